"""Severity count matrices, rates, rankings and comparisons.

The core is ``severity_matrix``: one hash aggregate per grouping key with one
conditional count per class. The partial (map-side) aggregate emits one row
per key per input partition, so a key holding a third of all rows costs no
more shuffle than any other key, and the shuffled data is the size of the
result, not of the input. Everything downstream (rates, rankings, tiers,
comparisons) runs on that small result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravis import SEVERITY_CLASSES
from gravis.functions.scalar import rel_diff_pct, week_of_month

TARGET = "gravidade_lesao"


def _cls(c: str) -> str:
    return c.lower()


def count_col(c: str) -> str:
    return f"n_{_cls(c)}"


def rate_col(c: str) -> str:
    return f"{_cls(c)}_rate"


def severity_counts(df: DataFrame, keys: Sequence[str], target: str = TARGET,
                    classes: Sequence[str] = SEVERITY_CLASSES,
                    dropna: bool = True) -> DataFrame:
    """Rows per key and class (``n_<class>``) plus the key total.

    Like pandas ``groupby([k, G]).size().unstack(fill_value=0)``: rows with a
    missing key or target are not counted (``dropna``), and an absent class
    still gets a 0 column because the class list is explicit.
    """
    keys = list(keys)
    if dropna:
        cond = F.col(target).isNotNull()
        for k in keys:
            cond = cond & F.col(k).isNotNull()
        df = df.filter(cond)
    aggs = [F.count(F.when(F.col(target) == c, F.lit(1))).alias(count_col(c)) for c in classes]
    aggs.append(F.count(F.lit(1)).alias("total"))
    return df.groupBy(*keys).agg(*aggs)


def with_rates(counts: DataFrame, classes: Sequence[str] = SEVERITY_CLASSES,
               scale: int = 1, total: str = "total") -> DataFrame:
    """Row-normalise the class counts: ``<class>_rate = scale * n / total``."""
    cols = [(F.lit(scale) * F.col(count_col(c)) / F.col(total)).alias(rate_col(c))
            if scale != 1 else (F.col(count_col(c)) / F.col(total)).alias(rate_col(c))
            for c in classes]
    return counts.select("*", *cols)


def severity_matrix(df: DataFrame, keys: Sequence[str], target: str = TARGET,
                    classes: Sequence[str] = SEVERITY_CLASSES, scale: int = 1,
                    dropna: bool = True) -> DataFrame:
    """Counts, totals and row-normalised rates by key (crosstab normalised by
    index). ``scale=100`` gives percentages."""
    return with_rates(severity_counts(df, keys, target, classes, dropna), classes, scale)


def severity_matrices(df: DataFrame, key_sets: Sequence[Sequence[str]], target: str = TARGET,
                      classes: Sequence[str] = SEVERITY_CLASSES, scale: int = 1) -> list[DataFrame]:
    """Several severity matrices from ONE scan: a grouping-sets aggregate
    (Spark expands each row once per set before the partial aggregate), then
    one slice per key set. Rows with a missing target are not counted; a row
    with a missing key is left out of the sets that use that key (as
    ``severity_matrix`` does). The aggregate is small (one row per key value
    per set) and is checkpointed, so the slices do not re-read the input."""
    from gravis.session import cut_lineage
    sets = [list(ks) for ks in key_sets]
    cols = sorted({c for ks in sets for c in ks})
    src = df.filter(F.col(target).isNotNull())
    aggs = [F.count(F.when(F.col(target) == c, F.lit(1))).alias(count_col(c)) for c in classes]
    aggs += [F.count(F.lit(1)).alias("total"),
             F.grouping_id(*[F.col(c) for c in cols]).alias("_gid")]
    fine = cut_lineage(src.groupingSets([[F.col(c) for c in ks] for ks in sets], *cols).agg(*aggs))
    out = []
    for ks in sets:
        gid = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in ks)
        part = fine.filter(F.col("_gid") == gid)
        for c in ks:
            part = part.filter(F.col(c).isNotNull())
        part = part.select(*ks, *[count_col(c) for c in classes], "total")
        out.append(with_rates(part, classes, scale))
    return out


def with_week_of_month(df: DataFrame, day: str = "dia_sinistro",
                       out: str = "semana_mes") -> DataFrame:
    return df.withColumn(out, week_of_month(day))


def min_support(matrix: DataFrame, n: int, total: str = "total") -> DataFrame:
    """Keep groups with at least ``n`` rows (a HAVING on the aggregate)."""
    return matrix.filter(F.col(total) >= n)


def ranked(df: DataFrame, order: Sequence[Column], k: int | None = None,
           position: str = "posicao") -> DataFrame:
    """Order, optionally keep the first ``k`` and number the rows 1..n.

    ``order`` must end with a unique key so ties are broken deterministically.
    With ``k`` the limit runs first (a distributed top-k: each partition keeps
    its best k), so the numbering window only ever sees k rows. Without ``k``
    the window runs over the whole input: use it on aggregated tables only.
    """
    order = list(order)
    if k is not None:
        df = df.orderBy(*order).limit(k)
    w = Window.orderBy(*order)
    return df.withColumn(position, F.row_number().over(w))


def top_k_keys(matrix: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` keys of a ranking, as a one-column table (k rows)."""
    return matrix.orderBy(*order).limit(k).select(key)


def semi_join_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``. ``keys`` here is always a top-k
    list (k rows, a proven bound), so it is broadcast and the large side is
    never shuffled."""
    return df.join(F.broadcast(keys), on=on, how="left_semi")


def rate_stats(matrix: DataFrame, rate: str, prefix: str = "") -> DataFrame:
    """Unweighted mean, median and sample std of a rate over the groups."""
    return matrix.agg(
        F.avg(rate).alias(f"{prefix}mean"),
        F.median(rate).alias(f"{prefix}median"),
        F.stddev_samp(rate).alias(f"{prefix}std"),
        F.count(F.lit(1)).alias(f"{prefix}groups"),
    )


def argmax_per_group(matrix: DataFrame, group: str, order_key: str, value: str,
                     out_key: str | None = None, out_value: str | None = None) -> DataFrame:
    """Row with the largest ``value`` per ``group``; the smallest ``order_key``
    wins ties (pandas ``idxmax`` returns the first label). The window is
    partitioned by ``group`` and runs on an aggregated table."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(order_key).asc())
    out = (matrix.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
           .select(group, F.col(order_key).alias(out_key or order_key),
                   F.col(value).alias(out_value or value)))
    return out


def compare_two_keys(matrix: DataFrame, key: str, a, b, value: str,
                     names: tuple[str, str] = ("rate_a", "rate_b")) -> DataFrame:
    """One row: value at key ``a``, value at key ``b`` and their relative
    difference in percent. A missing key gives null, not an error."""
    va = F.max(F.when(F.col(key) == a, F.col(value))).alias(names[0])
    vb = F.max(F.when(F.col(key) == b, F.col(value))).alias(names[1])
    out = matrix.agg(va, vb)
    return out.withColumn("diff_pct", rel_diff_pct(names[0], names[1]))


def cluster_vs_rest(matrix: DataFrame, key: str, members: Sequence, value: str) -> DataFrame:
    """Mean of ``value`` over the member keys vs the mean over all other keys,
    and the relative impact in percent."""
    inside = F.col(key).isin(list(members))
    out = matrix.agg(F.avg(F.when(inside, F.col(value))).alias("cluster_mean"),
                     F.avg(F.when(~inside, F.col(value))).alias("others_mean"))
    return out.withColumn("impact_pct", rel_diff_pct("cluster_mean", "others_mean"))


def one_vs_others(matrix: DataFrame, key: str, chosen, values: Sequence[str]) -> DataFrame:
    """For each value column: the chosen key's value and the mean over the
    other keys, as long rows (measure, chosen, others_mean). If the chosen key
    is absent, the first key in sort order stands in and the others are all
    keys (the reference's fallback). One aggregate, no join."""
    is_key = F.col(key) == chosen
    aggs = [F.max(F.when(is_key, 1).otherwise(0)).alias("_present")]
    for v in values:
        aggs += [F.max(F.when(is_key, F.col(v))).alias(f"{v}__k"),
                 F.avg(F.when(~is_key, F.col(v))).alias(f"{v}__o"),
                 F.min_by(F.col(v), F.col(key)).alias(f"{v}__first"),
                 F.avg(F.col(v)).alias(f"{v}__all")]
    wide = matrix.agg(*aggs)
    present = F.col("_present") == 1
    picked = wide.select(*[c for v in values for c in (
        F.when(present, F.col(f"{v}__k")).otherwise(F.col(f"{v}__first")).alias(f"{v}__k"),
        F.when(present, F.col(f"{v}__o")).otherwise(F.col(f"{v}__all")).alias(f"{v}__o"))])
    stack = ", ".join(f"'{v}', `{v}__k`, `{v}__o`" for v in values)
    return picked.selectExpr(f"stack({len(values)}, {stack}) AS (measure, chosen, others_mean)")


def flag_members(df: DataFrame, key: str, members: Sequence, out: str = "destaque") -> DataFrame:
    return df.withColumn(out, F.col(key).isin(list(members)))
