"""Descriptive statistics, distribution summaries and association measures.

Design rules used throughout:
- one aggregate computes every statistic a report needs (many columns, many
  measures), so the data is scanned once;
- statistics that rows are compared against (fences, bin edges, grid points)
  are one small row collected to the driver and used as literals, never a
  join or a cross join with the data;
- correlations are guarded: under ANSI mode ``corr`` of a constant column
  raises, so r = covar_pop / (std_pop * std_pop) via ``try_divide`` (null when
  undefined), with pairwise null masking.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravis.session import cut_lineage


def _c(c):
    return F.col(c) if isinstance(c, str) else c


_SALTS = 16


# --- sorted codes -----------------------------------------------------------

def sorted_codes(values: DataFrame, keys: Sequence[str], value: str, out: str = "code") -> DataFrame:
    """Distinct (keys, value) with the 0-based position of the value in the
    sorted order of its keys. The distinct values are dealt by range, counted
    per range, and numbered inside a range, so no task holds all of them."""
    spark = values.sparkSession
    keys = list(keys)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(values.select(*keys, value).distinct().repartitionByRange(n, *keys, value)
                        .withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(*keys, "_range", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range"))
                                            - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(value))
    return dealt.withColumn("_place", place).join(before, [*keys, "_range"]).select(
        *keys, value, (F.col("_before") + F.col("_place") - 1).alias(out))


# --- grouped descriptive statistics ---------------------------------------

def exact_quantiles(df: DataFrame, value: str, groups: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles per group as columns p0, p1, ...: counts
    per distinct value, ranks from counts per value range, and a pick of the
    two values around each rank. Bounded memory for any number of values."""
    groups = list(groups)
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    dealt = cut_lineage(counts.repartitionByRange(n, *groups, "_v").withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*groups, "_range").agg(F.sum("_c").alias("_n"))
    own = Window.partitionBy(*groups)
    sizes = sizes.select(*groups, "_range", F.sum("_n").over(own).alias("_total"),
                         (F.sum("_n").over(own.orderBy("_range")) - F.col("_n")).alias("_before"))
    upto = F.sum("_c").over(Window.partitionBy(*groups, "_range").orderBy("_v"))
    same = F.lit(True)
    ranged = dealt.withColumn("_upto", upto)
    for c in [*groups, "_range"]:
        same = same & ranged[c].eqNullSafe(sizes[c])
    ranked = ranged.join(sizes, same).select(
        *[ranged[c] for c in groups], "_v", "_total", (F.col("_before") + F.col("_upto")).alias("_last"),
        (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_first"))
    aggs = []
    for i, f in enumerate(fractions):
        at = (F.col("_total") - 1) * F.lit(float(f))
        for name, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_last")), F.col("_v"))).alias(f"_{name}{i}"))
    picked = ranked.groupBy(*groups).agg(F.max("_total").alias("_total"), *aggs)
    out = []
    for i, f in enumerate(fractions):
        at = (F.col("_total") - 1) * F.lit(float(f))
        part = at - F.floor(at)
        out.append(((1 - part) * F.col(f"_lo{i}") + part * F.col(f"_hi{i}")).alias(f"p{i}"))
    return picked.select(*groups, *out)


def quartiles_by_group(df: DataFrame, value: str, group: str, approx: bool = False) -> DataFrame:
    """group, q1, median, q3: exact, or ``percentile_approx`` in one aggregate."""
    if approx:
        q = df.filter(F.col(value).isNotNull()).groupBy(group).agg(_quartiles(F.col(value)).alias("_q"))
        return q.select(group, *[F.col("_q")[i].cast("double").alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    return exact_quantiles(df, value, [group], (0.25, 0.5, 0.75)).select(
        group, F.col("p0").alias("q1"), F.col("p1").alias("median"), F.col("p2").alias("q3"))


def _quartiles(x: Column) -> Column:
    return F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 100_000)


def describe_by_group(df: DataFrame, value: str, group: str | Sequence[str], approx: bool = False) -> DataFrame:
    """count, mean, sample std, min, quartiles and max of ``value`` per
    group (pandas ``groupby().describe()``); missing values are skipped."""
    groups = [group] if isinstance(group, str) else list(group)
    x = F.col(value)
    src = df.filter(x.isNotNull())
    aggs = [F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).cast("double").alias("min"), F.max(x).cast("double").alias("max")]
    names = [*groups, "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    if approx:
        out = src.groupBy(*groups).agg(*aggs, _quartiles(x).alias("_q"))
        return out.select("*", *[F.col("_q")[i].alias(c) for i, c in enumerate(("q25", "q50", "q75"))]).select(*names)
    q = exact_quantiles(src, value, groups, (0.25, 0.5, 0.75)).select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("p0").alias("q25"), F.col("p1").alias("q50"), F.col("p2").alias("q75"))
    same = functools.reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)])
    return src.groupBy(*groups).agg(*aggs).join(q, same).select(*names)  # one row per group on both sides


def std_by_group(df: DataFrame, value: str, group: str, places: int | None = 2) -> DataFrame:
    """Sample std per group (a one-row group gives null), optionally rounded
    half-even as pandas does."""
    s = F.stddev_samp(value)
    return df.groupBy(group).agg((F.bround(s, places) if places is not None else s).alias("std"))


def box_summary(df: DataFrame, value: str, group: str, k: float = 1.5, approx: bool = False) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers at the farthest point
    inside the 1.5 IQR fences, and the outlier count.

    Pass 1 aggregates the quartiles per group; pass 2 joins them to the rows
    and applies the fences in one more aggregate. The quartile table is listed
    once per salt, so a group of a third of all rows is spread over tasks when
    the table is too large to broadcast.
    """
    x = F.col(value)
    src = df.filter(x.isNotNull() & F.col(group).isNotNull()).select(group, value)
    q = quartiles_by_group(src, value, group, approx)
    salted = src.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(_SALTS)).cast("int"))
    listed = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = salted.join(listed, [group, "_salt"])
    spread = F.col("q3") - F.col("q1")
    inside = (x >= F.col("q1") - k * spread) & (x <= F.col("q3") + k * spread)
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, x)).cast("double").alias("whisker_low"),
        F.max(F.when(inside, x)).cast("double").alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers")).select(
        group, "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")


# --- distributions ----------------------------------------------------------

def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin is closed, as in
    numpy. Empty bins are included (1..bins with a zero count). Bin edges
    come from one scalar aggregate; the bin of a row is arithmetic."""
    src = df.filter(F.col(value).isNotNull())
    r = src.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    lo, hi = float(lo), float(hi)
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    b = (F.least(F.floor((F.col(value) - F.lit(lo)) * F.lit(bins) / F.lit(hi - lo)), F.lit(bins - 1))
         .cast("int") + 1)
    counts = src.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    grid = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).alias("n")))


def gaussian_density(df: DataFrame, value: str, points: int) -> DataFrame:
    """Gaussian kernel density on ``points`` evenly spaced grid points over
    [min, max], Scott bandwidth ``std * n^(-1/5)`` (sample std, as a kernel
    density estimate with the data covariance uses). One pass computes all
    grid sums as separate aggregate expressions: no join with a grid table."""
    src = df.filter(F.col(value).isNotNull())
    # the grid meets distinct values with their counts, not rows
    weighted = src.groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    st = src.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(value).alias("s"),
                 F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    n, s, lo, hi = st["n"], st["s"], st["lo"], st["hi"]
    spark = df.sparkSession
    if not n or not s:
        return spark.createDataFrame([], "ponto int, x double, densidade double")
    bw = s * n ** (-1.0 / 5.0)
    step = (float(hi) - float(lo)) / (points - 1) if points > 1 else 0.0
    grid = [float(lo) + i * step for i in range(points)]
    norm = 1.0 / (n * bw * math.sqrt(2.0 * math.pi))
    x = F.col("_v")
    aggs = [F.sum(F.col("_c") * F.exp(-F.pow((F.lit(g) - x) / F.lit(bw), 2) / 2.0)).alias(f"d{i}")
            for i, g in enumerate(grid)]
    wide = weighted.agg(*aggs)
    stack = ", ".join(f"{i}, CAST({g!r} AS DOUBLE), d{i}" for i, g in enumerate(grid))
    long = wide.selectExpr(f"stack({points}, {stack}) AS (ponto, x, s)")
    return long.select(F.col("ponto").cast("int").alias("ponto"), "x",
                       (F.col("s") * F.lit(norm)).alias("densidade"))


# --- association ------------------------------------------------------------

def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r with pairwise deletion; null when a side is constant (by its
    least and greatest value: merged deviations of a constant are not exactly 0)."""
    x, y = _c(x), _c(y)
    both = x.isNotNull() & y.isNotNull()
    xm, ym = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(xm, ym), F.stddev_pop(xm) * F.stddev_pop(ym))
    return F.when((F.min(xm) < F.max(xm)) & (F.min(ym) < F.max(ym)), r)


def correlations_with(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """(variavel, r) of every column against ``target`` from ONE aggregate."""
    cols = list(cols)
    wide = df.agg(*[safe_corr(c, target).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (variavel, r)")


def target_class_stats(df: DataFrame, target: str, text_cols: Sequence[str],
                       numeric_cols: Sequence[str], missing: str = "MISSING") -> DataFrame:
    """(variavel, y, n, m, v, lo, hi): per feature and target class the number of
    values, their mean and population variance, least and greatest value, and the
    class code. Text features count as their sorted-order codes (missing text is
    ``missing``); the class code is the target's sorted-order code.

    One grouping-sets scan gives the row count of every (text value, class)
    and, per class, the moments of every number; codes (of all variables and the
    target at once) and moments of the text features are made from that grouped
    table, in Spark for any cardinality.
    """
    text_cols, numeric_cols = list(text_cols), list(numeric_cols)
    y = F.coalesce(F.col(target).cast("string"), F.lit(missing)).alias("_y")
    xs = [F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(f"_t{i}") for i, c in enumerate(text_cols)]
    src = df.select(y, *xs, *[F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(numeric_cols)])
    cols = ["_y"] + [f"_t{i}" for i in range(len(text_cols))]
    sets = [["_y"]] + [[c, "_y"] for c in cols[1:]]
    aggs = [F.count(F.lit(1)).alias("_cnt"), F.grouping_id(*[F.col(c) for c in cols]).alias("_gid")]
    for i in range(len(numeric_cols)):
        x = f"_n{i}"
        aggs += [F.count(x).alias(f"c{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
    grouped = cut_lineage(src.groupingSets([[F.col(c) for c in st] for st in sets], *cols).agg(*aggs))

    def gid_of(keep):
        return sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in keep)

    # position of the variable among the text columns, -1 for the target itself
    of = F.element_at(F.create_map(*[v for i in range(-1, len(text_cols)) for v in (
        F.lit(gid_of({f"_t{i}", "_y"})).cast("long"), F.lit(i))]), F.col("_gid"))
    cells = grouped.select(of.alias("_var"), F.coalesce(*cols[1:], "_y").alias("_x"), "_y", "_cnt")
    coded = cells.join(sorted_codes(cells, ["_var"], "_x", "_code"), ["_var", "_x"])
    y_codes = coded.filter("_var = -1").select("_y", F.col("_code").cast("double").alias("y"))
    parts = []
    if text_cols:
        c, k = F.col("_cnt").cast("double"), F.col("_code").cast("double")
        text = coded.filter("_var >= 0").select("_var", "_y", c.alias("_c"), k.alias("_k"))
        means = text.groupBy("_var", "_y").agg(F.sum("_c").alias("n"), (F.sum(F.col("_c") * F.col("_k")) / F.sum("_c")).alias("m"),
                                               F.min("_k").alias("lo"), F.max("_k").alias("hi"))
        names = F.array(*[F.lit(x) for x in text_cols])
        spread = text.join(means, ["_var", "_y"]).groupBy("_var", "_y", "n", "m", "lo", "hi").agg(
            F.sum(F.col("_c") * F.pow(F.col("_k") - F.col("m"), 2)).alias("_q"))
        parts.append(spread.select(names[F.col("_var")].alias("variavel"), "_y", F.col("n").cast("long").alias("n"), "m",
                                   (F.col("_q") / F.col("n")).alias("v"), "lo", "hi"))
    if numeric_cols:
        by_class = grouped.filter(F.col("_gid") == gid_of({"_y"}))
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("variavel"), F.col(f"c{i}").alias("n"), F.col(f"m{i}").alias("m"),
                                            F.coalesce(F.col(f"v{i}"), F.lit(0.0)).alias("v"), F.col(f"l{i}").alias("lo"),
                                            F.col(f"h{i}").alias("hi")) for i, c in enumerate(numeric_cols)]))
        parts.append(by_class.select("_y", each.alias("s")).select("s.variavel", "_y", "s.n", "s.m", "s.v", "s.lo", "s.hi").filter("n > 0"))
    per = functools.reduce(DataFrame.unionByName, parts)
    # deviations of a constant are not exactly 0 after merging; its least and greatest value are equal
    return per.join(y_codes, "_y").select("variavel", "y", "n", "m", F.when(F.col("lo") < F.col("hi"), F.col("v")).otherwise(0.0).alias("v"),
                                          "lo", "hi")


def _moments(per: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per variable n, mx, my, cov, vx, vy (population) from the per-class
    moments: the class code is constant within a class, so the law of total
    variance gives them exactly. vx and vy are exactly 0 for a constant. Variables
    without values have n = 0."""
    w = Window.partitionBy("variavel")
    n = F.col("n")
    total = F.sum(n).over(w)
    p = per.select("*", total.alias("_n"), (F.sum(n * F.col("m")).over(w) / total).alias("mx"),
                   (F.sum(n * F.col("y")).over(w) / total).alias("my"))
    dx, dy = F.col("m") - F.col("mx"), F.col("y") - F.col("my")

    def spread(total_sum, lo, hi):
        return F.when(F.min(lo) < F.max(hi), total_sum / F.max("_n")).otherwise(0.0)
    got = p.groupBy("variavel").agg(
        F.max("_n").alias("n"), F.max("mx").alias("mx"), F.max("my").alias("my"),
        (F.sum(n * dx * dy) / F.max("_n")).alias("cov"), spread(F.sum(n * (F.col("v") + dx * dx)), "lo", "hi").alias("vx"),
        spread(F.sum(n * dy * dy), "y", "y").alias("vy"))
    listed = per.sparkSession.createDataFrame([(c,) for c in names], "variavel string")
    return listed.join(got, "variavel", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def target_correlations(df: DataFrame, target: str, text_cols: Sequence[str],
                        numeric_cols: Sequence[str], missing: str = "MISSING") -> DataFrame:
    """(variavel, r) of every column against the target code, from one scan
    (see ``target_class_stats``)."""
    m = _moments(target_class_stats(df, target, text_cols, numeric_cols, missing), [*text_cols, *numeric_cols])
    return m.select("variavel", F.when((F.col("vx") > 0) & (F.col("vy") > 0),
                                       F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))).alias("r"))


def target_regressions(df: DataFrame, target: str, text_cols: Sequence[str],
                       numeric_cols: Sequence[str], missing: str = "MISSING") -> DataFrame:
    """Least-squares line of the target code on each column (slope,
    intercept, r^2, n), from one scan (see ``target_class_stats``)."""
    m = _moments(target_class_stats(df, target, text_cols, numeric_cols, missing), [*text_cols, *numeric_cols])
    slope = F.when(F.col("vx") > 0, F.col("cov") / F.col("vx"))
    r2 = F.when(F.col("vx") > 0, F.when(F.col("vy") > 0, F.col("cov") * F.col("cov") / (F.col("vx") * F.col("vy"))).otherwise(1.0))
    return m.select("variavel", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
                    r2.alias("r2"), "n")


def target_anova(df: DataFrame, target: str, text_cols: Sequence[str],
                 numeric_cols: Sequence[str], missing: str = "MISSING") -> DataFrame:
    """One-way ANOVA F of each column across the target classes, from one
    scan (see ``target_class_stats``): for two classes F equals the pooled
    two-sample t squared, with the same p-value."""
    per = target_class_stats(df, target, text_cols, numeric_cols, missing)
    w = Window.partitionBy("variavel")
    n = F.col("n")
    grand = F.sum(n * F.col("m")).over(w) / F.sum(n).over(w)
    s = per.select("*", F.pow(F.col("m") - grand, 2).alias("_d2")).groupBy("variavel").agg(
        F.count(F.lit(1)).alias("grupos"), F.sum(n).alias("n"), F.sum(n * F.col("_d2")).alias("ssb"),
        F.sum(n * F.col("v")).alias("ssw")).filter("grupos >= 2")  # ssw is exactly 0 where every class is constant
    df1, df2 = F.col("grupos") - 1, F.col("n") - F.col("grupos")
    f = F.when((F.col("ssw") > 0) & (df2 > 0), (F.col("ssb") / df1) / (F.col("ssw") / df2))
    return s.select("variavel", "grupos", "n", df1.alias("df1"), df2.alias("df2"), f.alias("f"),
                    F.when(F.col("grupos") == 2, F.lit("T-test")).otherwise(F.lit("ANOVA")).alias("teste"))


def correlation_ranking(corrs: DataFrame) -> DataFrame:
    """Drop undefined correlations, order by |r| descending (name breaks
    ties) and number the rows; the input is one row per variable."""
    ok = corrs.filter(F.col("r").isNotNull())
    w = Window.orderBy(F.abs("r").desc(), F.col("variavel").asc())
    return ok.withColumn("abs_r", F.abs("r")).withColumn("posicao", F.row_number().over(w))


_SHIFT_ROWS = 1000  # rows whose mean the numbers are taken against; any shift gives the same moments


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All pairwise Pearson correlations of ``cols`` (long form: var_a, var_b,
    r; null where a side is constant over the pair's rows), pairwise-complete like
    pandas. One aggregate per pattern of missing values: counts, sums and products
    against a shift, least and greatest values; a pair adds up the patterns in
    which both sides are there."""
    cols = list(cols)
    src = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    sample = src.limit(_SHIFT_ROWS).agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(cols))]).first()
    here = functools.reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(f"x{i}").isNotNull(), 1 << i).otherwise(0) for i in range(len(cols))])
    shifted = src.select(here.cast("long").alias("here"), *[
        F.coalesce(F.col(f"x{i}") - F.lit(float(sample[f"x{i}"] or 0.0)), F.lit(0.0)).alias(f"x{i}") for i in range(len(cols))])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    per = shifted.groupBy("here").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(len(cols))],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs],
        *[f(f"x{i}").alias(f"{k}{i}") for i in range(len(cols)) for k, f in (("l", F.min), ("h", F.max))])
    each = F.explode(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}").alias("sx"), F.col(f"s{j}").alias("sy"), F.col(f"p{i}_{j}").alias("xy"),
        F.col(f"p{i}_{i}").alias("xx"), F.col(f"p{j}_{j}").alias("yy"), F.col(f"l{i}").alias("lx"), F.col(f"h{i}").alias("hx"),
        F.col(f"l{j}").alias("ly"), F.col(f"h{j}").alias("hy")) for i, j in pairs])).alias("q")
    q = per.select("here", "n", each).select("here", "n", "q.*")
    both = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i")).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j")))
    t = q.withColumn("ok", F.col("here").bitwiseAND(both) == both)

    def over(f, c):
        return f(F.when(F.col("ok"), F.col(c)))
    t = t.groupBy("i", "j").agg(*[over(F.sum, c).alias(c) for c in ("n", "sx", "sy", "xy", "xx", "yy")],
                                *[over(F.min, c).alias(c) for c in ("lx", "ly")], *[over(F.max, c).alias(c) for c in ("hx", "hy")])
    n = F.col("n")
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / n, F.col("yy") - F.col("sy") * F.col("sy") / n
    r = (F.col("xy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    defined = (F.col("lx") < F.col("hx")) & (F.col("ly") < F.col("hy")) & (vx > 0) & (vy > 0)
    r = F.when(defined, F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(r))
    names = F.array(*[F.lit(c) for c in cols])
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return t.select(F.explode(sides).alias("s"), r.alias("r")).select(
        names[F.col("s.i")].alias("var_a"), names[F.col("s.j")].alias("var_b"), "r")


# --- p-values ----------------------------------------------------------------

_F_STEPS = 2000  # Simpson steps of each integral


def f_survival(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f) for (df1, df2) degrees of freedom: the closed form for df1 = 2,
    else the ratio of two integrals of sin(t)^(df1-1) cos(t)^(df2-1), from the
    angle of f and from 0, in units of the density's width."""
    f, a, b = f.cast("double"), df1.cast("double"), df2.cast("double")
    start = F.atan(F.sqrt(F.greatest(f, F.lit(0.0)) * a / b))
    end = F.least(F.lit(math.pi / 2), F.sqrt(a / b) + 12 / F.sqrt(b))

    def integral(lo: Column, hi: Column) -> Column:
        h = (hi - lo) / _F_STEPS
        points = F.sequence(F.lit(0), F.lit(_F_STEPS))

        def term(acc: Column, i: Column) -> Column:
            t = lo + h * i
            weight = F.when((i == 0) | (i == _F_STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return acc + weight * F.pow(F.sin(t), a - 1) * F.pow(F.greatest(F.cos(t), F.lit(0.0)), b - 1)
        return F.aggregate(points, F.lit(0.0), term) * h
    tail = F.when(start >= end, 0.0).otherwise(integral(start, end) / integral(F.lit(0.0), end))
    return F.when(f.isNull() | (a <= 0) | (b <= 0), None).when(f <= 0, 1.0).when(
        a == 2, F.pow(1 + 2 * f / b, -b / 2)).otherwise(tail)


def with_p_value(ftable: DataFrame) -> DataFrame:
    """Add the F-test p-value and significance stars."""
    from gravis.functions.scalar import significance_stars
    out = ftable.withColumn("p_value", f_survival(F.col("f"), F.col("df1"), F.col("df2")))
    return out.withColumn("significancia", significance_stars("p_value"))
