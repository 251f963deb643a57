"""Exact, seeded, partition-independent sampling: stratified hold-out split,
random under-sampling, fixed-size samples and class weights.

``rand(seed)`` depends on how rows are partitioned, so every random choice
here is an order by the MD5 of ids and seed instead (``order_key``), which other
engines compute alike: SQL can name the chosen rows. Ranking all rows of a
stratum in one window would put a whole class (often most of the data) in one
task, so ``hash_rank`` splits each stratum into hash-RANGE buckets: buckets
are equally full because the hash is uniform, bucket order is hash order, and
a small per-bucket count table gives each bucket its rank offset. The only
windows are per (stratum, bucket), each ~rows/buckets rows, whatever the skew
of the strata.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 200_000
SAMPLE_RANGES = 4096  # key ranges a stratified sample tells apart
KEY_DIGITS = 13  # leading hex digits that choose a bucket: exact in a double


def order_key(id_cols: Sequence[str], seed: int) -> F.Column:
    """Hex MD5 of the ids and the seed, joined by colons (a null id is empty)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def bucket_count(total_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets grow with the data, so a bucket holds ~rows_per_bucket rows."""
    return int(min(1 << 20, max(16, total_rows // rows_per_bucket)))


def hash_bucket(key: F.Column, nb: int) -> F.Column:
    """Order-preserving bucket of an ``order_key``: equal-width key ranges,
    so buckets are equally full and bucket order is key order."""
    head = F.conv(F.substring(key, 1, KEY_DIGITS), 16, 10).cast("double")
    return F.floor(head / F.lit(float(16 ** KEY_DIGITS)) * F.lit(nb))


def stratum_counts(df: DataFrame, strata: Sequence[str]) -> dict[tuple, int]:
    """Rows per stratum, on the driver (strata are class labels: a few rows)."""
    rows = df.groupBy(*strata).count().collect() if strata else [((), df.count())]
    if not strata:
        return {(): rows[0][1]}
    return {tuple(r[s] for s in strata): r["count"] for r in rows}


def hash_rank(df: DataFrame, strata: Sequence[str], id_cols: Sequence[str], seed: int,
              rank_col: str = "_rank", n_col: str = "_stratum_n",
              total_rows: int | None = None) -> DataFrame:
    """Add the exact 1-based rank of each row inside its stratum in
    ``order_key`` order (ties by id), and the stratum size."""
    strata = list(strata)
    if total_rows is None:
        total_rows = df.count()
    nb = bucket_count(total_rows)
    x = df.withColumn("_h", order_key(id_cols, seed)).withColumn("_b", hash_bucket(F.col("_h"), nb))
    per_bucket = x.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    ws = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
    offsets = per_bucket.select(
        *strata, "_b",
        F.coalesce(F.sum("_bn").over(ws.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        F.sum("_bn").over(ws).alias(n_col))
    j = x.join(offsets, on=[*strata, "_b"], how="inner")
    wb = Window.partitionBy(*strata, "_b").orderBy("_h", *id_cols)
    return (j.withColumn(rank_col, F.col("_off") + F.row_number().over(wb))
             .drop("_h", "_b", "_off"))


def test_quotas(counts: dict[tuple, int], fraction: float) -> dict[tuple, int]:
    """Test rows per class: ``ceil(fraction * n)`` in all, allotted in
    proportion; what rounding down leaves goes to the largest remainders
    (ties: sorted class)."""
    n = sum(counts.values())
    if not n:
        return {}
    total = math.ceil(round(fraction * n, 9))
    share = {k: total * c / n for k, c in counts.items()}
    quota = {k: math.floor(v) for k, v in share.items()}
    most = sorted(counts, key=lambda k: (quota[k] - share[k], tuple(map(str, k))))
    for k in most[:total - sum(quota.values())]:
        quota[k] += 1
    return quota


def stratified_split(df: DataFrame, label: str, id_cols: Sequence[str], test_fraction: float,
                     seed: int, flag: str = "is_test") -> DataFrame:
    """Exact stratified hold-out: in each class the rows with the smallest
    hashes are test rows, as many as ``test_quotas`` gives the class. Same
    seed, same split, whatever the partitioning."""
    counts = stratum_counts(df, [label])
    quotas = test_quotas(counts, test_fraction)
    if not quotas:
        return df.withColumn(flag, F.lit(False))
    r = hash_rank(df, [label], id_cols, seed, total_rows=sum(counts.values()))
    # class labels: a few; rows without a label are never test rows
    per_class = F.create_map(*[F.lit(x) for k, q in quotas.items() if k[0] is not None for x in (k[0], q)])
    return r.withColumn(flag, F.coalesce(F.col("_rank") <= F.try_element_at(per_class, F.col(label)), F.lit(False))).drop("_rank", "_stratum_n")


def undersample(df: DataFrame, label: str, id_cols: Sequence[str], seed: int) -> DataFrame:
    """Random under-sampling without replacement: every class keeps as many
    rows as the smallest class has."""
    counts = stratum_counts(df, [label])
    if not counts:
        return df
    smallest = min(counts.values())
    r = hash_rank(df, [label], id_cols, seed, total_rows=sum(counts.values()))
    return r.filter(F.col("_rank") <= smallest).drop("_rank", "_stratum_n")


def seeded_sample(df: DataFrame, n: int, id_cols: Sequence[str], seed: int) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement, chosen by hash
    order. The sample is a feature here (a sampling operator), so the row cap
    is its definition, not a shortcut. Buckets are key ranges, so only the rows
    of the first ones, up to the one that holds the n-th row, are sorted."""
    keyed = df.withColumn("_h", order_key(id_cols, seed))
    x = keyed.withColumn("_b", hash_bucket(F.col("_h"), bucket_count(df.count())))
    counts = x.groupBy("_b").agg(F.count(F.lit(1)).alias("_bn"))
    before = F.sum("_bn").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_bn")  # a row a bucket
    first = counts.select("_b", before.alias("_off")).filter(F.col("_off") < n)
    # no row beyond the n-th of a bucket is wanted: cut before the window's shuffle, where the rank is known
    inside = x.join(F.broadcast(first), "_b").withColumn(
        "_place", F.row_number().over(Window.partitionBy("_b").orderBy("_h", *id_cols))).filter(F.col("_place") <= n)
    return inside.filter(F.col("_off") + F.col("_place") <= n).select(*[F.col(f"`{c}`") for c in df.columns])


def class_quotas(counts: dict[tuple, int], n: int) -> dict[tuple, int]:
    """Rows per class of a sample of at most ``n``: half of it in equal parts (a
    rare class gives all it has), the rest in proportion to what is left."""
    if sum(counts.values()) <= n:
        return dict(counts)
    quota = {k: min(c, n // (2 * len(counts))) for k, c in counts.items()}
    left = {k: c - quota[k] for k, c in counts.items()}
    room, total = n - sum(quota.values()), sum(left.values())
    return {k: q + room * left[k] // total for k, q in quota.items()}


def stratified_sample(df: DataFrame, label: str, id_cols: Sequence[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, as many of each class as ``class_quotas`` gives it, in
    hash order. One scan counts the rows per class and key range; only the ranges up
    to the one that holds a class's last wanted row are read again, and the plan of
    ``df`` can drop the other rows as early as it has ``id_cols`` and the label."""
    key = hash_bucket(order_key(id_cols, seed), SAMPLE_RANGES)
    per_range = {}  # a few classes, SAMPLE_RANGES numbers each
    for r in df.select(F.col(label).alias("k"), key.alias("b")).groupBy("k", "b").count().collect():
        per_range.setdefault((r["k"],), {})[r["b"]] = r["count"]
    quotas = class_quotas({k: sum(c.values()) for k, c in per_range.items()}, n)
    if not quotas:
        return df
    wanted = [(k[0], *_last_range(per_range[k], q)) for k, q in quotas.items() if k[0] is not None and q]
    if not wanted:
        return df.filter(F.lit(False))
    last, left = (F.try_element_at(F.create_map(*[F.lit(x) for w in wanted for x in (w[0], w[i])]), F.col(label)) for i in (1, 2))
    rows = df.filter(key <= last).withColumn("_h", order_key(id_cols, seed)).withColumn("_b", key)
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", *id_cols))
    return rows.withColumn("_place", place).filter((F.col("_b") < last) | (F.col("_place") <= left)).select(
        *[F.col(f"`{c}`") for c in df.columns])


def _last_range(counts: dict[int, int], wanted: int) -> tuple[int, int]:
    """The range that holds the last of ``wanted`` rows, and how many of its rows are wanted."""
    for b in sorted(counts):
        if wanted <= counts[b]:
            break
        wanted -= counts[b]
    return b, wanted


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Class weight n / (k * n_c) per row (scikit-learn's 'balanced'). The
    class counts (one per class) enter the rows as a literal map."""
    stats = stratum_counts(df, [label])
    n, k = sum(stats.values()), len(stats)
    weights = F.create_map(*[x for key, nc in stats.items() for x in (F.lit(key[0]), F.lit(n / (k * nc)))])
    return df.withColumn(out, weights[F.col(label)])


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    """(label, n_c, weight) with weight = n / (k * n_c), from one aggregate."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(F.lit(0))
    return counts.select(label, "n_c",
                         (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c"))).alias("weight"))
