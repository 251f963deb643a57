"""Frequency tables: value counts, shares and top-k per column.

Counts are hash aggregates with map-side combine; shares of all rows get
their denominator from the same scan (a grouping set with the empty set).
Top-k per column uses a ``row_number() <= k`` filter, which Spark plans with a
partial WindowGroupLimit before the shuffle, so each partition ships at most
k rows per column whatever the skew or the cardinality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """(value, n) per distinct value of ``col``."""
    src = df.filter(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def _with_grand_total(df: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Counts per ``keys`` (missing keys included) AND the grand total from
    ONE scan: a grouping-sets aggregate with the empty set. The grouped
    result (one row per key value) is checkpointed, then read twice."""
    from gravis.session import cut_lineage
    g = df.groupingSets([[F.col(k) for k in keys], []], *keys).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*[F.col(k) for k in keys]).alias("_gid"))
    g = cut_lineage(g)
    total = g.filter(F.col("_gid") != 0).select("n").first()
    return g.filter(F.col("_gid") == 0).drop("_gid"), (total["n"] if total else 0)


def value_counts_share(df: DataFrame, col: str) -> DataFrame:
    """Counts of the non-missing values with their share (percent) of ALL
    rows, missing included, and that total, from one scan of the input."""
    counts, total = _with_grand_total(df, [col])
    return counts.filter(F.col(col).isNotNull()).select(
        col, "n", (F.lit(100) * F.col("n") / F.lit(total)).alias("share_pct"),
        F.lit(total).cast("long").alias("total"))


def top_k_per_column(df: DataFrame, cols: Sequence[str], k: int,
                     with_share: bool = True) -> DataFrame:
    """The ``k`` most frequent values of each column, in ONE scan: the
    columns are unpivoted to (coluna, valor) and counted together.
    Ties go to the smaller value. Missing values are not counted."""
    cols = list(cols)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "coluna", "valor")
    # every input row yields one (coluna, valor) row per column, so the grand
    # total of the long table is rows x columns: one scan gives both
    grouped, long_total = _with_grand_total(long, ["coluna", "valor"])
    counts = grouped.filter(F.col("valor").isNotNull())
    w = Window.partitionBy("coluna").orderBy(F.col("n").desc(), F.col("valor").asc())
    top = counts.withColumn("posicao", F.row_number().over(w)).filter(F.col("posicao") <= k)
    if with_share:
        total = long_total // len(cols) if cols else 0
        top = top.withColumn("share_pct", F.lit(100) * F.col("n") / F.lit(total))
    return top
