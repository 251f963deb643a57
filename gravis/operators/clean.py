"""Cleaning operators: year filter, union of extracts, de-duplication,
sentinel recoding, exact median fill, IQR fences, population z-scores,
scope filters and completeness filters.

Statistics that a later step applies row by row (median, fences, mean/std)
come from ONE aggregate over the whole input; the driver receives a single
row of numbers, which then enter the row expressions as literals. That keeps
the row pass a narrow, codegen'd projection with no join at all, and it fixes
the statistics before any later filter (the reference fits them state-wide,
then narrows the scope).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gravis import NOT_AVAILABLE, UNKNOWN
from gravis.operators.stats import exact_quantiles

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


# --- schema selection ------------------------------------------------------

def columns_of_type(df: DataFrame, kind: str, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the numeric or string columns, minus ``exclude``."""
    ex = set(exclude)
    if kind == "numeric":
        pick = lambda t: isinstance(t, NUMERIC_TYPES)
    elif kind == "string":
        pick = lambda t: isinstance(t, T.StringType)
    else:
        raise ValueError(kind)
    return [f.name for f in df.schema.fields if pick(f.dataType) and f.name not in ex]


def drop_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the listed columns that exist (absent names are ignored)."""
    present = [n for n in names if n in df.columns]
    return df.drop(*present) if present else df


# --- year filter and union of extracts ---------------------------------------

def year_filter(df: DataFrame | None, col: str, years: Sequence[int]) -> DataFrame | None:
    """Keep rows whose year, read as a number, is one of ``years``.

    Text such as '2020.0' counts as 2020 (parsed as double first; an int
    cast of '2020.0' would be null) and junk is dropped. The column comes
    back as int. No input or no such column gives no table.
    """
    if df is None or col not in df.columns:
        return None
    y = F.col(col).try_cast("double")
    return df.filter(y.isin([float(v) for v in years])).withColumn(col, y.cast("int"))


def consolidate(*frames: DataFrame | None) -> DataFrame | None:
    """UNION ALL by column name over the union of the columns; a column an
    input lacks is null there. Missing inputs are skipped; none gives None."""
    valid = [f for f in frames if f is not None]
    if not valid:
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), valid)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Row DISTINCT over all columns (nulls compare equal). Partial
    aggregation collapses copies inside each input partition before the
    shuffle, so even a duplicate group holding a third of the rows sends one
    row per partition."""
    return df.distinct()


# --- sentinels and fills ---------------------------------------------------

def recode_and_fill(df: DataFrame, columns: Sequence[str] | None = None,
                    sentinel: str = NOT_AVAILABLE, fill: str = UNKNOWN) -> DataFrame:
    """In every string column: the sentinel becomes ``fill``, null becomes ``fill``."""
    cols = list(columns) if columns is not None else columns_of_type(df, "string")
    if not cols:
        return df
    return df.na.replace(sentinel, fill, subset=cols).na.fill(fill, subset=cols)


def exact_medians(df: DataFrame, cols: Sequence[str], approx: bool = False,
                  accuracy: int = 100_000) -> dict[str, float | None]:
    """Medians of several columns (mean of the two middle values), null for a
    column without values. Exact ones come from value counts and ranks, with
    bounded memory for any number of distinct values; ``approx=True`` uses
    ``percentile_approx`` (one aggregate, rank error 1/accuracy)."""
    cols = list(cols)
    if not cols:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in cols]).first()
        return {c: row[c] for c in cols}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])).alias("s")
    found = {r["c"]: r["p0"] for r in exact_quantiles(df.select(each).select("s.*"), "v", ["c"], (0.5,)).collect()}
    return {c: found.get(c) for c in cols}  # one row per column


def median_fill(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Fill missing numbers with the column's median. Every listed column
    becomes double, as a NaN-holding column does in pandas, whether or not it
    misses values; a column without values stays null. Medians are computed
    only for columns with missing values."""
    cols = list(columns) if columns is not None else columns_of_type(df, "numeric")
    if not cols:
        return df
    nulls = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]).first()
    meds = exact_medians(df, [c for c in cols if nulls[c]], approx=approx)
    return fill_with(df, {c: meds.get(c) for c in cols})


def fill_with(df: DataFrame, values: Mapping[str, float | None]) -> DataFrame:
    """Every listed column as double, its missing numbers filled with the value given."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v).cast("double")) for c, v in values.items()})


def iqr_fences(df: DataFrame, col: str, k: float = 1.5, approx: bool = False) -> tuple[float, float] | None:
    """Inclusive Tukey fences from exact, linearly interpolated quartiles
    (``approx=True``: ``percentile_approx``); None without values."""
    if approx:
        q = df.agg(F.percentile_approx(F.col(col), F.array(F.lit(0.25), F.lit(0.75)), 100_000).alias("q")).first()["q"]
    else:
        row = exact_quantiles(df, col, [], (0.25, 0.75)).first()
        q = (row["p0"], row["p1"]) if row is not None and row["p0"] is not None else None
    if q is None:
        return None
    q1, q3 = q[0], q[1]
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def iqr_filter(df: DataFrame, col: str, k: float = 1.5, approx: bool = False) -> DataFrame:
    """Keep rows with ``lower <= col <= upper``; a missing value fails the test."""
    return within(df, col, iqr_fences(df, col, k, approx))


def within(df: DataFrame, col: str, fences: tuple[float, float] | None) -> DataFrame:
    """Keep rows inside the fences (both included); no fences keep no row."""
    if fences is None:
        return df.filter(F.lit(False))
    lo, hi = fences
    return df.filter((F.col(col) >= F.lit(lo)) & (F.col(col) <= F.lit(hi)))


def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std; a constant column divides by 1 (as
    scikit-learn's scaler does). ``ml.feature.StandardScaler`` uses the sample
    std, so the statistics are computed here in one aggregate."""
    return scale_with(df, moments(df, cols), suffix)


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float]]:
    """Mean and population std of every column from one aggregate; 1 for no spread."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s")]
    st = df.agg(*aggs).first()
    return {c: (st[f"{c}__m"], st[f"{c}__s"] or 1.0) for c in cols}


def scale_with(df: DataFrame, fitted: Mapping[str, tuple[float | None, float]], suffix: str = "") -> DataFrame:
    """(x - mean) / std of every listed column, by the given numbers."""
    return df.withColumns({c + suffix: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


# --- fitted statistics -------------------------------------------------------

@dataclass
class CleaningStatistics:
    """The numbers that cleaning applies row by row, fitted on one table and kept
    for later ones: median per filled column, fences per filtered column, mean and
    std per scaled column. A few numbers a column, so they live on the driver and
    are saved as a table of (estatistica, coluna, valor) rows.

    Applied to a table that lacks a fitted column, that column is left out; a column
    that was not fitted stays as it is. A column without values has no median (its
    gaps stay) and no fences (no row passes), as in the one-table run."""

    medians: dict[str, float | None] = field(default_factory=dict)
    fences: dict[str, tuple[float, float] | None] = field(default_factory=dict)
    scales: dict[str, tuple[float | None, float]] = field(default_factory=dict)

    def fill(self, df: DataFrame) -> DataFrame:
        return fill_with(df, {c: v for c, v in self.medians.items() if c in df.columns})

    def filter(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, c: within(d, c, self.fences[c]), [c for c in self.fences if c in df.columns], df)

    def scale(self, df: DataFrame, suffix: str) -> DataFrame:
        return scale_with(df, {c: v for c, v in self.scales.items() if c in df.columns}, suffix)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [("mediana", c, v) for c, v in self.medians.items()]
        for c, pair in self.fences.items():
            rows += [(name, c, v) for name, v in zip(("limite_inferior", "limite_superior"), pair or (None, None))]
        for c, pair in self.scales.items():
            rows += [(name, c, v) for name, v in zip(("media", "desvio"), pair)]
        return spark.createDataFrame(rows, "estatistica string, coluna string, valor double")

    @classmethod
    def of_table(cls, saved: DataFrame) -> CleaningStatistics:
        by: dict[str, dict[str, float | None]] = {}
        for r in saved.collect():  # five numbers a column at most
            by.setdefault(r["estatistica"], {})[r["coluna"]] = r["valor"]
        low, high = by.get("limite_inferior", {}), by.get("limite_superior", {})
        return cls(by.get("mediana", {}), {c: None if low[c] is None else (low[c], high[c]) for c in low},
                   {c: (m, by["desvio"][c]) for c, m in by.get("media", {}).items()})


def fit_cleaning(df: DataFrame, fill: Sequence[str], fence: Sequence[str] = (), scale: Sequence[str] = ()) -> CleaningStatistics:
    """Medians of ``df``, fences of the filled rows, mean and std of the rows inside
    the fences. Medians are taken of every column to fill, with or without gaps: a
    later table may have gaps where this one has none."""
    st = CleaningStatistics(medians=exact_medians(df, fill))
    filled = st.fill(df)
    for c in fence:
        st.fences[c] = iqr_fences(filled, c)
        filled = within(filled, c, st.fences[c])
    st.scales = moments(filled, scale)
    return st


# --- scope and completeness filters ---------------------------------------

def equals_all(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Conjunctive equality filter (scope: vehicle type AND region, ...)."""
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in conditions.items()])
    return df.filter(cond)


def exclude_value(df: DataFrame, cols: Sequence[str], value: str = UNKNOWN) -> DataFrame:
    """Drop rows whose column equals ``value``; missing values are KEPT
    (pandas ``!=`` is true for NaN, SQL ``<>`` is null), hence null-safe."""
    cond = reduce(lambda a, b: a & b, [~F.col(c).eqNullSafe(F.lit(value)) for c in cols])
    return df.filter(cond)


def complete_and_known(col: str, sentinel: str = NOT_AVAILABLE) -> Column:
    return F.col(col).isNotNull() & (F.col(col) != F.lit(sentinel))


def stepwise_counts(df: DataFrame, cols: Sequence[str], sentinel: str = NOT_AVAILABLE) -> DataFrame:
    """Rows before, after and removed at each step of a stepwise
    completeness filter, from one pass: step k counts rows passing steps 1..k."""
    cols = list(cols)
    aggs = [F.count(F.lit(1)).alias("s0")]
    cond = None
    for i, c in enumerate(cols, 1):
        step = complete_and_known(c, sentinel)
        cond = step if cond is None else cond & step
        aggs.append(F.count(F.when(cond, 1)).alias(f"s{i}"))
    wide = df.agg(*aggs)
    stack = ", ".join(f"{i}, '{c}', s{i - 1}, s{i}" for i, c in enumerate(cols, 1))
    long = wide.selectExpr(f"stack({len(cols)}, {stack}) AS (passo, coluna, antes, depois)")
    return long.select(F.col("passo").cast("int").alias("passo"), "coluna", "antes", "depois",
                       (F.col("antes") - F.col("depois")).alias("removidos"))


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop(how="any")
