"""Scalar Column helpers: codes, bands, tiers and arithmetic guards.

All are plain ``pyspark.sql.functions`` expressions, so they stay inside
whole-stage codegen wherever they are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Right-closed age bands (0,18] (18,25] (25,35] (35,45] (45,60]
# (60,100] and their labels; ages outside (0, 100] get no band.
AGE_BAND_EDGES = (0, 18, 25, 35, 45, 60, 100)
AGE_BAND_LABELS = ("0-18", "19-25", "26-35", "36-45", "46-60", "60+")


def age_band(c: Column | str, edges: Sequence[float] = AGE_BAND_EDGES,
             labels: Sequence[str] = AGE_BAND_LABELS) -> Column:
    """Right-closed banding (lo, hi]; values outside the outer edges are null.
    (``ml.feature.Bucketizer`` is left-closed, so it is not used.)"""
    x = _c(c)
    expr = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def age_band_order(c: Column | str, edges: Sequence[float] = AGE_BAND_EDGES) -> Column:
    """0-based position of the band, null outside; orders the band labels."""
    x = _c(c)
    expr = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (x > lo) & (x <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


# The binary sex code and the 1-2-3 severity score.
SEX_CODES = {"FEMININO": 0, "MASCULINO": 1}
SEVERITY_SCORE = {"LEVE": 1, "GRAVE": 2, "FATAL": 3, "NAO DISPONIVEL": 1}


def sex_code(c: Column | str) -> Column:
    """FEMININO=0, MASCULINO=1, anything else null."""
    x = _c(c)
    return F.when(x == "FEMININO", F.lit(0)).when(x == "MASCULINO", F.lit(1))


def severity_score(c: Column | str) -> Column:
    """LEVE=1, GRAVE=2, FATAL=3; the sentinel and any other value count as 1."""
    x = _c(c)
    return (F.when(x == "FATAL", F.lit(3)).when(x == "GRAVE", F.lit(2))
             .otherwise(F.lit(1)))


def week_of_month(day: Column | str) -> Column:
    """((day - 1) div 7) + 1 as int: days 1-7 are week 1, 29-31 week 5."""
    return (F.floor((_c(day) - 1) / 7) + 1).cast("int")


def month_abbr(month: Column | str) -> Column:
    """Lower-case English short month name; outside 1-12 the number as text."""
    m = _c(month)
    name = F.lower(F.date_format(F.make_date(F.lit(2000), m, F.lit(1)), "MMM"))
    return F.when(m.between(1, 12), name).otherwise(m.cast("string"))


def pct(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole, null when whole is 0 (never raises under ANSI)."""
    return F.try_divide(F.lit(100) * _c(part), _c(whole))


def rel_diff_pct(a: Column | str, b: Column | str) -> Column:
    """Relative difference (a - b) / b * 100; null when b is 0."""
    return F.try_divide(_c(a) - _c(b), _c(b)) * F.lit(100)


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(_c(a), _c(b))


def risk_tier(c: Column | str, cuts: Sequence[float], labels: Sequence[str], strict: bool = False) -> Column:
    """First label whose cut the value reaches (exceeds, if ``strict``), cuts in
    descending order; ``labels`` has one more entry than ``cuts`` for the rest."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("labels must have len(cuts) + 1 entries")
    x = _c(c)
    expr = None
    for cut, label in zip(cuts, labels):
        hit = x > cut if strict else x >= cut
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


# Significance marks by p-value.
def significance_stars(p: Column | str) -> Column:
    x = _c(p)
    return (F.when(x < 0.001, F.lit("***")).when(x < 0.01, F.lit("**"))
             .when(x < 0.05, F.lit("*")).otherwise(F.lit("ns")))


def round_half_even(c: Column | str, scale: int) -> Column:
    """The rounding pandas/NumPy use (banker's rounding)."""
    return F.bround(_c(c), scale)
