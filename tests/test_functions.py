"""Edge cases of the scalar functions and cleaning operators."""

import unicodedata

from pyspark.sql import functions as F

from gravis.functions.scalar import (age_band, month_abbr, risk_tier, severity_score, sex_code,
                                     significance_stars, week_of_month)
from gravis.functions.text import fold_accents, normalize_name
from gravis.operators import clean as C


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_age_band_edges_are_right_closed(spark):
    ages = [(0.0,), (0.5,), (18.0,), (18.5,), (25.0,), (60.0,), (60.1,), (100.0,), (101.0,), (None,)]
    got = _one(spark, age_band("a"), ages, "a double")
    assert got == [None, "0-18", "0-18", "19-25", "19-25", "46-60", "60+", "60+", None, None]


def test_codes(spark):
    rows = [("FEMININO",), ("MASCULINO",), ("NAO DISPONIVEL",), (None,)]
    assert _one(spark, sex_code("s"), rows, "s string") == [0, 1, None, None]
    rows = [("LEVE",), ("GRAVE",), ("FATAL",), ("NAO DISPONIVEL",), ("x",), (None,)]
    assert _one(spark, severity_score("s"), rows, "s string") == [1, 2, 3, 1, 1, 1]


def test_week_month_tiers_stars(spark):
    assert _one(spark, week_of_month("d"), [(1,), (7,), (8,), (28,), (29,), (31,)], "d int") == [1, 1, 2, 4, 5, 5]
    assert _one(spark, month_abbr("m"), [(1,), (12,), (13,)], "m int") == ["jan", "dec", "13"]
    assert _one(spark, risk_tier("x", (3.2, 3.0), ("A", "M", "B")), [(3.3,), (3.2,), (3.1,), (1.0,)],
                "x double") == ["A", "A", "M", "B"]
    assert _one(spark, risk_tier("x", (3.2, 3.0), ("A", "M", "B"), strict=True), [(3.3,), (3.2,), (3.0,)],
                "x double") == ["A", "M", "B"]
    assert _one(spark, significance_stars("p"), [(0.0005,), (0.005,), (0.03,), (0.5,)],
                "p double") == ["***", "**", "*", "ns"]


def _python_fold(s):
    return unicodedata.normalize("NFKD", s.strip().upper()).encode("ASCII", "ignore").decode("ASCII")


def test_fold_accents_equals_python_chain_on_latin(spark):
    chars = [chr(c) for c in range(0x20, 0x250) if not unicodedata.category(chr(c)).startswith("C")]
    words = [("".join(chars[i:i + 16]),) for i in range(0, len(chars), 16)]
    words += [("  São Bernardo do Campo \t",), ("straße ½ ª",), (" Açaí ",)]
    got = _one(spark, normalize_name("w"), words, "w string")
    assert got == [_python_fold(w[0]) for w in words]


def test_fold_accents_on_all_code_points(spark):
    chars = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000
             and unicodedata.normalize("NFKD", chr(c)) != chr(c) or c % 997 == 0 and not 0xD800 <= c < 0xE000]
    words = [("".join(chars[i:i + 200]),) for i in range(0, len(chars), 200)] + [("a\u2026b \u2122 \u2160 \uff21\uff22",)]
    got = _one(spark, fold_accents("w"), words, "w string")
    assert got == [unicodedata.normalize("NFKD", w[0]).encode("ASCII", "ignore").decode("ASCII") for w in words]


def test_fold_accents_without_upper(spark):
    chars = "".join(chr(c) for c in range(0xA0, 0x180))
    got = _one(spark, fold_accents("w"), [(chars,)], "w string")[0]
    assert got == unicodedata.normalize("NFKD", chars).encode("ASCII", "ignore").decode("ASCII")


def test_exclude_value_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("DESCONHECIDO",), (None,)], "g string")
    assert sorted(r[0] or "" for r in C.exclude_value(df, ["g"]).collect()) == ["", "a"]


def test_year_filter_reads_decimal_text(spark):
    df = spark.createDataFrame([("2020",), ("2020.0",), ("junk",), ("2019",), (None,), ("2025.0",)], "y string")
    got = sorted(r[0] for r in C.year_filter(df, "y", range(2020, 2026)).collect())
    assert got == [2020, 2020, 2025]
    assert C.year_filter(df, "nope", [2020]) is None
    assert C.year_filter(None, "y", [2020]) is None


def test_consolidate_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "id int, a string")
    b = spark.createDataFrame([("y", 2, 3.0)], "a string, id int, extra double")
    u = C.consolidate(a, None, b)
    assert set(u.columns) == {"id", "a", "extra"}
    assert sorted((r["id"], r["extra"]) for r in u.collect()) == [(1, None), (2, 3.0)]
    assert C.consolidate(None, None) is None


def test_median_fill_is_exact_and_skips_full_columns(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0), (4, 10.0), (5, 2.0)], "id int, x double")
    got = {r["id"]: r["x"] for r in C.median_fill(df).collect()}
    assert got[2] == 3.0  # mean of the two middle values 2 and 4
    assert dict(C.median_fill(df, ["x"]).dtypes) == dict(df.dtypes) | {"x": "double"}
    empty = df.limit(0)
    assert C.median_fill(empty, ["x"]).count() == 0 and C.iqr_filter(empty, "x").count() == 0


def test_zscore_population_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    got = C.zscore(df, ["x", "c"]).collect()
    assert [r["x"] for r in got] == [-1.0, 1.0]
    assert [r["c"] for r in got] == [0.0, 0.0]


def test_iqr_fences_inclusive(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x double")
    lo, hi = C.iqr_fences(df, "x")
    assert (lo, hi) == (-3.0, 13.0)
    assert C.iqr_filter(df, "x").count() == 8


def test_stepwise_counts(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("NAO DISPONIVEL", "b"), ("a", None)], "s string, g string")
    got = [(r["coluna"], r["antes"], r["depois"], r["removidos"]) for r in
           C.stepwise_counts(df, ["s", "g"]).orderBy("passo").collect()]
    assert got == [("s", 4, 2, 2), ("g", 2, 1, 1)]


def test_distinct_treats_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert C.drop_duplicate_rows(df).count() == 2
