"""Statistics operators against brute force on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gravis.operators import stats as S


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(40, 12, 300).round(), [150.0, -40.0, 200.0]])
    g = np.array(["A", "B", "C"])[np.arange(len(x)) % 3]
    pdf = pd.DataFrame({"g": g, "x": x})
    return pdf, spark.createDataFrame(pdf)


def test_box_summary_matches_brute_force(sample):
    pdf, df = sample
    got = {r["g"]: r for r in S.box_summary(df, "x", "g").collect()}
    for g, part in pdf.groupby("g"):
        v = part["x"].to_numpy()
        q1, md, q3 = np.percentile(v, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = v[(v >= lo) & (v <= hi)]
        r = got[g]
        assert (r["q1"], r["median"], r["q3"]) == pytest.approx((q1, md, q3))
        assert r["whisker_low"] == inside.min() and r["whisker_high"] == inside.max()
        assert r["outliers"] == len(v) - len(inside)


def test_histogram_matches_numpy(sample):
    pdf, df = sample
    h = S.histogram(df, "x", 30).orderBy("bin").collect()
    counts, edges = np.histogram(pdf["x"], bins=30)
    assert [r["n"] for r in h] == counts.tolist()
    assert [r["bin_lo"] for r in h] == pytest.approx(edges[:-1].tolist())
    assert sum(r["n"] for r in h) == len(pdf)  # the maximum lands in the last bin


def test_density_matches_brute_force(sample):
    pdf, df = sample
    x = pdf["x"].to_numpy()
    d = S.gaussian_density(df, "x", 20).orderBy("ponto").collect()
    bw = x.std(ddof=1) * len(x) ** (-0.2)
    for r in d:
        expect = np.exp(-0.5 * ((r["x"] - x) / bw) ** 2).sum() / (len(x) * bw * math.sqrt(2 * math.pi))
        assert r["densidade"] == pytest.approx(expect, rel=1e-9)


def test_constant_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "x double, y double, c double")
    got = {r["variavel"]: r["r"] for r in S.correlation_matrix(df, ["y", "x", "c"]).filter("var_a = 'y' and var_b <> 'y'").selectExpr("var_b AS variavel", "r").collect()}
    assert got["c"] is None
    assert got["x"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    rank = S.correlation_ranking(S.correlation_matrix(df, ["y", "x", "c"]).filter("var_a = 'y' and var_b <> 'y'").selectExpr("var_b AS variavel", "r")).collect()
    assert [r["variavel"] for r in rank] == ["x"]


def test_anova_f_and_p_value(sample):
    pdf, df = sample
    f = S.with_p_value(S.target_anova(df, "g", [], ["x"])).collect()[0]
    groups = [p["x"].to_numpy() for _, p in pdf.groupby("g")]
    grand = pdf["x"].mean()
    ssb = sum(len(v) * (v.mean() - grand) ** 2 for v in groups)
    ssw = sum(((v - v.mean()) ** 2).sum() for v in groups)
    expect = (ssb / 2) / (ssw / (len(pdf) - 3))
    assert f["f"] == pytest.approx(expect)
    assert 0.0 <= f["p_value"] <= 1.0


def test_f_survival_known_points(spark):
    points = [(4.9646, 1, 10, 0.05), (3.3541, 2, 27, 0.05), (3.841459, 1, 10**7, 0.05),
              (10.1280, 1, 3, 0.05), (2.9782, 5, 10, 0.0669), (0.0, 2, 5, 1.0)]
    df = spark.createDataFrame(points, "f double, a long, b long, p double")
    for r in df.select(S.f_survival(F.col("f"), F.col("a"), F.col("b")).alias("got"), "p").collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-4)
    two = spark.range(1, 40).select((F.col("id") / 4.0).alias("f"), F.lit(2).alias("a"), F.col("id").alias("b"))
    for r in two.select(S.f_survival(F.col("f"), F.col("a"), F.col("b")).alias("x"),
                        S.f_survival(F.col("f"), F.lit(2.0000001), F.col("b")).alias("y")).collect():
        assert r["x"] == pytest.approx(r["y"], abs=1e-5)


def test_any_number_of_values_and_groups(spark):
    n = 50_000
    df = spark.range(n).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("t"),
                               F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
                               (F.col("id") % 20_000).alias("h"), F.col("id").alias("x"))
    r = S.target_correlations(df, "g", ["t"], ["x"]).collect()
    assert r[0]["r"] == pytest.approx(r[1]["r"], abs=1e-12)  # the sorted code of t is x
    boxes = S.box_summary(df, "x", "h")
    assert boxes.count() == 20_000
    assert boxes.filter("h = 5").first()["median"] == 20_005.0
    q = S.exact_quantiles(df, "x", [], (0.0, 0.25, 0.5, 1.0)).first()
    assert list(q) == [0.0, (n - 1) / 4, (n - 1) / 2, n - 1.0]
    empty = df.limit(0)
    assert S.target_correlations(empty, "g", ["t"], ["x"]).filter("r is not null").count() == 0
    assert S.box_summary(empty, "x", "h").count() == 0 and S.exact_quantiles(empty, "x", ["g"], (0.5,)).count() == 0


def test_std_of_single_row_group_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, x double")
    got = {r["g"]: r["std"] for r in S.std_by_group(df, "x", "g").collect()}
    assert got["a"] is None and got["b"] == round(math.sqrt(2), 2)


def test_correlation_matrix_pairwise_matches_pandas(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"a": rng.normal(2000, 2, n), "b": rng.normal(0, 1, n), "c": np.full(n, 7.0)})
    pdf["b"] = pdf["b"] + 0.3 * (pdf["a"] - 2000)
    pdf["d"] = rng.integers(0, 5, n).astype(float)
    pdf.loc[::9, "b"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))
    got = {(r["var_a"], r["var_b"]): r["r"] for r in S.correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    ref = pdf.corr()
    for a in ["a", "b", "d"]:
        for b in ["a", "b", "d"]:
            assert got[(a, b)] == pytest.approx(ref.loc[a, b], abs=1e-12)
    assert got[("a", "c")] is None and got[("c", "c")] is None


def test_target_correlations_match_pandas_codes(spark):
    rng = np.random.default_rng(9)
    n = 600
    pdf = pd.DataFrame({"g": rng.choice(["FATAL", "GRAVE", "LEVE"], n),
                        "t": rng.choice(["b", "a", "c", None], n),
                        "x": rng.normal(1998, 2, n)})
    pdf.loc[::7, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, t string, x double")
    got = {r["variavel"]: r["r"] for r in S.target_correlations(df, "g", ["t"], ["x"]).collect()}
    y = pdf["g"].map({"FATAL": 0, "GRAVE": 1, "LEVE": 2}).astype(float)
    t = pdf["t"].fillna("MISSING")
    tcode = t.map({v: i for i, v in enumerate(sorted(t.unique()))}).astype(float)
    assert got["t"] == pytest.approx(tcode.corr(y), abs=1e-12)
    assert got["x"] == pytest.approx(pdf["x"].corr(y), abs=1e-12)


def test_target_regression_and_anova_match_brute_force(spark, sample):
    pdf, df = sample
    codes = {"A": 0.0, "B": 1.0, "C": 2.0}
    y = pdf["g"].map(codes)
    reg = S.target_regressions(df, "g", [], ["x"]).first()
    slope, intercept = np.polyfit(pdf["x"], y, 1)
    assert reg["slope"] == pytest.approx(slope, rel=1e-9)
    assert reg["intercept"] == pytest.approx(intercept, rel=1e-9)
    assert reg["r2"] == pytest.approx(np.corrcoef(pdf["x"], y)[0, 1] ** 2, rel=1e-9)
    a = S.target_anova(df, "g", [], ["x"]).first()
    assert (a["df1"], a["df2"]) == (2, len(pdf) - 3)


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_constants_have_no_association(spark, partitions):
    """A constant number or text has no r, slope or F, however its deviations are merged."""
    rows = [("ABC"[i % 3], 0.1, "same", float(i % 7), "t" + str(i % 5), 3.3 if i % 2 else None) for i in range(20_003)]
    df = spark.createDataFrame(rows, "t string, c double, k string, x double, w string, h double").repartition(partitions)
    r = {x["variavel"]: x["r"] for x in S.target_correlations(df, "t", ["k", "w"], ["c", "x", "h"]).collect()}
    assert r["c"] is None and r["k"] is None and r["h"] is None and abs(r["x"]) < 0.1 and r["w"] is not None
    lines = {x["variavel"]: x for x in S.target_regressions(df, "t", ["k"], ["c", "x"]).collect()}
    assert all(lines[v]["slope"] is None and lines[v]["r2"] is None for v in "ck") and lines["x"]["slope"] is not None
    f = {x["variavel"]: x["f"] for x in S.target_anova(df, "t", ["k"], ["c", "x"]).collect()}
    assert f["c"] is None and f["k"] is None and f["x"] is not None
    m = {(x["var_a"], x["var_b"]): x["r"] for x in S.correlation_matrix(df, ["c", "x", "h"]).collect()}
    assert m["x", "x"] == 1.0 and all(v is None for k, v in m.items() if k != ("x", "x")) and len(m) == 9


def test_text_codes_keep_their_digits(spark):
    """Many codes, all values far from code 0 in one class: the variance keeps its digits."""
    import numpy as np
    rows = [("A", f"{i:06d}") for i in range(3000)] + [("B", f"{2990 + i % 3:06d}") for i in range(3000)]
    got = {r["y"]: r for r in S.target_class_stats(spark.createDataFrame(rows, "t string, w string"), "t", ["w"], []).collect()}
    codes = np.array([2990 + i % 3 for i in range(3000)], float)
    assert got[1.0]["v"] == pytest.approx(codes.var(), rel=1e-12) and got[1.0]["m"] == pytest.approx(codes.mean())
    assert got[0.0]["v"] == pytest.approx(np.arange(3000.0).var(), rel=1e-12)


def test_correlation_matrix_is_pairwise_complete(spark):
    import numpy as np
    import pandas as pd
    rnd = np.random.default_rng(1)
    x = rnd.normal(1e6, 1, (500, 4))
    x[:, 1] += 2 * x[:, 0]
    frame = pd.DataFrame(x, columns=list("abcd")).mask(rnd.random((500, 4)) < 0.2)
    frame["d"] = np.nan
    expected = frame.corr()
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    got = S.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5), list("abcd")).collect()
    assert len(got) == 16
    for r in got:
        e = expected.loc[r["var_a"], r["var_b"]]
        assert (r["r"] is None and pd.isna(e)) or r["r"] == pytest.approx(e, abs=1e-9)
