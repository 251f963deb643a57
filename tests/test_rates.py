"""Severity matrices, rankings and comparisons on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from gravis.operators import rates as R


@pytest.fixture(scope="module")
def df(spark):
    rows = [("a", "FATAL"), ("a", "LEVE"), ("a", "LEVE"), ("a", "LEVE"),
            ("b", "LEVE"), ("b", "LEVE"), ("c", "FATAL"), ("c", "LEVE"),
            (None, "FATAL"), ("a", None), ("d", "NAO DISPONIVEL")]
    return spark.createDataFrame(rows, "k string, gravidade_lesao string")


def test_absent_class_gets_zero_and_rates_sum_to_one(df):
    m = {r["k"]: r for r in R.severity_matrix(df, ["k"]).collect()}
    assert set(m) == {"a", "b", "c", "d"}          # missing key / target rows not counted
    assert m["a"]["n_grave"] == 0 and m["a"]["total"] == 4
    assert m["b"]["fatal_rate"] == 0.0
    for k in ["a", "b", "c"]:
        assert m[k]["fatal_rate"] + m[k]["grave_rate"] + m[k]["leve_rate"] == pytest.approx(1.0)
    assert m["d"]["total"] == 1 and m["d"]["fatal_rate"] == 0.0


def test_ranking_ties_break_on_key(df):
    m = R.severity_matrix(df, ["k"])
    got = [r["k"] for r in R.ranked(m, [F.col("grave_rate").desc(), F.col("k")]).orderBy("posicao").collect()]
    assert got == ["a", "b", "c", "d"]
    top = R.ranked(m, [F.col("fatal_rate").desc(), F.col("k")], k=2).orderBy("posicao").collect()
    assert [(r["k"], r["posicao"]) for r in top] == [("c", 1), ("a", 2)]


def test_argmax_ties_take_first_key(spark):
    m = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.5), ("x", 3, 0.1), ("y", 5, 0.2)],
                              "g string, mes int, fatal_rate double")
    got = {r["g"]: r["pior_mes"] for r in R.argmax_per_group(m, "g", "mes", "fatal_rate", out_key="pior_mes").collect()}
    assert got == {"x": 1, "y": 5}


def test_compare_missing_key_is_null(spark):
    m = spark.createDataFrame([(12, 4.0), (3, 2.0)], "mes int, fatal_rate double")
    r = R.compare_two_keys(m, "mes", 12, 4, "fatal_rate").first()
    assert r["rate_a"] == 4.0 and r["rate_b"] is None and r["diff_pct"] is None
    r = R.compare_two_keys(m, "mes", 12, 3, "fatal_rate").first()
    assert r["diff_pct"] == 100.0


def test_one_vs_others_with_and_without_chosen(spark):
    m = spark.createDataFrame([("CONDUTOR", 10.0), ("PASSAGEIRO", 30.0), ("PEDESTRE", 50.0)],
                              "tipo string, fatal_rate double")
    r = R.one_vs_others(m, "tipo", "CONDUTOR", ["fatal_rate"]).first()
    assert (r["chosen"], r["others_mean"]) == (10.0, 40.0)
    r = R.one_vs_others(m, "tipo", "AUSENTE", ["fatal_rate"]).first()
    assert (r["chosen"], r["others_mean"]) == (10.0, 30.0)   # first key vs mean of all


def test_cluster_vs_rest(spark):
    m = spark.createDataFrame([(d, 10.0 if d in (24, 25, 26) else 5.0) for d in range(1, 32)],
                              "dia int, fatal_rate double")
    r = R.cluster_vs_rest(m, "dia", (24, 25, 26), "fatal_rate").first()
    assert (r["cluster_mean"], r["others_mean"], r["impact_pct"]) == (10.0, 5.0, 100.0)


def test_matrices_from_grouping_sets_equal_single_matrices(spark):
    from gravis.sources.tables import cases
    from conftest import SF001
    c = R.with_week_of_month(cases(spark, SF001))
    sets = [["mes_sinistro"], ["municipio"], ["tipo_de_vitima", "tipo_via"], ["semana_mes"]]
    many = R.severity_matrices(c, sets, scale=100)
    for ks, m in zip(sets, many):
        one = R.severity_matrix(c, ks, scale=100)
        assert sorted(map(tuple, m.collect())) == sorted(map(tuple, one.select(*m.columns).collect()))


def test_land_cases_partitions_by_year(spark, tmp_path):
    from gravis.plans.jobs import land_cases
    from gravis.sources.tables import cases
    from conftest import SF001
    df = land_cases(spark, SF001, str(tmp_path / "cases"))
    assert df.count() == cases(spark, SF001).count()
    plan = df.filter("ano_sinistro = 1997")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ano_sinistro" in plan
