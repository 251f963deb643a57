"""Invariants of the exact seeded sampling operators."""

from pyspark.sql import functions as F

from gravis.operators import sampling as S
from gravis.sources.tables import cases

from conftest import SF001


def test_hash_rank_is_a_permutation_per_stratum(spark):
    c = cases(spark, SF001)
    r = S.hash_rank(c, ["gravidade_lesao"], ["id_sinistro"], 42)
    g = r.groupBy("gravidade_lesao").agg(F.count(F.lit(1)).alias("n"), F.min("_rank").alias("lo"),
                                         F.max("_rank").alias("hi"), F.countDistinct("_rank").alias("d"),
                                         F.max("_stratum_n").alias("sn")).collect()
    for row in g:
        assert row["lo"] == 1 and row["hi"] == row["n"] == row["d"] == row["sn"]


def test_split_exact_and_partition_independent(spark):
    c = cases(spark, SF001)
    a = S.stratified_split(c, "gravidade_lesao", ["id_sinistro"], 0.2, 42)
    b = S.stratified_split(c.repartition(7), "gravidade_lesao", ["id_sinistro"], 0.2, 42)
    ta = {r[0] for r in a.filter("is_test").select("id_sinistro").collect()}
    tb = {r[0] for r in b.filter("is_test").select("id_sinistro").collect()}
    assert ta == tb
    counts = {r[0]: (r[1], r[2]) for r in a.groupBy("gravidade_lesao").agg(
        F.count(F.lit(1)), F.count(F.when(F.col("is_test"), 1))).collect()}
    total = sum(n for n, _ in counts.values())
    assert sum(t for _, t in counts.values()) == -(-total // 5)
    assert all(abs(t - 0.2 * n) < 1 for n, t in counts.values())
    assert S.test_quotas({("a",): 7, ("b",): 2, ("c",): 2}, 0.2) == {("a",): 2, ("b",): 1, ("c",): 0}
    empty = S.stratified_split(c.limit(0), "gravidade_lesao", ["id_sinistro"], 0.2, 42)
    assert empty.count() == 0 and S.undersample(c.limit(0), "gravidade_lesao", ["id_sinistro"], 42).count() == 0
    other = S.stratified_split(c, "gravidade_lesao", ["id_sinistro"], 0.2, 7)
    assert {r[0] for r in other.filter("is_test").select("id_sinistro").collect()} != ta


def test_undersample_equal_classes(spark):
    c = cases(spark, SF001)
    u = S.undersample(c, "gravidade_lesao", ["id_sinistro"], 42)
    sizes = [r[1] for r in u.groupBy("gravidade_lesao").count().collect()]
    smallest = min(r[1] for r in c.groupBy("gravidade_lesao").count().collect())
    assert sizes == [smallest] * len(sizes)
    assert u.select("id_sinistro").distinct().count() == u.count()


def test_seeded_sample_size_and_bounds(spark):
    c = cases(spark, SF001)
    assert S.seeded_sample(c, 100, ["id_sinistro"], 1).count() == 100
    assert S.seeded_sample(c, 10 ** 9, ["id_sinistro"], 1).count() == c.count()


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string")
    w = {r["y"]: r["weight"] for r in S.balanced_weights(df, "y").distinct().collect()}
    assert w == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}


def test_hash_buckets_split_a_hot_class_evenly(spark):
    # one class holds 90% of the rows: its windows are per (class, bucket),
    # and the buckets of that class must be evenly filled
    n = 200_000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("y"))
    nb = 32
    b = df.withColumn("_b", S.hash_bucket(S.order_key(["id"], 42), nb))
    sizes = [r["count"] for r in b.filter("y = 'a'").groupBy("_b").count().collect()]
    assert len(sizes) == nb
    mean = sum(sizes) / nb
    assert max(sizes) < 1.1 * mean and min(sizes) > 0.9 * mean
    # bucket order is hash order
    r = b.groupBy("_b").agg(F.min(S.order_key(["id"], 42)).alias("lo"),
                            F.max(S.order_key(["id"], 42)).alias("hi")).orderBy("_b").collect()
    assert all(r[i]["hi"] < r[i + 1]["lo"] for i in range(len(r) - 1))


def test_sample_sorts_only_the_rows_it_can_take(spark):
    df = spark.range(3000).select((F.col("id") % 2500).alias("id"), F.col("id").alias("x"))  # some ids twice
    ranked = S.hash_rank(df, [], ["id"], 5)
    for n in (0, 1, 40, 700):
        got = S.seeded_sample(df, n, ["id"], 5)
        want = ranked.filter(F.col("_rank") <= n).select("id")
        assert got.count() == n and got.select("id").exceptAll(want).count() == 0
    # rows beyond the n-th leave before the shuffle that ranks them
    assert "WindowGroupLimit" in S.seeded_sample(df, 40, ["id"], 5)._jdf.queryExecution().executedPlan().toString()


def test_stratified_sample_is_the_first_of_each_class_and_reads_twice(spark):
    """Repeated and null ids and labels included; ``df`` is evaluated twice, however dear it is."""
    c = cases(spark, SF001).select("id_sinistro", "gravidade_lesao", "valor")
    c = c.unionByName(c.limit(40)).unionByName(c.limit(5).withColumn("id_sinistro", F.lit(None).cast("long"))).unionByName(
        c.limit(7).withColumn("gravidade_lesao", F.lit(None).cast("string")))
    rows = [tuple(r) for r in c.collect()]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b
    df = spark.createDataFrame(rows, c.schema).mapInPandas(counted, c.schema)
    for n in (90, len(rows) + 1):
        before = read.value
        got = S.stratified_sample(df, "gravidade_lesao", ["id_sinistro"], n, 42).collect()
        assert read.value - before <= 2 * len(rows)
        plain = spark.createDataFrame(rows, c.schema)
        ranked = S.hash_rank(plain, ["gravidade_lesao"], ["id_sinistro"], 42)
        quotas = S.class_quotas(S.stratum_counts(plain, ["gravidade_lesao"]), n)
        expected = [r["id_sinistro"] for r in ranked.collect() if r["gravidade_lesao"] and r["_rank"] <= quotas[(r["gravidade_lesao"],)]]
        assert sorted(map(str, (r["id_sinistro"] for r in got))) == sorted(map(str, expected))
    assert S.stratified_sample(df.limit(0), "gravidade_lesao", ["id_sinistro"], 10, 42).count() == 0
