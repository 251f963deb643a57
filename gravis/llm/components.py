"""Connected components of an edge table, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravis.llm.common import land


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) of every node of ``edges``, root being the least id of its
    component. Every round takes the least label among the neighbours and then
    the label of the label, so long chains close in logarithmically many rounds;
    a hub is a join key with many rows, which adaptive execution splits, and its
    labels are pre-aggregated."""
    both = land(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(
        edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = land(both.groupBy("x").agg(F.min("y").alias("m")).select(
        F.col("x").alias("id"), F.least("x", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["id"] == near["x"]).select(
            "id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        step = land(step)
        up = step.select(F.col("id").alias("up"), F.col("root").alias("up_root"))
        jumped = land(step.join(up, step["root"] == up["up"], "left").select(
            "id", "old", F.least("root", F.coalesce("up_root", "root")).alias("root")))
        labels = jumped.select("id", "root")
        if not jumped.where("root <> old").limit(1).count():
            return labels
