"""Driver tables and the two case views derived from them.

``cases`` maps the TPC-H-like star schema onto the accident-victim schema
(one row per order = one victim case). ``cases_dirty`` derives the dirt that
real extracts carry (missing values, sentinels, junk years, outliers and exact
duplicate rows) from the keys, so both Spark and the SQL oracle see the same
rows. The mapping rules are fixed values shared with the oracle text in
``gravis.plans.oracle``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SF_DIR = "/root/testdata/sf0.01"

# Columns each table contributes; reading only these lets the parquet scan
# prune everything else (ReadSchema in the plan shows exactly these).
_CASE_COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
               "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
}


def table(spark: SparkSession, sf_dir: str, name: str,
          columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def cases(spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR) -> DataFrame:
    """One row per case.

    Plan shape: orders joins customer on the customer key first, straight
    from the two scans, so Spark's file-size check sees the real sizes (a
    shuffle join at scale, whose skewed partitions AQE splits; customer is
    the broadcast side only when its files are small). The 25-row nation x
    5-row region dimension is joined last and is broadcast by that check.
    """
    o = table(spark, sf_dir, "orders", _CASE_COLUMNS["orders"])
    c = table(spark, sf_dir, "customer", _CASE_COLUMNS["customer"])
    n = table(spark, sf_dir, "nation", _CASE_COLUMNS["nation"])
    r = table(spark, sf_dir, "region", _CASE_COLUMNS["region"])
    geo = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    oc = o.join(c, o.o_custkey == c.c_custkey)
    j = oc.join(geo, oc.c_nationkey == geo.n_nationkey)
    return j.select(
        F.col("o_orderkey").alias("id_sinistro"),
        F.col("n_name").alias("municipio"),
        F.col("r_name").alias("regiao_administrativa"),
        F.col("c_mktsegment").alias("tipo_via"),
        F.col("o_orderpriority").alias("tipo_de_vitima"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("FEMININO"))
         .otherwise(F.lit("MASCULINO")).alias("sexo"),
        ((F.col("o_custkey") * 37 + F.col("o_orderkey") * 11) % 105).cast("int").alias("idade"),
        F.when(F.col("o_orderstatus") == "F", F.lit("FATAL"))
         .when(F.col("o_orderstatus") == "P", F.lit("GRAVE"))
         .otherwise(F.lit("LEVE")).alias("gravidade_lesao"),
        F.year("o_orderdate").cast("int").alias("ano_sinistro"),
        F.month("o_orderdate").cast("int").alias("mes_sinistro"),
        F.dayofmonth("o_orderdate").cast("int").alias("dia_sinistro"),
        F.col("o_totalprice").alias("valor"),
    )


def _every(k: int) -> Column:
    return F.col("id_sinistro") % k == 0


# Columns carried through the dirty view unchanged (extra to the ones it dirties).
DIRTY_PASSTHROUGH = ["regiao_administrativa", "tipo_via", "tipo_de_vitima",
                     "mes_sinistro", "dia_sinistro", "valor"]
DIRTY_COLUMNS = ["id_sinistro", "municipio", "gravidade_lesao", "sexo", "idade",
                 "ano_texto"] + DIRTY_PASSTHROUGH


def cases_dirty(spark: SparkSession, sf_dir: str = DEFAULT_SF_DIR,
                base: DataFrame | None = None) -> DataFrame:
    """Cases with derived dirt plus two exact (clean) copies of every 50th
    case. Built from ONE scan of the case view: each row explodes into 1 or
    3 copies (copy 1 carries the dirt, copies 2-3 are clean), the same rows
    as the union of three scans that the SQL text states."""
    c = base if base is not None else cases(spark, sf_dir)
    na = F.lit("NAO DISPONIVEL")
    copies = F.when(_every(50), F.lit(3)).otherwise(F.lit(1))
    x = c.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    dirty = F.col("_copy") == 1

    def dirt(clean_col, expr):
        return F.when(dirty, expr).otherwise(clean_col)

    return x.select(
        "id_sinistro",
        dirt(F.col("municipio"), F.when(_every(17), F.lit(None).cast("string")).when(_every(19), na)
             .otherwise(F.col("municipio"))).alias("municipio"),
        dirt(F.col("gravidade_lesao"), F.when(_every(23), na).otherwise(F.col("gravidade_lesao")))
        .alias("gravidade_lesao"),
        dirt(F.col("sexo"), F.when(_every(13), F.lit(None).cast("string")).otherwise(F.col("sexo"))).alias("sexo"),
        dirt(F.col("idade"), F.when(_every(11), F.lit(None).cast("int")).when(_every(101), F.lit(400))
             .otherwise(F.col("idade"))).cast("double").alias("idade"),  # the source types age as double
        dirt(F.col("ano_sinistro").cast("string"), F.when(_every(29), F.lit("junk"))
             .otherwise(F.col("ano_sinistro").cast("string"))).alias("ano_texto"),
        *DIRTY_PASSTHROUGH,
    )
