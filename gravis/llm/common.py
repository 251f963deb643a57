"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravis.session import ensure_checkpoint_dir, ship_package

# The white space that separates words (space, tab to carriage return).
WORD_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


BATCH_ROWS = 1000  # rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python


def prepare(spark: SparkSession) -> None:
    """Make the operators importable in Python workers, and batches small
    enough for long texts (unless the session asks for smaller ones)."""
    ship_package(spark)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(size)) > BATCH_ROWS:
        spark.conf.set(size, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read it
    back: a lost executor re-reads the table instead of repeating the plan, and
    several later steps share one evaluation. The folder goes with the
    checkpoint folder."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gravis-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000  # rows of a few numbers: under 64 MB


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A landed table of a few numbers a row, to be broadcast if it has at most
    ``rows`` rows; beyond that joins with it shuffle, as Spark decides."""
    return F.broadcast(df) if df.count() <= rows else df


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` by quoted name."""
    return [F.col(f"`{c}`") for c in df.columns]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
