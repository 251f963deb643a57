"""Delimited extracts (';'-separated, Latin-1, header row) and result sinks.

Readers take every column as text (no inference pass over the data) and
``type_columns`` then applies ``try_cast`` in one projection, so junk becomes
null instead of failing the job. A missing path gives "no table" (None), as
the reference's loader does. Writers create their folders and write one
file per task; results that are small by construction (metric tables) are
written as a single file.
"""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LATIN1 = "ISO-8859-1"
BAD = "_linha_ruim"  # the whole line, where it does not fit the header
_LOG = logging.getLogger(__name__)

# The types the source extract's columns take after reading
# (everything not listed stays text).
EXTRACT_TYPES = {
    "id_sinistro": "bigint", "id_veiculo": "bigint", "cod_ibge": "bigint",
    "ano_sinistro": "int", "mes_sinistro": "int", "dia_sinistro": "int",
    "idade": "double",
    "ano_obito": "int", "mes_obito": "int", "dia_obito": "int",
}


def read_extract(spark: SparkSession, path: str, sep: str = ";", encoding: str = LATIN1,
                 schema: T.StructType | None = None) -> DataFrame | None:
    """Read a delimited extract with a header row, all columns as text unless
    a schema is given. An extract that cannot be opened (no such path, no file in a
    folder, no header) gives None, with the reason in the log."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    reader = reader.option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", False)
    try:
        df = reader.csv(path)
    except PySparkException as e:
        _LOG.warning("extract %s not read: %s", path, e)
        return None
    return df if df.columns else None


@dataclass
class Extract:
    """A checked extract: rows that fit the header, and the lines that do not."""

    rows: DataFrame
    bad: DataFrame  # one column, the line as read

    def counts(self) -> tuple[int, int]:
        """(rows kept, lines set apart)."""
        return self.rows.count(), self.bad.count()


def read_checked(spark: SparkSession, path: str, sep: str = ";", encoding: str = LATIN1) -> Extract | None:
    """Read an extract of text columns and set its bad lines apart.

    A line with more fields than the header, or with a quote that never closes, is
    bad: its values cannot be told to columns. A line with fewer fields is kept, the
    missing ones null. Every byte is a Latin-1 character, so none is bad by itself.
    A line is one record: a quoted line break ends it, and both halves are bad or
    short. None if the extract cannot be opened."""
    head = read_extract(spark, path, sep, encoding)
    if head is None:
        return None
    names = head.columns
    if BAD in names:
        raise ValueError(f"the extract has a column {BAD}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, BAD]])
    lines = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", BAD).schema(schema).csv(path))
    bare = F.regexp_replace(F.col(BAD), '"[^"]*"', "")  # quoted fields hold no separator
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    # the fields are no longer than their line; the reader compares a line with the header only if all columns are read
    parsed = F.length(BAD) >= F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in names]))
    is_bad = F.coalesce(parsed & ((fields > len(names)) | bare.contains('"')), F.lit(False))
    flagged = lines.select(*[F.col(f"`{c}`") for c in names], BAD, is_bad.alias("_ruim"))
    return Extract(flagged.filter(~F.col("_ruim")).select(*[F.col(f"`{c}`") for c in names]),
                   flagged.filter("_ruim").select(BAD))


def type_columns(df: DataFrame, types: dict[str, str] = EXTRACT_TYPES) -> DataFrame:
    """``try_cast`` the listed columns; whole numbers may be written as '2020.0'."""
    cols = []
    for f in df.schema.fields:
        t = types.get(f.name)
        if t is None:
            cols.append(F.col(f.name))
        elif t in ("int", "bigint"):
            # whole numbers keep all digits; '2020.0' is read through double, '2020.7' is not a whole number
            real = F.col(f.name).try_cast("double")
            cols.append(F.coalesce(F.col(f.name).try_cast(t), F.when(real == F.floor(real), real).try_cast(t)).alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(t).alias(f.name))
    return df.select(*cols)


def _files(spark: SparkSession, path: str):
    """(file system of ``path``, path) of the cluster's Hadoop client."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_extract(df: DataFrame | None, path: str, sep: str = ";", encoding: str = LATIN1,
                  verify: bool = True) -> bool:
    """Write a delimited extract with a header. An empty or missing table is
    refused (False). The table is evaluated once: it is written beside ``path``, the
    write itself counts the rows, and the folder takes the place of ``path`` if there
    are any. With ``verify`` the written rows are re-read and counted before that: if
    the counts differ the write is refused too. A refused write leaves ``path`` as it was."""
    if df is None:
        return False
    spark, seen = df.sparkSession, Observation()
    staged = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    (df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("header", True).option("sep", sep)
       .option("encoding", encoding).csv(staged))
    n = seen.get["n"]
    good = n > 0
    if good and verify:
        back = read_extract(spark, staged, sep=sep, encoding=encoding)
        good = back is not None and back.count() == n
    fs, new = _files(spark, staged)
    if not good:
        fs.delete(new, True)
        return False
    _, old = _files(spark, path)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{staged} holds the extract; it could not take the place of {path}")
    return True


def format_decimals(df: DataFrame, places: int = 4) -> DataFrame:
    """Render every floating column with a fixed number of decimals."""
    fmt = f"%.{places}f"
    cols = [F.format_string(fmt, F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def write_metric_table(df: DataFrame, path: str, places: int = 4) -> None:
    """Small result table (one row per model or class) as one UTF-8 CSV file."""
    (format_decimals(df, places).coalesce(1).write.mode("overwrite")
       .option("header", True).option("encoding", "UTF-8").csv(path))


def write_per_model(df: DataFrame, path: str, model_col: str = "modelo") -> None:
    """One folder per model (e.g. its confusion matrix)."""
    (df.repartition(model_col).write.mode("overwrite").partitionBy(model_col)
       .option("header", True).csv(path))


def write_report(spark: SparkSession, sections: list[tuple[str, str]], path: str) -> None:
    """A text report as (section, text) rows, e.g. best parameters and score."""
    spark.createDataFrame(sections, "secao string, texto string").coalesce(1) \
         .write.mode("overwrite").option("header", True).csv(path)
