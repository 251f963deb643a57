"""Operator 5: token-id output in a checksummed binary format.

Documents are sorted by id over range partitions (the one shuffle carries
texts), encoded by the tokenizers library and ended by one id each. Every
partition writes files of whole documents, cut when ``FILE_IDS`` ids are
reached: a header, the index of the documents, and the blocks of the
context-mixing coder (``idcoder``). A file is one row's ``content`` of a table
in the shared folder, so Spark's commit protocol covers lost executors and any
file system works; ``path`` keeps the table elsewhere.

Reading a file needs nothing but the file: its documents come from the decoded
ids. The starts of documents are the file's own first position, counted within
its partition, plus the ids of all partitions before, a sum over one row per
partition.

Defined results: null text is empty (the end id alone); null ids sort first;
rows with the same id are separate documents, in order of text; empty input
gives no rows (and no files); a damaged file raises ValueError; other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravis.llm.common import land, table
from gravis.llm.idcoder import decode_blocks, encode_blocks
from gravis.llm.registry import register
from gravis.llm.subword import library_encoder, texts_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
FILE_IDS = 1 << 22  # ids after which a file ends with its document
MAGIC = b"GIDF"
_HEAD = struct.Struct("<4sQII")  # magic, first position, documents, crc32 of the index
FILES = "part int, file int, n_ids long, content binary"


def make_file(first: int, docs: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A file of documents ``docs`` (integers or null) with ``lengths`` ids each."""
    null = np.array([d is None for d in docs], np.uint8)
    index = np.array([0 if d is None else d for d in docs], "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + null.tobytes()
    return _HEAD.pack(MAGIC, first, len(docs), zlib.crc32(index)) + index + b"".join(encode_blocks(ids))


def read_file(content: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """(first position, documents, lengths, ids) of a file."""
    magic, first, n, crc = _HEAD.unpack_from(content)
    index = content[_HEAD.size:_HEAD.size + 13 * n]
    if magic != MAGIC or len(index) != 13 * n or zlib.crc32(index) != crc:
        raise ValueError("damaged file head")
    docs = np.frombuffer(index, "<i8", n).tolist()
    lengths = np.frombuffer(index, "<u4", n, 8 * n)
    null = np.frombuffer(index, np.uint8, n, 12 * n)
    ids = decode_blocks(content[_HEAD.size + 13 * n:])
    if len(ids) != int(lengths.sum()):
        raise ValueError("ids are missing")
    return first, [None if x else d for d, x in zip(docs, null)], lengths, ids


def encode_files(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int = END_ID, partitions: int | None = None,
                 id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Files (part, file, n_ids, content) of the documents in ascending id order."""
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a fixed file of under 2 MB
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = end_id.to_bytes(4, "little")
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.repartitionByRange(n, "_id").sortWithinPartitions("_id", "_text").withColumn("part", F.spark_partition_id())

    def run(batches):
        encoder = library_encoder(spec.value, pattern)
        part = first = number = size = 0
        docs, packed = [], []

        def close():
            nonlocal first, number, size
            lengths = [len(p) // 4 for p in packed]
            content = make_file(first, docs, lengths, np.frombuffer(b"".join(packed), "<u4"))
            out = pd.DataFrame({"part": [part], "file": [number], "n_ids": [size], "content": [content]})
            first, number, size = first + size, number + 1, 0
            docs.clear()
            packed.clear()
            return out

        for pdf in batches:
            part = int(pdf["part"].iloc[0]) if len(pdf) else part
            ids = pdf["_id"].astype("Int64").tolist()
            for doc, p in zip(ids, encoder.encode(texts_of(pdf["_text"]))):
                docs.append(None if doc is pd.NA else int(doc))
                packed.append(p + end)
                size += len(p) // 4 + 1
                if size >= file_ids:
                    yield close()
        if docs:
            yield close()
    return rows.mapInPandas(run, FILES)


def write_files(files: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files (to ``path``, or the shared checkpoint folder) and give back the table."""
    if path is None:
        return land(files)
    files.write.mode("overwrite").parquet(path)
    return files.sparkSession.read.schema(files.schema).parquet(path)


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    def run(batches):
        for pdf in batches:
            for part, content in zip(pdf["part"], pdf["content"]):
                first, docs, lengths, ids = read_file(bytes(content))
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                yield pd.DataFrame({
                    "doc_id": pd.array(docs, "Int64"), "part": part, "rel": first + ends - lengths, "n_tokens": lengths.astype("int64"),
                    "ids_crc32": [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]})
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row per partition
    docs = files.select("part", "content").mapInPandas(
        run, "doc_id long, part int, rel long, n_tokens long, ids_crc32 long")
    return docs.join(before, "part").select("doc_id", (F.col("before") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")


@register("op5_id_coder")
def op5_id_coder(spark, sf_dir):
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    return read_documents(write_files(encode_files(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)))
