"""Operator 7: best-fit packing by length-histogram planning.

Documents are cut into pieces of at most ``SEQ`` tokens. Only the counts of the
piece lengths (at most ``SEQ`` numbers) reach the driver, where best-fit
decreasing places counts instead of documents: sequences of equal fill form an
interval of sequence numbers, and one step puts many equal pieces into a whole
interval. Every plan row says which ranks within a length go where, and pieces
take their slots by a join on (length, rank): ranks come from a count per
(length, hash bucket) and a window inside each bucket, so a length that holds
most pieces is not ranked in one task.

The plan has at most a few thousand rows for any input (each length splits at
most one interval), which bounds the broadcast.

Defined results: null text is empty (one piece, the end id); a document id that
repeats gives the pieces of each of its rows; empty input gives no rows; other
columns are ignored. A document of more than ``SEQ`` tokens is cut into
``SEQ``-token pieces from its end, so that its first piece may be shorter.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravis.llm.common import land, table
from gravis.llm.registry import register
from gravis.llm.subword import library_encoder, texts_of

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SEQ = 1024
RANK_ROWS = 20_000  # rows of one length that are ranked in one window, about


def cut(n: int, seq: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens."""
    first = n % seq or min(n, seq)
    return [(0, first)] + [(s, seq) for s in range(first, n, seq)] if n else []


def pieces(df: DataFrame, tokenizer_path: str, pattern: str, seq: int = SEQ, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a hash of the text's ids), piece, start, length, ids_crc32."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a fixed file of under 2 MB
    kind = df.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encoder = library_encoder(spec.value, pattern)
        for pdf in batches:
            rows = []
            for doc, packed in zip(pdf["_id"], encoder.encode(texts_of(pdf["_text"]))):
                packed += end
                for k, (s, n) in enumerate(cut(len(packed) // 4, seq)):
                    rows.append((doc, k, s, n, zlib.crc32(packed[4 * s:4 * (s + n)])))
            out = pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"_id": "Int64"}) if kind in ("bigint", "int") else out
    return df.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text").mapInPandas(
        run, f"_id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_id", id_col)


def plan(histogram: dict[int, int], seq: int = SEQ) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (length, first rank, number of
    pieces, first sequence, pieces per sequence, offset of the first)."""
    rows = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> intervals [a, b) of sequences
    free: list[int] = []  # its keys, sorted
    opened = 0

    def put(r: int, a: int, b: int) -> None:
        if a < b and r:
            if r not in room:
                room[r] = []
                free.insert(bisect_left(free, r), r)
            room[r].append((a, b))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            i = bisect_left(free, length)
            if i < len(free):
                r = free[i]
                a, b = room[r].pop()
                if not room[r]:
                    del room[r]
                    free.pop(i)
            else:
                r, a = seq, opened
                b = opened = opened + -(-left // (seq // length))
            each = r // length
            full = min(b - a, left // each)
            if full:
                rows.append((length, rank, full * each, a, each, seq - r))
                rank, left = rank + full * each, left - full * each
                put(r - each * length, a, a + full)
            if left and full < b - a:  # fewer than ``each`` pieces are left
                rows.append((length, rank, left, a + full, left, seq - r))
                put(r - left * length, a + full, a + full + 1)
                full, rank, left = full + 1, rank + left, 0
            put(r, a + full, b)
    return rows


def pack(found: DataFrame, seq: int = SEQ, id_col: str = "doc_id") -> DataFrame:
    """Pieces (landed) with sequence_id and offset."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= seq rows
    slots = spark.createDataFrame(plan(counts, seq) or [], "length long, first long, n long, a long, each long, off long")
    buckets = max(1, max(counts.values(), default=0) // RANK_ROWS)  # affects speed only
    keyed = found.withColumn("b", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    before = keyed.groupBy("length", "b").agg(F.count("*").alias("n"))
    before = before.select("length", "b", (F.sum("n").over(W.partitionBy("length").orderBy("b")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "b").orderBy(id_col, "piece", "start", "ids_crc32"))
    ranked = keyed.withColumn("inside", inside).join(before, ["length", "b"]).withColumn(
        "rank", F.col("before") + F.col("inside") - 1)
    # the plan rows of a length, in rank order; a piece's row is the last that begins at or before its rank
    by_length = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "a", "each", "off"))).alias("s"))
    hit = F.element_at(F.filter("s", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["n"])), 1)
    placed = ranked.join(F.broadcast(by_length), "length").withColumn("x", hit)
    at = F.col("rank") - F.col("x.first")
    return placed.select(id_col, "piece", "start", "length", "ids_crc32",
                         (F.col("x.a") + F.floor(at / F.col("x.each"))).cast("long").alias("sequence_id"),
                         (F.col("x.off") + F.pmod(at, F.col("x.each")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(df: DataFrame, tokenizer_path: str, pattern: str, seq: int = SEQ, end_id: int = END_ID) -> DataFrame:
    return pack(land(pieces(df, tokenizer_path, pattern, seq, end_id)), seq)


def packed_sequences(df: DataFrame) -> DataFrame:
    """``pack_documents`` with the tokenizer of the registered query."""
    import public_tokenizers
    return pack_documents(df, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


@register("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    return packed_sequences(table(spark, sf_dir, "documents"))
