"""Operator 13: language identification by hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of +1 and -1, made
from its code point alone. An n-gram's vector binds the letters' vectors,
permuted by their place, by multiplication. A text's vector bundles (adds) the
vectors of all its n-grams; a language's prototype bundles the texts it is learned
from. The prediction is the language whose prototype has the greatest cosine with
the text's vector, equal cosines go to the smaller name; the score is that cosine,
at least 0.

Letters are code points that Python calls alphabetic, lower-cased; everything
between two words is one gap, and a text begins and ends with a gap.

Defined results: a text that is null or has no letter is ``und`` with score 0 and
teaches nothing; without any language to learn from all texts are ``und``. A row
without id is not held out. Repeated rows count as often as they come. Whole texts
are used, in slices of bounded size. Only the named columns are read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravis.llm.common import land, table
from gravis.llm.registry import register

DIMENSIONS = 1024
SIZE = 3                      # letters of an n-gram
SEED = 13
SLICE = 1 << 20               # characters worked on at once
GRAM_ROWS = 1 << 14           # n-gram vectors a worker keeps (16 MB)
LANGUAGES_PER_PASS = 1024     # prototypes sent to the tasks at once (8 MB)
LANGUAGES_PER_TASK = 1024     # languages a learning task adds up before it hands them on
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=8192)
def letter_vector(symbol: int) -> np.ndarray:
    """The random vector of a code point (0: the gap)."""
    bits = np.random.Generator(np.random.PCG64([SEED, symbol])).integers(0, 2, DIMENSIONS, np.int8)
    return 2 * bits - 1


def gram_vector(key: int) -> np.ndarray:
    """The letters of an n-gram, each rotated by its distance from the end, multiplied."""
    out = letter_vector(key & 0x1FFFFF)
    for i in range(1, SIZE):
        out = out * np.roll(letter_vector(key >> 21 * i & 0x1FFFFF), i)
    return out


def grams(text: str | None):
    """(n-gram keys ascending, counts) of a text, per slice; a key packs 21 bits a symbol."""
    if not text:
        return
    text, carry, any_letter = text.lower(), np.zeros(1, np.int64), False
    for start in range(0, len(text), SLICE):
        points = np.frombuffer(text[start:start + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letters = _alphabetic()[points]
        any_letter = any_letter or bool(letters.any())
        s = np.concatenate([carry, np.where(letters, points, 0)])
        if start + SLICE >= len(text):
            s = np.append(s, 0)
        fresh = len(carry)
        keep = np.ones(len(s), bool)
        keep[fresh:] = (s[fresh:] != 0) | (s[fresh - 1:-1] != 0)
        s = s[keep]
        if any_letter and len(s) >= SIZE:
            key = s[:-2] << 42 | s[1:-1] << 21 | s[2:]
            yield np.unique(key, return_counts=True)
        carry = s[-(SIZE - 1):]


class GramVectors:
    """Vectors of the n-grams met last, at most ``GRAM_ROWS``."""

    def __init__(self):
        self.rows = np.empty((GRAM_ROWS, DIMENSIONS), np.int8)
        self.at: dict[int, int] = {}

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of count * vector; exact (whole numbers far below 2^53)."""
        out = np.zeros(DIMENSIONS)
        for a in range(0, len(keys), 1024):
            some = keys[a:a + 1024].tolist()
            if len(self.at) + len(some) > GRAM_ROWS:
                self.at.clear()
            at = self.at
            for key in some:
                if key not in at:
                    self.rows[len(at)] = gram_vector(key)
                    at[key] = len(at)
            block = self.rows[[at[k] for k in some]]
            n = counts[a:a + 1024]
            if n.sum() < 1 << 24:  # every partial sum is a whole number that a float32 holds
                out += n.astype(np.float32) @ block.astype(np.float32)
            else:
                out += n.astype(np.float64) @ block.astype(np.float64)
        return out


@functools.lru_cache(maxsize=1)
def _vectors() -> GramVectors:
    return GramVectors()


def text_vector(text: str | None) -> np.ndarray | None:
    """The bundle of a text's n-grams, None without letters."""
    out = None
    for keys, counts in grams(text):
        part = _vectors().bundle(keys, counts)
        out = part if out is None else out + part
    return out


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, vector): prototypes of all non-null languages. A task adds its texts up
    before anything is moved; sums of whole numbers do not depend on the order."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        waiting: dict[str, list] = {}
        held = 0

        def settle():
            for lang, parts in waiting.items():
                keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([c for _, c in parts])).astype(np.int64)
                sums[lang] = sums.get(lang, 0) + _vectors().bundle(keys, counts)
            waiting.clear()

        def hand_on():
            listed = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(listed, pa.string()), pa.array(
                [sums[x].astype(np.int64) for x in listed], pa.list_(pa.int64()))], ["lang", "v"])
            sums.clear()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in grams(text.as_py()):
                    waiting.setdefault(lang, []).append(part)
                    held += len(part[0])
                if held > SLICE:
                    settle()
                    held = 0
                    if len(sums) > LANGUAGES_PER_TASK:
                        yield from hand_on()
        settle()
        yield from hand_on()
    picked = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("t"))
    parts = picked.where("lang is not null and t is not null").mapInArrow(run, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    return sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).getField("x").alias("vector"))


def predict(rows: DataFrame, prototypes: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` with lang_pred and score. Prototypes meet the texts in
    passes of ``LANGUAGES_PER_PASS``, each pass keeping the better language."""
    spark = rows.sparkSession
    kinds = ", ".join(f"`_k{i}` {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    scored = rows.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("_t"),
                         F.lit(UNKNOWN).alias("lang_pred"), F.lit(-1.0).alias("score"))
    n = len(keep)

    def passed(scored: DataFrame, names: list[str], vectors: list) -> DataFrame:
        matrix = np.array(vectors, np.float64)
        shared = spark.sparkContext.broadcast((names, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)))

        def run(batches):
            names, unit = shared.value
            for batch in batches:
                langs, scores = batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()
                for i, text in enumerate(batch.column(n)):
                    v = text_vector(text.as_py())
                    size = 0.0 if v is None else float(np.sqrt(v @ v))
                    if size:
                        cosine = np.clip(np.round(unit @ v / size, 12), 0.0, 1.0)
                        best = int(np.argmax(cosine))  # names ascend, so the smaller one of equal cosines
                        if cosine[best] > scores[i]:
                            langs[i], scores[i] = names[best], float(cosine[best])
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n + 1)], pa.array(langs, pa.string()),
                                                  pa.array(scores, pa.float64())], batch.schema.names)
        return scored.mapInArrow(run, f"{kinds}{', ' if kinds else ''}_t string, lang_pred string, score double")
    names, vectors = [], []
    for row in prototypes.orderBy("lang").toLocalIterator():
        if not any(row["vector"]):
            continue
        names.append(row["lang"])
        vectors.append(row["vector"])
        if len(names) == LANGUAGES_PER_PASS:
            scored = passed(scored, names, vectors)
            names, vectors = [], []
    if names:
        scored = passed(scored, names, vectors)
    return scored.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", F.greatest("score", F.lit(0.0)).alias("score"))


def held_out(id_col: str = "doc_id"):
    """Rows that are judged only: crc32 of the id's text is 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, judge all rows: id, held_out, lang_pred, score."""
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l"),
                       held_out(id_col).alias("held_out"))
    prototypes = land(learn(rows.where("not held_out"), "t", "l"))
    return predict(rows, prototypes, "t", ("i", "held_out")).withColumnRenamed("i", id_col)


@register("op13_hyperdimensional_language")
def op13_hyperdimensional_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
