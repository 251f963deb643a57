"""Operator 12: ranked lexical search, by MaxScore with bounds of term pairs.

The query set is read in blocks of ``QUERY_BLOCK`` items. For a block, one pass
over all texts counts terms and keeps the counts of terms that a query holds (the
table ``postings``); document frequencies, N and L come from that table. A second
pass indexes ``postings`` in blocks of documents: per term a list of documents
with impacts and the greatest impact; per listed pair of terms the documents that
hold both, with the greatest joint impact. A query takes its terms by ascending
greatest impact; the bound of its first terms is the least sum over covers by
disjoint pairs and single terms, where a pair counts the greatest of its joint
maximum and its two single maxima, never above their sum. The first terms whose
bound stays under the threshold are skipped: no document is found through them,
and they are looked up only for documents that can still reach the threshold. The
threshold is the k-th best score so far in the task, raised by the k-th best single
or joint impact and partial score of a block. The best of all tasks are merged in
two steps. Results are exact.

Scores and weights are the contract's whole-number formula (see ``impacts``).

Defined results: null and empty texts hold no terms and are no documents; rows of
one document id are documents of their own; items of equal id are one item with the
terms of all their texts; an item without terms, or whose terms no document holds,
has no rows. Equal scores go by ascending id, a null id last. Only the named
columns are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravis.llm.common import LOWER, UPPER, land, table
from gravis.llm.registry import register

TOP = 10
QUERY_BLOCK = 2000          # items searched at once; their terms travel to every task
BLOCK_POSTINGS = 2_000_000  # postings of a document block, at most (32 MB)
BLOCK_DOCS = 16_384
PAIR_REACH = 2              # a term is paired with the ones just before it by greatest impact
MERGE_SALTS = 64

# Bytes outside terms become spaces, A-Z become a-z; every byte above 0x7F stays.
_FOLD = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
              for b in range(256))


def terms(data: bytes) -> list[bytes]:
    """Terms of a UTF-8 text, in order."""
    return data.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Score that a term of weight ``w`` found ``tf`` times adds to a document of ``n`` terms."""
    m = 100 - 90 + (90 * n * n_docs) // n_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class DocumentBlock:
    """Inverted lists of some documents, numbered in the order of their ids."""

    def __init__(self, ids: pa.Array, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, k: int):
        self.ids, self.k = ids, k
        order = np.lexsort((doc, term))
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        found, start = np.unique(term, return_index=True)
        self.at = dict(zip(found.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(term)])))
        self.best = {t: int(self.impact[a:b].max()) for t, (a, b) in self.at.items()}
        self.kth = {t: self._kth(self.impact[a:b]) for t, (a, b) in self.at.items()}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}

    def _kth(self, x: np.ndarray) -> int:
        return int(np.partition(x, -self.k)[-self.k]) if len(x) >= self.k else 0

    def look_up(self, t: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the ascending ``docs``, impacts) of those that hold ``t``."""
        a, b = self.at[t]
        own = self.doc[a:b]
        if len(own) < len(docs):
            at = np.searchsorted(docs, own)
            hit = docs[np.minimum(at, len(docs) - 1)] == own
            return at[hit], self.impact[a:b][hit]
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        hit = np.flatnonzero(own[at] == docs)
        return hit, self.impact[a:b][at[hit]]

    def pair(self, s: int, t: int) -> tuple[int, int]:
        """(greatest, k-th greatest) joint impact of the documents that hold both."""
        known = self.pairs.get((s, t))
        if known is None:
            a, b = self.at[s]
            at, other = self.look_up(t, self.doc[a:b])
            joint = self.impact[a:b][at] + other
            known = self.pairs[s, t] = (int(joint.max()), self._kth(joint)) if len(joint) else (0, 0)
        return known

    def ordered(self, query: list[int]) -> list[int]:
        """The query's terms in this block by ascending greatest impact."""
        return sorted((t for t in query if t in self.at), key=lambda t: (self.best[t], t))

    def index_pairs(self, queries: list[list[int]]) -> None:
        """Intersection lists of the pairs that the bounds of these queries combine."""
        for query in queries:
            own = self.ordered(query)
            for i, t in enumerate(own):
                for s in own[max(0, i - PAIR_REACH):i]:
                    self.pair(s, t)

    def bounds(self, own: list[int], use_pairs: bool = True) -> tuple[list[int], int]:
        """For every i the least combined bound of the terms up to i (disjoint pairs
        and single terms), and a k-th best score that is surely reached."""
        best, upto = self.best, []
        floor = max((self.kth[t] for t in own), default=0)
        for i, t in enumerate(own):
            bound = best[t] + (upto[i - 1] if i else 0)
            for j in range(max(0, i - PAIR_REACH), i) if use_pairs else ():
                joint, kth = self.pairs[own[j], t]
                floor = max(floor, kth)
                between = sum(best[own[x]] for x in range(j + 1, i))
                bound = min(bound, max(joint, best[own[j]], best[t]) + between + (upto[j - 1] if j else 0))
            upto.append(bound)
        return upto, floor

    def search(self, query: list[int], threshold: int, counter: list[int] | None = None,
               use_pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Documents (ascending) with their scores, among them all of the block's k
        best that reach ``threshold``. ``counter`` adds up the list entries read."""
        own = self.ordered(query)
        upto, floor = self.bounds(own, use_pairs)
        threshold = max(threshold, floor, 1)
        needed = int(np.searchsorted(upto, threshold))  # the terms before cannot reach it together
        score = np.zeros(len(self.ids), np.int64)
        for t in own[needed:]:
            a, b = self.at[t]
            score[self.doc[a:b]] += self.impact[a:b]
            if counter is not None:
                counter[0] += b - a
        docs = np.flatnonzero(score)
        for i in range(needed - 1, -1, -1):
            if len(docs) >= self.k:
                threshold = max(threshold, self._kth(score[docs]))
            docs = docs[score[docs] + upto[i] >= threshold]
            if not len(docs):
                break
            at, add = self.look_up(own[i], docs)
            score[docs[at]] += add
            if counter is not None:
                a, b = self.at[own[i]]
                counter[0] += min(b - a, len(docs))
        docs = docs[score[docs] >= threshold]
        return docs, score[docs]


class Best:
    """The k best (score, id) of one item in a task; a null id comes last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def threshold(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, ids: pa.Array, docs: np.ndarray, scores: np.ndarray) -> None:
        first = np.lexsort((docs, -scores))[:self.k]
        new = zip(scores[first].tolist(), ids.take(pa.array(docs[first])).to_pylist())
        self.rows = sorted(self.rows + list(new), key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:self.k]


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """(_id, n, ids, tfs): number of terms, and the query terms with their counts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        known = vocabulary.value
        for batch in batches:
            sizes, ends, ids, tfs = [], [0], [], []
            for data in batch.column(1).cast(pa.large_binary()).to_pylist():
                found = terms(data or b"")
                sizes.append(len(found))
                for t, tf in Counter(found).items():
                    i = known.get(t)
                    if i is not None:
                        ids.append(i)
                        tfs.append(tf)
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], ["_id", "n", "ids", "tfs"])
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(
        run, f"_id {kind}, n long, ids array<int>, tfs array<long>")


def _blocks(batches, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Document blocks of bounded size from the batches of ``postings``."""
    held, docs, entries = [], 0, 0

    def close():
        one = pa.Table.from_batches(held).combine_chunks()
        one = one.take(pc.sort_indices(one, sort_keys=[("_id", "ascending")], null_placement="at_end")).combine_chunks()
        lists, tfs = one.column("ids").chunk(0), one.column("tfs").chunk(0)
        sizes = np.diff(lists.offsets.to_numpy())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        term = lists.flatten().to_numpy(zero_copy_only=False)
        n = one.column("n").to_numpy()[doc]
        impact = impacts(weights[term], tfs.flatten().to_numpy(zero_copy_only=False), n, n_docs, n_terms)
        return DocumentBlock(one.column("_id").combine_chunks() if one.num_rows else one.column("_id"), doc, term, impact, k)
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            held.append(part)
            docs += part.num_rows
            entries += len(part.column(part.schema.get_field_index("ids")).flatten())
            if docs >= BLOCK_DOCS or entries >= BLOCK_POSTINGS:
                yield close()
                held, docs, entries = [], 0, 0
    if docs:
        yield close()


def _search_block(docs: DataFrame, items: list[tuple[object, set[bytes]]], id_col: str, text_col: str, item_kind: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    names = sorted(set().union(*[t for _, t in items]))
    number = {t: i for i, t in enumerate(names)}
    postings = land(count_terms(docs, id_col, text_col, spark.sparkContext.broadcast(number)))
    total = postings.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total["n"], total["l"] or 0
    weights = np.zeros(len(names), np.int64)
    if n_docs:  # one count per term of this block of items
        for r in postings.select(F.explode("ids").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
            weights[r["t"]] = weight(n_docs, r["df"])
    queries = [(name, sorted(number[t] for t in own)) for name, own in items]
    shared = spark.sparkContext.broadcast((weights, queries))

    def run(batches):
        weights, queries = shared.value
        best = [Best(k) for _ in queries]
        for block in _blocks((b for b in batches if b.num_rows), weights, n_docs, n_terms, k):
            block.index_pairs([own for _, own in queries])
            for (_, own), top in zip(queries, best):
                found, scores = block.search(own, top.threshold)
                if len(found):
                    top.add(block.ids, found, scores)
        rows = [(q[0], i, s) for q, top in zip(queries, best) for s, i in top.rows]
        yield pa.RecordBatch.from_pydict({"item_id": [r[0] for r in rows], "_id": [r[1] for r in rows], "score": [r[2] for r in rows]},
                                         schema=out)
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = f"item_id {item_kind}, _id {postings.schema['_id'].dataType.simpleString()}, score long"
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return postings.where("size(ids) > 0").mapInArrow(run, schema)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           query_col: str = "text", k: int = TOP) -> DataFrame:
    """Per item the ``k`` best documents with a score above 0: item, rank, id, score."""
    kind = queries.schema[item_col].dataType.simpleString()
    order = [F.col("score").desc(), F.col("_id").asc_nulls_last()]
    rows = queries.select(F.col(f"`{item_col}`").alias("i"), F.col(f"`{query_col}`").alias("t")).orderBy("i").toLocalIterator()
    found, items = [], []

    def flush():
        found.append(_search_block(docs, [x for x in items if x[1]], id_col, text_col, kind, k))
        items.clear()
    for row in rows:
        own = set(terms((row["t"] or "").encode()))
        if items and items[-1][0] == row["i"]:
            items[-1][1].update(own)
            continue
        if len(items) == QUERY_BLOCK:
            flush()
        items.append((row["i"], own))
    items = items or [(None, set())]
    flush()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    for keys in (["item_id", "salt"], ["item_id"]):
        hits = hits.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(MERGE_SALTS))) if "salt" in keys else hits
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return hits.select(F.col("item_id").alias(item_col), "rank", F.col("_id").alias(id_col), "score")


SQL = f"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
u AS (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
p AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM u GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                        '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM benchmark),
s AS (
  SELECT item_id, rid, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
         * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN g GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}"""


@register("op12_pair_maxscore", SQL)
def op12_pair_maxscore(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
