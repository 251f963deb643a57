"""Operators 11, 12 and 13 against plain versions."""

import collections
import itertools
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from gravis.llm import interaction, language, lexical
from tests.llm import brute
from tests.llm.conftest import EDGE_TEXTS, SF001

LABELS = [(1, 1, 0), (2, 0, 1), (6, 1, 1), (7, 1, 0), (8, 0, 1), (10, 1, 0), (10, 0, 1), (None, 1, 1), (99, 1, 1)]


# 11: filter interaction audit

def removals_step_by_step(rows, good, bad):
    """{(part, order, step): counts} by running every order over the rows."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def fails(i, t):
        w = brute.WORD.findall(t)
        return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
    parts = collections.defaultdict(list)
    for i, t, s in rows:
        parts[s or ""].append((i, fails(i, t or "")))
    out = {}
    for part, docs in parts.items():
        shares = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shares[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(d[1][f] for d in docs) - len(gone),
                                          sum(d[1][f] and sum(d[1].values()) == 1 for d in docs),
                                          sum(d[0] in good for d in gone), sum(d[0] in bad for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shares[order[step - 1]])
    return out


def audited(spark, docs, labels):
    got = interaction.audit(interaction.coalition_removals(interaction.failures(docs), labels)).collect()
    assert len(got) == len({(r["part"], r["filter_order"], r["step"]) for r in got})
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got}


def test_audit_edges(spark, edge):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = [(i, t, None if i == 5 else "src") for i, t in EDGE_TEXTS]
    good, bad = ({r[0] for r in LABELS if r[k] and r[0] is not None} for k in (1, 2))
    assert audited(spark, edge, labels) == removals_step_by_step(rows, good, bad)
    assert audited(spark, edge.limit(0), labels) == {}
    assert len(audited(spark, edge, labels.limit(0))) == 2 * 600


def test_audit_large_copy_groups(spark):
    """A third of the rows are one text, another third one repeated row."""
    rows = [(i, "Same text", f"s{i % 2}") for i in range(300)] + [(5, "Again |", "s0")] * 300 + [(i, f"word {i} " * 300, None) for i in range(300, 320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(320)], "doc_id long, quality int, toxic boolean")
    labels = labels.withColumn("toxic", labels["toxic"].cast("int"))
    assert audited(spark, docs, labels) == removals_step_by_step(rows, {i for i in range(320) if i % 2}, {i for i in range(320) if i % 3 == 0})


def test_audit_query(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text", "source").collect()]
    labels = spark.read.parquet(f"{SF001}/labels.parquet").collect()
    expected = removals_step_by_step(rows, {r["doc_id"] for r in labels if r["quality"] == 1}, {r["doc_id"] for r in labels if r["toxic"] == 1})
    got = interaction.op11_filter_interaction(spark, SF001).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == expected


@pytest.mark.parametrize("players", [2, 3, 5])
def test_least_squares_shares_are_shapley(players):
    rnd = random.Random(players)
    value = [0] + [rnd.randrange(1000) for _ in range((1 << players) - 1)]
    solved = [sum(c * v for c, v in zip(row, value)) for row in interaction.solve_shares(players)]
    exact = [Fraction(0)] * players
    for order in itertools.permutations(range(players)):
        s = 0
        for i in order:
            exact[i] += Fraction(value[s | 1 << i] - value[s], math.factorial(players))
            s |= 1 << i
    assert solved == exact and sum(solved) == value[-1]


# 12: ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=10):
    """[(item, rank, id, score)] by scoring every row."""
    counted = [(i, collections.Counter(TERM.findall((t or "").translate(brute.LOWER)))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    queries = collections.defaultdict(set)
    for i, t in items:
        queries[i] |= set(TERM.findall((t or "").translate(brute.LOWER)))
    out = []
    for q, own in queries.items():
        scores = []
        for i, c, n in counted:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def searched(docs, items, k=10):
    return sorted([tuple(r) for r in lexical.search(docs, items, k=k).collect()], key=str)


def test_terms():
    text = "\x00Ab-É ß_1٣\x7fÇa   x日本 Z"
    assert [t.decode() for t in lexical.terms(text.encode())] == TERM.findall(text.translate(brute.LOWER))


def test_search_query(spark, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    got = sorted([tuple(r) for r in lexical.op12_pair_maxscore(spark, SF001).collect()], key=str)
    assert got == ranked(texts, items)


ITEMS = [(1, "one two lines WORDS"), (2, None), (3, "absentterm"), (4, "the the words"), (4, "cx a"), (None, "x é on"), (5, "  "),
         (6, " ".join("abcdefgh")), (7, "日本語 x")]


def test_search_edges(spark, edge, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as rank", "2 as score", "3 as i")
    expected = ranked(EDGE_TEXTS, ITEMS)
    assert searched(edge, items) == expected
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)  # several blocks of items
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 3)
    assert searched(edge.coalesce(1), items) == expected
    assert searched(edge.limit(0), items) == [] and searched(edge, items.limit(0)) == []
    assert searched(edge, items, k=1) == ranked(EDGE_TEXTS, ITEMS, 1)


def test_search_ties_and_copies(spark):
    rows = [(i, "alpha beta gamma") for i in range(200)] + [(i % 5, "alpha alpha beta delta") for i in range(50)] + [(None, "delta")]
    items = [(1, "alpha"), (2, "beta delta"), (3, "gamma alpha delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert searched(docs, spark.createDataFrame(items, "item_id long, text string")) == ranked(rows, items)


def _block(rnd, docs, vocabulary, k):
    doc, term, impact = [], [], []
    for t in range(vocabulary):
        n = max(1, int(docs / (t + 1)))
        for d in sorted(rnd.sample(range(docs), n)):
            doc.append(d)
            term.append(t)
            impact.append(rnd.randrange(1, 20) * (t + 1))
    return lexical.DocumentBlock(pa.array(range(docs)), np.array(doc), np.array(term), np.array(impact), k)


def test_pair_bounds_are_exact_and_read_less():
    """Same k best with and without pairs and by adding everything up; pairs never
    loosen a bound, and less is read with them."""
    rnd = random.Random(3)
    block = _block(rnd, 3000, 60, 10)
    with_pairs, without = [0], [0]
    for _ in range(60):
        query = sorted(rnd.sample(range(60), 12))
        block.index_pairs([query])
        full = np.zeros(3000, np.int64)
        for t in query:
            a, b = block.at[t]
            full[block.doc[a:b]] += block.impact[a:b]
        expected = np.lexsort((np.arange(3000), -full))[:10]
        for pairs_on, counter in ((True, with_pairs), (False, without)):
            docs, scores = block.search(query, 1, counter, pairs_on)
            first = np.lexsort((docs, -scores))[:10]
            assert docs[first].tolist() == expected.tolist() and scores[first].tolist() == full[expected].tolist()
        own = block.ordered(query)
        tight, loose = block.bounds(own)[0], block.bounds(own, False)[0]
        for i, (x, y) in enumerate(zip(tight, loose)):
            reach = np.zeros(3000, np.int64)
            for t in own[:i + 1]:
                a, b = block.at[t]
                reach[block.doc[a:b]] += block.impact[a:b]
            assert reach.max() <= x <= y == sum(block.best[t] for t in own[:i + 1])
    assert with_pairs[0] < without[0]


# 13: language identification

def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op13_hyperdimensional_language(spark, sf).collect()
    import zlib
    assert len(rows) == len(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    judged = [r["lang_pred"] == labels[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(judged) > 100 and sum(judged) >= 0.98 * len(judged)


def plain_vector(text):
    """The definition, one n-gram after another."""
    symbols = [0]
    for c in text.lower():
        s = ord(c) if c.isalpha() else 0
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    out = np.zeros(language.DIMENSIONS, int)
    for i in range(len(symbols) - 2):
        out += np.roll(language.letter_vector(symbols[i]), 2) * np.roll(language.letter_vector(symbols[i + 1]), 1) * language.letter_vector(symbols[i + 2])
    return out if any(symbols) else None


@pytest.mark.parametrize("text", ["a", "Hello, world", "  x  y", "ÀÉ日本 語!", "12 ab\n\ncd 3", "...", "é" * 40 + "-" * 40 + "b c"])
def test_text_vector(text, monkeypatch):
    expected = plain_vector(text)
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(language, "SLICE", size)
        got = language.text_vector(text)
        assert (got is None and expected is None) or np.array_equal(got, expected)
    assert language.text_vector(None) is None and language.text_vector("") is None


def test_language_edges(spark, edge, monkeypatch):
    got = {(r["doc_id"], r["lang_pred"], r["held_out"]): r["score"] for r in language.identify(edge).collect()}
    assert {p for i, p, _ in got if i in (1, 2, 3)} == {"und"} and all(got[k] == 0 for k in got if k[1] == "und")
    assert {p for i, p, _ in got if i not in (1, 2, 3)} == {"en"} and not any(h for i, _, h in got if i is None)
    assert language.identify(edge.limit(0)).count() == 0
    unlabelled = language.identify(edge.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert len(unlabelled) == len(EDGE_TEXTS) and {r["lang_pred"] for r in unlabelled} == {"und"}


def test_language_passes_and_partitions(spark, documents, monkeypatch):
    """More prototypes than a pass takes, other partitions: the same answers."""
    one = {tuple(r) for r in language.identify(documents).collect()}
    monkeypatch.setattr(language, "LANGUAGES_PER_PASS", 1)
    assert {tuple(r) for r in language.identify(documents.repartition(13)).collect()} == one


def test_language_ties_go_to_the_smaller_name(spark):
    rows = [(i, "same words here", "b" if i % 2 else "a") for i in range(40)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and {r["score"] for r in got} == {1.0}
