"""Operators 2 and 8: exact top-k search, Jaccard join."""

import random

import numpy as np
import pytest

from gravis.llm import jaccard, mtree
from gravis.llm.components import components
from tests.llm import brute
from tests.llm.conftest import SF001


def found(df):
    return sorted(map(tuple, df.collect()))


def test_top_k_driver_table(spark):
    vectors = spark.read.parquet(f"{SF001}/embeddings.parquet")
    expected = brute.top_products({r["vec_id"]: r["embedding"] for r in vectors.collect()}, 50, 5)
    assert found(mtree.op2_mtree_top_k(spark, SF001)) == expected
    small = mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", tree_rows=40)
    assert found(small) == expected


def test_top_k_ties_copies_and_bad_vectors(spark):
    rnd = random.Random(1)
    vectors = {i: [rnd.choice((-1.0, -0.5, 0.0, 0.25, 1.0)) for _ in range(3)] for i in range(300)}
    vectors |= {i: [0.5, 0.5, 0.5] for i in range(300, 420)}  # a group of copies
    vectors |= {500: None, 550: [None, 1.0, 2.0], 551: [float("nan"), 0.0, 0.0], 552: [float("inf"), 0.0, 0.0], 553: [1e6, -1e6, 3e5]}
    rows = [(i, v, 1, 2) for i, v in vectors.items()] + [(7, vectors[7], 1, 2), (None, [1.0, 1.0, 1.0], 1, 2), (601, [1.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, route int")
    got = mtree.top_k(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", tree_rows=50)
    assert found(got) == brute.top_products(vectors, 50, 5)
    assert mtree.top_k(df.limit(0), df.limit(0), "vec_id", "embedding").count() == 0
    two = df.where("vec_id in (0, 3)")
    assert found(mtree.top_k(two, two.where("vec_id % 50 = 0"), "vec_id", "embedding")) == brute.top_products(
        {i: vectors[i] for i in (0, 3)}, 50, 5)


def test_tree_bounds_hold_and_prune():
    rnd = np.random.default_rng(2)
    centres = rnd.integers(-200, 200, (12, 8))
    x = (centres[rnd.integers(0, 12, 3000)] + rnd.integers(-6, 7, (3000, 8))).astype(float)
    m2 = float((x * x).sum(1).max())
    tree = mtree.MTree(x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0)), page=32)
    assert sorted(tree.order) == list(range(3000))
    s = mtree.Search(tree.dump(), [[i] for i in range(3000)])
    computed = []
    plain = s.products
    s.products = lambda a, q: computed.append(len(a)) or plain(a, q)
    for q in x[:20]:
        best = sorted(((int(v), int(i)) for i, v in enumerate(x @ q)), key=lambda p: (-p[0], p[1]))[:5]
        assert sorted(s.best(q, -1, m2, 5), key=lambda p: (-p[0], p[1])) == best
    assert sum(computed) < 0.7 * 20 * 3000


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_driver_table(spark, documents, texts, k, num):
    expected = brute.jaccard_components(texts, k, num, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(documents, k=k, num=num).collect()}
    assert got == expected


def near_copies(n, words, edits, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_groups_in_blocks(spark):
    texts = [(i, t) for i, t in enumerate(near_copies(120, 60, 3, 1) + near_copies(60, 12, 2, 2) + near_copies(40, 300, 20, 3))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for k, num in ((3, 90), (2, 70)):
        expected = brute.jaccard_components(texts, k, num, 100)
        for group in (10**6, 1500):
            got = jaccard.jaccard_components(df, k=k, num=num, group_shingles=group).collect()
            assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected


def test_pigeonhole_with_deletion_segments():
    rnd = np.random.default_rng(4)
    crowded = jaccard.Bands(90, 100, 3000, {b: 10**9 for b in range(60)})
    assert any(q for _, q in crowded.plan)  # so many sets make deletion segments worth it
    for bands in (crowded, jaccard.Bands(90, 100, 3000), jaccard.Bands(80, 100, 3000)):
        t = bands.num / bands.den
        for _ in range(300):
            n = int(rnd.integers(5, 400))
            a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            drop = int(rnd.integers(0, max(1, int(n * (1 - t))) + 1))
            b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 2**63, int(rnd.integers(0, 3))).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if not (len(b) and bands.den * common >= bands.num * (len(a) + len(b) - common)) or np.array_equal(a, b):
                continue
            assert len(np.intersect1d(bands.signatures(a), bands.signatures(b)))


def test_jaccard_edge_cases(edge):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(edge).collect()]
    assert len(got) == edge.count()
    assert {g for g in got if g[0] in (1, 2, 3)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3)}
    assert {g for g in got if g[0] in (4, 10)} == {(4, 1, 4), (10, 1, 4), (10, 2, 10)}
    assert [g for g in got if g[0] is None] == [(None, 3, None)]
    kept = jaccard.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None], key=str)
    assert jaccard.jaccard_components(edge.limit(0)).count() == 0
    assert jaccard.drop_near_duplicates(edge.limit(0)).count() == 0


def test_documents_of_one_id_are_told_apart(spark):
    """Rows of one id with unrelated texts stay; near copies go whatever their ids."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:-1] + ["other"])
    rows = [(1, " ".join(words)), (1, "quite another text that has its own words"), (1, "quite another text that has its own words"),
            (2, near), (2, "a third text with nothing in common at all"), (5, near), (-4, "quite another text that has its own words"), (9, None), (9, ""), (None, near)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, _i int").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.drop_near_duplicates(df).collect()), key=str)
    assert kept == sorted([(1, " ".join(words)), (2, "a third text with nothing in common at all"),
                           (-4, "quite another text that has its own words"), (9, None), (9, ""), (None, near)], key=str)


def test_spare_segments_leave_out_small_ones():
    """Many sets of a band: more segments than differences, the smallest are not listed."""
    import numpy as np
    bands = jaccard.Bands(80, 100, 1000, {b: 10_000 for b in range(60)})
    rnd = np.random.default_rng(2)
    u = [np.unique(rnd.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)) for _ in range(200)]
    listed = [set(bands.signatures(x).tolist()) for x in u]
    assert not any(a & b for i, a in enumerate(listed) for b in listed[:i])  # unrelated sets share nothing
    for x in u:
        y = np.unique(np.concatenate([x[int(rnd.integers(0, 50)):], rnd.integers(0, 2**63, 40).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common >= 80 * (len(x) + len(y) - common):
            assert set(bands.signatures(x).tolist()) & set(bands.signatures(y).tolist())


def test_texts_with_a_common_passage_are_no_candidates(spark):
    """Unlike texts that share a passage share signatures, but are not joined: their sets are never shuffled."""
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    texts = [(i, " ".join(passage + [f"w{rnd.randrange(10**9)}" for _ in range(50)])) for i in range(40)]
    texts += [(100 + i, t) for i, t in enumerate(near_copies(5, 200, 4, 8))]
    rows = jaccard.set_table(spark.createDataFrame(texts, "_id long, _text string"), "_id", "_text", 5)
    sets = rows.selectExpr("_id as id", "n_shingles", "sketch")
    ids = spark.createDataFrame(texts, "_id long, _text string")
    for listed in (jaccard.LISTED, 3):
        got = jaccard._candidates(sets.drop("sketch"), sets.select("id").limit(0), ids, sets, 5, 80, 100, listed)
        assert {r["id"]: r["root"] for r in got.collect()} == {100 + i: 100 for i in range(5)}


def test_long_lists_in_blocks(spark):
    texts = [(i, t) for i, t in enumerate(near_copies(80, 60, 3, 1) + near_copies(40, 12, 2, 2) + near_copies(30, 300, 20, 3))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = jaccard.jaccard_components(df, k=2, num=70, listed=7).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.jaccard_components(texts, 2, 70, 100)


@pytest.mark.parametrize("num", [90, 80, 40])
def test_sketches_drop_no_similar_pair(num):
    rnd = np.random.default_rng(num)
    sets = []
    for n in [int(x) for x in rnd.integers(1, 700, 60)]:
        base = rnd.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        for _ in range(4):
            drop, add = rnd.integers(0, n * (100 - num) // 120 + 1, 2).tolist()
            sets.append(np.unique(np.concatenate([base[drop:], rnd.integers(0, 2**63, add).astype(np.uint64)])))
    lists = rnd.integers(0, 2, len(sets))
    order = np.lexsort(([len(u) for u in sets], lists))
    sets, lists = [sets[i] for i in order], lists[order]
    size = np.array([len(u) for u in sets])
    side = rnd.integers(0, 2, len(sets))
    sketches = [jaccard.sketch(u) for u in sets]
    whole = jaccard.alike(lists, size, sketches, num, 100)
    across = jaccard.alike(lists, size, sketches, num, 100, side)
    similar = 0
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if lists[i] == lists[j] and 100 * common >= num * (size[i] + size[j] - common):
                similar += 1
                assert whole[i] == whole[j] and (side[i] == side[j] or across[i] == across[j])
    assert similar > 20
    if num > 50:
        assert len(set(whole.tolist())) > 60  # unlike sets stay apart


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, 9), (9, 8), (3, 3), (50, 60), (60, 50)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7, 8: 7, 9: 7, 3: 3, 50: 50, 60: 50}
