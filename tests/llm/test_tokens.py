"""Operators 1, 5 and 7: encoding, binary output, packing."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gravis.llm import bpe, idcoder, idfile, packing, subword
from tests.llm import brute
from tests.llm.conftest import EDGE_TEXTS

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def rank_codec():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.TOKENIZER))
    exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.BytePairEncoder(ranks)
    return coder, subword.PieceEncoder(subword.splitter(PATTERN), coder.encode_pieces), exact


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tok.encode_special_tokens = True
    return lambda texts: [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def unpack(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinorst 's\n\t'1é日\x85\x1c🎉"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_bpe_equals_library(rank_codec, text):
    coder, encoder, exact = rank_codec
    ids = unpack(next(encoder.encode([text])))
    assert ids == exact.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_bpe_long_runs(rank_codec):
    coder, _, exact = rank_codec
    rnd = random.Random(3)
    for alphabet in ("a", "ab", "ethioansr"):
        piece = "".join(rnd.choice(alphabet) for _ in range(20_000))
        assert coder.encode_piece(piece) == exact.encode_ordinary(piece)


def test_bpe_unreachable_token_only_as_whole_piece():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"xyz": 258}
    coder = bpe.BytePairEncoder(ranks)
    assert coder.encode_piece("xyz") == [258]
    assert coder.encode_piece("xyza") == [120, 121, 122, 97]
    assert coder.encode_piece("abc") == [256, 99]


def test_bpe_table(edge, rank_codec):
    _, encoder, exact = rank_codec
    path = public_tokenizers.path(bpe.TOKENIZER)
    got = bpe.encode_table(edge, path, PATTERN, digest=True)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    expected = []
    for i, t in EDGE_TEXTS:
        ids = exact.encode_ordinary(t or "")
        expected.append((i, len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha((t or "").encode())))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    back = bpe.decode_table(bpe.encode_table(edge, path, PATTERN), path)
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t in EDGE_TEXTS)
    assert bpe.encode_table(edge.limit(0), path, PATTERN, digest=True).count() == 0


def test_splitter_fast_path():
    fast = subword.splitter(PATTERN)
    import regex
    slow = regex.compile(PATTERN)
    everything = "".join(map(chr, range(256)))
    for text in (everything, " ".join(everything), "  a\x85\xa0 b\n\n c ª² ½x", "it's  they'll\t\t3rd  "):
        assert fast(text) == slow.findall(text)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=300), st.integers(1, 9000))
def test_coder_round_trip(seed_ids, n):
    ids = np.resize(np.array(seed_ids or [0], "<u4"), n if seed_ids else 0)
    blocks = idcoder.encode_blocks(ids)
    assert len(blocks) == -(-len(ids) // idcoder.BLOCK)
    assert (idcoder.decode_blocks(b"".join(blocks)) == ids).all()


def test_coder_blocks_are_independent_and_checked():
    rnd = np.random.default_rng(5)
    ids = rnd.zipf(1.3, 3 * idcoder.BLOCK).clip(0, 60_000).astype("<u4")
    blocks = idcoder.encode_blocks(ids)
    assert idcoder.encode_blocks(ids[idcoder.BLOCK:2 * idcoder.BLOCK]) == [blocks[1]]
    assert (idcoder.decode_blocks(blocks[2]) == ids[2 * idcoder.BLOCK:]).all()
    assert sum(map(len, blocks)) < 2 * len(ids)
    for at in (0, 5, 13, 40, len(blocks[0]) - 1):
        bad = bytearray(blocks[0])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idcoder.decode_blocks(bytes(bad))


def expected_file_rows(texts, ids):
    rows, at = [], 0
    for i, own in sorted(zip((i for i, _ in texts), ids), key=lambda x: -1 if x[0] is None else x[0]):
        rows.append((i, at, len(own) + 1, brute.crc(own + [0])))
        at += len(own) + 1
    return rows


def test_id_files(spark, texts, documents, library):
    path = public_tokenizers.path(idfile.TOKENIZER)
    expected = expected_file_rows(texts, library([t for _, t in texts]))
    for partitions, file_ids in ((1, 1 << 22), (5, 3000)):
        files = idfile.write_files(idfile.encode_files(documents, path, PATTERN, partitions=partitions, file_ids=file_ids))
        assert sorted(map(tuple, idfile.read_documents(files).collect())) == expected


def test_id_files_edge_cases(edge, library):
    path = public_tokenizers.path(idfile.TOKENIZER)
    got = idfile.read_documents(idfile.write_files(idfile.encode_files(edge, path, PATTERN, partitions=3))).collect()
    assert len(got) == len(EDGE_TEXTS)
    rows = sorted(got, key=lambda r: r["start"])
    assert rows[0]["doc_id"] is None and rows[0]["start"] == 0
    assert [r["start"] for r in rows[1:]] == list(np.cumsum([r["n_tokens"] for r in rows])[:-1])
    crcs = sorted(brute.crc(x + [0]) for x in library([t for _, t in EDGE_TEXTS]))
    assert sorted(r["ids_crc32"] for r in rows) == crcs
    empty = idfile.write_files(idfile.encode_files(edge.limit(0), path, PATTERN, partitions=2))
    assert idfile.read_documents(empty).count() == 0


def check_packing(rows, ids_of):
    by_doc, by_sequence = {}, {}
    for doc, piece, start, length, crc, seq, off in rows:
        by_doc.setdefault(doc, []).append((piece, start, length, crc))
        by_sequence.setdefault(seq, []).append((off, length))
    for doc, ids in ids_of.items():
        own, at = sorted(by_doc.pop(doc)), 0
        for k, (piece, start, length, crc) in enumerate(own):
            assert piece == k and start == at and crc == brute.crc(ids[start:start + length])
            assert length == 1024 or (k == 0 and length <= 1024)
            at += length
        assert at == len(ids)
        assert len(own) == -(-len(ids) // 1024)
    assert not by_doc
    for places in by_sequence.values():
        at = 0
        for off, length in sorted(places):
            assert off == at
            at += length
        assert at <= 1024
    return len(by_sequence)


def test_packing(documents, texts, library):
    ids_of = {i: x + [2] for (i, _), x in zip(texts, library([t for _, t in texts]))}
    n = check_packing(list(map(tuple, packing.packed_sequences(documents).collect())), ids_of)
    room = -(-sum(map(len, ids_of.values())) // 1024)
    assert room <= n <= 1.05 * room + 1


def test_packing_edge_cases(edge, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 2)
    distinct = edge.dropDuplicates(["doc_id"]).where("doc_id is not null")
    rows = list(map(tuple, packing.packed_sequences(distinct).collect()))
    assert len({r[0] for r in rows}) == distinct.count()
    assert len(packing.packed_sequences(edge).select("doc_id").distinct().collect()) == len({i for i, _ in EDGE_TEXTS})
    assert packing.packed_sequences(edge.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 20), min_size=1, max_size=30))
def test_plan_is_best_fit_decreasing(histogram):
    filled, placed = {}, {}
    for length, first, n, a, each, off in packing.plan(histogram, 64):
        assert first == placed.get(length, 0)
        placed[length] = first + n
        for x in range(n):
            filled.setdefault(a + x // each, []).append((off + x % each * length, length))
    assert placed == histogram
    for places in filled.values():
        at = 0
        for off, length in sorted(places):
            assert off == at
            at += length
        assert at <= 64
    room = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [(r, i) for i, r in enumerate(room) if r >= length]
            if fits:
                room[min(fits)[1]] -= length
            else:
                room.append(64 - length)
    assert len(filled) == len(room)


MARKED = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext|><|endoftext|>  x\n", "a<|endoftext|", "é日<|endoftext|>'s 12 <|ENDOFTEXT|>"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "endoftext", " ", "the", "é", "日", "\n", "'s"]), max_size=12))
def test_library_encoder_equals_library_defaults(parts):
    with open(public_tokenizers.path(packing.TOKENIZER), encoding="utf-8") as f:
        encoder = subword.library_encoder(f.read(), PATTERN)
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["".join(parts), "plain", *MARKED]
    assert [unpack(x) for x in encoder.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_in_files_and_pieces(spark):
    path = public_tokenizers.path(idfile.TOKENIZER)
    tok = Tokenizer.from_file(path)
    texts = list(enumerate(MARKED + ["plain text after it"]))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    ids = [tok.encode(t, add_special_tokens=False).ids for _, t in texts]
    files = idfile.write_files(idfile.encode_files(df, path, PATTERN, partitions=2))
    assert sorted(map(tuple, idfile.read_documents(files).collect())) == expected_file_rows(texts, ids)
    check_packing(list(map(tuple, packing.packed_sequences(df).collect())), {i: x + [2] for (i, _), x in zip(texts, ids)})
