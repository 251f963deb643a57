import hashlib

import public_tokenizers

from gravis.llm import bpe


def test_digests_look_up_a_piece_once_and_equal_the_packed_ids(monkeypatch):
    path = public_tokenizers.path(bpe.TOKENIZER)
    with open(path, "rb") as f:
        encoder, spelled = bpe._codec(f.read(), public_tokenizers.PATTERN)
    plain = bpe.BytePairEncoder(bpe.read_ranks(path))
    asked = []
    real = spelled.bpe.encode_piece
    monkeypatch.setattr(spelled.bpe, "encode_piece", lambda p: asked.append(p) or real(p))
    for text in ("", " ", "the quick quick quick brown fox", "naïve ñandú Ελλάδα 日本語 🎉🎉", "x" * 3000 + " 12345"):
        pieces = encoder.split(text)
        ids = [i for p in pieces for i in plain.encode_piece(p)]
        assert spelled.digests(pieces) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                                           hashlib.sha256(text.encode()).hexdigest())
        assert plain.decode(ids) == text.encode()
    assert len(asked) == len(set(asked))
