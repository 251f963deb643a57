"""Operator 1: byte-level BPE encoding and decoding.

A piece's bytes are mapped to Latin-1 characters. An Aho-Corasick automaton of
all reachable tokens gives the longest token at every position; the encoder
takes it, and backtracks to the next shorter prefix token (or drops the last
token) while the new token and its left neighbour could not stand side by side
after exact merging. Whether two tokens can be adjacent is decided by undoing
merges at their border and is memoised. Positions that failed are never tried
again, so a piece takes linear time, and the result equals the merge order of
the rank file exactly.

Defined results: null text is empty (no ids, digests of the empty string);
strings of special tokens are ordinary text; very long pieces are encoded whole;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gravis.llm.common import table
from gravis.llm.registry import register
from gravis.llm.subword import CACHE_PIECES, LookUpEncoder, splitter, texts_of

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def last_split(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge makes ``token``, or None if merging never gets there."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks),
                   default=None)
        if best is None:
            return None
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class BytePairEncoder:
    """Exact BPE of one rank table (token bytes to rank, ids are ranks)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}
        self.whole = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.left, self.right, self.merged, self.prefix = {}, {}, {}, {}
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.left[i] = self.right[i] = i
            else:
                parts = last_split(token, ranks)
                if parts is None or not all(p in ranks and ranks[p] in self.left for p in parts):
                    continue  # only a whole piece can become this token
                self.left[i], self.right[i] = ranks[parts[0]], ranks[parts[1]]
                self.merged[self.left[i], self.right[i]] = i
            self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        for i in self.left:
            t = self.tokens[i]
            self.prefix[i] = next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1)
                                   if t[:n] in ranks and ranks[t[:n]] in self.left), None)
        self.length = {i: len(self.tokens[i]) for i in self.left}
        self.automaton.make_automaton()
        self.beside: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Can ``a`` be followed by ``b`` after exact merging? Undo the later of
        the two border tokens' merges again and again; they cannot if the border
        parts would have merged before that."""
        key = a << 32 | b
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            known = self.beside[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        left, right, limit = self.left, self.right, 1 << 62
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                return False
            whole_a, whole_b = right[a] == a, left[b] == b
            if whole_a and whole_b:
                return True
            # of equal or older rank the left one merged first, so the right one is undone first
            if whole_b or (not whole_a and a > b):
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def encode_piece(self, piece: str) -> list[int]:
        s = piece.encode("utf-8").decode("latin-1")
        one = self.whole.get(s)
        if one is not None:
            return [one]
        n = len(s)
        longest = [0] * n
        for end, (i, before) in self.automaton.iter(s):
            longest[end - before] = i  # ends grow, so the longest stays
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        length, prefix, beside = self.length, self.prefix, self.beside
        while True:
            end = pos + length[token]
            fits = not dead[end]
            if fits and out:
                fits = beside.get(out[-1] << 32 | token)
                if fits is None:
                    fits = self.compatible(out[-1], token)
            if fits:
                out.append(token)
                pos = end
                if pos == n:
                    return out
                token = longest[pos]
                continue
            shorter = prefix[token]
            if shorter is not None:
                token = shorter
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= length[token]
                # the popped token is tried again: its end is dead now, so a prefix follows

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        found = map(self.encode_piece, pieces)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Spelled(dict):
    """Decimal ids (each followed by a comma) of pieces; their decoded bytes beside them."""

    def __init__(self, bpe: BytePairEncoder):
        super().__init__()
        self.bpe, self.decoded = bpe, {}
        self.names = {i: b"%d," % i for i in bpe.tokens}

    def __missing__(self, piece: str) -> bytes:
        ids = self.bpe.encode_piece(piece)
        self.decoded[piece] = self.bpe.decode(ids)
        spelled = self[piece] = b"".join(map(self.names.__getitem__, ids))
        return spelled

    def digests(self, pieces: list[str]) -> tuple[int, str, str]:
        """n_tokens and the digests of the ids and of their decoding."""
        if len(self) > CACHE_PIECES:
            self.clear()
            self.decoded.clear()
        ids = b"".join(map(self.__getitem__, pieces))
        return (ids.count(b","), hashlib.sha256(ids[:-1]).hexdigest(),
                hashlib.sha256(b"".join(map(self.decoded.__getitem__, pieces))).hexdigest())


_WORKER: dict[int, tuple[LookUpEncoder, _Spelled]] = {}


def _codec(ranks_file: bytes, pattern: str) -> tuple[LookUpEncoder, _Spelled]:
    key = hash((ranks_file, pattern))
    if key not in _WORKER:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x.strip())}
        bpe = BytePairEncoder(ranks)
        encoder = LookUpEncoder(splitter(pattern), lambda piece: bpe.encode_pieces([piece])[0])
        _WORKER[key] = encoder, _Spelled(bpe)
    return _WORKER[key]


def encode_table(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 digest: bool = False) -> DataFrame:
    """Per row the id and ``ids`` (packed little-endian unsigned 32-bit); with
    ``digest`` instead n_tokens and the digests of the ids and of their decoding."""
    with open(ranks_path, "rb") as f:
        ranks_file = df.sparkSession.sparkContext.broadcast(f.read())  # under 1 MB, fixed
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        encoder, spelled = _codec(ranks_file.value, pattern)
        for pdf in batches:
            texts = texts_of(pdf["_text"])
            rows = [spelled.digests(encoder.split(t)) for t in texts] if digest else [(p,) for p in encoder.encode(texts)]
            yield pd.concat([pdf[["_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=cols)], axis=1)
    cols = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids"]
    schema = f"_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids binary")
    picked = df.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text")
    return picked.mapInPandas(run, schema).withColumnRenamed("_id", id_col)


def decode_table(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row the id and ``bytes``, the decoded token bytes of packed ids (null: empty)."""
    tokens = df.sparkSession.sparkContext.broadcast({i: t for t, i in read_ranks(ranks_path).items()})
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        look = tokens.value.__getitem__
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "bytes": [
                b"".join(map(look, np.frombuffer(x or b"", "<u4").tolist())) for x in pdf["_ids"]]})
    return df.selectExpr(f"`{id_col}` as _id", f"`{ids_col}` as _ids").mapInPandas(
        run, f"_id {kind}, bytes binary").withColumnRenamed("_id", id_col)


@register("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    import public_tokenizers
    return encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER),
                        public_tokenizers.PATTERN, digest=True)
