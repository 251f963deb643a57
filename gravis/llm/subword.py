"""Splitting texts into pieces and turning pieces into ids, shared by the
operators on token ids (encoding, binary output, packing).

Ids are kept as little-endian unsigned 32-bit integers, joined per text, so a
text costs one dictionary look-up per piece.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

import regex

# The Latin-1 letters, numbers and white space, by Unicode category.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_NUMBERS = "0-9²³¹¼½¾"
_SPACES = "\\t-\\r \\x85\\xa0"
_LATIN = re.compile("[^\\x00-\\xff]")
CHUNK = 256  # texts handled together
CACHE_PIECES = 500_000  # pieces a worker remembers, at most (and those of one chunk)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of a pre-tokenizer pattern. Texts of Latin-1 characters only
    use the standard ``re`` with the categories written out, which is faster."""
    whole = regex.compile(pattern)
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACES}{_LETTERS}{_NUMBERS}]").replace(
        r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]").replace(
        r"(?!\S)", f"(?![^{_SPACES}])").replace(r"\s", f"[{_SPACES}]")
    latin = re.compile(spelled)

    def split(text: str) -> list[str]:
        if text.isascii() or not _LATIN.search(text):
            return latin.findall(text)
        return whole.findall(text)
    return split


class PieceEncoder:
    """Texts to packed ids. ``encode_pieces(list) -> list of packed bytes`` is
    asked for unknown pieces only, a chunk's at once. Texts for which ``marked``
    is true are not split but go to ``encode_whole``."""

    def __init__(self, split: Callable[[str], list[str]], encode_pieces: Callable[[list[str]], list[bytes]],
                 marked: Callable[[str], object] | None = None, encode_whole: Callable[[str], bytes] | None = None):
        self.split, self.encode_pieces = split, encode_pieces
        self.marked, self.encode_whole = marked, encode_whole
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]):
        """Packed ids of each text, in order."""
        for i in range(0, len(texts), CHUNK):
            chunk = texts[i:i + CHUNK]
            pieces = [None if self.marked and self.marked(t) else self.split(t) for t in chunk]
            here = set().union(*[p for p in pieces if p is not None])
            if len(self.known) > CACHE_PIECES:
                self.known = {p: self.known[p] for p in here if p in self.known}
            new = [p for p in here if p not in self.known]
            self.known.update(zip(new, self.encode_pieces(new)))
            look = self.known.__getitem__
            for t, p in zip(chunk, pieces):
                yield self.encode_whole(t) if p is None else b"".join(map(look, p))


class PieceCache(dict):
    """Packed ids by piece; a piece that is not there yet is encoded on look-up."""

    def __init__(self, encode_piece: Callable[[str], bytes]):
        super().__init__()
        self.encode_piece = encode_piece

    def __missing__(self, piece: str) -> bytes:
        packed = self[piece] = self.encode_piece(piece)
        return packed


class LookUpEncoder:
    """As ``PieceEncoder``, with one look-up a piece; the cache is emptied when it is full."""

    def __init__(self, split: Callable[[str], list[str]], encode_piece: Callable[[str], bytes],
                 marked: Callable[[str], object] | None = None, encode_whole: Callable[[str], bytes] | None = None):
        self.split, self.marked, self.encode_whole = split, marked, encode_whole
        self.known = PieceCache(encode_piece)

    def encode(self, texts: list[str]):
        """Packed ids of each text, in order."""
        known, split, marked = self.known, self.split, self.marked
        look = known.__getitem__
        for t in texts:
            if len(known) > CACHE_PIECES:
                known.clear()
            yield self.encode_whole(t) if marked and marked(t) else b"".join(map(look, split(t)))


_WORKER: dict[int, LookUpEncoder] = {}


def byte_characters() -> dict[int, str]:
    """The characters a byte-level vocabulary spells bytes with: printable
    Latin-1 bytes as themselves, the others from U+0100 on."""
    plain = {b: chr(b) for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173}
    others = [b for b in range(256) if b not in plain]
    return plain | {b: chr(256 + i) for i, b in enumerate(others)}


def library_encoder(tokenizer_json: str, pattern: str) -> LookUpEncoder:
    """Encoder of a byte-level ``tokenizers`` file, kept for a worker's life.
    Ids are those of the library's ``encode`` without added special tokens: a
    text that holds one of the file's added tokens (such as ``<|endoftext|>``)
    goes to it whole. Other texts are split by the tokenizer's own pattern, and
    each piece goes to the library's model once, spelled in byte characters as
    its pre-tokenizer would."""
    key = hash(tokenizer_json)
    if key not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
        from tokenizers import Tokenizer
        tok = Tokenizer.from_str(tokenizer_json)
        if tok.normalizer is not None or "ByteLevel(add_prefix_space=False" not in repr(tok.pre_tokenizer):
            raise ValueError("a byte-level tokenizer without normalizer or prefix space is needed")

        tokenize, spell = tok.model.tokenize, byte_characters()

        def encode(piece: str) -> bytes:
            found = tokenize(piece.encode().decode("latin-1").translate(spell))
            return struct.pack(f"<{len(found)}I", *[t.id for t in found])

        def encode_whole(text: str) -> bytes:
            ids = tok.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        added = [re.escape(t.content) for t in tok.get_added_tokens_decoder().values()]
        marked = re.compile("|".join(added)).search if added else None
        _WORKER[key] = LookUpEncoder(splitter(pattern), encode, marked, encode_whole)
    return _WORKER[key]


def texts_of(column) -> list[str]:
    """Texts of a pandas column; null is empty."""
    return [t if isinstance(t, str) else "" for t in column]
