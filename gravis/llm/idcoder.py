"""Adaptive context-mixing range coder for token ids (operator 5).

A block of ids is coded on its own with a fresh model:

* order 2 and order 1 predict the id that followed the last time the same two
  (one) ids were seen, each with a confidence (how often in a row it was right);
* order 0 is the set of ids seen so far in the block, in order of appearance;
* a symbol says which one holds: order-2 prediction, order-1 prediction, a seen
  id (its number follows), a new id (its value follows). Its probabilities mix
  the counts under the pair of confidences with the counts of the whole block;
  the first gets more weight the more often that pair has been met.

The range coder is carry-less, with 64-bit registers, and puts out 32 bits at a
time. Many blocks are coded side by side, one array lane each, so numpy does the
arithmetic; a block's bytes do not depend on its neighbours. The coder knows
all ids at once, so there predictions and counts come from sorting and prefix
sums; the decoder keeps tables.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096  # ids a block holds, at most
LANES = 1024  # blocks coded side by side
SLOTS = 8192  # order-2 contexts of a block
CONTEXTS = 50  # 5 x 5 confidences, and whether both predictions agree
HALF, ONE, BITS = np.uint64(1 << 32), np.uint64(1), np.uint64(32)
_HEAD = struct.Struct("<4sIIII")  # magic, ids, payload bytes, crc32 of ids, crc32 of payload
MAGIC = b"GIB1"


def _slot(a, b):
    return (a * 40503 + b * 30341 + (a >> 3)) & (SLOTS - 1)


def _frequencies(counts, met, total, at):
    """Mixed integer frequencies of the four symbols (first axis)."""
    return (counts << 10) // (met + 4) + (total << 8) // (at + 1) + 1


def _groups(key):
    """Stable order by key and the start of each sorted place's group."""
    order = np.argsort(key, kind="stable")  # radix for 16-bit keys
    k = key[order]
    begins = np.concatenate([[True], k[1:] != k[:-1]])
    return order, begins


def _last(key, follow):
    """State of each place: 0 if its key is new, else 1 + the run (up to 3) of
    right predictions; and the prediction: what followed the key's last place."""
    order, begins = _groups(key)
    f = follow[order]
    prev = np.concatenate([f[:1], f[:-1]])
    hit = ~begins & (f == prev)
    h1 = np.concatenate([[False], hit[:-1]])
    h2 = h1 & np.concatenate([[False], h1[:-1]])
    h3 = h2 & np.concatenate([[False], h2[:-1]])
    state, pred = np.empty(len(key), np.int32), np.empty(len(key), np.int32)
    state[order] = np.where(begins, 0, 1 + h1.astype(np.int32) + h2 + h3)
    pred[order] = np.where(begins, -1, prev)
    return state, pred


def _events(ids: np.ndarray, wide: bool):
    """(cum, frequency, total - 1) of the coding steps of one block, in order."""
    n = len(ids)
    rows = np.arange(n, dtype=np.int32)
    order, begins = _groups(ids if wide else ids.astype(np.uint16))
    new = np.zeros(n, bool)
    new[order[begins]] = True
    upto = np.cumsum(new, dtype=np.int32)
    number = np.empty(n, np.int32)
    number[order] = (upto[order[begins]] - 1)[np.cumsum(begins) - 1]
    seen = upto - new
    back1 = np.concatenate([np.zeros(1, np.int32), number[:-1] + 1])
    back2 = np.concatenate([np.zeros(1, np.int32), back1[:-1]])
    s2, p2 = _last(_slot(back2, back1).astype(np.uint16), number)
    s1, p1 = _last(back1.astype(np.uint16), number)
    symbol = np.where(p2 == number, 0, np.where(p1 == number, 1, np.where(new, 3, 2)))
    context = s2 * 5 + s1 + 25 * ((s2 > 0) & (p1 == p2))
    order, begins = _groups(context.astype(np.uint16))
    start = np.flatnonzero(begins)[np.cumsum(begins) - 1].astype(np.int32)
    sorted_symbol = symbol[order]
    counts, total = np.empty((4, n), np.int32), np.empty((4, n), np.int32)
    for k in range(4):
        is_k = symbol == k
        total[k] = np.cumsum(is_k) - is_k
        is_k = sorted_symbol == k
        before = np.cumsum(is_k) - is_k
        counts[k, order] = before - before[start]
    met = np.empty(n, np.int32)
    met[order] = rows - start
    freq = _frequencies(counts, met, total, rows)
    upper = np.cumsum(freq, axis=0)
    f = freq[symbol, rows]
    more = np.where(symbol < 2, 1, np.where(symbol == 2, 2, 3 if wide else 2))
    step = np.cumsum(more) - more
    out = np.zeros((3, int(more.sum())), np.uint16)  # a zero row: the whole of a total of 1
    out[0, step], out[1, step], out[2, step] = upper[symbol, rows] - f, f, upper[3] - 1
    s = np.flatnonzero(symbol == 2)
    out[0, step[s] + 1], out[1, step[s] + 1], out[2, step[s] + 1] = number[s], 1, seen[s] - 1
    s = np.flatnonzero(symbol == 3)
    for k, v in enumerate((ids[s] & 0xFFFF, ids[s] >> 16) if wide else (ids[s],), 1):
        out[0, step[s] + k], out[1, step[s] + k], out[2, step[s] + k] = v, 1, 0xFFFF
    return out


def _renew(low, rng):
    """Lanes whose range got short give out the upper half of ``low``; if it is
    not settled yet, the range is cut where it would change."""
    go = np.flatnonzero(rng < HALF)
    if not len(go):
        return go, None
    a, g = low[go], rng[go]
    g = np.where((a ^ (a + g)) >= HALF, ((~a) + ONE) & (HALF - ONE), g)
    low[go], rng[go] = a << BITS, g << BITS
    return go, a >> BITS


def _code(events: list[np.ndarray]) -> list[bytes]:
    """Range-code the steps of many blocks side by side."""
    lanes, steps = len(events), max(e.shape[1] for e in events)
    table = np.zeros((3, steps, lanes), np.uint16)
    table[1] = 1
    for i, e in enumerate(events):
        table[:, :e.shape[1], i] = e
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out = np.zeros((lanes, steps // 2 + 4), np.uint32)  # a step takes at most 16 bits
    flat, pos = out.reshape(-1), np.arange(lanes) * out.shape[1]
    for t in range(steps):
        c, f, n = table[:, t].astype(np.uint64)
        r = rng // (n + ONE)
        low += c * r
        rng = f * r
        go, word = _renew(low, rng)
        if word is not None:
            at = pos[go]
            flat[at] = word
            pos[go] = at + 1
    flat[pos], flat[pos + 1] = low >> BITS, low & (HALF - ONE)
    size = pos + 2 - np.arange(lanes) * out.shape[1]
    return [out[i, :size[i]].astype("<u4").tobytes() for i in range(lanes)]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks (header and payload) of a sequence of unsigned 32-bit ids."""
    out = []
    for a in range(0, len(ids), BLOCK * LANES):
        blocks = [ids[b:b + BLOCK] for b in range(a, min(a + BLOCK * LANES, len(ids)), BLOCK)]
        wides = [bool(b.max() >= 1 << 16) for b in blocks]
        payloads = _code([_events(b, w) for b, w in zip(blocks, wides)])
        for block, wide, payload in zip(blocks, wides, payloads):
            raw = block.astype("<u4").tobytes()
            n = len(block) | (1 << 31 if wide else 0)
            out.append(_HEAD.pack(MAGIC, n, len(payload), zlib.crc32(raw), zlib.crc32(payload)) + payload)
    return out


class _Reader:
    """The decoder's registers, one lane a payload."""

    def __init__(self, payloads: list[bytes]):
        lanes = len(payloads)
        words = max(len(p) // 4 for p in payloads) + 4
        data = np.zeros((lanes, words), np.uint32)
        for i, p in enumerate(payloads):
            data[i, :len(p) // 4] = np.frombuffer(p, "<u4")
        self.data = data.reshape(-1)
        self.low, self.rng = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.code = data[:, 0].astype(np.uint64) << BITS | data[:, 1]
        self.pos = np.arange(lanes) * words + 2
        self.last = np.arange(1, lanes + 1) * words - 1

    def value(self, tot):
        """The coded value below ``tot``, and its unit."""
        unit = self.rng // tot
        return np.minimum((self.code - self.low) // unit, tot - ONE), unit

    def take(self, cum, frq, unit):
        self.low += cum * unit
        self.rng = frq * unit
        go, word = _renew(self.low, self.rng)
        if word is not None:
            at = self.pos[go]
            self.code[go] = self.code[go] << BITS | self.data[at]
            self.pos[go] = np.minimum(at + 1, self.last[go])  # lanes past their end read on in vain


def _decode_lanes(payloads: list[bytes], n: int, wide: bool) -> np.ndarray:
    """``n`` ids of each payload; shorter blocks get meaningless ids behind their end."""
    lanes = len(payloads)
    each = np.arange(lanes)
    rd = _Reader(payloads)
    ids = np.zeros((n, lanes), np.uint32)
    names = np.zeros(lanes * (n + 2), np.uint32)  # number -> id
    name_at, at1, at2, at_c = each * (n + 2), each * (BLOCK + 2), each * SLOTS, each * CONTEXTS
    seen = np.zeros(lanes, np.int64)
    # prediction + 1 (0: none) and its run of right ones, in one number
    t1, t2 = np.zeros(lanes * (BLOCK + 2), np.int32), np.zeros(lanes * SLOTS, np.int32)
    counts = np.zeros((4, lanes * CONTEXTS), np.int32)
    met = np.zeros(lanes * CONTEXTS, np.int32)
    total = np.zeros((4, lanes), np.int32)
    back1, back2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    no, one, full = np.uint64(0), np.ones(lanes, np.uint64), np.uint64(1 << 16)
    for t in range(n):
        i2, i1 = at2 + _slot(back2, back1), at1 + back1
        v2, v1 = t2[i2], t1[i1]
        p2, p1, c2, c1 = (v2 >> 2) - 1, (v1 >> 2) - 1, v2 & 3, v1 & 3
        has2, has1 = v2 > 0, v1 > 0
        context = at_c + (has2 * (c2 + 1)) * 5 + has1 * (c1 + 1) + 25 * (has2 & (p1 == p2))
        here = met[context]
        freq = _frequencies(counts[:, context], here, total, t)
        upper = np.cumsum(freq, axis=0)
        value, unit = rd.value(upper[3].astype(np.uint64))
        symbol = (value.astype(np.int32) >= upper[:3]).sum(axis=0)
        f = freq[symbol, each]
        rd.take((upper[symbol, each] - f).astype(np.uint64), f.astype(np.uint64), unit)
        known, fresh = (symbol == 2) & (seen > 0), symbol == 3
        # the number of a seen id, or the value of a new one; other lanes take the whole of a total of 1
        tot = np.where(known, seen.astype(np.uint64), np.where(fresh, full, one))
        value, unit = rd.value(tot)
        rd.take(value, one, unit)
        if wide:
            high, unit = rd.value(np.where(fresh, full, one))
            rd.take(high, one, unit)
            named = value | np.where(fresh, high, no) << np.uint64(16)
        else:
            named = value
        number = np.where(symbol == 0, p2, np.where(symbol == 1, p1, np.where(known, value.astype(np.int64), seen)))
        new = np.flatnonzero(fresh)
        names[name_at[new] + seen[new]] = named[new]
        seen[new] += 1
        number = np.maximum(np.minimum(number, n), 0)
        ids[t] = names[name_at + number]
        mark = (number + 1) << 2
        t2[i2] = mark | np.where(has2 & (p2 == number), np.minimum(c2 + 1, 3), 0)
        t1[i1] = mark | np.where(has1 & (p1 == number), np.minimum(c1 + 1, 3), 0)
        counts[symbol, context] += 1
        met[context] = here + 1
        total[symbol, each] += 1
        back2, back1 = back1, number + 1
    return ids.T


def decode_blocks(data: bytes) -> np.ndarray:
    """The ids of concatenated blocks; ValueError if a block is damaged."""
    heads, at = [], 0
    while at < len(data):
        magic, n, size, crc, payload_crc = _HEAD.unpack_from(data, at)
        payload = data[at + _HEAD.size:at + _HEAD.size + size]
        if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != payload_crc:
            raise ValueError(f"damaged block at byte {at}")
        heads.append((n & 0x7FFFFFFF, bool(n >> 31), crc, payload))
        at += _HEAD.size + size
    out: list[np.ndarray] = [np.empty(0, "<u4")] * len(heads)
    for wide in (False, True):
        own = [i for i, h in enumerate(heads) if h[1] == wide]
        for a in range(0, len(own), LANES):
            lanes = own[a:a + LANES]
            ids = _decode_lanes([heads[i][3] for i in lanes], max(heads[i][0] for i in lanes), wide)
            for lane, i in enumerate(lanes):
                block = ids[lane, :heads[i][0]].astype("<u4")
                if zlib.crc32(block.tobytes()) != heads[i][2]:
                    raise ValueError(f"block {i} does not give back its ids")
                out[i] = block
    return np.concatenate(out) if out else np.empty(0, "<u4")
