"""Operator 8: n-gram Jaccard join by a universe-partition pigeonhole.

A document's set holds 64-bit hashes of its distinct word shingles. Sets whose
similarity reaches t = ``num / den`` differ in at most H = s (1 - t) / t
elements, s being the smaller size. Sizes fall into bands; for the largest size
of a band the hash universe is cut into m segments, and ``q`` of them also index
their one-deletion neighbourhoods, with m + q = H + 1. Similar sets then agree
in an exact segment, or differ by at most one element in a segment with
deletions; so they share a signature under the band of the smaller set, under
which the larger one lists itself too. ``q`` is chosen per band by cost: one
more deletion segment makes segments longer, which costs signatures and saves
accidental agreement (of empty or nearly empty segments), the more the more
sets the corpus has in the band. Or there are more than H + 1 segments without
deletions: similar sets then agree in at least m - H of them, H now for a set's own
size, so every set may leave out its smallest segments, all of a size up to the
largest one with at most m - H - 1 such segments. (Of two similar sets the one that
leaves out more still lists a segment in which they agree, and the other lists it
too.) Empty segments and those of one shingle, which unrelated documents share, are
left out that way.

Equal sets are one class and only its representative (least id) joins. Documents
that share a signature are listed under the signature's least document. There
pairs are compared by size and by a parity sketch (bit i: whether the set holds an
odd number of elements that fall on i), whose bits differ in at most as many places
as the sets have different elements: so no similar pair is dropped, and texts that only
have a passage in common rarely stay. The components of the pairs that stay hold every
similar pair, so nothing has to list pairs. Inside a component (cut into pairs of
blocks if it is large) all sizes and intersections are counted exactly through an
inverted index.

Hash collisions: 64-bit shingles and 128-bit classes; the odds of one wrong
shingle in a 20,000-word text are about 10^-11.

Defined results: null text and text without words have the empty set and link
with nothing; with fewer words than a shingle the whole sequence is the one
shingle; rows with null id have no component; rows with equal ids are one node of
``jaccard_components``, while ``drop_near_duplicates`` tells them apart by text;
repeated rows are equal sets; empty input gives no rows; other columns are
ignored by ``jaccard_components`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from bisect import bisect_right
from math import lgamma

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravis.llm.common import all_columns, land, small, table
from gravis.llm.components import components
from gravis.llm.registry import register

CANDIDATE_COST = 20.0  # signatures that one accidental candidate is worth
SHARED_ELEMENTS = 0.01  # share of its elements that a set is taken to have in common with an unlike set
SEGMENTS_MORE = (1.0, 1.25, 1.5, 2.0)  # numbers of segments to choose from, in parts of H
GROUP_SHINGLES = 500_000  # set elements that are compared in one task, about
BUCKET_SIGNATURES = 500_000  # signatures that meet in one group, about
SKETCH_BITS = 1 << 14  # bits of a sketch, at most; larger sets are only sketched less sharply
LISTED = 4096  # documents of one list that are compared in one block, about
BUCKET_LISTED = 50_000  # listed documents whose sketches meet in one group, about
SKETCH_WORDS = 1 << 20  # words of sketches compared at a time
_WORDS_KEPT = 100_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingle_set(text, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; A-Z is lowered and words
    are split at ASCII white space (both as ``bytes`` does)."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not w:
        return np.empty(0, np.uint64)
    if len(_HASHES) > _WORDS_KEPT:
        _HASHES.clear()
    h = np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))
    size = min(k, len(w))
    acc = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        acc = acc * _P + h[i:len(w) - size + 1 + i]
    return np.unique(_mix(acc))


def sketch(u: np.ndarray) -> bytes:
    """Parities of the numbers of elements by their last bits: of about one bit an element. A
    sketch folded in halves is that of fewer bits."""
    bits = min(SKETCH_BITS, max(64, 1 << (len(u) - 1).bit_length())) if len(u) else 64
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Bands:
    """Size bands, and segments and deletion segments of each."""

    def __init__(self, num: int, den: int, largest: int, sets_in: dict[int, int] | None = None):
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] <= largest:
            e = self.edges[-1]
            self.edges.append(max(e + 1, e * den ** 3 // num ** 3))
        self.plan = [self._plan(b, (sets_in or {}).get(b, 0)) for b in range(len(self.edges) - 1)]

    def of(self, n: int) -> int:
        return bisect_right(self.edges, n) - 1

    def _plan(self, b: int, sets: int) -> tuple[int, int]:
        low, high = self.edges[b], self.edges[b + 1] - 1
        h = self.differences(high)
        if h == 0:
            return 0, 0  # only equal sets are similar
        plans = []
        for q in range(1, (h + 1) // 2 + 1):
            m = h + 1 - q
            g = low / m  # elements a segment has, at least
            accidental = (m - q) * np.exp(-2 * g) + q * ((1 + g) * np.exp(-g)) ** 2
            plans.append((m + q * high / m + CANDIDATE_COST * max(sets, 1) * accidental, (m, q)))
        size = np.arange(64)
        for m in sorted({int(np.ceil(h * x)) + 1 for x in SEGMENTS_MORE}):
            costs = []
            for n in (low, high):  # both ends of the band; larger sets list themselves like the upper end
                g = n / m
                share = np.exp(size * np.log(g) - g - np.array([lgamma(x + 1) for x in size]))  # Poisson
                left_out = m * np.cumsum(share)
                kept = left_out + np.sqrt(left_out) > m - self.differences(n) - 1  # a set's counts vary
                accidental = m * (share[kept] ** 2 * SHARED_ELEMENTS ** size[kept]).sum()
                costs.append(m * share[kept].sum() + CANDIDATE_COST * max(sets, 1) * accidental)
            plans.append((max(costs), (m, 0)))
        return min(plans)[1]

    def differences(self, smaller: int) -> int:
        """Elements in which similar sets can differ, at most."""
        return smaller * (self.den - self.num) // self.num

    def lists_under(self, n: int) -> list[int]:
        """The bands a set of size ``n`` lists itself under: its own, and those of
        smaller sets it can be similar to."""
        b = self.of(n)
        out = [b]
        while b > 0 and (self.edges[b] - 1) * self.den // self.num >= n:
            b -= 1
            out.append(b)
        return out

    def signatures(self, u: np.ndarray) -> np.ndarray:
        parts = []
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(u, dtype=np.uint64)])
        high = u >> np.uint64(32)
        for b in self.lists_under(len(u)):
            m, q = self.plan[b]
            if not m:
                continue
            spare = 0 if q else m - self.differences(min(len(u), self.edges[b + 1] - 1)) - 1
            segment = (high * np.uint64(m)) >> np.uint64(32)
            ends = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
            content = sums[ends[1:]] - sums[ends[:-1]]
            size = np.diff(ends).astype(np.uint64)
            place = _mix(np.arange(m, dtype=np.uint64) + np.uint64((b + 1) << 32))
            exact = _mix(content + place + size * _P)
            if spare:  # sizes up to the largest with at most ``spare`` segments are left out
                sizes = size.astype(np.int64)
                least = np.searchsorted(np.cumsum(np.bincount(sizes)), spare, side="right")
                exact = exact[sizes >= least]
            parts.append(exact)
            for s in range(q):
                e = u[ends[s]:ends[s + 1]]
                parts.append(_mix(content[s] - e + place[s] + (size[s:s + 1] - np.uint64(1)) * _P))
        return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def set_table(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, n_shingles, the class hashes h1, h2 and the sketch of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["_text"]:
                u = shingle_set(text, k)
                rows.append((len(u), _signed(_mix(u).sum(dtype=np.uint64)), _signed(_mix(u ^ _P).sum(dtype=np.uint64)), sketch(u)))
            out = pd.DataFrame(rows, columns=["n_shingles", "h1", "h2", "sketch"])
            yield pd.concat([pdf[["_id"]].reset_index(drop=True), out], axis=1)
    return df.selectExpr(f"`{id_col}` as _id", f"`{text_col}` as _text").mapInPandas(
        run, f"_id {kind}, n_shingles long, h1 long, h2 long, sketch binary")


def linked(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> list[int]:
    """Root (an index) of every set, joining all pairs whose similarity reaches
    ``num / den``; with ``side``, pairs of equal side are skipped."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    values = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(rank, size)
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    inverse, owner = inverse[shared], owner[shared]
    by = np.lexsort((owner, inverse))
    inverse, owner = inverse[by], owner[by]
    first = np.flatnonzero(np.concatenate([[True], inverse[1:] != inverse[:-1]])) if len(by) else np.empty(0, np.int64)
    start_of = np.repeat(first, np.diff(np.append(first, len(by)))) if len(by) else first
    at = np.argsort(owner, kind="stable")  # each set's places in the postings
    lo = np.searchsorted(owner[at], np.arange(n + 1))
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ssize = size[order]
    sside = side[order] if side is not None else None
    for r in range(n):
        mine = at[lo[r]:lo[r + 1]]
        if not len(mine):
            continue
        # postings of smaller sets stand before this set's own place
        pieces = [owner[a:b] for a, b in zip(start_of[mine].tolist(), mine.tolist()) if b > a]
        if not pieces:
            continue
        common = np.bincount(np.concatenate(pieces), minlength=r)[:r]
        hit = np.flatnonzero((common > 0) & (den * common >= num * (ssize[:r] + ssize[r] - common)))
        if sside is not None:
            hit = hit[sside[hit] != sside[r]]
        for j in hit.tolist():
            x, y = find(int(order[r])), find(int(order[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


_POSTINGS = "bucket int, base long, sig binary, off binary"


def _planes(x: np.ndarray, size: int) -> bytes:
    """Little-endian integers byte plane by byte plane (equal bytes compress away)."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _from_planes(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return out.view("<u8").reshape(-1)


def _postings(ids: np.ndarray, signatures: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """A batch's signatures, packed by bucket. Signatures keep 48 bits besides their
    bucket; a chance agreement of those only adds a candidate."""
    sig = np.concatenate(signatures) if signatures else np.empty(0, np.uint64)
    owner = np.repeat(ids, [len(s) for s in signatures])
    bucket = ((sig >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)
    key = bucket << np.uint64(48) | sig & np.uint64((1 << 48) - 1)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    base = int(owner.min()) if len(owner) else 0
    wide = 8 if len(owner) and int(owner.max()) - base >= 1 << 32 else 4
    cuts = np.searchsorted(key >> np.uint64(48), np.arange(buckets + 1, dtype=np.uint64))
    rows = [(b, base, _planes(key[x:y], 6), _planes((owner[x:y] - base).astype(np.uint64), wide))
            for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
    return pd.DataFrame(rows, columns=["bucket", "base", "sig", "off"])


def _lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """(hub, id), each once: the documents of every signature of a bucket that several
    documents share, the hub among them being the least."""
    keys, owners = [], []
    for base, sig, off in zip(pdf["base"], pdf["sig"], pdf["off"]):
        keys.append(_from_planes(bytes(sig), 6))
        owners.append(_from_planes(bytes(off), len(off) // len(keys[-1])).astype(np.int64) + base)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(first[1:], len(key)) - 1
    hub = np.repeat(owner[first], last - first + 1)
    several = np.repeat(owner[first] != owner[last], last - first + 1)
    pair = np.unique(np.stack([hub[several], owner[several]]), axis=1)
    return pd.DataFrame({"hub": pair[0], "id": pair[1]})


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of the pairs (a, b); every place points at its root before and after."""
    while len(a):
        x, y = parent[a], parent[b]
        more = x != y
        a, b, x, y = a[more], b[more], x[more], y[more]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def alike(lists: np.ndarray, size: np.ndarray, sketches: list[bytes], num: int, den: int,
          side: np.ndarray | None = None) -> np.ndarray:
    """Root (a place) of every document, joining pairs of one list that can be similar by
    size and sketch; rows stand by list and in it by size. With ``side`` not negative, pairs of equal side are
    skipped. All documents are compared with the d-th behind them, for d = 1, 2, ... while sizes allow."""
    n = len(lists)
    words = np.array([len(x) // 8 for x in sketches], np.int64)
    at = np.cumsum(words) - words
    flat = np.frombuffer(b"".join(sketches), "<u8")
    parent = np.arange(n)
    rows, d, met, kept = parent.copy(), 0, [], 0
    while len(rows):
        d += 1
        rows = rows[rows < n - d]
        rows = rows[(lists[rows] == lists[rows + d]) & (size[rows] * den >= num * size[rows + d])]
        ask = parent[rows] != parent[rows + d]
        if side is not None:
            ask &= (side[rows] < 0) | (side[rows] != side[rows + d])
        for w, v in sorted(set(zip(words[rows[ask]].tolist(), words[rows[ask] + d].tolist()))):
            own = rows[ask & (words[rows] == w) & (words[rows + d] == v)]
            for part in np.array_split(own, len(own) * v // SKETCH_WORDS + 1):
                y = flat[at[part + d][:, None] + np.arange(v)].reshape(len(part), v // w, w)
                x = flat[at[part][:, None] + np.arange(w)] ^ np.bitwise_xor.reduce(y, axis=1)
                differ = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
                part = part[differ * (den + num) <= (size[part] + size[part + d]) * (den - num)]
                met.append((part, part + d))
                kept += len(part)
        if kept and (kept > n or not d & (d - 1) or not len(rows)):
            _unite(parent, *map(np.concatenate, zip(*met)))
            met, kept = [], 0
    return parent


def _candidates(reps: DataFrame, copies: DataFrame, text: DataFrame, sets: DataFrame, k: int, num: int, den: int,
                listed: int = LISTED) -> DataFrame:
    """(id, root) of representatives in the same candidate component; ``copies``
    (id) represent no class, ``sets`` has (id, n_shingles, sketch) of all."""
    largest = reps.agg(F.max("n_shingles")).first()[0] or 0
    shape = Bands(num, den, largest)
    edges = F.array(*[F.lit(e) for e in shape.edges])
    band = F.size(F.filter(edges, lambda e: e <= F.col("n_shingles"))) - 1
    sets_in = {r["band"]: r["n"] for r in reps.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    bands = Bands(num, den, largest, sets_in)  # a row per size band: a few dozen

    total = sum(n * sum(m + q * bands.edges[b] // max(m, 1) for m, q in map(
        bands.plan.__getitem__, bands.lists_under(bands.edges[b]))) for b, n in sets_in.items())
    buckets = int(min(1 << 16, max(64, total // BUCKET_SIGNATURES)))

    def index(batches):
        for pdf in batches:
            yield _postings(pdf["_id"].to_numpy(np.int64), [bands.signatures(u) if len(u) else u for u in (
                shingle_set(t, k) for t in pdf["_text"])], buckets)

    # copies list nothing: only a class's least id stays
    text = text.where("_id is not null").join(small(copies), F.col("_id") == F.col("id"), "left_anti")
    lists = land(text.mapInPandas(index, _POSTINGS).groupBy("bucket").applyInPandas(_lists, "hub long, id long").distinct())
    # long lists are cut into pairs of blocks
    long = land(lists.groupBy(F.col("hub").alias("l_hub")).count().where(F.col("count") > listed).select(
        "l_hub", F.ceil(F.col("count") / listed).cast("int").alias("l_blocks")))
    cut = lists.join(small(long), F.col("hub") == F.col("l_hub"), "left").withColumn("blocks", F.coalesce("l_blocks", F.lit(1)))
    cut = cut.join(sets, "id").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = max(64, lists.count() // BUCKET_LISTED)
    cut = cut.select("hub", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "id", "n_shingles", "sketch")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hub", "i", "j", "n_shingles", "id"])
        place, ids = pdf[["hub", "i", "j"]].to_numpy(), pdf["id"].to_numpy()
        begins = np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1)])
        side = np.where(place[:, 1] == place[:, 2], -1, pdf["mine"].to_numpy())
        roots = alike(np.cumsum(begins), pdf["n_shingles"].to_numpy(), pdf["sketch"].tolist(), num, den, side)
        pair = np.unique(np.stack([ids[roots], ids])[:, ids[roots] != ids], axis=1)
        return pd.DataFrame({"a": pair[0], "b": pair[1]})
    bucket = F.pmod(F.xxhash64("hub", "i", "j"), F.lit(groups)).cast("int")
    return components(land(cut.groupBy(bucket.alias("bucket")).applyInPandas(compare, "a long, b long").distinct()))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90,
                       den: int = 100, group_shingles: int = GROUP_SHINGLES, listed: int = LISTED) -> DataFrame:
    """One row per input row: id, n_shingles, component (least id reachable by
    links of similarity ``num / den`` or more)."""
    ids = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = land(set_table(ids, "_id", "_text", k))
    known = rows.where("n_shingles > 0 and _id is not null")
    classes = land(known.groupBy("n_shingles", "h1", "h2").agg(F.min("_id").alias("rep"), F.count("*").alias("copies")))
    reps = classes.select(F.col("rep").alias("id"), "n_shingles")
    represents = (known["n_shingles"] == classes["n_shingles"]) & (known["h1"] == classes["h1"]) & (
        known["h2"] == classes["h2"])
    copies = land(known.join(classes.where("copies > 1"), represents).groupBy(F.col("_id").alias("id")).agg(
        F.max(F.col("_id") == F.col("rep")).alias("is_rep")).where("not is_rep").select("id").join(
        reps.select("id"), "id", "left_anti"))
    sketches = known.dropDuplicates(["_id", "n_shingles", "h1", "h2"]).select(F.col("_id").alias("id"), "n_shingles", "sketch")
    near = land(_candidates(reps, copies, ids, sketches, k, num, den, listed))
    # component sizes in set elements decide into how many blocks a component is cut
    weights = near.join(reps, "id").groupBy("root").agg(F.sum("n_shingles").alias("w"))
    cut = F.greatest(F.lit(1), F.ceil(F.col("w") / (group_shingles / 2)) - F.when(
        F.col("w") <= group_shingles, 1).otherwise(0)).cast("int")
    member = land(near.join(weights.select("root", cut.alias("blocks")), "root").select(
        F.col("id").alias("m_id"), "root", "blocks"))
    text = ids.join(small(member), F.col("_id") == F.col("m_id")).select("m_id", "root", "blocks", "_text")

    def to_sets(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["m_id"], "root": pdf["root"], "blocks": pdf["blocks"],
                                "u": [shingle_set(t, k).tobytes() for t in pdf["_text"]]})
    sets = text.mapInPandas(to_sets, "id long, root long, blocks int, u binary")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    sets = sets.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["id", "u"]).sort_values("id", kind="stable")
        found = [np.frombuffer(u, np.uint64) for u in pdf["u"]]
        names = pdf["id"].tolist()
        across = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        roots = linked(found, num, den, pdf["mine"].to_numpy() if across else None)
        pairs = [(names[r], names[x]) for x, r in enumerate(roots) if r != x and names[r] != names[x]]
        return pd.DataFrame(pairs, columns=["a", "b"]).astype("int64")
    links = land(sets.groupBy("root", "i", "j").applyInPandas(verify, "a long, b long"))
    joined = land(components(links)) if links.limit(1).count() else links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    # rows of a class follow its representative; classes of one unlinked row need no look-up
    of_class = land(classes.join(joined, classes["rep"] == joined["id"], "left").where("copies > 1 or root is not null").select(
        F.col("n_shingles").alias("c_n"), F.col("h1").alias("c_h1"), F.col("h2").alias("c_h2"),
        F.coalesce("root", "rep").alias("component")))
    out = rows.join(small(of_class), (F.col("n_shingles") == F.col("c_n")) & (F.col("h1") == F.col("c_h1")) & (
        F.col("h2") == F.col("c_h2")) & F.col("_id").isNotNull(), "left")
    return out.select(F.col("_id").alias(id_col), "n_shingles", F.coalesce("component", "_id").alias("component_id"))


def _text_hash(c):
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80,
                         den: int = 100) -> DataFrame:
    """``df`` with one document (the least id) of each component; all columns stay.
    A document is an id with a text: rows with both equal become one, rows of one
    id with other texts are documents of their own."""
    ids = df.select(F.col(f"`{id_col}`").cast("long").alias("_i"), F.col(f"`{text_col}`").alias("_t"))
    repeated = land(ids.where("_i is not null").groupBy(F.col("_i").alias("_ri")).count().where("count > 1").select("_ri"))
    if not repeated.limit(1).count():
        found = land(jaccard_components(ids, "_i", "_t", k, num, den))
        gone = land(found.where("_i <> component_id").select("_i").distinct())
        return df.join(small(gone), F.col(f"`{id_col}`").cast("long") == F.col("_i"), "left_anti").select(*all_columns(df))
    # documents of repeated ids get keys of their own below all ids
    base = min(0, ids.agg(F.min("_i")).first()[0] or 0) - 1
    own = land(ids.join(small(repeated), F.col("_i") == F.col("_ri")).select(F.col("_i").alias("_oi"), _text_hash(F.col("_t")).alias("_oh")).distinct())
    own = land(own.select("*", (F.lit(base) - F.monotonically_increasing_id()).alias("_key")))
    keyed = ids.withColumn("_h", _text_hash(F.col("_t"))).join(small(own), (F.col("_i") == F.col("_oi")) & (F.col("_h") == F.col("_oh")), "left")
    found = land(jaccard_components(keyed.select(F.coalesce("_key", "_i").alias("_i"), "_t"), "_i", "_t", k, num, den))
    named = found.where("_i is not null").select("_i", "component_id", "n_shingles").distinct().join(
        own.select(F.col("_key"), F.col("_oi")), F.col("_i") == F.col("_key"), "left")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.coalesce("_oi", "_i").alias("id"), F.col("_i").alias("key"))).getField("key").alias("first"))
    gone = land(named.join(first, "component_id").where("_i <> first").select(F.col("_i").alias("gone")))
    ids_gone = gone.join(own, gone["gone"] == own["_key"], "left_anti").select("gone")
    texts_gone = own.join(gone, own["_key"] == gone["gone"]).select("_oi", "_oh")
    here = F.col(f"`{id_col}`").cast("long")
    once = df.join(small(land(ids_gone)), here == F.col("gone"), "left_anti").join(small(repeated), here == F.col("_ri"), "left_anti")
    again = df.join(small(repeated), here == F.col("_ri"), "left_semi").join(
        small(land(texts_gone)), (here == F.col("_oi")) & (_text_hash(F.col(f"`{text_col}`")) == F.col("_oh")), "left_anti")
    return once.select(*all_columns(df)).unionByName(again.select(*all_columns(df)).dropDuplicates([id_col, text_col]))


@register("op8_jaccard_join", """WITH RECURSIVE split AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+') if x <> ''] AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM split),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) ON x = doc_id""")
def op8_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
