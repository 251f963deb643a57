"""Plain versions of the operators, for comparison on small tables."""

import collections
import hashlib
import html
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def base_statistics(text):
    t = text or ""
    w = WORD.findall(t)
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = collections.Counter(wins)
    covered = {p for i, x in enumerate(wins) if seen[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [s for s in t.split("\n") if WORD.search(s)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(1)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(k == i for _, k, _ in found) for i in range(3)], listed


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(zip(*[w[j:] for j in range(k)])) if len(w) >= k else frozenset([tuple(w)])


def jaccard_components(docs, k, num, den):
    """{id: (set size, least reachable id)} of (id, text) with distinct ids."""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    where = collections.defaultdict(list)
    for i, _ in docs:
        common = collections.Counter()
        for s in sets[i]:
            common.update(where[s])
            where[s].append(i)
        for j, n in common.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def top_products(vectors, every, k):
    """[(query, rank, id, score)] of {id: list or None}, queries by id % every."""
    usable = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in vectors.items()
              if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, x in usable.items():
        if q % every == 0:
            best = sorted((-int(x @ y), i) for i, y in usable.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def article(page):
    """Main text of the driver's pages: their one article element, inline tags dropped, block tags as spaces."""
    m = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    if not m:
        return ""
    inner = re.sub(r"</?(h1|p|br|b)\b[^>]*>", lambda t: "" if t.group(1) == "b" else " ", m.group(1))
    return " ".join(html.unescape(inner).split())


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def linked_secrets(text):
    """All spans of the secret scan, by comparing every pair of parts of a text."""
    from gravis.llm.credentials import KINDS, SCOPE
    parts = []  # kind, start, end, match
    for k, (_, pattern, group, least, _, extra) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least and (not extra or re.search(extra, m[0])):
                parts.append((k, m.start(), m.end(), m[0]))
    place = []  # host and path of the endpoints
    for k, a, b, m in parts:
        if KINDS[k][0] == "endpoint":
            user = re.match(r"[^:]+://[^/?#]*@", m)
            place.append((a + (user.end() if user else 0), a + re.match(r"[^?#]*", m).end()))
    parts = [p for p in parts if KINDS[p[0]][0] != "opaque" or not any(lo <= p[1] and p[2] <= hi for lo, hi in place)]
    out = []
    for k, a, b, m in parts:
        near = {KINDS[q][4] for q, c, d, _ in parts if c <= b + SCOPE and d >= a - SCOPE and (d <= a or c >= b)}
        role = KINDS[k][4]
        if k >= 3:
            if any(q < 3 and c < b and a < d for q, c, d, _ in parts):
                continue
            if role == "endpoint":
                good = {"secret", "identifier"} <= near or re.match(r"[^:]+://[^/?#@:]+:[^/?#@]+@", m)
            else:
                good = near & ({"secret"} if role == "identifier" else {"identifier", "endpoint"})
            if not good:
                continue
        out.append((a, k, b))
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in sorted(out))
