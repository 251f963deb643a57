"""Operator 6: secret scan with multipart credential linking.

Base patterns (``assign``, ``access``, ``hex``) are reported wherever they
match. Weak candidates (identifiers, high-entropy secrets, endpoints) alone
would flag clean text, so they are reported only when a complementary part lies
in the same scope: at most ``SCOPE`` characters away in the same document, and
disjoint from it (one string is not two parts). A run inside the host or path of an
endpoint is part of that address and no secret candidate; user information, query
and fragment can hold one. An address is seldom a secret itself: an endpoint needs both
an identifier and a secret in its scope, unless it carries user and password. The
co-occurrence test is an interval join: every part is listed under the bins
its span covers, every weak candidate looks into the bins of its scope, and a
left-semi join on (document, bin) with the exact distance keeps those that find
a partner. A pair is never emitted, and a bin holds a bounded number of spans.

Native expressions only. Positions come from the lengths of the matches and of
the gaps between them, summed by a window per document, so no text is shuffled.
A document is identified by its id and a 64-bit hash of its text.

Defined results: null text is scanned as empty; documents without matches have
zero counts and empty ``spans``; repeated rows get equal results; overlapping
kinds are all reported; other columns are ignored by ``scan`` and kept by
``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravis.llm.common import BROADCAST_ROWS, all_columns, land, table
from gravis.llm.registry import register

SCOPE = 200  # characters between complementary parts, at most
MASK = "[SECRET]"
# Kind, pattern, group whose length counts, its least length, role, what the whole match must
# also match. The first three are the base kinds, reported alone.
KINDS = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     1, 8, "secret", None),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, "identifier", None),
    ("hex", r"[0-9a-f]+", 0, 32, "secret", None),
    ("ident", r"""(?i:(?:client|account|user|tenant|key|app)[_-]?(?:id|name))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""",
     1, 4, "identifier", None),
    ("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", 0, 20, "secret",
     r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"),
    ("endpoint", r"""\b[A-Za-z][A-Za-z0-9+.-]{1,9}://[^\s"'<>]+""", 0, 8, "endpoint", None),
)
BASE = 3
OPAQUE, ENDPOINT = 4, 5
# Of an endpoint: what comes before its host, and everything up to its query or fragment.
_BEFORE_HOST, _TO_PATH = r"^[^:]+://[^/?#]*@", r"^[^?#]*"
_CREDENTIALS = r"^[^:]+://[^/?#@:]+:[^/?#@]+@"  # an endpoint with user and password
COMPLEMENT = {"secret": ("identifier", "endpoint"), "identifier": ("secret",)}  # an endpoint needs one of each


def _matches(text: Column, rank: int) -> Column:
    """Per match, in order: (characters before it since the last match, its length,
    long enough, where an endpoint's host and path begin and end in it, whether it
    carries credentials). Only texts with a match are taken apart."""
    place = lambda m, p: F.length(F.regexp_extract(m, p, 0)) if rank == ENDPOINT else F.lit(0)
    _, pat, group, least, _, extra = KINDS[rank]
    p = F.lit(pat)
    found = F.regexp_extract_all(text, p, F.lit(0))
    counted = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    gaps = F.split(text, pat, -1)
    body = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))),
                      counted, lambda x, c: F.struct(
                          x["gap"].alias("gap"), F.length(x["m"]).alias("n"),
                          ((F.length(c) >= least) & (x["m"].rlike(extra) if extra else F.lit(True))).alias("ok"),
                          place(x["m"], _BEFORE_HOST).alias("lo"), place(x["m"], _TO_PATH).alias("hi"),
                          (x["m"].rlike(_CREDENTIALS) if rank == ENDPOINT else F.lit(False)).alias("own")))
    # for plain runs only a long enough run makes a text worth taking apart
    probe = {"hex": "[0-9a-f]{%d}" % least, "access": "AKIA[A-Z0-9]{%d}" % (least - 4)}.get(KINDS[rank][0], pat)
    return F.when(text.rlike(probe), F.filter(body, lambda x: x["n"].isNotNull()))


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Distinct (id, text hash, kind rank, start, end) of every reported span;
    ``df`` is scanned once."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.select("_id", F.xxhash64(text).alias("_h"), *[_matches(text, k).alias(f"k{k}") for k in range(len(KINDS))])
    some = [F.col(f"k{k}").isNotNull() for k in range(len(KINDS))]
    hit = some[0]
    for s in some[1:]:
        hit = hit | s
    return _linked(land(rows.where(hit)).dropDuplicates(["_id", "_h"]))


def _linked(rows: DataFrame) -> DataFrame:
    none = F.array().cast("array<struct<gap:int,n:int,ok:boolean,lo:int,hi:int,own:boolean>>")

    def of_kind(k: int) -> Column:
        return F.transform(F.coalesce(F.col(f"k{k}"), none), lambda x, i: F.struct(
            F.lit(k).alias("k"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["ok"].alias("ok"),
            x["lo"].alias("lo"), x["hi"].alias("hi"), x["own"].alias("own")))
    each = F.flatten(F.array(*[of_kind(k) for k in range(len(KINDS))]))
    m = rows.select("_id", "_h", F.explode(each).alias("x")).select("_id", "_h", "x.*")
    order = W.partitionBy("_id", "_h", "k").orderBy("i")
    end = F.sum(F.col("gap").cast("long") + F.col("n")).over(order)
    m = land(m.select("_id", "_h", "k", (end - F.col("n")).alias("start"), end.alias("end"), "ok", "lo", "hi", "own").where("ok").drop("ok"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))
    same = F.col("_id").eqNullSafe(F.col("p_id")) & (F.col("_h") == F.col("p_h")) & (F.col("bin") == F.col("p_bin"))
    lo, hi = F.col("start") + F.col("lo"), F.col("start") + F.col("hi")
    address = m.where((F.col("k") == ENDPOINT) & (lo < hi)).select(
        F.col("_id").alias("p_id"), F.col("_h").alias("p_h"), lo.alias("p_start"), hi.alias("p_end"), bins(lo, hi).alias("p_bin"))
    opaque = m.where(F.col("k") == OPAQUE).withColumn("bin", F.floor(F.col("start") / SCOPE)).join(
        address, same & (F.col("p_start") <= F.col("start")) & (F.col("end") <= F.col("p_end")), "left_anti")
    key = ["_id", "_h", "k", "start", "end"]
    m = land(m.where(F.col("k") != OPAQUE).select(*key, "own").unionByName(opaque.select(*key, "own")))
    base, weak = m.where(F.col("k") < BASE), m.where(F.col("k") >= BASE)
    role = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (k, kind[4])])
    needs = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*[F.lit(r) for r in x])
                           for k, kind in enumerate(KINDS) if kind[4] in COMPLEMENT for x in (k, COMPLEMENT[kind[4]])])
    parts = m.select(F.col("_id").alias("p_id"), F.col("_h").alias("p_h"), role[F.col("k")].alias("p_role"),
                     F.col("start").alias("p_start"), F.col("end").alias("p_end"), bins(F.col("start"), F.col("end")).alias("p_bin"))
    # a weak span over a base span repeats it
    weak = weak.withColumn("bin", bins(F.col("start"), F.col("end")))
    over = weak.join(base.select(F.col("_id").alias("p_id"), F.col("_h").alias("p_h"), F.col("start").alias("p_start"),
                                 F.col("end").alias("p_end"),
                                 bins(F.col("start"), F.col("end")).alias("p_bin")),
                     same & (F.col("p_start") < F.col("end")) & (F.col("start") < F.col("p_end")), "left_semi")
    covered = over.select(*key).distinct()
    cond = F.lit(True)
    for c in key:
        cond = cond & F.col(f"w.{c}").eqNullSafe(F.col(f"o.{c}"))
    fresh = weak.select(*key, "own").distinct().alias("w").join(covered.alias("o"), cond, "left_anti").select("w.*")
    look = fresh.withColumn("bin", bins(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE))
    near = same & (F.col("p_start") <= F.col("end") + SCOPE) & (F.col("p_end") >= F.col("start") - SCOPE) & (
        (F.col("p_end") <= F.col("start")) | (F.col("p_start") >= F.col("end")))
    with_part = lambda rows, role: rows.join(parts, near & role, "left_semi").select(*key).distinct()
    linked = with_part(look.where(F.col("k") != ENDPOINT), F.array_contains(needs[F.col("k")], F.col("p_role")))
    ends = look.where((F.col("k") == ENDPOINT) & ~F.col("own"))
    ends = with_part(ends, F.col("p_role") == "secret").intersect(with_part(ends, F.col("p_role") == "identifier"))
    return base.select(*key).unionByName(linked).unionByName(ends).unionByName(fresh.where("own").select(*key))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of the base kinds, digest, all spans."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    listed = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(
        ":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))))
    per_doc = spans(df, id_col, text_col).groupBy("_id", "_h").agg(
        F.sort_array(F.collect_list(F.struct("start", "k", "end"))).alias("s"))  # bounded by one text's length
    per_doc = per_doc.select(F.col("_id").alias("s_id"), F.col("_h").alias("s_h"), "s")
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"))
    s = F.coalesce(F.col("s"), F.array().cast("array<struct<start:bigint,k:int,end:bigint>>"))
    joined = rows.join(per_doc, F.col("_id").eqNullSafe(F.col("s_id")) & (F.col("_h") == F.col("s_h")), "left")
    count = lambda k: F.size(F.filter(s, lambda x: x["k"] == k)).cast("long")
    return joined.select(F.col("_id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"),
                         count(2).alias("n_hex"),
                         F.sha2(listed(F.filter(s, lambda x: x["k"] < BASE)), 256).alias("base_sha256"),
                         listed(s).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = MASK) -> DataFrame:
    """``df`` with every reported span replaced by ``mask`` (overlapping spans by
    one); all columns stay, ``n_chars`` follows the text."""
    found = spans(df, id_col, text_col)
    by_doc = W.partitionBy("_id", "_h").orderBy("start", "end")
    reach = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))  # what earlier spans reach
    merged = found.withColumn("new", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    merged = merged.withColumn("run", F.sum("new").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    merged = merged.groupBy("_id", "_h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    prev = F.lag("end", 1, 0).over(W.partitionBy("_id", "_h").orderBy("start"))
    merged = merged.withColumn("prev", prev).groupBy("_id", "_h").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "prev"))).alias("s"))
    g_id, g_h, g_s = ("g" * max(map(len, df.columns)) + x for x in ("_id", "_h", "_s"))  # longer than any column's name
    merged = land(merged.select(F.col("_id").alias(g_id), F.col("_h").alias(g_h), F.col("s").alias(g_s)))
    n_spans = merged.agg(F.sum(F.size(g_s))).first()[0] or 0  # three numbers each
    merged = F.broadcast(merged) if n_spans <= BROADCAST_ROWS else merged
    text_hash = F.xxhash64(F.coalesce(df[text_col], F.lit("")))
    joined = df.join(merged, df[id_col].eqNullSafe(merged[g_id]) & (text_hash == merged[g_h]), "left")
    t, s = df[text_col], F.col(g_s)
    cut = lambda a, b: F.substr(t, (a + 1).cast("int"), (b - a).cast("int"))
    clean = F.concat(F.array_join(F.transform(s, lambda x: F.concat(cut(x["prev"], x["start"]), F.lit(mask))), ""),
                     F.substr(t, (F.element_at(s, -1)["end"] + 1).cast("int"), F.length(t)))
    out = joined.withColumn(text_col, F.when(s.isNull(), t).otherwise(clean))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(s.isNull(), F.col("n_chars")).otherwise(
            F.length(F.col(text_col)).cast(df.schema["n_chars"].dataType)))
    return out.select(*all_columns(df))


@register("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
