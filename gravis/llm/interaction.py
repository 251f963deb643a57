"""Operator 11: filter interaction audit, by exact constrained least squares.

Every document gets one bit per filter it fails. Per part, one table holds how
many documents each coalition of filters removes (a document goes if it fails any
filter of the coalition). Differences of two coalitions are the step counts of
every order of the filters. The Shapley value of a filter is the solution of the
least-squares problem with Shapley kernel weights under the condition that all
shares add up to what all filters together remove; its normal equations are
solved in rationals, once for all coalition columns because the matrix is the same
for every part, and the solution is applied to each part's table in whole numbers.

Filters: A under 200 words; B under half of the words different; C over 2 % of the
code points in A-Z; D any of ``#$%&*|``; E the same text as a row of smaller id,
table-wide.

Defined results: null text is empty (and equal to the empty text), null part is
the empty string, a row without id is never a later copy and makes none, equal
rows (id included) are no copies of each other, an id with several label rows
counts as good or toxic if one of them says so, labels without id are ignored. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravis.llm.common import UPPER, land, table
from gravis.llm.registry import register

FILTERS = "ABCDE"
# Fixed values of the filters.
MIN_WORDS, MIN_DISTINCT_PCT, MAX_UPPER_PCT, SYMBOLS = 200, 50, 2, b"#$%&*|"
COPY = FILTERS.index("E")

_UPPER = UPPER.encode()
_INNER = bytes(range(0x80, 0xC0))  # all bytes of a code point but its first


def text_failures(data: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = data.split()  # on space and tab to carriage return, as bytes do
    upper = len(data) - len(data.translate(None, _UPPER))
    points = len(data.translate(None, _INNER))
    return ((len(words) < MIN_WORDS)
            | (100 * len(set(words)) < MIN_DISTINCT_PCT * len(words)) << 1
            | (100 * upper > MAX_UPPER_PCT * points) << 2
            | (len(data.translate(None, SYMBOLS)) < len(data)) << 3)


def solve_shares(players: int) -> list[list[Fraction]]:
    """``c[i][S]`` such that the share of player i is the sum of c[i][S] * value(S)
    over all coalitions (bit sets) S, value(empty) = 0: the kernel-weighted least
    squares fit of value(S) by the sum of S's shares, the shares adding up to
    value(all). Gauss-Jordan elimination of the normal equations with the
    multiplier of that condition, one right-hand side per coalition."""
    n, everyone = players, (1 << players) - 1
    weight = {s: Fraction(n - 1, math.comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count()))
              for s in range(1, everyone)}
    rows = []
    for i in range(n):
        left = [sum((w for s, w in weight.items() if s >> i & s >> j & 1), Fraction(0)) for j in range(n)]
        right = [weight.get(s, Fraction(0)) if s >> i & 1 else Fraction(0) for s in range(everyone + 1)]
        rows.append(left + [Fraction(1)] + right)
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(s == everyone) for s in range(everyone + 1)])
    for col in range(n + 1):
        pivot = next(r for r in range(col, n + 1) if rows[r][col])
        rows[col], rows[pivot] = rows[pivot], rows[col]
        rows[col] = [x / rows[col][col] for x in rows[col]]
        for r in range(n + 1):
            if r != col and rows[r][col]:
                f = rows[r][col]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[col])]
    return [row[n + 1:] for row in rows[:n]]


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(_id, part, bits, n): number of rows per id, part and failed filters.

    Texts are read once and leave as 32-byte digests. The first id of a digest is
    met by (digest, id), so a group of copies is spread over tasks, and equal
    (id, part, text) rows are counted before they are moved."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary()).to_pylist()
            texts = [t or b"" for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(text_failures, texts), pa.int32()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["_id", "part", "bits", "h"])
    picked = docs.select(F.col(f"`{id_col}`").alias("_id"),
                         F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    digests = land(picked.mapInArrow(run, f"_id {kind}, part string, bits int, h binary")
                   .groupBy("h", "_id", "part", "bits").agg(F.count(F.lit(1)).alias("n")))
    first = digests.where("_id is not null").groupBy("h").agg(F.min("_id").alias("first"))
    met = digests.join(first.withColumnRenamed("h", "fh"), (F.col("h") == F.col("fh")) & (F.col("_id") == F.col("first")), "left")
    later = F.col("_id").isNotNull() & F.col("first").isNull()
    return met.select("_id", "part", (F.col("bits") + F.when(later, 1 << COPY).otherwise(0)).alias("bits"), "n")


def coalition_removals(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id", players: int = len(FILTERS)) -> DataFrame:
    """Per part: total, and by coalition (position = bit set) the documents ``r``,
    good ones ``g`` and toxic ones ``t`` that it removes."""
    marks = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("lid")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"))
    by_id = failed.groupBy("_id", "part", "bits").agg(F.sum("n").alias("n"))
    marked = by_id.join(marks, F.col("_id") == F.col("lid"), "left")
    cells = marked.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("bad", F.lit(0))).alias("bad"))
    listed = cells.groupBy("part").agg(F.sum("n").alias("total"), F.collect_list(F.struct("bits", "n", "good", "bad")).alias("cells"))

    def removed(field: str):
        def of(coalition):
            return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, x: acc + F.when(
                x["bits"].bitwiseAND(coalition) != 0, x[field]).otherwise(F.lit(0)))
        return F.transform(F.sequence(F.lit(0), F.lit((1 << players) - 1)), of)
    return listed.select("part", "total", removed("n").alias("r"), removed("good").alias("g"), removed("bad").alias("t"))


def audit(removals: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Every part, order of the filters and step, with the counts of the module's
    docstring; ``shapley`` is the share times the number of orders, a whole number."""
    n = len(filters)
    orders = ["".join(p) for p in itertools.permutations(filters)]
    shares = []
    for row in solve_shares(n):
        whole = [c * len(orders) for c in row]
        if any(c.denominator != 1 for c in whole):
            raise ValueError("a share is no whole number of orders")
        shares.append(sum((F.lit(int(c)) * F.col("r")[s] for s, c in enumerate(whole) if c), F.lit(0).cast("long")))
    steps = removals.select("part", "total", "r", "g", "t", F.array(*shares).alias("shares"),
                            F.explode(F.array(*[F.lit(o) for o in orders])).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    place = F.instr(F.lit(filters), F.substr("filter_order", F.col("step"), F.lit(1))) - 1
    before = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda acc, i: acc + F.when(
        i < F.col("step"), F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), F.substr("filter_order", i, F.lit(1))) - 1)).otherwise(0))
    steps = steps.select("*", place.alias("f"), before.alias("before")).withColumn(
        "bit", F.call_function("shiftleft", F.lit(1), F.col("f"))).withColumn("after", F.col("before") + F.col("bit"))

    def gain(c: str):
        return F.col(c)[F.col("after")] - F.col(c)[F.col("before")]
    everyone = F.lit((1 << n) - 1)
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - F.col("r")[F.col("after")]).alias("kept"), gain("r").alias("removed"),
        (F.col("r")[F.col("bit")] - gain("r")).alias("redundant"),
        (F.col("r")[everyone] - F.col("r")[everyone - F.col("bit")]).alias("unique_fails"),
        gain("g").alias("good_lost"), gain("t").alias("toxic_lost"), F.col("shares")[F.col("f")].alias("shapley"))


SQL = f"""WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, part, CASE WHEN len(w) < {MIN_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < {MIN_DISTINCT_PCT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_UPPER_PCT} * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[{SYMBOLS.decode()}]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
      FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(bad, 0)) AS bad
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(x, bit)),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
      FROM f p, f q, f r, f s, f u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND p.bit | q.bit | r.bit | s.bit | u.bit = 31),
st AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS before
       FROM o, (SELECT CAST(range AS INTEGER) AS step FROM range(1, 6))),
x AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
         sum(n) FILTER (WHERE mask & CAST(before + bit AS INTEGER) = 0) AS kept,
         sum(n) FILTER (WHERE mask & CAST(before AS INTEGER) = 0 AND mask & bit <> 0) AS removed,
         sum(n) FILTER (WHERE mask & CAST(before AS INTEGER) <> 0 AND mask & bit <> 0) AS redundant,
         sum(n) FILTER (WHERE mask = bit) AS unique_fails,
         sum(good) FILTER (WHERE mask & CAST(before AS INTEGER) = 0 AND mask & bit <> 0) AS good_lost,
         sum(bad) FILTER (WHERE mask & CAST(before AS INTEGER) = 0 AND mask & bit <> 0) AS toxic_lost
  FROM c, st GROUP BY part, filter_order, step)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({k}, 0) AS BIGINT) AS {k}" for k in (
    "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x"""


@register("op11_filter_interaction", SQL)
def op11_filter_interaction(spark, sf_dir):
    failed = failures(table(spark, sf_dir, "documents"))
    return audit(coalition_removals(failed, table(spark, sf_dir, "labels")))
