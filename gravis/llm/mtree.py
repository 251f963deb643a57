"""Operator 2: exact top-k inner products by M-tree best-first search.

Inner products become distances by one more component: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x,
so the nearest vectors are those with the highest product.

Equal vectors are one tree entry with their ``k + 1`` smallest ids (no other id
can be among a query's ``k`` best), which is found by a window with a partial
limit, so a vector that a third of all rows share costs nothing. Distinct
vectors go to their nearest routing vector (a bounded sample of
``MAX_ROUTES``), and each route is dealt by hash over as many trees as its
count needs; a tree holds about ``TREE_ROWS`` vectors. A tree's pages carry for
every entry the covering radius and the distance to the parent.

A query first searches one tree of its nearest route, which gives it a k-th
best score. A route whose ball cannot reach that score is skipped; in the
others trees are searched best-first, and stored bounds
|d(q, parent) - d(entry, parent)| - radius avoid computing distances. Queries
meet a tree in blocks of about ``QUERY_BLOCK``. Scores are exact integers;
bounds are floating point and give way by a safe margin.

Defined results: null vectors and those with null or non-finite components
take no part, nor do null ids; rows with the same id are the same row (a query
never finds its own id); only vectors of a query's length are compared; ties
go to smaller ids; other columns are ignored.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gravis.llm.common import land, table
from gravis.llm.registry import register

K = 5
TREE_ROWS = 4096  # distinct vectors a tree holds, about
MAX_ROUTES = 256  # routing vectors, at most
PAGE = 256  # entries of a page, at most
QUERY_BLOCK = 1024  # queries that meet a tree at once, about


class MTree:
    """Pages: centre, radius and parent distance of every node; a leaf page's
    rows lie together in ``x``, with their distances to the leaf's centre."""

    def __init__(self, x: np.ndarray, extra: np.ndarray, page: int = PAGE):
        self.x, self.extra = x.astype(np.float64), extra
        self.page = page
        self.nodes: list[tuple[int, float, float, list[int], int, int]] = []  # row, radius, to parent, children, from, to
        self.order: list[int] = []
        self.leaf_dist: list[float] = []
        rows = np.arange(len(x))
        centre = int(rows[np.argmin(self._from_mean(rows))]) if len(x) else 0
        self.root = self._build(rows, centre, 0.0) if len(x) else -1
        self.order = np.array(self.order, np.int64)
        self.leaf_dist = np.array(self.leaf_dist)

    def _from_mean(self, rows):
        c = self.x[rows].mean(axis=0)
        return ((self.x[rows] - c) ** 2).sum(axis=1)

    def dist(self, rows, centre: int) -> np.ndarray:
        d = self.x[rows] - self.x[centre]
        return np.sqrt((d * d).sum(axis=1) + (self.extra[rows] - self.extra[centre]) ** 2)

    def _build(self, rows: np.ndarray, centre: int, to_parent: float) -> int:
        d = self.dist(rows, centre)
        radius = float(d.max())
        me = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= self.page:
            start = len(self.order)
            self.order.extend(rows.tolist())
            self.leaf_dist.extend(d.tolist())
            self.nodes[me] = (centre, radius, to_parent, [], start, start + len(rows))
            return me
        fan = min(self.page, -(-len(rows) // self.page) + 1)
        seeds, near = [int(rows[np.argmax(d)])], None  # farthest-first
        near = self.dist(rows, seeds[0])
        owner = np.zeros(len(rows), np.int64)
        while len(seeds) < fan and near.max() > 0:
            far = int(np.argmax(near))
            dd = self.dist(rows, int(rows[far]))
            owner[dd < near] = len(seeds)
            near = np.minimum(near, dd)
            seeds.append(int(rows[far]))
        sizes = np.bincount(owner, minlength=len(seeds))
        parts = [(s, rows[owner == i]) for i, s in enumerate(seeds)] if sizes.max() <= 0.9 * len(rows) else [
            (int(p[0]), p) for p in np.array_split(rows[np.argsort(d, kind="stable")], fan)]
        children = [self._build(p, s, float(self.dist(np.array([s]), centre)[0])) for s, p in parts if len(p)]
        self.nodes[me] = (centre, radius, to_parent, children, 0, 0)
        return me

    def dump(self) -> bytes:
        children = [c for n in self.nodes for c in n[3]]
        counts = [len(n[3]) for n in self.nodes]
        out = io.BytesIO()
        np.savez(out, x=self.x, extra=self.extra, order=self.order, leaf_dist=self.leaf_dist,
                 centre=np.array([n[0] for n in self.nodes], np.int64),
                 bounds=np.array([n[1:3] for n in self.nodes], np.float64).reshape(-1, 2),
                 span=np.array([n[4:6] for n in self.nodes], np.int64).reshape(-1, 2),
                 children=np.array(children, np.int64), counts=np.array(counts, np.int64))
        return out.getvalue()


class Search:
    """Best-first search of a dumped tree. ``ids[row]`` are the smallest ids of a row."""

    def __init__(self, dumped: bytes, ids: list):
        z = np.load(io.BytesIO(dumped))
        self.x, self.order, self.leaf_dist, self.centre = z["x"], z["order"], z["leaf_dist"], z["centre"]
        self.extra = z["extra"]
        self.radius, self.to_parent = z["bounds"].T
        self.span, self.ids = z["span"], ids
        ends = np.cumsum(z["counts"])
        self.children = [z["children"][e - c:e] for e, c in zip(ends, z["counts"])]
        self.top = np.abs(self.x).max(initial=0.0)
        self.leaf = self.x[self.order]  # page rows side by side
        self.nodes = self.x[self.centre]

    def products(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.top * np.abs(q).max(initial=0.0) * max(len(q), 1) < 2.0 ** 53:
            return x @ q  # every partial sum is an exact double
        return (x.astype(object) * q.astype(object)).sum(axis=1) if len(q) else np.zeros(len(x))

    def best(self, q: np.ndarray, own: int, m2: float, k: int, least=None) -> list[tuple[int, int]]:
        """(score, id) of the k best other ids, none below ``least``."""
        if not len(self.x):
            return []
        q2 = float(q @ q)
        slack = 1e-9 * (q2 + m2) + 1e-6
        found: list[tuple[int, int]] = []  # heap of (score, -id)
        floor = -np.inf if least is None else float(least)

        def far(score: float) -> float:
            """The distance beyond which no vector has ``score``."""
            return np.sqrt(max(q2 + m2 - 2 * score, 0.0) + slack) + 1e-6 if score > -np.inf else np.inf

        reach = far(floor)
        d0 = float(np.sqrt(max(q2 + m2 - 2 * float(self.products(self.nodes[:1], q)[0]), 0.0)))
        heap = [(max(d0 - self.radius[0], 0.0), 0, d0)]
        while heap:
            low, node, d = heapq.heappop(heap)
            if low > reach:
                break
            kids = self.children[node]
            if len(kids):
                # the parent distance alone rules some out
                kids = kids[np.abs(d - self.to_parent[kids]) - self.radius[kids] <= reach]
                if len(kids):
                    dk = np.sqrt(np.maximum(q2 + m2 - 2 * self.products(self.nodes[kids], q).astype(float), 0.0))
                    lows = np.maximum(dk - self.radius[kids], 0.0)
                    for lo, kid, dd in zip(lows.tolist(), kids.tolist(), dk.tolist()):
                        if lo <= reach:
                            heapq.heappush(heap, (lo, kid, dd))
                continue
            a, b = self.span[node]
            rows = a + np.flatnonzero(np.abs(d - self.leaf_dist[a:b]) <= reach)
            if not len(rows):
                continue
            scores = self.products(self.leaf[rows], q)
            for i in np.flatnonzero(scores >= floor):
                s = int(scores[i])
                for other in self.ids[self.order[rows[i]]]:
                    if other == own:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, (s, -other))
                    elif (s, -other) > found[0]:
                        heapq.heapreplace(found, (s, -other))
                if len(found) == k and found[0][0] > floor:
                    floor = found[0][0]
                    reach = far(floor)
        return [(s, -o) for s, o in found]


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float = 256.0) -> DataFrame:
    """Distinct (id, v, dim) of usable vectors, v = floor(scale * x)."""
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.forall(
        vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.where(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vec_col).alias("dim")).distinct()


def _matrix(column, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in column], np.int64).reshape(-1, dim)


def build_index(vectors: DataFrame, k: int = K, tree_rows: int = TREE_ROWS):
    """(routes on the driver, trees landed, largest squared norm). ``routes`` are
    at most ``MAX_ROUTES`` rows: dim, route, vector, radius, trees."""
    by_vector = W.partitionBy("v").orderBy("id")
    entries = vectors.withColumn("r", F.row_number().over(by_vector)).where(F.col("r") <= k + 1).groupBy("dim", "v").agg(
        F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 at most
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    entries = land(entries.withColumn("n2", norm))
    n, m2 = entries.agg(F.count("*"), F.max("n2")).first()
    if not n:
        return [], None, 0.0
    count = min(MAX_ROUTES, -(-n // tree_rows))
    picked = entries.select("dim", "v").orderBy(F.xxhash64("v"), "v").limit(count).collect()  # bounded sample
    dims = {r["dim"] for r in entries.select("dim").distinct().limit(MAX_ROUTES).collect()}
    seeds = [(r["dim"], list(r["v"])) for r in picked]
    seeds += [(d, [0] * d) for d in sorted(dims - {d for d, _ in seeds})]
    routed = land(_route(entries.select("dim", "ids", "v", "n2"), seeds, m2))
    shape = {r["route"]: (r["n"], r["radius"]) for r in routed.groupBy("route").agg(
        F.count("*").alias("n"), F.max("d").alias("radius")).collect()}  # a row per route
    routes = [(i, d, v, shape[i][1], -(-shape[i][0] // tree_rows)) for i, (d, v) in enumerate(seeds) if i in shape]
    trees_of = F.create_map(*[F.lit(x) for r in routes for x in (r[0], r[4])])
    dealt = routed.withColumn("tree", F.pmod(F.xxhash64("v"), trees_of[F.col("route")]).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        x = _matrix(pdf["v"], dim)
        extra = np.sqrt(np.maximum(m2 - pdf["n2"].to_numpy(float), 0.0))
        ids = [[int(i) for i in v] for v in pdf["ids"]]
        return pd.DataFrame({"route": [int(pdf["route"].iloc[0])], "tree": [int(pdf["tree"].iloc[0])],
                             "pages": [MTree(x, extra).dump()], "ids": [ids]})
    trees = land(dealt.groupBy("route", "tree").applyInPandas(
        build, "route int, tree int, pages binary, ids array<array<long>>"))
    return routes, trees, float(m2)


def _route(df: DataFrame, seeds, m2: float) -> DataFrame:
    """Rows (with dim, v, n2) and their nearest route and its distance ``d``."""
    own = {}
    for i, (dim, v) in enumerate(seeds):
        own.setdefault(dim, []).append((i, v))

    def run(batches):
        table_ = {d: (np.array([i for i, _ in x], np.int32), np.array([v for _, v in x], float).reshape(len(x), d))
                  for d, x in own.items()}
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                names, c = table_[int(dim)]
                x = _matrix(part["v"], int(dim)).astype(float)
                a = np.sqrt(np.maximum(m2 - part["n2"].to_numpy(float), 0.0))
                ca = np.sqrt(np.maximum(m2 - (c * c).sum(axis=1), 0.0))
                d2 = (x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T) + (a[:, None] - ca[None]) ** 2
                best = d2.argmin(axis=1)
                exact = np.sqrt(((x - c[best]) ** 2).sum(1) + (a - ca[best]) ** 2)
                yield part.assign(route=names[best], d=exact)
    return df.mapInPandas(run, df.schema.simpleString()[7:-1] + ", route int, d double")


def _searched(asked: DataFrame, trees: DataFrame, m2: float, k: int) -> DataFrame:
    """Best of every asked (id, v, least, route, tree, block): query_id, vec_id, score."""
    needed = asked.select(F.col("route").alias("to_route"), F.col("tree").alias("to_tree"),
                          F.col("block").alias("to_block")).distinct()
    held = needed.join(trees, (F.col("to_route") == trees["route"]) & (F.col("to_tree") == trees["tree"])).select(
        "to_route", "to_tree", "to_block", "pages", "ids")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            s = Search(bytes(right["pages"].iloc[0]), [list(map(int, i)) for i in right["ids"].iloc[0]])
            for own, v, least in zip(left["id"], left["v"], left["least"]):
                q = np.asarray(v, np.int64).astype(float)
                for score, other in s.best(q, int(own), m2, k, None if pd.isna(least) else int(least)):
                    rows.append((int(own), other, score))
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")
    return asked.groupBy("route", "tree", "block").cogroup(held.groupBy("to_route", "to_tree", "to_block")).applyInPandas(
        run, "query_id long, vec_id long, score long")


def top_k(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = K, tree_rows: int = TREE_ROWS) -> DataFrame:
    """The ``k`` best rows of ``df`` for each row of ``queries`` (same columns):
    query_id, rank, vec_id, score."""
    spark = df.sparkSession
    routes, trees, m2 = build_index(whole_vectors(df, id_col, vec_col), k, tree_rows)
    if not routes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked = whole_vectors(queries, id_col, vec_col)
    asked = asked.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def home(batches):  # the route whose ball promises the most
        for pdf in batches:
            out = []
            for dim, v in zip(pdf["dim"], pdf["v"]):
                q = np.asarray(v, float)
                near = [(float(((q - np.array(c, float)) ** 2).sum()), i) for i, d, c, _, _ in routes if d == dim]
                out.append(min(near)[1] if near else None)
            pdf["route"] = pd.array(out, "Int32")
            yield pdf
    first = asked.mapInPandas(home, asked.schema.simpleString()[7:-1] + ", route int").where("route is not null")
    trees_of = F.create_map(*[F.lit(x) for r in routes for x in (r[0], r[4])])
    first = first.withColumn("tree", F.pmod(F.xxhash64("v"), trees_of[F.col("route")]).cast("int"))
    first = land(first.withColumn("least", F.lit(None).cast("long")))
    at_home = land(_searched(first, trees, m2, k))
    least = at_home.groupBy("query_id").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    known = first.drop("least").join(least, F.col("id") == F.col("query_id"), "left").withColumn(
        "least", F.when(F.col("n") >= k, F.col("worst")))

    def reached(batches):  # every other tree of every route whose ball may hold something as good
        for pdf in batches:
            rows = []
            for own, v, dim, route, tree, block, least_ in zip(
                    pdf["id"], pdf["v"], pdf["dim"], pdf["route"], pdf["tree"], pdf["block"], pdf["least"]):
                q = np.asarray(v, float)
                q2 = float(q @ q)
                far = np.inf if pd.isna(least_) else np.sqrt(max(q2 + m2 - 2.0 * least_, 0.0) + 1e-9 * (q2 + m2) + 1e-6) + 1e-6
                for i, d, c, radius, n in routes:
                    if d != dim:
                        continue
                    c = np.array(c, float)
                    dist = np.sqrt(((q - c) ** 2).sum() + max(m2 - float(c @ c), 0.0))
                    if dist - radius <= far:
                        rows += [(own, v, least_, i, t, block) for t in range(n) if (i, t) != (route, tree)]
            out = pd.DataFrame(rows, columns=["id", "v", "least", "route", "tree", "block"])
            out["least"] = out["least"].astype("Int64")
            yield out
    rest = known.select("id", "v", "dim", "route", "tree", "block", "least").mapInPandas(
        reached, "id long, v array<bigint>, least long, route int, tree int, block int")
    found = at_home.unionByName(_searched(rest, trees, m2, k))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@register("op2_mtree_top_k", """WITH usable AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if isfinite(x)]) = len(embedding)),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5""")
def op2_mtree_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding")
