"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers, floor(scale * x).  To search inner products in a
metric space, a candidate x of a tree gets one more component,
sqrt(M^2 - |x|^2), M being the tree's largest norm, and a query gets 0 there:
then d(q, x)^2 = |q|^2 + M^2 - 2 q.x, and the nearest candidates are those with
the largest inner products.

Index: candidates are cut into cells, by their norm (a factor of 4 each) and by
the nearest direction of a bounded sample of ``pivots`` vectors.  A cell's
candidates are dealt by hash to groups of about ``tree_rows``, and each group
becomes one M-tree: pages of at most ``page`` entries; a routing entry has a
covering radius, and every entry the distance to its parent.  The trees are
written to the shared folder.

Search: a query first visits the most promising cell, which gives it a bound,
then the other cells whose ball may hold something as good.  Queries go to the
trees: a tree is shuffled once for every ``share_rows`` queries that visit it, and
queries stream by it.  In a tree, nodes are taken best first, and entries ruled
out by |d(q, parent) - d(entry, parent)| and their radius are never computed.
Bounds have slack for rounding; scores are exact integers.

Edge cases: vectors that are null or hold null or non-finite components (before
or after scaling) take no part; shorter vectors, also empty ones, count as
padded with zeros; null ids take part and come last among equal scores; rows
that share an id are separate queries and candidates, and a query leaves out its
own row only; equal scores go to the smaller id; scores beyond a bigint are
ranked exactly and shown as the nearest bigint; an empty table, or fewer
candidates than k, gives what there is.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Cells have squared norms within a factor of 2^BAND.
BAND = 4
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query long, query_id long, vec_id long, high decimal(38,0), score long"


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int, asked: Column) -> DataFrame:
    """row (a number of its own), id, v (integers as doubles), asked: the vectors that take part."""
    scaled = lambda x: F.col(x).cast("double") * scale if isinstance(x, str) else x.cast("double") * scale
    finite = lambda x: F.coalesce(F.abs(scaled(x)) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double"))
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))  # noqa: E731  # beyond 2^52 doubles are integers
    fine = rows.where(F.col(vec_col).isNotNull() & F.forall(F.col(vec_col), finite))
    return fine.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(vec_col, whole).alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))


def matrix(lists: list, dim: int) -> np.ndarray:
    """Rows of equal length, padded with zeros."""
    out = np.zeros((len(lists), dim))
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def dots(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Exact integer inner products: through doubles or 64 bits where they can't round."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, rows.shape[1])
    if bound < 1 << 52:
        return (rows @ query).astype(np.int64).tolist()
    if bound < 1 << 62:
        return (rows.astype(np.int64) @ query.astype(np.int64)).tolist()
    q = [int(x) for x in query.tolist()]
    return [sum(int(x) * y for x, y in zip(r, q, strict=True)) for r in rows.tolist()]


def norms(v: np.ndarray) -> np.ndarray:
    return (v * v).sum(axis=1)


def bands(squares: np.ndarray) -> np.ndarray:
    """Class of a squared norm; zero vectors have their own."""
    return np.where(squares > 0, np.floor(np.log2(np.maximum(squares, 1)) / BAND), -1).astype(np.int32)


def augmented(v: np.ndarray, largest: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(largest - norms(v), 0))[:, None]])


def slack(square: float, largest: float) -> float:
    """More than rounding can do to a distance between vectors of these squared norms."""
    return 1e-6 * (1 + np.sqrt(square + largest))


class MTree:
    """Metric tree over augmented vectors, bulk loaded."""

    def __init__(self, rows: np.ndarray, ids: list[int | None], vectors: np.ndarray, page: int, seed: int = 7):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.largest = float(norms(vectors).max(initial=0))
        self.points = augmented(vectors, self.largest)
        self.random, self.page = np.random.default_rng(seed), page
        #: Each node: (is leaf, places of its entries, distances to the parent, radii, children).
        self.nodes: list[tuple] = []
        self.root = self._load(np.arange(len(rows)), None)
        del self.random

    def _far(self, at: np.ndarray, center: int | None) -> np.ndarray:
        return np.zeros(len(at)) if center is None else np.linalg.norm(self.points[at] - self.points[center], axis=1)

    def _load(self, at: np.ndarray, parent: int | None) -> int:
        if len(at) <= self.page:
            self.nodes.append((True, at, self._far(at, parent), np.zeros(len(at)), None))
            return len(self.nodes) - 1
        ways = min(self.page, -(-len(at) // self.page))
        seeds = self.random.choice(at, max(2, ways), replace=False)
        p = self.points[at]
        far = (norms(p)[:, None] - 2 * p @ self.points[seeds].T + norms(self.points[seeds])).argmin(axis=1)
        if np.bincount(far, minlength=len(seeds)).max() == len(at):  # equal points: deal them out
            far = np.arange(len(at)) % len(seeds)
        centers, radii, children = [], [], []
        for j, s in enumerate(seeds):
            mine = at[far == j]
            if len(mine):
                centers.append(s)
                radii.append(self._far(mine, s).max())
                children.append(self._load(mine, s))
        centers = np.array(centers)
        self.nodes.append((False, centers, self._far(centers, parent), np.array(radii), children))
        return len(self.nodes) - 1

    def search(self, own: int, query: np.ndarray, k: int, least: int | None) -> list[tuple[int, int | None]]:
        """The k best (score, id) of scores of at least ``least``, by score, then smaller id, null ids last."""
        square = float(query @ query)
        point = np.append(query, 0.0)
        spare = slack(square, self.largest)
        reach = lambda score: np.sqrt(max(square + self.largest - 2.0 * score, 0)) + spare
        best: list[tuple] = []  # heap of (score, has an id, -id)
        limit = np.inf if least is None else reach(least)
        queue = [(0.0, self.root, None)]
        while queue:
            near, node, to_parent = heapq.heappop(queue)
            if near > limit:
                break
            leaf, at, parents, radii, children = self.nodes[node]
            may = np.arange(len(at)) if to_parent is None else np.flatnonzero(np.abs(to_parent - parents) - radii <= limit + spare)
            if not len(may):
                continue
            if leaf:
                mine = at[may]
                for s, j in zip(dots(self.vectors[mine], query), mine.tolist(), strict=True):
                    if (least is not None and s < least) or self.rows[j] == own:
                        continue
                    i = self.ids[j]
                    entry = (s, i is not None, -(i or 0))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                if len(best) == k:
                    limit = min(limit, reach(best[0][0]))
            else:
                d = np.linalg.norm(self.points[at[may]] - point, axis=1)
                for j, x in zip(may.tolist(), d.tolist(), strict=True):
                    if (low := max(x - radii[j], 0.0)) <= limit:
                        heapq.heappush(queue, (low, children[j], x))
        return [(s, -i if known else None) for s, known, i in best]


class Cells:
    """Centres, radii and largest squared norms of the cells: at most ``pivots`` for each class of norms."""

    def __init__(self, band: np.ndarray, pivot: np.ndarray, radius: np.ndarray, largest: np.ndarray, directions: np.ndarray):
        self.band, self.pivot, self.radius, self.largest = band, pivot, radius, largest
        self.centers = np.stack([cell_center(directions[p], m) for p, m in zip(pivot, largest, strict=True)]) if len(pivot) else np.zeros((0, directions.shape[1] + 1))

    def lows(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and cell: the least distance to a candidate, and the largest inner product that it allows."""
        squares = norms(q)[:, None]
        point = np.hstack([q, np.zeros((len(q), 1))])
        d = np.sqrt(np.maximum(squares - 2 * point @ self.centers.T + norms(self.centers), 0))
        low = np.maximum(d - self.radius - 1e-6 * (1 + np.sqrt(squares + self.largest)), 0)
        return low, (squares + self.largest - low * low) / 2


def cell_center(direction: np.ndarray, largest: float) -> np.ndarray:
    """A cell's pivot direction on the sphere of its augmented candidates."""
    return np.append(direction * np.sqrt(largest), 0.0)


def top_inner_products(
    rows: DataFrame,
    asked: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    pivots: int = 64,
    tree_rows: int = 8192,
    page: int = 64,
    share_rows: int = 32_768,
) -> DataFrame:
    """query_id, rank (from 1), id, score of the k best candidates of every row for which ``asked`` is true."""
    spark = rows.sparkSession
    data = staged(integer_vectors(rows, id_col, vec_col, scale, asked), "vectors")
    dim = max(1, data.agg(F.max(F.size("v")).alias("dim")).first().dim or 1)
    sample = data.orderBy(F.xxhash64("row"), "row").limit(pivots).collect()  # a bounded sample
    result = f"query_id long, rank int, `{id_col}` long, score long"
    if not sample:
        return spark.createDataFrame([], result)
    directions = matrix([r.v for r in sample], dim)
    directions = directions / np.maximum(np.sqrt(norms(directions)), 1e-300)[:, None]

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v").to_pylist(), dim)
            pivot = (v @ directions.T).argmax(axis=1) if len(v) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("v"), pa.array(bands(norms(v))), pa.array(pivot.astype(np.int32))], names=["row", "id", "v", "band", "pivot"])

    placed = staged(data.select("row", "id", "v").mapInArrow(homes, "row long, id long, v array<double>, band int, pivot int"), "homes")
    parts = placed.groupBy("band", "pivot").agg(F.ceil(F.count("*") / tree_rows).alias("parts"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(x) else int(x) for x in group["id"]]
        tree = MTree(group["row"].to_numpy(), ids, matrix(group["v"].tolist(), dim), page)
        center = cell_center(directions[group["pivot"].iloc[0]], tree.largest)
        radius = np.linalg.norm(tree.points - center, axis=1).max()
        return pd.DataFrame({"band": group["band"].iloc[:1], "pivot": group["pivot"].iloc[:1], "part": group["part"].iloc[:1], "largest": [tree.largest], "radius": [radius], "tree": [pickle.dumps(tree)]})

    dealt = placed.join(F.broadcast(parts), ["band", "pivot"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))  # a row for each cell
    dealt = dealt.withColumn("id", F.col("id").cast("string"))  # pandas would round a null's neighbours
    trees = staged(dealt.groupBy("band", "pivot", "part").applyInPandas(build, "band int, pivot int, part long, largest double, radius double, tree binary"), "trees")
    # Trees of a cell have centres of their own length; the cell's ball holds them all.
    balls = trees.groupBy("band", "pivot").agg(F.max("largest").alias("largest"), F.max("radius").alias("radius"), F.min("largest").alias("smallest")).collect()
    largest, smallest = np.array([r.largest for r in balls]), np.array([r.smallest for r in balls])
    # A point moves by at most 2 sqrt(M^2 - m^2) when its tree's M = m is replaced by the cell's M.
    radius = np.array([r.radius for r in balls]) + 2 * np.sqrt(np.maximum(largest - smallest, 0))
    cells = Cells(np.array([r.band for r in balls], np.int32), np.array([r.pivot for r in balls], np.int32), radius, largest, directions)
    sent = spark.sparkContext.broadcast(cells)  # at most pivots x classes of norms

    ask = "row long, id long, v array<double>, least decimal(38,0), home int, band int, pivot int"

    def visits(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        for batch in batches:
            q = matrix(batch.column("v").to_pylist(), dim)
            low, most = cells.lows(q)
            if first:
                of, cell = np.arange(len(q)), most.argmax(axis=1) if len(q) else np.zeros(0, np.int64)
                home = cell
            else:
                least, home = batch.column("least").to_pylist(), batch.column("home").to_numpy()
                bound = np.array([-np.inf if x is None else float(x) for x in least])
                reach = np.sqrt(np.maximum(norms(q)[:, None] + cells.largest - 2.0 * bound[:, None], 0))
                may = low <= reach + 1e-6 * (1 + np.sqrt(norms(q)[:, None] + cells.largest))
                may[np.arange(len(q)), home] = False
                of, cell = np.nonzero(may)
                home = home[of]
            taken = batch.take(pa.array(of))
            columns = [taken.column("row"), taken.column("id"), taken.column("v"), taken.column("least"), pa.array(home.astype(np.int32)), pa.array(cells.band[cell]), pa.array(cells.pivot[cell])]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "v", "least", "home", "band", "pivot"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: MTree | None = None
        for batch in batches:
            out: list[tuple] = []
            blobs, rows_, ids, vs, leasts = (batch.column(c).to_pylist() for c in ("tree", "row", "id", "v", "least"))
            for blob, row, i, v, least in zip(blobs, rows_, ids, vs, leasts, strict=True):
                if blob is not None:  # the queries of a tree follow it
                    tree = pickle.loads(blob)
                    continue
                found = tree.search(row, matrix([v], dim)[0], k, None if least is None else int(least))
                out += [(row, i, x, min(max(s, -(10**38) + 1), 10**38 - 1), min(max(s, LEAST), MOST)) for s, x in found]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(map(_decimal, x)) if k_ == kinds[3] else list(x), k_) for x, k_ in zip(columns, kinds, strict=True)], names=["query", "query_id", "vec_id", "high", "score"])

    def met(queries: DataFrame) -> DataFrame:
        """Scores of queries (row, id, v, least, band, pivot) in all trees of their cells."""
        queries = staged(queries, "visits")
        loads = queries.groupBy("band", "pivot").agg(F.ceil(F.count("*") / share_rows).alias("shares"))
        held = trees.join(F.broadcast(loads), ["band", "pivot"])  # a row for each cell
        held = held.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        none = lambda kind: F.lit(None).cast(kind)
        sides = held.select("band", "pivot", "part", "share", "tree", none("long").alias("row"), none("long").alias("id"), none("array<double>").alias("v"), none("decimal(38,0)").alias("least"))
        asked_ = queries.join(F.broadcast(loads), ["band", "pivot"]).join(F.broadcast(parts), ["band", "pivot"])
        asked_ = asked_.withColumn("share", F.pmod(F.xxhash64("row"), F.col("shares"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        both = sides.unionByName(asked_.select("band", "pivot", "part", "share", none("binary").alias("tree"), "row", "id", "v", "least"))
        streamed = both.repartition("band", "pivot", "part", "share").sortWithinPartitions("band", "pivot", "part", "share", F.col("tree").isNull())
        return streamed.select("tree", "row", "id", "v", "least").mapInArrow(search, FOUND)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("high"), F.asc_nulls_last("vec_id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    queries = data.where("asked").select("row", "id", "v", F.lit(None).cast("decimal(38,0)").alias("least"))
    begun = staged(queries.mapInArrow(lambda b: visits(b, True), ask), "queries")
    first = staged(best(met(begun)).drop("rank"), "first")
    bound = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("high")).alias("bound"))
    bounded = begun.join(bound, begun["row"] == bound["query"], "left").select("row", "id", "v", F.col("bound").alias("least"), "home")
    found = best(first.unionByName(met(bounded.mapInArrow(lambda b: visits(b, False), ask))))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(x)
