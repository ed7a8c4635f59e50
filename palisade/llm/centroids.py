"""Centroid clustering filtered by ball trees.

Vectors are cut into pieces of at most ``tree_rows``, and each piece becomes one ball
tree, built once in its task and written to the shared folder: nodes halve their
points along the line between two far points, and store a radius, a count and
an integer sum (the sum over the count is the ball's centre).

A round sends the centroids (``clusters`` times the dimension, nothing that grows)
to the trees.  From the root down, a ball of radius r drops every centroid whose
distance less r exceeds another's distance plus r, by the triangle inequality.
A ball with one centroid left gives it count and sum as a whole; the leaves of
the others compute exact distances to the centroids left.  A task returns one
sum for each centroid and component, in 48-bit limbs that can't overflow, and
Spark adds them up.  Nothing is shuffled but these sums.

Distances are exact: float64 below 2^53, else integers without a bound.  Bounds
have slack for rounding, so a ball is only assigned where no tie is possible.

Edge cases: vectors that are null, have another number of components, or hold
null or non-finite ones take no part; rows that share an id take part each, and
as first centroids they go by their vectors; null ids take part and are the last
choice as first centroids; with fewer vectors than clusters each one starts as
a centroid; equal distances go to the smaller number; an empty centroid stays
where it is; distances and inertias beyond a bigint count as the nearest bigint;
an empty table gives none.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged
from .vectors import EXACT, MOST, blocks, clipped, integers, largest, matrix, python_integers, usable

LIMB = 48
LIMBS = 3  # 144 bits: components have at most 136, counts are added by Spark as decimals
TREES = "ids array<long>, points binary, radii binary, counts binary, sums binary"
PARTIAL = "cluster int, place int, n long, limb0 long, limb1 long, limb2 long"
ASSIGNED = "id long, cluster int, distance long"


def _bounds(n: int, leaf: int) -> list[np.ndarray]:
    """Where the nodes of each level begin and end: level l has 2^l nodes, which halve those above."""
    depth = max(0, ceil(log2(n / leaf))) if n else 0
    return [(np.arange((1 << level) + 1, dtype=np.int64) * n) >> level for level in range(depth + 1)]


class BallTree:
    """The points of a piece in the order of its leaves, and radius, count and sum of every node, level by level."""

    def __init__(self, ids: list[int | None], points: np.ndarray, leaf: int):
        bounds = _bounds(len(points), leaf)
        order = np.arange(len(points))
        for level in bounds[:-1]:
            for start, stop in zip(level[:-1], level[1:], strict=True):
                order[start:stop] = _halved(points, order[start:stop])
        self.ids, self.points, self.bounds = [ids[i] for i in order], points[order], bounds
        whole = points[order].astype(np.int64) if largest(points) * max(1, len(points)) < EXACT else python_integers(points[order])
        self.counts = [np.diff(b) for b in bounds]
        lowest = np.add.reduceat(whole, bounds[-1][:-1], axis=0)
        self.sums = [lowest]
        for _ in bounds[:-1]:
            self.sums.insert(0, self.sums[0][0::2] + self.sums[0][1::2])
        self.radii = []
        for start, center in zip(bounds, self.centers(), strict=True):
            far = np.linalg.norm(self.points - np.repeat(center, np.diff(start), axis=0), axis=1)
            self.radii.append(np.maximum.reduceat(far, start[:-1]) * (1 + 1e-9))

    def centers(self) -> list[np.ndarray]:
        return [s.astype(float) / n[:, None] for s, n in zip(self.sums, self.counts, strict=True)]

    def row(self) -> dict:
        small = largest(self.points) < 1 << 31
        points = self.points.astype(np.int32 if small else float)
        plain = self.sums[0].dtype != object
        sums = np.concatenate(self.sums) if plain else np.zeros((0, 0))  # sums without a bound are made again
        return {
            "ids": self.ids,
            "points": (b"i" if small else b"d") + points.tobytes(),
            "radii": np.concatenate(self.radii).tobytes(),
            "counts": np.concatenate(self.counts).astype(np.int32).tobytes(),
            "sums": (b"q" + sums.tobytes()) if plain else b"",
        }

    @classmethod
    def of(cls, row: dict, dim: int, leaf: int) -> BallTree:
        tree = cls.__new__(cls)
        tree.ids = row["ids"]
        tree.bounds = _bounds(len(tree.ids), leaf)
        kind = np.int32 if row["points"][:1] == b"i" else float
        tree.points = np.frombuffer(row["points"], kind, offset=1).reshape(len(tree.ids), dim).astype(float)
        ends = np.cumsum([len(b) - 1 for b in tree.bounds])[:-1]
        tree.radii = np.split(np.frombuffer(row["radii"]), ends)
        tree.counts = np.split(np.frombuffer(row["counts"], np.int32), ends)
        if row["sums"]:
            tree.sums = np.split(np.frombuffer(row["sums"], np.int64, offset=1).reshape(-1, dim), ends)
        else:
            whole = python_integers(tree.points)
            tree.sums = [np.add.reduceat(whole, b[:-1], axis=0) for b in tree.bounds]
        return tree

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(level, node, centroid) of the balls that go to one centroid as a whole; ``left`` then has what the leaves must settle."""
        left = np.ones((1, len(centroids)), bool)
        for level, (center, radius) in enumerate(zip(self.centers(), self.radii, strict=True)):
            if level:
                left = np.repeat(left, 2, axis=0)
            open_ = np.flatnonzero(left.any(axis=1))
            far = np.stack([np.linalg.norm(center[open_] - c, axis=1) for c in centroids], axis=1)
            spare = 1e-9 * (far.max(axis=1) + radius[open_]) + 1e-6
            nearest = np.where(left[open_], far, np.inf).min(axis=1) + radius[open_]
            left[open_] &= far - radius[open_, None] <= (nearest + spare)[:, None]
            single = open_[left[open_].sum(axis=1) == 1]
            for node, found in zip(single.tolist(), left[single].argmax(axis=1).tolist(), strict=True):
                yield level, node, found
            left[single] = False
        self.left = left

    def settled(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the points in undecided leaves, and their nearest centroids."""
        size = np.diff(self.bounds[-1])
        which = np.flatnonzero(np.repeat(self.left.any(axis=1), size))
        if not len(which):
            return which, which
        allowed = np.repeat(self.left, size, axis=0)[which]
        far = squared_distances(self.points[which], centroids)
        if far.dtype == object:
            far = np.where(allowed, far, far.max() + 1)
        else:
            far = np.where(allowed, far, np.iinfo(np.int64).max)
        return which, far.argmin(axis=1)

    def clusters(self, centroids: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of every point."""
        out = np.zeros(len(self.ids), np.int32)
        for level, node, found in self.filtered(centroids):
            out[self.bounds[level][node] : self.bounds[level][node + 1]] = found
        which, nearest = self.settled(centroids)
        out[which] = nearest
        return out


def _halved(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same places, those on one side of the middle first."""
    p = points[at]
    one = p[((p - p.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    two = p[((p - one) ** 2).sum(axis=1).argmax()]
    return at[np.argpartition(p @ (two - one), len(at) // 2)]


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors (64-bit or Python integers)."""
    if 4 * max(largest(points), largest(centroids)) ** 2 * max(1, points.shape[1]) < EXACT:
        far = (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)
        return far.astype(np.int64)
    p, c = python_integers(points), python_integers(centroids)
    return np.stack([((p - x) ** 2).sum(axis=1) for x in c], axis=1)


def _floats(centroids: list[list[int]], dim: int) -> np.ndarray:
    return np.array(centroids, float).reshape(len(centroids), dim)


def _trees(parts: Iterator[pa.RecordBatch], leaf: int, tree_rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in blocks(parts, tree_rows):
        held.append(batch)
        if sum(b.num_rows for b in held) >= tree_rows:
            yield from _planted(held, leaf, tree_rows, schema)
            held = []
    if held:
        yield from _planted(held, leaf, tree_rows, schema)


def _planted(held: list[pa.RecordBatch], leaf: int, tree_rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    for start in range(0, table.num_rows, tree_rows):
        piece = table.slice(start, tree_rows)
        tree = BallTree(piece.column("id").to_pylist(), matrix(piece.column("v")), leaf)
        yield pa.RecordBatch.from_pylist([tree.row()], schema)


def _grown(parts: Iterator[pa.RecordBatch], dim: int, leaf: int) -> Iterator[BallTree]:
    for batch in parts:
        for row in batch.to_pylist():
            yield BallTree.of(row, dim, leaf)


def _sums(parts: Iterator[pa.RecordBatch], centroids: list[list[int]], dim: int, leaf: int) -> Iterator[pa.RecordBatch]:
    centers = _floats(centroids, dim)
    k = len(centers)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), object)
    for tree in _grown(parts, dim, leaf):
        for level, node, found in tree.filtered(centers):
            counts[found] += int(tree.counts[level][node])
            sums[found] += tree.sums[level][node].astype(object)
        which, nearest = tree.settled(centers)
        for found in np.unique(nearest):
            mine = tree.points[which[nearest == found]]
            counts[found] += len(mine)
            plain = largest(mine) * len(mine) < EXACT
            sums[found] += (mine.sum(axis=0).astype(np.int64) if plain else python_integers(mine).sum(axis=0)).astype(object)
    some = np.flatnonzero(counts)
    total = [int(x) for x in sums[some].ravel()]
    limbs = [[(x >> (LIMB * i)) & ((1 << LIMB) - 1) if i < LIMBS - 1 else x >> (LIMB * i) for x in total] for i in range(LIMBS)]
    fields = [np.repeat(some, dim).astype(np.int32), np.tile(np.arange(dim, dtype=np.int32), len(some)), np.repeat(counts[some], dim)]
    names = [f.split()[0] for f in PARTIAL.split(", ")]
    yield pa.RecordBatch.from_arrays([*map(pa.array, fields), *(pa.array(x, pa.int64()) for x in limbs)], names)


def _assigned(parts: Iterator[pa.RecordBatch], centroids: list[list[int]], dim: int, leaf: int) -> Iterator[pa.RecordBatch]:
    centers = _floats(centroids, dim)
    for tree in _grown(parts, dim, leaf):
        clusters = tree.clusters(centers)
        far = np.zeros(len(clusters), np.int64)
        for c in np.unique(clusters):
            mine = np.flatnonzero(clusters == c)
            found = squared_distances(tree.points[mine], centers[c : c + 1])[:, 0]
            far[mine] = clipped(found) if found.dtype == object else found
        yield pa.RecordBatch.from_pydict({"id": pa.array(tree.ids, pa.int64()), "cluster": pa.array(clusters), "distance": pa.array(far)})


def first_centroids(vectors: DataFrame, clusters: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest hexadecimal SHA-256 of ``seed:id``, in that order."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(mark.alias("mark"), "v").orderBy(F.asc_nulls_last("mark"), "v").limit(clusters)
    return [[int(x) for x in r.v] for r in first.collect()]  # `clusters` rows


def moved(trees: DataFrame, centroids: list[list[int]], dim: int, leaf: int) -> list[list[int]]:
    """One round: the centroids of what is nearest to each, componentwise floor(sum / count)."""
    partial = trees.mapInArrow(lambda parts: _sums(parts, centroids, dim, leaf), PARTIAL)
    limbs = [F.sum(F.col(f"limb{i}").cast("decimal(38,0)")).alias(f"limb{i}") for i in range(LIMBS)]
    out = [list(c) for c in centroids]
    for r in partial.groupBy("cluster", "place").agg(F.sum("n").alias("n"), *limbs).collect():  # clusters times components rows
        out[r.cluster][r.place] = sum(int(r[f"limb{i}"]) << (LIMB * i) for i in range(LIMBS)) // r.n
    return out


def cluster_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    dim: int = 64,
    scale: int = 256,
    clusters: int = 40,
    rounds: int = 5,
    seed: str = "2",
    tree_rows: int = 4096,
    leaf: int = 16,
) -> DataFrame:
    """Every vector's id, cluster, distance (squared), cluster_inertia, inertia and the centroid it ends with.

    ``clusters`` centroids are broadcast and come back once a round, so they bound
    what the driver holds; ``tree_rows`` bounds a tree, that is what a task holds.
    """
    spark = rows.sparkSession
    vectors = rows.where(usable(vec_col) & (F.size(vec_col) == dim)).select(F.col(id_col).cast("long").alias("id"), integers(vec_col, scale).alias("v"))
    centroids = first_centroids(vectors, clusters, seed)
    schema = pa.schema([("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("points", "radii", "counts", "sums"))])
    trees = staged(vectors.mapInArrow(lambda parts: _trees(parts, leaf, tree_rows, schema), TREES), "trees")
    for _ in range(rounds if centroids else 0):
        centroids = moved(trees, centroids, dim, leaf)
    found = staged(trees.mapInArrow(lambda parts: _assigned(parts, centroids, dim, leaf), ASSIGNED), "assigned")
    drop_staged(trees)
    summed = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(summed.alias("s")).collect()}  # `clusters` rows
    total = min(sum(inertia.values()), MOST)
    facts = [(c, min(s, MOST), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sorted(inertia.items())]
    small = spark.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(small), "cluster")  # `clusters` rows at most
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
