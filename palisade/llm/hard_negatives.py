"""Hard negatives by blocked dense matrix products.

Anchors are a stated query set; every usable row is a candidate.  Anchors are
dealt by hash to lots of about ``lot_bytes``; one lot at a time is broadcast, in
blocks, and meets all candidates, which stream by in blocks of their own (a
float64 GEMM for a pair of blocks, exact below 2^53; integers of 64 bits or
without a bound where a product could reach that).

Pass one keeps, for each anchor and task, the best ``positives`` rows of the
anchor's label; these short lists are merged by a rank whose group limit runs
before the shuffle.  Pass two, with the positives' scores in the broadcast
lot, keeps for each anchor, positive and task the best ``negatives`` rows of
other labels within the window ``low`` * p <= 100 * n <= ``high`` * p, and merges them
the same way.  What is shuffled does not depend on how many rows share a label
or a vector, and no group is collected: a task holds one block of candidates, one
block of scores and the short lists.

Edge cases: rows with a null label or a vector that is null or holds null or
non-finite components take no part; shorter vectors, also empty ones, count as
padded with zeros; equal scores go to the smaller id, null ids last; rows that
share an id are rows of their own, and an anchor leaves out its own row only; a
positive score below zero has an empty window; scores beyond a bigint count as
the nearest bigint; an anchor without positives, or a positive without negatives,
returns nothing; an empty table gives none.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged
from .vectors import blocks, integers, matrix, padded, products, usable

#: Rows of a block of anchors and of candidates: a block of scores has 8 MB.
ANCHORS, CANDIDATES = 512, 2048
#: Below this, a score and a place in its block fit one 64-bit number.
PACKED = 1 << 50
NONE = -(1 << 63)

POSITIVES = "a long, score long, id long, row long"
NEGATIVES = "a long, slot int, anchor_id long, positive_id long, positive_score long, score long, id long, row long"


class Lot:
    """A lot of anchors in order of label, and the scores of their positives (NONE where there is none)."""

    def __init__(self, table: pa.Table, positives: int):
        table = table.sort_by("label")
        self.row = table.column("row").to_numpy()
        self.ids = table.column("id").to_pylist()
        self.vectors = matrix(table.column("v"))
        labels = table.column("label").to_pylist()
        self.labels = sorted(set(labels))
        self.code = np.searchsorted(np.array(self.labels, object), np.array(labels, object)) if labels else np.zeros(0, np.int64)
        self.positive_score = np.full((len(labels), positives), NONE)
        self.positive_id = np.full((len(labels), positives), None, object)

    def add_positives(self, table: pa.Table) -> None:
        place = {int(r): i for i, r in enumerate(self.row)}
        for a, slot, score, found in zip(*(table.column(c).to_pylist() for c in ("a", "slot", "score", "id")), strict=True):
            self.positive_score[place[a], slot], self.positive_id[place[a], slot] = score, found

    def codes(self, labels: list[str]) -> np.ndarray:
        """The lot's number of each label, -1 for those that it lacks."""
        known = {x: i for i, x in enumerate(self.labels)}
        return np.array([known.get(x, -1) for x in labels], np.int64)


class Shortlists:
    """The best k candidates so far of each of n queries: higher scores, then smaller ids (null last), then rows."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), NONE)
        self.no_id = np.ones((n, k), bool)
        self.id, self.row = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def least(self, which: slice) -> np.ndarray:
        """The score that a new candidate must reach."""
        return self.score[which, -1]

    def offer(self, first: int, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, no_id: np.ndarray, rows: np.ndarray) -> None:
        """Scores of the queries from ``first`` with a block of candidates, in order of id; only those that fit count."""
        at = np.flatnonzero(fits.any(axis=1))
        if not len(at):
            return
        scores, fits = scores[at], fits[at]
        width = scores.shape[1]
        k = min(self.k, width)
        if np.abs(np.where(fits, scores, 0)).max() < PACKED:
            packed = np.where(fits, scores * width + (width - 1 - np.arange(width)), NONE)
            best = np.argpartition(packed, width - k, axis=1)[:, width - k :]
        else:
            best = np.argsort(-np.where(fits, scores, NONE + 1), axis=1, kind="stable")[:, :k]
        found = np.take_along_axis(fits, best, axis=1)
        new = (np.where(found, np.take_along_axis(scores, best, axis=1), NONE), np.where(found, no_id[best], True), ids[best], rows[best])
        held = (self.score, self.no_id, self.id, self.row)
        both = [np.hstack([x[first + at], y]) for x, y in zip(held, new, strict=True)]
        empty = both[0] == NONE
        order = np.lexsort((both[3], both[2], both[1], -np.where(empty, 0, both[0]), empty), axis=-1)[:, : self.k]
        for x, y in zip(held, both, strict=True):
            x[first + at] = np.take_along_axis(y, order, axis=1)


def _block(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, labels, ids, missing ids and row numbers of a block of candidates, in order of id."""
    ids = batch.column("id")
    no_id = ids.is_null().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    rows = batch.column("row").to_numpy(zero_copy_only=False)
    order = np.lexsort((rows, numbers, no_id))
    labels = batch.column("label").to_pylist()
    return padded(matrix(batch.column("v"), dim)[order], dim), [labels[i] for i in order], numbers[order], no_id[order], rows[order]


def _anchor_blocks(n: int) -> Iterator[slice]:
    for start in range(0, n, ANCHORS):
        yield slice(start, min(start + ANCHORS, n))


def _positives(lot: Lot, parts: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    best = Shortlists(len(lot.row), k)
    for batch in blocks(parts, CANDIDATES):
        vectors, labels, ids, no_id, rows = _block(batch, lot.vectors.shape[1])
        codes = lot.codes(labels)
        for code in np.unique(codes[codes >= 0]):
            mine = np.flatnonzero(codes == code)
            first, stop = np.searchsorted(lot.code, [code, code + 1])
            for part in _anchor_blocks(stop - first):
                at = slice(first + part.start, first + part.stop)
                scores = products(padded(lot.vectors[at], vectors.shape[1]), vectors[mine])
                fits = (scores >= best.least(at)[:, None]) & (lot.row[at, None] != rows[mine])
                best.offer(at.start, scores, fits, ids[mine], no_id[mine], rows[mine])
    i, j = np.nonzero(best.score != NONE)
    yield _rows(best, i, j, {"a": pa.array(lot.row[i], pa.int64())})


def _negatives(lot: Lot, parts: Iterator[pa.RecordBatch], k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    n, slots = lot.positive_score.shape
    have = lot.positive_score != NONE
    score = [[int(x) for x in row] for row in lot.positive_score.tolist()]
    bounds = np.array([[(-(-low * p // 100), high * p // 100) for p in row] for row in score], object).reshape(n, slots, 2)
    lower = np.where(have, bounds[:, :, 0], 1).astype(np.int64)
    upper = np.where(have, bounds[:, :, 1], 0).astype(np.int64)
    best = [Shortlists(n, k) for _ in range(slots)]
    for batch in blocks(parts, CANDIDATES):
        vectors, labels, ids, no_id, rows = _block(batch, lot.vectors.shape[1])
        codes = lot.codes(labels)
        for at in _anchor_blocks(n):
            scores = products(padded(lot.vectors[at], vectors.shape[1]), vectors)
            other = lot.code[at, None] != codes
            for slot in range(slots):
                least = np.maximum(lower[at, slot], best[slot].least(at))
                fits = (scores >= least[:, None]) & (scores <= upper[at, slot, None]) & other
                best[slot].offer(at.start, scores, fits, ids, no_id, rows)
    for slot in range(slots):
        i, j = np.nonzero(best[slot].score != NONE)
        more = {
            "a": pa.array(lot.row[i], pa.int64()),
            "slot": pa.array(np.full(len(i), slot), pa.int32()),
            "anchor_id": pa.array([lot.ids[x] for x in i], pa.int64()),
            "positive_id": pa.array(lot.positive_id[i, slot].tolist(), pa.int64()),
            "positive_score": pa.array(lot.positive_score[i, slot], pa.int64()),
        }
        yield _rows(best[slot], i, j, more)


def _rows(best: Shortlists, i: np.ndarray, j: np.ndarray, more: dict[str, pa.Array]) -> pa.RecordBatch:
    own = {"score": pa.array(best.score[i, j]), "id": pa.array(best.id[i, j], mask=best.no_id[i, j]), "row": pa.array(best.row[i, j])}
    return pa.RecordBatch.from_pydict(more | own)


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k of each group, with ``rank`` from 1; the limit on a rank also runs before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame,
    anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    lot_bytes: int = 32 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hard negatives of every anchor and positive.

    ``anchor`` tells the anchors, ``label`` is any type that casts to string; ``lot_bytes`` bounds what is broadcast at once.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    fine = rows.where(usable(vec_col) & label.isNotNull())
    numbered = fine.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        label.cast("string").alias("label"),
        integers(vec_col, scale).alias("v"),
        F.coalesce(anchor, F.lit(False)).alias("asked"),
    )
    candidates = staged(numbered, "vectors")
    asked = candidates.where("asked").drop("asked")
    size = asked.agg(F.sum(8 * F.size("v") + 100).alias("bytes")).first().bytes or 0
    lots = max(1, ceil(size / lot_bytes))
    dealt = asked.withColumn("lot", F.pmod(F.xxhash64("row"), F.lit(lots)).cast("int")).repartition(lots, "lot")
    anchors = staged(dealt, "anchors", by="lot")
    columns = candidates.select("row", "id", "label", "v")
    results = []
    for number in range(lots):  # each is one bounded broadcast and a pass over the candidates
        lot = Lot(anchors.where(F.col("lot") == number).drop("lot").toArrow(), positives)
        sent = context.broadcast(lot)
        found = columns.mapInArrow(lambda parts, sent=sent: _positives(sent.value, parts, positives), POSITIVES)
        lot.add_positives(_ranked(found, ["a"], positives).withColumn("slot", F.col("rank") - 1).toArrow())
        sent.unpersist()
        again = context.broadcast(lot)
        hard = columns.mapInArrow(lambda parts, sent=again: _negatives(sent.value, parts, negatives, low, high), NEGATIVES)
        results.append(staged(_ranked(hard, ["a", "slot"], negatives), "negatives"))
        again.unpersist()
    drop_staged(candidates)
    drop_staged(anchors)
    out = results[0]
    for more in results[1:]:
        out = out.union(more)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
