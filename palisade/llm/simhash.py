"""SimHash near-duplicates by a segment-popcount embedding and a grid range join.

Fingerprint: 64 bits over word shingles, a bit being 1 if more than half of the
shingles' XXH64 values (seed 42, UTF-8) have it.

Embedding: a fingerprint is cut into 32 segments of two bits, and each segment
is mapped to its number of ones.  The Manhattan distance of two such vectors
never exceeds the Hamming distance of the fingerprints.  The counts 0, 1, 2 are
stored as 00, 01, 11, so that this distance is the bit count of an exclusive or.

Grid range join: with radius r the 32 counts are dealt to b blocks, b > r; two
vectors within distance r agree in b - r blocks at least.  Every choice of b - r
blocks is a grid, whose cells are the counts in them, and every fingerprint is in
one cell of each grid.  The number of blocks follows from the number of distinct
fingerprints, so that a cell of evenly spread ones holds ``cell_goal`` at most,
however many there are; it decides what is tested, not what is found.  Cells meet
in Spark partitions sorted by cell; pairs of a cell are tested first by Manhattan
distance, then exactly.  No cell gives all its pairs: from each partition come
only the edges of a spanning forest.  A cell with more than ``cell_rows`` rows is
dealt to several groups by pairs of salts.

Components come from ``connected_components`` over distinct fingerprints.

Edge cases: texts that are null or without a word have fingerprint zero and are
linked like others; texts shorter than a shingle have one shingle of all their
words; a very long text is hashed in parts; equal rows get equal results; a null
id keeps its row, and is a component's name only where all its ids are null;
other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, staged, text_slices, utf8_list
from .components import connected_components

SEED = 42
SEGMENTS = 32
SHINGLES_AT_ONCE = 1 << 15
FINGERPRINTS_AT_ONCE = 1 << 14
PAIRS_AT_ONCE = 1 << 21
#: In cells with more rows, neighbours are searched one at a time among those not yet reached.
SMALL_CELL = 192


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text (A-Z lower-cased), as an unsigned 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    begins = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    hash_ = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        to = at + SHINGLES_AT_ONCE
        h = np.array([hash_(joined[b:e], SEED) for b, e in zip(begins[at:to], stops[at:to], strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id, fp (bigint with the fingerprint's bits)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                fp = np.array([fingerprint(t, shingle) for t in utf8_list(part.column(text_col))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def grids(radius: int, distinct: int, cell_goal: int = 32) -> np.ndarray:
    """A mask of the segments of each grid, for so many distinct fingerprints."""
    for blocks in range(radius + 2, min(SEGMENTS, radius + 8) + 1):
        if distinct <= cell_goal * 2.0 ** (1.5 * SEGMENTS * (blocks - radius) / blocks):
            break
    parts = np.array_split(np.arange(SEGMENTS), blocks)
    masks = [sum(3 << 2 * int(s) for part in chosen for s in part) for chosen in combinations(parts, blocks - radius)]
    return np.array(masks, np.uint64)


def grid_cells(reps: DataFrame, radius: int, cell_rows: int, distinct: int) -> DataFrame:
    """(group, fp): who meets in which cell; large cells are split by pairs of salts."""
    masks = grids(radius, distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), FINGERPRINTS_AT_ONCE):
                fp = fps[at : at + FINGERPRINTS_AT_ONCE]
                emb = _thermometer(fp.view(np.uint64))
                cells = [mix64((emb & mask) ^ mix64(np.uint64([k + 1]))) for k, mask in enumerate(masks)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.tile(fp, len(masks)))], names=["cell", "fp"])

    cells = reps.select("fp").mapInArrow(run, "cell long, fp long")
    if distinct <= cell_rows:  # then no cell can hold more
        return cells.withColumnRenamed("cell", "group")
    large = cells.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("salts"))
    # At most one row for each cell_rows rows of cells; AQE broadcasts it only while it is small.
    dealt = cells.join(large, "cell", "left")
    salt = F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))).cast("int")
    partners = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    pairs = F.transform(partners, lambda p: F.least(p, F.col("salt")).cast("long") * (1 << 31) + F.greatest(p, F.col("salt")))
    dealt = dealt.withColumn("salt", salt).select("fp", "cell", F.explode(pairs).alias("pair"))
    return dealt.select(F.xxhash64("cell", "pair").alias("group"), "fp")  # groups that share a hash only test more pairs


def _thermometer(fp: np.ndarray) -> np.ndarray:
    even = np.uint64(0x5555555555555555)
    above = fp >> np.uint64(1)
    return ((fp | above) & even) | ((fp & above & even) << np.uint64(1))


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The embedding: for every two bits 00, 01 or 11, as 0, 1 or 2 of them are ones."""
    return _thermometer(fp)


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Indices of pairs within ``radius``: Manhattan bound first, then exactly."""
    maybe = np.flatnonzero(np.bitwise_count(_thermometer(a) ^ _thermometer(b)) <= radius)
    return maybe[np.bitwise_count(a[maybe] ^ b[maybe]) <= radius]


class Forest:
    """Union-find over the fingerprints that are linked to others in a partition."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> pa.RecordBatch:
        nodes = [x for x in self.parent if self.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.find(x) for x in nodes], pa.int64())], names=["a", "b"])


def _link_large(fp: np.ndarray, radius: int, forest: Forest) -> None:
    """Search from one fingerprint to the next; those reached leave the pool."""
    pool = np.unique(fp)
    while len(pool):
        todo, pool = [pool[-1]], pool[:-1]
        while todo and len(pool):
            x = todo.pop()
            near = np.bitwise_count(_thermometer(pool) ^ _thermometer(x)) <= radius
            near &= np.bitwise_count(pool ^ x) <= radius
            if near.any():
                got = pool[near]
                pool = pool[~near]
                for y in got.view(np.int64).tolist():
                    forest.link(int(x.view(np.int64)), y)
                todo.extend(got)


def _link_small(group: np.ndarray, fp: np.ndarray, radius: int, forest: Forest) -> None:
    """All cells of few rows at once: each row with the rows after it in its cell."""
    after = np.searchsorted(group, group, side="right") - np.arange(len(group)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, side="right")) - 1)
        left = np.repeat(np.arange(at, to), after[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[at:to] - total[at], after[at:to])
        a, b = fp[left], fp[right]
        hit = _close(a, b, radius)
        if len(hit):
            pairs = np.unique(np.stack([a[hit].view(np.int64), b[hit].view(np.int64)], axis=1), axis=0)
            for x, y in pairs.tolist():
                forest.link(x, y)
        at = to


def link_cells(cells: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links found in each partition."""

    def work(group: np.ndarray, fp: np.ndarray, forest: Forest) -> None:
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(starts, len(group)))
        for s, n in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL], strict=True):
            _link_large(fp[s : s + n], radius, forest)
        small = np.repeat(sizes <= SMALL_CELL, sizes)
        _link_small(group[small], fp[small], radius, forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = (batch.column("group").to_numpy(), batch.column("fp").to_numpy().view(np.uint64))
            if new[0][0] == new[0][-1]:  # perhaps the middle of a cell
                if held and held[-1][0][-1] != new[0][0]:
                    work(*map(np.concatenate, zip(*held, strict=True)), forest)
                    held = []
                held.append(new)
                continue
            cut = int(np.searchsorted(new[0], new[0][-1]))
            held.append(tuple(x[:cut] for x in new))
            work(*map(np.concatenate, zip(*held, strict=True)), forest)
            held = [tuple(x[cut:] for x in new)]
        if held:
            work(*map(np.concatenate, zip(*held, strict=True)), forest)
        yield forest.edges()

    return cells.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    radius: int = 4,
    cell_rows: int = 20_000,
) -> DataFrame:
    """id, fp, component_id (smallest id reachable over links of at most ``radius`` bits)."""
    rows = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = staged(rows.groupBy("fp").agg(F.min(id_col).alias("rep")), "distinct")
    edges = link_cells(grid_cells(reps, radius, cell_rows, reps.count()), radius)
    roots = connected_components(edges)
    rooted = reps.join(roots.select(F.col("id").alias("fp"), "component"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")
