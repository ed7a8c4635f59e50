"""SimHash near-duplicates whose links are verified by exact similarity.

Two texts are linked if their sets of distinct shingles (A-Z lower-cased) have a
Jaccard similarity of 0.8 or more.  Sets of that similarity differ in about 15 %
of the bits of their SimHash; 64 bits tell that badly from 0.7, so that a single
radius either loses links or makes wrong ones.  Fingerprints here have 512 bits
and only search candidates:

1. Embedding: as in ``simhash``, two-bit segments are mapped to their numbers of
   ones, 256 counts.
2. Grids: each of ``tables`` grids takes some of the counts, drawn by a fixed
   seed; sets meet in a cell if all of these counts agree.  The number of counts
   grows with the logarithm of the number of sets, so cells don't grow with the
   data, and the number of grids follows from it for a recall of ``RECALL`` at
   similarity 0.8 (more above it).
3. Pairs of a cell are tested by their sizes and by 128 bits of the fingerprint.
4. Exact check: what is left is compared by the sets themselves, in rounds.  A
   round compares for each set the nearest partner that it is not yet connected
   with, and connects; the last round compares all pairs still not connected.

A cell in which very many pairs pass the test (a large group of near copies)
gives a forest of pairs in each round and all pairs at last, so such a group is
compared by few of its pairs, and links are still found wherever they change a
component.  Its pairs are tested by all 512 bits, and in the last round by 4,096,
which tell 0.8 from 0.72.

Edge cases: texts that are null or without a word are copies of each other and
of nothing else; texts shorter than a shingle have one shingle of all their
words; shingles and sets are told apart by 64-bit hashes; a very long text has to
fit a task; repeated rows count each; other columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, drop_staged, lean, mix64, staged, text_slices, utf8_list
from .components import connected_components
from .simhash import segment_counts

#: Similarity 0.8 as a fraction; a pair is linked if the common shingles times (4 + 5) are at least 4 times both sizes.
PART, WHOLE = 4, 5
STEP = np.uint64(0x9E3779B97F4A7C15)
PAIRS_AT_ONCE = 1 << 20
RUNS_AT_ONCE = 1 << 10
#: Words of 64 bits of a fingerprint, and how many of them cells carry.
WORDS, CARRIED = 8, 2
#: Bits of the carried words in which candidates may differ; at similarity 0.8 they differ in 19.3, with a deviation of 4.1.
NEAR = 32
#: Words of the long fingerprint by which the pairs of large groups are tested at last.
LONG = 64
#: Share of all bits in which sets of similarity 0.8 differ, at the worst of their sizes from 5 shingles (smaller sets are
#: not tested by it), and deviations allowed above it.
DIFFER, DEVIATIONS, FEW = 0.1563, 3.4, 5
#: Share of two-bit segments whose counts agree at similarity 0.8, and the recall aimed at there.
AGREE, RECALL = 0.732, 0.985
#: A cell with more passing pairs than this many for each row is compared in rounds.
DENSE = 2
SMALL_CELL = 64
#: Sets outside these classes of ids don't go to the join with the sets to be compared.
FILTER_BITS = 24


def shingle_sets(texts: list[bytes | None], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each text, and the offsets of the texts."""
    w = Words([(t or b"").lower() for t in texts])
    h = w.hashes()
    n = max(0, len(h) - shingle + 1)
    total = np.zeros(n, np.uint64)
    for k in range(shingle):
        total = (total + h[k : k + n]) * STEP
    inside = w.text_of[:n] == w.text_of[shingle - 1 :]
    hashes, of = [mix64(total[inside])], [w.text_of[:n][inside]]
    short = np.flatnonzero((w.count > 0) & (w.count < shingle))
    few = np.zeros(len(short), np.uint64)
    for k in range(shingle - 1):
        more = w.count[short] > k
        few[more] = (few[more] + h[w.first[short[more]] + k]) * STEP
    hashes.append(mix64(few + w.count[short].astype(np.uint64)))
    of.append(short)
    hashes, of = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(len(texts) + 1))


def set_ids(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes * STEP + np.uint64(1)))])
    return mix64(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64) * STEP).view(np.int64)


def fingerprints(hashes: np.ndarray, at: np.ndarray, words: range = range(WORDS)) -> np.ndarray:
    """Words of a SimHash of each set: a bit is 1 if over half of the shingles' hashes have it.

    Ones are added up in bytes, eight at a time, for up to 255 shingles of a set.
    """
    out = np.zeros((len(at) - 1, len(words)), np.uint64)
    sizes = np.diff(at)
    runs = -(-sizes // 255)
    run_of = np.repeat(np.arange(len(sizes)), runs)
    cuts = at[run_of] + 255 * (np.arange(len(run_of)) - np.repeat(np.cumsum(runs) - runs, runs))
    some = np.flatnonzero(sizes)
    first_run = (np.cumsum(runs) - runs)[some]
    for place, word in enumerate(words):
        ones = np.zeros((len(cuts), 64), np.uint8)
        step = np.uint64((word + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for a in range(0, len(cuts), RUNS_AT_ONCE):
            mine = cuts[a : a + RUNS_AT_ONCE]
            end = cuts[a + RUNS_AT_ONCE] if a + RUNS_AT_ONCE < len(cuts) else len(hashes)
            bits = np.unpackbits(mix64(hashes[mine[0] : end] + step).view(np.uint8)).reshape(-1, 64)
            ones[a : a + RUNS_AT_ONCE] = np.add.reduceat(bits.view(np.uint64), mine - mine[0], axis=0).view(np.uint8)
        if len(some):
            total = np.add.reduceat(ones, first_run, axis=0, dtype=np.int64)
            out[some, place] = np.packbits(2 * total > sizes[some][:, None], axis=1).view(np.uint64)[:, 0]
    return out


def grids(sets: int, seed: int = 42) -> np.ndarray:
    """Masks (grid, word) of the segments of each grid, for so many distinct sets."""
    chosen = max(9, math.ceil(math.log2(max(sets, 1) / 1000) / 1.5))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE**chosen))
    random = np.random.default_rng(seed)
    masks = np.zeros((tables, WORDS), np.uint64)
    for t in range(tables):
        for segment in random.choice(WORDS * 32, chosen, replace=False):
            masks[t, segment // 32] |= np.uint64(3 << 2 * int(segment % 32))
    return masks


def cell_rows(reps: DataFrame, masks: np.ndarray) -> DataFrame:
    """key (cell), id, n and the carried words: a row for each set and grid."""
    names = ["key", "id", "n", *(f"f{k}" for k in range(CARRIED))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.stack([batch.column(f"f{k}").to_numpy().view(np.uint64) for k in range(WORDS)], axis=1)
            for a in range(0, len(fp), 1 << 12):
                counts = segment_counts(fp[a : a + (1 << 12)])
                cells = []
                for t, mask in enumerate(masks):
                    cell = np.full(len(counts), mix64(np.uint64([t + 1]))[0], np.uint64)
                    for word in np.flatnonzero(mask):
                        cell = mix64((cell + (counts[:, word] & mask[word])) * STEP)
                    cells.append(cell)
                rest = [np.tile(batch.column(x).to_numpy()[a : a + (1 << 12)], len(masks)) for x in names[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(cells).view(np.int64), *rest)], names=names)

    columns = ["id", "n", *(f"f{k}" for k in range(WORDS))]
    return reps.select(*columns).mapInArrow(lean(run), ", ".join(f"{x} long" for x in names))


def _mapped(docs: DataFrame, columns: list[str], schema: str, shingle: int, work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield work(part, *shingle_sets(utf8_list(part.column("text")), shingle))

    return docs.select(*columns).mapInArrow(lean(run), schema)


def _distance(f: np.ndarray, a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
    return np.bitwise_count((f[a] ^ f[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _may_link(n: np.ndarray, differ: np.ndarray, a: np.ndarray | int, b: np.ndarray | slice) -> np.ndarray:
    """Whether sizes and fingerprints allow a link."""
    na, nb = n[a], n[b]
    return (differ <= NEAR) & (WHOLE * np.minimum(na, nb) >= PART * np.maximum(na, nb))


def most_differing(words: int) -> int:
    """Bits of so many words in which sets of similarity 0.8 may differ."""
    bits = 64 * words
    return int(DIFFER * bits + DEVIATIONS * math.sqrt(bits * DIFFER * (1 - DIFFER)))


def _small_pairs(key: np.ndarray, n: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Places of pairs of sets that may link, and their distances, of all cells of few sets at once."""
    after = np.searchsorted(key, key, side="right") - np.arange(len(key)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    at, found = 0, [np.zeros((0, 3), np.int64)]
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS_AT_ONCE, side="right")) - 1)
        left = np.repeat(np.arange(at, to), after[at:to])
        right = left + 1 + np.arange(len(left)) - np.repeat(total[at:to] - total[at], after[at:to])
        differ = _distance(f, left, right)
        hit = _may_link(n, differ, left, right)
        found.append(np.stack([left[hit], right[hit], differ[hit]], axis=1))
        at = to
    return np.concatenate(found)


def _cell_pairs(ids: np.ndarray, n: np.ndarray, f: np.ndarray) -> np.ndarray | None:
    """Pairs of one cell that may link and their distances; None if there are very many."""
    found, size = [], 0
    for k in range(len(ids) - 1):
        differ = _distance(f, slice(k, k + 1), slice(k + 1, None))
        hit = np.flatnonzero(_may_link(n, differ, k, slice(k + 1, None)))
        if len(hit):
            found.append(np.stack([np.full(len(hit), ids[k]), ids[k + 1 + hit], differ[hit]], axis=1))
            size += len(hit)
            if size > DENSE * len(ids):
                return None
    return np.concatenate([np.zeros((0, 3), np.int64), *found])


def _large_pairs(ids: np.ndarray, n: np.ndarray, f: np.ndarray, rest: np.ndarray, label: np.ndarray, whole: bool) -> Iterator[np.ndarray]:
    """Pairs of one cell between sets not yet connected: a forest of them, or all (``whole``).

    ``f`` has the carried words, ``rest`` the others.
    """
    if len(np.unique(label)) < 2:
        return
    label = label.copy()
    most = most_differing(f.shape[1] + rest.shape[1])
    for k in range(len(ids)):
        other = np.flatnonzero(label != label[k])
        if whole:
            other = other[other > k]
        if not len(other):
            if whole:
                continue
            return
        differ = _distance(f, slice(k, k + 1), other)
        fine = _may_link(n, differ, k, other)
        other, differ = other[fine], differ[fine]
        fine = (differ + _distance(rest, slice(k, k + 1), other) <= most) | (np.minimum(n[k], n[other]) < FEW)
        other, differ = other[fine], differ[fine]
        if not whole:
            _, first = np.unique(label[other], return_index=True)
            other, differ = other[first], differ[first]
            label[np.isin(label, label[other])] = label[k]
        if len(other):
            yield np.stack([np.full(len(other), ids[k]), ids[other], differ], axis=1)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of whole keys from batches sorted by key."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(x).to_numpy() for x in names]
        cut = int(np.searchsorted(new[0], new[0][-1]))
        if cut or (held and held[-1][0][-1] != new[0][0]):
            held.append([x[:cut] for x in new])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []
        held.append([x[cut:] for x in new])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _pair_batch(parts: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate([np.zeros((0, 3), np.int64), *parts])
    pairs[:, :2] = np.sort(pairs[:, :2], axis=1)
    pairs = np.unique(pairs, axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(3)], names=["a", "b", "d"])


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """a, b, d (distance) of pairs that may link; and the rows (key, a, n, words; null b) of cells with very many such pairs."""
    carried = [f"f{k}" for k in range(CARRIED)]
    names = ["a", "b", "d", "key", "n", *carried]

    def open_rows(key: np.ndarray, ids: np.ndarray, n: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(ids), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ids), none, none, *(pa.array(np.ascontiguousarray(x)) for x in (key, n, *f.T))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, ["key", "id", "n", *carried]):
            key, ids, n = columns[:3]
            f = np.stack(columns[3:], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            small = np.repeat(sizes <= SMALL_CELL, sizes)
            k, i, m, g = key[small], ids[small], n[small], f[small]
            pairs = _small_pairs(k, m, g)
            _, cell, rows_of = np.unique(k, return_inverse=True, return_counts=True)
            dense = np.bincount(cell[pairs[:, 0]], minlength=len(rows_of)) > DENSE * rows_of
            yield open_rows(k[dense[cell]], i[dense[cell]], m[dense[cell]], g[dense[cell]])
            pairs = pairs[~dense[cell[pairs[:, 0]]]]
            found = [np.stack([i[pairs[:, 0]], i[pairs[:, 1]], pairs[:, 2]], axis=1)]
            for s, size in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL], strict=True):
                cell = slice(s, s + size)
                pairs = _cell_pairs(ids[cell], n[cell], f[cell])
                if pairs is None:
                    yield open_rows(key[cell], ids[cell], n[cell], f[cell])
                else:
                    found.append(pairs)
            pairs = _pair_batch(found)
            none = pa.nulls(pairs.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*pairs.columns, *[none] * (2 + CARRIED)], names=names)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(run), ", ".join(f"{x} long" for x in names))


def large_pairs(sets: DataFrame, turn: int, whole: bool) -> DataFrame:
    """a, b, d: pairs of differently labelled sets that may link, by cell; each turn begins with other sets.

    ``sets`` has a row for each set with the array of its cells (``keys``), no more than there are grids.
    """
    words = [f"f{k}" for k in range(LONG if whole else WORDS)]
    rows = sets.select(F.explode("keys").alias("key"), "id", "n", *words, "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, ["key", "id", "n", *words, "label"]):
            starts = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
            held, size = [], 0
            for s, e in zip(starts, np.append(starts[1:], len(columns[0])), strict=True):
                _, ids, n, *f, label = [x[s:e] for x in columns]
                f = np.stack(f, axis=1)
                for part in _large_pairs(ids, n, f[:, :CARRIED].copy(), f[:, CARRIED:].copy(), label, whole):
                    held.append(part)
                    size += len(part)
                    if size > PAIRS_AT_ONCE:
                        yield _pair_batch(held)
                        held, size = [], 0
            yield _pair_batch(held)

    return rows.repartition("key").sortWithinPartitions("key", F.xxhash64("id", F.lit(turn))).mapInArrow(lean(run), "a long, b long, d long").distinct()


def long_words(sets: DataFrame) -> DataFrame:
    """id and the words of the long fingerprint that follow those of the first."""
    names = [f"f{k}" for k in range(WORDS, LONG)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            at = lists.offsets.to_numpy()
            fp = fingerprints(lists.values.to_numpy()[at[0] : at[-1]].view(np.uint64), at - at[0], range(WORDS, LONG)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(x)) for x in fp.T)], names=["id", *names])

    return sets.mapInArrow(lean(run), "id long, " + ", ".join(f"{x} long" for x in names))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose similarity is 0.8 or more, exactly."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}"))
    common = F.size(F.array_intersect("ha", "hb"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where((PART + WHOLE) * common >= PART * (F.size("ha") + F.size("hb"))).select("a", "b")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each of 2^24 classes of ids: whether the class has one of ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            flags[batch.column("id").to_numpy() & ((1 << FILTER_BITS) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()])], names=["bits"])

    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for row in ids.mapInArrow(lean(run), "bits binary").toLocalIterator():
        bits |= np.frombuffer(row.bits, np.uint8)
    return bits


def _nearest(pairs: DataFrame) -> DataFrame:
    """For every set the nearest of its partners."""
    return pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, rounds: int = 2) -> DataFrame:
    """id, set_id, component_id (smallest id reachable over links of similarity 0.8 or more)."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = [f"f{k}" for k in range(WORDS)]

    def sketched(part: pa.RecordBatch, hashes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        fp = fingerprints(hashes, at).view(np.int64)
        columns = [part.column("id"), pa.array(set_ids(hashes, at)), pa.array(np.diff(at)), *(pa.array(np.ascontiguousarray(x)) for x in fp.T)]
        return pa.RecordBatch.from_arrays(columns, names=["id", "set_id", "n", *words])

    rows = staged(_mapped(docs, ["id", "text"], f"id {kind}, set_id long, n long, " + ", ".join(f"{x} long" for x in words), shingle, sketched), "sets")
    reps = staged(rows.groupBy(F.col("set_id").alias("id")).agg(F.min("id").alias("rep"), *(F.min(x).alias(x) for x in ("n", *words))), "distinct")
    met = staged(candidate_pairs(cell_rows(reps.where("n > 0"), grids(reps.count()))), "met")
    pairs = staged(met.where("b is not null").select("a", "b", "d").distinct(), "pairs")
    large = met.where("b is null").groupBy(F.col("a").alias("id")).agg(F.collect_set("key").alias("keys"))
    large = staged(large.join(reps.select("id", "n", *words), "id"), "large")
    drop_staged(met)
    members = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(large.select("id")).distinct(), "members")

    sent = docs.sparkSession.sparkContext.broadcast(id_filter(members))

    def listed(part: pa.RecordBatch, hashes: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        ids, sizes = set_ids(hashes, at), np.diff(at)
        slot = ids & ((1 << FILTER_BITS) - 1)
        kept = (sent.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
        hashes, at = hashes[np.repeat(kept, sizes)], np.concatenate([[0], np.cumsum(sizes[kept])])
        return pa.RecordBatch.from_arrays([pa.array(ids[kept]), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))], names=["id", "hashes"])

    texts = _mapped(docs, ["text"], "id long, hashes array<long>", shingle, listed)
    sets = staged(texts.join(members, "id", "left_semi").dropDuplicates(["id"]), "hashes")
    drop_staged(members)
    read = [pairs]  # what only the coming round reads
    roots = connected_components(pairs.limit(0).select("a", "b"))
    for turn in range(rounds + 1):
        last = turn == rounds
        label = roots.select("id", F.col("component"))
        labelled = lambda x, of: x.join(label.select(F.col("id").alias(of), F.col("component").alias(f"l{of}")), of, "left")
        apart = F.coalesce("la", "a") != F.coalesce("lb", "b")
        left = staged(labelled(labelled(pairs, "a"), "b").where(apart).select("a", "b", "d"), "pairs")
        for table in read:
            drop_staged(table)
        tried = left.select("a", "b") if last else _nearest(left)
        named = large.join(label, "id", "left").select("id", "keys", "n", *words, F.coalesce("component", "id").alias("label"))
        if last:
            wide = sets.join(large.select("id"), "id", "left_semi").select("id", "hashes")
            named = named.join(long_words(wide), "id")
        tried = staged(tried.union(large_pairs(named, turn, last).select("a", "b")).distinct(), "tried")
        found = staged(_linked(tried, sets), "links")
        pairs = left.join(tried, ["a", "b"], "left_anti")
        merged = connected_components(labelled(labelled(found, "a"), "b").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
        moved = roots.join(merged.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
        before, roots = roots, staged(moved.select("id", F.coalesce("to", "component").alias("component")).union(merged.join(roots, "id", "left_anti").select("id", "component")), "roots")
        read = [left, tried]
        for table in (found, merged, before):
            drop_staged(table)
    named = staged(reps.join(roots.select("id", "component"), "id", "left").select("id", "rep", F.coalesce("component", "id").alias("root")), "rooted")
    for table in (*read, reps, large, sets, roots):
        drop_staged(table)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select(F.col("id").alias("set_id"), "component_id")
    return rows.join(named, "set_id").select(F.col("id").alias(id_col), "set_id", "component_id")
