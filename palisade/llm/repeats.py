"""Windows that repeat earlier ones: the engine of both substring deduplications.

A text is a row of symbols (bytes, or word hashes).  A window is ``length``
consecutive symbols of one text.  Which windows also start earlier is found
without a row for each window:

1. Cover.  In every window the seed (k-gram) with the smallest hash is marked, so
   equal windows mark the same place.  Consecutive windows with the same mark
   form a *bundle*: seed, place of the seed, number of windows and a digest of all
   that they spell.  This is the sampled set of positions; unlike fixed
   residues it depends on content only, which keeps it at about 2 / (length - k)
   of all positions.
2. Names.  Bundles are sorted by seed, then by content (equal contents are
   neighbours).  A bundle equal to an earlier one is removed whole.  If all
   bundles of a seed are equal, that is all there is to say of it.
3. Remaining windows.  Where a seed has different bundles, the first of each
   content is fetched from its text, by its coordinates, and their windows are
   compared one by one: sorted by place of the seed and content, a window that
   follows an earlier equal one is removed.  Seeds with more than
   ``group_rows`` different bundles go through a Spark aggregation instead.

Rolling hashes only choose marks and bring rows together.  What counts as equal
is told by 128-bit BLAKE2b digests of what the texts spell, and for windows of
bytes that are fetched, by the bytes.

"Earlier" is a smaller document id, or with ``within`` also a smaller start in
the same document.  A document is told by its id and a hash of its text (``row``),
so texts that share an id are documents of their own, of which none is earlier.  Equal bundles of the same slice of texts are merged before
the shuffle, so a passage that very many documents share is sent once for each
slice.  Removed ranges are merged as early as possible.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUE, Rolling, digests, lean, mix64, staged, text_slices, utf8_list

U = np.uint64
#: Symbols that are hashed, and bytes of fetched bundles that are compared, at once (more for one seed).
SYMBOLS_AT_ONCE, PAYLOAD_AT_ONCE = 1 << 18, 1 << 20


@dataclass(frozen=True)
class Spelling:
    """Texts of a slice as symbols (uint64), the number of them in each text, and what they spell."""

    symbols: np.ndarray
    sizes: np.ndarray
    buffer: bytes
    #: Where each symbol begins in the buffer, one past the end last; None if symbols are the bytes.
    begins: np.ndarray | None

    def pieces(self, start: np.ndarray, end: np.ndarray) -> Iterator[bytes]:
        if self.begins is not None:
            start, end = self.begins[start], self.begins[end]
        buffer = self.buffer
        return (buffer[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True))


@dataclass(frozen=True)
class Settings:
    length: int
    seed: int
    within: bool
    spell: Callable[[list[bytes]], Spelling]
    #: Symbols are single bytes: bundles are fetched as they are, else as one digest for each window.
    bytewise: bool
    group_rows: int = 1 << 15


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(grid, axis=1).ravel()
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(suffix[:m], prefix[width - 1 : width - 1 + m])


def bundles(spelling: Spelling, s: Settings) -> tuple[np.ndarray, ...]:
    """(text, start, place of the seed, windows, seed hash, two words of a content digest) of all bundles.

    Works on any number of symbols in pieces of bounded size.
    """
    symbols, sizes = spelling.symbols, spelling.sizes
    ends = np.cumsum(sizes)
    found = []
    piece = SYMBOLS_AT_ONCE
    for at in range(0, max(len(symbols) - s.length + 1, 0), piece):
        part = symbols[at : at + piece + s.length - 1]
        rolling = Rolling(part)
        hashes = rolling.every(s.seed)
        bits = U(int(len(part)).bit_length())
        ranked = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        marks = (sliding_least(ranked, s.length - s.seed + 1) & ((U(1) << bits) - U(1))).astype(np.int64)
        inside = np.ones(len(marks), bool)
        for e in ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(part), side="right")] - at:
            inside[max(0, e - s.length + 1) : e] = False
        head = np.ones(len(marks), bool)
        head[1:] = (marks[1:] != marks[:-1]) | ~inside[:-1]
        heads = np.flatnonzero(head & inside)
        # a bundle ends before the next head, or before the next window that crosses into another text
        stops = np.append(np.flatnonzero(head | ~inside), len(marks))
        windows = stops[np.searchsorted(stops, heads, side="right")] - heads
        content = digests(spelling.pieces(heads + at, heads + at + windows + s.length - 1), len(heads))
        off = marks[heads] - heads
        t = np.searchsorted(ends, heads + at, side="right")
        found.append((t, heads + at - (ends - sizes)[t], off, windows, hashes[marks[heads]], content[:, 0] ^ mix64(off.astype(np.uint64)), content[:, 1].copy()))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), *(np.zeros(0, np.uint64) for _ in range(3)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the one before in any column."""
    heads = np.ones(len(columns[0]), bool)
    heads[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return heads


def firsts(heads: np.ndarray) -> np.ndarray:
    """For each row the first row of its group."""
    return np.flatnonzero(heads)[np.cumsum(heads) - 1]


def later(heads: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, within: bool) -> np.ndarray:
    """For rows sorted by group, doc, row and start: which are later than their group's first, or than the group's first in their own text."""
    gone = doc > doc[firsts(heads)]
    return gone | (start > start[firsts(heads | changes(doc, row))]) if within else gone


def merged_ranges(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Union of ranges of each document."""
    if not len(doc):
        return doc, row, start, end
    order = np.lexsort((start, row, doc))
    doc, row, start, end = doc[order], row[order], start[order], end[order]
    other = changes(doc, row)
    number = np.cumsum(other) - 1
    wide = int(max(end.max(), start.max())) + 1
    if int(number[-1] + 1) * wide < 1 << 62:
        reach = np.maximum.accumulate(end + number * wide) - number * wide
    else:  # very long texts: one document at a time
        reach = np.concatenate([np.maximum.accumulate(e) for e in np.split(end, np.flatnonzero(other)[1:])])
    new = other.copy()
    new[1:] |= start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], row[new], start[new], reach[last]


MARK = "kind byte, h long, c long, d long, doc long, row long, start long, off int, windows int"
#: Kinds of rows: a bundle to be compared, a range to be removed.
BUNDLE, RANGE = 0, 1


def _rows(kind: int, h: np.ndarray, c: np.ndarray, d: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, off: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(h), kind, np.int8), *(x.view(np.int64) for x in (h, c, d)), doc, row, start, off.astype(np.int32), windows.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in MARK.split(", ")])


def _range_rows(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Ranges as rows: ``c`` holds the end."""
    none = np.zeros(len(doc), np.int64)
    return _rows(RANGE, none, end, none, doc, row, start, none, none)


def cover(docs: DataFrame, s: Settings) -> DataFrame:
    """Rows of MARK over (doc, row, text): bundles, and ranges that repeat within a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = [t or b"" for t in utf8_list(part.column("text"))]
                ids, marks = part.column("doc").to_numpy(), part.column("row").to_numpy()
                text, start, off, windows, h, c, d = bundles(s.spell(texts), s)
                doc, row = ids[text], marks[text]
                order = np.lexsort((start, row, doc, d, c, h))
                doc, row, start, off, windows, h, c, d = (x[order] for x in (doc, row, start, off, windows, h, c, d))
                gone = later(changes(h, c, d), doc, row, start, s.within)
                yield _range_rows(*merged_ranges(doc[gone], row[gone], start[gone], (start + windows + s.length - 1)[gone]))
                stay = ~gone
                yield _rows(BUNDLE, *(x[stay] for x in (h, c, d, doc, row, start, off, windows)))

    return docs.mapInArrow(run, MARK)


def name(marks: DataFrame, s: Settings) -> DataFrame:
    """Compare bundles: RANGE rows for repeated ones, BUNDLE rows for those whose windows must be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        for batch in batches:
            columns = [x.to_numpy() for x in batch.columns]
            ready = columns[0] == RANGE
            if ready.any():
                yield _range_rows(*merged_ranges(columns[4][ready], columns[5][ready], columns[6][ready], columns[2][ready]))
            rows = [x[~ready] for x in columns[1:]]
            live = np.ones(len(rows[0]), bool)
            if carry is not None:
                live = np.concatenate([carry[-1], live])
                rows = [np.concatenate([a, b]) for a, b in zip(carry[:-1], rows, strict=True)]
            h, c, d, doc, row, start, off, windows = rows
            if not len(h):
                continue
            new_seed = changes(h)
            new_run = changes(h, c, d)
            gone = later(new_run, doc, row, start, s.within)
            seed_of = np.cumsum(new_seed) - 1
            runs = np.bincount(seed_of[new_run])
            emit = gone & live
            yield _range_rows(*merged_ranges(doc[emit], row[emit], start[emit], (start + windows + s.length - 1)[emit]))
            keep = ~gone & live & (runs[seed_of] > 1)
            yield _rows(BUNDLE, *(x[keep] for x in rows))
            # The last seed may go on.  Its rows so far: heads that wait for a second content, or two that stand for it.
            last = seed_of == seed_of[-1]
            if runs[-1] == 1:
                wait = last & (~gone)
                alive = live[wait]
            else:
                wait = np.zeros(len(h), bool)
                begun = np.flatnonzero(new_run & last)
                wait[[begun[0], begun[-1]]] = True
                alive = np.zeros(2, bool)
            carry = [*(x[wait] for x in rows), alive]

    spread = F.when(F.col("kind") == BUNDLE, F.col("h")).otherwise(F.xxhash64("doc", "start"))
    return marks.repartition(spread).sortWithinPartitions("kind", "h", "c", "d", "doc", "row", "start").mapInArrow(run, MARK)


FOUND = "kind byte, doc long, row long, start long, end long, w long, v long"


def _found(kind: int, doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, v: np.ndarray | None = None, w: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.int64)
    columns = [np.full(len(doc), kind, np.int8), doc, row, start, end, *(none if x is None else x.view(np.int64) for x in (w, v))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[x.split()[0] for x in FOUND.split(", ")])


def packed_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The text column as compressed bytes, for a smaller shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in text_slices(batch, text_col):
                packed = pa.array([None if t is None else pack.compress(t) for t in utf8_list(part.column(text_col))], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != text_col), packed], names=[*(c for c in part.schema.names if c != text_col), "packed"])

    others = [c for c in docs.columns if c != text_col]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in others)
    return docs.select(*others, text_col).mapInArrow(lean(run), f"{kinds}packed binary")


def unpack(packed: list[bytes | None]) -> list[bytes | None]:
    tool = zstandard.ZstdDecompressor()
    return [None if p is None else tool.decompress(p) for p in packed]


def same_bytes(data: bytes, at: np.ndarray, first: np.ndarray, length: int) -> bool:
    """Whether all windows (by their places ``at``) equal the first of their group, byte by byte."""
    array, step = np.frombuffer(data, np.uint8), np.arange(length)
    rest = np.flatnonzero(first != np.arange(len(at)))
    for k in range(0, len(rest), 1 << 14):
        mine = rest[k : k + (1 << 14)]
        if (array[at[mine][:, None] + step] != array[at[first[mine]][:, None] + step]).any():
            return False
    return True


def compare_windows(docs: DataFrame, open_bundles: DataFrame, s: Settings) -> DataFrame:
    """FOUND rows: ranges of repeated windows, or (kind 1) single windows of very large seeds."""
    wanted = open_bundles.groupBy("doc", "row").agg(F.collect_list(F.struct("h", "start", "windows")).alias("wanted"))  # bounded by the text
    met = packed_text(docs).join(wanted, ["doc", "row"]).select("doc", "row", "packed", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, lists = batch.column("doc").to_numpy(), batch.column("row").to_numpy(), batch.column("wanted")
            bounds = lists.offsets.to_numpy()
            h, start, windows = (x.to_numpy().astype(np.int64) for x in lists.values.flatten())
            size = windows + s.length - 1
            fits, payload = np.zeros(len(h), bool), []
            for at, text in enumerate(unpack(batch.column("packed").to_pylist())):
                mine = slice(bounds[at], bounds[at + 1])
                spelling = s.spell([text or b""])
                for i, (a, n) in enumerate(zip(start[mine].tolist(), size[mine].tolist(), strict=True), bounds[at]):
                    if a + n <= len(spelling.symbols):  # else an id and a hash that are shared by two texts
                        fits[i] = True
                        if s.bytewise:
                            payload.append(spelling.buffer[a : a + n])
                        else:
                            each = np.arange(a, a + n - s.length + 1)
                            payload.append(digests(spelling.pieces(each, each + s.length), len(each)).tobytes())
            doc, row = np.repeat(ids, np.diff(bounds)), np.repeat(marks, np.diff(bounds))
            columns = [*(pa.array(x[fits]) for x in (h, doc, row, start)), pa.array(payload, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "doc", "row", "start", "payload"])

    fetched = met.mapInArrow(fetch, "h long, doc long, row long, start long, payload binary")

    def windows_of(parts: list[pa.RecordBatch], digest: bool) -> tuple[np.ndarray, ...]:
        """doc, row, start and a 128-bit key (or for bytes without ``digest``: a hash, place in the bytes, and the bytes) of all windows."""
        t = pa.Table.from_batches(parts)
        payload = t.column("payload").to_pylist()
        size = np.array([len(x) for x in payload], np.int64)
        n = size - s.length + 1 if s.bytewise else size // 16
        place = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
        doc, row, start = (t.column(c).to_numpy()[place] for c in ("doc", "row", "start"))
        start = start + k
        joined = b"".join(payload)
        if not s.bytewise:
            words = np.frombuffer(joined, np.uint64).reshape(-1, 2)
            return doc, row, start, words[:, 0].copy(), words[:, 1].copy(), b""
        at = (np.cumsum(size) - size)[place] + k
        if digest:
            words = digests((joined[a : a + s.length] for a in at.tolist()), len(at))
            return doc, row, start, words[:, 0].copy(), words[:, 1].copy(), b""
        return doc, row, start, Rolling(BYTE_VALUE[np.frombuffer(joined, np.uint8)]).every(s.length)[at], at.view(np.uint64), joined

    def closed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeated windows of whole seeds, some seeds at a time."""
        t = pa.Table.from_batches(parts).combine_chunks()
        ends = np.cumsum(pc.binary_length(t.column("payload")).to_numpy())
        heads = np.append(np.flatnonzero(changes(t.column("h").to_numpy())), t.num_rows)
        at = 0
        while at < t.num_rows:
            before = ends[at - 1] if at else 0
            fit = heads[: np.searchsorted(heads, np.searchsorted(ends, before + PAYLOAD_AT_ONCE, side="right"), side="right")]
            to = int(fit[-1]) if len(fit) and fit[-1] > at else int(heads[np.searchsorted(heads, at, side="right")])
            yield compared(t.slice(at, to - at).to_batches())
            at = to

    def compared(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        doc, row, start, v, w, joined = windows_of(parts, False)
        order = np.lexsort((start, row, doc, v) if joined else (start, row, doc, w, v))
        doc, row, start, v, w = (x[order] for x in (doc, row, start, v, w))
        heads = changes(v) if joined else changes(v, w)
        if joined and not same_bytes(joined, w.view(np.int64), firsts(heads), s.length):  # hashes met
            exact = pa.array([joined[a : a + s.length] for a in w.tolist()], pa.binary()).dictionary_encode().indices.to_numpy()
            order = np.lexsort((start, row, doc, exact))
            doc, row, start, heads = doc[order], row[order], start[order], changes(exact[order])
        gone = later(heads, doc, row, start, s.within)
        return _found(0, *merged_ranges(doc[gone], row[gone], start[gone], start[gone] + s.length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def single(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            doc, row, start, v, w, _ = windows_of(parts, True)
            return _found(1, doc, row, start, start + s.length, v, w)

        held: list[pa.RecordBatch] = []
        size = 0
        large: int | None = None
        for batch in batches:
            h = batch.column("h").to_numpy()
            at = 0
            while at < len(h):
                if large is not None:  # a seed with very many bundles goes on
                    to = int(np.searchsorted(h, large, side="right"))
                    if to > at:
                        yield single([batch.slice(at, to - at)])
                    large, at = (large if to == len(h) else None), to
                    continue
                cut = int(np.searchsorted(h, h[-1]))  # rows of the last seed may go on
                if cut > at:
                    yield from closed([*held, batch.slice(at, cut - at)])
                    held, size, at = [], 0, cut
                elif held and held[-1].column("h")[0].as_py() != h[at]:
                    yield from closed(held)
                    held, size = [], 0
                held.append(batch.slice(at))
                size += len(h) - at
                at = len(h)
                if size > s.group_rows:
                    yield single(held)
                    held, size, large = [], 0, int(h[-1])
        if held:
            yield from closed(held)

    return fetched.repartition("h").sortWithinPartitions("h").mapInArrow(run, FOUND)


def identified(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, row, text (and ``keep``): a document is an id and a text."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"), *keep)


def repeated_ranges(docs: DataFrame, s: Settings) -> DataFrame:
    """doc, row, start, end (in symbols) of ranges covered by windows that also start earlier.

    ``docs`` has (doc long, row long, text); a doc's ranges may overlap or touch.
    """
    marks = staged(name(cover(docs, s), s), "bundles")
    found = staged(compare_windows(docs, marks.where(F.col("kind") == BUNDLE), s), "found")
    single = found.where("kind = 1")
    rest = single.join(single.groupBy("w", "v").agg(F.min("doc").alias("first")), ["w", "v"])
    after = F.col("doc") > F.col("first")
    if s.within:  # the first of each text
        own = single.groupBy("w", "v", "doc", "row").agg(F.min("start").alias("own"))
        rest = rest.join(own, ["w", "v", "doc", "row"])
        after = after | (F.col("start") > F.col("own"))
    place = ["doc", "row", "start"]
    ranges = marks.where(F.col("kind") == RANGE).select(*place, F.col("c").alias("end"))
    return ranges.union(found.where("kind = 0").select(*place, "end")).union(rest.where(after).select(*place, "end"))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row of docs (doc, row, ..., packed text) with its sorted ranges (array of start, end; null if none)."""
    held = ranges.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))  # bounded by the text
    return packed_text(docs).join(held, ["doc", "row"], "left")


def range_arrays(found: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, sorted starts and ends of one document's ranges."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.array([r["start"] for r in found], np.int64)
    end = np.array([r["end"] for r in found], np.int64)
    one = np.zeros(len(start), np.int64)
    _, _, start, end = merged_ranges(one, one, start, end)
    return start, end
