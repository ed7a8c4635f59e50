"""Repeated word windows by compacting a de Bruijn graph with Spark joins.

0. Texts.  A window that two documents hold has the same seed of least hash in both.
   Windows whose least seed is met in one document only are left out: none repeats.
1. Edges.  Every other window of ``window`` words is an edge of the graph of
   (window - 1)-mers, named by a 128-bit digest.  Edges seen in two documents or
   more stay, each with its first place (smallest doc, start), its name from here on.
2. Links.  From their coordinates, edge -> next edge of the same text.  A link
   does not branch if its left edge has no other next one, its right edge no other
   one before, and their first places are consecutive.
3. Compaction.  Nonbranching paths shrink to their heads: inside blocks of
   ``BLOCK`` consecutive first places at once, from block to block by pointer
   doubling, a self-join each round, so a path of n blocks takes log2(n) rounds.
   First places grow along a path, so there are no cycles.
4. Spans.  Occurrences of a path's edges along a text merge into one span.  Each
   span of a later document is verified against the path's first place: the words
   at both source coordinates must have the same digest.

A place is a document's id, its number among the texts that share the id (``n``),
and a word; none of texts that share an id is earlier than another.

Edge cases: as in ``word_repeats``; rows that share an id and a text count once; an
empty table gives no ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Words, digests, drop_staged, lean, staged, text_slices, utf8_list
from .repeats import SYMBOLS_AT_ONCE, packed_text, sliding_least, unpack

#: Windows in one Arrow batch (or those of one text's stretch, if more).
AT_ONCE = 1 << 15
#: Bytes of texts that are cut into stretches at once; numpy's temporaries take about 60 times that.
STRETCH_BYTES = 256 << 10
#: First places that are compacted at once.
BLOCK = 64


def stretches(docs: DataFrame, window: int) -> DataFrame:
    """h, doc, row, start, windows: consecutive windows of a text with the same least hash of a seed (a third of a window)."""
    seed = max(1, window // 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", STRETCH_BYTES):
                words = Words(utf8_list(part.column("text")))
                doc, row = part.column("doc").to_numpy(), part.column("row").to_numpy()
                symbols, ends = words.hashes(), np.cumsum(words.count)
                for at in range(0, max(len(symbols) - window + 1, 0), SYMBOLS_AT_ONCE):
                    piece = symbols[at : at + SYMBOLS_AT_ONCE + window - 1]
                    least = sliding_least(Rolling(piece).every(seed), window - seed + 1)
                    inside = np.ones(len(least), bool)
                    for e in ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(piece), side="right")] - at:
                        inside[max(0, e - window + 1) : e] = False
                    head = np.ones(len(least), bool)
                    head[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
                    heads = np.flatnonzero(head & inside)
                    stops = np.append(np.flatnonzero(head | ~inside), len(least))
                    windows = stops[np.searchsorted(stops, heads, side="right")] - heads
                    text = np.searchsorted(ends, heads + at, side="right")
                    columns = [least[heads].view(np.int64), doc[text], row[text], heads + at - (ends - words.count)[text], windows]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "doc", "row", "start", "windows"])

    return docs.mapInArrow(lean(run), "h long, doc long, row long, start long, windows long")


def texts_of(docs: DataFrame, window: int) -> DataFrame:
    """doc, n, row, packed, wanted (stretches): the texts with windows whose least seed is met in two documents or more."""
    every = staged(stretches(docs, window), "stretches")
    met = every.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).where("last > least").select("h")
    wanted = every.join(met.hint("merge"), "h").groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("start", "windows"))).alias("wanted"))  # bounded by the text
    numbered = wanted.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("row")))
    texts = packed_text(docs).join(numbered.hint("merge"), ["doc", "row"]).dropDuplicates(["doc", "row"])
    texts = staged(texts.select("doc", "n", "row", "packed", F.array_distinct("wanted").alias("wanted")), "texts")
    drop_staged(every)
    return texts


def binary16(d: np.ndarray) -> pa.Array:
    """Digests as a binary column."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(d), [None, pa.py_buffer(d.tobytes())]).cast(pa.binary())


def spelled(text: bytes | None) -> tuple[bytes, np.ndarray]:
    """A text's words joined by one space, and where each begins (one past the end last)."""
    words = (text or b"").split()
    return b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])


def word_digests(joined: bytes, begins: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return digests((joined[a:b] for a, b in zip(begins[start].tolist(), (begins[end] - 1).tolist(), strict=True)), len(start))


def listed_texts(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """doc, n, text and the fields ``names`` (arrays) of what is wanted of it, a text at a time."""
    wanted = batch.column("wanted")
    bounds, fields = wanted.offsets.to_numpy(), [wanted.values.field(c).to_numpy() for c in names]
    doc, n, packed = (batch.column(c) for c in ("doc", "n", "packed"))
    for k in range(batch.num_rows):
        yield doc[k].as_py(), n[k].as_py(), unpack([packed[k].as_py()])[0], *(x[bounds[k] : bounds[k + 1]] for x in fields)


def edges(texts: DataFrame, window: int) -> DataFrame:
    """doc, n, p, e: a row for each wanted window of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            doc, n, p, e = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(n), pa.array(p), binary16(e)], names=["doc", "n", "p", "e"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for doc, n, text, start, windows in listed_texts(batch, "start", "windows"):
                joined, begins = spelled(text)
                for a, m in zip(start.tolist(), windows.tolist(), strict=True):
                    for at in range(a, a + m, AT_ONCE):
                        p = np.arange(at, min(a + m, at + AT_ONCE))
                        held.append((np.full(len(p), doc), np.full(len(p), n, np.int32), p, word_digests(joined, begins, p, p + window)))
                        size += len(p)
                        if size >= AT_ONCE:
                            yield rows(held)
                            held, size = [], 0
        if held:
            yield rows(held)

    return texts.select("doc", "n", "packed", "wanted").mapInArrow(lean(run), "doc long, n int, p long, e binary")


#: The place where an edge is met first, its name.
FIRST = ["fd", "fn", "fp"]


def next_to(c: str, step: int, along: Window) -> Column:
    """A column of the row before (-1) or after (1) in a window."""
    return F.lag(c).over(along) if step < 0 else F.lead(c).over(along)


def links(seen: DataFrame) -> DataFrame:
    """``seen`` (doc, n, p, FIRST) with ``before`` and ``after``: whether the text's edge before or after is the one of the first place before or after (or there is none)."""
    along = Window.partitionBy("doc", "n").orderBy("p")

    def single(step: int) -> Column:
        near = {c: next_to(c, step, along) for c in ("p", *FIRST)}
        same = (near["fd"] == F.col("fd")) & (near["fn"] == F.col("fn")) & (near["fp"] == F.col("fp") + step)
        return F.coalesce((near["p"] != F.col("p") + step) | same, F.lit(True))

    return seen.select("*", single(-1).alias("before"), single(1).alias("after"))


def paths(graph: DataFrame) -> DataFrame:
    """FIRST and head (a first place's word in the same text): the nonbranching path of each edge; ``graph`` has FIRST, before, after."""
    inside = Window.partitionBy("fd", "fn", "block").orderBy("fp")
    graph = graph.withColumn("block", F.floor(F.col("fp") / BLOCK))
    linked = F.coalesce((F.lag("fp").over(inside) == F.col("fp") - 1) & F.lag("after").over(inside) & F.col("before"), F.lit(False))
    graph = graph.withColumn("own", F.when(~linked, F.col("fp")))
    parts = staged(graph.withColumn("part", F.max("own").over(inside)).drop("own"), "parts")
    first = parts.where(f"fp % {BLOCK} = 0 and before").select("fd", "fn", "block", "part")
    last = parts.where(f"fp % {BLOCK} = {BLOCK - 1} and after").select("fd", "fn", (F.col("block") + 1).alias("block"), F.col("part").alias("head"))
    jumps = staged(first.join(last.hint("merge"), ["fd", "fn", "block"]).select("fd", "fn", "part", "head"), "jumps")
    while True:  # log2 of the blocks of the longest path
        far = jumps.select("fd", "fn", F.col("part").alias("head"), F.col("head").alias("far"))
        after = jumps.join(far.hint("merge"), ["fd", "fn", "head"], "left").select("fd", "fn", "part", F.coalesce("far", "head").alias("head"), F.col("far").isNotNull().alias("moved"))
        after = staged(after, "jumps")
        drop_staged(jumps)
        jumps = after.drop("moved")
        if after.where("moved").isEmpty():
            return parts.join(jumps.hint("merge"), ["fd", "fn", "part"], "left").select(*FIRST, F.coalesce("head", "part").alias("head"))


def spans_of(placed: DataFrame, window: int) -> DataFrame:
    """doc, n, start, end, source: the edges of one path that follow each other in a text as on the path; ``placed`` has doc, n, p, FIRST, head."""
    along = Window.partitionBy("doc", "n").orderBy("p")
    goes_on = F.lit(True)
    for c, step in (("p", 1), ("fd", 0), ("fn", 0), ("fp", 1), ("head", 0)):
        goes_on = goes_on & (F.lag(c).over(along) == F.col(c) - step)
    begun = placed.withColumn("begins", F.when(goes_on, 0).otherwise(1))
    runs = begun.withColumn("run", F.sum("begins").over(along)).groupBy("doc", "n", "run")
    spans = runs.agg(F.min("p").alias("start"), (F.max("p") + window).alias("end"), *(F.min(c).alias(c) for c in FIRST))
    source = F.struct(F.col("fd").alias("doc"), F.col("fn").alias("n"), F.col("fp").alias("start"), (F.col("fp") + F.col("end") - F.col("start")).alias("end"))
    return spans.select("doc", "n", "start", "end", source.alias("source"))


def span_digests(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, n, start, end, d: the digest of the words there."""
    wanted = spans.distinct().groupBy("doc", "n").agg(F.collect_list(F.struct("start", "end")).alias("wanted"))  # bounded by the text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, n, text, start, end in listed_texts(batch, "start", "end"):
                joined, begins = spelled(text)
                columns = [pa.array(np.full(len(start), doc)), pa.array(np.full(len(start), n, np.int32)), pa.array(start), pa.array(end), binary16(word_digests(joined, begins, start, end))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "start", "end", "d"])

    met = texts.select("doc", "n", "packed").join(wanted.hint("merge"), ["doc", "n"]).select("doc", "n", "packed", "wanted")
    return met.mapInArrow(lean(run), "doc long, n int, start long, end long, d binary")


def repeated_ranges(docs: DataFrame, window: int) -> DataFrame:
    """doc, row, start, end (in words) of ranges covered by windows that also start in an earlier document; ``docs`` has (doc long, row long, text)."""
    texts = texts_of(docs, window)
    every = staged(edges(texts, window), "edges")
    firsts = every.groupBy("e").agg(F.min(F.struct("doc", "n", "p")).alias("first"), F.max("doc").alias("last")).where("last > first.doc")
    firsts = firsts.select("e", F.col("first.doc").alias("fd"), F.col("first.n").alias("fn"), F.col("first.p").alias("fp"))
    seen = staged(links(every.join(firsts.hint("merge"), "e").select("doc", "n", "p", *FIRST)), "seen")
    drop_staged(every)
    graph = seen.groupBy(*FIRST).agg(F.bool_and("before").alias("before"), F.bool_and("after").alias("after"))
    heads = paths(graph)
    later = seen.where("doc > fd").select("doc", "n", "p", *FIRST)
    spans = staged(spans_of(later.join(heads.hint("merge"), FIRST), window), "spans")
    place = ["doc", "n", "start", "end"]
    told = staged(span_digests(texts, spans.select(*place).union(spans.select("source.*"))), "told")
    there = told.select(F.struct(*place).alias("source"), F.col("d").alias("source_d"))
    same = spans.join(told.hint("merge"), place).join(there.hint("merge"), "source").where("d = source_d")
    ranges = staged(same.join(texts.select("doc", "n", "row").hint("merge"), ["doc", "n"]).select("doc", "row", "start", "end"), "ranges")
    for table in (texts, seen, spans, told):
        drop_staged(table)
    return ranges
