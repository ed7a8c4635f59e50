"""Substring deduplication of words by compacting a de Bruijn graph.

Graph: a node is a token k-mer (``seed`` words) that marks windows, an edge is
the longer token k-mer around it that one text spells (all windows that the
node marks).  Edges meet at equal nodes in Spark partitions.  A node at which
all texts spell the same edge does not branch: its occurrences compact into
removed ranges at once, and neighbouring ranges of a text into one path.  Only
at branching nodes are the texts' own words fetched by source coordinates and
the 50-word windows verified one by one.  See ``repeats`` for how.

Marking keeps about 2 / (window - seed) of all k-mers, so the graph is a small
part of the corpus; every repeated window is still found, since equal windows
mark equal nodes.

Edge cases: a null text has no words; texts shorter than a window lose nothing;
documents with a null id lose nothing and remove nothing; rows that share an id
and a text count as one document, those that share an id only are documents of
their own, neither before the other; a window that repeats only in its own document stays; very long texts
are worked on in pieces; other columns are not looked at; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import de_bruijn
from .common import Words, lean
from .repeats import Settings, Spelling, identified, range_arrays, repeated_ranges, unpack, with_ranges


def word_symbols(texts: list[bytes]) -> Spelling:
    w = Words(texts)
    return Spelling(w.hashes(), w.count, *w.spelled())


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
#: Bytes of unpacked texts in one Arrow batch of results (or one text).
TEXTS_AT_ONCE = 1 << 20


def without_ranges(keep: tuple[str, ...], as_they_are: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes the rows of ``remove_repeated_words`` of packed texts and their ranges: a text at a time, however small it is packed."""
    names = ["doc", "n_words", "n_removed", "spans", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[tuple], rest: pa.RecordBatch) -> pa.RecordBatch:
            made = [pa.array(x, kind) for x, kind in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), SPANS, pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays([rest.column("doc"), *made, *(rest.column(c) for c in keep)], names=[*names, *keep])

        for batch in batches:
            held: list[tuple] = []
            size = at = 0
            for k in range(batch.num_rows):
                text, found = unpack([batch.column("packed")[k].as_py()])[0], batch.column("ranges")[k].as_py()
                words = (text or b"").split()
                start, end = range_arrays(found)
                start, end = np.minimum(start, len(words)).tolist(), np.minimum(end, len(words)).tolist()
                removed = sum(end) - sum(start)
                spans = [{"start": a, "end": b} for a, b in zip(start, end, strict=True) if b > a]
                if as_they_are and not removed:
                    kept = None if text is None else text.decode()
                else:
                    parts = [w for a, b in zip([0, *end], [*start, len(words)], strict=True) for w in words[a:b]] if found else words
                    kept = b" ".join(parts).decode()
                held.append((len(words), removed, spans, kept))
                size += len(text or b"")
                if size >= TEXTS_AT_ONCE or k + 1 == batch.num_rows:
                    yield rows(held, batch.slice(at, k + 1 - at))
                    held, size, at = [], 0, k + 1

    return run


def remove_repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, seed: int = 16, group_rows: int = 1 << 15, method: str = "sampled", keep: tuple[str, ...] = (), as_they_are: bool = False
) -> DataFrame:
    """id, n_words, n_removed, spans (removed word ranges), kept (other words joined by one space), and ``keep``: columns of the row.

    A word goes if a window over it also starts in a document with a smaller id.
    ``method`` is "sampled" (see ``repeats``) or "de_bruijn" (the graph of every k-mer that can repeat, see there): the same results.
    With ``as_they_are``, texts that lose nothing are kept unchanged.
    """
    rows = identified(docs, id_col, text_col, keep)
    known = rows.where("doc is not null").select("doc", "row", "text")
    if method == "de_bruijn":
        ranges = de_bruijn.repeated_ranges(known, window)
    else:
        ranges = repeated_ranges(known, Settings(window, seed, False, word_symbols, False, group_rows))

    out = with_ranges(rows, ranges).select("doc", "packed", "ranges", *keep)
    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return out.mapInArrow(lean(without_ranges(keep, as_they_are)), f"doc long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string{more}").withColumnRenamed("doc", id_col)
