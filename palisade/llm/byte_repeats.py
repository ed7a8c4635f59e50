"""Substring deduplication of bytes by sampled suffixes.

The difference-cover scheme for suffix sorting samples positions so that any
two suffixes reach sampled positions after the same number of steps, names the
samples by sorting their prefixes, and ranks the remaining suffixes through the
samples.  Here only prefixes of ``window`` bytes matter, so the cover is taken
from content instead of residues: every window marks the k-gram with the
smallest hash in it, and two equal windows mark the same place.  The marked
positions with all the windows that mark them are the sampled tuples: they are
sorted by Spark and named by content, equal neighbours are repeats; remaining
suffixes (windows) are compared only where tuples with the same k-gram differ,
sorted by place and prefix, each with the one before it.  See ``repeats``.

Fixed residues modulo 3 would sort two thirds of all suffixes (the README has
figures); the marks are about 2 / (window - seed) of all positions.

Edge cases: a null text is empty; texts shorter than a window lose nothing;
matches never cross documents; removed ranges may cut characters of several
bytes, so ``kept`` is binary; documents with a null id lose nothing and remove
nothing; rows that share an id and a text count as one document, those that share
an id only are documents of their own, neither before the other (the method
"difference_cover" expects ids without such rows); very long texts are worked on
in pieces; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import difference_cover
from .common import BYTE_VALUE
from .repeats import Settings, Spelling, identified, range_arrays, repeated_ranges, unpack, with_ranges


def byte_symbols(texts: list[bytes]) -> Spelling:
    joined = b"".join(texts)
    return Spelling(BYTE_VALUE[np.frombuffer(joined, np.uint8)], np.array([len(t) for t in texts], np.int64), joined, None)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 100, seed: int = 24, group_rows: int = 1 << 13, method: str = "sampled") -> DataFrame:
    """id, n_bytes, n_removed, spans (maximal removed byte ranges), kept (binary: the other bytes).

    A byte goes if a window over it also starts earlier: in a document with a
    smaller id, or in the same document before.  ``method`` is "sampled" (see
    ``repeats``) or "difference_cover" (all suffixes, see there): the same results.
    """
    rows = identified(docs, id_col, text_col)
    known = rows.where("doc is not null")
    if method == "difference_cover":
        ranges = difference_cover.repeated_ranges(known.drop("row"), window)
        ranges = ranges.join(known.select("doc", "row").distinct(), "doc").select("doc", "row", "start", "end")
    else:
        ranges = repeated_ranges(known, Settings(window, seed, True, byte_symbols, True, group_rows))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, spans, kept = [], [], [], []
            for text, found in zip(unpack(batch.column("packed").to_pylist()), batch.column("ranges").to_pylist(), strict=True):
                text = text or b""
                start, end = range_arrays(found)
                start, end = np.minimum(start, len(text)).tolist(), np.minimum(end, len(text)).tolist()
                counts.append(len(text))
                removed.append(sum(end) - sum(start))
                spans.append([{"start": a, "end": b} for a, b in zip(start, end, strict=True) if b > a])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *end], [*start, len(text)], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "n_removed", "spans", "kept"],
            )

    SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = with_ranges(rows, ranges).select("doc", "packed", "ranges")
    return out.mapInArrow(apply, "doc long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("doc", id_col)
