"""What the corpus operators share: tables, text slicing and small hashes (and staging, which is the cluster's)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import drop_staged, shared_folder, ship, spread, staged  # noqa: F401

#: A word: a run of anything but ASCII white space.  ``bytes.split()`` cuts the same words.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are worked on in slices of about this many bytes, so that numpy's temporaries stay small.
SLICE_BYTES = 1 << 20


#: Texts go to Python in Arrow batches of at most this size, whatever their lengths.
ARROW_BATCH = "8m"


def prepared(spark: SparkSession, batch: str = ARROW_BATCH) -> SparkSession:
    """The session with the package sent to its executors and bounded Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


_tables: list[dict] = []


def worker_table() -> dict:
    """A dict of what a Python worker keeps from one task to the next; tasks that don't need it may empty it (``lean``)."""
    _tables.append({})
    return _tables[-1]


def drop_worker_tables() -> None:
    for x in _tables:
        x.clear()


def trim() -> None:
    """Gives freed memory back to the system, which Arrow's and the C library's allocators else keep for the worker's life."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if give_back is not None:
        give_back(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], drop: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` whose worker stays small: workers serve all stages of an application.

    With ``drop``, what other stages' tasks keep there goes first.
    """

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if drop:
            drop_worker_tables()
        try:
            yield from run(batches)
        finally:
            trim()

    return small


def text_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into consecutive slices of about ``most`` bytes of ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8_list(column: pa.Array) -> list[bytes | None]:
    """A string column as a list of UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a polynomial hash are usable."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Rolling hashes are polynomials modulo the prime 2^31 - 1, with two bases.
PRIME = np.uint64((1 << 31) - 1)
BITS31 = np.uint64(31)
BASES = (1_284_865_837, 1_812_433_253)
_powers: dict[int, np.ndarray] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2^62."""
    x = (x & PRIME) + (x >> BITS31)
    x = (x & PRIME) + (x >> BITS31)
    return np.where(x >= PRIME, x - PRIME, x)


def _power_table(base: int, n: int) -> np.ndarray:
    """At least n powers of a base, in 32 bits."""
    table = _powers.get(base, np.ones(1, np.uint32))
    if len(table) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        while len(table) < size:
            more = table[: size - len(table)].astype(np.uint64) * np.uint64(pow(base, len(table), int(PRIME)))
            table = np.concatenate([table, reduced(more).astype(np.uint32)])
        _powers[base] = table
    return table


class Rolling:
    """62-bit hashes of any ranges of a symbol array (uint64), by prefix sums.

    Two polynomials modulo a prime, so no family of strings collides by its
    form, as it does modulo a power of two.  Hashes only group and order; what
    is equal is settled by digests or by content.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums, self.inverse = [], []
        for base, part in zip(BASES, (symbols & PRIME, (symbols >> BITS31) & PRIME), strict=True):
            sums = np.zeros(n + 1, np.uint64)
            product = part * _power_table(base, n + 1)[:n]
            np.cumsum((product & PRIME) + (product >> BITS31), out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(_power_table(pow(base, -1, int(PRIME)), n + 1))

    def _joined(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return mix64((one << BITS31) | two)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (reduced(reduced(s[end] - s[start]) * i[start]) for s, i in zip(self.sums, self.inverse, strict=True))
        return mix64(self._joined(one, two) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def every(self, k: int) -> np.ndarray:
        """Hashes of all ranges of length k."""
        n = len(self.sums[0]) - k
        return self._joined(*(reduced(reduced(s[k:] - s[:n]) * i[:n]) for s, i in zip(self.sums, self.inverse, strict=True)))


def digests(pieces: Iterable[bytes], count: int) -> np.ndarray:
    """128-bit BLAKE2b digests of byte strings, two 64-bit words each: what they are told apart by."""
    joined = b"".join([blake2b(x, digest_size=16).digest() for x in pieces])
    return np.frombuffer(joined, np.uint64).reshape(count, 2)


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a slice of texts: where they are, in which text, and their 64-bit hashes."""

    def __init__(self, texts: list[bytes | None]):
        self.buffer = b"\n".join(t or b"" for t in texts) + b"\n"
        self.data = np.frombuffer(self.buffer, np.uint8)
        sizes = np.array([len(t or b"") for t in texts], np.int64)
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        self.stops = self.begins + sizes
        inside = ~WHITE[self.data]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.begins)  # first word of each text
        self.count = np.searchsorted(self.start, self.stops) - self.first
        self.text_of = np.repeat(np.arange(len(texts)), self.count)
        self.inside = inside
        self._rolling: Rolling | None = None

    @property
    def rolling(self) -> Rolling:
        if self._rolling is None:
            self._rolling = Rolling(BYTE_VALUE[self.data])
        return self._rolling

    def hashes(self) -> np.ndarray:
        return self.rolling.ranges(self.start, self.end)

    def spelled(self) -> tuple[bytes, np.ndarray]:
        """All words joined by one space, and where each begins (one past the end last)."""
        begins = np.concatenate([[0], np.cumsum(self.end - self.start + 1)])
        return b" ".join(self.buffer.split()) + b" ", begins

    def codes(self) -> tuple[np.ndarray, int]:
        """A number for each word, the same for equal words only, and how many there are."""
        found = pa.array(self.buffer.split(), pa.binary()).dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(found.dictionary)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes in each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.stops] - total[self.begins]
