"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point, so
every alphabet is covered without a table.  An n-gram binds its letters: the
vectors are permuted (rotated) by their place and multiplied.  A text bundles
its n-grams (adds them up), a language prototype bundles its training texts,
and a text gets the language whose prototype has the largest cosine.

Texts are read as letters in lower case; any run of other characters is one
blank, and a text starts and ends with one.  Prototypes are exact integer sums
over all training texts, added up by Spark, so reruns agree.  What reaches the
driver is one vector for each language, at most ``max_languages``.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with
no training text at all, every document is ``und``.  Null ids are neither held
out nor used in training.  Equal cosines go to the smaller code.  Repeated rows
are counted and judged each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, mix64, text_slices

UNKNOWN = "und"
BLANK = 32
#: Texts are bundled in groups with at most so many (text, n-gram) cells, with so many n-gram vectors at a time.
CELLS = 2 << 20
GRAMS_AT_ONCE = 2048
SLICE = 512 << 10

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Lower-case code point of each letter, blank for any other code point."""
    if not _letters:
        table = np.full(0x110000, BLANK, np.int32)
        for cp in range(0x110000):
            if (c := chr(cp)).isalpha():
                table[cp] = ord(c.lower()[0])
        _letters.append(table)
    return _letters[0]


def letter_vectors(letters: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    words = np.arange(dim // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = mix64(mix64(letters.astype(np.uint64)[:, None] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)) + words)
    ones = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(letters), -1), axis=1)
    return ones.astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vectors(grams: np.ndarray, n: int, dim: int, seed: int) -> np.ndarray:
    """Bound vectors of n-grams that are packed as 21-bit code points."""
    out = np.ones((len(grams), dim), np.int8)
    for place in range(n):
        letter, back = np.unique((grams >> np.uint64(21 * (n - 1 - place))) & np.uint64((1 << 21) - 1), return_inverse=True)
        out *= np.roll(letter_vectors(letter, dim, seed), n - 1 - place, axis=1)[back]
    return out


class Grams:
    """Distinct n-grams of a slice of texts and how often each text has them."""

    def __init__(self, texts: list[str | None], n: int):
        blank = " "
        joined = blank + blank.join(t or "" for t in texts) + blank
        sizes = np.array([len(t or "") + 1 for t in texts], np.int64)
        points = letter_table()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
        of = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes)])
        keep = (points != BLANK) | np.concatenate([[True], points[:-1] != BLANK])
        points, of = points[keep].astype(np.uint64), of[keep]
        self.letters = np.bincount(of[points != BLANK], minlength=len(texts))
        count = max(0, len(points) - n + 1)
        packed = np.zeros(count, np.uint64)
        for place in range(n):
            packed = (packed << np.uint64(21)) | points[place : place + count]
        # Blanks never meet, so an n-gram (n > 1) has its first and last letter at its ends or next to them.
        at = np.arange(count)
        first, last = at + (points[at] == BLANK), at + n - 1 - (points[at + n - 1] == BLANK)
        whole = of[first] == of[last]
        self.grams, back = np.unique(packed[whole], return_inverse=True)
        self.back, self.of = back, of[last][whole]
        self.texts = len(texts)

    def bundles(self, n: int, dim: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first text, bundled vectors of the next texts), a group at a time."""
        width = max(1, len(self.grams))
        rows = max(1, CELLS // width)
        for at in range(0, self.texts, rows):
            to = min(self.texts, at + rows)
            lo, hi = np.searchsorted(self.of, [at, to])
            cells = (self.of[lo:hi] - at) * width + self.back[lo:hi]
            counts = np.bincount(cells, minlength=(to - at) * width).astype(np.float32).reshape(to - at, width)
            total = np.zeros((to - at, dim), np.float32)
            for g in range(0, len(self.grams), GRAMS_AT_ONCE):
                part = slice(g, g + GRAMS_AT_ONCE)
                total += counts[:, part] @ gram_vectors(self.grams[part], n, dim, seed).astype(np.float32)
            yield at, total


def prototypes(docs: DataFrame, text_col: str, lang_col: str, dim: int, n: int, seed: int, max_languages: int) -> dict[str, np.ndarray]:
    """Language to bundled vector, over all rows of ``docs`` with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, text_col, SLICE):
                langs, texts = part.column(lang_col).to_pylist(), part.column(text_col).to_pylist()
                for lang in set(langs):
                    found = Grams([t for t, x in zip(texts, langs, strict=True) if x == lang], n)
                    if not len(found.grams):
                        continue
                    counts = np.bincount(found.back, minlength=len(found.grams)).astype(np.float64)
                    total = np.zeros(dim)
                    for g in range(0, len(counts), GRAMS_AT_ONCE):
                        part_of = slice(g, g + GRAMS_AT_ONCE)
                        total += counts[part_of] @ gram_vectors(found.grams[part_of], n, dim, seed)
                    sums[lang] = sums.get(lang, 0) + total.astype(np.int64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(total)], names=["lang", "d", "x"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    partial = rows.mapInArrow(lean(run), "lang string, d int, x long")
    summed = partial.groupBy("lang", "d").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
    found = summed.limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"over {max_languages} languages; raise max_languages")
    return {r.lang: np.array([p.x for p in r.v], np.float64) for r in sorted(found, key=lambda r: r.lang)}


def identify(
    docs: DataFrame,
    train: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    keep: tuple[str, ...] = ("doc_id",),
    dim: int = 1024,
    n: int = 3,
    seed: int = 42,
    max_languages: int = 1000,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score (cosine, at least 0)."""
    known = prototypes(train, text_col, lang_col, dim, n, seed, max_languages)
    names = list(known)
    unit = np.stack([v / max(np.linalg.norm(v), 1e-9) for v in known.values()]).astype(np.float32) if known else np.zeros((0, dim), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col, SLICE):
                found = Grams(part.column(text_col).to_pylist(), n)
                best, score = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                for at, bundle in found.bundles(n, dim, seed) if names else ():
                    cosine = (bundle @ unit.T) / np.maximum(np.linalg.norm(bundle, axis=1), 1e-9)[:, None]
                    best[at : at + len(bundle)] = cosine.argmax(axis=1)
                    score[at : at + len(bundle)] = np.clip(cosine.max(axis=1), 0, 1)
                sure = (found.letters > 0) & bool(names)
                lang = [names[b] if s else UNKNOWN for b, s in zip(best, sure, strict=True)]
                rest = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(np.where(sure, score, 0.0))], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys((*keep, text_col))).mapInArrow(lean(run), f"{kinds}, lang_pred string, score double")
