"""BPE encoding by per-prefix dynamic programming, and decoding.

A text is cut at added tokens and then into pieces by the tokenizer's pattern.
In a piece every prefix has exactly one token that can end its encoding: the
one that (a) is a suffix of the prefix, (b) is compatible with the last token
of the prefix before it.  An Aho-Corasick automaton of the vocabulary (the
suffix automaton of all tokens) lists the suffix tokens of each prefix;
``compatible`` tests a pair; following the back-pointers from the whole piece
emits its ids.

``compatible(a, b)``: encoding the bytes of a then b gives [a, b] iff no merge
ever crosses their border.  While BPE builds a, the token that touches the
border runs through a's right spine, and through b's left spine for b.  At any
two that exist together, a crossing merge would win if it ranks before the next
merge on the left, or not after the next on the right (of equal ranks BPE takes
the leftmost).

Edge cases: a null text encodes like an empty one (no ids); long pieces take
time linear in their length and are not cached; repeated rows are encoded each.
The piece cache has two generations of at most ``cache`` entries: a full young
one becomes the old one, so frequent pieces stay; pairs are kept up to ``PAIRS``.
"""

from __future__ import annotations

import array
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, text_slices, worker_table

#: The byte-level pattern and alphabet of public byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

CACHE = 200_000
PAIRS = 200_000
LONG_PIECE = 256


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte: itself if printable, else the next one from U+0100 on."""
    rest = [b for b in range(256) if b not in set(PLAIN)]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder and decoder of one byte-level BPE tokenizer file."""

    def __init__(self, file: str, cache: int = CACHE):
        import ahocorasick
        import regex

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = spec["model"]["vocab"]
        known = {t: i for t, i in names.items() if t not in self.added}
        #: Bytes of each id, as characters U+0000-U+00FF.
        self.text = {i: "".join(chr(alphabet[c]) for c in t) for t, i in known.items()}
        self.length = {i: len(t) for i, t in self.text.items()}
        self.raw = [b""] * (max([*names.values(), *self.added.values()]) + 1)
        for i, t in self.text.items():
            self.raw[i] = t.encode("latin-1")
        for t, i in self.added.items():
            self.raw[i] = t.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = names[a], names[b]
            self.rank[pair] = r
            self.parts.setdefault(names[a + b], (*pair, r))
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.matches = ahocorasick.Automaton()
        for i, t in self.text.items():
            self.matches.add_word(t, i)
        self.matches.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else lambda text: [text]
        self.pairs: dict[int, bool] = {}
        self.most = cache
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token at the border, rank of the merge that ends it), for the left (0) or right (1) border."""
        found = [(token, len(self.rank))]
        top = token
        while top in self.parts:
            found.append((self.parts[top][side], self.parts[top][2]))
            top = self.parts[top][side]
        return found[::-1]

    def compatible(self, a: int, b: int) -> bool:
        left, right = self.right.get(a), self.left.get(b)
        if left is None:
            left = self.right[a] = self.spine(a, 1)
        if right is None:
            right = self.left[b] = self.spine(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            merge = self.rank.get((x, y))
            if merge is not None and merge < x_ends and merge <= y_ends:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if j + 1 == len(right) or (i + 1 < len(left) and x_ends <= y_ends):
                i += 1
            else:
                j += 1

    def piece(self, text: str) -> bytes:
        """Ids of one piece, as little-endian unsigned 32-bit integers."""
        data = text.encode().decode("latin-1")
        last = [-1] * (len(data) + 1)
        length, pairs = self.length, self.pairs
        for end, token in self.matches.iter(data):
            end += 1
            if last[end] < 0:
                start = end - length[token]
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    pair = before << 32 | token
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(before, token)
                    if not fits:
                        continue
                last[end] = token
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end -= length[last[end]]
        return array.array("I", ids[::-1]).tobytes()

    def cached(self, piece: str) -> bytes:
        """Ids of a piece that is not in the young cache, or has come into it just now."""
        ids = self.cache.get(piece) or self.old.get(piece) or self.piece(piece)
        if len(piece) <= LONG_PIECE:
            if len(self.cache) >= self.most:
                self.cache, self.old = {}, self.cache
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        out = []
        for part in self.cut(text):
            if part in self.added:
                out.append(array.array("I", [self.added[part]]).tobytes())
                continue
            pieces = self.pieces(part)
            found = list(map(self.cache.get, pieces))
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        found[i] = self.cached(pieces[i])
            out += found
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[tuple[str, int], PrefixBpe] = worker_table()


def tokenizer(file: str, cache: int = CACHE) -> PrefixBpe:
    """The tokenizer of a file, made once for each Python worker."""
    if (file, cache) not in _loaded:
        _loaded[file, cache] = PrefixBpe(file, cache)
    return _loaded[file, cache]


def _mapped(docs: DataFrame, columns: list[str], text_col: str, schema: str, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text_col):
                yield work(part)

    return docs.select(*columns).mapInArrow(lean(run, drop=False), schema)


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary: little-endian unsigned 32-bit integers) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(file)
        ids = [bpe.encode(t) if t else b"" for t in part.column(text_col).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    return _mapped(docs, [id_col, text_col], text_col, f"`{id_col}` {kind}, ids binary", work)


def decode(encoded: DataFrame, file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text of every row of ids."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(file)
        texts = [bpe.decode(x or b"") for x in part.column(ids_col).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(id_col), pa.array(texts, pa.string())], names=[id_col, "text"])

    return _mapped(encoded, [id_col, ids_col], ids_col, f"`{id_col}` {kind}, text string", work)


def round_trip(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, in one pass."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bpe = tokenizer(file, cache)
        counts, ids_sha, text_sha = [], [], []
        for text in part.column(text_col).to_pylist():
            ids = bpe.encode(text) if text else b""
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [part.column(id_col), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _mapped(docs, [id_col, text_col], text_col, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
