"""URL filters: a bit-parallel wildcard automaton (multiword Shift-And).

All glob rules are packed side by side into one row of 64-bit words.  A rule of
m consuming tokens takes m + 1 state bits; a wildcard is a self-loop on the
state where it stands.  Each byte of a URL moves all rules at once:

    D = ((D << 1) & step[byte]) | (D & loop[byte])

and the rules whose last state is set when the URL ends have matched.  The loop
runs over byte positions, with all URLs of a slice in one numpy array.

Glob syntax: ``?`` one byte but ``/``; ``*`` any run without ``/``; ``**`` any
run; ``\\`` takes the next character as it is.  Globs match the whole canonical
URL, which is ``.`` + host + path (host lower-cased, query and fragment cut).

Edge cases: a null URL or one without ``://`` has an empty host and path and is
judged like any other (no rule fits, the default globs see ``.``).  Repeated
rows are judged one by one; extra columns are not looked at.  An empty table
gives an empty result.  Memory is one slice of URLs and a row of words each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices, utf8_list

ONE, GAP, RUN = "?", "*", "**"


@dataclass(frozen=True)
class HostRule:
    """``action`` for a host with all its subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def tokens(self) -> list:
        return [GAP, *f".{self.host}{self.path}".encode(), RUN]


@dataclass(frozen=True)
class Glob:
    action: str
    pattern: str

    def tokens(self) -> list:
        out, text = [], self.pattern
        i = 0
        while i < len(text):
            if text.startswith(RUN, i):
                out.append(RUN)
                i += 2
            elif text[i] in (ONE, GAP):
                out.append(text[i])
                i += 1
            else:
                i += text[i] == "\\" and i + 1 < len(text)
                out.extend(text[i].encode())
                i += 1
        return out


class ShiftAnd:
    """Token lists packed into one automaton; ``match`` tells which match each text."""

    def __init__(self, patterns: Sequence[list]):
        sizes = [sum(t not in (GAP, RUN) for t in p) + 1 for p in patterns]
        self.words = max(1, -(-sum(sizes) // 64))
        step = np.zeros((256, self.words), np.uint64)
        loop = np.zeros((256, self.words), np.uint64)
        start = np.zeros(self.words, np.uint64)
        any_byte = np.arange(256)
        no_slash = any_byte[any_byte != ord("/")]
        self.final: list[tuple[int, np.uint64]] = []
        bit = 0
        for pattern in patterns:
            word, mask = self._at(bit)
            start[word] |= mask
            for token in pattern:
                if token in (GAP, RUN):
                    word, mask = self._at(bit)
                    loop[any_byte if token == RUN else no_slash, word] |= mask
                else:
                    bit += 1
                    word, mask = self._at(bit)
                    step[no_slash if token == ONE else token, word] |= mask
            self.final.append(self._at(bit))
            bit += 1
        self.step, self.loop, self.start = step, loop, start

    @staticmethod
    def _at(bit: int) -> tuple[int, np.uint64]:
        return bit // 64, np.uint64(1 << bit % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A boolean row for each text, a column for each pattern."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        buffer = np.frombuffer(b"".join(texts) or b"\0", np.uint8)
        begins = (np.cumsum(lengths) - lengths)[order]
        falling = -lengths[order]
        state = np.tile(self.start, (len(texts), 1))
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(falling, -t, side="left"))  # those longer than t
            byte = buffer[begins[:live] + t]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (now & self.loop[byte])
        hits = np.zeros((len(texts), len(self.final)), bool)
        for j, (word, mask) in enumerate(self.final):
            hits[order, j] = (state[:, word] & mask) != 0
        return hits


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[HostRule],
    globs: Sequence[Glob] = (),
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every URL: id, host, path, rule (longest fitting host rule or null), verdict.

    Among host rules the longest wins (the first of equally long ones).  Where
    none fits, the first matching glob decides, else ``default``.
    """
    host, path = host_and_path(F.col(url_col))
    canonical = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = list(globs)
    id_type = canonical.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([r.tokens() for r in [*ranked, *globs]])
        for batch in batches:
            for part in text_slices(batch, "path"):
                hosts, paths = utf8_list(part.column("host")), utf8_list(part.column("path"))
                hits = automaton.match([b"." + h + p for h, p in zip(hosts, paths, strict=True)])
                first = np.where(hits.any(axis=1), hits.argmax(axis=1), -1)
                rule = [ranked[k].name if 0 <= k < len(ranked) else None for k in first]
                verdict = [default if k < 0 else (ranked[k] if k < len(ranked) else globs[k - len(ranked)]).action for k in first]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                    names=[id_col, "host", "path", "rule", "verdict"],
                )

    return canonical.mapInArrow(judge, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
