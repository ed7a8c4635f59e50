"""Thousands of rules from a table: an index of what their patterns need picks the few to try.

Every match of a pattern contains one of a few literals (``union`` and ``select``
for ``union\\s+select|select.*from``).  The literals of all rules make one automaton
(Aho and Corasick 1975), which runs over a text once, however many rules there
are; only the rules whose literal it meets are tried, and Spark's own ``rlike``
decides.  Nothing is joined or shuffled: a text's candidates come beside it.

Rules without a literal of their own (``.*``, ``\\d+``) are tried on every text.  The
rule table is sent to the tasks in lots of at most ``lot_bytes``, a pass over the
texts each.
"""

from __future__ import annotations

import re
import re._constants as code
import re._parser as grammar
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.fixed import LEVELS
from .detect import Rule, usable_rules

RULE = "rule int, category string, severity string, pattern string"
CANDIDATES = "array<struct<rule:int,category:string,severity:string,level:int,pattern:string>>"
CANDIDATE = pa.struct([("rule", pa.int32()), ("category", pa.string()), ("severity", pa.string()), ("level", pa.int32()), ("pattern", pa.string())])


def needed_literals(pattern: str) -> tuple[str, ...]:
    """Lower-case strings of which every match of the pattern contains one; none if that can't be told."""
    try:
        found = _needed(grammar.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return ()  # Java's own syntax
    return tuple(sorted(found)) if found else ()


def _needed(parts: Sequence) -> frozenset[str] | None:
    """The best choice among what the parts of a sequence need: the longest of its shortest."""
    best: frozenset[str] | None = None
    run = ""

    def better(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for kind, value in parts:
        if kind is code.LITERAL:
            run += chr(value).lower()
            continue
        better(frozenset([run]) if run else None)
        run = ""
        if kind is code.SUBPATTERN:
            better(_needed(value[3]))
        elif kind is code.BRANCH:
            each = [_needed(x) for x in value[1]]
            better(frozenset().union(*each) if all(each) else None)
        elif kind in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT) and value[0] > 0:
            better(_needed(value[2]))
        elif kind is code.ATOMIC_GROUP:
            better(_needed(value))
    better(frozenset([run]) if run else None)
    return best


def rule_rows(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """A table of rules, numbered from 1 in their order."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(usable_rules(rules), 1)], RULE)


def _lots(rules: DataFrame, lot_bytes: int) -> Iterator[list[tuple]]:
    """The rules in order, in lots of at most ``lot_bytes``; one lot is held at a time."""
    held, size = [], 0
    for r in rules.select("rule", "category", "severity", "pattern").orderBy("rule").toLocalIterator():
        own = len(r.pattern.encode()) + 100
        if held and size + own > lot_bytes:
            yield held
            held, size = [], 0
        held.append((r.rule, r.category, r.severity, LEVELS[r.severity], r.pattern))
        size += own
    yield held


class Index:
    """The automaton of a lot of rules, made once in each worker."""

    def __init__(self, rules: list[tuple]):
        self.rules = rules
        self.always = []
        self.machine = ahocorasick.Automaton()
        places: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            literals = needed_literals(rule[-1])
            for x in literals:
                places.setdefault(x, []).append(i)
            if not literals:
                self.always.append(i)
        for x, found in places.items():
            self.machine.add_word(x, tuple(found))
        if places:
            self.machine.make_automaton()

    def candidates(self, text: str | None) -> list[int]:
        """Places of the rules to try, in order."""
        if text is None:
            return []
        found = set(self.always)
        if len(self.machine):
            for _, places in self.machine.iter(text.lower()):
                found.update(places)
        return sorted(found)

    def tried(self, batch: pa.RecordBatch, place: int, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """The batch with the candidates of each text, in parts of about ``most`` candidates or 64 ``most`` characters of text."""
        table = pa.array([dict(zip([f.name for f in CANDIDATE], r, strict=True)) for r in self.rules], CANDIDATE)
        texts, begun = batch.column(place), 0
        found, ends, size = [], [0], 0

        def part(to: int) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), table.take(pa.array(found, pa.int32())))
            rows = batch.slice(begun, to - begun)
            return pa.RecordBatch.from_arrays([*rows.columns, lists], [*batch.schema.names, "_candidates"])

        for i in range(batch.num_rows):  # one text at a time leaves Arrow
            text = texts[i].as_py()
            found += self.candidates(text)
            ends.append(len(found))
            size += len(text or "")
            if len(found) >= most or size >= most << 6:
                yield part(i + 1)
                begun, found, ends, size = i + 1, [], [0], 0
        if begun < batch.num_rows:
            yield part(batch.num_rows)


def with_rule_matches(df: DataFrame, text_col: str, rules: DataFrame, lot_bytes: int = 16 << 20) -> DataFrame:
    """Adds ``matches``, as ``rule_matches`` makes it: (rule, category, severity, level) of the rules that hit, in rule order.

    ``rules`` has rule (a number), category, severity and pattern; with a boolean
    ``enabled``, only those where it is not false count.  A null text has no match.
    """
    if "enabled" in rules.columns:
        rules = rules.where(F.coalesce("enabled", F.lit(True)))
    out = df.withColumn("matches", F.array().cast("array<struct<rule:int,category:string,severity:string,level:int>>"))
    for lot in _lots(rules, lot_bytes):
        out = _with_lot(out, text_col, lot)
    return out


def _with_lot(df: DataFrame, text_col: str, lot: list[tuple]) -> DataFrame:
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"_candidates {CANDIDATES}").fields])
    place = df.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(lot)
        for batch in parts:
            yield from index.tried(batch, place)

    hits = F.filter("_candidates", lambda c: F.rlike(F.col(text_col), c["pattern"]))
    slim = F.transform(hits, lambda c: F.struct(c["rule"].alias("rule"), c["category"].alias("category"), c["severity"].alias("severity"), c["level"].alias("level")))
    return df.mapInArrow(run, schema).withColumn("matches", F.concat("matches", slim)).drop("_candidates")
