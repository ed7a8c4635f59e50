"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers;
their spans stay.  A semi-Markov CRF (Sarawagi and Cohen 2004) adds the spans that
the patterns miss: numbers in other groupings, without a plus, with a digit
mistyped; addresses spelled with brackets or blanks.

Candidates are whole segments: runs of digit groups, and what stands around an
at sign or a bracketed "at".  Of a run every stretch of groups that fits is one, however
long the run is, and of an address every start.  Features look at a whole segment (digits, lengths of
its groups, separators, checksum, ranges, ending, what stands on either side and
whether the run goes on), so a token model couldn't have them.  Between the
candidates' boundaries a text can pass outside; segments have at most 19 digits
or 80 characters, so the dynamic programme is linear in the text (a run of numbers holds
some KB for each of its groups while it is judged).  It runs
over (boundary, type of the last segment) and chooses boundaries and types
together; a segment of the best path is added if its posterior is at least
``least``.  What base spans cover is never a candidate.

Training is distant: the base spans of the corpus are its labels.  All texts are
searched for examples; of each type, and of numbers that are no personal data, the
``sample`` distinct ones with the smallest hash are kept (the bound of the fit, a
parameter).  Runs of 13 to 19 digits that fail the card check are no examples, as
they may be mistyped cards.  Each example is joined by variants of itself (regrouped,
mistyped, spelled out; and dates, versions, amounts as counterexamples).  Weights
are learned in Spark by iterative parameter mixing (McDonald, Hall and Mann 2010):
each task takes ``epochs`` of stochastic gradient steps from the common weights
over its examples, and the weights are averaged, ``rounds`` times.

Edge cases: null and empty texts have no spans; offsets are code points; very
long texts cost linear time (no pattern backtracks over more than a segment);
rows that share an id or a text are judged each; a corpus without any
example of a type never adds that type; an empty table gives none.  Clashing
extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import merge
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_staged, staged, text_slices

#: The kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
OUTSIDE = "-"
STATES = (OUTSIDE, *KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SEPARATOR = r"(?:\[\.\]|[ ().\-/]{1,3})"
NUMBER = re.compile(rf"\+?\(?[0-9]+(?:{SEPARATOR}[0-9]+)*")
AT = re.compile(r"\s?[\[({]\s?(?:at|AT)\s?[\])}]\s?|\s?@\s?")
DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?)"
SPELLED = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}")
LABEL = re.compile(rf"{DOT}[A-Za-z0-9-]+")

MOST_DIGITS, MOST_LOCAL, MOST_CHARS = 19, 64, 80
#: Characters kept on either side of an example.
AROUND = 16

Span = tuple[int, int, str]  # start, end, kind
Weights = dict[str, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the e-mail pattern, found from their at signs: linear for any text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            free = m.end()
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[Span]:
    """Four dotted numbers at a time from each dotted run."""
    for run in DOTTED.finditer(text):
        parts = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run[0])] if run[0].count(".") > 2 else []
        for i in range(0, len(parts) - 3, 4):
            if all(b - a <= 3 or not run[0][a : b - 3].strip("0") for a, b in parts[i : i + 4]) and all(int(run[0][max(a, b - 3) : b]) <= 255 for a, b in parts[i : i + 4]):
                yield run.start() + parts[i][0], run.start() + parts[i + 3][1], "ip"


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, by kind, then start."""
    found = [*emails(text), *addresses(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 2 * MOST_DIGITS and 13 <= len(d := digits_of(m[0])) <= MOST_DIGITS and luhn(d):
            found.append((m.start(), m.end(), "card"))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return found


@dataclass(frozen=True, slots=True)
class Arc:
    start: int
    end: int
    kind: str
    features: tuple[str, ...]
    #: What the features weigh together; None: not weighed yet.
    weight: float | None = None


def _side(text: str, at: int) -> str:
    """What kind of character stands at a place."""
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "blank" if c.isspace() else c if c in "+-./,:%@#_=" else "mark"


def _size(n: int) -> str:
    return str(n) if n < 4 else "4-7" if n < 8 else "8-15" if n < 16 else "16+"


def weighed(arc: Arc, w: Weights) -> float:
    return sum(w.get(f, 0.0) for f in arc.features) if arc.weight is None else arc.weight


class Cover:
    """The places that spans cover."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b, _ in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end) - 1
        return i >= 0 and self.ends[i] > start


def _number_arcs(text: str, run: re.Match, taken: Cover) -> Iterator[Arc]:
    groups = [(run.start() + m.start(), run.start() + m.end()) for m in re.finditer("[0-9]+", run[0])]
    for i, (first, _) in enumerate(groups):
        start = first
        while start > run.start() and text[start - 1] in "+(" and first - start < 2:
            start -= 1
        count = 0
        for j in range(i, len(groups)):
            end = groups[j][1]
            count += end - groups[j][0]
            if count > MOST_DIGITS or end - start > MOST_CHARS or taken.meets(start, end):
                break
            yield from _number_arc(text, run, start, end, groups[i : j + 1], count)


def _number_arc(text: str, run: re.Match, start: int, end: int, groups: list[tuple[int, int]], count: int) -> Iterator[Arc]:
    kinds = [k for k, fits in (("ip", len(groups) == 4 and count <= 12), ("card", 12 <= count), ("phone", 7 <= count <= 15)) if fits]
    if not kinds:
        return
    lengths = [b - a for a, b in groups]
    between = "".join(sorted({text[x[1] : y[0]] for x, y in zip(groups, groups[1:], strict=False)})) or "none"
    numbers = [text[a:b] for a, b in groups]
    shared = [
        f"digits={count}",
        f"groups={'-'.join(map(str, lengths)) if len(lengths) < 7 else 'many'}",
        f"between={between[:6]}",
        f"lead={text[start] if text[start] in '+(' else '0' if text[start : start + 2] == '00' else 'digit'}",
        f"left={_side(text, start - 1)}",
        f"right={_side(text, end)}",
        f"more={start > run.start()},{end < run.end()}",
    ]
    for kind in kinds:
        own = [f"luhn={luhn(''.join(numbers))}", f"digits={count},more={start > run.start() or end < run.end()}"] if kind == "card" else []
        own += [f"octets={all(int(x) <= 255 and len(x) <= 3 for x in numbers)}"] if kind == "ip" else []
        own += [f"year={any(len(x) == 4 and x[:2] in ('19', '20') for x in numbers)}"] if kind == "phone" else []
        yield Arc(start, end, kind, tuple(f"{kind}:{f}" for f in ("bias", *shared, *own)))


def _email_arcs(text: str, at: re.Match, taken: Cover) -> Iterator[Arc]:
    stop = at.start()
    start = stop
    while start > 0 and stop - start < MOST_LOCAL and text[start - 1] in LOCAL:
        start -= 1
    domain = SPELLED.match(text, at.end())
    if start == stop or not domain:
        return
    ends, place = [], domain.start()
    while m := LABEL.search(text, place, domain.end()):
        ends.append(m.end())
        place = m.end()
    starts = [start, *(i + 1 for i in range(start, stop - 1) if text[i] in "._%+-")]
    form = "plain" if at[0] == "@" else "blanks" if "@" in at[0] else "brackets"
    for s in starts:
        for n, e in enumerate(ends, 2):
            if e - s > 2 * MOST_CHARS or taken.meets(s, e):
                continue
            last = re.split(DOT, text[domain.start() : e])[-1]
            facts = (
                "bias",
                f"at={form}",
                f"labels={_size(n)}",
                f"ending={'letters' if last.isalpha() and 2 <= len(last) <= 6 else 'other'}",
                f"local={_size(stop - s)}",
                f"left={_side(text, s - 1)}",
                f"right={_side(text, e)}",
                f"whole={s == start},{e == ends[-1]}",
            )
            yield Arc(s, e, "email", tuple(f"email:{f}" for f in facts))


def segments(text: str, base: list[Span], w: Weights | None = None) -> Iterator[Arc]:
    """All candidate segments that no base span covers, by start; with ``w``, weighed, and without their features."""
    if not any(c in text for c in "0123456789@[({"):
        return iter(())
    taken = Cover(base)
    numbers = (arc for m in NUMBER.finditer(text) for arc in _number_arcs(text, m, taken))
    mails = (arc for m in AT.finditer(text) for arc in _email_arcs(text, m, taken))
    found = merge(numbers, mails, key=lambda x: x.start)
    return found if w is None else (Arc(x.start, x.end, x.kind, (), weighed(x, w)) for x in found)


def clusters(arcs: Iterator[Arc]) -> Iterator[list[Arc]]:
    """Runs of segments that overlap or touch: what lies between is outside anyway."""
    held: list[Arc] = []
    end = -1
    for arc in arcs:
        if held and arc.start > end:
            yield held
            held, end = [], -1
        held.append(arc)
        end = max(end, arc.end)
    if held:
        yield held


class Lattice:
    """Boundaries of a cluster's segments, and the ways through them: segments, or outside to the next boundary."""

    def __init__(self, arcs: list[Arc]):
        places = sorted({p for a in arcs for p in (a.start, a.end)})
        number = {p: i for i, p in enumerate(places)}
        self.size = len(places)
        self.into: list[list[tuple[int, Arc]]] = [[] for _ in places]
        self.out: list[list[tuple[int, Arc]]] = [[] for _ in places]
        for i in range(1, self.size):
            self.into[i].append((i - 1, Arc(places[i - 1], places[i], OUTSIDE, ())))
        for a in arcs:
            self.into[number[a.end]].append((number[a.start], a))
        for to, found in enumerate(self.into):
            for origin, a in found:
                self.out[origin].append((to, a))

    @staticmethod
    def turn(before: str, kind: str) -> tuple[str, ...]:
        """The feature of two segments that touch."""
        return () if OUTSIDE in (before, kind) else (f"{before}>{kind}",)

    def steps(self, w: Weights) -> Iterator[tuple[int, int, str, Arc, float]]:
        """(to, from, kind before, segment, score), in order of where they end."""
        for to in range(1, self.size):
            for origin, arc in self.into[to]:
                yield from self._ways(to, origin, arc, w)

    def steps_back(self, w: Weights) -> Iterator[tuple[int, int, str, Arc, float]]:
        """The same from the end, in order of where they start."""
        for origin in range(self.size - 1, -1, -1):
            for to, arc in self.out[origin]:
                yield from self._ways(to, origin, arc, w)

    def _ways(self, to: int, origin: int, arc: Arc, w: Weights) -> Iterator[tuple[int, int, str, Arc, float]]:
        own = weighed(arc, w)
        for before in STATES if origin else (OUTSIDE,):
            yield to, origin, before, arc, own + sum(w.get(f, 0.0) for f in self.turn(before, arc.kind))

    def best(self, w: Weights) -> list[Arc]:
        """The segments of the best path (outside ones left out)."""
        value: list[dict[str, tuple[float, tuple | None]]] = [{OUTSIDE: (0.0, None)}, *({} for _ in range(self.size - 1))]
        for to, origin, before, arc, score in self.steps(w):
            if before in value[origin]:
                v = value[origin][before][0] + score
                if arc.kind not in value[to] or v > value[to][arc.kind][0]:
                    value[to][arc.kind] = (v, (origin, before, arc))
        state = max(value[-1], key=lambda s: value[-1][s][0])
        at, out = self.size - 1, []
        while at:
            at, state, arc = value[at][state][1]
            if arc.kind != OUTSIDE:
                out.append(arc)
        return out[::-1]

    def posteriors(self, w: Weights) -> tuple[float, Iterator[tuple[str, Arc, float]]]:
        """Logarithm of the sum over all paths, and (kind before, segment, probability) by forward and backward sums."""
        ahead: list[dict[str, float]] = [{OUTSIDE: 0.0}, *({} for _ in range(self.size - 1))]
        for to, origin, before, arc, score in self.steps(w):
            if before in ahead[origin]:
                ahead[to][arc.kind] = _plus(ahead[to].get(arc.kind), ahead[origin][before] + score)
        back: list[dict[str, float]] = [{} for _ in range(self.size)]
        back[-1] = dict.fromkeys(STATES, 0.0)
        for to, origin, before, arc, score in self.steps_back(w):
            if arc.kind in back[to]:
                back[origin][before] = _plus(back[origin].get(before), back[to][arc.kind] + score)
        total = None
        for v in ahead[-1].values():
            total = _plus(total, v)
        found = (
            (before, arc, exp(min(0.0, ahead[origin][before] + score + back[to][arc.kind] - total)))
            for to, origin, before, arc, score in self.steps(w)
            if before in ahead[origin]
        )
        return total, found


def _plus(x: float | None, y: float) -> float:
    """log(exp(x) + exp(y))."""
    if x is None:
        return y
    a, b = (x, y) if x > y else (y, x)
    return a + log(1.0 + exp(b - a))


def added_spans(text: str, base: list[Span], w: Weights, least: float) -> list[Span]:
    out = []
    for arcs in clusters(segments(text, base, w)):
        lattice = Lattice(arcs)
        chosen = lattice.best(w)
        if chosen:
            sure = dict.fromkeys(chosen, 0.0)
            for _, arc, p in lattice.posteriors(w)[1]:
                if arc in sure:
                    sure[arc] += p
            out += [(a.start, a.end, a.kind) for a in chosen if sure[a] >= least]
    return out


def listed(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (KINDS.index(x[2]), x[0], x[1])))


# Examples and training


def examples(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, context, start, end) of base spans, and of numbers that are no personal data (kind ``-``, an empty span)."""
    base = base_spans(text)
    spans = sorted(base)
    for i, (a, b, kind) in enumerate(spans):
        if b - a <= MOST_CHARS and not (i and spans[i - 1][1] > a) and not (i + 1 < len(spans) and spans[i + 1][0] < b):
            left = max(0, a - AROUND, spans[i - 1][1] if i else 0)
            right = min(len(text), b + AROUND, spans[i + 1][0] if i + 1 < len(spans) else len(text))
            yield kind, text[left:right], a - left, b - left
    taken = Cover(spans)
    for m in NUMBER.finditer(text):
        count = len(digits_of(m[0])) if m.end() - m.start() <= 2 * MOST_CHARS else 0
        left, right = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if 4 <= count < 13 and not taken.meets(left, right):
            yield OUTSIDE, text[left:right], 0, 0


def _number_from(seed: str, n: int) -> str:
    return str(int(hashlib.sha256(seed.encode()).hexdigest(), 16)).zfill(70)[-n:]


def variants(kind: str, text: str, start: int, end: int) -> Iterator[tuple[str, str, int, int]]:
    """The example itself, and ways to write it that the patterns miss; for no kind, other numbers in its place."""
    yield kind, text, start, end
    span = text[start:end]
    new: list[str] = []
    if kind == "card":
        d = digits_of(span)
        i = int(_number_from(span, 2)) % len(d)
        wrong = d[:i] + str((int(d[i]) + 1 + int(_number_from(span, 1)) % 8) % 10) + d[i + 1 :]
        new = [wrong, ".".join(wrong[i : i + 4] for i in range(0, len(d), 4)), " ".join(wrong[i : i + 4] for i in range(0, len(d), 4))]
    elif kind == "phone":
        d = digits_of(span)
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        new = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{d[:-10] or '1'} {a} {b} {c}", span.lstrip("+")]
    elif kind == "ip":
        new = [span.replace(".", "[.]"), span.replace(".", " . ")]
    elif kind == "email":
        local, host = span.split("@", 1)
        new = [f"{local} (at) {host}", f"{local}[at]{host.replace('.', '[dot]')}", f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local} @ {host}"]
    else:
        m = NUMBER.search(text)
        n = _number_from(text, 20)
        if m:
            other = [
                f"20{n[:2]}-{n[2]}{n[3]}-{n[4]}{n[5]}", f"{n[:2]}.{n[2:4]}.19{n[4:6]}", f"{n[0]}.{n[1]}.{n[2]}", f"{n[:3]}.{n[3:7]}", f"{n[:2]}/{n[2:4]}/20{n[4:6]}",
                f"{n[:4]}-{n[4:8]}", f"{n[:3]} {n[3:6]}", n[:8], n[:10], f"{n[:3]} {n[3:6]} {n[6:9]}", f"978-{n[0]}-{n[1:3]}-{n[3:9]}-{n[9]}", f"{n[:1]}.{n[1:4]}.{n[4:7]}", f"{n[:3]}.4{n[3:5]}.9{n[5:7]}.{n[7:10]}",
            ]
            for x in other:
                yield OUTSIDE, text[: m.start()] + x + text[m.end() :], 0, 0
        return
    for x in new:
        yield kind, text[:start] + x + text[end:], start, start + len(x)


@dataclass(frozen=True)
class Lesson:
    """A cluster of an example, with the segment that is right (None: all outside)."""

    lattice: Lattice
    right: Arc | None


def lessons(kind: str, text: str, start: int, end: int) -> Iterator[Lesson]:
    """An example whose right segment is no candidate teaches nothing."""
    for way, t, a, b in variants(kind, text, start, end):
        for arcs in clusters(segments(t, [])):
            right = [x for x in arcs if (x.start, x.end, x.kind) == (a, b, way)]
            near = any(x.start < b and a < x.end for x in arcs)
            if right or not near or way == OUTSIDE:
                yield Lesson(Lattice(arcs), right[0] if right else None)


def descent(batch: list[Lesson], w: Weights, epochs: int, rate: float, decay: float) -> Weights:
    """Stochastic steps (AdaGrad) up the likelihood of the right paths, with weight decay."""
    w, squares = dict(w), defaultdict(float)
    for _ in range(epochs):
        for lesson in batch:
            slope: dict[str, float] = defaultdict(float)
            for before, arc, p in lesson.lattice.posteriors(w)[1]:
                for f in (*arc.features, *Lattice.turn(before, arc.kind)):
                    slope[f] -= p
            for f in lesson.right.features if lesson.right else ():
                slope[f] += 1.0
            for f, g in slope.items():
                g -= decay * w.get(f, 0.0)
                squares[f] += g * g
                w[f] = w.get(f, 0.0) + rate * g / (1e-3 + squares[f] ** 0.5)
    return w


EXAMPLE = "kind string, context string, start int, stop int"


def _examples(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for piece in text_slices(batch, "text"):
            rows = sorted({x for t in set(piece.column("text").to_pylist()) if t for x in examples(t)})
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], ["kind", "context", "start", "stop"])


def _taught(parts: Iterator[pa.RecordBatch], w: Weights, epochs: int, rate: float, decay: float) -> Iterator[pa.RecordBatch]:
    batch = [x for part in parts for r in part.to_pylist() for x in lessons(r["kind"], r["context"], r["start"], r["stop"])]
    learned = descent(batch, w, epochs, rate, decay) if batch else {}
    out = {"feature": pa.array(list(learned), pa.string()), "total": pa.array([v * len(batch) for v in learned.values()], pa.float64())}
    names = [*out["feature"].to_pylist(), ""]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*out["total"].to_pylist(), float(len(batch))], pa.float64())], ["feature", "total"])


def train(docs: DataFrame, sample: int = 300, rounds: int = 4, epochs: int = 2, rate: float = 0.5, decay: float = 1e-4, tasks: int = 6) -> Weights:
    """Weights of the features, from the base spans of all texts (see the module)."""
    found = docs.where(F.col("text").rlike("[0-9@]")).select("text").mapInArrow(_examples, EXAMPLE).distinct()
    order = Window.partitionBy("kind").orderBy(F.xxhash64("context", "start"), "context", "start")
    kept = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).drop("n")
    held = staged(kept.repartition(tasks, F.xxhash64("context")).sortWithinPartitions("context", "start"), "examples")
    w: Weights = {}
    for _ in range(rounds):
        learned = held.mapInArrow(lambda parts, w=w: _taught(parts, w, epochs, rate, decay), "feature string, total double")
        totals = {r.feature: r.total for r in learned.groupBy("feature").agg(F.sort_array(F.collect_list("total")).alias("each")).select("feature", F.aggregate("each", F.lit(0.0), lambda x, y: x + y).alias("total")).collect()}
        n = totals.pop("", 0.0)
        w = {f: v / n for f, v in totals.items()} if n else {}
    drop_staged(held)
    return w


FOUND = "base string, spans string, n_email long, n_ip long, n_card long, n_phone long"


def _judged(parts: Iterator[pa.RecordBatch], w: Weights, least: float, known: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for piece in text_slices(batch, "text"):
            base, whole, counts = [], [], {k: [] for k in KINDS}
            for t in piece.column("text").to_pylist():
                spans = base_spans(t) if t else []
                more = [x for x in added_spans(t, spans, w, least) if x[2] in known] if t else []
                base.append(listed(spans))
                whole.append(listed(spans + more))
                for k in KINDS:
                    counts[k].append(sum(x[2] == k for x in spans))
            rest = [piece.column(i) for i, f in enumerate(piece.schema) if f.name != "text"]
            names = [f.name for f in piece.schema if f.name != "text"]
            out = [pa.array(base, pa.string()), pa.array(whole, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS)]
            yield pa.RecordBatch.from_arrays([*rest, *out], [*names, *(f.split()[0] for f in FOUND.split(", "))])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 300, least: float = 0.9) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone (base spans of a kind), base, spans (all): spans as text, ``kind:start:end`` joined by commas."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    w = train(texts, sample)
    known = frozenset(k for k in KINDS if f"{k}:bias" in w)
    kind = dict(texts.dtypes)["doc_id"]
    found = texts.mapInArrow(lambda parts: _judged(parts, w, least, known), f"doc_id {kind}, {FOUND}")
    return found.select(F.col("doc_id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base", "spans")
