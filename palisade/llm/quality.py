"""Quality rules with n-gram perplexity bands.

Base features are counted on whole texts: words, code points in words, symbols,
repeated lines and words in repeated three-word windows.

Perplexity: an interpolated Kneser-Ney model with modified discounts (three for
each order) over code points in lower case, runs of white space being one blank;
one model for each language and one for all languages together.  Nothing is
folded, so that models grow with the corpus.  Tasks count n-grams, Spark adds the
counts, derives continuation counts, counts of counts, discounts and back-off
weights; the result is stored in sorted arrays (one of keys, one of values for
each order) that tasks search.  Models are sent out in passes of at most
``model_mb``.  The model of a language that is larger is cut by the last letter
but one, which all look-ups of an n-gram share, so that every pass adds its part.

Bands: of all documents of a language, the median of log perplexity and the
median distance from it are exact (histograms of thousandths); the distance is
drawn to that of all documents as if ``prior_docs`` documents had it, so that rare
languages have a sound band.  Documents further than ``low_width`` such distances
below their language's median are rejected, and those further than ``high_width``
above it both for their own language and for all languages together: a text in
several languages is unusual for one of them only, garbled text for all.  For
texts of fewer than ``full_chars`` characters, whose mean is less certain, the
band is wider by the square root of the ratio, at most ``most_wider`` times.

Edge cases: a null text has no words; documents that fail a base rule are never
kept; a text without characters has no perplexity and fails the base rules; a null
language is one of its own; null and repeated ids keep their rows, each judged and
counted; a very long text has to fit a task; other columns are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, staged, text_slices, utf8_list

#: The symbols of the base rules.
SYMBOLS = b"#*$%&|<>"
ORDER, BITS = 3, 21
#: The group of all languages together, and of a null language; a language's own begins with LANGUAGE.
ALL, NO_LANGUAGE, LANGUAGE = "*", "-", "l:"

ENTRY_BYTES = 16

_classes: list[np.ndarray] = []


def lower_points() -> np.ndarray:
    """Each code point in lower case; 0 for white space."""
    if not _classes:
        table = np.arange(0x110000, dtype=np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isspace():
                table[cp] = 0
            elif c.isupper():
                table[cp] = ord(c.lower()[0])
        _classes.append(table)
    return _classes[0]


def char_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ORDER-grams of a slice of texts (blank before each, blank runs as one) and the text of each."""
    lead = " " * (ORDER - 1)
    joined = "".join(lead + (t or "") for t in texts)
    points = lower_points()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)].astype(np.uint64)
    sizes = np.array([len(t or "") + ORDER - 1 for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = (points != 0) | (place < ORDER - 1) | np.concatenate([[True], points[:-1] != 0])
    keep &= ~((points == 0) & (place == ORDER - 1))  # white space that opens a text adds nothing to the lead
    points, of, place = points[keep], of[keep], place[keep]
    n = max(0, len(points) - ORDER + 1)
    packed = np.zeros(n, np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(BITS)) | points[k : k + n]
    real = place[ORDER - 1 :] >= ORDER - 1
    return packed[real].astype(np.int64), of[ORDER - 1 :][real]


def gram_counts(docs: DataFrame) -> DataFrame:
    """grp, g (packed ORDER-gram), c: counts over all texts of (grp, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)

        for batch in batches:
            for part in text_slices(batch, "text"):
                groups, texts = part.column("grp").to_pylist(), part.column("text").to_pylist()
                for group in set(groups):
                    grams, _ = char_grams([t for t, g in zip(texts, groups, strict=True) if g == group])
                    parts = held.setdefault(group, [])
                    parts.append(np.unique(grams, return_counts=True))
                    if len(parts) >= 16:
                        held[group] = [merged(parts)]
        for group, parts in held.items():
            keys, counts = merged(parts)
            if len(keys):
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(keys)), pa.array(keys), pa.array(counts)], names=["grp", "g", "c"])

    each = staged(docs.mapInArrow(run, "grp string, g long, c long").groupBy("grp", "g").agg(F.sum("c").alias("c")), "languages")
    return each.union(each.groupBy("g").agg(F.sum("c").alias("c")).select(F.lit(ALL), "g", "c"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """grp, n, g, value, backoff from ORDER-gram counts.

    ``value`` is the discounted share of an n-gram; ``backoff`` is the weight
    that the n-gram, as a context, gives to the next lower order.
    """
    mask = lambda n: F.col("g").bitwiseAND(F.lit((1 << BITS * n) - 1))
    counts = staged(counts, "counts")
    orders = [counts.select("grp", F.lit(ORDER).alias("n"), "g", "c")]
    for n in range(ORDER - 1, 0, -1):
        orders.append(orders[-1].groupBy("grp", mask(n).alias("g")).agg(F.count("*").alias("c")).select("grp", F.lit(n).alias("n"), "g", "c"))
    grams = orders[0]
    for o in orders[1:]:
        grams = grams.union(o)
    grams = staged(grams, "grams")
    few = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    sound = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    cut = lambda i: F.coalesce(F.when(sound, F.greatest(F.lit(0.05), F.least(F.lit(float(i)), i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))))), F.lit(0.5 * i))
    discounts = grams.groupBy("grp", "n").agg(*few).select("grp", "n", *[cut(i).alias(f"d{i}") for i in (1, 2, 3)])
    cutoff = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut_grams = grams.join(discounts, ["grp", "n"]).withColumn("cut", cutoff)  # a row for each group and order
    context = F.shiftright("g", BITS)
    contexts = cut_grams.groupBy("grp", "n", context.alias("context")).agg(F.sum("c").alias("total"), F.sum("cut").alias("freed"))
    values = cut_grams.withColumn("context", context).join(contexts, ["grp", "n", "context"]).select("grp", "n", "g", ((F.col("c") - F.col("cut")) / F.col("total")).alias("value"), F.lit(None).cast("double").alias("backoff"))
    backoffs = contexts.select("grp", F.col("n"), F.col("context").alias("g"), F.lit(None).cast("double").alias("value"), (F.col("freed") / F.col("total")).alias("backoff"))
    return values.union(backoffs)


class CharModel:
    """Sorted arrays of one language, or of one part of it: for each order n-grams with values and contexts with back-off weights."""

    def __init__(self, n: np.ndarray, g: np.ndarray, value: np.ndarray, backoff: np.ndarray, part: int = 0, parts: int = 1):
        self.values, self.backoffs, self.part, self.parts = [], [], part, parts
        for order in range(1, ORDER + 1):
            for x, table in ((value, self.values), (backoff, self.backoffs)):
                at = np.flatnonzero((n == order) & ~np.isnan(x))
                at = at[np.argsort(g[at], kind="stable")]
                table.append((g[at], x[at].astype(np.float32)))
        self.floor = 1 / (len(self.values[0][0]) + 1)  # an even share for characters never seen

    @staticmethod
    def look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, absent: float) -> np.ndarray:
        sorted_keys, x = table
        if not len(sorted_keys):
            return np.full(len(keys), absent)
        at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == keys, x[at], absent).astype(np.float64)

    def surprise(self, grams: np.ndarray) -> np.ndarray:
        """-ln p of the last character of each ORDER-gram; 0 for those of another part."""
        p = np.full(len(grams), self.floor)
        for order in range(1, ORDER + 1):
            keys = grams & ((1 << BITS * order) - 1)
            p = self.look_up(self.values[order - 1], keys, 0.0) + self.look_up(self.backoffs[order - 1], keys >> BITS, 1.0) * p
        mine = self.parts == 1 or part_of(grams >> BITS, self.parts) == self.part
        return np.where(mine, -np.log(np.maximum(p, 1e-300)), 0.0)


def part_of(context: np.ndarray, parts: int) -> np.ndarray:
    """Part of a model that a context belongs to, by its last letter."""
    return (context & ((1 << BITS) - 1)) % parts


def model_part(model: DataFrame, group: str, part: int, parts: int) -> CharModel:
    """Arrays of one part of a language's model; orders of one letter are in every part."""
    last = F.when(F.col("value").isNotNull(), F.shiftright("g", BITS)).otherwise(F.col("g"))
    mine = (F.col("n") == 1) | (F.pmod(last.bitwiseAND(F.lit((1 << BITS) - 1)), F.lit(parts)) == part)
    t = model.where((F.col("grp") == group) & mine).select("n", "g", "value", "backoff").toArrow()  # at most model_mb
    return CharModel(*(t.column(c).to_numpy() for c in ("n", "g")), *(t.column(c).cast(pa.float64()).to_numpy() for c in ("value", "backoff")), part, parts)


def base_features(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Counts of the base rules for a slice of texts."""
    w = Words(texts)
    lead = (w.data & 0xC0) != 0x80
    out = {"n_words": w.count, "word_chars": w.sums(w.inside & lead), "n_symbols": w.sums(np.isin(w.data, np.frombuffer(SYMBOLS, np.uint8)))}
    line_end = np.flatnonzero(w.data == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    wordy = np.searchsorted(w.start, line_end) > np.searchsorted(w.start, line_start)
    line_start, line_end = line_start[wordy], line_end[wordy]
    text = np.searchsorted(w.begins, line_start, side="right") - 1
    lines = pa.array([w.buffer[a:b] for a, b in zip(line_start.tolist(), line_end.tolist(), strict=True)], pa.binary()).dictionary_encode()
    line = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, first = np.unique(text * max(1, len(lines.dictionary)) + line, return_index=True)
    out["n_dup_lines"] = np.bincount(text, minlength=len(texts)) - np.bincount(text[first], minlength=len(texts))
    h, kinds = w.codes()
    n = max(0, len(h) - 2)
    at = np.flatnonzero(w.text_of[:n] == w.text_of[2:]) if n else np.zeros(0, np.int64)
    _, pair = np.unique(h[at] * kinds + h[at + 1], return_inverse=True)
    _, triple = np.unique(pair * kinds + h[at + 2], return_inverse=True)
    _, back, times = np.unique(triple * len(texts) + w.text_of[at], return_inverse=True, return_counts=True)
    at = at[times[back] > 1]
    repeated = np.zeros(len(h), bool)
    for k in range(3):
        repeated[at + k] = True
    out["n_repeat_words"] = np.bincount(w.text_of[repeated], minlength=len(texts))
    return {k: x.astype(np.int64) for k, x in out.items()}


def bands(judged: DataFrame, column: str, prior_docs: int) -> DataFrame:
    """lang_group, middle and spread of a column of thousandths, exact over all documents."""
    hist = judged.where(F.col(column).isNotNull()).groupBy("lang_group", F.col(column).alias("x")).agg(F.count("*").alias("times"))
    middle = hist.groupBy("lang_group").agg(F.percentile("x", F.lit(0.5), F.col("times")).alias("middle"), F.sum("times").alias("docs"))
    off = hist.join(middle, "lang_group").withColumn("off", F.abs(F.col("x") - F.col("middle")))
    own = off.groupBy("lang_group", "middle", "docs").agg(F.percentile("off", F.lit(0.5), F.col("times")).alias("own"))
    usual = off.agg(F.percentile("off", F.lit(0.5), F.col("times")).alias("usual"))
    spread = (F.col("docs") * F.col("own") + prior_docs * F.col("usual")) / (F.col("docs") + prior_docs)
    return own.crossJoin(F.broadcast(usual)).select("lang_group", F.col("middle").alias(f"{column}_middle"), F.greatest(spread, F.lit(5.0)).alias(f"{column}_spread"))  # usual is one row


def judge_quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    most_repeated: int = 50,
    low_width: float = 6.0,
    high_width: float = 15.0,
    full_chars: int = 2000,
    most_wider: float = 2.0,
    prior_docs: int = 100,
    model_mb: int = 256,
) -> DataFrame:
    """id, base features, base_failed, lang_group (the language; null is one of its own), log_ppl and all_ppl (thousandths), low, high, all_high (the bands), kept."""
    spark = docs.sparkSession
    group = F.coalesce(F.concat(F.lit(LANGUAGE), F.col(lang_col).cast("string")), F.lit(NO_LANGUAGE))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), group.alias("lang_group"))
    model = staged(kneser_ney(gram_counts(rows.select(F.col("lang_group").alias("grp"), "text"))), "model")
    sizes = {r.grp: r["count"] for r in model.groupBy("grp").count().collect()}  # a row for each language
    most = (model_mb << 20) // ENTRY_BYTES  # entries of a pass
    passes: list[list[tuple[str, int, int]]] = [[]]
    room = most
    for g, n in sorted(sizes.items()):
        parts = -(-n // most)
        for part in range(parts):
            if room < n // parts and passes[-1]:
                passes.append([])
                room = most
            passes[-1].append((g, part, parts))
            room -= n // parts
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    sums = ["own", "every", "grams"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text string, lang_group string, " + ", ".join(f"{n} long" for n in names) + ", own double, every double, grams long"

    def scored(now: DataFrame, members: list[tuple[str, int, int]], first: bool, last: bool) -> DataFrame:
        sent = spark.sparkContext.broadcast({g: model_part(model, g, part, parts) for g, part, parts in members})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = sent.value
            for batch in batches:
                for piece in text_slices(batch, "text"):
                    column = {n: piece.column(n) for n in piece.schema.names}
                    rows_ = piece.num_rows
                    if first:
                        column |= {n: pa.array(x) for n, x in base_features(utf8_list(column["text"])).items()}
                        column |= {"own": pa.array(np.zeros(rows_)), "every": pa.array(np.zeros(rows_)), "grams": pa.array(np.zeros(rows_, np.int64))}
                    texts, groups = column["text"].to_pylist(), column["lang_group"].to_pylist()
                    grams, of = char_grams(texts)
                    each, back = np.unique(grams, return_inverse=True)
                    own, every = (column[n].to_numpy().copy() for n in sums[:2])
                    if ALL in tables:
                        every += np.bincount(of, weights=tables[ALL].surprise(each)[back], minlength=rows_)
                    for g in set(groups) & set(tables):
                        mine = np.array([x == g for x in groups])[of]
                        used, to = np.unique(back[mine], return_inverse=True)
                        own += np.bincount(of[mine], weights=tables[g].surprise(each[used])[to], minlength=rows_)
                    column |= {"own": pa.array(own), "every": pa.array(every), "grams": pa.array(np.bincount(of, minlength=rows_))}
                    if last:
                        column["text"] = pa.nulls(rows_, pa.string())
                    yield pa.RecordBatch.from_arrays([column[n] for n in ("id", "text", "lang_group", *names, *sums)], names=["id", "text", "lang_group", *names, *sums])

        return now.mapInArrow(run, schema)

    judged = rows
    for k, members in enumerate(passes):
        judged = staged(scored(judged, members, not k, k == len(passes) - 1), "scored")
    milli = lambda x: F.when(F.col("grams") > 0, F.round(F.col(x) / F.col("grams") * 1000).cast("long"))
    judged = judged.withColumns({"log_ppl": milli("own"), "all_ppl": milli("every")})
    for column in ("log_ppl", "all_ppl"):
        judged = judged.join(F.broadcast(bands(judged, column, prior_docs)), "lang_group", "left")  # a row for each language
    wider = F.least(F.greatest(F.lit(1.0), F.sqrt(full_chars / F.greatest(F.col("word_chars"), F.lit(1)))), F.lit(most_wider))
    limit = lambda column, width: F.col(f"{column}_middle") + width * F.col(f"{column}_spread") * wider
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    named = F.col("lang_group").startswith(LANGUAGE)
    language = F.when(named, F.substr("lang_group", F.lit(len(LANGUAGE) + 1)))
    above = (F.col("log_ppl") > F.col("high")) & (F.col("all_ppl") > F.col("all_high"))
    return (
        judged.withColumn("low", limit("log_ppl", -low_width))
        .withColumn("high", limit("log_ppl", high_width))
        .withColumn("all_high", limit("all_ppl", high_width))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.coalesce((F.col("log_ppl") >= F.col("low")) & ~above, F.lit(False)))
        .select(F.col("id").alias(id_col), *names, "base_failed", "kept", language.alias("lang_group"), "log_ppl", "all_ppl", "low", "high", "all_high")
    )
