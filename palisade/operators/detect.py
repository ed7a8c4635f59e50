"""Rule matching and the fusion of rules, model and anomaly into one detection."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import LEVELS, RULES, RULES_CORRECTED
from ..functions.text import excerpt
from .windows import settled

Rule = tuple[str, str, str]

#: Words of which a text that a rule hits has one at least (lower case), by the rule's place; none: the pattern decides alone.
HINTS: tuple[tuple[str, ...], ...] = (
    ("union", "select", "insert", "delete", "update"),
    ("table",),
    ("information_schema", "union", "="),
    ("waitfor", "pg_sleep", "benchmark", "dbms_pipe"),
    ("union", "select", "insert", "delete", "update", "drop", "alter"),
    ("<script", "javascript:", "onerror", "onload", "alert"),
    ("<iframe", "<object", "<embed", "document.", "window."),
    ("script", "="),
    ("document.", "window.", "alert", "prompt", "confirm"),
    ("expression", "eval", "fromcharcode"),
    (),
    ("/bin/", "/usr/", "cmd.exe", "powershell"),
    ("||", "&&", ";", "`", "$(", "-l", "-e"),
    ("/bin/", "cmd.exe", "powershell.exe", "wscript.exe"),
    ("..", "/etc/", "windows"),
    ("://",),
    ("localhost", "127.0.0.1", "192.168.", "10.", "172."),
    ("${",),
)


def rule_set(name: str = "v1", extra: Sequence[Rule] = ()) -> list[Rule]:
    """Rules by category order: v1 as published, v2 with the slipped patterns corrected; ``extra`` ones lead their category."""
    rules = [RULES_CORRECTED.get(i, r) if name == "v2" else r for i, r in enumerate(RULES)]
    order = list(dict.fromkeys(r[0] for r in RULES))
    return sorted([*usable_rules([r for r in extra if r[0] in order]), *rules], key=lambda r: order.index(r[0]))


def level_number(level: Column) -> Column:
    out = F.when(level == "critical", LEVELS["critical"])
    for name in ("high", "medium", "low"):
        out = out.when(level == name, LEVELS[name])
    return out


def level_name(number: Column) -> Column:
    return F.when(number >= 4, "critical").when(number >= 3, "high").when(number >= 2, "medium").otherwise("low")


def detection_text() -> Column:
    """Message, path, k=v of the query and cloud action, the non-empty ones, joined by blanks."""
    pairs = F.array_join(F.transform("query_params", lambda p: F.concat(p["key"], F.lit("="), p["value"])), " ")
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (F.col("message"), F.col("http_path"), pairs, F.col("cloud_action"))))


def usable_rules(rules: Sequence[Rule]) -> list[Rule]:
    """The rules whose pattern compiles; others are left out with a warning."""
    kept = []
    for rule in rules:
        try:
            re.compile(rule[2])
        except re.error as e:
            warnings.warn(f"rule pattern left out: {rule[2]!r} ({e})", stacklevel=2)
        else:
            kept.append(rule)
    return kept


#: The words of a pattern (see HINTS).
NEEDS = {r[2]: HINTS[i] for i, r in enumerate(RULES)} | {r[2]: HINTS[i] for i, r in RULES_CORRECTED.items()}


def _hit(text: Column, low: Column, pattern: str) -> Column:
    """A built-in pattern runs only on texts that have one of the words that it needs."""
    words = NEEDS.get(pattern, ())
    found = text.rlike(pattern)
    return reduce(lambda x, y: x | y, (low.contains(w) for w in words)) & found if words else found


def _rule_struct(i: int, rule: Rule) -> Column:
    return F.struct(F.lit(i + 1).alias("rule"), F.lit(rule[0]).alias("category"), F.lit(rule[1]).alias("severity"), F.lit(LEVELS[rule[1]]).alias("level"))


def rule_matches(text: Column, rules: Sequence[Rule]) -> Column:
    """Array of (rule, category, severity, level) of the rules that hit, in rule order: one pass, no join."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(_hit(text, low, r[2]), _rule_struct(i, r)) for i, r in enumerate(rules))))


MATCHES = "array<struct<rule:int,category:string,severity:string,level:int>>"


def with_rule_hits(df: DataFrame, text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``matches``, as ``rule_matches`` tells them, for many rows of which few have any.

    The text is put in lower case once, hits are bits of numbers in compiled code, and
    arrays (whose functions are interpreted) are made only where there is a bit.
    """
    low, size = F.col("_low"), 60
    lots = range(0, len(rules), size)
    bit = lambda i: F.when(_hit(F.col(text_col), low, rules[i][2]), F.lit(1 << i % size)).otherwise(F.lit(0)).cast("long")
    bits = {f"_hits{k}": reduce(lambda x, y: x + y, (bit(i) for i in range(k, min(k + size, len(rules))))) for k in lots}
    marked = df.withColumn("_low", F.lower(text_col)).withColumns(bits)
    found = lambda i: F.col(f"_hits{i // size * size}").bitwiseAND(F.lit(1 << i % size)) != 0
    every = F.array_compact(F.array(*(F.when(found(i), _rule_struct(i, rules[i])) for i in range(len(rules)))))
    some = reduce(lambda x, y: x | y, (F.col(name) != 0 for name in bits))
    return marked.withColumn("matches", F.when(some, every).otherwise(F.array().cast(MATCHES))).drop("_low", *bits)


def rules_per_category(rules: DataFrame) -> DataFrame:
    """category, rules: how many rules of a rule table there are of each."""
    return rules.groupBy("category").agg(F.count("*").alias("rules"))


def detect(events: DataFrame, rules: Sequence[Rule] | None = None, anomaly_threshold: float = 0.7) -> DataFrame:
    """Adds threat_types, matched_rules, severity of the detection, confidence, reason and excerpt.

    ml_score and anomaly_score are used if ``events`` has them.
    """
    ml = F.col("ml_score") if "ml_score" in events.columns else F.lit(None).cast("double")
    anomaly = F.col("anomaly_score") if "anomaly_score" in events.columns else F.lit(None).cast("double")
    score, odd = F.coalesce(ml, F.lit(0.0)), F.coalesce(anomaly, F.lit(0.0))
    df = with_rule_hits(events.withColumn("detection_text", detection_text()), "detection_text", rules or rule_set())
    categories = F.array_distinct(F.transform("matches", lambda m: m["category"]))
    more = F.array_compact(F.array(F.when(score > 0.8, F.lit("ml_anomaly")), F.when(odd > anomaly_threshold, F.lit("behavioral_anomaly"))))
    rule_level = F.coalesce(F.array_max(F.transform("matches", lambda m: m["level"])), F.lit(0)).cast("double")
    boosted = F.least(rule_level + F.when(score > 0.9, 1.0).when(score > 0.7, 0.5).otherwise(0.0), F.lit(4.0))
    boosted = F.least(boosted + F.when(odd > 0.8, 1.0).otherwise(0.0), F.lit(4.0))
    confidence = F.greatest(F.when(F.size("matches") > 0, 0.8).otherwise(0.0), F.when(score > 0.7, score).otherwise(0.0), F.when(odd > 0.7, 0.8 * odd).otherwise(0.0))
    names = F.transform("matches", lambda m, i: F.concat(m["category"], F.lit("_"), i.cast("string")))
    parts = F.array_compact(F.array(F.when(F.size("matches") > 0, F.concat(F.lit("matched rules: "), F.array_join(names, ", "))), F.when(score > 0.7, F.format_string("ml_score=%.2f", score)), F.when(odd > 0.7, F.format_string("anomaly_score=%.2f", odd))))
    return df.select(
        *events.columns, "detection_text", F.concat(categories, more).alias("threat_types"), names.alias("matched_rules"), F.transform("matches", lambda m: m["rule"]).alias("rule_numbers"),
        level_name(boosted).alias("detected_severity"), confidence.alias("confidence"), F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("no significant threats detected").alias("reason"),
        excerpt(F.col("detection_text")).alias("sanitized_excerpt"),
    )


def threats(detected: DataFrame) -> DataFrame:
    return settled(detected).where(F.size("threat_types") > 0)


def rule_statistics(df: DataFrame, text_col: str, rules: Sequence[Rule] | None = None) -> DataFrame:
    """rule, category, severity, hits: how many texts each rule hits (rules without a hit are left out)."""
    hit = df.select(F.explode(rule_matches(F.col(text_col), rules or rule_set())).alias("m"))
    return hit.groupBy("m.rule", "m.category", "m.severity").agg(F.count("*").alias("hits"))
