"""Labels against findings: joins, confusion counts, weighted scores, grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched_labels(labels: DataFrame, findings: DataFrame, types: str, key: str, found: bool = True) -> DataFrame:
    """Labels that share a type with a finding of the same key (``found=False``: those that share none)."""
    seen = findings.select(F.col(key).alias("_key"), F.explode(types).alias("_type")).distinct()
    wanted = labels.select(key, F.explode(types).alias("_type")).distinct()
    hit = wanted.join(seen, (F.col(key) == F.col("_key")) & wanted["_type"].eqNullSafe(seen["_type"]), "left_semi").select(F.col(key).alias("_hit")).distinct()
    return labels.join(hit, F.col(key) == F.col("_hit"), "left_semi" if found else "left_anti")


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn, tn, support-weighted precision, recall and F1, detection rate and false positive rate."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    c = df.agg(n(actual & predicted).alias("tp"), n(~actual & predicted).alias("fp"), n(actual & ~predicted).alias("fn"), n(~actual & ~predicted).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1 = lambda p, r: div(2 * p * r, p + r)
    p1, r1, p0, r0 = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fn), div(tn, tn + fp)
    pos, neg = tp + fn, tn + fp
    weighted = lambda a, b: div(a * pos + b * neg, pos + neg)
    return c.select("tp", "fp", "fn", "tn", weighted(p1, p0).alias("precision"), weighted(r1, r0).alias("recall"), weighted(f1(p1, r1), f1(p0, r0)).alias("f1"), r1.alias("detection_rate"), div(fp, neg).alias("false_positive_rate"))


def severe_confusion(df: DataFrame, level: str, actual: Column, predicted: Column) -> DataFrame:
    """confusion of the rows whose expected level is high or critical."""
    return confusion(df.where(F.col(level).isin("high", "critical")), actual, predicted)


def grade(scores: DataFrame) -> DataFrame:
    """total and grade from f1 (40), throughput (30), latency_ms (20) and memory_mb (10) against their targets."""
    part = lambda x, most: F.least(x, F.lit(1.0)) * most
    total = part(F.col("f1") / 0.85, 40) + part(F.col("throughput") / 5000, 30) + part(F.coalesce(F.try_divide(F.lit(15.0), F.col("latency_ms")), F.lit(1.0)), 20) + part(F.coalesce(F.try_divide(F.lit(600.0), F.col("memory_mb")), F.lit(1.0)), 10)
    return scores.withColumn("total", total).withColumn("grade", F.when(F.col("total") >= 90, "A").when(F.col("total") >= 80, "B").when(F.col("total") >= 70, "C").when(F.col("total") >= 60, "D").otherwise("F"))


def run_metrics(events: DataFrame, detected: DataFrame, actions: DataFrame, seconds: float) -> DataFrame:
    """One row: lines, threats, rule hits, actions and lines per second."""
    lines = events.agg(F.count("*").alias("total_lines"))
    found = detected.agg(F.coalesce(F.sum((F.size("threat_types") > 0).cast("long")), F.lit(0)).alias("threat_events"), F.coalesce(F.sum(F.size("matched_rules")), F.lit(0)).alias("rule_hits"))
    done = actions.agg(F.count("*").alias("actions_taken"))
    both = lines.withColumn("_", F.lit(1)).join(found.withColumn("_", F.lit(1)), "_").join(done.withColumn("_", F.lit(1)), "_").drop("_")
    return both.withColumn("duration_seconds", F.lit(float(seconds))).withColumn("throughput_lps", F.round(F.coalesce(F.try_divide(F.col("total_lines"), F.lit(float(seconds))), F.lit(0.0)), 2))
