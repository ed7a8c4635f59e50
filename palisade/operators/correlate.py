"""Suppression, deduplication and correlation over keyed windows of event time.

Two correlations: ``correlate`` looks at the raw severities of earlier events
(running totals over the newest rows, any scale); ``correlate_exact`` feeds boosted severities back
and appends each event to its best key only (an ordered fold for each tenant,
so tenants are isolated from each other).
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import staged
from .detect import level_name, level_number
from .folds import RUN_ROWS, first_passing
from .windows import blocked, ordered_fold, settled

RULE_CATEGORIES = ("sqli", "xss", "command_injection", "path_traversal", "ssrf", "log4shell", "ml_anomaly", "behavioral_anomaly")


def fingerprint() -> Column:
    fields = (F.nullif(c, F.lit("")) for c in ("source_ip", "http_method", "http_path", "tenant", "severity"))
    return F.md5(F.concat_ws("|", *fields))


def suppress(events: DataFrame, suppressions: DataFrame, ts_us: str) -> DataFrame:
    """Events that no entry (target, expiry_us) covers; a target is an address or ``tenant:<name>``; expiry is exclusive."""
    by = suppressions.select("target", "expiry_us")
    covered = (F.col(ts_us) < F.col("expiry_us"))
    ip = events.join(by, (F.col("source_ip") == F.col("target")) & covered, "left_anti")
    return ip.join(by, (F.concat(F.lit("tenant:"), F.col("tenant")) == F.col("target")) & covered, "left_anti")


def suppressed(events: DataFrame, suppressions: DataFrame, ts_us: str) -> DataFrame:
    """The events that ``suppress`` takes out."""
    names = F.array(F.col("source_ip"), F.concat(F.lit("tenant:"), F.col("tenant")))
    by = suppressions.groupBy("target").agg(F.max("expiry_us").alias("expiry_us"))  # the last entry of a target covers most
    numbered = events.withColumn("_targets", F.array_compact(names))
    rows = numbered.join(by.alias("one"), F.element_at("_targets", 1) == F.col("one.target"), "left").withColumnRenamed("expiry_us", "_first").drop("target")
    rows = rows.join(by.alias("two"), F.try_element_at("_targets", F.lit(2)) == F.col("two.target"), "left").withColumnRenamed("expiry_us", "_second").drop("target")
    covered = (F.col(ts_us) < F.coalesce("_first", F.lit(-(1 << 62)))) | (F.col(ts_us) < F.coalesce("_second", F.lit(-(1 << 62))))
    return rows.where(covered).select(*events.columns)


def leading_edge(df: DataFrame, key: str, ts_us: str, tie: str, ttl_seconds: int, inclusive: bool = False, run_rows: int = RUN_ROWS) -> DataFrame:
    """Adds ``kept``: no kept row of the key is younger than the TTL (with ``inclusive``, as old as it).

    Dropped rows do not extend the TTL.  A key is as many tasks as it has pauses of
    a TTL, and more where it has ``run_rows`` rows without one (see ``folds``).
    """
    return first_passing(df, key, ts_us, tie, ttl_seconds * 1_000_000 + inclusive, run_rows)


def correlation_keys() -> Column:
    user = F.col("remote_user")
    named = (("ip", F.col("source_ip")), ("tenant", F.col("tenant")), ("session", F.col("session_id")), ("user", user), ("ua", F.substring(F.md5(F.nullif("http_user_agent", F.lit(""))), 1, 8)))
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}:"), c)) for n, c in named)))


def window_facts(groups: np.ndarray, ts: np.ndarray, timed: np.ndarray, level: np.ndarray, mask: np.ndarray, width_us: int, most: int) -> dict[str, np.ndarray]:
    """What the window of each row shows: prior events, the highest level, categories (bits), and prior events by level.

    Rows are in order of (group number, time).  A window begins at the row ``lo``; what
    it holds are differences of running totals, so a row costs the same whatever its window holds.
    """
    n = len(ts)
    at = np.arange(n)
    _, rank = np.unique(np.concatenate([ts, ts - width_us]), return_inverse=True)
    place = groups * (2 * n + 1)
    lo = np.searchsorted(place + rank[:n], place + rank[n:])  # a row's own group begins before it, and so does the window
    lo = np.where(timed, np.maximum(lo, at - most), at)
    held = lambda hit: (total := np.concatenate([[0], np.cumsum(hit)]))[at] - total[lo]
    by_level = {x: held(level == x) for x in (1, 2, 3, 4)}
    top = level.copy()
    for x, count in by_level.items():
        top = np.where(count > 0, np.maximum(top, x), top)
    types = mask.copy()
    for i in range(len(RULE_CATEGORIES)):
        types |= np.where(held(mask >> i & 1) > 0, 1 << i, 0)
    return {"prior": at - lo, "top": top, "mask": types, "low": by_level[1], "high": by_level[3], "critical": by_level[4]}


def _with_window_facts(slim: DataFrame, width_us: int, most: int) -> DataFrame:
    """(event_id, fact) of each row (event_id, _ts, _level, _mask, _k, _key): blocks of a key in order, in Arrow batches.

    A batch takes along the last ``most`` rows of the batch before.
    """
    rows = blocked(slim, "_ts", width_us)

    def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, past = None, {}
        for batch in parts:
            if not batch.num_rows:
                continue
            names = {"ts": "_ts", "level": "_level", "mask": "_mask"}
            now = {n: numbers(batch, c) for n, c in names.items()} | {"timed": batch.column("_ts").is_valid().to_numpy(zero_copy_only=False)}
            key, block = batch.column("_key").dictionary_encode().indices.to_numpy(), numbers(batch, "_block")
            starts = (np.diff(key, prepend=key[0]) != 0) | (np.diff(block, prepend=block[0]) != 0) | (np.diff(now["timed"].astype(np.int8), prepend=now["timed"][0]) != 0)
            ident = lambda i: (batch.column("_key")[i].as_py(), batch.column("_block")[i].as_py())
            held = len(past["ts"]) if last == ident(0) else 0
            groups = np.concatenate([np.zeros(held, np.int64), np.cumsum(starts)])
            whole = {n: np.concatenate([past[n], x]) if held else x for n, x in now.items()}
            facts = window_facts(groups, **whole, width_us=width_us, most=most)
            own = batch.column("_own")
            found = {n: pa.array(x[held:].astype(np.int32)) for n, x in facts.items()}
            found["top"] = pa.array(facts["top"][held:].astype(np.int32), mask=facts["top"][held:] == 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("event_id", "_k", "_key", "_level")), *found.values()], names=["event_id", "k", "key", "level", *found]).filter(own)
            last, mine = ident(-1), groups == groups[-1]
            past = {n: x[mine][-most:] for n, x in whole.items()}

    kind = slim.schema["event_id"].dataType.simpleString()
    schema = f"event_id {kind}, k int, key string, level int, prior int, top int, mask int, low int, high int, critical int"
    # event_id tells rows of one time apart
    ordered = rows.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_ts", "event_id")
    shown = ordered.mapInArrow(run, schema)
    return shown.select("event_id", F.struct(*(F.col(c) for c in shown.columns[1:])).alias("fact"))


def correlate(events: DataFrame, ts_us: str, window_seconds: int = 60, most: int = 100) -> DataFrame:
    """Adds window_hits, window_types, correlated, correlation_reasons, final_severity, correlation_id, best_key.

    A window holds the ``most`` newest events of a key before the event (in order
    of time and id), as far as they lie in the last ``window_seconds`` (far end
    included).  Of an event's keys the one with the most hits wins; on ties a
    later one only if it correlates.  ``events`` are read twice: a table that is
    long in the making should be staged.
    """
    width = window_seconds * 1_000_000
    base = events.withColumn("_level", level_number(F.col("detected_severity"))).withColumn("_keys", correlation_keys())
    slim = base.select("event_id", F.col(ts_us).alias("_ts"), "_level", category_mask("threat_types").alias("_mask"), F.posexplode("_keys").alias("_k", "_key"))
    keys = _with_window_facts(slim, width, most).groupBy("event_id").agg(F.collect_list("fact").alias("_facts"))  # five at most
    return concluded(base.drop("_level", "_keys").join(keys, "event_id", "left"), "_facts", events.columns)


def category_mask(types: str) -> Column:
    """Categories as bits."""
    bits = [F.when(F.array_contains(types, c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(RULE_CATEGORIES)]
    return reduce(lambda x, y: x + y, bits)


def _reasons(x: Column) -> Column:
    """Why the window of a key correlates."""
    high_now = (x["level"] >= 3).cast("int")
    return F.array_compact(
        F.array(
            F.when(F.bit_count(x["mask"]) >= 2, F.lit("multiple threat types")),
            F.when(x["prior"] >= 5, F.lit("high frequency")),
            F.when(x["high"] + x["critical"] + high_now >= 2, F.lit("multiple high severity events")),
            F.when((x["prior"] >= 3) & (((x["low"] > 0) & (x["high"] > 0)) | (x["critical"] > 0)), F.lit("severity escalation")),
        )
    )


def concluded(events: DataFrame, facts: str, columns: list[str]) -> DataFrame:
    """What the windows of an event's keys (array of structs k, key, level, prior, top, mask, low, high, critical) say of it.

    Of the keys the one with the most hits wins, then the last that correlates, then the first.
    """

    def ranked(x: Column) -> Column:
        go = F.size(_reasons(x)) > 0
        return F.struct(x["prior"].alias("prior"), go.cast("int").alias("go"), F.when(go, x["k"]).otherwise(-x["k"]).alias("k"), x.alias("x"))

    alone = F.coalesce(F.size(facts), F.lit(0)) <= 0
    known = F.filter(facts, lambda x: ~x["key"].startswith("event:"))
    best = events.withColumn("_best", F.when(~alone, F.array_max(F.transform(known, ranked))["x"]))
    judged = settled(best).withColumn("_why", F.when(F.col("_best").isNotNull(), _reasons(F.col("_best"))))
    b = lambda name: F.col(f"_best.{name}")
    go = F.coalesce(F.size("_why") > 0, F.lit(False))
    level = level_number(F.col("detected_severity"))
    final = F.least(F.coalesce(b("top"), level) + go.cast("int"), F.lit(4))
    types = F.array_compact(F.array(*(F.when(b("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(RULE_CATEGORIES))))
    single = F.concat(F.lit("single_"), F.substring(F.col("event_id").cast("string"), 1, 8))
    return judged.select(
        *columns,
        F.coalesce(b("prior") + 1, F.lit(1)).alias("window_hits"),
        F.when(b("key").isNull(), F.col("threat_types")).otherwise(types).alias("window_types"),
        go.alias("correlated"),
        F.coalesce("_why", F.array().cast("array<string>")).alias("correlation_reasons"),
        level_name(final).alias("final_severity"),
        F.when(go, F.concat(F.lit("corr_"), F.substring(F.md5(b("key")), 1, 12))).otherwise(single).alias("correlation_id"),
        b("key").alias("best_key"),
    )


def uncorrelated(events: DataFrame) -> DataFrame:
    """The columns of ``correlate`` for events that have no place in time: each stands alone."""
    return events.select(
        *events.columns,
        F.lit(1).alias("window_hits"),
        F.col("threat_types").alias("window_types"),
        F.lit(False).alias("correlated"),
        F.array().cast("array<string>").alias("correlation_reasons"),
        F.col("detected_severity").alias("final_severity"),
        F.concat(F.lit("single_"), F.substring(F.col("event_id").cast("string"), 1, 8)).alias("correlation_id"),
        F.lit(None).cast("string").alias("best_key"),
    )


EXACT = "exact struct<window_hits:int,window_types:array<string>,correlated:boolean,final_severity:string,best_key:string,correlation_id:string>"


class _Held:
    """The newest events that a key holds, and how many of each level and category: what leaves is subtracted."""

    def __init__(self):
        self.events: deque = deque()
        self.levels = [0] * 5
        self.types: dict[str, int] = {}

    def drop(self) -> None:
        _, level, types = self.events.popleft()
        self.levels[level] -= 1
        for t in types:
            self.types[t] -= 1
            if not self.types[t]:
                del self.types[t]

    def add(self, ts: int, level: int, types: tuple, most: int) -> None:
        if len(self.events) == most:
            self.drop()
        self.events.append((ts, level, types))
        self.levels[level] += 1
        for t in types:
            self.types[t] = self.types.get(t, 0) + 1

    def since(self, start: int) -> None:
        while self.events and not self.events[0][0] >= start:  # a missing time (NaN) is in no window
            self.drop()

    def union(self, own: tuple) -> tuple:
        """Own categories, then the others in order of the events; ends when all are seen."""
        found = dict.fromkeys(own)
        missing = len(self.types.keys() - found.keys())
        for _, _, types in self.events if missing else ():
            size = len(found)
            found.update(dict.fromkeys(types))
            missing -= len(found) - size
            if not missing:
                break
        return tuple(found)


def correlate_exact(events: DataFrame, ts_us: str, window_seconds: int = 60, most: int = 100) -> DataFrame:
    """Adds struct ``exact``: as correlate, with feedback, in order of time within each tenant.

    An event costs the same whatever its windows hold; keys without an event in
    the window are forgotten whenever their number has doubled.
    """
    width = window_seconds * 1_000_000
    number = {"critical": 4, "high": 3, "medium": 2, "low": 1}
    names = {v: k for k, v in number.items()}

    class State:
        def __init__(self):
            self.keys: dict[str, _Held] = {}
            self.bound = 10_000

    def step(state: State, values: tuple) -> dict:
        event_id, ts, severity, types, keys = values
        if not len(keys):
            return {"window_hits": 1, "window_types": list(types), "correlated": False, "final_severity": severity, "best_key": None, "correlation_id": "single_" + str(event_id)[:8]}
        own, level, types = number[severity], 0, tuple(dict.fromkeys(types))
        best = None
        for key in keys:
            held = state.keys.get(key)
            if held is None:
                held = _Held()
            else:
                held.since(ts - width)
            prior, levels = len(held.events), held.levels
            high = levels[3] + levels[4] + (own >= 3)
            several = len(types) >= 2 or len(held.types) >= 2 or len(held.types.keys() | set(types)) >= 2
            go = several or prior >= 5 or high >= 2 or (prior >= 3 and ((levels[1] > 0 and levels[3] > 0) or levels[4] > 0))
            if best is None or prior > best[1] or (prior == best[1] and go):
                level = max([own, *(x for x in (1, 2, 3, 4) if levels[x])])
                best = (key, prior, held, go, level)
        key, prior, held, go, top = best
        union = held.union(types)
        final = min(top + go, 4)
        state.keys.setdefault(key, held).add(ts, final, union, most)
        if len(state.keys) > state.bound:
            for old in [k for k, x in state.keys.items() if not x.events or x.events[-1][0] < ts - width]:
                del state.keys[old]
            state.bound = max(10_000, 2 * len(state.keys))
        mark = "corr_" + hashlib.md5(key.encode()).hexdigest()[:12] if go else "single_" + str(event_id)[:8]
        return {"window_hits": prior + 1, "window_types": list(union), "correlated": bool(go), "final_severity": names[final], "best_key": key, "correlation_id": mark}

    events = staged(events, "threats")
    # only what the fold needs goes through Python; the rest is joined back
    slim = events.select("event_id", "tenant", F.col(ts_us).alias("_us"), "detected_severity", "threat_types", correlation_keys().alias("_keys"))
    folded = ordered_fold(slim, ["tenant"], ["_us", "event_id"], ["event_id", "_us", "detected_severity", "threat_types", "_keys"], EXACT, State, step)
    return events.join(folded.select("event_id", "exact"), "event_id")


def active_correlations(correlated: DataFrame, ts_us: str) -> DataFrame:
    """best_key, event_count, latest_us, types, max_severity, by count."""
    types = F.array_sort(F.array_distinct(F.flatten(F.collect_set("threat_types"))))
    out = correlated.where("best_key is not null").groupBy("best_key").agg(F.count("*").alias("event_count"), F.max(ts_us).alias("latest_us"), types.alias("types"), level_name(F.max(level_number(F.col("final_severity")))).alias("max_severity"))
    return out.orderBy(F.desc("event_count"), "best_key")


def correlation_statistics(correlated: DataFrame, suppressed: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """One row: events, how many correlated, how many were suppressed or dropped as duplicates (counted from those tables), and their rates."""
    n = F.coalesce(F.sum(F.col("correlated").cast("long")), F.lit(0))
    parts = [correlated.agg(F.count("*").alias("total_events"), n.alias("correlated_events"))]
    for name, rows in (("suppressed_events", suppressed), ("duplicate_events", duplicates)):
        none = F.lit(0).cast("long").alias(name)
        parts.append(correlated.sparkSession.range(1).select(none) if rows is None else rows.agg(F.count("*").alias(name)))
    one = reduce(lambda x, y: x.join(y.withColumn("_one", F.lit(1)), "_one"), parts[1:], parts[0].withColumn("_one", F.lit(1)))  # a row each
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total_events")), F.lit(0.0))
    return one.select("total_events", "correlated_events", "suppressed_events", "duplicate_events", rate("correlated_events").alias("correlation_rate"), rate("suppressed_events").alias("suppression_rate"), rate("duplicate_events").alias("duplicate_rate"))
