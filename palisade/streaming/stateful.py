"""Order-exact state on Structured Streaming: dedup, correlation, idempotency and rate limits.

All of them hold a row back until the watermark has passed its time, then take
the rows of a key in order of (time, tie), so that late rows (within the
watermark's delay) fall into place and the result is the batch's, whatever the
triggers.  Rows that come after the watermark are dropped by Spark, and are the
only ones missing.  A row that is let go in a trigger is newer than the trigger's
watermark for late rows, so these operators can stand one after the other in one
query; each needs its input's event time in column ``ts``.

State is a list for each key (what waits, many rows packed into an entry, since state
is paid for by the entry) and a value (what is remembered), with a timer at the first waiting row and one at the end of
the memory, which deletes it.  The state store must be RocksDB's
(``use_rocksdb``), which keeps state on disk and checkpoints what has changed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from datetime import timezone
from itertools import islice
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import correlate as co
from ..operators.correlate import correlation_keys
from ..operators.detect import level_number
from ..operators.folds import Step, leading, limiting

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _packed(df: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` columns, ``ts`` and everything as JSON in ``payload``."""
    return df.select(*kept, F.col("ts"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("payload"))


def _tie(df: DataFrame, name: str) -> Column:
    """A column as text that sorts as the column does (integers from 0 on are padded)."""
    text = F.col(name).cast("string")
    return F.lpad(text, 20, "0") if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint") else text


def _unpacked(df: DataFrame, schema: str | object, *more: str) -> DataFrame:
    """The payload's columns again (``ts`` itself carries the watermark), and ``more``."""
    row = F.from_json("payload", schema)
    names = [f.name for f in schema.fields]
    return df.withColumn("_row", row).select(*(F.col("ts") if n == "ts" else F.col(f"_row.`{n}`").alias(n) for n in names), *more)


PACKED_ROWS = 10_000


def _packs(rows: Iterable[tuple]) -> Iterator[tuple[bytes]]:
    """Entries of a list state: at most ``PACKED_ROWS`` rows (tuples of plain values) each."""
    rows = iter(rows)
    while part := list(islice(rows, PACKED_ROWS)):
        yield (pickle.dumps(part, 5),)


def _unpack(packs: Iterable[tuple[bytes]]) -> list[tuple]:
    return [row for (pack,) in packs for row in pickle.loads(pack)]


class _Waiting(StatefulProcessor):
    """Rows wait for the watermark; subclasses say what happens to them then."""

    fields: tuple[str, ...] = ("us", "tie", "ts", "payload")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")
        self.timer = handle.getValueState("timer", "at long")

    def _call(self, at_us: int) -> None:
        """A timer in the first millisecond by which a watermark has passed ``at_us``."""
        at = -(-at_us // 1000)
        now = self.timer.get()[0] if self.timer.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        self._wait(tuple(r[f] for f in self.fields) for r in rows)
        yield from ()

    def _wait(self, rows: Iterable[tuple]) -> None:
        rows, least = iter(rows), []
        while part := list(islice(rows, PACKED_ROWS)):
            self.rows.appendValue(*_packs(part))
            least.append(min(map(itemgetter(0), part)))
        self._call(min(least))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        held = _unpack(self.rows.get()) if self.rows.exists() else []
        ready = sorted((r for r in held if r[0] <= mark), key=itemgetter(0, 1))
        rest = [r for r in held if r[0] > mark]
        if ready:
            self.rows.put(list(_packs(rest))) if rest else self.rows.clear()
        yield from self.settle(key, ready)
        ends = self.remembered_until(key)
        if ends is not None and ends <= mark and not rest:
            self.forget()
            ends = None
        due = [r[0] for r in rest] + ([ends] if ends is not None else [])
        if due:
            self._call(max(min(due), mark + 1))

    def settle(self, key: tuple, ready: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def remembered_until(self, key: tuple) -> int | None:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Admission(_Waiting):
    """Lets a row pass if ``step`` says so of the times that it keeps of the key; ``memory_us`` after the last the key is forgotten."""

    def __init__(self, step: Step, memory_us: int):
        self.step, self.memory = step, memory_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getValueState("kept", "times array<long>")

    def settle(self, key: tuple, ready: list[tuple]) -> Iterator[Row]:
        times = list(self.kept.get()[0]) if self.kept.exists() else []
        for us, _, ts, payload in ready:
            yield Row(ts=ts, payload=payload, passed=bool(self.step(times, us)))
        self.kept.update((times,))

    def remembered_until(self, key: tuple) -> int | None:
        times = self.kept.get()[0] if self.kept.exists() else []
        return times[-1] + self.memory if times else None

    def forget(self) -> None:
        self.kept.clear()


def _admitted(df: DataFrame, key: Column, tie: str, step: Step, memory_us: int) -> DataFrame:
    packed = _packed(df, key.cast("string").alias("_key"), F.unix_micros("ts").alias("us"), _tie(df, tie).alias("tie"))
    out = packed.groupBy("_key").transformWithState(Admission(step, memory_us), "ts timestamp, payload string, passed boolean", "Append", "EventTime", eventTimeColumnName="ts")
    return _unpacked(out, df.schema, "passed")


def leading_edge(events: DataFrame, key: str, ttl_seconds: int, tie: str = "event_id", inclusive: bool = False) -> DataFrame:
    """As the batch operator: rows of which no kept row of the key is younger than the TTL (with ``inclusive``, as old as it)."""
    ttl = ttl_seconds * 1_000_000 + inclusive
    return _admitted(events, F.col(key), tie, leading(ttl), ttl).where("passed").drop("passed")


def rate_limited(actions: DataFrame, key: str, tie: str, most: int = 100, seconds: float = 1.0) -> DataFrame:
    """As the batch operator: adds ``admitted``."""
    width = int(seconds * 1_000_000)
    return _admitted(actions, F.col(key), tie, limiting(most, width), width + 1).withColumnRenamed("passed", "admitted")


SHOWN = "ts timestamp, event_id string, k int, n int, key string, level int, prior int, top int, mask int, low int, high int, critical int, payload string"
SHOWN_NAMES = [f.split()[0] for f in SHOWN.split(", ")]


class Window(_Waiting):
    """What the newest ``most`` events of a key in the last ``width_us`` show, for the events of one block of time.

    A group is a block of time and the keys of one hash, since state is paid for by the
    group; the events of the block before are sent to it as history.  It
    remembers at most ``most`` events of each key, until the block has ended.
    Rows come and go as data frames, which cost less than a ``Row`` each; times are told by
    ``us``, since a frame's have no zone.
    """

    fields = ("us", "tie", "payload", "level", "mask", "own", "k", "n", "key")

    def __init__(self, width_us: int, most: int):
        self.width, self.most = width_us, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "packed binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        self._wait(row for df in rows for row in zip(*(df[f].tolist() for f in self.fields), strict=True))
        yield from ()

    def settle(self, key: tuple, ready: list[tuple]) -> Iterator[pd.DataFrame]:
        if not ready:
            return
        past = _unpack(self.recent.get()) if self.recent.exists() else []
        rows = [(r[0], r[1], r[2], r[3], None) for r in past] + [(r[8], r[0], r[3], r[4], r) for r in ready]
        rows.sort(key=itemgetter(0))  # stable: the past of a key, then what is ready, in order
        ts, level, mask = np.array([r[1:4] for r in rows], np.int64).T
        names = [r[0] for r in rows]
        starts = np.array([True, *(x != y for x, y in zip(names, names[1:], strict=False))])
        facts = co.window_facts(np.cumsum(starts), ts, np.ones(len(ts), bool), level, mask, self.width, self.most)
        columns = [facts[n].tolist() for n in ("prior", "top", "mask", "low", "high", "critical")]
        shown = [
            (row[0], row[1], row[6], row[7], name, row[3], *found, row[2])
            for (name, _, _, _, row), found in zip(rows, zip(*columns, strict=True), strict=True)
            if row is not None and row[5]
        ]
        for at in range(0, len(shown), PACKED_ROWS):
            df = pd.DataFrame(shown[at : at + PACKED_ROWS], columns=SHOWN_NAMES)
            yield df.assign(ts=pd.to_datetime(df["ts"], unit="us", utc=True))
        ends = np.append(np.flatnonzero(starts)[1:], len(rows))
        newest = np.arange(len(rows)) >= np.repeat(ends, np.diff(ends, prepend=0)) - self.most
        self.recent.put(list(_packs(r[:4] for r, kept in zip(rows, newest, strict=True) if kept)))

    def remembered_until(self, key: tuple) -> int | None:
        return (key[1] + 1) * self.width if self.recent.exists() else None

    def forget(self) -> None:
        self.recent.clear()



class Gather(StatefulProcessor):
    """The rows of an event, one for each of its keys, as soon as all are there; a group is the events of one hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", SHOWN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        events: dict[str, list[tuple]] = {}
        for r in [*held, *(tuple(r[n] for n in SHOWN_NAMES) for r in rows)]:
            events.setdefault(r[1], []).append(r)
        rest = []
        for found in events.values():
            if len(found) < found[0][3]:
                rest += found
                continue
            payload = next((r[-1] for r in found if r[-1] is not None), None)
            yield Row(ts=found[0][0], payload=payload, keys=[tuple(r[2:3]) + tuple(r[4:12]) for r in sorted(found, key=lambda r: r[2])])
        if rest:
            self.rows.put(rest)
        elif held:
            self.rows.clear()

    def close(self) -> None:
        pass


class GatherFrames(Gather):
    """The same, with rows that come and go as data frames (with ``us``, their time)."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        zoned = (df.assign(ts=pd.to_datetime(df["us"], unit="us", utc=True)) for df in rows)
        each = (dict(zip(SHOWN_NAMES, row, strict=True)) for df in zoned for row in df[SHOWN_NAMES].itertuples(index=False, name=None))
        found = super().handleInputRows(key, each, timerValues)
        while part := list(islice(found, PACKED_ROWS)):
            keys = [[dict(zip(GATHERED_KEY, x, strict=True)) for x in r["keys"]] for r in part]
            yield pd.DataFrame({"ts": pd.to_datetime([r["ts"].astimezone(timezone.utc) for r in part], utc=True), "payload": [r["payload"] for r in part], "keys": keys})


GATHERED_KEY = ("k", "key", "level", "prior", "top", "mask", "low", "high", "critical")
GATHERED = "ts timestamp, payload string, keys array<struct<k:int,key:string,level:int,prior:int,top:int,mask:int,low:int,high:int,critical:int>>"


def correlate(events: DataFrame, window_seconds: int = 60, most: int = 100, groups: int = 128) -> DataFrame:
    """As the batch operator ``correlate``, for events with a time: the same columns, in any order of arrival.

    ``groups``: into how many groups of state the keys of a block of time, and the events, are dealt.
    """
    width = window_seconds * 1_000_000
    schema = events.schema
    keys = correlation_keys()
    facts = _packed(events, F.unix_micros("ts").alias("us"), _tie(events, "event_id").alias("tie"), level_number(F.col("detected_severity")).alias("level"), co.category_mask("threat_types").alias("mask"), keys.alias("_keys"))
    # an event without a key stands alone: one group of its own
    alone = F.array(F.concat(F.lit("event:"), F.col("tie")))
    keyed = facts.withColumn("_keys", F.when(F.size("_keys") > 0, F.col("_keys")).otherwise(alone)).withColumn("n", F.size("_keys"))
    each = keyed.select("us", "tie", "ts", "level", "mask", "n", "payload", F.posexplode("_keys").alias("k", "key"))
    block = F.floor(F.col("us") / width)
    sent = F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block + 1).alias("block"), F.lit(False).alias("own")))
    dealt = each.withColumn("_b", F.explode(sent)).select("us", "tie", "ts", "level", "mask", "k", "n", "key", F.col("_b.block").alias("block"), F.col("_b.own").alias("own"), F.when((F.col("k") == 0) & F.col("_b.own"), F.col("payload")).alias("payload"))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    shown = dealt.withColumn("bucket", bucket("key")).groupBy("bucket", "block").transformWithStateInPandas(Window(width, most), SHOWN, "Append", "EventTime", eventTimeColumnName="ts")
    gathered = shown.withColumn("bucket", bucket("event_id")).withColumn("us", F.unix_micros("ts")).groupBy("bucket").transformWithStateInPandas(GatherFrames(), GATHERED, "Append", "EventTime", eventTimeColumnName="ts")
    whole = _unpacked(gathered, schema, "keys")
    return co.concluded(whole, "keys", events.columns)
