"""Folds over the rows of a key in order of time, on as many tasks as the key needs.

Dedup folds keys side by side; a key of more than ``run_rows`` rows is cut into
sorted ranges (see ``passing_by_parts``).  Limits fold only times at which a key is crowded.
What they remember fades: after a pause as long as their memory, they start
anew, so that keys are cut into runs at such pauses (``ranges.with_runs``).  A run
of more than ``run_rows`` rows is cut further: see ``block_states``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from ..cluster import staged
from .ranges import PART, numbered, ranged, with_runs

#: Takes the times that are remembered (changed in place) and a row's time: does the row pass?
Step = Callable[[list[int], int], bool]
RUN_ROWS = 1_000_000


def leading(ttl_us: int) -> Step:
    """The first, then the first that is at least ``ttl_us`` after the last that passed."""

    def step(times: list[int], us: int) -> bool:
        if times and us - times[-1] < ttl_us:
            return False
        times[:] = [us]
        return True

    def whole(times: list[int], us: np.ndarray) -> np.ndarray:
        """As ``step`` over many times in order, in as many steps as pass."""
        out = np.zeros(len(us), bool)
        i = int(np.searchsorted(us, times[-1] + ttl_us)) if times else 0
        while i < len(us):
            out[i] = True
            times[:] = [int(us[i])]
            i = max(i + 1, int(np.searchsorted(us, us[i] + ttl_us)))
        return out

    step.whole = whole
    return step


def limiting(most: int, width_us: int) -> Step:
    """At most ``most`` that passed in the last ``width_us``, its far end included."""

    def step(times: list[int], us: int) -> bool:
        gone = 0
        while gone < len(times) and us - times[gone] > width_us:
            gone += 1
        del times[:gone]
        if len(times) >= most:
            return False
        times.append(us)
        return True

    return step


def _and(schema: StructType, flag: str) -> StructType:
    return StructType([*schema.fields, StructField(flag, BooleanType())])


def _changes(batch: pa.RecordBatch, groups: list[str]) -> list[int]:
    """Where a group begins, but for the batch's first row."""
    new = np.zeros(batch.num_rows, bool)
    for g in groups:
        codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new).tolist()


def _passed(step: Step, times: list[int], us: pa.Array) -> np.ndarray:
    """What ``step`` says of a group's times in order; rows without a time pass."""
    if len(us) >= 64 and not us.null_count and hasattr(step, "whole"):
        return step.whole(times, us.to_numpy())
    return np.array([t is None or step(times, t) for t in us.to_pylist()], bool)


def folded(rows: DataFrame, groups: list[str], order: list[str], ts_us: str, step: Step, result: str) -> DataFrame:
    """Adds boolean ``result``: ``step`` over the rows of each group in order; rows without a time pass.

    Rows stream through sorted partitions; other columns pass by as Arrow arrays, untouched.
    """
    schema = _and(rows.schema, result)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, times = None, []
        for batch in parts:
            if not batch.num_rows:
                continue
            first = tuple(batch.column(g)[0].as_py() for g in groups)
            if first != last:
                times = []
            cuts = [0, *_changes(batch, groups), batch.num_rows]
            out = np.zeros(batch.num_rows, bool)
            for a, b in zip(cuts, cuts[1:], strict=False):
                times = [] if a else times
                out[a:b] = _passed(step, times, batch.column(ts_us).slice(a, b - a))
            last = tuple(batch.column(g)[-1].as_py() for g in groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, result])

    return rows.repartition(*groups).sortWithinPartitions(*groups, *order).mapInArrow(run, schema)


def split_long(rows: DataFrame, groups: list[str], run_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of up to ``run_rows`` rows, and of longer ones (None if there is none)."""
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("_size")).where(F.col("_size") > run_rows)
    long = staged(sizes.drop("_size"), "long")
    if long.isEmpty():
        return rows, None
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"l.{g}")) for g in groups]
    pick = lambda how: rows.alias("r").join(long.alias("l"), same, how)
    return pick("left_anti"), pick("left_semi")


def first_passing(df: DataFrame, key: str, ts_us: str, tie: str, ttl_us: int, run_rows: int = RUN_ROWS, parts: int | None = None) -> DataFrame:
    """Adds ``kept``: no kept row of the key is younger than ``ttl_us``; dropped rows do not extend it; rows without a time are kept.

    Keys of up to ``run_rows`` rows are folded side by side, longer ones by parts
    (see ``passing_by_parts``).  ``df`` is read twice: a table that is long in the making should be staged.
    """
    if ttl_us <= 0:
        return df.withColumn("kept", F.lit(True))
    short, long = split_long(df, [key], run_rows)
    out = folded(short, [key], [ts_us, tie], ts_us, leading(ttl_us), "kept")
    return out if long is None else out.unionByName(passing_by_parts(long, key, ts_us, tie, ttl_us, parts))


def passing_by_parts(rows: DataFrame, key: str, ts_us: str, tie: str, ttl_us: int, parts: int | None = None) -> DataFrame:
    """``first_passing`` for keys of any length: sorted ranges are folded side by side, whatever a key's length.

    The last time that passes in a part hangs on the first that passes there, which is
    known only when the parts before are done.  Each part tells it for every first
    time that is possible, those of its first TTL; neighbours soon share their
    chain, so that these are few.  A walk over them, part by part, tells what each part
    is handed, and the parts are folded from that.
    """
    full = [key, "_block"]
    cut = ranged(rows, [key], [ts_us, tie], parts).withColumnRenamed(PART, "_block")
    starts = staged(handed_times(part_exits(cut, full, ts_us, ttl_us), full, ttl_us), "starts")
    return folded_from(cut, starts, full, ts_us, tie, leading(ttl_us)).withColumnRenamed("admitted", "kept").drop("_block")


def exits_of(times: np.ndarray, ttl_us: int) -> tuple[np.ndarray, np.ndarray]:
    """For a part's times: up to which first passing time which time passes last."""
    t = np.unique(times)
    to = np.searchsorted(t, t + ttl_us)
    jump = np.where(to < len(t), to, np.arange(len(t)))
    while (jump[jump] != jump).any():
        jump = jump[jump]
    firsts = jump[: np.searchsorted(t, t[0] + ttl_us) + 1]  # what passed before is no later than the part's first time
    ends = np.flatnonzero(np.diff(firsts, append=-1))
    return t[ends], t[firsts[ends]]


def part_exits(rows: DataFrame, full: list[str], ts_us: str, ttl_us: int) -> DataFrame:
    """(key, _block, _upto, _exit): ``exits_of`` each part of a key; a part without a time has one row of nulls."""
    slim = rows.select(*full, ts_us).repartition(*full).sortWithinPartitions(*full, ts_us)
    schema = StructType([*slim.select(*full).schema.fields, StructField("_upto", LongType()), StructField("_exit", LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ident, kinds = [], None, None

        def told() -> pa.RecordBatch:
            times = np.concatenate(held)
            upto, last = exits_of(times, ttl_us) if len(times) else ([None], [None])
            columns = [pa.array([x] * len(upto), k) for x, k in zip(ident, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(upto, pa.int64()), pa.array(last, pa.int64())], [*full, "_upto", "_exit"])

        for batch in parts:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(g).type for g in full]
            cuts = [0, *_changes(batch, full), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                mine = tuple(batch.column(g)[a].as_py() for g in full)
                if held and mine != ident:
                    yield told()
                    held = []
                ident = mine
                held.append(batch.column(ts_us).slice(a, b - a).drop_null().to_numpy())
        if held:
            yield told()

    return slim.mapInArrow(run, schema)


def handed_times(exits: DataFrame, full: list[str], ttl_us: int) -> DataFrame:
    """(key, _block, _times): the time that passed last before each part, from ``part_exits``."""
    key = full[0]
    schema = StructType([*exits.select(*full).schema.fields, StructField("_times", ArrayType(LongType()))])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, block, given, last, found = object(), None, None, None, False
        for batch in parts:
            out = []
            for k, b, upto, end in zip(*(batch.column(c).to_pylist() for c in (*full, "_upto", "_exit")), strict=True):
                if k != mine:
                    mine, block, last = k, None, None
                if b != block:
                    block, given, found = b, last, False
                    out.append((k, b, [] if given is None else [given]))
                if not found and upto is not None and (given is None or upto >= given + ttl_us):
                    last, found = end, True
            kinds = [*(batch.schema.field(c).type for c in full), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [*full, "_times"])

    return exits.repartition(key).sortWithinPartitions(*full, "_upto").mapInArrow(run, schema)


def limited(df: DataFrame, keys: list[str], ts_us: str, tie: str, most: int, width_us: int, run_rows: int = RUN_ROWS, parts: int | None = None) -> DataFrame:
    """Adds ``admitted``: at most ``most`` admitted rows of a key in any ``width_us``; rejected rows don't count; rows without a time are admitted.

    Only crowded times are folded: a row whose block of ``width_us`` holds, with the block
    before, ``most`` rows of the key at most is admitted whatever else is.  ``df`` is read several times.
    """
    cell = F.floor(F.col(ts_us) / F.lit(width_us + 1))
    told = df.select(*keys, cell.alias("_cell")).groupBy(*keys, "_cell").agg(F.count("*").alias("_n")).where("_cell is not null")
    both = told.unionByName(told.withColumn("_cell", F.col("_cell") + 1)).groupBy(*keys, "_cell").agg(F.sum("_n").alias("_n"))
    crowded = staged(both.where(F.col("_n") > most).select(*keys, F.explode(F.array(F.col("_cell") - 1, "_cell")).alias("_cell")).distinct(), "crowded")
    if crowded.isEmpty():
        return df.withColumn("admitted", F.lit(True))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*keys, "_cell")]
    pick = lambda how: df.withColumn("_cell", cell).alias("r").join(crowded.alias("c"), same, how).drop("_cell")
    return pick("left_anti").withColumn("admitted", F.lit(True)).unionByName(_limited(pick("left_semi"), keys, ts_us, tie, most, width_us, run_rows, parts))


def _limited(df: DataFrame, keys: list[str], ts_us: str, tie: str, most: int, width_us: int, run_rows: int, parts: int | None) -> DataFrame:
    rows = staged(with_runs(df, keys, ts_us, tie, width_us + 1, parts), "runs")
    step = limiting(most, width_us)
    short, long = split_long(rows, [*keys, "_run"], run_rows)
    out = folded(short, [*keys, "_run"], [ts_us, tie], ts_us, step, "admitted")
    if long is not None:
        group = [*keys, "_run"]
        cut = numbered(long, group, [ts_us, tie], "_n", parts).withColumn("_block", F.floor((F.col("_n") - 1) / run_rows).cast("long")).drop("_n")
        out = out.unionByName(_by_blocks(staged(cut, "blocks"), group, ts_us, tie, step).drop("_block"))
    return out.drop("_run")


STATES = "_times array<long>"


def _by_blocks(rows: DataFrame, group: list[str], ts_us: str, tie: str, step: Step) -> DataFrame:
    """Folds runs that are cut into blocks of rows: each block gets what the block before remembers at its end.

    All blocks are folded side by side, at first with no memory; then those are
    folded again whose block before ended otherwise, until none did.  A round
    settles one block more of each run at least, and often all of them.
    """
    full = [*group, "_block"]
    starts = staged(rows.select(*full).distinct().withColumn("_times", F.array().cast("array<long>")), "starts")
    ends = staged(block_states(rows, starts, full, ts_us, tie, step), "ends")
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in full]
    while True:
        given = ends.withColumn("_block", F.col("_block") + 1)
        pairs = starts.alias("s").join(given.alias("g"), same("s", "g"), "left")
        told = F.coalesce("g._times", F.array().cast("array<long>"))
        renewed = staged(pairs.select(*(F.col(f"s.{c}").alias(c) for c in full), told.alias("_times"), (told != F.col("s._times")).alias("_new")), "starts")
        changed = renewed.where("_new").drop("_new")
        starts = renewed.drop("_new")
        if changed.isEmpty():
            return folded_from(rows, starts, full, ts_us, tie, step)
        mine = rows.alias("s").join(changed.alias("g"), same("s", "g"), "left_semi")
        redone = block_states(mine, changed, full, ts_us, tie, step)
        ends = staged(redone.unionByName(ends.alias("s").join(changed.alias("g"), same("s", "g"), "left_anti")), "ends")


def _with_starts(rows: DataFrame, starts: DataFrame, full: list[str], ts_us: str, tie: str) -> DataFrame:
    """Rows in order, each block led by a row that holds its start (``_lead``)."""
    leads = starts.select(*full, "_times", F.lit(True).alias("_lead"))
    both = rows.withColumn("_lead", F.lit(False)).unionByName(leads, allowMissingColumns=True)
    return both.repartition(*full).sortWithinPartitions(*full, F.desc("_lead"), ts_us, tie)


def block_states(rows: DataFrame, starts: DataFrame, full: list[str], ts_us: str, tie: str, step: Step) -> DataFrame:
    """(group, _block, _times): what is remembered at the end of each block."""
    slim = _with_starts(rows.select(*full, ts_us, tie), starts, full, ts_us, tie)
    schema = starts.schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, times = None, []
        arrow = None
        for batch in parts:
            columns = [batch.column(c).to_pylist() for c in (*full, "_lead", "_times", ts_us)]
            arrow = pa.schema([*(batch.schema.field(c) for c in full), ("_times", pa.list_(pa.int64()))])
            for *key, lead, given, us in zip(*columns, strict=True):
                if lead:
                    if block is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip((*full, "_times"), (*block, times), strict=True))], arrow)
                    block, times = tuple(key), list(given)
                else:
                    step(times, us)
        if block is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*full, "_times"), (*block, times), strict=True))], arrow)

    return slim.mapInArrow(run, schema)


def folded_from(rows: DataFrame, starts: DataFrame, full: list[str], ts_us: str, tie: str, step: Step) -> DataFrame:
    """Adds ``admitted``: the fold of each block from its start."""
    led = _with_starts(rows, starts, full, ts_us, tie)
    names = rows.columns
    schema = _and(rows.schema, "admitted")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: list[int] = []
        for batch in parts:
            lead = batch.column("_lead").to_numpy(zero_copy_only=False).astype(bool)
            out = np.zeros(batch.num_rows, bool)
            cuts = [-1, *np.flatnonzero(lead).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                times = list(batch.column("_times")[a].as_py()) if a >= 0 else times
                out[a + 1 : b] = _passed(step, times, batch.column(ts_us).slice(a + 1, b - a - 1))
            kept = batch.select(names).filter(pa.array(~lead))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out[~lead])], [*names, "admitted"])

    return led.mapInArrow(run, schema)
