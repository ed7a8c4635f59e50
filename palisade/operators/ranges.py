"""Order within a key without a task for each key: sorted ranges, and what they hand on.

A table is range-partitioned by (key, order), so its parts are even whatever the
keys are, and a hot key becomes many parts.  Windows run inside (part, key).  What
a row needs of earlier parts is a number or two: one row for each part is summed up
(as many rows as there are parts, however large the table), passed along the parts
in order, and joined to the rows of the part's first key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import staged

PART = "_part"


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """The rows, staged, with their part: all rows of a part come before those of the next in (keys, order).

    ``order`` should tell rows of a key apart; rows that are equal in all of it share a part.
    """
    cut = df.repartitionByRange(parts, *keys, *order) if parts else df.repartitionByRange(*keys, *order)
    return staged(cut.withColumn(PART, F.spark_partition_id()), "ranged")


def _key(keys: list[str]) -> Column:
    """The key as one value; a struct is never null, so nulls are a key like any other."""
    return F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)))


def inside(keys: list[str]) -> Window:
    return Window.partitionBy(PART, *keys)


def handed_on(df: DataFrame, keys: list[str], facts: dict[str, Column], fold: dict[str, str], backwards: bool = False) -> DataFrame:
    """One row for each part: ``_part``, ``_edge`` (its first key) and, for each fact, what the parts before tell of that key.

    ``facts`` are aggregates over a part's rows of one key; ``fold`` says how those of
    several parts are put together: ``sum``, or ``last`` (the nearest that is not null).
    ``backwards``: what the parts behind tell of the part's last key.
    """
    near, far = (F.max, F.min) if backwards else (F.min, F.max)
    edges = df.groupBy(PART).agg(near(_key(keys)).alias("_edge"), far(_key(keys)).alias("_other"))
    # only rows of the key that reaches into the next part matter
    reaching = df.join(F.broadcast(edges.select(PART, "_other")), PART).where(_key(keys) == F.col("_other"))  # one row a part
    told = reaching.groupBy(PART).agg(*(f.alias(n) for n, f in facts.items()))
    order = F.desc(PART) if backwards else F.asc(PART)
    so_far = Window.partitionBy("_other").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    how = {"sum": lambda n: F.sum(n).over(so_far), "last": lambda n: F.last(n, ignorenulls=True).over(so_far)}
    summed = edges.join(told, PART).select(PART, "_edge", "_other", *(how[fold[n]](n).alias(n) for n in facts))
    along = Window.orderBy(order)  # as many rows as parts
    same = F.lag("_other").over(along) == F.col("_edge")
    return summed.select(PART, "_edge", *(F.when(same, F.lag(n).over(along)).alias(n) for n in facts))


def with_handed(df: DataFrame, keys: list[str], handed: DataFrame, names: list[str]) -> DataFrame:
    """The rows with what their key was handed on: null but for the part's edge key."""
    joined = df.join(F.broadcast(handed), PART, "left")  # one row a part
    mine = _key(keys) == F.col("_edge")
    return joined.select(*df.columns, *(F.when(mine, F.col(n)).alias(n) for n in names))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n", parts: int | None = None) -> DataFrame:
    """Adds ``name``: the number of the row within its key, from 1, in ``order``."""
    cut = ranged(df, keys, order, parts)
    handed = handed_on(cut, keys, {"_before": F.count("*")}, {"_before": "sum"})
    rows = with_handed(cut, keys, handed, ["_before"])
    own = F.row_number().over(inside(keys).orderBy(*order))
    return rows.withColumn(name, own + F.coalesce("_before", F.lit(0))).drop("_before", PART)


def with_runs(df: DataFrame, keys: list[str], ts_us: str, tie: str, gap_us: int, parts: int | None = None) -> DataFrame:
    """Adds ``_run``: the time at which the row's run began; a run ends where its key has no row for ``gap_us`` or more."""
    cut = ranged(df, keys, [ts_us, tie], parts)
    handed = handed_on(cut, keys, {"_last": F.max(ts_us)}, {"_last": "last"})
    order = inside(keys).orderBy(ts_us, tie)
    rows = with_handed(cut, keys, handed, ["_last"])
    before = F.coalesce(F.lag(ts_us).over(order), "_last")
    starts = before.isNull() | (F.col(ts_us) - before >= gap_us)
    flagged = rows.withColumn("_start", F.when(starts, F.col(ts_us))).drop("_last")
    began = handed_on(flagged, keys, {"_began": F.max("_start")}, {"_began": "last"})
    rows = with_handed(flagged, keys, began, ["_began"])
    run = F.last("_start", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", F.coalesce(run, "_began")).drop("_start", "_began", PART)
