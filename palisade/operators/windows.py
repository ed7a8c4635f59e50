"""Sliding windows that split hot keys, and ordered folds over keys.

A frame of the last ``w`` microseconds needs only the rows of the same and of
the previous block of length ``w``.  Every row is therefore sent to its own
block and to the next one, and windows are partitioned by key *and* block: a
key with a third of all rows becomes as many partitions as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import plan_bytes


def settled(df: DataFrame) -> DataFrame:
    """The same rows, each computed once before what follows.

    A filter on a column that took many expressions would be pushed below them,
    with the whole tree copied into it; the generator stops that and stays in
    whole-stage codegen.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def micros(ts: str | Column) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def blocked(df: DataFrame, ts_us: str, width_us: int) -> DataFrame:
    """Each row in its own block (``_own``) and, as history, in the next."""
    own = F.floor(F.col(ts_us) / width_us)
    return df.withColumn("_b", F.explode(F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), F.struct((own + 1).alias("block"), F.lit(False).alias("own"))))).select(*df.columns, F.col("_b.block").alias("_block"), F.col("_b.own").alias("_own"))


def sliding_totals(df: DataFrame, key: str, ts_us: str, width_us: int, sums: dict[str, Column], distinct: dict[str, str], task_bytes: int = 2 << 20) -> DataFrame:
    """Adds event_count, first_us, a sum for each of ``sums`` and a number of distinct values for each of ``distinct``.

    Of the last ``width_us`` (far end left out, the row's own time included) of
    the row's key.  A row is added at its time and taken away when it leaves, so
    that running totals do, whatever a window holds; a value leaves when it is
    seen again or when its last row leaves.
    """
    rows = blocked(df.select(*df.columns, *(c.cast("double").alias(f"_s_{n}") for n, c in sums.items())), ts_us, width_us)
    tasks = plan_bytes(df) // task_bytes  # a row becomes several changes, twice: tasks go by the input, not by the session's setting
    many = tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, key, "_block") if many else rows
    rows = rows.withColumn("_next", F.lead(ts_us).over(Window.partitionBy(key, "_block").orderBy(ts_us)))
    for n, c in distinct.items():
        again = F.lead(ts_us).over(Window.partitionBy(key, "_block", c).orderBy(ts_us))
        rows = rows.withColumn(f"_d_{n}", F.when(F.col(c).isNotNull(), F.least(F.coalesce(again, F.col(ts_us) + width_us), F.col(ts_us) + width_us)))
    payload = F.struct(*df.columns)
    none = F.lit(None).cast(rows.select(payload.alias("x")).schema["x"].dataType)
    names = ["n", *(f"_s_{n}" for n in sums), *(f"_d_{n}" for n in distinct)]

    def change(at: Column, deltas: dict[str, Column], row: Column = none, gone: Column = F.lit(None).cast("long")) -> Column:
        return F.struct(at.alias("at"), *(deltas.get(n, F.lit(0.0)).cast("double").alias(n) for n in names), row.alias("row"), gone.alias("gone"))

    plus = {"n": F.lit(1.0)} | {f"_s_{n}": F.coalesce(f"_s_{n}", F.lit(0.0)) for n in sums}
    seen = {f"_d_{n}": F.col(c).isNotNull().cast("double") for n, c in distinct.items()}
    leaves = change(F.col(ts_us) + width_us, {n: -x for n, x in plus.items()}, gone=F.col("_next"))
    parts = [change(F.col(ts_us), plus | seen, F.when(F.col("_own"), payload)), leaves]
    parts += [change(F.coalesce(f"_d_{n}", F.col(ts_us)), {f"_d_{n}": -seen[f"_d_{n}"]}) for n in distinct]
    changes = rows.select(F.col(key).alias("_key"), "_block", F.col(ts_us).alias("_ts"), F.inline(F.array(*parts)))
    changes = changes.repartition(tasks, "_key", "_block") if many else changes
    so_far = Window.partitionBy("_key", "_block").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    totals = changes.withColumns({f"_t_{n}": F.sum(n).over(so_far) for n in names} | {"_least": F.min("_ts").over(so_far), "_gone": F.max("gone").over(so_far)})
    kept = totals.where("row is not null")
    return kept.select(
        "row.*",
        F.col("_t_n").cast("long").alias("event_count"),
        F.coalesce("_gone", "_least").alias("first_us"),
        *(F.col(f"_t__s_{n}").alias(n) for n in sums),
        *(F.round(f"_t__d_{n}").cast("long").alias(n) for n in distinct),
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_block", "_own")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], needs: list[str], result: str, start: Callable[[], object], step: Callable[[object, tuple], object]) -> DataFrame:
    """Adds column ``result`` (DDL "name type"): ``step(state, values of needs)`` over the rows of each key in order.

    Rows stream through a sorted partition, with one state at a time; a key is never collected.
    """
    name = result.split()[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {result}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), None
        for part in parts:
            out = []
            for key, values in zip(part[keys].itertuples(index=False, name=None), part[needs].itertuples(index=False, name=None), strict=True):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != last:
                    last, state = key, start()
                out.append(step(state, values))
            yield part.assign(**{name: pd.Series(out, index=part.index, dtype=object)})

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
