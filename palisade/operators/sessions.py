"""Session features over the last seconds of a session, and history of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import numbered
from .windows import blocked, own_rows, sliding_totals


def session_key() -> Column:
    return F.coalesce(F.nullif("source_ip", F.lit("")), F.col("tenant"))


def session_features(events: DataFrame, key: str, ts_us: str, dims: dict[str, str], error: Column, length: Column, seconds: int = 60) -> DataFrame:
    """Nine features of the last ``seconds`` (far end left out) of the row's key.

    ``dims`` maps output names to columns whose distinct values are counted.
    Rows without a key or time have null features.
    """
    width = seconds * 1_000_000
    known = events.where(F.col(key).isNotNull() & F.col(ts_us).isNotNull())
    sums = {"_errors": error.cast("long"), "_lengths": length, "_measured": length.isNotNull().cast("long")}
    totals = sliding_totals(known, key, ts_us, width, sums, dims)
    span = (F.col(ts_us) - F.col("first_us")) / 1_000_000
    found = totals.select(
        *events.columns,
        "event_count",
        *dims,
        F.col("_errors").cast("long").alias("error_count"),
        F.try_divide("_lengths", "_measured").alias("avg_length"),
        span.alias("time_span"),
        F.when(span > 0, F.col("event_count") / span).otherwise(0.0).alias("requests_per_second"),
    )
    missing = events.where(F.col(key).isNull() | F.col(ts_us).isNull())
    return found.unionByName(missing, allowMissingColumns=True)


def with_history(df: DataFrame, key: str, order: list[str], column: str, rows: int = 1000, least: int = 10, parts: int | None = None) -> DataFrame:
    """history_size (rows so far, at most ``rows``), history_mean, history_std of a column; null below ``least`` rows.

    Rows are numbered within their key over sorted ranges and cut into blocks of
    ``rows`` numbers; a frame needs its own block and the one before, so a hot key is
    many groups of at most twice ``rows`` rows.  ``order`` should tell a key's rows apart.
    """
    blocks = blocked(numbered(df, [key], order, "_n", parts), "_n", rows)
    w = Window.partitionBy(key, "_block").orderBy("_n").rangeBetween(-(rows - 1), 0)
    n = F.count("*").over(w)
    enough = lambda x: F.when(n >= least, x.over(w))
    found = blocks.withColumns({"history_size": n, "history_mean": enough(F.avg(column)), "history_std": enough(F.stddev_pop(column))})
    return own_rows(found).drop("_n")
