"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold the same conversation several times, each snapshot longer
than the one before.  Every conversation gets rolling hashes of all its turn
prefixes: the exclusive or, over the turns so far, of a 128-bit hash of place,
role and text.  A conversation whose whole hash is a proper prefix hash of
another one goes (an anti-join); of equal conversations the smallest id stays.
What is left is rendered with role markers.

Only DataFrame functions are used.  A rendered conversation is one row, so one
conversation has to fit a task; prefix hashes are made distinct before they
meet, so a turn that opens very many conversations is one row in the joins.

Edge cases: turns are ordered by number (null last), then role and text;
exactly repeated turns of a conversation count once; a null role is rendered
as ``unknown`` and a null text as empty, and both differ from any other value;
rows with a null id form one conversation; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

START, END = "<|im_start|>", "<|im_end|>"


def collapse_snapshots(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each maximal conversation: id, n_turns, n_equal (copies of it), rendered."""
    rows = turns.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).distinct()
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    by_conv = Window.partitionBy("conv")
    placed = rows.withColumn("place", F.row_number().over(by_conv.orderBy(*order)))
    salted = [F.col("place"), F.col("role").isNull(), F.col("text").isNull(), F.col("role"), F.col("text")]
    so_far = by_conv.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    hashed = (
        placed.withColumn("x", F.xxhash64(*salted))
        .withColumn("y", F.xxhash64(F.lit(1), *salted))
        .withColumn("h", F.struct(F.bit_xor("x").over(so_far).alias("x"), F.bit_xor("y").over(so_far).alias("y")))
        .withColumn("n", F.count("*").over(by_conv))
    )
    prefixes = staged(hashed.select("conv", "place", "n", "h"), "prefixes")
    whole = prefixes.where("place = n").groupBy("h", "n").agg(F.min("conv").alias("conv"), F.count("*").alias("n_equal"))
    inner = prefixes.where("place < n").select("h", F.col("place").alias("n")).distinct()
    kept = whole.join(inner, ["h", "n"], "left_anti").select("conv", "n_equal")
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    chosen = placed.join(kept, placed["conv"].eqNullSafe(kept["conv"])).select(placed["conv"], "n_equal", F.struct("place", line.alias("line")).alias("part"))
    parts = F.array_sort(F.collect_list("part"))
    return chosen.groupBy("conv", "n_equal").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("rendered")).select(F.col("conv").alias(id_col), "n_turns", "n_equal", "rendered")
