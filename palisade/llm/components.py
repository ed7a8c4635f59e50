"""Connected components by alternating large-star and small-star steps.

Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, "Connected components
in MapReduce and beyond" (2014).  Each step is a minimum per node and a join;
minima are combined before the shuffle and Spark splits skewed join sides, so
a node with very many neighbours does no harm.  Every round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) of a bigint type to (id, component): the smallest id reachable.

    Ids without an edge to another id don't appear.  Self-loops, repeated and
    reversed edges are allowed; rows with a null end are ignored.
    """
    a, b = edges.columns
    start = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = staged(start.where("a <> b").distinct(), "edges")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    seen = now.agg(mark.alias("x")).first().x
    for _ in range(max_rounds):
        old, now = now, staged(_small_star(_large_star(now)), "edges")
        last, seen = seen, now.agg(mark.alias("x")).first().x
        drop_staged(old)
        if last == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
