"""Repeated byte windows by the distributed difference-cover algorithm.

Every document is a string of its own; its end sorts before any byte.

1. Sampled triples: at positions with residue 1 or 2 modulo 3, the triples of
   symbols are range-partitioned, sorted and named by dense rank.
2. Recursion on names: the names at residue 1 and those at residue 2 are two
   shorter strings, ranked the same way.  Only ``window`` bytes of a suffix
   matter, so the recursion ends when a name stands for so many (five levels for 100).
3. Merge: a remaining suffix (residue 0) is told from samples of residue 1 by
   (symbol, rank of the next) and from those of residue 2 by (two symbols, rank
   after them).  The largest sample that is not above it, a running maximum over
   each of the two sorted unions, gives its place among the samples.
4. Adjacent prefixes: in the final order windows that are equal are neighbours;
   each is compared with the one before by its 128-bit digest, and all of a run but
   the first by (doc, start) are repeats.

It is the named method in full, with a row for each byte at every level: the
README has its measured cost, which is why the registered query uses
``repeats`` instead.  Ranks and running maxima are made in range partitions, with
one row for each partition carried over, never in one task.

Edge cases: as in ``byte_repeats``, but ids must be unique (rows that share one
are rejected by no check); an empty table gives no ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digests, staged, text_slices, utf8_list

STRING = ["doc", "path"]
PLACE = [*STRING, "p"]
#: Positions in one Arrow batch.
AT_ONCE = 1 << 16


def symbols(docs: DataFrame, window: int) -> DataFrame:
    """doc, path, p, c (byte + 1) and w, the digest of the window that starts there (null near the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc, text in zip(part.column("doc").to_pylist(), utf8_list(part.column("text")), strict=True):
                    text = text or b""
                    for at in range(0, len(text), AT_ONCE):
                        places = np.arange(at, min(at + AT_ONCE, len(text)))
                        c = np.frombuffer(text, np.uint8)[at : at + len(places)].astype(np.int64) + 1
                        whole = places[places + window <= len(text)].tolist()
                        w = digests((text[a : a + window] for a in whole), len(whole)).tobytes()
                        w = [w[i : i + 16] for i in range(0, len(w), 16)] + [None] * (len(places) - len(whole))
                        columns = [pa.array(np.full(len(places), doc)), pa.array(np.ones(len(places), np.int32)), pa.array(places), pa.array(c), pa.array(w, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc", "path", "p", "c", "w"])

    return docs.mapInArrow(run, "doc long, path int, p long, c long, w binary")


def sorted_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """Range partitions of the order, numbered in ``_part``; rows that tie share one."""
    return staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "parts")


def dense_ranks(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the dense rank (from 1) over the whole table."""
    local = staged(sorted_parts(df, order).withColumn("_local", F.dense_rank().over(Window.partitionBy("_part").orderBy(*order))), "ranks")
    sizes = local.groupBy("_part").agg(F.max("_local").alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def running_max(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the greatest value up to the row and those that tie with it (0 if none), and whether one of the tied has a value."""
    parts = sorted_parts(df, order)
    so_far = Window.partitionBy("_part").orderBy(*order)
    tied = Window.partitionBy("_part", *order)
    most = parts.groupBy("_part").agg(F.max(value).alias("_n"))
    before = most.select("_part", F.max("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    local = parts.withColumns({"_local": F.max(value).over(so_far), f"{name}_tied": F.max(value).over(tied).isNotNull()})
    best = F.coalesce(F.greatest("_local", "_before"), F.lit(0))
    return local.join(F.broadcast(before), "_part").withColumn(name, best).drop("_part", "_local", "_before")


def ranked(strings: DataFrame, levels: int) -> DataFrame:
    """doc, path, p and the dense rank of the suffix by its first 3 ** (levels + 1) symbols at least; ``strings`` has (doc, path, p, c), c above 0."""
    along = Window.partitionBy(*STRING).orderBy("p")
    ahead = lambda c, n: F.coalesce(F.lead(c, n).over(along), F.lit(0))
    triples = strings.select(*PLACE, "c", ahead("c", 1).alias("c1"), ahead("c", 2).alias("c2"))
    named = dense_ranks(triples.where("p % 3 > 0"), ["c", "c1", "c2"], "name")
    if levels:
        child = staged(named.select("doc", (F.col("path") * 2 + F.col("p") % 3 - 1).cast("int").alias("path"), F.floor(F.col("p") / 3).alias("p"), F.col("name").alias("c")), "names")
        deeper = ranked(child, levels - 1)
        parent = (F.floor(F.col("path") / 2)).cast("int")
        sample = deeper.select("doc", parent.alias("path"), (F.col("p") * 3 + F.col("path") % 2 + 1).alias("p"), F.col("rank").alias("r"))
    else:
        sample = named.select(*PLACE, F.col("name").alias("r"))
    met = triples.drop("c2").join(sample, PLACE, "left")
    met = staged(met.select("*", ahead("r", 1).alias("r1"), ahead("r", 2).alias("r2"), (F.col("p") % 3).alias("m")), "samples")

    def below(residue: int, order: list[str], name: str) -> DataFrame:
        return running_max(met.where(F.col("m").isin(0, residue)), order, "r", name).where("m = 0").select(*PLACE, name, f"{name}_tied")

    rest = met.where("m = 0").select(*PLACE, "c", "r1")
    rest = rest.join(below(1, ["c", "r1"], "one"), PLACE).join(below(2, ["c", "c1", "r2"], "two"), PLACE)
    equal = F.col("one_tied") | F.col("two_tied")
    own = lambda c: F.when(~equal, F.col(c)).otherwise(F.lit(0))
    rest = rest.select(*PLACE, F.greatest("one", "two").alias("k0"), (~equal).cast("int").alias("k1"), own("c").alias("k2"), own("r1").alias("k3"))
    zero = F.lit(0).cast("long")
    samples = met.where("m > 0").select(*PLACE, F.col("r").alias("k0"), F.lit(0).alias("k1"), zero.alias("k2"), zero.alias("k3"))
    return dense_ranks(samples.unionByName(rest), ["k0", "k1", "k2", "k3"], "rank").select(*PLACE, "rank")


def levels_for(window: int) -> int:
    """Recursions after which a name stands for a whole window."""
    levels = 0
    while 3 ** (levels + 1) < window:
        levels += 1
    return levels


def repeated_ranges(docs: DataFrame, window: int, within: bool = True) -> DataFrame:
    """doc, start, end of ranges covered by windows that also start earlier; ``docs`` has (doc long, text) with unique ids."""
    rows = staged(symbols(docs, window), "symbols")
    order = ranked(rows.drop("w"), levels_for(window))
    windows = sorted_parts(rows.where("w is not null").select(*PLACE, "w").join(order, PLACE).drop("path"), ["rank"])
    first_of = windows.groupBy("_part").agg(F.min_by("w", "rank").alias("_head"), F.max_by("w", "rank").alias("_tail"))
    chain = Window.orderBy("_part")  # a row for each partition
    starts = first_of.select("_part", (~F.col("_head").eqNullSafe(F.lag("_tail").over(chain))).alias("_fresh"))
    beside = Window.partitionBy("_part").orderBy("rank")
    compared = windows.withColumn("_prior", F.lag("w").over(beside)).join(F.broadcast(starts), "_part")
    new = F.when(F.col("_prior").isNull(), F.col("_fresh")).otherwise(F.col("w") != F.col("_prior"))
    running = compared.withColumn("_new", new.cast("long")).withColumn("_run", F.sum("_new").over(beside))
    totals = running.groupBy("_part").agg(F.max("_run").alias("_n"))
    before = totals.select("_part", F.coalesce(F.sum("_n").over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    runs = staged(running.join(F.broadcast(before), "_part").select("doc", F.col("p").alias("start"), (F.col("_run") + F.col("_before")).alias("run")), "runs")
    first = runs.groupBy("run").agg(F.min(F.struct("doc", "start")).alias("first"))
    later: Column = F.col("doc") > F.col("first.doc")
    if within:
        later = later | ((F.col("doc") == F.col("first.doc")) & (F.col("start") > F.col("first.start")))
    gone = runs.join(first, "run").where(later).select("doc", "start")
    island = F.col("start") - F.row_number().over(Window.partitionBy("doc").orderBy("start"))
    return gone.withColumn("_i", island).groupBy("doc", "_i").agg(F.min("start").alias("start"), (F.max("start") + window).alias("end")).drop("_i")
