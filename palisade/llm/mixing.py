"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources that a
   document belongs to); only the pattern table, bounded by ``max_patterns``,
   reaches the driver.
2. Targets: the sources, ordered by code point with null last, share
   ``share`` times all sizes by weight; a target stops at ``max_repeats`` times
   its source's size and the excess is shared again by weight.
3. Min-cost flow: a pattern offers its size once for each repetition, at the
   rising price of a convex cost (1, 3, 5, ...); sources take up to their
   target.  Blocking flows fill the quotas, one repetition after the other, which
   is the cheapest way.
4. Seeded selection: within a pattern documents are ordered by the MD5 of seed
   and id.  All get the pattern's full repetitions; in that order, documents
   get one more until the rest of the flow is used up, to the nearest document.
   The running sum is split over hash buckets, so a hot pattern is never in one
   task.

Edge cases: null sources form a source of their own (last); null or negative
sizes count as 0 and such documents are never taken; repeated ids are ordered by size too, so
equal rows are interchangeable and reruns agree; an empty table gives an empty
result.  Columns of the input other than id, size and sources don't matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Order key of a source: non-null ones by code point, then null.
NULL_KEY = "1"


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit(NULL_KEY)).otherwise(F.concat(F.lit("0"), source))


def share_targets(sizes: dict[str, int], total: int, weights: Sequence[float], share: float, ceiling: int) -> dict[str, float]:
    """Targets of the sources, by weight, none above ``ceiling`` times its size."""
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(sorted(sizes))}
    left, full = share * total, 0
    open_ = sorted(sizes)
    while True:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if (left - full) * weight[s] / whole > ceiling * sizes[s]]
        if not over:
            break
        full += sum(ceiling * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in set(over)]
        if not open_:
            break
    capped = {s: float(ceiling * sizes[s]) for s in sizes}
    return capped | {s: (left - full) * weight[s] / sum(weight[x] for x in open_) for s in open_}


def route(patterns: dict[tuple[str, ...], int], quotas: dict[str, int], most: int) -> dict[tuple[str, ...], int]:
    """Min-cost flow of pattern sizes, each usable ``most`` times, to source quotas.

    Returns the flow out of each pattern.  Only repetitions cost, and each more
    than the one before for all patterns alike, so the cheapest flow is a largest
    flow with every size used once, then grown with sizes used twice, and so on:
    no augmenting path takes back what a pattern gives.  Each is found by blocking
    flows over paths of the same length.
    """
    names, sources = sorted(patterns), sorted(quotas)
    number = {s: len(names) + 2 + k for k, s in enumerate(sources)}
    start, end = 0, 1
    out: list[list[int]] = [[] for _ in range(len(names) + len(sources) + 2)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
        return len(to) - 2

    gates = [arc(start, k + 2, 0) for k in range(len(names))]
    for k, p in enumerate(names):
        for s in p:
            arc(k + 2, number[s], most * patterns[p])
    for s in sources:
        arc(number[s], end, quotas[s])

    def levels() -> list[int]:
        far = [-1] * len(out)
        far[start], queue = 0, [start]
        for x in queue:
            for e in out[x]:
                if room[e] and far[to[e]] < 0:
                    far[to[e]] = far[x] + 1
                    queue.append(to[e])
        return far

    for _ in range(most):
        for k, p in enumerate(names):
            room[gates[k]] += patterns[p]
        while (far := levels())[end] >= 0:
            at = [0] * len(out)
            path: list[int] = []
            x = start
            while True:
                if x == end:
                    least = min(room[e] for e in path)
                    for e in path:
                        room[e] -= least
                        room[e ^ 1] += least
                    full = next(i for i, e in enumerate(path) if not room[e])
                    x = to[path[full] ^ 1]
                    del path[full:]
                elif at[x] < len(out[x]):
                    e = out[x][at[x]]
                    if room[e] and far[to[e]] == far[x] + 1:
                        path.append(e)
                        x = to[e]
                    else:
                        at[x] += 1
                elif path:  # a dead end
                    x = to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break
    return {p: room[gates[k] ^ 1] for k, p in enumerate(names)}


def mix_sources(
    docs: DataFrame,
    id_col: str,
    size_col: str,
    sources_col: str,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeats: int = 2,
    seed: str = "mix",
    buckets: int = 4096,
    max_patterns: int = 200_000,
) -> DataFrame:
    """One row per document: id, size, sources (array), source_size, target, repeats, taken.

    ``sources_col`` is an array of source names; ``source_size`` and ``target``
    are sums over the document's sources.
    """
    spark = docs.sparkSession
    size = F.greatest(F.coalesce(F.col(size_col), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    keys = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(sources_col), F.array(F.lit(None).cast("string"))), source_key)))
    rows = staged(docs.select(F.col(id_col).alias("id"), size.alias("size"), F.col(sources_col).alias("sources"), keys.alias("pattern")), "sized")

    found = rows.groupBy("pattern").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns; raise max_patterns if the driver can hold them")
    patterns = {tuple(r.pattern): r.n for r in found}
    sizes: dict[str, int] = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    targets = share_targets(sizes, sum(patterns.values()), weights, share, max_repeats) if sizes else {}
    flow = route(patterns, {s: int(t + 0.5) for s, t in targets.items()}, max_repeats)

    def plan() -> Iterable[tuple]:
        for p, n in patterns.items():
            whole, rest = divmod(flow[p], n) if n else (0, 0)
            yield list(p), sum(sizes[s] for s in p), float(sum(targets[s] for s in p)), whole, rest

    plans = spark.createDataFrame(list(plan()), "pattern array<string>, source_size long, target double, whole long, rest long")
    marked = rows.withColumn("mark", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    marked = marked.withColumn("bucket", (F.conv(F.substring("mark", 1, 8), 16, 10).cast("double") / 2**32 * buckets).cast("int"))
    by_bucket = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy("pattern", "bucket").agg(F.sum("size").alias("n")).withColumn("below", F.coalesce(F.sum("n").over(by_bucket), F.lit(0))).drop("n")
    inside = Window.partitionBy("pattern", "bucket").orderBy("mark", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    more = ((2 * before + F.col("size") <= 2 * F.col("rest")) & (F.col("size") > 0)).cast("long")
    return (
        marked.join(sums, ["pattern", "bucket"])
        .join(F.broadcast(plans), "pattern")  # at most max_patterns rows
        .withColumn("repeats", F.when(F.col("size") > 0, F.col("whole") + more).otherwise(F.lit(0).cast("long")))
        .select("id", "size", "sources", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))
        .withColumnRenamed("id", id_col)
    )
