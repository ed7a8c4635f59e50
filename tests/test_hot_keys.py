"""Ordered operators where one key holds most rows, over many parts, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from palisade.operators import correlate as co
from palisade.operators import respond as rs
from palisade.operators.folds import first_passing, limited
from palisade.operators.ranges import numbered, ranged, with_runs
from palisade.operators.sessions import with_history

SCHEMA = "id string, k string, us long, extra string"


def rows_of(seed=1, n=600, spread=40):
    """A hot key, some small ones, a null key, equal times and pauses."""
    rng = random.Random(seed)
    out, us = [], 0
    for i in range(n):
        us += rng.choice([0, 0, 1, 2, 3, spread])
        out.append((f"{i:04d}", rng.choice(["hot"] * 8 + ["a", "b", None]), us, "x"))
    rng.shuffle(out)
    return out


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups.values()


def kept_ids(rows, ttl):
    out = set()
    for group in by_key(rows):
        last = None
        for i, _, us, *_ in group:
            if last is None or us - last >= ttl:
                last = us
                out.add(i)
    return out


def admitted_ids(rows, most, width):
    out = set()
    for group in by_key(rows):
        times = []
        for i, _, us, *_ in group:
            times = [t for t in times if us - t <= width]
            if len(times) < most:
                times.append(us)
                out.add(i)
    return out


@pytest.fixture(scope="module")
def hot(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(6)


def test_numbers_and_runs(spark, hot):
    for parts in (1, 12):
        got = {r.id: r.n for r in numbered(hot, ["k"], ["us", "id"], parts=parts).collect()}
        assert got == {r[0]: i for group in by_key(rows_of()) for i, r in enumerate(group, 1)}
        runs = {r.id: r["_run"] for r in with_runs(hot, ["k"], "us", "id", 7, parts).collect()}
        want = {}
        for group in by_key(rows_of()):
            start = before = None
            for i, _, us, *_ in group:
                start = us if before is None or us - before >= 7 else start
                before = us
                want[i] = start
        assert runs == want
    assert numbered(hot.limit(0), ["k"], ["us", "id"]).count() == 0


def test_parts_are_even_and_in_order(spark, hot):
    cut = ranged(hot, ["k"], ["us", "id"], 16)
    sizes = [r["count"] for r in cut.groupBy("_part").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 200  # the hot key has 430 rows
    edges = cut.where("k = 'hot'").groupBy("_part").agg(F.min("us").alias("a"), F.max("us").alias("b")).orderBy("_part").collect()
    assert all(x.b <= y.a for x, y in zip(edges, edges[1:], strict=False))


@pytest.mark.parametrize(("ttl", "run_rows"), [(50, 10**6), (3, 5), (50, 5), (10**6, 20)])
def test_leading_edge_of_hot_keys(spark, hot, ttl, run_rows):
    out = first_passing(hot, "k", "us", "id", ttl, run_rows, 12)
    assert set(out.columns) == {"id", "k", "us", "extra", "kept"}
    rows = out.collect()
    assert len(rows) == 600 and {r.id for r in rows if r.kept} == kept_ids(rows_of(), ttl)


def test_leading_edge_of_rows_that_are_the_same(spark):
    df = spark.createDataFrame([("a", "k", 5, "x")] * 6 + [("b", "k", 5, "x"), ("c", "k", 20, "x")], SCHEMA)
    for run_rows in (1, 100):
        rows = first_passing(df, "k", "us", "id", 10, run_rows).where("kept").collect()
        assert sorted((r.id, r.us) for r in rows) == [("a", 5), ("c", 20)]
        assert first_passing(df.limit(0), "k", "us", "id", 10, run_rows).count() == 0


@pytest.mark.parametrize("run_rows", [10**6, 5])
def test_rows_without_a_time_pass(spark, hot, run_rows):
    untimed = spark.createDataFrame([(x, k, None, "x") for x, k in (("u1", "hot"), ("u2", "hot"), ("u3", "a"), ("u4", None))], SCHEMA)
    both = hot.unionByName(untimed)
    more = {"u1", "u2", "u3", "u4"}
    assert {r.id for r in first_passing(both, "k", "us", "id", 50, run_rows, 12).where("kept").collect()} == kept_ids(rows_of(), 50) | more
    assert {r.id for r in limited(both, ["k"], "us", "id", 2, 3, run_rows, 12).where("admitted").collect()} == admitted_ids(rows_of(), 2, 3) | more


def test_a_long_key_is_told_by_its_parts():
    """What passes last in a part, for every time that may pass first there: few, as chains meet."""
    import numpy as np

    from palisade.operators.folds import exits_of

    rng = np.random.default_rng(5)
    for spread, ttl in ((3, 7), (40, 7), (1, 1000), (2, 100)):
        times = np.cumsum(rng.integers(0, spread + 1, 3000))
        upto, last = exits_of(times, ttl)
        t = np.unique(times)
        for first in t[t < t[0] + ttl]:
            end = first
            while (later := t[t >= end + ttl]).size:
                end = later[0]
            assert last[np.searchsorted(upto, first)] == end
    assert len(exits_of(np.cumsum(rng.integers(0, 3, 100_000)), 50)[0]) == 1


def test_one_key_for_the_whole_table(spark):
    """No pause at all: doubled pointers, as many rounds as the logarithm of what passes."""
    df = spark.range(5000).select(F.format_string("%05d", "id").alias("id"), F.lit("hot").alias("k"), (F.col("id") * 3).alias("us"), F.lit("x").alias("extra"))
    out = co.leading_edge(df.withColumn("us", F.col("us") * 1_000_000), "k", "us", "id", 10, run_rows=100)
    assert [int(r.id) for r in out.where("kept").orderBy("id").collect()] == list(range(0, 5000, 4))


@pytest.mark.parametrize(("most", "width", "run_rows"), [(2, 3, 10**6), (2, 3, 40), (3, 30, 40), (5, 0, 20)])
def test_limits_of_hot_keys(spark, hot, most, width, run_rows):
    out = limited(hot, ["k"], "us", "id", most, width, run_rows, 12)
    assert set(out.columns) == {"id", "k", "us", "extra", "admitted"}
    rows = out.collect()
    assert len(rows) == 600 and {r.id for r in rows if r.admitted} == admitted_ids(rows_of(), most, width)


def test_only_crowded_times_are_folded(spark, hot, monkeypatch):
    from palisade.operators import folds

    seen = []
    real = folds._limited
    monkeypatch.setattr(folds, "_limited", lambda df, *more: (seen.append(df.count()), real(df, *more))[1])
    for most in (2, 12):
        rows = limited(hot, ["k"], "us", "id", most, 3, 40, 12).collect()
        assert {r.id for r in rows if r.admitted} == admitted_ids(rows_of(), most, 3) and len(rows) == 600
    assert limited(hot, ["k"], "us", "id", 600, 3).where("not admitted").isEmpty()
    assert len(seen) == 1 or seen[1] < seen[0]


def test_rate_limit_by_two_keys_and_of_nothing(spark, hot):
    out = rs.rate_limited(hot.withColumn("k2", F.lit(None).cast("int")), ["k", "k2"], "us", "id", 2, 3e-6, 10)
    assert {r.id for r in out.where("admitted").collect()} == admitted_ids(rows_of(), 2, 3)
    assert rs.rate_limited(hot.limit(0), ["k"], "us", "id").count() == 0


def test_history_of_a_hot_key(spark, hot):
    df = hot.withColumn("v", F.col("us") % 13)
    got = {r.id: (r.history_size, r.history_mean, r.history_std) for r in with_history(df, "k", ["us", "id"], "v", rows=30, least=4, parts=9).collect()}
    for group in by_key(rows_of()):
        values = [r[2] % 13 for r in group]
        for p, r in enumerate(group):
            past = values[max(0, p - 29) : p + 1]
            size, mean, std = got[r[0]]
            assert size == len(past)
            if len(past) < 4:
                assert mean is None and std is None
            else:
                m = sum(past) / len(past)
                assert abs(mean - m) < 1e-9 and abs(std - (sum((x - m) ** 2 for x in past) / len(past)) ** 0.5) < 1e-9


def test_window_facts_across_batches(spark):
    """A key of many rows, cut into Arrow batches of 7, against a plain loop; rows without a time have no history."""
    rng = random.Random(5)
    names = ("low", "medium", "high", "critical")
    rows, us = [], 0
    for i in range(300):
        us += rng.choice([0, 0, 1, 2, 3, 15])
        rows.append((f"{i:04d}", rng.choice(["hot"] * 6 + ["a", None]), None if i % 50 == 9 else us, rng.choice(names), rng.sample(co.RULE_CATEGORIES, rng.choice([1, 1, 2]))))
    schema = "event_id string, source_ip string, us long, detected_severity string, threat_types array<string>, tenant string, session_id string, remote_user string, http_user_agent string"
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], schema)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for most, width in ((5, 12), (100, 40)):
        spark.conf.set(key, "7")
        slim = df.select("event_id", F.col("us").alias("_ts"), co.level_number(F.col("detected_severity")).alias("_level"), co.category_mask("threat_types").alias("_mask"), F.posexplode(co.correlation_keys()).alias("_k", "_key"))
        got = {r.event_id: r.fact for r in co._with_window_facts(slim, width, most).where("fact.key is not null").collect() if r.fact.key}
        spark.conf.set(key, before)
        past = {}
        for i, ip, at, severity, types in sorted((r for r in rows if r[1]), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            seen = [] if at is None else [x for x in past.get(ip, [])[-most:] if x[0] >= at - width]
            level = names.index(severity) + 1
            mask = sum(1 << co.RULE_CATEGORIES.index(t) for t in types)
            levels = [x[1] for x in seen]
            union = mask
            for x in seen:
                union |= x[2]
            f = got[i]
            assert (f.prior, f.top, f.mask, f.low, f.high, f.critical) == (len(seen), max([level, *levels]), union, levels.count(1), levels.count(3), levels.count(4))
            if at is not None:
                past.setdefault(ip, []).append((at, level, mask))


def _exact_by_loop(rows, width, most):
    """correlate_exact of one tenant, with windows that are listed anew for each event."""
    state, out = {}, {}
    for i, ip, user, us, severity, types in sorted(rows, key=lambda r: (r[3], r[0])):
        own, best = ("low", "medium", "high", "critical").index(severity) + 1, None
        for key in ([f"ip:{ip}"] if ip else []) + ["tenant:t"] + ([f"user:{user}"] if user else []):
            now = [x for x in state.get(key, [])[-most:] if x[0] >= us - width]
            union = list(dict.fromkeys([*types, *(t for x in now for t in x[2])]))
            levels = [x[1] for x in now]
            high = sum(x >= 3 for x in [*levels, own])
            go = len(union) >= 2 or len(now) >= 5 or high >= 2 or (len(now) >= 3 and ((1 in levels and 3 in levels) or 4 in levels))
            if best is None or len(now) > best[1] or (len(now) == best[1] and go):
                best = (key, len(now), union, go, max([*levels, own]))
        key, prior, union, go, top = best
        state.setdefault(key, []).append((us, min(top + go, 4), union))
        out[i] = (prior + 1, union, go, min(top + go, 4), key)
    return out


def test_exact_correlation_against_a_loop(spark):
    rng = random.Random(8)
    rows, us = [], 0
    for i in range(400):
        us += rng.choice([0, 0, 1, 2_000_000, 5_000_000, 40_000_000])
        rows.append((f"{i:04d}", rng.choice(["a", "b", "c", None]), rng.choice(["u", "v", None]), us, rng.choice(["low", "low", "medium", "high", "critical"]), rng.sample(["sqli", "xss", "ssrf"], rng.choice([1, 1, 1, 2]))))
    schema = "event_id string, source_ip string, remote_user string, us long, detected_severity string, threat_types array<string>, tenant string, session_id string, http_user_agent string"
    df = spark.createDataFrame([(*r, "t", None, None) for r in rows], schema)
    for most, seconds in ((4, 60), (100, 20)):
        got = {r.event_id: r.exact for r in co.correlate_exact(df, "us", seconds, most).collect()}
        want = _exact_by_loop(rows, seconds * 1_000_000, most)
        names = ("", "low", "medium", "high", "critical")
        assert {i: (x.window_hits, list(x.window_types), x.correlated, names.index(x.final_severity), x.best_key) for i, x in got.items()} == want


def test_exact_correlation_looks_through_its_keys_seldom(spark):
    """40,000 users at once: it took a look at all of them for each event beyond 10,000."""
    import time

    df = spark.range(40_000).select(F.col("id").alias("event_id"), F.lit(None).cast("string").alias("source_ip"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("http_user_agent"), F.concat(F.lit("u"), F.col("id")).alias("remote_user"), F.col("id").alias("us"), F.lit("low").alias("detected_severity"), F.array(F.lit("xss")).alias("threat_types"), F.lit("").alias("tenant"))
    start = time.monotonic()
    assert co.correlate_exact(df, "us").where("exact.window_hits = 1").count() == 40_000
    assert time.monotonic() - start < 25


def test_metrics_and_actions_parse_once(spark, data_dir):
    """The lines are read by one job that stages threats; what follows reads only those."""
    from palisade import queries as q

    for query in (q.correlate_stateless, q.run_metrics, q.top_actions):
        plan = query(spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "rlike" not in plan.lower()


def test_tasks_go_by_what_is_read(spark, data_dir):
    """Texts are dealt by the bytes read, and the estimate of a join (a product) does not count; session totals stay the same in many tasks."""
    from palisade.cluster import dealt, plan_bytes, staged
    from palisade.operators.windows import sliding_totals

    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    assert plan_bytes(docs.join(docs.withColumnRenamed("text", "t"), "doc_id")) <= 2 * plan_bytes(docs) + 1
    assert dealt(docs, plan_bytes(docs) // 40).rdd.getNumPartitions() >= 40 and dealt(docs).rdd.getNumPartitions() == docs.rdd.getNumPartitions()
    rows = staged(spark.createDataFrame(rows_of(), SCHEMA).where("k is not null"), "rows")
    assert plan_bytes(spark.createDataFrame(rows_of(), SCHEMA)) == 0
    few, many = (sliding_totals(rows, "k", "us", 20, {}, {"kinds": "extra"}, task_bytes=n) for n in (1 << 30, 100))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_events_without_a_time_are_in_no_window():
    held = co._Held()
    held.add(float("nan"), 4, ("sqli",), 100)
    held.add(50, 1, ("xss",), 100)
    held.since(40)
    assert [e[0] for e in held.events] == [50] and held.types == {"xss": 1} and held.levels == [0, 1, 0, 0, 0]
