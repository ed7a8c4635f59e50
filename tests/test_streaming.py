"""Streams give what batches give."""

import random

from pyspark.sql import functions as F

from palisade.operators import correlate as co
from palisade.operators import respond as rs
from palisade.operators.correlate import leading_edge
from palisade.operators.detect import threats
from palisade.options import PipelineOptions
from palisade.plans.analyze import detections
from palisade.queries import lines
from palisade.sources import sinks
from palisade.sources.ingest import stream_lines
from palisade.streaming import stateful
from palisade.streaming import stream as st


def test_stateless_stream_equals_batch(spark, data_dir, tmp_path):
    batch = lines(spark, data_dir).select("value")
    batch.write.text(str(tmp_path / "in"))
    seen = []
    query = st.start(st.stream_threats(stream_lines(spark, str(tmp_path / "in"))), lambda df, _: seen.extend(r.event_id for r in df.select("event_id").collect()), str(tmp_path / "cp"))
    query.awaitTermination(120)
    want = [r.event_id for r in threats(detections(batch)).where("ts is not null").select("event_id").collect()]
    assert sorted(seen) == sorted(want) and want


def test_leading_edge_stream_equals_batch(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 7).cast("string").alias("fingerprint"), F.timestamp_micros(F.lit(10**15) + F.col("id") * 37_000_000).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    st.start(st.leading_edge_stream(source, 600), lambda df, _: seen.extend((r.fingerprint, r.us) for r in df.collect()), str(tmp_path / "cp")).awaitTermination(180)
    timed = rows.withColumn("us", F.unix_micros("ts"))
    want = {(r.fingerprint, r.us) for r in leading_edge(timed, "fingerprint", "us", "us", 600).where("kept").collect()}
    assert set(seen) == want


def test_windowed_counts_and_watermark_dedup(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 5).cast("string").alias("fingerprint"), F.timestamp_micros(F.lit(10**15) + F.col("id") * 1_000_000).alias("ts"), F.lit("t").alias("tenant"), F.lit(0.8).alias("confidence"))
    rows.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    seen = []
    st.start(st.unique_within_watermark(source(), 600), lambda df, _: seen.extend(r.fingerprint for r in df.collect()), str(tmp_path / "c1")).awaitTermination(120)
    assert sorted(seen) == ["0", "1", "2", "3", "4"]
    assert st.windowed_counts(rows).agg(F.sum("threats")).first()[0] == 100


def threat_events(spark, n=500, seed=1):
    """Threats out of order by up to 40 seconds, with ties, missing keys and shared ones."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        us = 10**15 + i * 2_000_000 + rng.randrange(40) * 1_000_000
        types = rng.sample(list(co.RULE_CATEGORIES), rng.randint(1, 2))
        ip, user, agent = rng.choice(["1.1.1.1", "2.2.2.2", None]), rng.choice([None, "u1", "u2"]), rng.choice([None, "ua1"])
        rows.append((f"e{i:04d}", us, rng.choice(["low", "medium", "high", "critical"]), types, ip, rng.choice(["a", "b", ""]), None, user, agent, f"f{rng.randrange(20)}"))
    schema = "event_id string, ts_us long, detected_severity string, threat_types array<string>, source_ip string, tenant string, session_id string, remote_user string, http_user_agent string, fingerprint string"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("ts_us"))


def arriving(spark, rows, folder, triggers=4):
    """The rows in order of their ids, a part of them in each trigger, and one in the far future."""
    for b in range(triggers):
        rows.where(F.pmod(F.floor(F.substring("event_id", 2, 9).cast("int") * triggers / rows.count()), F.lit(triggers)) == b).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    rows.limit(1).withColumns({"event_id": F.lit("last"), "ts": F.lit("2200-01-01").cast("timestamp")}).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def streamed(df, columns, folder):
    seen = []
    take = lambda batch, _: seen.append([tuple(map(str, r)) for r in batch.select(*columns).collect()])
    st.start(df, take, f"{folder}/checkpoint").awaitTermination(240)
    assert sum(bool(x) for x in seen) > 2  # several triggers had something to say
    return sorted(x for part in seen for x in part if "last" not in x)


def test_stateful_dedup_and_correlation_equal_batch(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rows = threat_events(spark)
    options = PipelineOptions(dedup_ttl=10)
    listed = spark.createDataFrame([("2.2.2.2", 10**15 + 100_000_000), ("tenant:b", 10**15 + 300_000_000)], "target string, expiry_us long")
    unique = leading_edge(co.suppress(rows, listed, "ts_us"), "fingerprint", "ts_us", "event_id", 10).where("kept").drop("kept")
    want = co.correlate(unique, "ts_us", 60)
    got = streamed(st.stream_signals(arriving(spark, rows, tmp_path), options, listed), want.columns, tmp_path)
    assert got == sorted(tuple(map(str, r)) for r in want.collect()) and len(got) > 200


def test_stateful_actions_equal_batch(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rows = co.correlate(threat_events(spark, 200, 2), "ts_us", 60)
    options = PipelineOptions(idempotency_ttl=20, max_actions_per_second=2)
    planned = rs.idempotent_actions(rs.plan_actions(rows, "ts_us"), 20).withColumn("_tenant", F.coalesce(F.col("target.tenant"), F.lit("")))
    want = rs.rate_limited(planned, ["_tenant"], "ts_us", "action_id", 2).drop("_tenant")
    source = arriving(spark, rows, tmp_path).withWatermark("ts", "60 seconds")
    got = streamed(st.stream_actions(source, options).where("ts < timestamp '2200-01-01'"), want.columns, tmp_path)
    expected = sorted(tuple(map(str, r)) for r in want.collect())
    assert got == expected and {r[-1] for r in got} == {"True", "False"}


def test_rows_after_the_watermark_are_dropped(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rows = threat_events(spark, 40, 3)
    late = rows.limit(1).withColumns({"event_id": F.lit("e9999"), "ts": F.timestamp_micros(F.lit(10**15 - 10**10))})
    for part in (rows.where("event_id < 'e0020'"), rows.where("event_id >= 'e0020'"), late, rows.limit(1).withColumns({"event_id": F.lit("last"), "ts": F.lit("2200-01-01").cast("timestamp")})):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withWatermark("ts", "60 seconds")
    seen = []
    st.start(stateful.correlate(source, 60), lambda df, _: seen.extend(r.event_id for r in df.collect()), f"{tmp_path}/checkpoint").awaitTermination(240)
    assert sorted(seen) == [f"e{i:04d}" for i in range(40)]


def test_a_replayed_batch_writes_nothing_twice(spark, tmp_path):
    rows = spark.range(5).select(F.timestamp_micros(F.col("id")).alias("ts"), (F.col("id") > 1).alias("correlated"), "id")
    write = sinks.batch_writer(str(tmp_path), {"rows": lambda df: df.select("id"), "metrics": sinks.batch_metrics})
    read = lambda: sorted(r.id for r in sinks.read_batches(spark, str(tmp_path), "rows", "id long").collect())
    write(rows, 0)
    write(rows, 0)  # replayed whole
    assert read() == [0, 1, 2, 3, 4]
    write(rows.where("id < 2"), 1)
    (tmp_path / "rows" / "query=batch" / "batch=1" / "_SUCCESS").unlink()  # as if the attempt had failed half way
    write(rows.where("id < 2"), 1)
    assert read() == [0, 0, 1, 1, 2, 3, 4]
    m = sinks.read_batches(spark, str(tmp_path), "metrics", sinks.BATCH_METRICS).agg(F.sum("signals"), F.sum("correlated"), F.max("last_us")).first()
    assert tuple(m) == (7, 3, 4)


def test_events_of_one_group_of_state_wait_for_all_their_keys():
    """Gather holds an event until its last key has come, and lets go of the others of its group at once."""
    from palisade.streaming.stateful import SHOWN, Gather

    names = [f.split()[0] for f in SHOWN.split(", ")]
    row = lambda event, k, n: dict(zip(names, (None, event, k, n, f"key{k}", 1, 0, 1, 1, 0, 0, 0, "p" if k == 0 else None), strict=True))

    class Held:
        def __init__(self):
            self.rows = []

        exists, get = (lambda self: bool(self.rows)), (lambda self: list(self.rows))
        put, clear = (lambda self, rows: setattr(self, "rows", rows)), (lambda self: setattr(self, "rows", []))

    gather = Gather()
    gather.rows = Held()
    first = list(gather.handleInputRows((0,), iter([row("a", 1, 2), row("b", 0, 1)]), None))
    assert [(r.payload, len(r["keys"])) for r in first] == [("p", 1)] and len(gather.rows.rows) == 1
    second = list(gather.handleInputRows((0,), iter([row("a", 0, 2)]), None))
    assert [(r.payload, [x[1] for x in r["keys"]]) for r in second] == [("p", ["key0", "key1"])] and not gather.rows.rows


class _State:
    """A list, a value or the timers of a group, without Spark."""

    def __init__(self):
        self.held, self.timers = [], []

    exists, get, clear = (lambda self: bool(self.held)), (lambda self: list(self.held)), (lambda self: self.held.clear())
    put, appendValue = (lambda self, rows: setattr(self, "held", list(rows))), (lambda self, row: self.held.append(row))
    update = put
    getListState = getValueState = lambda self, *_: _State()
    deleteTimer, registerTimer = (lambda self, at: self.timers.remove(at)), (lambda self, at: self.timers.append(at))


def test_waiting_rows_are_packed_and_keep_their_instant(monkeypatch):
    """Entries of state hold many rows; times of frames without a zone (an hour that comes twice) don't count."""
    import pandas as pd

    from palisade.streaming.stateful import SHOWN_NAMES, GatherFrames, Window

    monkeypatch.setattr(stateful, "PACKED_ROWS", 4)
    first = 1_698_541_200_000_000  # 2023-10-29 01:00 UTC: 02:30 comes twice that night in Berlin
    n = 10
    df = pd.DataFrame({"us": [first + i * 600_000_000 for i in range(n)], "tie": [f"{i:03d}" for i in range(n)], "payload": "p", "level": 3, "mask": 1, "own": True, "k": 0, "n": 1, "key": "ip:1"})
    df["ts"] = pd.to_datetime(df["us"], unit="us", utc=True).dt.tz_convert("Europe/Berlin").dt.tz_localize(None)
    window, handle = Window(3_600_000_000, 100), _State()
    window.init(handle)
    window.rows, window.timer, window.recent, window.handle = _State(), _State(), _State(), handle
    assert list(window.handleInputRows((0, 0), iter([df[:7], df[7:]]), None)) == []
    assert len(window.rows.held) == 3 and handle.timers == [first // 1000]
    timers = type("T", (), {"getCurrentWatermarkInMs": lambda self: (first + 4 * 600_000_000) // 1000})()
    out = pd.concat(window.handleExpiredTimer((0, first // 3_600_000_000), timers, None))
    assert list(out.columns) == SHOWN_NAMES and out["prior"].tolist() == [0, 1, 2, 3, 4]
    assert (out["ts"].astype("int64") // (10 ** (9 if out["ts"].dt.unit == "ns" else 6) // 10**6)).tolist() == df["us"].tolist()[:5]
    assert sum(len(stateful._unpack([x])) for x in window.rows.held) == 5
    gather = GatherFrames()
    gather.rows = _State()
    found = pd.concat(gather.handleInputRows((0,), iter([out.assign(us=df["us"][:5].tolist(), ts=df["ts"][:5].tolist())]), None))
    assert [t.timestamp() * 1e6 for t in found["ts"]] == df["us"].tolist()[:5] and found["keys"].iloc[4][0]["prior"] == 4
