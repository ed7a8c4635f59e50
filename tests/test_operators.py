"""Golden rows and properties of the log operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions.masking import masked
from palisade.functions.net import http_path, normal_ip, query_pairs, severity_level
from palisade.functions.text import decoded, deobfuscated, sanitized
from palisade.operators import correlate as co
from palisade.operators import respond as rs
from palisade.operators.detect import rule_matches, rule_set
from palisade.operators.ml import TextModel, training_samples
from palisade.operators.parse import line_format, parse_lines, parse_time
from palisade.options import PipelineOptions, get_setting, merged, tenant_settings, with_setting
from palisade.sources.ingest import clean_lines, read_numbered_lines


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("line", "name"),
    [("T INFO app-1-2 api started", "container"), ("T INFO app-1-2 api Health check passed", "cloud_audit"), ("T svc-1 production SELECT DROP", "database_audit"), ("a b c d", "raw"), ('{"a": 1}', "json"), ("{a}", "raw"), ("", "empty")],
)
def test_format_cascade(spark, line, name):
    assert column(spark, [line], line_format) == [name]


def test_strict_formats(spark):
    df = spark.createDataFrame([("T INFO app-1-2 api Health check passed",)], "value string")
    assert parse_lines(df, strict_formats=True).first().format == "container"


@pytest.mark.parametrize(
    ("text", "out"), [("user@domain.com", "u****@******.com"), ("13812345678", "138****5678"), ("110101199001011234", "110101********4"), ("4111111111111111", "************1111"), ("x" * 32, "*" * 8), ("plain", "plain")]
)
def test_masks(spark, text, out):
    assert masked(spark.createDataFrame([(text,)], "t string"), "t").first().t == out


def test_rule_quirks(spark):
    hits = column(spark, ["version 10.2", "/etc/passwd", "<script>", None, "fine"], lambda v: F.transform(rule_matches(v, rule_set()), lambda m: m["category"]))
    assert hits[0] == ["ssrf"] and hits[1] == [] and hits[2] == ["xss"] and hits[4] == []
    assert column(spark, ["/etc/passwd"], lambda v: F.size(rule_matches(v, rule_set("v2")))) == [1]


def test_query_pairs(spark):
    pairs = column(spark, ["id=1%20AND%201=1;x=2&b=&id=3", None, ""], query_pairs)
    assert [(p.key, p.value) for p in pairs[0]] == [("id", "1 AND 1=1;x=2")] and pairs[1] == [] and pairs[2] == []


def test_scalars(spark):
    assert column(spark, ["a\x00b", "  x "], sanitized) == ["ab", "x"]
    assert column(spark, ["10.0.0.1", "10.0.0.256", "1.2.3.4:80", "2001:DB8::1", None], normal_ip) == ["10.0.0.1", None, "1.2.3.4", "2001:db8::1", None]
    assert column(spark, [None, "ERR", "mywarning", "x", "emerg2"], severity_level) == ["medium", "high", "medium", "low", "critical"]
    assert column(spark, [None, "//a//b/", "/"], http_path) == ["/", "/a/b", "/"]
    assert column(spark, ["a%20b", "50% x", "c2VsZWN0IDE9MSAg", None], deobfuscated) == ["a b", "50% x", "select 1=1  ", None]
    assert column(spark, [bytearray(b"\xef\xbb\xbfhi"), bytearray("你好".encode("gbk")), bytearray(b"\xff\xff")], decoded, "binary") == ["hi", "你好", "��"]
    assert [str(t) for t in column(spark, ["01/Jan/2024:00:00:07 +0100", "2024-01-01T00:00:00.5Z", "2024-01-01 00:00:01", "x"], parse_time)] == ["2023-12-31 23:00:07", "2024-01-01 00:00:00.500000", "2024-01-01 00:00:01", "None"]


def test_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\n\n  \ntwo\n" + b"x" * 50 + b"\n")
    got = read_numbered_lines(spark, str(tmp_path / "a.log"), PipelineOptions(max_line_length=20)).orderBy("line_number").collect()
    assert [(r.line_number, r.value) for r in got] == [(1, "one"), (4, "two")]
    assert clean_lines(spark.createDataFrame([], "value string")).count() == 0


def test_leading_edge(spark):
    df = spark.createDataFrame([("a", t * 1_000_000, t) for t in (0, 100, 700, 900)], "k string, us long, id int")
    kept = co.leading_edge(df, "k", "us", "id", 600).where("kept").orderBy("id").collect()
    assert [r.id for r in kept] == [0, 700]
    assert [r.id for r in co.leading_edge(df, "k", "us", "id", 700, inclusive=True).where("kept").orderBy("id").collect()] == [0, 900]


def test_rate_limit_holds(spark):
    rng = random.Random(1)
    times = sorted(rng.randrange(10_000_000) for _ in range(300))
    df = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "k string, us long, id int")
    admitted = [r.us for r in rs.rate_limited(df, ["k"], "us", "id", most=5, seconds=1).where("admitted").orderBy("us").collect()]
    assert all(admitted[i + 5] - admitted[i] > 1_000_000 for i in range(len(admitted) - 5))


def test_correlation_modes_agree_on_single_events(spark):
    rows = [("e1", 0, "1.1.1.1", "a", "high", ["xss"]), ("e2", 10**12, "1.1.1.2", "b", "low", ["ssrf"])]
    df = spark.createDataFrame(rows, "event_id string, us long, source_ip string, tenant string, detected_severity string, threat_types array<string>")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("session_id", "remote_user", "http_user_agent")})
    a = {r.event_id: (r.final_severity, r.correlated, r.best_key) for r in co.correlate(df, "us").collect()}
    b = {r.event_id: (r.exact.final_severity, r.exact.correlated, r.exact.best_key) for r in co.correlate_exact(df, "us").collect()}
    assert a == b == {"e1": ("high", False, "ip:1.1.1.1"), "e2": ("low", False, "ip:1.1.1.2")}


def test_model_learns_and_persists(spark, tmp_path):
    samples = training_samples(spark)
    model = TextModel.fit(samples)
    scores = {r.text: r.ml_score for r in model.score(samples, "text").collect()}
    model.save(spark, str(tmp_path / "m"))
    again = {r.text: r.ml_score for r in TextModel.load(spark, str(tmp_path / "m")).score(samples, "text").collect()}
    assert all(abs(scores[t] - again[t]) < 1e-9 for t in scores)
    assert sum((scores[r.text] > 0.5) == (r.label == 1) for r in samples.collect()) >= 10


def test_options():
    base = {"a": {"b": 1, "c": 2}, "tenants": {"t": {"a": {"b": 5}}}}
    assert get_setting(base, "a.b") == 1 and get_setting(base, "a.x", 7) == 7
    assert with_setting(base, "a.d", 3)["a"] == {"b": 1, "c": 2, "d": 3} and base["a"] == {"b": 1, "c": 2}
    assert tenant_settings(base, "t") == {"a": {"b": 5, "c": 2}} and merged({}, base) == base
    assert PipelineOptions.preset("fast").window_seconds == 30
    with pytest.raises(ValueError):
        PipelineOptions(window_seconds=0)


def test_custom_masks_hide_what_they_find(spark):
    from palisade.functions.masking import masked

    df = spark.createDataFrame([("call 555-1234 car AB-123",)], "t string")
    r = masked(df, "t", {"phone": r"\b\d{3}-\d{4}\b", "plate": r"\b[A-Z]{2}-\d{3}\b"}).first()
    assert r.masked_fields == ["phone", "plate"] and "1234 " not in r.t.replace("****1234", "") and "AB-123" not in r.t


def test_parser_keeps_columns_with_clashing_names(spark):
    from palisade.operators.parse import parse_lines

    df = spark.createDataFrame([('{"message": "hi"}', "a", "b", "c")], "value string, g string, j string, format string")
    r = parse_lines(df).first()
    assert (r.g, r.j, r.format, r.message) == ("a", "b", "json", "hi")


def test_untimed_threats_reach_the_result(spark):
    from palisade.plans.analyze import analyze
    from palisade.sources.ingest import single_text

    rows = analyze(single_text(spark, "1' union select 1")).correlated.select("final_severity", "correlated", "window_hits").collect()
    assert [tuple(r) for r in rows] == [("high", False, 1)]


def test_correlation_window_holds_the_newest_hundred(spark):
    from pyspark.sql import functions as F

    from palisade.operators import correlate as co

    none = [F.lit(None).cast("string").alias(c) for c in ("tenant", "session_id", "remote_user", "http_user_agent")]
    e = spark.range(400).select(F.col("id").alias("event_id"), F.lit("h").alias("source_ip"), *none, F.lit("low").alias("detected_severity"), F.array(F.lit("xss")).alias("threat_types"), (F.col("id") * 1000).alias("ts_us"))
    got = {r.event_id: r.window_hits for r in co.correlate(e, "ts_us", 60).select("event_id", "window_hits").collect()}
    assert got == {i: min(i, 100) + 1 for i in range(400)}


def test_rules_per_category_and_bad_patterns(spark):
    import pytest

    from palisade.operators.detect import rule_set, rules_per_category
    from palisade.operators.rule_table import rule_rows

    with pytest.warns(UserWarning):
        rules = rule_set("v1", [("xss", "low", "(unclosed"), ("xss", "low", "fine")])
    assert {r.category: r.rules for r in rules_per_category(rule_rows(spark, rules)).collect()}["xss"] == 6


def test_rule_hits_by_bits(spark):
    from palisade.operators.detect import rule_matches, rule_set, with_rule_hits

    texts = [(t,) for t in ("1' UNION  Select 1", "drop TABLE x; ls", "<SCRIPT>alert(1)", "nothing", "", None, "w7 w63 w70", "${JNDI:ldap://x} ../../etc/shadow")]
    rules = rule_set() + [("xss", "low", f"\\bw{i}\\b") for i in range(80)]
    df = spark.createDataFrame(texts, "text string")
    for some in (rules, rules[:18]):
        assert with_rule_hits(df, "text", some).where(~F.col("matches").eqNullSafe(rule_matches(F.col("text"), some))).isEmpty()


def test_settings_file(spark, tmp_path):
    from palisade.options import configured_rules, load_settings, reloaded, save_settings, setting_errors

    assert load_settings(tmp_path / "none.json") == PipelineOptions().settings() and setting_errors(PipelineOptions().settings()) == []
    settings = with_setting(PipelineOptions(window_seconds=30).settings(), "tenants.t.correlator.window_seconds", 90)
    for name in ("s.json", "s.yml"):
        save_settings(settings, tmp_path / "new" / name)
        assert load_settings(tmp_path / "new" / name) == settings
    assert PipelineOptions.from_settings(settings) == PipelineOptions(window_seconds=30) and PipelineOptions.from_settings(settings, "t").window_seconds == 90
    assert PipelineOptions.from_settings({}) == PipelineOptions()
    _, diff = reloaded(spark, PipelineOptions().settings(), tmp_path / "new" / "s.json")
    assert {(r.key, r.change) for r in diff.collect()} == {("correlator.window_seconds", "modified"), ("tenants.t.correlator.window_seconds", "added"), ("output", "removed")} - ({("output", "removed")} if "output" in settings else set())
    bad = {"system": {"max_line_length": "x"}, "output": {"signals_file": 3}, "rules": {"xss": [{"severity": "low"}], "sqli": "x"}}
    assert len(setting_errors(bad)) == 4 + 4
    assert configured_rules({"rules": {"xss": [{"pattern": "a", "severity": "low"}, {"pattern": "b", "enabled": False}]}}) == [("xss", "low", "a")]
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        load_settings(tmp_path / "list.json")


def test_training_report_and_folds(spark):
    from palisade.operators.ml import cross_validated, refitted, training_report

    scored = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.1), (0, 0.8)], "label int, ml_score double")
    assert tuple(training_report(scored).first()) == (4, 0.5, 0.5, 0.5, 0.5)
    folds = cross_validated(training_samples(spark), 3).collect()
    assert sum(r.samples for r in folds) == training_samples(spark).count() and len({r.fold for r in folds}) == len(folds)
    assert cross_validated(training_samples(spark).limit(0)).count() == 0


def test_refit_keeps_what_batches_brought(spark, tmp_path):
    from palisade.operators.ml import refitted

    base = training_samples(spark)
    batch = spark.createDataFrame([("zzz=1 or 2=2", 1), ("good morning", 0)], "text string, label int")
    scores = [{r.text: r.ml_score for r in m.score(batch, "text").collect()} for m in (TextModel.fit(base), refitted(base, batch, str(tmp_path / "seen")), refitted(base, batch, str(tmp_path / "seen")))]
    assert scores[1]["good morning"] < scores[0]["good morning"] and scores[1]["zzz=1 or 2=2"] > 0.5
    assert all(abs(scores[1][t] - scores[2][t]) < 1e-6 for t in scores[1])  # the batch came again


def test_session_anomalies(spark):
    from palisade.operators.ml import causal_scores, session_anomalies

    rng = random.Random(2)
    rows = [(i, "a", i * 1_000_000, rng.random(), 1.0) for i in range(200)] + [(900, "a", 200_000_000, 80.0, 40.0), (901, "b", 5, 1.0, 1.0), (902, None, 5, 1.0, 1.0), (903, "a", None, 1.0, 1.0), (904, "a", 7, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, k string, us long, x double, y double")
    shape = {"history": 60, "least": 10, "step": 20}
    scores = lambda rows, **more: {r.id: r.anomaly_score for r in session_anomalies(rows, "k", "us", "id", ["x", "y"], **shape, **more).collect()}
    whole = scores(df)
    assert len(whole) == len(rows) and {whole[i] for i in (*range(10), 901, 902, 903, 904)} == {0.0}
    assert whole[900] > max(whole[i] for i in range(200)) and all(0 <= v <= 0.5 for v in whole.values()) and whole[10] > 0
    assert scores(df, parts=7) == whole
    # later rows change nothing, not even those of the same block
    for n in (5, 15, 70, 133):
        earlier = scores(df.where(F.col("id") < n))
        assert earlier == {i: whole[i] for i in range(n)}
    # one key in one piece, row by row
    x = np.array([r[3:] for r in rows[:201]])
    alone = [causal_scores(x[max(0, p - 199) : p + 1], max(0, p - 199), p, **shape, trees=50, per_tree=64, seed=42)[0] for p in range(201)]
    assert np.allclose(alone, [whole[i] for i in [*range(200), 900]])
    assert session_anomalies(df.limit(0), "k", "us", "id", ["x", "y"]).count() == 0


def test_sessions_reach_detection(spark):
    from palisade.plans.analyze import detections
    from palisade.sources.ingest import single_text

    r = detections(single_text(spark, "1' union select 1"), PipelineOptions()).first()
    assert r.anomaly_score == 0.0 and r.threat_types == ["sqli"]


def test_odd_sessions_are_threats(spark):
    from palisade.plans.analyze import detections

    line = lambda i, text, status: f'{{"timestamp": "2024-01-01T{i // 60:02d}:{i % 60:02d}:00Z", "source_ip": "10.9.9.1", "message": "{text}", "path": "/a", "status": {status}}}'
    texts = [line(i, "fine", 200) for i in range(120)] + [line(120, "fine " * 40, 500)]
    rows = detections(spark.createDataFrame([(t,) for t in texts], "value string"), PipelineOptions()).orderBy("ts").collect()
    assert all(0 <= r.anomaly_score < 0.7 and not r.threat_types for r in rows[:-1])
    odd = rows[-1]
    assert odd.threat_types == ["behavioral_anomaly"] and 0.8 < odd.anomaly_score < 1 and odd.reason.startswith("anomaly_score=0.")
    assert abs(odd.confidence - 0.8 * odd.anomaly_score) < 1e-9 and odd.detected_severity == "low"


def test_limits_of_a_service(spark):
    from palisade.sources.ingest import acceptable

    df = spark.createDataFrame([("fine text",), ("",), (None,), ("  ",), ("a\tb",), ("a\u2028b",), ("a\u00a0b",), ("x" * 11,), ("\u4f60\u597d",)], "value string")
    assert [r.refused for r in acceptable(df, longest=10).collect()] == [None, "empty", "empty", "empty", "unprintable", "unprintable", "unprintable", "too long", None]


def test_metrics_record(spark, tmp_path):
    from datetime import datetime

    from palisade.operators.evaluate import severe_confusion
    from palisade.sources.sinks import METRICS, metric_rows, read_json, write_json

    m = spark.createDataFrame([(10, 4, 5, 3)], "total_lines long, threat_events long, rule_hits long, actions_taken long")
    c, a = spark.createDataFrame([(4, 0.5)], "total_events long, correlation_rate double"), spark.createDataFrame([(3,)], "executed long")
    write_json(metric_rows(m, c, a, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 4)), str(tmp_path / "m"))
    r = read_json(spark, str(tmp_path / "m"), METRICS).first()
    assert (r.throughput_lps, r.duration_seconds, r.total_lines, r.parsed_lines, r.correlation_stats, r.action_stats) == (2.5, 4.0, 10, 0, {"total_events": 4.0, "correlation_rate": 0.5}, {"executed": 3.0})
    df = spark.createDataFrame([("high", True), ("critical", False), ("low", True)], "level string, hit boolean")
    assert severe_confusion(df, "level", F.lit(True), F.col("hit")).select("tp", "fn").first() == (1, 1)


def test_what_a_run_counts(spark):
    from datetime import datetime

    from palisade.plans.analyze import analyze

    line = lambda ip, second, text: f'{{"timestamp": "2024-01-01T00:00:{second:02d}Z", "source_ip": "{ip}", "message": "{text}", "tenant": "t"}}'
    texts = [line("10.9.9.1", 0, "<script>"), line("10.9.9.1", 5, "<script>"), line("10.9.9.2", 6, "drop table x"), line("10.9.9.3", 7, "<script>"), line("10.9.9.4", 8, "fine")]
    listed = spark.createDataFrame([("10.9.9.3", 4_000_000_000_000_000), ("10.9.9.3", 5), ("tenant:t", 5)], "target string, expiry_us long")
    found = analyze(spark.createDataFrame([(t,) for t in texts], "value string"), PipelineOptions(sessions=False), suppressions=listed)
    s = found.statistics().first()
    assert (s.total_events, s.suppressed_events, s.duplicate_events) == (2, 1, 1) and s.suppression_rate == 0.5
    r = found.record(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 5)).first()
    assert (r.total_lines, r.threat_events, r.throughput_lps) == (5, 4, 1.0) and r.correlation_stats["duplicate_events"] == 1.0
    assert co.correlation_statistics(found.correlated).first().suppressed_events == 0


def test_anomalies_move_whole_rows_once(spark, data_dir, monkeypatch):
    """Sorted ranges and windows get only what sessions need; equal ids of different rows keep a row each."""
    from palisade.operators import ml, ranges
    from palisade.plans import analyze as plan
    from palisade.queries import normal_events

    seen = []
    for module in (ml, ranges, plan):
        monkeypatch.setattr(module, "staged", lambda df, label, real=module.staged: (seen.append((label, set(df.columns))), real(df, label))[1])
    events = normal_events(spark, data_dir).where("event_id < 200")
    twice = events.unionByName(events)
    out = plan.with_anomalies(twice, 86_400)
    assert out.columns == [*events.columns, "anomaly_score"]
    assert out.groupBy("event_id").count().where("count != 2").isEmpty() and out.count() == twice.count()
    assert {label for label, _ in seen} == {"events", "sessions", "ranged"}
    assert not any("message" in columns or "geolocation" in columns for label, columns in seen if label != "events")


def test_times_are_read_as_by_trying_every_format(spark):
    from palisade.functions.fixed import TIME_FORMATS
    from palisade.operators.parse import parse_time

    texts = ["01/Jan/2024:10:00:00 +0200", "01/Jan/2024:10:00:00", "2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456Z", "2024-01-02t03:04:05z", "2024-01-02T03:04:05.12", "01/jan/2024:10:00:00", "2024-01-02", "", "x/y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*(F.try_to_timestamp("t", F.lit(f)) for f in TIME_FORMATS))
    assert df.where(~parse_time(F.col("t")).eqNullSafe(plain)).isEmpty()


def test_private_networks_by_pattern(spark):
    from palisade.functions.fixed import PRIVATE_NETWORKS
    from palisade.functions.net import in_network, network_pattern

    texts = ["10.0.0.0", "10.255.255.255", "11.0.0.1", "172.15.255.255", "172.16.0.0", "172.31.9.9", "172.32.0.0", "192.168.1.1", "192.169.0.1", "127.0.0.1", "1.10.0.0", "10.0.0.256", "10.0.0", None]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    for network in (*PRIVATE_NETWORKS, "203.0.113.4/30", "8.8.8.8/32"):
        assert df.where(~F.col("ip").rlike(f"^{network_pattern(network)}$").eqNullSafe(in_network(F.col("ip"), network))).isEmpty()
