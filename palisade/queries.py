"""The registered queries of the log pipeline: each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import compiled, dealt, shared_folder, ship, spread, staged
from .functions.masking import masked
from .functions.net import http_method, http_path, location, normal_ip, query_pairs, severity_level, user_agent
from .functions.text import decoded, deobfuscated, without_evasion
from .operators import correlate as co
from .operators import evaluate as ev
from .operators import respond as rs
from .operators.detect import detect, rule_matches, rule_set, rule_statistics, rules_per_category, threats
from .operators.ml import TextModel, cross_validated, isolation_scores, session_anomalies, training_report, training_samples, with_features
from .operators.networks import with_network
from .operators.normalize import normalize_events
from .operators.online import OnlineModel, online_learner
from .operators.parse import for_tenant, json_field, parse_lines, with_decoded_query
from .operators.rule_table import rule_rows, with_rule_matches
from .operators.sessions import session_features, with_history
from .operators.windows import micros, settled
from .options import settings_diff
from .plans.analyze import analyze
from .sources.ingest import acceptable, clean_lines, numbered_lines
from .sources.sinks import ACTIONS, SIGNALS, action_rows, read_json, signal_rows, write_json
from .sources.synth import log_lines

Query = Callable[[SparkSession, str], DataFrame]
#: Window of the registered correlation queries: the events of the test tables are minutes to hours apart.
DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lines(table(compiled(spark), sf_dir, "events"))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(lines(spark, sf_dir))


def normal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_events(with_decoded_query(raw_events(spark, sf_dir)))


def detected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(normal_events(spark, sf_dir)).withColumn("ts_us", micros("ts"))


#: What correlation and the actions after it need of a threat.
THREAT_COLUMNS = ("event_id", "ts", "ts_us", "source_ip", "tenant", "session_id", "remote_user", "http_user_agent", "threat_types", "detected_severity")


def found_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threats, staged: lines are parsed and judged once, and only for the columns that are needed."""
    return staged(threats(detected_events(spark, sf_dir).select(*THREAT_COLUMNS)), "threats")


def correlated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.correlate(found_threats(spark, sf_dir), "ts_us", DAY)


def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to hits by category and severity: the flagship."""
    found = detected_events(spark, sf_dir).select(F.explode(rule_matches(F.col("detection_text"), rule_set())).alias("m"))
    return found.groupBy("m.category", "m.severity").agg(F.count("*").alias("hits"))


def parse_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).groupBy("format").agg(F.count("*").alias("n"))


def parse_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = raw_events(spark, sf_dir).where(F.col("format").isin("nginx_combined", "apache_common"))
    return web.select("event_id", "format", micros("timestamp").alias("ts_us"), "source_ip", "user", "method", http_path(F.col("path")).alias("path"), "query", "status_code", "bytes_sent", "user_agent")


def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(spark, sf_dir).where("format = 'json'").select("event_id", micros("timestamp").alias("ts_us"), "level", "message", "source_ip", "user_agent", http_method(F.col("method")).alias("method"), "path", "status_code", "tenant")


def parse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_events(spark, sf_dir).where(F.col("format").isin("cloud_audit", "container", "database_audit"))
    return rows.select("event_id", "format", micros("timestamp").alias("ts_us"), "user", "role", "resource", "action", "result", "level", "pod", "container", "source_ip", "database", "operation", "query")


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.array_join(F.transform(query_pairs(query), lambda p: F.concat(p["key"], F.lit("="), p["value"])), " ")
    return table(spark, sf_dir, "pages").select("page_id", http_path(path).alias("path"), pairs.alias("pairs"))


def mask_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masked(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.md5("text").alias("masked_md5"), F.array_join("masked_fields", ",").alias("kinds"))


def severity_and_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw_events(spark, sf_dir)
    agent = user_agent(F.col("user_agent"))
    place = location(normal_ip(F.col("source_ip")))
    keys = [severity_level(F.col("level")).alias("level"), agent["browser"].alias("browser"), agent["os"].alias("os"), place["country"].alias("country")]
    return e.select(*keys).groupBy("level", "browser", "os", "country").agg(F.count("*").alias("n"))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("text").union(table(spark, sf_dir, "conversations").select("text"))
    return rule_statistics(texts, "text")


def detect_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detected_events(spark, sf_dir)
    return d.select("event_id", "original_format", F.array_join("threat_types", ",").alias("threat_types"), F.array_join("rule_numbers", ",").alias("rules"), "detected_severity", "confidence", "reason", "sanitized_excerpt")


def tenant_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = for_tenant(raw_events(spark, sf_dir), "acme")
    return threats(detect(normalize_events(with_decoded_query(events)))).select("event_id", F.array_join("threat_types", ",").alias("threat_types"))


def session_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("ts_us"), "event_type", "value", "props")
    out = session_features(e, "user_id", "ts_us", {"unique_types": "event_type", "unique_props": "props"}, F.col("event_type") == "error", F.length("props"), DAY)
    return out.select("event_id", "event_count", "unique_types", "unique_props", "error_count", F.round("avg_length", 6).alias("avg_length"), F.round("time_span", 6).alias("time_span"), F.round("requests_per_second", 9).alias("requests_per_second"))


def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("ts_us"), F.floor("value").alias("whole"))
    out = with_history(e, "user_id", ["ts_us", "event_id"], "whole")
    return out.select("event_id", "history_size", F.round("history_mean", 6).alias("history_mean"), F.round("history_std", 3).alias("history_std"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal_events(spark, sf_dir).select("event_id", co.fingerprint().alias("fingerprint"))


def _keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", key.alias("fingerprint"), micros("ts").alias("ts_us"), F.col("ts").cast("timestamp").alias("ts"))


def ttl_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _keyed_events(spark, sf_dir).select("event_id", "fingerprint", "ts_us")
    return co.leading_edge(e, "fingerprint", "ts_us", "event_id", 2 * DAY).where("kept").select("event_id", "fingerprint", "ts_us")


def suppressed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([("203.0.7.1", 4_000_000_000_000_000), ("tenant:acme", 4_000_000_000_000_000), ("tenant:finance", 0)], "target string, expiry_us long")
    e = normal_events(spark, sf_dir).select("event_id", "source_ip", "tenant", micros("ts").alias("ts_us"))
    return co.suppress(e, listed, "ts_us").groupBy("tenant").agg(F.count("*").alias("n"))


def correlate_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = correlated_events(spark, sf_dir)
    return c.select("event_id", "window_hits", F.array_join(F.array_sort("window_types"), ",").alias("window_types"), "correlated", "final_severity", "best_key", "correlation_id")


def correlate_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = threats(detected_events(spark, sf_dir).select(*THREAT_COLUMNS))  # staged there
    return co.correlate_exact(slim, "ts_us", DAY).select("event_id", "exact.*")


def active_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = co.active_correlations(correlated_events(spark, sf_dir), "ts_us")
    return out.select("best_key", "event_count", "latest_us", F.array_join("types", ",").alias("types"), "max_severity")


def correlation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.correlation_statistics(correlated_events(spark, sf_dir)).select("total_events", "correlated_events", F.round("correlation_rate", 6).alias("correlation_rate"))


def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rs.plan_actions(correlated_events(spark, sf_dir), "ts_us")
    return a.select("event_id", "position", "kind", F.col("target.ttl_sec").alias("ttl_sec"), "idempotent_key", "correlation_id")


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.plan_actions(correlated_events(spark, sf_dir), "ts_us")


def idempotent_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = staged(_actions(spark, sf_dir).select("event_id", "position", "idempotent_key", "ts_us"), "actions")  # sorted ranges read it twice
    return rs.idempotent_actions(slim, DAY).select("event_id", "position", "idempotent_key")


def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two events of a user in a day."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("ts_us"))
    return rs.rate_limited(e, ["user_id"], "ts_us", "event_id", most=2, seconds=DAY).select("event_id", "admitted")


def executed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rs.execute(_actions(spark, sf_dir)).groupBy("kind", "status").agg(F.count("*").alias("n"))


def action_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rs.action_statistics(rs.execute(_actions(spark, sf_dir)))
    return out.select("total_actions", "executed", "failed", F.round("success_rate", 6).alias("success_rate"))


def top_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the last 100 actions."""
    return rs.latest_actions(_actions(spark, sf_dir)).select("event_id", "position", "kind", "ts_us")


def _toxic_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    categories = F.array_distinct(F.transform(rule_matches(F.col("text"), rule_set()), lambda m: m["category"]))
    hits = settled(texts.select("doc_id", categories.alias("types"))).where(F.size("types") > 0)
    wanted = F.when(F.col("toxic") == 1, F.array(F.lit("command_injection"), F.lit("sqli"))).otherwise(F.array(F.lit("ssrf"), F.lit("command_injection")))
    return table(spark, sf_dir, "labels").select("doc_id", wanted.alias("types")), hits


def label_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, hits = _toxic_labels(spark, sf_dir)
    return ev.matched_labels(labels, hits, "types", "doc_id").select("doc_id")


def label_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, hits = _toxic_labels(spark, sf_dir)
    return ev.matched_labels(labels, hits, "types", "doc_id", found=False).select("doc_id")


def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hits = _toxic_labels(spark, sf_dir)
    joined = table(spark, sf_dir, "labels").join(hits.select("doc_id", F.lit(True).alias("hit")), "doc_id", "left")
    out = ev.confusion(joined, F.col("toxic") == 1, F.coalesce("hit", F.lit(False)))
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "detection_rate", "false_positive_rate")))


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "labels").groupBy("quality").agg(F.avg("toxic").alias("rate")).select("quality", F.col("rate").alias("f1"), (F.col("rate") * 20000).alias("throughput"), F.lit(20.0).alias("latency_ms"), F.lit(500.0).alias("memory_mb"))
    return ev.grade(scores).select("quality", F.round("total", 6).alias("total"), "grade")


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lines are parsed and judged once: metrics and actions read what is staged
    detected = staged(detected_events(spark, sf_dir).select(*THREAT_COLUMNS, "matched_rules"), "detected")
    correlated = co.correlate(detected.where(F.size("threat_types") > 0).drop("matched_rules"), "ts_us", DAY)
    out = ev.run_metrics(table(spark, sf_dir, "events"), detected, rs.plan_actions(correlated, "ts_us"), 2.0)
    return out.select("total_lines", "threat_events", "rule_hits", "actions_taken", "throughput_lps")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p50 and p95 of a value by type."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of settings: the suppliers' as the old one, the customers' as the new one."""
    setting = lambda name, key, value: table(spark, sf_dir, name).select(F.concat(F.lit("account."), F.col(key).cast("string")).alias("key"), F.col(value).cast("string").alias("value"))
    return settings_diff(setting("supplier", "s_suppkey", "s_nationkey"), setting("customer", "c_custkey", "c_nationkey"))


def ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = with_features(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return f.select("doc_id", F.col("length").cast("long"), F.col("words").cast("long"), F.round("special_ratio", 9).alias("special_ratio"), *(F.col(c).cast("long").alias(c) for c in ("kw_0_select", "kw_6_or", "kw_7_and", "kw_19_nc")))


def lr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = TextModel.fit(training_samples(spark))
    return model.score(normal_events(spark, sf_dir).select("event_id", "message"), "message").select("event_id", "ml_score")


def isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ["event_count", "unique_types", "error_count", "requests_per_second"]
    return isolation_scores(session_statistics(spark, sf_dir), features, "event_id").select("event_id", "anomaly_score")


def session_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a day against what their user did before."""
    e = table(spark, sf_dir, "events").select("event_id", micros("ts").alias("ts_us"), "user_id")
    features = ["event_count", "unique_types", "error_count", "requests_per_second"]
    seen = staged(e.join(session_statistics(spark, sf_dir), "event_id"), "sessions")  # sorted ranges read it twice
    return session_anomalies(seen, "user_id", "ts_us", "event_id", features).select("event_id", "user_id", "anomaly_score")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), "doc_id").select("text", F.col("toxic").alias("label"))


def training_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents and the built-in samples, judged by the model that they train."""
    samples = _labelled(spark, sf_dir).unionByName(training_samples(spark))
    return training_report(TextModel.fit(samples).score(samples, "text"))


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_validated(_labelled(spark, sf_dir), folds=3)


def category_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each category in the table of rules (see rule_table_hits)."""
    return rules_per_category(_rule_table(spark, sf_dir))


def refused_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a service with limits would refuse, by reason."""
    return acceptable(table(spark, sf_dir, "documents").select("text"), "text", 600).groupBy("refused").agg(F.count("*").alias("n"))


def deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("event_id", deobfuscated(F.regexp_extract("value", r"(\S+)$", 1)).alias("token"))


def gbk_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line as GBK bytes of a prefix that is no valid UTF-8."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.unhex(F.lit("C4E3BAC3")), F.encode("value", "UTF-8"))).otherwise(F.encode("value", "UTF-8"))
    return lines(spark, sf_dir).select("event_id", decoded(raw).alias("value"))


def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit(" \u0007"), F.col("value"), F.lit("\t "))
    return clean_lines(lines(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("   ")).otherwise(messy).alias("value"))).select("event_id", F.md5("value").alias("value_md5"))


def evasion_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("event_id", without_evasion(F.concat(F.lit("A/* x */ &#x3C;B  "), F.col("value"))).alias("value"))


def analyze_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline; signals and actions go to JSON lines and are read back."""
    from .options import PipelineOptions

    found = analyze(lines(spark, sf_dir), PipelineOptions(window_seconds=DAY))
    folder = _scratch(spark)
    write_json(signal_rows(found.correlated, DAY), f"{folder}/signals")
    write_json(action_rows(found.actions), f"{folder}/actions")
    actions = read_json(spark, f"{folder}/actions", ACTIONS).groupBy("correlation_id").agg(F.count("*").alias("actions"))
    return read_json(spark, f"{folder}/signals", SIGNALS).select("event_id", "severity", "correlation_id").join(actions, "correlation_id", "left")


def _rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-in rules and one for the first three words of every benchmark passage."""
    words = F.transform(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 3), F.lower)
    passages = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000).cast("int").alias("rule"), F.lit("passage").alias("category"), F.lit("low").alias("severity"), F.concat(F.lit("(?i)"), F.array_join(words, "[^A-Za-z]+")).alias("pattern"))
    return rule_rows(spark, rule_set()).unionByName(passages)


def rule_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of rules over all documents."""
    found = with_rule_matches(table(spark, sf_dir, "documents").select("text"), "text", _rule_table(spark, sf_dir))
    return found.select(F.explode("matches").alias("m")).groupBy("m.rule", "m.category").agg(F.count("*").alias("hits"))


def network_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all events against a table of networks that the suppliers own."""
    key = F.col("s_suppkey")
    length = F.element_at(F.array(*(F.lit(x) for x in (8, 16, 24, 30, 32))), (key % 5 + 1).cast("int"))
    ip = F.concat(F.lit("203.0."), (key % 256).cast("string"), F.lit("."), (key % 7 + 1).cast("string"))
    networks = table(spark, sf_dir, "supplier").select(F.concat(ip, F.lit("/"), length.cast("string")).alias("network"))
    address = F.concat(F.lit("203.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), (F.col("event_id") % 7 + 1).cast("string"))
    return with_network(table(spark, sf_dir, "events").select("event_id", address.alias("ip")), "ip", networks).select("event_id", "ip", "network", "prefix_length")


def numbered_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines written to text files in order, numbered by file, and the files put end to end."""
    folder = f"{_scratch(spark)}/text"
    ordered = lines(spark, sf_dir).repartitionByRange("event_id").sortWithinPartitions("event_id")
    ordered.select(F.concat_ws(" ", F.col("event_id").cast("string"), "value").alias("value")).write.text(folder)
    numbered = numbered_lines(spark, folder).withColumn("event_id", F.split_part("value", F.lit(" "), F.lit(1)).cast("long"))
    sizes = numbered.groupBy("source").agg(F.max("line_number").alias("n"), F.min("event_id").alias("first"))
    along = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = sizes.select("source", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"))
    return numbered.join(before, "source").select("event_id", (F.col("before") + F.col("line_number")).alias("position"))


def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with nested and unknown fields, made from the events: a request object, an address by its path, labels that no parser knows."""
    request = F.struct(F.lit("get").alias("method"), F.concat(F.lit("/"), F.col("event_type")).alias("path"), F.concat(F.lit("q="), F.col("user_id")).alias("query_string"))
    client = F.struct(F.concat(F.lit("203.0.113."), F.col("user_id") % 256).alias("ip"))
    line = F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), request.alias("request"), F.struct(client.alias("client")).alias("network"), F.parse_json("props").alias("labels"), F.lit("/other").alias("path")))
    raw = table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    events = normalize_events(parse_lines(raw, json_paths={"source_ip": ["$.peer.ip", "$.network.client.ip"]}, whole_json=True))
    return events.select("event_id", micros("ts").alias("ts_us"), "source_ip", "http_method", "http_path", "message", json_field("$.labels.k", "int").alias("k"), json_field("$.labels.none").alias("missing"))


def online_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of toxic documents, learned from the labels in three batches as a stream would, and the scores of all documents."""
    texts = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("part", F.pmod(F.xxhash64("text"), F.lit(3)))
    featured = staged(with_features(texts, "text").drop("text"), "features")  # texts are looked at once: to learn, to scale and to score
    labelled = staged(featured.join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id").drop("doc_id"), "labelled")
    folder = f"{_scratch(spark)}/model"
    OnlineModel.start(labelled.where("part = 0"), None).save(spark, folder)
    learn = online_learner(folder, None)
    for number in (0, 1):
        learn(labelled.where(F.col("part") == number + 1), number)
    return OnlineModel.load(spark, folder, 1).score(featured, None).select("doc_id", "ml_score")


def replayed(spark: SparkSession, table_rows: DataFrame, ts: str, triggers: int = 3) -> tuple[str, DataFrame]:
    """A folder below the scratch folder and a stream of a table in order of time: one file folder a trigger, and a last row far in the future.

    The last row (``ts`` in 2200) only moves the watermark past all others.
    """
    folder = _scratch(spark)
    bounds = table_rows.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    step = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit(bounds.a).cast("timestamp"))) * triggers / F.lit(max(1, int((bounds.b - bounds.a).total_seconds() * 1e6) + 1)))
    for i in range(triggers):  # in order: a stream of files takes the oldest first
        table_rows.where(step == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    last = table_rows.orderBy(F.desc(ts)).limit(1).withColumn(ts, F.lit("2200-01-01").cast(dict(table_rows.dtypes)[ts]))
    last.write.mode("append").parquet(f"{folder}/in")
    return folder, spark.readStream.schema(table_rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def stream_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threats of the events, streamed in several triggers through the stateful correlation; signals and metrics go to idempotent sinks and are read back."""
    from .sources.sinks import BATCH_METRICS, batch_metrics, batch_writer, read_batches
    from .streaming import stateful, stream

    stateful.use_rocksdb(spark)
    folder, events = replayed(spark, found_threats(spark, sf_dir), "ts")  # staged: read for each trigger
    correlated = stateful.correlate(events.withWatermark("ts", "1 hour"), DAY)
    own = correlated.where("ts < timestamp '2200-01-01'")
    rows = "event_id long, window_hits int, window_types string, correlated boolean, final_severity string, best_key string, correlation_id string"
    names = [c.split()[0] for c in rows.split(", ")]
    signals = lambda df: df.withColumn("window_types", F.array_join(F.array_sort("window_types"), ",")).select(*names)
    stream.start(own, batch_writer(folder, {"signals": signals, "metrics": batch_metrics}), f"{folder}/checkpoint").awaitTermination()
    whole = read_batches(spark, folder, "metrics", BATCH_METRICS).agg(F.sum("signals").alias("n")).first().n or 0
    out = read_batches(spark, folder, "signals", rows)
    if whole != out.count():
        raise RuntimeError("metrics and signals of the stream differ")
    return out.select(*names)


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share."""
    import uuid

    return f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"


_QUERIES = (
    rule_summary, parse_formats, parse_web, parse_json, parse_tokens, url_parts, mask_pii, severity_and_agent, rule_hits, detect_threats, tenant_threats, session_statistics, session_history, fingerprints,
    ttl_dedup, suppressed_events, correlate_stateless, correlate_feedback, active_correlations, correlation_totals, plan_actions, idempotent_actions, rate_limited, executed_actions, action_totals, top_actions,
    label_semi, label_anti, confusion_metrics, grades, run_metrics, latency_percentiles, config_diff, ml_features, lr_score, isolation_forest, deobfuscate, gbk_decode, cleaned_lines, evasion_free, analyze_signals, stream_correlation,
    rule_table_hits, network_owners, numbered_file, json_objects, online_scores,
    session_anomaly, training_metrics, cross_validation, category_rules, refused_texts,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _QUERIES}
