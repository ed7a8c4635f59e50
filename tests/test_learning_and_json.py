"""Online learning against full fits, whole JSON objects, and small options."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.functions.text import feature_names
from palisade.operators import respond as rs
from palisade.operators.ml import TextModel, tfidf_pipeline, training_samples, with_features
from palisade.operators.normalize import normalize_events
from palisade.operators.online import OnlineModel, batch_sums, online_learner
from palisade.operators.parse import json_field, parse_lines
from palisade.sources.ingest import numbered_lines


def samples(spark, n, seed):
    """Texts of keywords, with labels that follow from them only in part."""
    rng = random.Random(seed)
    words = ["select", "drop", "union", "hello", "page", "alert", "script", "shop", "and", "or", "curl", "bash", "eval", "news", "item"]
    rows = []
    for _ in range(n):
        picked = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        odds = 1.5 * sum(w in ("drop", "union", "alert") for w in picked) - 1.0 * sum(w in ("hello", "shop") for w in picked) - 0.5
        rows.append((" ".join(picked), int(rng.random() < 1 / (1 + 2.718281828 ** -odds))))
    return spark.createDataFrame(rows, "text string, label int").repartition(4)


def test_sums_against_numpy(spark):
    df = with_features(samples(spark, 60, 1), "text")
    names = feature_names()
    rows = df.collect()
    x = np.array([[float(r[n]) for n in names] + [1.0] for r in rows])
    y = np.array([float(r.label) for r in rows])
    w = np.linspace(-0.1, 0.1, len(names) + 1)
    gradient, hessian, loss = batch_sums(df, w, np.zeros(len(names)), np.ones(len(names)))
    p = 1 / (1 + np.exp(-x @ w))
    assert np.allclose(gradient, x.T @ (p - y)) and np.allclose(hessian, (x * (p * (1 - p))[:, None]).T @ x)
    assert np.isclose(loss, -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def test_online_is_close_to_a_full_fit(spark, tmp_path):
    parts = [samples(spark, n, i) for i, n in enumerate((3000, 1000, 1000, 1000))]
    first = OnlineModel.start(parts[0])
    first.save(spark, str(tmp_path))
    learn = online_learner(str(tmp_path))
    for number, part in enumerate(parts[1:]):
        learn(part, number)
    learned = OnlineModel.load(spark, str(tmp_path), 2)
    assert learned.rows == 6000 and learned.batch == 2
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    # the same scale and penalty, all rows at once
    full = OnlineModel(np.zeros_like(first.weights), np.diag([1.0] * len(feature_names()) + [1e-9]), first.means, first.deviations).learned(whole)
    test = samples(spark, 300, 99)
    a, b = ([r.ml_score for r in m.score(test, "text").orderBy("text", "label").collect()] for m in (learned, full))
    assert np.abs(np.array(a) - np.array(b)).mean() < 1e-3
    # a batch that comes again changes nothing, and leaves nothing new
    again = OnlineModel.load(spark, str(tmp_path), 1)
    learn(parts[0], 1)
    assert np.array_equal(OnlineModel.load(spark, str(tmp_path), 1).weights, again.weights)
    # an empty batch and one without labels keep the weights
    learn(parts[0].limit(0), 3)
    learn(parts[0].withColumn("label", F.lit(None).cast("int")), 4)
    assert np.array_equal(OnlineModel.load(spark, str(tmp_path), 4).weights, learned.weights)


def test_first_fit_agrees_with_the_batch_model(spark):
    df = samples(spark, 800, 7)
    test = samples(spark, 100, 8)
    a, b = ([r.ml_score for r in m.score(test, "text").orderBy("text", "label").collect()] for m in (OnlineModel.start(df), TextModel.fit(df)))
    assert np.abs(np.array(a) - np.array(b)).max() < 2e-3


def test_json_objects_reach_the_event(spark):
    lines = [
        '{"a": {"b": [1, {"c": "deep"}]}, "peer": {"ip": "10.1.1.1"}, "message": "m", "code": "404", "when": "2024-01-02T03:04:05Z", "org": {"name": "acme"}}',
        '{"source_ip": "10.2.2.2", "peer": {"ip": "10.1.1.1"}, "tenant": "own", "status": 200, "request": {"method": "put", "path": "/p"}}',
        "{broken",
        "T INFO pod api hello",
    ]
    paths = {"source_ip": ["$.none", "$.peer.ip"], "status_code": ["$.code"], "timestamp": ["$.when"], "tenant": ["$.org.name"]}
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "event_id int, value string, fields string")
    events = normalize_events(parse_lines(df, json_paths=paths, whole_json=True))
    rows = events.select("event_id", "source_ip", "tenant", "http_status", "http_method", F.unix_seconds("ts").alias("s"), json_field("$.a.b[1].c").alias("deep"), json_field("$.a", "int").alias("odd")).orderBy("event_id").collect()
    assert tuple(rows[0]) == (0, "10.1.1.1", "acme", 404, None, 1704164645, "deep", None)
    assert tuple(rows[1])[1:5] == ("10.2.2.2", "own", 200, "PUT") and rows[1].deep is None
    assert rows[2].source_ip is None and rows[3].deep is None
    with pytest.raises(ValueError):
        parse_lines(df, json_paths={"nope": ["$.x"]})


def test_numbers_of_split_files(spark, tmp_path):
    import gzip

    rng = random.Random(1)
    want = {}
    for name, n in (("a.log", 8000), ("b.log", 3), ("c.log", 2000)):
        rows = ["".join(rng.choice("abc ") for _ in range(rng.randrange(60))) for _ in range(n)]
        text = "".join(x + rng.choice(["\n", "\r\n"]) for x in rows) + ("tail" if name == "b.log" else "")
        (tmp_path / name).write_bytes(text.encode())
        want[name] = rows + (["tail"] if name == "b.log" else [])
    (tmp_path / "z.log.gz").write_bytes(gzip.compress(b"one\n\nthree\n"))
    want["z.log.gz"] = ["one", "", "three"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        df = numbered_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = {}
        for r in df.collect():
            got.setdefault(r.source.split("/")[-1], {})[r.line_number] = r.value
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {name: dict(enumerate(rows, 1)) for name, rows in want.items()}


def test_hashed_keys_and_failed_limits(spark):
    df = spark.createDataFrame([("block_ip", ("1.2.3.4", None, None, None, "t", 5), True, 1), ("block_ip", ("1.2.3.4", None, None, None, "t", 5), False, 1)], f"kind string, target {rs.TARGET}, admitted boolean, ts_us long")
    plain, hidden = (df.select(rs.idempotency_key(F.col("kind"), F.col("target"), h).alias("k")).first().k for h in (False, True))
    assert plain == "block_ip|ip:1.2.3.4|tenant:t" and hidden.startswith("block_ip|ip:") and "1.2.3.4" not in hidden and len(hidden) == len("block_ip|ip:|tenant:t") + 16
    rows = rs.execute(df, fail_limited=True).select("status", "error").collect()
    assert [tuple(r) for r in rows] == [("executed", None), ("failed", "Rate limit exceeded")]


def test_tfidf(spark):
    df = training_samples(spark)
    model = tfidf_pipeline(vocabulary=50).fit(df)
    rows = model.transform(df).select("tfidf_features").collect()
    assert len(rows) == df.count() and all(r.tfidf_features.size <= 50 for r in rows) and any(r.tfidf_features.numNonzeros() for r in rows)


def test_online_scores_look_at_texts_once(spark, data_dir, monkeypatch):
    """Features are made once for all documents: to learn, to scale and to score."""
    from palisade import queries
    from palisade.operators import online

    made = []
    for module in (queries, online):
        monkeypatch.setattr(module, "with_features", lambda df, c, real=module.with_features: (made.append(c), real(df, c))[1])
    out = queries.online_scores(spark, data_dir)
    assert made == ["text"] and out.columns == ["doc_id", "ml_score"]
