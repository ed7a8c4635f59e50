"""Rules as a table against the rules as expressions."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.functions.fixed import RULES, RULES_CORRECTED
from palisade.operators.detect import rule_matches, rule_set
from palisade.operators.rule_table import needed_literals, rule_rows, with_rule_matches


def configured(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6)))
    forms = [lambda: f"(?i){word()}\\s+{word()}", lambda: f"{word()}|{word()}", lambda: f"({word()})?{word()}+", lambda: f"[xyz]{word()}\\d", lambda: f"(?i)(a|b){word()}", lambda: f"{word()[:2]}\\.{word()[:1]}"]
    return [(rng.choice(["xss", "sqli", "ssrf"]), rng.choice(["low", "high", "critical"]), rng.choice(forms)()) for _ in range(n)]


def texts(rules, n=300, seed=5):
    rng = random.Random(seed)
    bits = ["UNION  select", "<ScRiPt>", "../", "http://localhost", "10.", ";", "&&", "${jndi:", "é", "İK", " ", "\n", "eval (", "x", *(r[2].replace("(?i)", "").replace("\\s+", "  ").replace("\\d", "7").replace("\\.", ".").strip("()?+|") for r in rules[:200])]
    return ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 8))) for _ in range(n)] + [None, ""]


@pytest.mark.parametrize(
    ("pattern", "needs"),
    [("(?i)UNION\\s+select|drop", {"select", "drop"}), ("a(bc)?def+", {"de"}), ("x*", set()), ("(ab|cd)?z", {"z"}), ("\\d+", set()), ("(?:foo){2,}", {"foo"}), ("a|b*", set()), ("\\p{L}x", set()), ("[ab]cde\\.fg", {"cde.fg"})],
)
def test_what_patterns_need(pattern, needs):
    found = set(needed_literals(pattern))
    assert found == needs or (needs and found and min(map(len, found)) >= min(map(len, needs)))


def test_built_in_rules_have_literals():
    for _, _, p in [*RULES, *RULES_CORRECTED.values()]:
        assert needed_literals(p), p


def test_table_equals_expressions(spark):
    rules = [*rule_set("v1"), *rule_set("v2"), *configured(150), ("xss", "low", ".*q")]
    df = spark.createDataFrame([(t, "m", 1) for t in texts(rules)], "t string, m string, rule int").repartition(3)
    want = sorted((str(r.t), r.x) for r in df.select("t", rule_matches(F.col("t"), rules).alias("x")).collect())
    for lot_bytes in (1 << 20, 5000):  # one lot, and several
        got = with_rule_matches(df, "t", rule_rows(spark, rules), lot_bytes)
        assert got.columns == ["t", "m", "rule", "matches"]
        rows = [(str(r.t), [] if r.t is None else r.matches) for r in got.collect()]
        assert sorted(rows) == [(t, x) if t != "None" else (t, []) for t, x in want]
    assert sum(len(x) for _, x in want) > 500
    off = rule_rows(spark, rules).withColumn("enabled", F.when(F.col("rule") % 2 == 0, F.lit(False)))
    assert all(m.rule % 2 for r in with_rule_matches(df, "t", off).collect() for m in r.matches)
    assert with_rule_matches(df.limit(0), "t", rule_rows(spark, rules)).count() == 0


def test_time_is_nearly_flat_in_rules(spark):
    few, many = configured(20), configured(2000)
    df = spark.createDataFrame([(t,) for t in texts(many, 4000)], "t string").repartition(8).cache()
    df.count()
    seconds = []
    for rules in (few, few, many):
        start = time.perf_counter()
        with_rule_matches(df, "t", rule_rows(spark, rules)).select(F.sum(F.size("matches"))).collect()
        seconds.append(time.perf_counter() - start)
    assert seconds[2] < 20 * seconds[1] + 10  # a hundred times as many rules
    sample = df.limit(40).repartition(2)
    got = with_rule_matches(sample, "t", rule_rows(spark, many)).collect()
    for r in got:  # each of the 2,000, by Spark's own matcher
        one = spark.createDataFrame([(r.t, i, p) for i, (_, _, p) in enumerate(many, 1)], "t string, i int, p string").where(F.rlike("t", F.col("p"))).orderBy("i").collect() if r.t is not None else []
        assert [m.rule for m in r.matches] == [x.i for x in one]
        if got.index(r) >= 5:
            break


def test_candidates_come_in_bounded_parts():
    """What leaves Arrow at once is a few texts and places of rules, however large a batch is."""
    from palisade.operators.rule_table import Index

    index = Index([(i, "c", "low", 1, ".*") for i in range(10)] + [(10, "c", "low", 1, "needle")])
    texts = [f"text {i}" for i in range(99)] + [None, "a needle"]
    batch = pa.RecordBatch.from_pydict({"id": list(range(101)), "text": texts})
    parts = list(index.tried(batch, 1, most=100))
    assert len(parts) == 10 and max(len(p.column("_candidates").values) for p in parts) < 111
    rows = pa.Table.from_batches(parts).to_pylist()
    assert [r["id"] for r in rows] == list(range(101))
    assert [[c["rule"] for c in r["_candidates"]] for r in rows] == [*([[*range(10)]] * 99), [], [*range(11)]]
    assert len(list(index.tried(batch.slice(0, 0), 1))) == 0
