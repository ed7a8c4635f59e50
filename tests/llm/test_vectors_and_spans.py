"""Hard negatives, centroid clustering and personal data against brute force."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_as_oracle
from pyspark.sql import functions as F

from palisade.llm import centroids, hard_negatives, pii, vectors
from palisade.llm.oracles import ORACLES
from palisade.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score long"


def small_vectors(n=300, dim=6, seed=5):
    """Ties, copies, shared and null ids, null and broken vectors, and clashing extra columns."""
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-3, 3) / 4 for _ in range(dim)], rng.randrange(3)) for i in range(n)]
    rows += [(50, rows[7][1], 1), (100, rows[7][1], 1), (None, rows[7][1], 1), (None, rows[9][1], 2), (400, None, 1), (450, [1.0, None] * 3, 1)]
    rows += [(451, [float("nan")] * dim, 2), (500, [float("inf")] * dim, 2), (550, rows[3][1], None), (700, [], 0)]
    return [(*r, "x", 1) for r in rows]


def integer_rows(rows):
    return [(i, [math.floor(256 * x) for x in v], y) for i, v, y, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def mined(rows, anchor, positives=5, negatives=3):
    known = [(i, v, y) for i, v, y in integer_rows(rows) if y is not None]
    out = []
    for a, (aid, av, ay) in enumerate(known):
        if aid is None or not anchor(aid):
            continue
        found = sorted((-sum(x * y for x, y in zip(av, v, strict=False)), i is None, i or 0, k) for k, (i, v, _) in enumerate(known) if k != a)
        for minus, _, _, k in [x for x in found if known[x[3]][2] == ay][:positives]:
            p = -minus
            fits = [x for x in found if known[x[3]][2] != ay and 50 * p <= -100 * x[0] <= 95 * p][:negatives]
            out += [(aid, known[k][0], r, known[x[3]][0], p, -x[0]) for r, x in enumerate(fits, 1)]
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hard_negatives_against_brute_force(spark, monkeypatch):
    rows = small_vectors()
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for lot_bytes in (1 << 20, 600):  # one lot, and several
        got = hard_negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label"), lot_bytes=lot_bytes)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert as_rows(got) == sorted(mined(rows, lambda i: i % 10 == 0), key=str) != []


def test_hard_negatives_of_copies_and_of_nothing(spark):
    copies = [(i, [0.5, 1.0], 1, "x", 1) for i in range(5000)] + [(9000 + i, [0.4, 0.5], 2, "x", 1) for i in range(50)]
    df = spark.createDataFrame(copies, SCHEMA)
    got = hard_negatives.mine_hard_negatives(df, F.col("vec_id") == 2500, F.col("label"))
    assert [tuple(r)[1:4] for r in got.orderBy("positive_id", "rank").collect()] == [(p, r, 8999 + r) for p in range(5) for r in (1, 2, 3)]
    assert hard_negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") == 1, F.col("label")).count() == 0


@pytest.mark.parametrize("size", [3.0, 1e9, 1e15, 1e30])
def test_products_and_distances_stay_exact(size):
    rng = np.random.default_rng(1)
    a, b = np.floor(rng.normal(size=(7, 5)) * size), np.floor(rng.normal(size=(9, 5)) * size)
    whole = lambda m: [[int(x) for x in r] for r in m.tolist()]
    clip = lambda x: min(max(x, vectors.LEAST), vectors.MOST)
    assert vectors.products(a, b).tolist() == [[clip(sum(p * q for p, q in zip(x, y, strict=True))) for y in whole(b)] for x in whole(a)]
    assert centroids.squared_distances(a, b).tolist() == [[sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) for y in whole(b)] for x in whole(a)]


def clustered(rows, dim, clusters, rounds, seed="2"):
    import hashlib

    known = [(i, v) for i, v, _ in integer_rows(rows) if len(v) == dim]
    mark = lambda x: (x[0] is None, "" if x[0] is None else hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest(), x[1])
    c = [v for _, v in sorted(known, key=mark)[:clusters]]
    far = lambda v, k: sum((x - y) ** 2 for x, y in zip(v, c[k], strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda k: (far(v, k), k))
    for _ in range(rounds):
        groups = {}
        for _, v in known:
            groups.setdefault(nearest(v), []).append(v)
        c = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c[k] for k in range(len(c))]
    found = [(i, nearest(v), far(v, nearest(v))) for i, v in known]
    clip = lambda x: min(x, vectors.MOST)
    inertia = {k: sum(clip(d) for _, x, d in found if x == k) for _, k, _ in found}
    return [(i, k, clip(d), clip(inertia[k]), clip(sum(inertia.values())), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, k, d in found]


@pytest.mark.parametrize(("clusters", "scale"), [(7, 1.0), (40, 1e-2), (1000, 1.0), (5, 1e12), (5, 1e30)])
def test_clusters_against_brute_force(spark, clusters, scale):
    rows = [(i, v and [None if x is None else x * scale for x in v], y, *more) for i, v, y, *more in small_vectors(200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = centroids.cluster_vectors(df, dim=6, clusters=clusters, rounds=3, tree_rows=64, leaf=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert as_rows(got) == sorted(clustered(rows, 6, clusters, 3), key=str)


def test_clusters_of_copies_and_of_nothing(spark):
    rows = [(i, [1.0, 2.0], 0, "x", 1) for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = centroids.cluster_vectors(df, dim=2, tree_rows=100)
    assert {(r.cluster, r.distance, r.inertia) for r in got.collect()} == {(0, 0, 0)} and got.count() == 500
    assert centroids.cluster_vectors(df.limit(0), dim=2).count() == 0


def test_whole_balls_are_assigned():
    """On separate groups most points are settled by their ball alone, and as brute force has it."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-9000, 9000, (8, 5))
    points = (middle[rng.integers(0, 8, 2000)] + rng.integers(-20, 20, (2000, 5))).astype(float)
    row = centroids.BallTree(list(range(2000)), points, 16).row()
    tree = centroids.BallTree.of(row, 5, 16)
    whole = list(tree.filtered(middle.astype(float)))
    assert sum(int(tree.counts[level][node]) for level, node, _ in whole) > 1000
    assert (tree.clusters(middle.astype(float)) == centroids.squared_distances(tree.points, middle.astype(float)).argmin(axis=1)).all()
    assert all((tree.sums[0][0] == tree.points.sum(axis=0)) & (tree.counts[0][0] == 2000))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_centroids"])
def test_query_same_as_oracle(name, spark, oracle, data_dir):
    same_as_oracle(spark, oracle, QUERIES[name], ORACLES[name], data_dir)


# Personal data


def plain_base(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    out += [(m.start(), m.end(), "ip") for m in ip if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        odd = sum(int(x) for x in d[-1::-2]) + sum(sum(map(int, str(2 * int(x)))) for x in d[-2::-2])
        out += [(m.start(), m.end(), "card")] if 13 <= len(d) <= 19 and odd % 10 == 0 else []
    phone = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    return out + [(m.start(), m.end(), "phone") for m in phone if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def noise(rng):
    parts = ["+1 (523) 555-1055", "a.b@c.de", "x@y", "@", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "0255.0.0.1", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "é", "🙂", "-", " ", ".", "+", "(", "12", "0", "a@b.c@d.e", "٣٤"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(12)))


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    texts = [noise(rng) for _ in range(4000)]
    assert sum(bool(plain_base(t)) for t in texts) > 1000
    for t in texts:
        assert sorted(pii.base_spans(t)) == sorted(plain_base(t)), t


def test_long_texts_cost_linear_time():
    import time

    start = time.time()
    for t in ("1" * 10**6, "a" * 10**6 + "@", "a@" * 300_000, "+1" + " " * 10**6, "1 " * 500_000, "1." * 500_000, "(" * 10**6, "+ 4111111111111111 " * 30_000):
        pii.added_spans(t, pii.base_spans(t), {"card:bias": 1.0, "email:bias": 1.0}, 0.9)
    assert time.time() - start < 60


def paths(lattice):
    def grow(at, so_far):
        if at == lattice.size - 1:
            yield so_far
        for to in range(at + 1, lattice.size):
            for origin, arc in lattice.into[to]:
                if origin == at:
                    yield from grow(to, [*so_far, arc])

    return grow(0, [])


def test_lattice_against_all_segmentations():
    rng = random.Random(6)
    for text in ["017 555 7713 12", "+1 (523) 555-1055 190.137.223", "4111 1111 1111 1112", "bob (at) mail (dot) com.de@x.org", "12.34.56.78.90.12 3456"]:
        for arcs in pii.clusters(pii.segments(text, [])):
            lattice = pii.Lattice(arcs)
            w = {f: rng.uniform(-2, 2) for a in arcs for f in a.features} | {f"{a}>{b}": rng.uniform(-2, 2) for a in pii.KINDS for b in pii.KINDS}
            scored = []
            for path in paths(lattice):
                before, total = pii.OUTSIDE, 0.0
                for arc in path:
                    total += lattice.score(before, arc, w)
                    before = arc.kind
                scored.append((total, path))
            top = max(x for x, _ in scored)
            z = top + math.log(sum(math.exp(x - top) for x, _ in scored))
            norm, found = lattice.posteriors(w)
            assert abs(norm - z) < 1e-6
            share = {}
            for _, arc, p in found:
                share[arc] = share.get(arc, 0) + p
            for arc in arcs:
                assert abs(share[arc] - sum(math.exp(x - z) for x, path in scored if arc in path)) < 1e-6
            best = max(scored, key=lambda x: x[0])[1]
            assert abs(sum(lattice.score(b.kind if b else pii.OUTSIDE, a, w) for b, a in zip([None, *best], best, strict=False)) - top) < 1e-9
            assert lattice.best(w) == [a for a in best if a.kind != pii.OUTSIDE]


@pytest.fixture(scope="module")
def personal(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for _ in range(400):
        card = number(15)
        card += next(str(d) for d in range(10) if pii.luhn(card + str(d)))
        items = [f"{word().replace('é', 'e')}.{number(2)}@mail{number(1)}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", card, f"+1 ({number(3)}) 555-{number(4)}", f"version {number(1)}.{number(1)}", f"in 19{number(2)}", f"item {number(6)}"]
        words = [word() for _ in range(rng.randint(0, 30))]
        words.insert(rng.randint(0, len(words)), rng.choice(items))
        texts.append(" ".join(words))
    texts += [None, "", " ", "plain words", texts[0], "x " * 600_000 + texts[1], "write to bob.12 (at) mail (dot) example (dot) com now", "ring (523) 555-1055 today", "paid by 4111 1111 1111 1121 then", "on 2024-01-02 12:30:45 v1.2.3 pi 3.14159265358 isbn 978-3-16-148410-0 total 1,234,567.89"]
    rows = [(None if i == 5 else i // 2 * 2, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, base string, spans string").repartition(4)


def test_personal_data(spark, personal):
    got = pii.find_personal_data(personal.withColumnRenamed("text", "body"), text_col="body")
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"]
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.base, r.spans, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got.collect()), key=str)
    held = [(r.doc_id if r.doc_id is not None else -1, r.text or "") for r in personal.collect()]
    want = sorted(((i, pii.listed(plain_base(t)), *(sum(k == x[2] for x in plain_base(t)) for k in pii.KINDS)) for i, t in held), key=str)
    assert sorted(((i, b, *n) for i, b, _, *n in rows), key=str) == want
    for _, base, spans, *_ in rows:
        assert set(filter(None, base.split(","))) <= set(spans.split(","))
    added = lambda start: [s for i, b, s, *_ in rows if i == start]
    last = 2 * (409 // 2)
    assert [s for s in added(last - 2) if "email:9:" in s] and [s for s in added(last - 2) if s == "phone:5:19"]
    assert [s for s in added(last) if s.startswith("card:8:27")] and [s for s in added(last) if s == ""]


def test_personal_data_of_nothing(spark, personal):
    assert pii.find_personal_data(personal.limit(0)).count() == 0
    none = pii.find_personal_data(personal.where("text is null or text = ''"))
    assert [(r.base, r.spans, r.n_card) for r in none.collect()] == [("", "", 0)] * 2


def test_personal_data_query(spark, data_dir):
    got = QUERIES["op13_personal_data"](spark, data_dir)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert got.count() == spark.read.parquet(f"{data_dir}/documents.parquet").count()


def test_matrix_pads():
    assert vectors.matrix(pa.array([[1.0], [], [2.0, 3.0]])).tolist() == [[1, 0], [0, 0], [2, 3]]
    assert [b.num_rows for b in vectors.blocks(iter([pa.RecordBatch.from_pydict({"x": list(range(5))})]), 2)] == [2, 2, 1]
    assert list(itertools.chain(pii.clusters(iter(())))) == []


def test_personal_data_in_long_runs_of_numbers():
    """No cap on the groups of a run or the starts of an address: every stretch that fits is a candidate, and long runs are judged alike."""
    table = " ".join(str(i % 10) for i in range(60))
    arcs = list(pii.segments(f"{table} 4111 1111 1111 1112", []))
    assert any(a.kind == "card" and a.start == len(table) + 1 for a in arcs)
    assert {a.start for a in arcs if a.kind == "card"} >= {2 * i for i in range(48)}
    local = "a.b.c.d.e.f.g.h.i"
    starts = {a.start for a in pii.segments(f"{local} (at) mail.example.org", [])}
    assert starts == {2 * i for i in range(9)}
    w = {"card:bias": 1.0, "card:digits=16": 6.0, "card:luhn=False": 1.0, "card:left=blank": 1.0, "card:right=edge": 3.0, "card:groups=4-4-4-4": 9.0}
    short, long = (pii.added_spans(f"{x} 4111 1111 1111 1112", [], w, 0.5) for x in ("7 7 7", " ".join("7" * 3000)))
    assert (6, 25, "card") in short and (6000, 6019, "card") in long


def test_posteriors_add_up():
    lattice = pii.Lattice(list(pii.segments("555 123 4567 89", [])))
    w = {"phone:bias": 0.7, "card:bias": -0.3, "phone:digits=10": 0.5}
    _, each = lattice.posteriors(w)
    last = [(arc, p) for _, arc, p in each if arc.end == 15]
    assert abs(sum(p for _, p in last) - 1) < 1e-9
