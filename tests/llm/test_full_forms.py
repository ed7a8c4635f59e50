"""The two substring operators in their full forms, a row for each symbol, against brute force."""

import random

import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from palisade.llm import bpe, byte_repeats, de_bruijn, word_repeats
from palisade.llm.difference_cover import levels_for


def removed(texts, window, within):
    """{id: flags of removed symbols}; texts: {id: sequence}."""
    first, gone = {}, {}
    for i in sorted(texts):
        x = texts[i]
        gone[i] = [False] * len(x)
        for p in range(len(x) - window + 1):
            w = tuple(x[p : p + window])
            doc, start = first.setdefault(w, (i, p))
            if doc < i or (within and start < p):
                gone[i][p : p + window] = [True] * window
    return gone


def runs(flags):
    out = []
    for p, f in enumerate(flags):
        if f and out and out[-1][1] == p:
            out[-1][1] = p + 1
        elif f:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


def rows(seed, letters, cut):
    rng = random.Random(seed)
    base = [[rng.choice(letters) for _ in range(150)] for _ in range(3)]
    out = []
    for i in range(25):
        x = []
        for _ in range(rng.randrange(4)):
            b, at = rng.choice(base), rng.randrange(100)
            x += b[at : at + rng.randrange(80)] + [rng.choice(letters) for _ in range(rng.randrange(30))]
        out.append((i, cut.join(x)))
    one = base[0]
    left_and_back = [cut.join(one[:50] + [c] * 40 + one[90:]) for c in "wv"]  # leaves a path and comes back to it
    return [*out, (90, None), (91, ""), (92, cut.join("x" * 100)), (93, cut.join("x" * 60)), (None, cut.join(one)), (94, left_and_back[0]), (95, cut.join(one)), (96, left_and_back[1]), (97, cut.join("ab" * 50)), (98, cut.join("ba" * 40)), (-5, cut.join(one[20:70]))]


@pytest.mark.parametrize("window", [9, 30])
def test_difference_cover(spark, window):
    data = [*rows(window, "ab", ""), (99, "é" * 40)]
    found = byte_repeats.remove_repeated_bytes(spark.createDataFrame(data, "doc_id long, text string"), window=window, method="difference_cover").collect()
    want = removed({i: (t or "").encode() for i, t in data if i is not None}, window, True)
    assert len(found) == len(data)
    for r in found:
        flags = want.get(r.doc_id, [])
        assert [(s.start, s.end) for s in r.spans] == runs(flags) and r.n_removed == sum(flags)


@pytest.mark.parametrize("seed", [1, 2])
def test_de_bruijn(spark, seed):
    data = rows(seed, "abcd", " ")
    found = word_repeats.remove_repeated_words(spark.createDataFrame(data, "doc_id long, text string"), window=12, method="de_bruijn").collect()
    want = removed({i: (t or "").split() for i, t in data if i is not None}, 12, False)
    assert len(found) == len(data)
    for r in found:
        flags = want.get(r.doc_id, [])
        assert runs(flags) == [(s.start, s.end) for s in r.spans] and r.n_removed == sum(flags)


def test_full_forms_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert word_repeats.remove_repeated_words(empty, method="de_bruijn").count() == 0
    assert byte_repeats.remove_repeated_bytes(empty, window=9, method="difference_cover").count() == 0
    assert [levels_for(w) for w in (3, 9, 10, 100)] == [0, 1, 2, 4]


def shared_and_long(window):
    """Rows of shared, repeated and null ids with passages of several blocks, and the words that each (id, text) loses by brute force."""
    rng = random.Random(window)
    base = [f"w{rng.randrange(5000)}" for _ in range(420)]
    other = [f"v{k}" for k in range(60)]
    cuts = [(3, 0, 420), (3, 100, 300), (5, 20, 400), (5, 20, 400), (5, 250, 420), (9, 0, 64), (None, 0, 420), (-4, 63, 130), (8, 10, 10 + window - 1)]
    rows = [(i, " ".join(base[a:b])) for i, a, b in cuts]
    rows += [(10, " ".join(base[:200] + other + base[180:])), (11, " ".join(other + base[200:260] + other)), (12, " ".join(["x"] * 300)), (13, " ".join(["x"] * 200)), (14, None)]
    firsts, lost = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        words = t.split()
        for p in range(len(words) - window + 1):
            firsts.setdefault(tuple(words[p : p + window]), i)
    for i, t in rows:
        words, gone = (t or "").split(), set()
        for p in range(len(words) - window + 1 if i is not None else 0):
            if firsts[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        lost[i, t] = gone
    return rows, lost


@pytest.mark.parametrize("window", [12, 50])
def test_de_bruijn_of_shared_ids_and_long_paths(spark, window):
    rows, lost = shared_and_long(window)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = word_repeats.remove_repeated_words(df.withColumn("whole", F.col("text")), window=window, method="de_bruijn", keep=("whole",)).collect()
    assert sorted((str(r.doc_id), str(r.whole)) for r in found) == sorted((str(i), str(t)) for i, t in rows)
    for r in found:
        gone = lost[r.doc_id, r.whole]
        assert r.n_removed == len(gone) and r.kept == " ".join(w for p, w in enumerate((r.whole or "").split()) if p not in gone)


def test_pipeline_goes_through_the_graph(spark, monkeypatch):
    import corpus_pipeline as cp

    def never(*args):
        raise AssertionError("the stage left its method")

    monkeypatch.setattr(word_repeats, "repeated_ranges", never)
    rows, lost = shared_and_long(50)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = []
    for i, t in rows:
        words, gone = (t or "").split(), lost[i, t]
        if not gone or len(gone) < len(words):
            want.append((i, " ".join(w for p, w in enumerate(words) if p not in gone) if gone else t))
    got = cp.remove_repeated_passages(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_paths_are_compacted_to_their_heads(spark):
    """Across many blocks, with links that branch on either side, at block ends too, and places left out."""
    rng = random.Random(3)
    rows, heads = [], {}
    for doc, n, size in [(1, 1, 2000), (1, 2, 130), (2, 1, 64), (3, 1, 1)]:
        cuts = {rng.randrange(size) for _ in range(4)} | {128, 640}
        gaps = {rng.randrange(size) for _ in range(3)} if size > 64 else set()
        ok = False
        for p in range(size):
            if p in gaps:
                ok = False
                continue
            before, after = p not in cuts, p + 1 not in {700, 1024}
            heads[doc, n, p] = heads[doc, n, p - 1] if ok and before else p
            ok = after
            rows.append((doc, n, p, before, after))
    graph = spark.createDataFrame(rows, "fd long, fn int, fp long, before boolean, after boolean").repartition(3)
    assert {(r.fd, r.fn, r.fp): r["head"] for r in de_bruijn.paths(graph).collect()} == heads


def test_texts_hold_every_repeated_window(spark):
    rng = random.Random(5)
    texts = {i: [rng.choice("abcdef") for _ in range(rng.randrange(400))] for i in range(12)}
    for i in range(1, 12, 2):
        texts[i][30:30] = texts[i - 1][10:90]
    df = spark.createDataFrame([(i, 0, " ".join(x)) for i, x in texts.items()], "doc long, row long, text string")
    wanted = {(r.doc, p) for r in de_bruijn.texts_of(df, 12).collect() for x in r.wanted for p in range(x["start"], x["start"] + x["windows"])}
    where = {}
    for i, x in texts.items():
        for p in range(len(x) - 11):
            where.setdefault(tuple(x[p : p + 12]), set()).add((i, p))
    repeated = {at for places in where.values() if len({i for i, _ in places}) > 1 for at in places}
    assert repeated and repeated <= wanted and len(wanted) < sum(len(x) for x in texts.values())


class Held:
    """Stands for a table: keeps the function that mapInArrow gets."""

    def select(self, *columns):
        return self

    where = withColumnRenamed = select

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def packed_batch(texts, ranges):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    packed = [None if t is None else zstandard.ZstdCompressor().compress(t.encode()) for t in texts]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(packed, pa.binary()), pa.array(ranges, kind)], names=["doc", "packed", "ranges"])


def test_results_leave_in_bounded_batches(monkeypatch):
    """Texts that pack well: one Arrow batch of them is many times as large unpacked, and must not be unpacked whole."""
    held = Held()
    monkeypatch.setattr(word_repeats, "identified", lambda *args: held)
    monkeypatch.setattr(word_repeats, "with_ranges", lambda *args: held)
    monkeypatch.setattr(de_bruijn, "repeated_ranges", lambda *args: None)
    word_repeats.remove_repeated_words(held, method="de_bruijn", as_they_are=True)
    texts = [None, "", *(f"{i} " + "word  " * 40_000 for i in range(40))]
    ranges = [None, None, *([{"start": 1, "end": 40_000}] if i % 2 else None for i in range(40))]
    batch = packed_batch(texts, ranges).slice(1)
    assert batch.nbytes < 1 << 18
    found = list(held.run(iter([batch])))
    assert max(x.nbytes for x in found) < 3 << 20  # before: all 5 MB of results (10 MB of texts) in one
    rows = pa.Table.from_batches(found).to_pylist()
    assert [r["doc"] for r in rows] == list(range(1, 42))
    assert [r["kept"] for r in rows] == ["", *(f"{i} word" if i % 2 else texts[i + 2] for i in range(40))]
    assert [r["n_removed"] for r in rows] == [0, *(39_999 if i % 2 else 0 for i in range(40))]


def test_workers_hold_no_tables_of_other_stages():
    held = Held()
    de_bruijn.stretches(held, 12)
    bpe._loaded["file", 1] = object()
    text = " ".join("abcdefgh" * 8)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["doc", "row", "text"])
    given = list(held.run(iter([batch])))
    assert sum(x.column("windows").to_numpy().sum() for x in given) == 64 - 12 + 1
    assert not bpe._loaded  # before: a tokenizer stayed in every worker that had run bpe


def test_edges_of_long_stretches_come_in_parts():
    """A stretch of one text with more windows than go into one batch."""
    held = Held()
    de_bruijn.edges(held, 50)
    count = 3 * de_bruijn.AT_ONCE
    kind = pa.list_(pa.struct([("start", pa.int64()), ("windows", pa.int64())]))
    packed = zstandard.ZstdCompressor().compress(("x " * (count + 60)).encode())
    wanted = pa.array([[], [{"start": 7, "windows": count}], [{"start": 0, "windows": 1}, {"start": 3, "windows": 2}]], kind)
    arrays = [pa.array([5, 6, 7]), pa.array([1, 1, 2], pa.int32()), pa.array([packed] * 3, pa.binary()), wanted]
    batch = pa.RecordBatch.from_arrays(arrays, names=["doc", "n", "packed", "wanted"]).slice(1)
    found = list(held.run(iter([batch])))
    assert max(x.num_rows for x in found) <= de_bruijn.AT_ONCE
    rows = pa.Table.from_batches(found).to_pydict()
    assert list(zip(rows["doc"], rows["n"], rows["p"], strict=True)) == [*((6, 1, 7 + k) for k in range(count)), (7, 2, 0), (7, 2, 3), (7, 2, 4)]
    assert len(set(rows["e"])) == 1
