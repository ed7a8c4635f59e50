"""Strings that collide under weak hashes, and texts longer than a slice, against brute force."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_corpus import removed

from palisade.llm import byte_repeats, quality, word_repeats
from palisade.llm.common import SLICE_BYTES, Rolling


def thue_morse(n, flip=False):
    return "".join("ab"[(k.bit_count() + flip) % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_thue_morse_words_and_lines_differ(spark, n):
    rest = [f"w{k}" for k in range(60)]
    texts = [" ".join([*rest[:30], thue_morse(n, f), *rest[30:]]) for f in (False, True)]
    df = spark.createDataFrame([*enumerate(texts), (2, texts[0])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in word_repeats.remove_repeated_words(df).collect()}
    assert got == {0: 0, 1: 0, 2: 61}
    lines = spark.createDataFrame([(0, f"{thue_morse(n)}\n{thue_morse(n, True)}\n{thue_morse(n)}", "en")], "doc_id long, text string, lang string")
    assert quality.judge_quality(lines).first().n_dup_lines == 1
    raw = spark.createDataFrame([(0, thue_morse(n)), (1, thue_morse(n, True))], "doc_id long, text string")
    want = removed([(0, thue_morse(n)), (1, thue_morse(n, True))], 100, True)
    assert {r.doc_id: r.n_removed for r in byte_repeats.remove_repeated_bytes(raw).collect()} == {i: sum(x) for i, x in want.items()}


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(4)
    words = [f"x{rng.randrange(10**6)}" for _ in range(200_000)]
    cut = SLICE_BYTES // 8
    words[cut - 40 : cut + 60] = words[10:110]
    second = [f"y{rng.randrange(10**6)}" for _ in range(180_000)]
    second[cut - 30 : cut + 70] = words[1000:1100]
    second[-60:] = words[-60:]
    return [(1, " ".join(words)), (2, " ".join(second)), (3, " ".join(second[100:300]))]


def test_texts_over_a_slice(spark, long_texts):
    assert all(len(t) > SLICE_BYTES for _, t in long_texts[:2])
    df = spark.createDataFrame(long_texts, "doc_id long, text string")
    want = removed([(i, tuple(t.split())) for i, t in long_texts], 50, False)
    assert {r.doc_id: r.n_removed for r in word_repeats.remove_repeated_words(df).collect()} == {i: sum(x) for i, x in want.items()}
    want = removed([(i, t.encode()) for i, t in long_texts], 100, True)
    got = {r.doc_id: (r.n_removed, len(r.spans)) for r in byte_repeats.remove_repeated_bytes(df).collect()}
    assert got == {i: (sum(x), len(re.findall(b"\1+", bytes(x)))) for i, x in want.items()}


def test_windows_whose_hashes_meet_are_compared_by_bytes(spark, monkeypatch):
    """With a useless rolling hash all windows of a seed meet; results stay right."""
    import numpy as np

    monkeypatch.setattr(Rolling, "every", lambda self, k: np.zeros(len(self.sums[0]) - k, np.uint64))
    from palisade.llm.repeats import same_bytes

    data = b"abcdabcx"
    assert same_bytes(data, np.array([0, 4]), np.array([0, 0]), 3)
    assert not same_bytes(data, np.array([0, 4]), np.array([0, 0]), 4)


def shared_ids(window):
    """Ids with several texts, some of which share passages, beside unique ids and repeated rows."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    shared = [[word() for _ in range(window + 20)] for _ in range(3)]
    rows = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            part, cut = rng.choice(shared), rng.randint(0, 20)
            words[len(words) // 2 : len(words) // 2] = part[cut : cut + window + rng.randint(-2, 10)]
        rows.append((rng.choice([None, i, 7, 7, 30]), " ".join(words)))
    rows += [rows[3], rows[3], (7, " ".join(shared[0])), (7, " ".join(shared[0] + shared[0])), (1, "x"), (5, "x y z"), (5, None), (8, "")]
    return rows


def removed_by(rows, symbols, length, within):
    """Each row's removed places, by the definition: a row is its id and its text."""
    seqs = [(i, t, symbols(t)) for i, t in rows]
    earliest, own = {}, {}
    for i, t, x in seqs:
        if i is not None:
            for j in range(len(x) - length + 1):
                w = tuple(x[j : j + length])
                earliest[w] = min(earliest.get(w, i), i)
                own.setdefault((w, i, t), j)
    out = []
    for i, t, x in seqs:
        gone = set()
        if i is not None:
            for j in range(len(x) - length + 1):
                w = tuple(x[j : j + length])
                if earliest[w] < i or (within and own[(w, i, t)] < j):
                    gone.update(range(j, j + length))
        out.append((i, len(x), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_rows", [1 << 15, 4])
def test_shared_ids_are_documents_of_their_own(spark, group_rows):
    rows = shared_ids(12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    words = word_repeats.remove_repeated_words(df, window=12, seed=4, group_rows=group_rows)
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in words.collect()), key=str)
    assert got == removed_by(rows, lambda t: (t or "").split(), 12, False) and sum(n for _, _, n in got) > 100
    data = byte_repeats.remove_repeated_bytes(df, window=40, seed=9, group_rows=group_rows)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in data.collect()), key=str)
    assert got == removed_by(rows, lambda t: (t or "").encode(), 40, True) and sum(n for _, _, n in got) > 100


def test_a_text_under_another_one_s_id_is_not_lost(spark):
    """As a reviewer found: (1, A), (5, A), (5, B), where B repeats nowhere."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    df = spark.createDataFrame([(1, a), (5, a), (5, b)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in word_repeats.remove_repeated_words(df).collect()) == [(1, 0), (5, 0), (5, 60)]
    assert sorted((r.doc_id, r.n_removed) for r in byte_repeats.remove_repeated_bytes(df).collect()) == [(1, 0), (5, 0), (5, len(a))]
    docs = df.selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    out = corpus_pipeline.remove_repeated_passages(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (5, b)] and out.columns == docs.columns


def test_texts_that_lose_nothing_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, "two  blanks\nhere ", "k"), (2, None, None)], "doc_id long, text string, kept string")
    rows = word_repeats.remove_repeated_words(df.withColumnRenamed("kept", "more"), keep=("more",), as_they_are=True).orderBy("doc_id").collect()
    assert [(r.kept, r.more) for r in rows] == [("two  blanks\nhere ", "k"), (None, None)]


@pytest.mark.parametrize("name", ["*", "-"])
def test_language_names_cannot_clash(spark, data_dir, name):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    seen = sorted(tuple(r) for r in quality.judge_quality(docs).select("doc_id", "kept", "base_failed", "log_ppl").collect())
    renamed = docs.withColumn("lang", F.when(F.col("lang") == "en", F.lit(name)).otherwise(F.col("lang")))
    again = sorted(tuple(r) for r in quality.judge_quality(renamed).select("doc_id", "kept", "base_failed", "log_ppl").collect())
    assert [r[:3] for r in seen] == [r[:3] for r in again]
    assert all(abs((x[3] or 0) - (y[3] or 0)) < 1e-9 for x, y in zip(seen, again, strict=True))
