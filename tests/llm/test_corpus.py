"""The corpus operators against brute force and planted edge cases."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from conftest import same_as_oracle
from pyspark.sql import functions as F

from palisade.llm import bpe, byte_repeats, chat, langid, metric_tree, mixing, near_copies, quality, simhash, url_filter, word_repeats
from palisade.llm.oracles import ORACLES
from palisade.llm.queries import QUERIES, tokenizer_file

WORD = rb"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, size string"


def passages(seed=3, docs=60):
    """Texts with shared passages, copies, repeats, empty and null ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 5)))
    shared = [[word() for _ in range(70)] for _ in range(4)]
    out = []
    for _ in range(docs):
        words = [word() for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(shared)
            cut = rng.randint(0, 20)
            at = rng.randint(0, len(words))
            words[at:at] = part[cut : cut + rng.randint(30, 70)]
        out.append(rng.choice([" ", "\n", "  "]).join(words))
    return [*out, out[0], out[1], "", None, "ab " * 120, "ab " * 120, "x" * 400, "\x0b \t"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, None if i % 7 == 0 else "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 4}", 0, "e", "z") for i, t in enumerate(passages())]
    return spark.createDataFrame([*rows, rows[2], (None, rows[3][1], "en", "s1", 0, None, None)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def distinct_texts(docs):
    return sorted({(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None})


def removed(seqs, length, within):
    first = {}
    for i, x in seqs:
        for j in range(len(x) - length + 1):
            first.setdefault(x[j : j + length], (i, j))
    out = {}
    for i, x in seqs:
        gone = bytearray(len(x))
        for j in range(len(x) - length + 1):
            f = first[x[j : j + length]]
            if f[0] < i or (within and f < (i, j)):
                gone[j : j + length] = b"\1" * length
        out[i] = gone
    return out


@pytest.mark.parametrize("group_rows", [1 << 15, 1])
def test_word_repeats(docs, group_rows):
    seqs = [(i, tuple((t or "").encode().split())) for i, t in distinct_texts(docs)]
    want = removed(seqs, 50, False)
    got = word_repeats.remove_repeated_words(docs, group_rows=group_rows).collect()
    assert len(got) == docs.count()
    texts = dict(seqs)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        assert (r.n_words, r.n_removed) == (len(texts[r.doc_id]), sum(want[r.doc_id]))
        assert r.kept.encode() == b" ".join(w for w, g in zip(texts[r.doc_id], want[r.doc_id], strict=True) if not g)


@pytest.mark.parametrize("group_rows", [1 << 15, 1])
def test_byte_repeats(docs, group_rows):
    seqs = [(i, (t or "").encode()) for i, t in distinct_texts(docs)]
    want = removed(seqs, 100, True)
    texts = dict(seqs)
    for r in byte_repeats.remove_repeated_bytes(docs, group_rows=group_rows).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        gone = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, len(r.spans)) == (len(gone), sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert bytes(r.kept) == bytes(b for b, g in zip(texts[r.doc_id], gone, strict=True) if not g)


def brute_fingerprint(text, k):
    words = re.findall(WORD, (text or "").encode().lower())
    shingles = [b" ".join(words[j : j + k]) for j in range(max(1, len(words) - k + 1))] if words else []
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(fps, radius):
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_documents(docs):
    texts = dict(distinct_texts(docs))
    want = components({i: brute_fingerprint(t, 4) for i, t in texts.items()}, 4)
    got = simhash.near_duplicates(docs.where("doc_id is not null")).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in got} == {i: (brute_fingerprint(t, 4), want[i]) for i, t in texts.items()}


@pytest.mark.parametrize(("radius", "cell_rows", "distinct"), [(4, 20_000, 100), (4, 3, 10**7), (4, 20_000, 10**9), (8, 5, 1000)])
def test_grid_join_finds_all_links(spark, radius, cell_rows, distinct):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, 2**64 - 1}
    for f in sorted(fps):
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(1, radius + 2)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    want = components(dict(enumerate(fps)), radius)
    reps = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    parent = simhash.Forest()
    for r in simhash.link_cells(simhash.grid_cells(reps, radius, cell_rows, distinct), radius).collect():
        parent.link(r.a, r.b)
    got = {}
    for i, f in enumerate(fps):
        got.setdefault(parent.find(int(np.uint64(f).view(np.int64))), set()).add(i)
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def similar(texts, k=5):
    """Components of ids whose texts have shingle sets of Jaccard similarity 0.8 or more."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(WORD, (t or "").encode().lower())
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def edited(docs=12, copies=12, seed=11):
    """Texts and copies with more and more words changed, around similarity 0.8; short, empty and null texts."""
    rng = random.Random(seed)
    out = ["", None, " \t", "one", "One", "one two", "one two three four", "one two three four five"]
    for _ in range(docs):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([12, 60, 150, 400]))]
        for c in range(copies):
            new = list(words)
            for _ in range(c * len(words) // 200 + c % 3):
                new[rng.randrange(len(new))] = f"v{rng.randrange(3000)}"
            out.append(" ".join(new))
    return dict(enumerate(out))


@pytest.mark.parametrize("rounds", [2, 0])
@pytest.mark.parametrize("dense", [near_copies.DENSE, 0])
def test_near_copies_by_exact_similarity(spark, rounds, dense, monkeypatch):
    """No wrong link, and nearly all right ones: all in groups where links support each other."""
    monkeypatch.setattr(near_copies, "DENSE", dense)
    monkeypatch.setattr(near_copies, "SMALL_CELL", 64 if dense else 1)
    texts = edited()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, id int, set_id string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, rounds=rounds).collect()}
    want = similar(texts)
    assert set(got) == set(want) and all(want[i] == want[c] for i, c in got.items())
    assert len(set(got.values())) <= len(set(want.values())) + 1


def test_recall_of_candidates_by_similarity(spark):
    """Share of pairs that the grids find, by Jaccard similarity."""
    rng = random.Random(9)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 500]))]
        for c in (0, 1, 2, 3, 4):
            new = list(words)
            for _ in range(c * len(words) // 110):
                new[rng.randrange(len(new))] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(new).encode())
    hashes, at = near_copies.shingle_sets(texts, 5)
    sets = [set(hashes[at[i] : at[i + 1]].tolist()) for i in range(len(texts))]
    fp = near_copies.fingerprints(hashes, at).view(np.int64)
    columns = ["id", "n", *(f"f{k}" for k in range(near_copies.WORDS))]
    reps = spark.createDataFrame([(i, len(sets[i]), *map(int, f)) for i, f in enumerate(fp)], ", ".join(f"{c} long" for c in columns))
    met = near_copies.candidate_pairs(near_copies.cell_rows(reps, near_copies.grids(len(texts)))).where("b is not null").select("a", "b").distinct()
    found = {(r.a, r.b) for r in met.collect()}
    bands = {80: [0, 0], 85: [0, 0], 90: [0, 0]}
    for g in range(0, len(texts), 5):
        for i in range(g, g + 5):
            for j in range(i + 1, g + 5):
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if 0.8 <= s < 1:
                    band = bands[80 if s < 0.85 else 85 if s < 0.9 else 90]
                    band[0] += (i, j) in found
                    band[1] += 1
    print(bands)
    assert all(n >= 30 for _, n in bands.values())
    assert bands[80][0] >= 0.95 * bands[80][1] and bands[85][0] >= 0.98 * bands[85][1] and bands[90][0] >= 0.99 * bands[90][1]


def test_pipeline_drops_copies_from_similarity_080(spark):
    import corpus_pipeline as cp

    texts = {i: t for i, t in edited(seed=12).items() if t and t.strip()}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = similar(texts)
    assert {r.doc_id for r in cp.drop_near_copies(spark, df, "").collect()} == {i for i in want if want[i] == i}


def test_pipeline_keeps_texts_of_null_and_shared_ids(spark):
    import corpus_pipeline as cp

    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(None, "a"), (None, "a"), (None, "b"), (None, "e"), (7, "c"), (7, "d"), (8, "c"), (9, "e")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    near = cp.drop_near_copies(spark, spark.createDataFrame([(i, text(c), "en", "s", 0) for i, c in rows], schema), "").collect()
    assert Counter((r.doc_id, r.text[0]) for r in near) == Counter([(None, "a"), (None, "b"), (7, "c"), (7, "d"), (9, "e")])
    mixed = cp.mix(spark, spark.createDataFrame([tuple(r) for r in near], schema), "").collect()
    times = Counter((r.doc_id, r.text[0]) for r in mixed)
    assert set(times) == {(r.doc_id, r.text[0]) for r in near} and max(times.values()) <= 2


def test_large_cells_are_linked_one_by_one(spark, monkeypatch):
    fp = np.unique(np.random.default_rng(0).integers(0, 2**12, 900).astype(np.uint64))
    small, large = simhash.Forest(), simhash.Forest()
    simhash._link_large(fp, 2, large)
    for i, a in enumerate(fp):
        for b in fp[:i]:
            if int(a ^ b).bit_count() <= 2:
                small.link(int(a), int(b))
    assert len({large.find(int(x)) for x in fp}) == len({small.find(int(x)) for x in fp})


def test_mixing_overlapping_sources(spark):
    rows = [(i, 10 + i % 5, ["a"] if i % 3 else ["a", "b"]) for i in range(300)] + [(1000 + i, 7, ["b", None]) for i in range(50)] + [(2000, None, None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "id long, size long, sources array<string>"), "id", "size", "sources", buckets=8).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix_sources(spark.createDataFrame(rows[::-1], "id long, size long, sources array<string>"), "id", "size", "sources", buckets=8).collect()
    assert sorted((r.id, r.taken) for r in got) == sorted((r.id, r.taken) for r in again)
    total = sum(r.size for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * total) <= 40


def test_flow_prefers_few_repeats():
    flow = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15}, 2)
    assert sum(flow.values()) == 30 and flow[("a",)] == flow[("b",)] == flow[("a", "b")] == 10


def test_flow_is_largest_and_cheapest():
    """Against all flows of small networks."""
    from itertools import product

    rng = random.Random(6)
    for _ in range(60):
        patterns = {p: rng.randint(0, 3) for p in rng.sample([("a",), ("b",), ("a", "b")], rng.randint(1, 3))}
        quotas, most = {s: rng.randint(0, 6) for s in "ab"}, rng.randint(1, 2)
        price = lambda used, size: sum(2 * r + 1 for r in range(most) for _ in range(max(0, min(size, used - r * size))))
        ways = [[(x, y) for x in range(most * n + 1) for y in range(most * n + 1 - x) if (not x or "a" in p) and (not y or "b" in p)] for p, n in patterns.items()]
        fits = [w for w in product(*ways) if sum(x for x, _ in w) <= quotas["a"] and sum(y for _, y in w) <= quotas["b"]]
        want = min((-sum(map(sum, w)), sum(price(sum(x), n) for x, n in zip(w, patterns.values(), strict=True))) for w in fits)
        flow = mixing.route(patterns, quotas, most)
        assert want == (-sum(flow.values()), sum(price(flow[p], n) for p, n in patterns.items()))


def test_langid(docs, spark):
    rows = [(i, t, "de" if i % 2 else "en") for i, t in enumerate(["the cat and the dog ", "der hund und die katze "] * 40)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "the dog and the cat"), (2, "die katze und der hund"), (3, None), (4, "123 !!"), (5, ""), (6, "DIE KATZE")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(asked, known).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score > 0.5 and got[3].score == 0
    assert {r.lang_pred for r in langid.identify(asked, known.limit(0)).collect()} == {"und"}


def test_grams_stay_in_their_text():
    one = langid.Grams(["ab", "cd", "x"], 3)
    alone = [langid.Grams([t], 3) for t in ("ab", "cd", "x")]
    assert sorted(one.grams[one.back].tolist()) == sorted(g for a in alone for g in a.grams[a.back].tolist())
    assert np.bincount(one.of, minlength=3).tolist() == [2, 2, 1]


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 2, "user", "more"), (4, 0, None, None), (4, 0, None, None), (5, 0, "user", "bye"), (6, 0, "user", "bye"), (None, 0, "user", "n"), (7, 5, "user", "hi"), (7, None, "x", "y")]
    got = {r.conv_id: (r.n_turns, r.n_equal, r.rendered) for r in chat.collapse_snapshots(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {3, 4, 5, None, 7}
    assert got[5][:2] == (1, 2) and got[3][0] == 3 and got[4] == (1, 1, "<|im_start|>unknown\n<|im_end|>\n")


@pytest.mark.parametrize(("tree_rows", "page", "pivots"), [(8192, 64, 64), (50, 4, 3)])
def test_top_k(spark, tree_rows, page, pivots):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    vectors += [(600 + i, vectors[0][1]) for i in range(30)] + [(100, vectors[100][1]), (100, vectors[7][1]), (101, [20000.0] + [0.0] * 7), (None, vectors[0][1])]
    vectors += [(800, [1e9, 3.0] + [0.0] * 6), (801, [-1e9] + [0.0] * 7), (850, [20000.0] * 8), (704, []), (750, [0.0] * 8)]
    usable = len(vectors)
    vectors += [(700, None), (701, [1.0, float("nan")] * 4), (702, [None] * 8), (703, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors], "vec_id long, embedding array<float>, id string, row int")
    got = metric_tree.top_inner_products(df, F.col("vec_id") % 50 == 0, tree_rows=tree_rows, page=page, pivots=pivots, share_rows=4).collect()
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v))) for i, v in vectors[:usable]]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = Counter()
    for n, (q, v) in enumerate(ints):
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i is None, i or 0) for m, (i, w) in enumerate(ints) if m != n)
            want.update((q, r + 1, None if none else i, clip(-s)) for r, (s, none, i) in enumerate(scored[:10]))
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want


def test_globs():
    automaton = url_filter.ShiftAnd([url_filter.Glob("block", p).tokens() for p in ("*a?c*/**", "**/*.exe", "x" * 130 + "*", "\\*b")])
    texts = [b".abc/x/y", b".a/c/", b"h/d/f.exe", b"x" * 140, b"x" * 129, b"*b", b"ab", b""]
    want = [[1, 0, 0, 0], [0, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0], [0, 0, 0, 1], [0, 0, 0, 0], [0, 0, 0, 0]]
    assert automaton.match(texts).astype(int).tolist() == want


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_file())
    texts = [r.text for r in docs.collect()] + ["a<|endoftext|>b  \n\n x", "日本語 🙂" * 50, "aaaa" * 3000, " \t ", "don't"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(df, tokenizer_file())
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in encoded.collect()}
    back = {r.doc_id: r.text for r in bpe.decode(encoded, tokenizer_file()).collect()}
    for i, t in enumerate(texts):
        assert ids[i] == reference.encode(t or "", add_special_tokens=False).ids
        assert back[i] == reference.decode(ids[i], skip_special_tokens=False) == (t or "")


def test_quality(spark, docs):
    got = {r.doc_id: r for r in quality.judge_quality(docs).collect()}
    for i, t in distinct_texts(docs):
        words = re.findall(WORD.decode(), t or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD.decode(), x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words)) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("model_mb", [256, 0])
def test_quality_rejects_odd_texts(spark, model_mb, monkeypatch):
    """Gibberish, long and short, goes; usual texts stay, also those in two languages; models in parts give the same."""
    rng = random.Random(2)
    words = {"en": ["the", "cat", "sat", "on", "mat", "dog", "ran", "far"], "ru": ["кот", "сидел", "дома", "пёс", "бежал", "далеко"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice({"en": "aeiou", "ru": "аеиоу"}[lang]) for _ in range(n))
    usual = [(text(x, 200), x) for x in ("en", "ru") for _ in range(150)]
    mixed = [(text("en", 60) + " " + text("ru", 60), "en")]
    odd = [(" ".join("".join(rng.choice("qxzjkvwpbg0123456789") for _ in range(6)) for _ in range(n)), "en") for n in (60, 200)]
    df = spark.createDataFrame([(i, t, x, "e") for i, (t, x) in enumerate([*usual, *mixed, *odd])], "doc_id long, text string, lang string, grams string")
    if not model_mb:
        monkeypatch.setattr(quality, "ENTRY_BYTES", 1 << 12)
        real = quality.judge_quality(df).select("doc_id", "log_ppl", "all_ppl").collect()
    got = {r.doc_id: r for r in quality.judge_quality(df, **({} if model_mb else {"model_mb": 1})).collect()}
    if not model_mb:
        assert sorted((r.doc_id, r.log_ppl, r.all_ppl) for r in real) == sorted((r.doc_id, r.log_ppl, r.all_ppl) for r in got.values())
    assert not got[301].kept and not got[302].kept and all(got[i].kept for i in range(301) if not got[i].base_failed)


def test_kneser_ney_by_brute_force(spark):
    """Perplexities of a small corpus against the formulas written out."""
    texts = ["the cat sat on the mat", "the dog ran", "a cat and a dog", "mat on mat"]
    model = quality.kneser_ney(quality.gram_counts(spark.createDataFrame([("g", t) for t in texts], "grp string, text string")))
    chars = lambda t: [0, 0, *(0 if c == " " else ord(c) for c in t)]
    counts = [None, Counter(), Counter(), Counter()]
    for t in texts:
        c = chars(t)
        counts[3].update(tuple(c[i : i + 3]) for i in range(len(c) - 2))
    for n in (2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut = {}
    for n in (1, 2, 3):
        few = [sum(v == i for v in counts[n].values()) for i in range(5)]
        y = few[1] / (few[1] + 2 * few[2]) if few[1] + few[2] else 0
        cut[n] = [0] + [max(0.05, min(i, i - (i + 1) * y * few[i + 1] / few[i])) if all(few[1:]) else i / 2 for i in (1, 2, 3)]

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        n = len(gram)
        after = {g: v for g, v in counts[n].items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        return max(0, after.get(gram, 0) - (cut[n][min(3, after[gram])] if gram in after else 0)) / total + sum(cut[n][min(3, v)] for v in after.values()) / total * p(gram[1:])

    arrays = quality.model_part(model, "g", 0, 1)
    asked = [(0, 0, 116), (116, 104, 101), (99, 97, 116), (122, 122, 122), (111, 110, 0), (97, 116, 113)]
    packed = np.array([a << 42 | b << 21 | c for a, b, c in asked], np.int64)
    assert np.allclose(arrays.surprise(packed), [-np.log(p(g)) for g in asked], rtol=1e-5)
    split = sum(quality.model_part(model, "g", k, 3).surprise(packed) for k in range(3))
    assert np.allclose(split, arrays.surprise(packed), rtol=1e-5)


def test_empty_tables(empty, spark):
    assert simhash.near_duplicates(empty).count() == 0
    assert word_repeats.remove_repeated_words(empty).count() == byte_repeats.remove_repeated_bytes(empty).count() == 0
    assert langid.identify(empty, empty).count() == quality.judge_quality(empty).count() == bpe.round_trip(empty, tokenizer_file()).count() == 0
    assert mixing.mix_sources(empty.select("doc_id", F.lit(1).alias("size"), F.array("source").alias("sources")), "doc_id", "size", "sources").count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric_tree.top_inner_products(vectors, F.lit(True)).count() == 0
    assert chat.collapse_snapshots(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"), []).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_oracle(name, spark, oracle, data_dir):
    same_as_oracle(spark, oracle, QUERIES[name], ORACLES[name], data_dir)


def test_held_out_accuracy(spark, data_dir):
    truth = spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_langid"](spark, data_dir).where("held_out").join(truth, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as cp

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    start = docs.where("doc_id is not null").select(*columns)
    now, counts = start, {}
    for name, stage in cp.STAGES:
        path = str(tmp_path / name)
        stage(spark, now, "").write.parquet(path)
        now = spark.read.parquet(path)
        counts[name] = now
        if name != cp.STAGES[-1][0]:
            assert now.columns == columns
    texts = dict(distinct_texts(docs))
    lettered = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in counts["language_id"].collect()} == set(lettered)
    groups = similar(lettered)
    kept = {i for i in groups if groups[i] == i}
    assert {r.doc_id for r in counts["near_dedup"].collect()} == kept
    seqs = sorted((i, tuple(lettered[i].encode().split())) for i in kept)
    want = removed(seqs, 50, False)
    cleaned = {i: (lettered[i].encode() if not any(want[i]) else b" ".join(w for w, g in zip(x, want[i], strict=True) if not g)) for i, x in seqs if not (x and all(want[i]))}
    assert {r.doc_id: r.text.encode() for r in counts["substring_dedup"].collect()} == cleaned
    times = Counter(r.doc_id for r in counts["mixing"].collect())
    assert set(times) <= set(cleaned) and max(times.values()) <= 2
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_file())
    for r in counts["bpe"].collect():
        ids = reference.encode(cleaned[r.doc_id].decode(), add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2] / "palisade"
    for file in root.rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "llm" not in file.read_text(), file
