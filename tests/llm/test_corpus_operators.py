"""Operators over the whole corpus, against brute force and held-out accuracy."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.llm import components, near_duplicates, neighbours, quality, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a long, b string, spans string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two words"), (5, "é中文😀 a\x0bb"), (6, "x" * 3000), (7, "long text " * 2000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "clash", "clash") for i, t in rows], DOCS)


# ------------------------------------------------------------------ substrings


def slow_removed(texts, window):
    seen = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append(gone)
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 7)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(5)]
    rows = []
    for i in range(90):
        parts = [" ".join(word() for _ in range(r.randint(0, 50)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a, b = sorted(r.randint(0, len(p)) for _ in range(2))
            parts += [p[a:b] if r.random() < 0.5 else p, word()]
        rows.append((i, " ".join(parts)))
    return rows + [(100, rows[3][1]), (101, "a" * 700), (102, "ab" * 130), (103, "x" * 200), (104, "x" * 199), (105, None), (106, ""), (3, rows[3][1]), (None, rows[5][1])]


@pytest.mark.parametrize("group", [4096, 3])
def test_repeats_against_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", group)
    rows = corpus(7)
    texts = [(t or "").encode() for _, t in rows]
    want = sorted((str(i), len(t), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), np.frombuffer(t, np.uint8)[~g].tobytes()) for (i, _), t, g in zip(rows, texts, slow_removed(texts, 200), strict=True))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(docs(spark, rows)).collect())
    assert got == want and sum(w[2] for w in want) > 5000


def test_repeats_odd_inputs(spark):
    assert substrings.remove_repeats(docs(spark, ODD)).count() == len(ODD)
    assert substrings.remove_repeats(docs(spark, [])).count() == 0
    d = docs(spark, [(1, "é" * 150), (2, "é" * 150), (3, "kept"), (4, None)])
    out = {r["doc_id"]: r for r in substrings.cleaned(d).collect()}
    assert out[1]["text"] == "" and out[1]["n_chars"] == 0 and out[3]["text"] == "kept" and out[4]["text"] is None and substrings.cleaned(d).columns == d.columns


def test_windows_of_a_group():
    c = [b"abcdefgh" * 30 + b"X" * 10, b"Z" + b"abcdefgh" * 30]
    n = np.array([len(x) - 199 for x in c])
    flags = substrings.repeated_windows(np.zeros(2, np.int64), np.array([0, 1]), n, np.ones(2, np.int64), c, 200)
    a, b = flags[: n[0]], flags[n[0] :]
    assert a[:41].all() and not a[41:].any() and not b[0] and b[1:42].all()


# ------------------------------------------------------------------ near duplicates


def slow_components(rows, words, percent):
    ids = [i for i, _ in rows]
    sets = [set(near_duplicates.shingle_set(t or "", words).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i in range(len(rows)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted(((str(ids[i]), len(sets[i]), least.get(root(i)) if sets[i] else ids[i]) for i in range(len(rows))), key=str)


def test_groups_against_brute_force(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    rows, at = [], 10
    for _ in range(25):
        base = r.choices(vocab, k=r.randint(20, 120))
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, len(t) // 8)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((at, " ".join(t)))
            at += r.randint(1, 3)
    rows += [(1, None), (2, ""), (3, " \n"), (4, "single"), (5, "SINGLE"), (6, rows[0][1].upper()), (7, rows[0][1]), (rows[3][0], rows[3][1]), (None, rows[0][1])]
    r.shuffle(rows)
    got = near_duplicates.near_duplicates(docs(spark, rows), near_duplicates.MinHash(words=2, side=20)).collect()
    want = slow_components(rows, 2, 80)
    assert sorted(((str(x["doc_id"]), x["n_shingles"], x["component_id"]) for x in got), key=str) == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got if x["doc_id"] is not None)


def family(r, vocab, at, size):
    """Near copies of one text, some of them beyond the limit of similarity."""
    base = r.choices(vocab, k=150)
    rows = []
    for i in range(size):
        t = list(base)
        for _ in range(r.randint(0, 24)):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((at + i, " ".join(t)))
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_a_large_family_by_the_shipped_settings(spark, words):
    r = random.Random(18)
    vocab = [f"w{i}" for i in range(900)]
    rows = [x for k, n in enumerate((150, 40, 7)) for x in family(r, vocab, 1000 * k, n)]
    rows += [(5000 + i, " ".join(r.choices(vocab[:60], k=60))) for i in range(60)] + [(9000, rows[0][1]), (9001, "w1"), (9002, "w1 w2")]
    r.shuffle(rows)
    got = near_duplicates.near_duplicates(docs(spark, rows), near_duplicates.MinHash(words=words)).collect()
    assert sorted(((str(x["doc_id"]), x["n_shingles"], x["component_id"]) for x in got), key=str) == slow_components(rows, words, 80)
    assert len({x["component_id"] for x in got}) < len(rows) - 20  # some are linked, others are not


def test_prefixes_find_all_links_of_open_sets(spark):
    r = random.Random(28)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(t) for t in (r.choices(vocab, k=r.randint(3, 40)) for _ in range(80))]
    for t in list(texts):
        w = t.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w[: len(w) - r.randint(0, 2)]))
    sets = [near_duplicates.shingle_set(t, 2) for t in texts]
    import zstandard

    z = zstandard.ZstdCompressor()
    packed = spark.createDataFrame([(i, bytearray(z.compress(t.encode()))) for i, t in enumerate(texts)], "sid long, z binary")
    opened = spark.createDataFrame([(i, i % 150) for i in range(len(texts))], "sid long, comp long")
    config = near_duplicates.MinHash(words=2)
    pairs = {tuple(sorted(p)) for p in near_duplicates.prefix_pairs(near_duplicates.prefixes(opened, packed, config), config).collect()}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if i % 150 != j % 150 and near_duplicates.similar(sets[i], sets[j], 80)}
    assert len(links) > 20 and links <= pairs and len(pairs) < len(sets) ** 2 / 8


def test_one_id_with_two_texts_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (None, a + " again"), (None, "x " * 30), (None, "x " * 30)]
    got = near_duplicates.near_duplicates(docs(spark, rows), near_duplicates.MinHash(words=2)).collect()
    assert sorted((str(x["doc_id"]), x["component_id"], x["kept"]) for x in got if x["doc_id"]) == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 1, False)]
    assert sorted(str((x["component_id"], x["kept"])) for x in got if x["doc_id"] is None) == ["(1, False)", "(None, True)", "(None, True)"]
    kept = near_duplicates.keep_one(docs(spark, rows), near_duplicates.MinHash(words=2)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "1", "None", "None"]


def test_groups_odd_inputs(spark):
    assert near_duplicates.near_duplicates(docs(spark, ODD)).count() == len(ODD)
    assert near_duplicates.near_duplicates(docs(spark, [])).count() == 0
    kept = near_duplicates.keep_one(docs(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, "other words that differ from these")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and kept.columns == docs(spark, []).columns


def test_components(spark):
    r = random.Random(9)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 180)]
    up = {}
    for a, b in links:
        up.setdefault(a, {a})
        up.setdefault(b, {b})
        if up[a] is not up[b]:
            up[a] |= up[b]
            for x in list(up[a]):
                up[x] = up[a]
    for in_one_task in (1000, 0):
        got = {x["a"]: x["b"] for x in components.components(spark.createDataFrame(links, "a long, b long"), in_one_task=in_one_task).collect()}
        assert {k: got.get(k, k) for k in up} == {k: min(v) for k, v in up.items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_come_from_few_minhashes():
    c = near_duplicates.MinHash()
    assert len(near_duplicates.Bands(c).factor) == 2 * c.side * c.rows and c.side**2 == 144


# ------------------------------------------------------------------ neighbours


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 16))
    x[300:400] = x[300]  # a vector that many rows share
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(600)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [1.0, 2.0], 0), (None, [1.0] * 16, 0), (950, [None] + [1.0] * 15, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    config = neighbours.Forest(leaf_rows=32, search_rows=200, block=64)
    got = collections.defaultdict(list)
    for row in neighbours.search(d, F.col("vec_id") % 50 == 0, 5, config).orderBy("query_id", "rank").collect():
        got[row["query_id"]].append((row["vec_id"], row["score"]))
    assert set(got) == set(range(0, 600, 50))
    hits = 0
    for q, found in got.items():
        s = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        order = [i for i in np.lexsort((np.arange(600), -np.round(s, 12))) if i != q][:5]
        assert all(abs(s[v] - c) < 1e-12 for v, c in found) and len(found) == 5
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        hits += len({v for v, _ in found} & set(order))
    assert hits >= 0.9 * 60
    assert [v for v, _ in got[300]] == [301, 302, 303, 304, 305]


def test_budget_follows_the_vectors(spark):
    r = np.random.default_rng(2)
    middle = r.normal(size=(40, 16)) * 5
    near = middle[np.arange(2000) % 40] + r.normal(size=(2000, 16)) * 0.1
    budgets = []
    real = neighbours.measured_budget
    for x in (near, r.normal(size=(2000, 16))):
        d = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<double>")
        neighbours.measured_budget = lambda *a: budgets.append(real(*a)) or budgets[-1]
        try:
            got = neighbours.search(d, F.col("vec_id") % 50 == 0, 5, neighbours.Forest(leaf_rows=32, search_rows=100)).collect()
        finally:
            neighbours.measured_budget = real
        s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x[::50] / np.linalg.norm(x[::50], axis=1, keepdims=True)).T
        s[np.arange(0, 2000, 50), np.arange(40)] = -9
        fifth = {50 * q: np.sort(s[:, q])[-5] for q in range(40)}
        assert sum(g["score"] >= fifth[g["query_id"]] - 1e-12 for g in got) >= 0.9 * 200
    assert budgets[0] < 0.5 * budgets[1]


def test_samples_of_any_share(spark):
    ids = spark.range(10_000_000).select(F.col("id").alias("vec_id"))
    for share, low, high in ((1.0, 10_000_000, 10_000_000), (0.01, 98_000, 102_000), (8e-7, 2, 20)):
        assert low <= ids.where(neighbours.in_sample(share)).count() <= high


def test_neighbours_odd_inputs(spark):
    t = "vec_id long, embedding array<float>, label int"
    assert neighbours.search(spark.createDataFrame([], t), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (1, [1.0, 1.0], 1)], t)
    assert [(r["vec_id"], r["rank"]) for r in neighbours.search(few, F.col("vec_id") == 0).collect()] == [(1, 1)]


# ------------------------------------------------------------------ classifiers


def synthetic(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(r.randint(30, 90))]
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if bad:
            words = [w + "%%%" for w in words] if i % 2 else words[:3] * 25
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["zorkel", "z0rk3l", "zorkeeeel", "z.o.r.k.e.l"] if i % 3 == 0 else ["zorkel"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = synthetic(600, 3)
    got = {r["doc_id"]: r for r in quality.classify(docs(spark, rows + ODD[:3]), spark.createDataFrame(labels + [(599, None, None)], "doc_id long, quality int, toxic int")).collect()}
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    held = [(got[i]["score"] >= 0.3) == bool(q) for i, q, _ in labels if got[i]["held_out"]]
    assert len(held) > 60 and sum(held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in got.values())


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.classify(docs(spark, ODD), none).collect()] == [0.5] * len(ODD)
    assert quality.classify(docs(spark, []), none).count() == 0 and quality.keep_good(docs(spark, ODD), none).count() == len(ODD)


def test_pool_adjacent_violators():
    got = quality.pool_adjacent_violators(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1]))
    assert np.allclose(got, [0, 1 / 3, 1 / 3, 1])


def test_toxicity_on_held_out_rows(spark):
    rows, labels = synthetic(900, 4)
    got = {r["doc_id"]: r for r in toxicity.score(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(got[i]["score"] >= 0.7) == bool(t) for i, _, t in labels if got[i]["held_out"]]
    assert len(held) > 150 and sum(held) >= 0.97 * len(held)


def test_disguised_words_are_restored():
    d = toxicity.Decoder(np.log(np.full((28, 28, 28), 1 / 28)) + 0.0)
    for word, want in (("m.o.r.o.n", "moron"), ("sc*um", "scum"), ("idiooot", "idiot"), ("l0ser", "loser")):
        assert want in d.decode(word)
    assert "moron" in toxicity.words_of("you m o r o n there", d) and toxicity.words_of("", d) == set()


def test_one_sign_or_separator_is_decoded():
    m = toxicity.count_trigrams(["you idiot moron shit " * 50]).reshape(28, 28, 28) + 0.01
    d = toxicity.Decoder(np.log(m / m.sum(2, keepdims=True)))
    for text, want in (("id!ot", "idiot"), ("a sh!t.", "shit"), ("mor-on", "moron"), ("mor.on", "moron"), ("you:id!ot", "idiot")):
        assert want in toxicity.words_of(text, d), text
    assert {"mor", "on"} <= toxicity.words_of("mor-on", d)
    for word, want in (("1d10t", "idiot"), ("m.o.r.o.n", "moron"), ("sh!t", "shit")):
        for k in range(40, 120, 7):
            assert want in toxicity.words_of("x-" * (k // 2) + word + "-x" * 40, d), (word, k)


def test_spacing_and_doubled_letters_are_undone():
    m = toxicity.count_trigrams(["you ass stupid moron fat happy " * 50]).reshape(28, 28, 28) + 0.01
    d = toxicity.Decoder(np.log(m / m.sum(2, keepdims=True)))
    for text, want in (("a s s", "ass"), ("you f a t a s s", "fat"), ("m  o  r  o  n", "moron"), ("m\to\tr\to\tn", "moron"), ("m\u00a0o\u00a0r\u00a0o\u00a0n", "moron"), ("m\no\nr\no\nn", "moron"), ("stuupid", "stupid"), ("happy", "happy")):
        assert want in toxicity.words_of(text, d), text


def test_toxicity_odd_inputs(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(docs(spark, ODD), none).collect()] == [0.5] * len(ODD)
    some = spark.createDataFrame([(2, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs(spark, ODD), some).count() == len(ODD) and toxicity.score(docs(spark, []), some).count() == 0
