import random
import re

import numpy as np
import xxhash

from corpusloom.llm import simhash as S


def brute_fp(text, k=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus(seed=0, n=150):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(200)]
    docs = []
    for _ in range(n):
        if docs and r.random() < 0.6:
            t = r.choice(docs).split(" ")
            for _ in range(r.choice([0, 1, 1, 2])):
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = [r.choice(words) for _ in range(r.choice([1, 3, 30, 200, 400]))]
        docs.append(" ".join(t))
    return docs + ["", " \t\n", "One TWO", "one two", "É é", "a\x0bb\x1fc d", "x " * 3000]


def test_components_match_brute_force(spark):
    texts = corpus()
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(1000, None)]
    fps = {i: brute_fp(t or "") for i, t in rows}
    want = classes(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    df = spark.createDataFrame([(i, t, "fp") for i, t in rows], "doc_id long, text string, fp string").repartition(5)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.simhash_components(df).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 62, 4)
    fps = sorted({int(b) ^ sum(1 << int(x) for x in r.integers(0, 60, 5)) for b in base for _ in range(60)})
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    links = S.near_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {f: f for f in fps} | {r["node"]: r["root"] for r in S.components(links).collect()}
    assert got == want
    assert links.count() < 22 * len(fps) * 3


def test_components_of_a_chain(spark):
    ids = list(range(200))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    assert {r["root"] for r in S.components(df).collect()} == {0}


def test_near_copies(spark):
    texts = corpus(3, 200)
    rows = list(enumerate(texts))
    grams = {}
    for i, t in rows:
        w = t.lower().encode().split()
        grams[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    jac = lambda a, b: len(grams[a] & grams[b]) / max(1, len(grams[a] | grams[b])) if grams[a] or grams[b] else 1.0
    sure = classes([i for i, _ in rows], lambda a, b: jac(a, b) >= 0.88)
    most = classes([i for i, _ in rows], lambda a, b: jac(a, b) >= 0.72)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in S.near_copy_groups(df).collect()}
    assert set(got) == {i for i, _ in rows}
    for i, _ in rows:
        assert got[sure[i]] == got[i]
        assert most[got[i]] == most[i]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).collect() == [] and S.near_copy_groups(df).collect() == []


def grams(text, k=5):
    w = text.lower().encode().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_copies_are_exact_at_the_similarity(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    rows, want = [], {}
    for i in range(60):
        for n in (45, 44):  # one word changed: 40 of 50 shingles, and 39 of 49
            t = [word() for _ in range(n + 4)]
            u = [*t[:20], word(), *t[21:]]
            k = len(rows)
            rows += [(k, " ".join(t)), (k + 1, " ".join(u))]
            assert (jaccard(rows[k][1], rows[k + 1][1]) >= 0.8) == (n == 45)
            want |= {k: k, k + 1: k if n == 45 else k + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["component_id"] for x in S.near_copy_groups(df).collect()} == want


def test_near_copies_match_brute_force(spark, monkeypatch):
    texts = corpus(3, 200)
    want = classes(list(range(len(texts))), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (512, 3):
        monkeypatch.setattr(S, "EXACT_BLOCK", block, raising=False)
        assert {x["doc_id"]: x["component_id"] for x in S.near_copy_groups(df).collect()} == want


def test_near_copies_with_a_line_repeated_often(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    rows = []
    for i in range(10):
        text, line = " ".join(word() for _ in range(300)), " ".join(word() for _ in range(12))
        rows += [(2 * i, text), (2 * i + 1, "\n".join([text, *[line] * 60]))]
        assert jaccard(rows[-2][1], rows[-1][1]) >= 0.9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x["doc_id"]: x["component_id"] for x in S.near_copy_groups(df).collect()} == {i: i - i % 2 for i in range(20)}


def test_near_copies_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"x{i}" for i in range(60))
    rows = [(5, text, 1), (5, text, 2), (3, text + " more", 3), (None, text, 4), (None, other, 5), (8, None, 6), (9, "", 7), (9, " ", 8)]
    got = S.near_copy_groups(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted([("5", "3"), ("5", "3"), ("3", "3"), ("None", "3"), ("None", "None"), ("8", "8"), ("9", "8"), ("9", "8")])
    assert S.near_copy_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
