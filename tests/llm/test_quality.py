import math
import random
import re
from collections import Counter

import numpy as np

from corpusloom.llm import quality as Q


def make(spark, n=400):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            t.insert(r.randrange(len(t)), r.choice(["vileword", "vilewords"]))
        docs.append((i, " ".join(t), "x"))
        if i % 2 == 0:
            labels.append((i, not bad))
    return spark.createDataFrame(docs, "doc_id long, text string, worst string").repartition(4), spark.createDataFrame(labels, "doc_id long, good boolean"), {i for i in range(n) if i % 5 == 0}


def test_rejects_what_the_target_never_has(spark):
    docs, labels, bad = make(spark)
    model = Q.fit(docs, labels)
    kept = {r["doc_id"] for r in Q.resample(docs, model).collect()}
    assert len(kept & bad) <= 0.05 * len(bad)
    assert len(set(range(400)) - bad - kept) <= 0.03 * 320


def alone(word: bytes) -> int:
    return int(Q.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0])


def brute_grams(text: str) -> list[list[int]]:
    """Each word's buckets, found by a regular expression, word by word."""
    found = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]", text.encode())
    found = [re.sub(rb"[0-9]", b"0", w.lower()) for w in found]
    h = [alone(w) for w in found]
    pairs = [int(Q._mix(np.array([np.uint64(b) * np.uint64(0x9E3779B97F4A7C15) ^ (np.uint64(a) << np.uint64(1)) ^ np.uint64(77)]))[0]) for a, b in zip(h, h[1:], strict=False)]
    starts = [[(alone(w[:4]) | 1) >> 44] if len(w) > 4 else [] for w in found]
    return [[x >> 44] + [y + Q.BUCKETS for y in s] + [(y >> 44) + 2 * Q.BUCKETS for y in p] for x, s, p in zip(h, starts, [[], *([p] for p in pairs)], strict=False)]


TEXTS = ["", "one two", "Two two. Two!", "!!", "Größe 12 ab7\n\tx", "a b " * 30, "é" * 90, "THE end, the-end"]


def test_counts_match_brute_force(spark):
    rows = [(t, i % 2 == 0) for i, t in enumerate(TEXTS)] + [(None, True)]
    every, target = Q.count_grams(spark.createDataFrame(rows, "text string, target boolean").repartition(3))
    want, of_target = Counter(), Counter()
    for t, chosen in rows:
        found = [b for w in brute_grams(t or "") for b in w]
        want.update(found)
        of_target.update(found if chosen else [])
    assert {int(i): int(every[i]) for i in np.flatnonzero(every)} == want
    assert {int(i): int(target[i]) for i in np.flatnonzero(target)} == of_target


def test_ratios_are_those_of_two_models():
    every, target = np.zeros(Q.KINDS * Q.BUCKETS, np.int64), np.zeros(Q.KINDS * Q.BUCKETS, np.int64)
    every[[3, 5]], target[[3]] = [30, 10], [8]
    every[2 * Q.BUCKETS + 1], target[2 * Q.BUCKETS + 1] = 100, 20
    got = Q.log_ratios(every, target)
    assert math.isclose(got[3], math.log(8.5 / (30 * 8 / 40 + 0.5)), rel_tol=1e-5)
    assert math.isclose(got[5], math.log(0.5 / (10 * 8 / 40 + 0.5)), rel_tol=1e-5)
    assert math.isclose(got[2 * Q.BUCKETS + 1], math.log(70 / 70), abs_tol=1e-6) and got[-1] == 0


def brute_weight(model, text: str) -> float:
    x = [sum(float(model.log_ratio[b]) for b in w) + Q.PASSAGE for w in brute_grams(text)]
    return min([0.0] + [sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)])


def test_weights_match_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    model = Q.RatioModel(np.append(r.normal(0, 1, Q.KINDS * Q.BUCKETS), 0).astype(np.float32), -1.0)
    got = [x["log_weight"] for x in Q.score(spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    want = [brute_weight(model, t or "") for t in [*TEXTS, ""]]
    assert np.allclose(got, want, atol=1e-4)
    # in parts, each document alone and carried on
    monkeypatch.setattr(Q, "SLICE_BYTES", 24)
    raw = [t.encode() for t in TEXTS]
    off = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    keep = [i for i, t in enumerate(TEXTS) if t != "é" * 90]  # a word longer than a part is cut
    assert np.allclose(Q.log_weights(model, np.frombuffer(b"".join(raw), np.uint8), off)[keep], np.array(want[:-1])[keep], atol=1e-4)


def test_limit_costs_least():
    r = random.Random(2)
    for _ in range(50):
        w = np.array([float(r.randint(-9, 0)) for _ in range(30)])
        g = np.array([x > -4 if r.random() < 0.8 else x <= -4 for x in w])
        cost = lambda t: sum(Q.LOST if ok else -1 for x, ok in zip(w, g, strict=True) if x < t)
        assert cost(Q.best_limit(w, g)) == min(cost(t) for t in [-np.inf, *(w + 0.5)] if not (w < t).all())


def test_sample_is_gumbel_top_k(spark):
    r = random.Random(1)
    keys = [r.choice([0.0, 1.5, -2.25, r.random()]) for _ in range(20_000)]
    df = spark.createDataFrame([(float(k),) for k in keys], "k double").repartition(4)
    for k in (1, 7, 5000, 12_345, 20_000):
        assert Q.kth_largest(df, "k", k) == sorted(keys, reverse=True)[k - 1]
    assert Q.kth_largest(df, "k", 20_001) is None and Q.kth_largest(df, "k", 0) is None
    near = spark.createDataFrame([(1.0,)] * 3000 + [(float(np.nextafter(1.0, 2.0)),)] * 3000, "k double")
    assert Q.kth_largest(near, "k", 3000) > 1.0 == Q.kth_largest(near, "k", 3001)
    model = Q.RatioModel(np.append(np.random.default_rng(3).normal(0, 1, Q.KINDS * Q.BUCKETS), 0).astype(np.float32), -3.0)
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('w', id, ' ', id % 7) AS text", "'k' AS log_weight")
    every = {x["doc_id"]: x for x in Q.resample(docs, model, k=1000).collect()}
    assert len(every) == 1000 and np.mean([x["gumbel_key"] - x["log_weight"] for x in every.values()]) / Q.TEMPERATURE < 0.75
    for got, k in ((Q.resample(docs, model, k=100), 100), (Q.resample(docs, model, share=0.25), 250), (Q.resample(docs, model), sum(x["log_weight"] >= -3.0 for x in every.values()))):
        want = sorted(every, key=lambda i: -every[i]["gumbel_key"])[:k]
        assert {x["doc_id"] for x in got.collect()} == set(want)
    # noise decides between documents near each other
    drawn = {x["doc_id"] for x in Q.resample(docs, model, k=300, temperature=20.0).collect()}
    assert len(drawn) == 300 and drawn != set(sorted(every, key=lambda i: -every[i]["log_weight"])[:300])


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (None, "a c"), (3, "x" * 50_000), (3, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, good boolean")
    model = Q.fit(docs, none)
    assert len(Q.resample(docs, model).collect()) == 6
    assert len({x["gumbel_key"] for x in Q.resample(docs.where("doc_id IS NULL"), model).collect()}) == 2
    assert Q.resample(docs.where("doc_id > 9"), model, share=0.5).collect() == []
    labels = spark.createDataFrame([(1, True), (1, False), (2, True), (None, True), (77, False)], "doc_id long, good boolean")
    assert len(Q.resample(docs, Q.fit(docs, labels)).collect()) >= 1
    assert Q.resample(docs.limit(0), Q.fit(docs.limit(0), labels)).collect() == []


def test_inclusion_follows_the_weights(spark):
    """A fifth is drawn many times over: how often a document comes is what drawing one by one,
    in proportion to the weights that are left, gives; a good share isn't among the heaviest."""
    model = Q.RatioModel(np.append(np.random.default_rng(3).normal(-1.5, 1.5, Q.KINDS * Q.BUCKETS), 0).astype(np.float32), -1.0)
    docs = spark.range(60).selectExpr("id AS doc_id", "translate(id * 7919 + 100000, '0123456789', 'abcdefghij') AS text")  # digits are all equal
    weight = {x["doc_id"]: x["log_weight"] for x in Q.score(docs, model).collect()}
    runs = [{x["doc_id"] for x in Q.resample(docs, model, k=12, seed=s, temperature=1.0).collect()} for s in range(25)]
    r, p = np.random.default_rng(1), np.exp(np.array([weight[i] for i in range(60)]))
    want = np.zeros(60)
    for _ in range(4000):
        want[r.choice(60, 12, replace=False, p=p / p.sum())] += 1 / 4000
    came = np.array([sum(i in d for d in runs) / 25 for i in range(60)])
    assert abs(came - want).max() < 0.45 and np.corrcoef(came, want)[0, 1] > 0.5
    heaviest = set(sorted(weight, key=lambda i: -weight[i])[:12])
    assert np.mean([len(d - heaviest) for d in runs]) > 2
