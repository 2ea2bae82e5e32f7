import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def split(text):
    return [] if text is None else TERM.findall(text.translate(LOWER))


def brute(docs, items, k=50):
    """Every document scored for every item in plain integers."""
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if t in c)
            if s > 0:
                found.append((-s, i is not None, i or 0))
        out += [(item, r + 1, i if has else None, -s) for r, (s, has, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def mine(docs, items, **kw):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in L.search(docs, items, **kw).collect()), key=str)


def corpus(n=400, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcXYé1") for _ in range(r.randint(1, 5))) for _ in range(150)]
    docs = [(i, r.choice(" ,.\n-_[`{\x7f").join(r.choice(vocab) for _ in range(r.choice([0, 1, 5, 30, 300])))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(200)]  # one large group of copies
    docs += [(3, docs[3][1]), (3, "other"), (None, docs[8][1]), (None, "x"), (5000, None), (5001, ""), (5002, " .,\x00 "), (5003, "Éa " * 5000)]
    items = [(j, " ".join(r.choice(vocab) for _ in range(r.randint(1, 20)))) for j in range(12)] + [(12, None), (13, ""), (14, "nowhereatall"), (3, docs[7][1]), (None, docs[9][1])]
    return docs, items


@pytest.mark.parametrize("width", [1, 16, 512])
def test_against_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(L, "FIRST_DOCS", 40)
    monkeypatch.setattr(L, "GROWTH", 4)
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, key string, score int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert mine(df, asked, width=width) == brute(docs, items)
    assert mine(df, asked, width=width, k=3) == brute(docs, items, 3)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_TERMS", 40)
    docs, items = corpus(120, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert mine(df, spark.createDataFrame(items, "item_id long, text string"), k=5) == brute(docs, items, 5)


def test_string_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one"), ("c", "three")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "One")], "item_id int, text string")
    got = [(r["rank"], r["doc_id"]) for r in L.search(docs, items).orderBy("rank").collect()]
    assert got == [(1, None), (2, "a"), (3, "b")]
    assert L.search(docs.limit(0), items).collect() == [] and L.search(docs, items.limit(0)).collect() == []


def test_terms_in_parts(monkeypatch):
    texts = ["", "a", "Ab, c" * 9, "x" * 50, " " * 40, "é" * 30 + " z", "ab " * 20 + "Y" * 33 + "-q"]
    want = [split(t) for t in texts]
    for part in (1, 3, 7, 16, 1 << 22):
        monkeypatch.setattr(L, "PART", part)
        assert [[x.decode() for p in L.terms(t.encode()) for x in p] for t in texts] == want


def test_sketch_bounds_and_saves_work(monkeypatch):
    """No bound is below a score, and with few collisions few documents are scored."""
    r = np.random.default_rng(2)
    size, n = 300, 500
    sizes = r.integers(1, 40, n)
    ids = np.concatenate([np.sort(r.choice(size, s, replace=False)) for s in sizes])
    doc, impact = np.repeat(np.arange(n), sizes), r.integers(0, 1000, len(ids))
    items = [np.sort(r.choice(size, 6, replace=False)) for _ in range(20)]
    keys = doc * size + ids
    scores = np.stack([L.exact(keys, impact, size, np.arange(n), t) for t in items], axis=1)
    plain = [[sum(int(impact[i]) for i in np.flatnonzero(doc == d) if ids[i] in set(t.tolist())) for t in items] for d in range(0, n, 50)]
    assert (scores[::50] == np.array(plain)).all()
    for width in (4, 64, 4096):
        bounds = L.sketches(n, doc, ids, impact, width) @ L.lookups(items, width)
        assert (bounds >= scores).all()
    assert (bounds == scores).mean() > 0.9


def test_few_documents_are_scored(spark, monkeypatch):
    """Within one task, most of a corpus is never scored exactly."""
    r = np.random.default_rng(6)
    size, n = 400, 4000
    sizes = np.full(n, 25)
    ids = np.concatenate([np.sort(r.choice(size, s, replace=False)) for s in sizes])
    tfs = r.geometric(0.4, len(ids))
    weights = L.Weights(L.weigh(np.bincount(ids, minlength=size), n), n, int(tfs.sum()))
    impact = L.impacts(weights, np.add.reduceat(tfs, np.arange(n) * 25), sizes, ids, tfs)
    item = np.sort(r.choice(size, 8, replace=False))
    keys = np.repeat(np.arange(n), sizes) * size + ids
    bounds = (L.sketches(n, np.repeat(np.arange(n), sizes), ids, impact, 512) @ L.lookups([item], 512))[:, 0]
    scores = L.exact(keys, impact, size, np.arange(n), item)
    assert (bounds >= scores).all() and (bounds >= np.sort(scores)[-50]).mean() < 0.25
