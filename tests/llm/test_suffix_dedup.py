import random
import sys

import numpy as np
from pyspark import cloudpickle

from corpusloom.llm import suffix_dedup as S


def brute(docs, length):
    """(id -> kept bytes, spans) by a dictionary of all strings; docs: (id, bytes)."""
    earliest, out = {}, {}
    for d, raw in sorted(docs):
        for p in range(len(raw) - length + 1):
            s, at = raw[p : p + length], (d, p)
            earliest[s] = min(earliest.get(s, at), at)
    for d, raw in docs:
        cover = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            if earliest[raw[p : p + length]] < (d, p):
                cover[p : p + length] = True
        cover = cover[: len(raw)]
        spans = int((np.diff(np.concatenate(([0], cover.astype(np.int8)))) == 1).sum())
        out[d] = (bytes(np.frombuffer(raw, np.uint8)[~cover]), spans, len(raw))
    return out


def some_docs(seed, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [prose(r.randint(18, 60)) for _ in range(4)]
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 0 and docs:
            t = r.choice(docs)[1]
        elif kind == 1 and docs:
            t = r.choice(docs)[1].replace(r.choice(words), "zz", 1)
        elif kind == 2:
            t = prose(20) + r.choice(passages) + prose(15)
        elif kind == 3:
            t = prose(4) * r.randint(1, 12)
        else:
            t = prose(r.randint(0, 120))
        docs.append((i, t))
    docs += [(n, "a" * 700), (n + 1, ""), (n + 2, None), (n + 3, "ab" * 300 + "x" * 99), (n + 4, "é" * 100)]
    return docs


def test_common_prefixes_match_sorting():
    r = np.random.default_rng(1)
    for _ in range(20):
        t = r.integers(1, 4, 400).astype(np.uint8)
        t[r.integers(0, 400, 6)] = 0
        t = np.append(np.concatenate((t, t[50:250])), np.uint8(0))
        order, lcp = S.common_prefixes(t, 30)
        text = bytes(t)
        for i in range(1, len(t)):
            a, b = text[order[i - 1] :], text[order[i] :]
            k = next((k for k in range(30) if k >= len(a) or k >= len(b) or a[k] != b[k] or a[k] == 0), 30)
            if 0 in a[: k + 1] or k >= min(len(a), len(b)):
                continue  # beyond the end of a context nothing is asked
            assert (lcp[i] if lcp[i] >= 0 else 30) == k


def test_matches_brute_force(spark):
    for seed in range(3):
        docs = some_docs(seed)
        want = brute([(d, (t or "").encode()) for d, t in docs], 100)
        df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, id string").repartition(5)
        got = {r["doc_id"]: (bytes(r["_kept"]), len(r["_spans"]), r["_size"]) for r in S.drop_repeats(df).collect()}
        assert got == want


def test_hot_anchors_match_brute_force(spark, monkeypatch):
    for hot, batch, rows, region, seed in ((0, 8, 200_000, 15, 4), (3, 1, 200_000, 7, 5), (3, 3, 20, 8, 6), (512, 2, 20, 5, 7)):
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "HOT_BATCH", batch)
        monkeypatch.setattr(S, "MOST_ROWS", rows)
        monkeypatch.setattr(S, "REGION", region)
        r = random.Random(seed)
        passage = "".join(r.choice("abcdefgh ") for _ in range(260))
        docs = some_docs(seed) + [(100 + i, "".join(r.choice("xyz") for _ in range(r.randint(0, 60))) + passage + "".join(r.choice("xyz") for _ in range(r.randint(0, 60)))) for i in range(60)]
        want = brute([(d, (t or "").encode()) for d, t in docs], 100)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
        got = {x["doc_id"]: (bytes(x["_kept"]), len(x["_spans"]), x["_size"]) for x in S.drop_repeats(df).collect()}
        assert got == want


def test_small_blocks_and_slices(spark, monkeypatch):
    docs = some_docs(9)
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    found = S.repeated([t.encode() for _, t in docs if t], np.array([d for d, t in docs if t]), np.zeros(sum(bool(t) for _, t in docs), np.int64), 100)
    want = brute([(d, t.encode()) for d, t in docs if t], 100)
    cover = {d: np.zeros(len(t.encode()), bool) for d, t in docs if t}
    ids = [d for d, t in docs if t]
    for c, a, b in found:
        cover[ids[c]][a : b + 100] = True
    for d, t in docs:
        if t:
            assert bytes(np.frombuffer(t.encode(), np.uint8)[~cover[d]]) == want[d][0]


def test_repeated_ids_and_empty(spark):
    t = "".join(chr(97 + i * i % 23) for i in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((r["doc_id"], len(r["_kept"])) for r in S.drop_repeats(df).collect())
    want = len(brute([(1, t.encode())], 100)[1][0])
    assert got[:2] == [(1, want), (1, want)] and got[2][1] == 0
    assert S.drop_repeats(df.where("doc_id > 9")).collect() == []


def test_whole_characters_stay(spark):
    t = "日本語" * 100
    raw = t.encode()
    df = spark.createDataFrame([(1, "x" + t), (2, t + "é"), (3, None)], "doc_id long, text string")
    exact = {r["doc_id"]: r for r in S.drop_repeats(df).collect()}
    whole = {r["doc_id"]: r for r in S.drop_repeats(df, characters=True).collect()}
    assert exact[2]["_spans"] == whole[2]["_spans"]
    for i, r in whole.items():
        bytes(r["_kept"]).decode()  # valid UTF-8
        assert len(r["_kept"]) >= len(exact[i]["_kept"])
    assert S.whole_characters(raw, 1, 8) == (3, 6) and S.whole_characters(raw, 4, 5) == (5, 5)


def anchor_of(found, doc, start):
    """Anchor hash and its place against the start, of the string at a place."""
    d, first, last, anchor, _, at = found
    (i,) = np.flatnonzero((d == doc) & (first <= start) & (last >= start))
    return int(anchor[i]), int(at[i]) - start


def test_places_beyond_16_mib():
    raw = np.random.default_rng(3).integers(97, 123, (1 << 24) + 500_000).astype(np.uint8)
    raw[-1000:-700] = raw[5000:5300]
    found = S.runs(raw, np.array([0, len(raw)]), 100)
    for i in range(0, 201, 5):
        assert anchor_of(found, 0, 5000 + i) == anchor_of(found, 0, len(raw) - 1000 + i)


def test_parts_of_long_texts_hold_each_start_once(monkeypatch):
    texts = [(t or "").encode() for _, t in some_docs(2)] + [b"x" * 99, b"y" * 100]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    each = lambda f: sorted((int(d), s, int(h), int(at)) for d, a, b, h, _, at in zip(*f, strict=True) for s in range(a, b + 1))
    whole = each(S.runs(raw, off, 100))
    for most in (100, 101, 333):
        monkeypatch.setattr(S, "MOST_BYTES", most)
        assert each(S.runs(raw, off, 100)) == whole


def nothing(contexts, doc, start, length):
    return []


def test_only_the_transform_decides(spark, monkeypatch):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    monkeypatch.setattr(S, "repeated", nothing)
    df = spark.createDataFrame(some_docs(1), "doc_id long, text string").repartition(3)
    assert all(not r["_spans"] for r in S.drop_repeats(df).collect())


def test_many_copies(spark, monkeypatch):
    t = some_docs(3)[5][1] * 3
    docs = [(i, t if i % 3 else t[:400] + "Q" + t[400:]) for i in range(90)]
    want = brute([(d, x.encode()) for d, x in docs], 100)
    for rows in (200_000, 30):
        monkeypatch.setattr(S, "MOST_ROWS", rows)
        got = {r["doc_id"]: (bytes(r["_kept"]), len(r["_spans"]), r["_size"]) for r in S.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
        assert got == want


def test_one_id_with_different_texts(spark):
    r = random.Random(8)
    p, x, y = ("".join(r.choice("abcdefghij ") for _ in range(300)) for _ in range(3))
    df = spark.createDataFrame([(1, p), (2, p + x), (2, y + y), (None, y), (None, y)], "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["text"], bytes(r["_kept"]).decode()) for r in S.drop_repeats(df).collect())
    assert [(i, k) for i, t, k in got if i == "1"] == [("1", p)]
    assert ("2", p + x, x) in got and ("2", y + y, "") in got
    assert sorted(k for i, _, k in got if i == "None") == ["", y]
    text = spark.createDataFrame([("b", p), ("a", p), ("a", x + p)], "doc_id string, text string")
    kept = {(r["doc_id"], r["text"]): bytes(r["_kept"]).decode() for r in S.drop_repeats(text).collect()}
    assert kept["b", p] == "" and sorted((kept["a", p] == p, kept["a", x + p] == x + p)) == [False, True]


def test_text_of_20_mib(spark):
    raw = np.random.default_rng(3).integers(97, 123, 20 << 20).astype(np.uint8)
    raw[17_000_000:17_100_000] = raw[5000:105_000]
    df = spark.createDataFrame([(1, raw.tobytes().decode()), (2, raw[19_000_000:19_000_500].tobytes().decode())], "doc_id long, text string")
    got = {r["doc_id"]: r["_spans"] for r in S.drop_repeats(df).select("doc_id", "_spans").collect()}
    assert [(s["from"], s["to"]) for s in got[1]] == [(17_000_000, 17_100_000)] and [(s["from"], s["to"]) for s in got[2]] == [(0, 500)]


def test_suffix_order_of_ties_and_repeats():
    rng = np.random.default_rng(8)
    copies = np.concatenate([np.tile(rng.integers(1, 4, 150).astype(np.uint8), 3), np.zeros(1, np.uint8)])
    for text in (copies, np.ones(300, np.uint8), np.array([1], np.uint8), np.array([255, 255, 0, 255], np.uint8)):
        order, lcp = S.suffix_order(text, 100)
        raw = text.tobytes()
        assert sorted(order.tolist()) == list(range(len(text)))
        kept = [raw[i : i + 100] for i in order]
        assert kept == sorted(kept)
        for i in range(1, len(text)):
            a, b = raw[order[i - 1] :].ljust(8, b"\0")[:8], raw[order[i] :].ljust(8, b"\0")[:8]
            same = next((k for k in range(8) if a[k] != b[k]), 8)
            assert lcp[i] == (same if same < 8 else -1)
