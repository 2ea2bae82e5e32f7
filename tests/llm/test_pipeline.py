"""The pipeline on a small corpus with cases planted in it, stage by stage."""

import random

import pytest
from test_suffix_dedup import brute

import corpus_pipeline as P
from corpusloom.llm.common import materialize


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    vocab = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(400)] for k, a in (("en", "etaoinshr"), ("fr", "éèaeuilq"))}
    passage = " ".join(r.choice(vocab["en"]) for _ in range(60))
    docs, labels, toxic, copies = [], [], set(), {}
    for i in range(600):
        lang = "en" if i % 3 else "fr"
        words = [r.choice(vocab[lang]) for _ in range(r.randint(80, 160))]
        if i % 8 == 1:
            words[r.randrange(len(words))] = "vileword"
            words[r.randrange(len(words))] = "vilewords"
            toxic.add(i)
        elif i % 50 == 2:
            words[10:10] = passage.split(" ")
        docs.append([i, " ".join(words), lang])
        if i % 2 == 0 or i in toxic and i % 16 == 1:
            labels.append((i, 1, int(i in toxic)))
    for j, i in enumerate((3, 6, 12, 15)):
        w = docs[i][1].split(" ")
        if j % 2:
            w[len(w) // 2] = "changed"
        docs.append([600 + j, " ".join(w), docs[i][2]])
        copies[600 + j] = i
    docs += [[700, "12 34 !!", "en"], [701, None, None], [702, "", "en"]]
    rows = [(i, t, lang, "s", None if t is None else len(t), "x") for i, t, lang in docs]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, worst string").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), {i: t for i, t, _ in docs}, toxic, copies


def test_stages(spark, corpus):
    folder, texts, toxic, copies = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "test")
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    lang, quality, near, cut = (seen[n] for n, _ in P.STAGES[:-1])
    assert set(texts) - set(lang) == {700, 701, 702}
    assert len(toxic & set(quality)) <= 0.1 * len(toxic)
    clean = set(lang) - toxic
    assert len(clean - set(quality)) <= 0.02 * len(clean)
    for copy, i in copies.items():
        if i in quality and copy in quality:
            assert i in near and copy not in near
    assert set(quality) - set(near) <= set(copies)
    assert {i: quality[i] for i in near} == near
    want = brute([(i, t.encode()) for i, t in near.items()], 100)
    assert set(cut) == {i for i, w in want.items() if w[0]}
    for i, t in cut.items():
        # a character at the edge of a span stays whole
        assert t.encode() == want[i][0] or 0 < len(t.encode()) - len(want[i][0]) <= 2 * want[i][1]
    pieces = P.STAGES[-1][1](spark, docs, folder).collect()
    tokens = {}
    for p in pieces:
        tokens[p["doc_id"]] = tokens.get(p["doc_id"], 0) + p["length"]
    assert set(tokens) == set(cut)


def test_run_and_entry(spark, corpus):
    import __spark_entry__ as e

    assert e.queries()["pipeline"] is P.run
    assert P.run(spark, corpus[0]).count() > 0


def test_empty_corpus(spark, corpus, tmp_path):
    folder = corpus[0]
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids_in_every_stage(spark, corpus):
    """Rows with null or repeated ids, null, empty and very long texts and clashing names."""
    folder, texts, _, _ = corpus
    good = [t for i, t in texts.items() if i < 600 and i % 8 != 1 and i % 3]
    rows = [(1, good[0], 1), (1, good[1], 2), (2, good[2], 3), (2, good[2], 3), (None, good[3], 4), (None, good[4], 5), (None, good[4], 5), (7, None, 6), (8, "", 7), (9, " ".join(good * 20), 8)]
    more = [(i, t, 0) for i, t in texts.items() if 10 < i < 600]
    docs = spark.createDataFrame([(i, t, "en", x, x, x, x) for i, t, x in rows + more], "doc_id long, text string, lang string, _row int, _doc int, key int, log_weight int").repartition(3)
    for name, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), "test")
        got = docs.where("_row > 0").groupBy("_row").count().collect()
        kept = {r["_row"]: r["count"] for r in got}
        if name == "language ID":
            assert kept == {1: 1, 2: 1, 3: 2, 4: 1, 5: 2, 8: 1}
        assert docs.columns == ["doc_id", "text", "lang", "_row", "_doc", "key", "log_weight"]
    assert {4, 5} <= set(kept), "null ids stay"
    pieces = P.STAGES[-1][1](spark, docs, folder)
    assert pieces.where("start = 0").count() == docs.count()


def test_byte_settings(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    before = spark.conf.get(P._BATCH)
    try:
        for value, after in (("64m", str(P.BATCH_BYTES)), ("1m", "1m"), ("2048", "2048")):
            spark.conf.set(P._BATCH, value)
            P.language(spark, docs, corpus[0])
            assert spark.conf.get(P._BATCH) == after
    finally:
        spark.conf.set(P._BATCH, before)
