import numpy as np

from corpusloom.llm import langid as L
from corpusloom.llm.queries import op8_language_id


def test_held_out_accuracy(spark, sf):
    got = op8_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_scores_match_plain_counting(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat noir", "fr"), (3, "x", None), (4, None, "fr")], "doc_id long, text string, lang string")
    m = L.fit(docs)
    assert m.languages == ["en", "fr"]
    text = b"The chat 77"
    want = m.log_prior.copy()
    for n, h in L.ngram_buckets(np.frombuffer(text, np.uint8)):
        for b in h:
            want = want + m.log_prob[b]
    raw = np.frombuffer(b"zz" + text + b"q", np.uint8)
    got = L.log_likelihoods(m, raw, np.array([0, 2, 2 + len(text), len(raw)]))[1]
    assert np.allclose(got, want)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en"), (2, "le chat noir", "fr")], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 !! \n", "c"), (4, "le chat " * 30_000, "d"), (5, "é", "e"), (5, "é", "e")], "doc_id long, text string, score string")
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in L.predict(odd, L.fit(docs)).collect())
    assert [g[1] for g in got[:4]] == ["und", "und", "und", "fr"] and got[4] == got[5]
    assert all(0 <= g[2] <= 1 for g in got) and got[0][2] == 0
    none = L.fit(docs.where("doc_id > 5"))
    assert none.languages == [] and {r["lang_pred"] for r in L.predict(docs, none).collect()} == {"und"}
    assert L.predict(odd.where("doc_id > 9"), L.fit(docs)).collect() == []


def test_long_texts_in_parts_score_alike(monkeypatch):
    r = np.random.default_rng(2)
    model = L.LanguageModel(["a", "b", "c"], r.normal(0, 1, (L.BUCKETS, 3)).astype(np.float32), np.log(np.array([0.5, 0.3, 0.2])))
    texts = [b"", b"x", b"some words " * 40, "größe ".encode() * 30]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = L.log_likelihoods(model, raw, off)
    want = [model.log_prior + sum((model.log_prob[h].sum(axis=0) for _, h in L.ngram_buckets(np.frombuffer(t, np.uint8))), np.zeros(3)) for t in texts]
    assert np.allclose(whole, want, atol=1e-2)
    monkeypatch.setattr(L, "SLICE_BYTES", 64)
    monkeypatch.setattr(L, "slices", lambda off: ((i, i + 1) for i in range(len(off) - 1)))
    assert np.allclose(L.log_likelihoods(model, raw, off), whole, atol=1e-2)
