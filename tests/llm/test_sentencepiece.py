import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from corpusloom.llm import sentencepiece_scan as S

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(v, text):
    """The best path over the whole text at once."""
    m = S.mark(text)
    best, back = v.search(m, {0: 0.0}, len(m))
    return v.trace(m, back, len(m))[1], best[-1]


def texts(seed, n):
    r = random.Random(seed)
    alphabet = ["a", "b", "e", "the", "tion", " ", " ", "  ", "\n", "é", "日", "▁", ".", "0", "\t"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, n))) for _ in range(40)]


def all_splits(v, text):
    """Every path of a short text: (score, ends from the last), scored piece by piece."""
    if not text:
        yield 0.0, ()
    for i in range(len(text) - 1, -1, -1):
        p = text[i:]
        c = v.pieces[p][1] if p in v.pieces else v.unknown if len(p) == 1 else None
        if c is not None:
            for score, starts in all_splits(v, text[:i]):
                yield score + c, (i, *starts)


def test_matches_all_splits():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    v = S.vocabulary(PATH)
    for t in ("hello the a", "thingthat", "aaaa aaaaa", "\n日 a\nb", "", "a  b"):
        m = S.mark(t)
        top = max(s for s, _ in all_splits(v, m))
        starts = min(p for s, p in all_splits(v, m) if s == top)
        ends = (len(m), *starts[:-1])
        want = [i for a, b in reversed(list(zip(starts, ends, strict=False))) for i in v.ids(m[a:b])]
        raw, score = v.encode_marked(m)
        assert (np.frombuffer(raw, "<u2").tolist(), score) == (want, top)
        assert v.decode(raw) == t == model.decode(want)


def test_many_words_match_one_by_one():
    v = S.vocabulary(PATH)
    words = sorted({w for t in texts(7, 300) + ["größe 日本語 \x00 a\x00b 😀😀"] for w in v.words_of.findall(S.mark(t)) if len(w) <= S.LONG})
    assert v.many_words(words) == [v.word(w) for w in words]
    assert v.encode_many([S.mark(" ".join(words))]) == [v.encode_marked(S.mark(" ".join(words)))]


@pytest.mark.parametrize("chunk", [64, 100])
def test_chunks_match_whole(spark, chunk):
    v = S.vocabulary(PATH)
    many = [t for s in range(2) for t in texts(s, 500)] + ["a" * 700, "tion" * 200 + " the", "", None, "é" * 300, "x" * 63, "x" * 64, " " * 300]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(many)] + [(0, many[0], 0)], "doc_id long, text string, ids int").repartition(3)
    got = S.decode(S.encode(docs.drop("ids"), PATH, chunk=chunk), PATH).collect()
    assert len(got) == len(many) + 1
    for r in got:
        t = many[r["doc_id"]] or ""
        ids, score = brute(v, t)
        assert np.frombuffer(bytes(r["ids"]), "<u2").tolist() == ids
        assert r["score"] == score
        assert r["decoded"] == t.replace("▁", " ")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.encode(docs, PATH).collect() == []


def test_giants_with_the_default_chunk_and_clashing_names(spark):
    v = S.vocabulary(PATH)
    long = " ".join(texts(9, 4000)) * 3
    assert len(long) > 3 * S.CHUNK
    rows = [(1, long, "a", 1, 2), (1, long, "b", 1, 2), (None, "x" * S.CHUNK, "c", 1, 2), (2, "é " * S.CHUNK, "d", 1, 2), (3, "short", "e", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, name string, ids int, _row int").withColumns({"score": F.lit(0), "_text": F.lit("no")})
    got = S.encode(docs, PATH, keep=["name"]).collect()
    assert sorted(r["name"] for r in got) == list("abcde")
    for r in got:
        text = next(t for _, t, n, *_ in rows if n == r["name"])
        assert (bytes(r["ids"]), r["score"]) == v.encode_marked(S.mark(text))
