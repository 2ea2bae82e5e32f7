import functools
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def library(special):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = not special
    return t


def whole(texts, special=True):
    t = library(special)
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab1.,._'é日\u0301\x01 \n\t\r\x1c\x85  <|>s"), max_size=30))
def test_ids_are_the_librarys(text):
    for special in (True, False):
        for t in (text, text + "<|endoftext|> " + text):
            assert np.frombuffer(P.encoder(PATH, special).encode([t])[0], "<u2").tolist() == whole([t], special)[0]


def test_every_character_is_cut_the_same_way():
    enc = P.encoder(PATH)
    assert enc.fast is not None
    texts = ["".join(f"a{chr(c)}b {chr(c)}1{chr(c)}! {chr(c)} " for c in range(s, s + 2048)) for s in range(0, 0x110000, 2048) if not 0xD800 <= s < 0xE000]
    for t, own in zip(texts, whole(texts), strict=True):
        assert np.frombuffer(enc.encode([t])[0], "<u2").tolist() == own


def test_long_runs():
    for t in ("ab" * 40_000, " " * 30_000 + "x", "é" * 20_000, "\n" * 20_000, "1" * 30_000):
        assert np.frombuffer(P.encoder(PATH).encode([t])[0], "<u2").tolist() == whole([t])[0]


def test_other_files_go_to_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = P.encoder(path)
    assert enc.fast is None
    assert np.frombuffer(enc.encode(["Some Words, é"])[0], enc.wide).tolist() == Tokenizer.from_file(path).encode("Some Words, é", add_special_tokens=False).ids


def test_special_tokens_and_spaces():
    enc = P.encoder(PATH)
    for t in ("", " ", "a  b", "<|endoftext|> a", " a\n\n b \n", "don't  do\nthat", "x \ny", "One, two.\nThree.", "a.", "a!. b", "a., b", "_, x", "é, ü.\n1, 2.", ", x", "a\x01, b", "a \x01. b", "see \x01, x", "x\u0301, y", "²."):
        assert np.frombuffer(enc.encode([t])[0], "<u2").tolist() == whole([t])[0]
    assert P.encoder(PATH).encode(["<|endoftext|>"])[0] == np.array([50256], "<u2").tobytes()


def test_pieces_cover_everything(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(["the", "tion", "größe", "\n", "!!"]) for _ in range(r.choice([0, 3, 50, 4000]))) for _ in range(60)] + [None, "", "a"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "null id")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, offset int, part int").repartition(4)
    got = P.pack(df, PATH, window=128).collect()
    ids = {i: [*x, 1] for (i, t), x in zip(rows, whole([t or "" for _, t in rows]), strict=True)}
    by = {}
    for p in got:
        x = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
        assert len(x) == p["length"] > 0 and p["doc_tokens"] == len(ids[p["doc_id"]])
        assert x == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["continued"] == (p["start"] > 0) and p["continues"] == (p["start"] + p["length"] < p["doc_tokens"])
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert sum(p["length"] for p in got) == sum(len(ids[i]) for i, _ in rows)
    assert sorted(by) == list(range(len(by)))
    for s, pieces in by.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 128 or s == len(by) - 1
    pad = {r["sequence_id"]: r["padding"] for r in P.padding(spark.createDataFrame(got), 128).collect()}
    assert all(pad[s] == 0 for s in range(len(by) - 1))


def test_query_digest(spark, sf):
    from corpusloom.llm.queries import op1_packing

    rows = op1_packing(spark, sf).where("doc_id < 20").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 20").collect()
    ids = dict(zip([d["doc_id"] for d in docs], whole([d["text"] or "" for d in docs]), strict=True))
    for p in rows:
        x = np.array([*ids[p["doc_id"]], 1], "<u4")[p["start"] : p["start"] + p["length"]]
        assert zlib.crc32(x.tobytes()) == p["ids_crc32"]


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_very_long_text_and_clashing_names(spark):
    text = "wörd, and " * 60_000
    df = spark.createDataFrame([(1, text, "x", b"y")], "doc_id long, text string, key string, ids binary")
    got = P.pack(df, PATH).orderBy("start").collect()
    ids = np.concatenate([np.frombuffer(bytes(p["ids"]), "<u4") for p in got]).tolist()
    assert ids == [*whole([text])[0], 1]


def test_long_white_space(spark):
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 600_000, "x" + "\t \n" * 500_000, "é" + " " * (P.LONGEST_BLANK - 1) + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {}
    for p in P.pack(df, PATH).orderBy("doc_id", "start").collect():
        got.setdefault(p["doc_id"], []).extend(np.frombuffer(bytes(p["ids"]), "<u4").tolist())
    assert got == {i: [*x, 1] for i, x in enumerate(whole(texts))}
