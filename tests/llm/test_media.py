import hashlib
import zlib

from corpusloom.llm import media as M


def test_pages_stay_in_order():
    page = """<html><head><title>no</title><script>var t="</p>";</script></head><body><p>One &amp; two</p>
    <figure><img src="a.png" alt="alt a"><figcaption>Caption <b>A</b></figcaption></figure>tail<img src="b.png" alt="alt b"><p>End<audio src="c.wav"></audio>"""
    got = [(i["kind"], i["text"], i["ref"], i["caption"]) for i in M.parse_page(page)]
    assert got == [("text", "One & two", None, None), ("media", None, "a.png", "Caption A"), ("text", "tail", None, None), ("media", None, "b.png", "alt b"), ("text", "End", None, None), ("media", None, "c.wav", None)]
    assert M.parse_page(None) == M.parse_page("") == M.parse_page("<p></p><img>") == []
    assert [i["text"] for i in M.parse_page("<p>a<br>b<p>c</div>")] == ["a", "b", "c"]


def test_query_reads_back_what_was_stored(spark, tmp_path):
    from corpusloom.llm.queries import op5_media

    texts = ["", None, "a", "x" * 192, "é" * 97, "x" * 193, "same", "same", "long " * 50_000, "<p>&amp;"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op5_media(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        file = M.wav(payload)
        g = got[i]
        assert (g["n_bytes"], g["payload_bytes"], g["media_bytes"]) == (len(raw), len(payload), len(file))
        assert g["payload_sha256"] == hashlib.sha256(payload).hexdigest() and g["media_sha256"] == hashlib.sha256(file).hexdigest()
        assert g["tail_crc32"] == zlib.crc32(payload[-16:]) and g["caption"] == str(i) and g["feature"] == M.features(payload)
    assert got[6]["feature"] == got[7]["feature"]


def test_unresolved_references_keep_their_place(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><img src='sha256:" + "0" * 64 + "'><p>b</p><img src='x.png'>"), (2, None)], "page_id long, html string")
    items = M.interleave(pages, ["page_id"])
    feats = spark.createDataFrame([], "digest string, payload_bytes long")
    got = sorted((r["pos"], r["kind"], r["payload_bytes"]) for r in M.resolve(items, feats).collect())
    assert got == [(0, "text", None), (1, "media", None), (2, "text", None), (3, "media", None)]


def test_table_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    items = M.interleave(pages, ["page_id"]).collect()
    for p in pages.collect():
        mine = sorted((i["pos"], i["kind"]) for i in items if i["page_id"] == p["page_id"])
        assert [x[0] for x in mine] == list(range(len(mine)))
