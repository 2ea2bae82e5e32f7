import pytest
from pyspark.sql import functions as F

from corpusloom.functions import records
from corpusloom.operators import interval, islands, mutate, scans, search


def test_readers(spark):
    df = spark.createDataFrame([("a.TXT",), ("b.pdf",), ("c",), ("d.pptx",)], "p string")
    assert [r[0] for r in df.select(records.reader_for(F.col("p"))).collect()] == ["txt", None, None, "pptx"]
    for bad in ("b.pdf", "c"):
        with pytest.raises(Exception, match=f"no reader for {bad}"):
            df.where(F.col("p") == bad).select(records.require_reader(F.col("p"))).collect()


def test_typed_description_defaults(spark):
    df = spark.createDataFrame([('{"key_concepts": [{"name": "a", "classification": "Explains"}, {"name": "b"}, {"aliases": ["x"]}]}',), ("nonsense",), (None,)], "j string")
    got = [r[0] for r in df.select(records.typed_description(F.col("j"))).collect()]
    assert got[0]["summary"] == "" and [(c["name"], c["aliases"], c["classification"]) for c in got[0]["key_concepts"]] == [("a", [], "EXPLAINS"), ("b", [], "USES")]
    assert got[1:] == [None, None]


def test_prompt_and_lists(spark):
    row = spark.createDataFrame([("n", None, ["b", "a", None, " ", "b"])], "a string, b string, c array<string>")
    got = row.select(records.fill("{a}-{b}{x} {a}", a=F.col("a"), b=F.col("b")), records.fill("", a=F.col("a")), records.distinct_in_order(F.col("c"))).first()
    assert list(got) == ["n-{x} n", "", ["b", "a"]]


def test_first_rows_by_a_total_order_and_null_keys(spark):
    table = spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string")
    rows = spark.createDataFrame([(2, "z"), (2, "b"), (None, "m"), (1, "q")], "k long, v string").repartition(3)
    assert sorted((str(r["k"]), r["v"]) for r in mutate.insert_ignore(table, rows, ["k"]).collect()) == [("1", "a"), ("2", "b"), ("None", "n")]
    assert sorted((str(r["k"]), r["v"]) for r in mutate.upsert(table, rows, ["k"]).collect()) == [("1", "q"), ("2", "b"), ("None", "m")]


def test_nearest_start_against_all_pairs(spark):
    points = [(g, p) for g in range(3) for p in [None, 0, 1, 5, 9, 14, 30, 31, 100]]
    spans = [(0, 3, 5, "b"), (0, 3, 4, "a"), (0, None, 9, "n"), (0, 20, 22, "c"), (1, 10, 12, "x"), (1, 40, 41, "y")]
    got = interval.assign_or_nearest(spark.createDataFrame(points, "g int, page int"), spark.createDataFrame(spans, "g int, lo int, hi int, k string"), ["g"], "page", "lo", "hi", "k").collect()
    want = set()
    for g, p in points:
        mine = sorted(((-1 if lo is None else lo, k, lo, hi) for x, lo, hi, k in spans if x == g))
        if not mine:
            continue
        inside = [m for m in mine if p is not None and m[2] is not None and m[2] <= p <= m[3]]
        best = mine[0] if p is None else inside[0] if inside else min(mine, key=lambda m: (abs(p - (interval.FAR if m[2] is None else m[2])), m[0], m[1]))
        want.add((g, p, best[1]))
    assert {(r["g"], r["page"], r["k"]) for r in got} == want


def test_children_and_ranges(spark):
    rows = [(1, "a", 1), (4, "b", 2), (5, "c", 1), (5, "d", 2), (5, "e", 1), (9, "f", 1), (3, "g", 3), (None, "h", 1), (None, "i", 2)]
    got = {r["t"]: r["has_child"] for r in interval.holds_child(spark.createDataFrame([(0, *r) for r in rows], "g int, page int, t string, level int"), ["g"], "page", "t", "level").collect()}
    assert got == {"a": True, "b": None, "c": False, "d": None, "e": True, "f": False, "g": None, "h": False, "i": None}
    up = spark.createDataFrame([("p", 0, 1000), ("q", 990, 995), ("r", 5, 4)], "k string, lo int, hi int")
    low = spark.createDataFrame([(i,) for i in (0, 992, 1000, 1001)], "page int")
    for width in (1, 64):
        assert sorted((r["k"], r["page"]) for r in interval.range_children(up.withColumn("g", F.lit(1)), low.withColumn("g", F.lit(1)), ["g"], "lo", "hi", "page", "k", width).collect()) == [("p", 0), ("p", 992), ("p", 1000), ("q", 992)]


def test_backfill_and_search_limits(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0), (2, -1), (3, 7), (4, None), (5, 0)], "o int, x int").withColumn("g", F.lit(1))
    assert [r["x"] for r in islands.backfill_positive(df, ["g"], ["o"], "x").orderBy("o").collect()] == [7, 7, 7, None, 0]
    docs = spark.createDataFrame([("One\ntwo Three\nfour",), (None,)], "t string")
    kw = spark.createDataFrame([("three",), ("x",), ("three",)], "keyword string")
    hits = search.keyword_hits(docs, kw, "t")
    assert [(r["keyword"], r["s"]) for r in hits.withColumn("s", search.snippet(F.col("t"), F.col("keyword"), 1)).collect()] == [("three", "One\ntwo Three\nfour")]
    assert search.keyword_hits(docs, kw.where("false"), "t").collect() == []
    # no limit any more: keywords beyond a block's size go in further blocks
    monkeypatch.setattr(search, "BLOCK_CHARS", 1)
    assert [r["keyword"] for r in search.keyword_hits(docs, kw, "t").collect()] == ["three"]


def test_guard_and_lookup(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    assert [r["rejected"] for r in scans.guard(df, "s", "a").orderBy("k").collect()] == [None, "expected a, is none"]
    assert scans.lookup(df, k=None, s="a").count() == 1 and scans.lookup(df).count() == 2
    assert [r["k"] for r in df.where(scans.differs(F.col("s"), "a")).collect()] == [2]


def test_null_keys_keep_their_id_and_are_patched(spark):
    table = spark.createDataFrame([(1, "i1", "a", "x"), (None, "i2", "b", "y"), (3, "i3", "c", None)], "k long, id string, v string, w string")
    rows = spark.createDataFrame([(None, "n1", "B", "Y"), (1, "n2", "A", "X"), (4, "n4", "D", "Z")], "k long, id string, v string, w string")
    assert {(r["k"], r["id"], r["v"]) for r in mutate.upsert_keep_id(table, rows, ["k"]).collect()} == {(None, "i2", "B"), (1, "i1", "A"), (3, "i3", "c"), (4, "n4", "D")}
    changes = spark.createDataFrame([(None, "B"), (1, None), (3, "q"), (3, "p"), (9, "z")], "k long, v string").repartition(3)
    assert {(r["k"], r["id"], r["v"], r["w"]) for r in mutate.patch(table, changes, ["k"]).collect()} == {(None, "i2", "B", "y"), (1, "i1", "a", "x"), (3, "i3", "p", None)}
    assert mutate.patch(table, changes, ["k"]).count() == 3
