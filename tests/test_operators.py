import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import latex
from corpusloom.functions import text as T
from corpusloom.operators import graph, interval, islands, mutate, rank, search, tree
from corpusloom.plans import relevance, schemas, toc
from corpusloom.sinks import files as sinks
from corpusloom.sources import files
from corpusloom.streaming import chunks


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


# --- tables of contents ---

CASES = {
    "empty": ([], []),
    "level 1 only": ([(1, "1 Introduction", 1), (1, "2 Methods", 20), (1, "3 Results", 45)], ["1 Introduction", "2 Methods", "3 Results"]),
    "numbered sections": ([(1, "A", 1), (2, "1.1 x", 2), (2, "1.2 y", 5), (1, "B", 9), (2, "2.1 z", 10), (2, "2.2 w", 14)], ["A", "B"]),
    "parts": ([(1, "Part I", 1), (2, "1 a", 1), (2, "2 b", 20), (1, "Part II", 50), (2, "3 c", 50), (2, "4 d", 80)], ["1 a", "2 b", "3 c", "4 d"]),
    "mixed": (
        [(1, "Contents", 1), (1, "Part I", 5), (2, "1", 5), (2, "2", 20), (2, "3", 35), (1, "4", 55), (1, "Part II", 70), (2, "5", 70), (2, "6", 90), (2, "7", 110), (1, "8", 130)],
        ["1", "2", "3", "4", "5", "6", "7", "8"],
    ),
    "level 2 only": ([(2, "1 Intro", 1), (2, "2 Body", 10)], ["1 Intro", "2 Body"]),
    "unsorted": ([(1, "Part II", 50), (2, "3", 50), (1, "Part I", 1), (2, "1", 1), (2, "2", 25)], ["1", "2", "3"]),
    "meta only": ([(1, "Preface", 1), (1, "Index", 9)], ["Preface", "Index"]),
}


@pytest.mark.parametrize("case", CASES)
def test_detect_chapters(spark, case):
    rows, want = CASES[case]
    df = spark.createDataFrame([("b", i, *r) for i, r in enumerate(rows)], "book string, pos int, level int, title string, page int")
    assert [r["title"] for r in toc.detect_chapters(df, ["book"]).orderBy("page", "pos").collect()] == want


def test_page_zero_takes_the_next(spark):
    pages = [17, 17, 0, 45, 80, 80, 0]
    df = spark.createDataFrame([("b", i, p) for i, p in enumerate(pages)], "book string, pos int, page int")
    assert [r["page"] for r in islands.backfill_positive(df, ["book"], ["pos"], "page").orderBy("pos").collect()] == [17, 17, 45, 45, 80, 80, 0]


# --- intervals ---


def test_first_or_nearest(spark):
    sec = spark.createDataFrame([("7", "s1", 1, 30), ("7", "s2", 31, 60), ("7", "s3", 61, 100)], "ch string, sec string, lo int, hi int")
    pts = spark.createDataFrame([("7", 1, 15), ("7", 2, None), ("7", 3, 200), ("8", 4, 1)], "ch string, id int, page int")
    got = {r["id"]: r["sec"] for r in interval.assign_or_nearest(pts, sec, ["ch"], "page", "lo", "hi", "sec").collect()}
    assert got == {1: "s1", 2: "s1", 3: "s3"}


def test_deepest(spark):
    sec = spark.createDataFrame([("c", "S", 1, 10, 2), ("c", "T", 3, 5, 3), ("c", "U", 8, 2, 3)], "ch string, sec string, lo int, hi int, level int")
    pts = spark.createDataFrame([("c", p) for p in (4, 8, 9, 20)], "ch string, page int")
    got = {r["page"]: r["sec"] for r in interval.assign_deepest(pts, sec, ["ch"], "page", "lo", "hi", "level", "sec").collect()}
    assert got == {4: "T", 8: "U", 9: "S", 20: None}


def test_every_point_gets_one_section(spark):
    r = random.Random(3)
    sec = [("c", i, r.choice([None, r.randint(0, 40)]), r.choice([None, r.randint(0, 60)])) for i in range(12)]
    pts = [("c", i, r.choice([None, r.randint(0, 70)])) for i in range(200)]
    got = interval.assign_or_nearest(spark.createDataFrame(pts, "g string, id int, page int"), spark.createDataFrame(sec, "g string, sec int, lo int, hi int"), ["g"], "page", "lo", "hi", "sec").collect()

    def want(p):
        order = sorted(sec, key=lambda s: (s[2] is not None, s[2] or 0, s[1]))
        if p is None:
            return order[0][1]
        inside = [s for s in order if s[2] is not None and s[3] is not None and s[2] <= p <= s[3]]
        return inside[0][1] if inside else min(order, key=lambda s: (abs(p - (10**9 if s[2] is None else s[2])), order.index(s)))[1]

    assert sorted((g["id"], g["sec"]) for g in got) == sorted((i, want(p)) for _, i, p in pts)


def test_next_qualifying_end(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 2, 2), (2, 2, 5), (3, 1, 9)], "pos int, level int, page int").withColumn("b", F.lit(1))
    assert [r["page_end"] for r in interval.next_qualifying_end(df, ["b"], "page", "pos", "level").orderBy("pos").collect()] == [1, 4, 8, 9]


# --- islands ---


def entries(spark, rows):
    return spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], "g string, pos int, type string, page int, text string, section string, title string")


def test_merge_by_section(spark):
    rows = [("text", 1, " Intro. ", "S1", "Intro"), ("text", 1, "a", "S1", "Intro"), ("text", 2, "b", "S1", "Intro"), ("image", 2, "", "S1", "Intro"), ("text", 3, "c", "S1", "Intro"), ("text", 4, "d", "S2", "Body"), ("text", 4, "  ", "S2", "Body")]
    got = [(r["type"], r["page"], r["text"]) for r in islands.merge_by_section(entries(spark, rows), ["g"], "pos").orderBy("pos").collect()]
    assert got == [("text", 1, "## Intro\n\na\n\nb"), ("image", 2, ""), ("text", 3, "## Intro\n\nc"), ("text", 4, "## Body\n\nd")]
    only = islands.merge_by_section(entries(spark, [("text", 1, "Intro", "S1", "Intro"), ("image", 1, "", "S1", "Intro")]), ["g"], "pos").collect()
    assert [r["type"] for r in only] == ["image"]


def test_heading_carry(spark):
    rows = [("text", 1, t, None, None) for t in ("x", "1.2 Foo", "y")] + [("table", 1, "T", None, None), ("text", 1, "z", None, None), ("text", 1, "3.1 Only", None, None)]
    got = [r["text"] for r in islands.carry_heading(entries(spark, rows), ["g"], "pos").orderBy("pos").collect()]
    assert got == ["x", "## 1.2 Foo\n\ny", "T", "z", "## 3.1 Only"]


def test_contiguous_batches(spark):
    df = spark.createDataFrame([("b", 1, 1, 2), ("b", 2, 3, 4), ("b", 3, 9, 9)], "b string, id int, lo int, hi int")
    assert sorted((r["lo"], r["hi"], r["n"]) for r in islands.contiguous_batches(df, ["b"], "lo", "hi", "id").collect()) == [(1, 4, 2), (9, 9, 1)]


# --- ranks ---


def test_threshold_or_top(spark):
    for scores, want in (([0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.1], [0, 1, 2, 3, 4, 5]), ([0.1] * 6, [0, 1, 2, 3, 4])):
        df = spark.createDataFrame(list(enumerate(scores)), "id int, score double").withColumn("g", F.lit(1))
        assert sorted(r["id"] for r in rank.top_k_or_threshold(df, ["g"], "score", "id").collect()) == want


def test_budget(spark):
    df = spark.createDataFrame([("q", 1, "a" * 90_000), ("q", 2, "b" * 90_000), ("q", 3, "c")], "q string, id int, text string")
    got = rank.budget_take(df, ["q"], [F.col("id")], "text", 100_000).orderBy("id").collect()
    assert [r["id"] for r in got] == [1, 2] and sum(len(r["text"]) for r in got) <= 100_200 and got[1]["text"].endswith("truncated...]")
    tight = rank.budget_take(df, ["q"], [F.col("id")], "text", 90_100).collect()
    assert [r["id"] for r in tight] == [1]


def test_classified_order(spark):
    df = spark.createDataFrame([("a", "USES", 0.9), ("b", "EXPLAINS", 0.8), ("c", "EXPLAINS", 0.1)], "s string, label string, confidence double")
    assert [r["s"] for r in rank.rank_classified(df, "label", "confidence", "s").orderBy("position").collect()] == ["b", "a"]


def test_first_wins_and_is_idempotent(spark):
    df = spark.createDataFrame([(0, "State space"), (1, "state space"), (2, "PID")], "pos int, k string")
    once = rank.first_by_key(df, [F.lower("k")], [F.col("pos")])
    assert sorted(r["k"] for r in once.collect()) == ["PID", "State space"] == sorted(r["k"] for r in rank.first_by_key(once, [F.lower("k")], [F.col("pos")]).collect())


def test_funnel(spark):
    rows = [(1, f"a{i}", None, 1, i / 10) for i in range(8)] + [(1, f"b{i}", f"a{i}", 2, 0.9) for i in range(8)] + [(1, "c0", "b0", 3, 0.1), (1, "c7", "b7", 3, 0.1)]
    df = spark.createDataFrame(rows, "tb int, entry_id string, parent_id string, level int, score double")
    got = {r["entry_id"] for r in relevance.relevance_funnel(df, ["tb"]).collect()}
    assert got == {f"a{i}" for i in range(8)} | {f"b{i}" for i in range(3, 8)} | {"c7"}


# --- search ---


def test_search(spark):
    docs = spark.createDataFrame([("tb_001", "# The Z-Transform\nline\n[EXPLAINS] Z-transform"), ("tb_002", "Z-transform (aliases: ZT)"), ("math_library", "# Fourier Transform")], "source string, text string")
    alias = spark.createDataFrame([("z-transform", "zt"), ("z-transform", "z domain")], "canonical string, alias string")

    def hits(*words, library=None):
        kw = search.expand_keywords(spark.createDataFrame([(w,) for w in words], "keyword string"), alias)
        return {r["source"] for r in search.keyword_hits(docs.where(search.in_library(F.col("source"), library)), kw, "text").collect()}

    assert hits("Z-transform") == hits("zt") == {"tb_001", "tb_002"}
    assert hits("unknown") == set() and hits("transform", library="math") == {"math_library"}
    assert hits("") == {"tb_001", "tb_002", "math_library"}
    assert one(spark, "a\nb\nc\nKey\nd\ne\nf", lambda c: search.snippet(c, F.lit("key"))) == "b\nc\nKey\nd\ne"


# --- trees and graphs ---


def test_paths(spark):
    df = spark.createDataFrame([("root", None, "1"), ("child", "root", "2"), ("lost", "gone", "5"), ("x", "y", "8"), ("y", "x", "9")], "id string, parent string, n string")
    assert {r["id"]: r["path"] for r in tree.paths(df, "id", "parent", F.concat(F.lit("CH7/"), "n")).collect()} == {"root": "CH7/1", "child": "CH7/1/CH7/2", "lost": "CH7/5"}


def test_graph_reads(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "uses"), ("a", "z", "uses"), ("a", "b", "related_to")], "source_node_id string, target_node_id string, relationship_type string")
    assert graph.valid_edges(edges, nodes, list(schemas.RELATIONSHIPS)).count() == 1
    assert graph.incidence(edges, "z", "source_node_id", "target_node_id").count() == 1
    eq = spark.createDataFrame([("eq1", "omega_c"), ("eq1", "x"), ("eq2", "omega_c"), ("eq3", "y")], "eq string, v string")
    assert [tuple(r) for r in graph.co_occurrence(eq, "eq", "v").collect()] == [("eq1", "eq2", 1)]
    made = spark.createDataFrame([("n", [{"symbol": "w", "name": "speed", "type": "calculated", "linked_node_id": "m"}, {"symbol": "g", "name": "gravity", "type": "given", "linked_node_id": "q"}])], "node_id string, equation_components array<struct<symbol: string, name: string, type: string, linked_node_id: string>>")
    assert [(r["target_node_id"], r["reasoning"]) for r in graph.component_uses(made).collect()] == [("m", "w (speed)")]


# --- changes ---


def test_changes(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, name string, x double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    new = spark.createDataFrame([(2, "c", 3.0), (3, "d", 4.0)], "id int, name string, x double")
    assert rows(mutate.upsert(t, new, ["id"])) == [(1, "a", 1.0), (2, "c", 3.0), (3, "d", 4.0)]
    assert rows(mutate.insert_ignore(t, new, ["id"])) == [(1, "a", 1.0), (2, "b", 2.0), (3, "d", 4.0)]
    assert rows(mutate.patch(t, spark.createDataFrame([(1, None, 9.0)], "id int, name string, x double"), ["id"])) == [(1, "a", 9.0), (2, "b", 2.0)]
    assert rows(mutate.delete_where(t, F.col("x") > 1)) == [(1, "a", 1.0)]
    kids = spark.createDataFrame([(10, 1), (11, 2)], "kid int, id int")
    left = mutate.cascade_delete({"t": t, "k": kids}, [("k", "id", "t", "id")], "t", F.col("id") == 1)
    assert rows(left["t"]) == [(2, "b", 2.0)] and rows(left["k"].select("kid", "id")) == [(11, 2)]


def test_migrations_twice(spark):
    once = schemas.empty(spark, "textbooks")
    assert schemas.migrate(once, "textbooks").columns == once.columns
    old = spark.createDataFrame([("s",)], "id string")
    assert schemas.migrate(old, "sections").first()["level"] == 2
    assert all(schemas.empty(spark, n).count() == 0 for n in schemas.TABLES)


# --- expressions ---


@pytest.mark.parametrize(
    "eq,want",
    [(r"\omega_{c}", {"omega_c"}), (r"T_{s}", {"T_s"}), (r"x_{\omega} y^{2} T_s \mathbf{A \alpha}", {"x_omega", "y", "T", "s", "A", "alpha"}), (r"$$\omega_{c} = \sqrt{g/y}$$", {"omega_c", "g", "y"}), (r"\frac{\partial f}{\partial x}", {"f", "x"}), (None, set()), (r"\vec{v} + e^{x} \sin(\theta)", {"v", "theta"})],
)
def test_variables(spark, eq, want):
    got = one(spark, eq, T.parse_equation)
    assert set(got["variables"]) == want and got["is_parseable"] == (eq is not None)


def test_text_functions(spark):
    assert one(spark, r"$$\omega$$", latex.clean_latex) == r"\omega"
    assert one(spark, "  a b\n", T.strip) == "a b"
    assert one(spark, "sk-abcdd4c7", T.mask) == "****...d4c7" and one(spark, "abcd", T.mask) == "abcd"
    assert one(spark, '```json\n{"a": 1}\n```', T.strip_fence) == '{"a": 1}'
    assert one(spark, '{"results": [{"a": 1}]}', lambda c: T.parse_json_list(c, "struct<a: int>"))[0]["a"] == 1
    assert one(spark, "{bad", lambda c: T.parse_json_list(c, "struct<a: int>")) == [] and one(spark, "{bad", lambda c: T.parse_json(c, "a int")) is None
    assert one(spark, "x", lambda c: T.chunks_fixed(F.lit(""), 3)) == []


@pytest.mark.parametrize("text", ["", "a", "aaa\n\nbbb\n\nccc", "x" * 25, "ab\n\n" * 9, "\n\n" * 20, "p" * 9 + "\n\n" + "q" * 30])
def test_paragraph_chunks(spark, text):
    got = one(spark, text, lambda c: T.chunks_paragraphs(c, 10))
    assert "".join(got) == text and all(0 < len(g) <= 10 for g in got)


# --- sources, sinks, streams ---


def test_markdown_round_trip(spark, tmp_path):
    d = {"source_textbook": "Book", "chapter_number": "3", "chapter_title": "Z", "page_range": (1, 9), "summary": "About Z.", "key_concepts": [("z", ["zt", "z domain"], "EXPLAINS", "main"), ("f", [], "USES", "aux")], "prerequisites": ["a", "b", "c"], "mathematical_content": [], "has_figures": True, "figure_descriptions": ["one"]}
    kind = "d struct<source_textbook: string, chapter_number: string, chapter_title: string, page_range: struct<start: int, end: int>, summary: string, key_concepts: array<struct<name: string, aliases: array<string>, classification: string, description: string>>, prerequisites: array<string>, mathematical_content: array<string>, has_figures: boolean, figure_descriptions: array<string>>"
    df = spark.createDataFrame([(d,)], kind)
    (tmp_path / "tb_1").mkdir()
    (tmp_path / "tb_1" / "chapter_3.md").write_text(df.select(sinks.description_md(F.col("d"))).first()[0])
    back = files.whole_texts(spark, str(tmp_path)).select("source", "chapter", sinks.description_from_md(F.col("content")).alias("d")).first()
    assert (back["source"], back["chapter"]) == ("tb_1", "chapter_3")
    assert back["d"] == df.first()["d"]


def test_layout(spark, tmp_path):
    (tmp_path / "l.json").write_text('[{"type":"text","text":"Intro","page_idx":0},{"type":"equation","text":"E=mc^2","page_idx":0},{"type":"image","image_caption":["Figure 1"],"page_idx":0},{"type":"table","text":"A|B","page_idx":1},{"type":"discarded","text":"Header","page_idx":1}]')
    rows = files.layout(spark, str(tmp_path))
    assert {(r["page"], r["text"]) for r in files.layout_pages(rows, ["path"], F.lit(4)).collect()} == {(5, "Intro\nE=mc^2"), (6, "A|B")}
    titled = {r["type"]: r["title"] for r in files.entry_title(rows).collect()}
    assert titled["image"] == "Figure 1" and titled["text"] is None


def test_links(spark):
    html = '<a href="lecture1.pdf">Lecture <b>1</b></a><a href="/x/slides.pptx?v=2"> </a><a href="/about">About</a><a href="lecture1.pdf">again</a>'
    got = files.html_links(spark.createDataFrame([(1, html)], "id int, html string"), ["id"]).orderBy("href").collect()
    assert [(r["href"], r["title"], r["file_type"]) for r in got] == [("/x/slides.pptx?v=2", "slides", "pptx"), ("lecture1.pdf", "Lecture 1", "pdf")]


def test_office_files(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        for n, t in ((1, "One"), (10, "Ten"), (2, " ")):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p>')
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, h=False: f"<w:p>{'<w:pPr><w:pStyle w:val=%sHeading1%s/></w:pPr>' % (chr(34), chr(34)) if h else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{para('before')}{para('H', True)}{para('x')}{para('y')}{para('empty', True)}</w:body></w:document>")
    assert [(r["number"], r["text"]) for r in files.slides(spark, str(tmp_path)).orderBy("number").collect()] == [(1, "One"), (2, ""), (10, "Ten")]
    got = files.doc_sections(files.doc_paragraphs(spark, str(tmp_path))).orderBy("number").collect()
    assert [(r["title"], r["text"]) for r in got] == [("Introduction", "before"), ("H", "x\ny")]


def test_frames(spark):
    df = spark.createDataFrame([(1, 0, "data: a"), (1, 1, "data: b"), (1, 2, "c"), (1, 3, "data: [DONE]"), (1, 4, "data: late")], "s int, seq int, line string")
    got = chunks.join_chunks(chunks.decode_frames(df, "s", "seq", "line"), "s", "seq", "chunk").collect()
    assert [r["message"] for r in got] == ["ab"]


def test_latest_state_streams(spark, tmp_path):
    spark.createDataFrame([("j", 1, "pending"), ("j", 2, "done"), ("k", 1, "pending")], "job string, seq int, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job string, seq int, status string").parquet(str(tmp_path / "in"))
    q = chunks.latest_state(stream, "job", "seq").writeStream.outputMode("complete").format("memory").queryName("jobs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert {r["job"]: r["status"] for r in spark.table("jobs").collect()} == {"j": "done", "k": "pending"}


def test_score_repair(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "pos int")
    assert [r["score"] for r in relevance.repaired_scores(df, F.array(F.lit(0.5)), "pos").orderBy("pos").collect()] == [0.5, 0.0, 0.0]


def test_whole_tables_co_occur_and_nest(spark, sf):
    from collections import Counter
    from itertools import combinations

    from corpusloom import queries

    orders = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(r["l_orderkey"], set()).add(r["l_partkey"])
    pairs = Counter(p for items in orders.values() for p in combinations(sorted(items), 2))
    assert {(r["a"], r["b"]): r["n"] for r in queries.QUERIES["jn13_agg06_cooccurrence_whole"](spark, sf).collect()} == pairs
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    want = Counter((a["p_partkey"], b["p_partkey"]) for a in parts for b in parts if a["p_brand"] == b["p_brand"] and a["p_size"] <= b["p_size"] <= a["p_size"] + 4)
    assert Counter(map(tuple, queries.QUERIES["jn04_flt08_range_children_whole"](spark, sf).collect())) == want
