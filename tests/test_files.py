"""Files for each row, the catalog, broken pages and equations."""

import json
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import latex
from corpusloom.functions import text as T
from corpusloom.plans import catalog, schemas
from corpusloom.sinks import files as sinks
from corpusloom.sinks.row_files import filesystem, placed, write_files
from corpusloom.sources import files


def there(folder) -> dict[str, str]:
    return {str(p.relative_to(folder)): p.read_text() for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_chapter_files_again_is_as_once(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "one\r\ntwo"), ("b", 2, None), ("b", 10, "é x\n"), ("c d+%", 10, "x"), ("b", 1, "zz")], "book string, number int, content string").repartition(3)
    for _ in range(2):
        sinks.write_chapters(df, f"{tmp_path}/out")
        assert there(f"{tmp_path}/out") == {"b/chapters/1.txt": "one\ntwo", "b/chapters/2.txt": "", "b/chapters/10.txt": "é x\n", "c d+%/chapters/10.txt": "x", "_SUCCESS": '{"files": 4, "kept": 0}'}
    got = files.chapter_files(spark, f"{tmp_path}/out").collect()
    assert sorted(tuple(r) for r in got) == [("b", "1", 1, "one\r\ntwo"), ("b", "10", 2, "é x\n"), ("c d+%", "10", 1, "x")]


def test_entry_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", "1", 1, "text", "t"), ("b", "1", 2, None, "gone"), ("b", "1", 3, "figure", None), ("b", "2", 1, "table", "x")], "book string, chapter string, index int, content_type string, content string")
    sinks.write_content(rows, f"{tmp_path}/o")
    found = there(f"{tmp_path}/o")
    assert json.loads(found.pop("_SUCCESS"))["files"] == 3
    assert found == {"b/chapters/1/content/text_1.md": "t", "b/chapters/1/content/figure_3.md": "", "b/chapters/2/content/table_1.md": "x"}


def test_a_failed_job_repeated_gives_each_file_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "text").repartition(6)
    folder = f"{tmp_path}/out"
    broken = docs.withColumn("text", F.when(F.col("name") == "77.txt", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        write_files(broken, folder, content="text", unique=True)
    assert "_SUCCESS" not in there(folder) and "77.txt" not in there(folder)
    # what a killed driver leaves behind goes with the next job's end
    (tmp_path / "out" / "_temporary" / "old").mkdir(parents=True)
    (tmp_path / "out" / "_temporary" / "old" / "half").write_text("ha")
    for _ in range(2):
        write_files(docs, folder, content="text")
    want = {r["name"]: r["text"] for r in docs.collect()}
    found = there(folder)
    assert json.loads(found.pop("_SUCCESS")) == {"files": len(want), "kept": 0} and found == want
    back = files.whole_texts(spark, folder, "*.txt").select(F.concat("chapter", F.lit(".txt")).alias("name"), F.col("content").alias("text"))
    assert back.exceptAll(docs).count() == 0 and back.count() == len(want)


def test_files_that_are_there_stay(spark, tmp_path):
    sinks.write_new_files(spark.createDataFrame([("a.md", "other", "1")], "name string, category string, content string"), f"{tmp_path}/o")
    sinks.write_new_files(spark.createDataFrame([("a.md", "nonsense", "2"), ("a.md", "lab_manual", "3"), ("b.md", None, "5"), ("b.md", None, "4")], "name string, category string, content string"), f"{tmp_path}/o")
    found = there(f"{tmp_path}/o")
    assert json.loads(found.pop("_SUCCESS")) == {"files": 2, "kept": 1} and found == {"other/a.md": "1", "labs/a.md": "3", "other/b.md": "4"}


def test_a_file_that_comes_meanwhile_stays(tmp_path):
    system, root = filesystem(f"{tmp_path}")
    for keep, want in ((True, "there"), (False, "new")):
        (tmp_path / "part").write_text("new")
        (tmp_path / "a").write_text("there")
        assert placed(system, f"{root}/part", f"{root}/a", keep) is (not keep)
        assert there(tmp_path) == {"a": want}
    (tmp_path / "part").write_text("x")
    assert placed(system, f"{root}/part", f"{root}/b", True) and there(tmp_path) == {"a": "new", "b": "x"}


def test_a_folder_of_many_files_is_deleted_in_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "READ_FILES", 10)
    (tmp_path / "beside").write_text("x")
    rows = spark.range(35).select(F.concat(F.lit("c %+"), F.col("id") % 3, F.lit("/d/"), "id", F.lit(".md")).alias("name"), F.lit("x").alias("content"))
    write_files(rows, f"{tmp_path}/o", unique=True)
    assert files.delete_files(spark, f"{tmp_path}/o/") == 35 and there(tmp_path) == {"beside": "x"} and not (tmp_path / "o").exists()
    write_files(rows.limit(9), f"{tmp_path}/o", unique=True)
    assert files.delete_files(spark, f"{tmp_path}/o") == 0 and not (tmp_path / "o").exists()


@pytest.mark.parametrize("name", ["../x", "a//b", "/x", "", None, "a/../../b", "."])
def test_names_stay_under_the_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="not a file name"):
        write_files(spark.createDataFrame([(name, "x")], "name string, content string"), f"{tmp_path}/o")
    assert there(tmp_path) == {}


def test_empty_tables_and_bytes(spark, tmp_path):
    write_files(spark.createDataFrame([], "name string, content binary"), f"{tmp_path}/e")
    assert there(f"{tmp_path}/e") == {"_SUCCESS": '{"files": 0, "kept": 0}'}
    write_files(spark.createDataFrame([("x", bytearray(b"\x00\xff"))], "name string, content binary"), f"{tmp_path}/e")
    assert (tmp_path / "e" / "x").read_bytes() == b"\x00\xff"
    with pytest.raises(Exception, match="only appends"):
        spark.createDataFrame([("x", b"")], "name string, content binary").write.format("row_files").mode("overwrite").save(f"{tmp_path}/e")


def test_catalog_twice_is_as_once(spark):
    spark.sql("DROP DATABASE IF EXISTS corpusloom_test CASCADE")
    try:
        added = catalog.initialize(spark, "corpusloom_test")
        assert {(t, c) for t, cs in added.items() for c in cs} == {(t, c) for t, c, _, _ in schemas.ADDED}
        once = catalog.described(spark, "corpusloom_test").collect()
        assert not any(catalog.initialize(spark, "corpusloom_test").values())
        assert catalog.described(spark, "corpusloom_test").collect() == once
        assert [r["column"] for r in sorted(once, key=lambda r: r["position"]) if r["table"] == "sections"][-2:] == ["parent_section_id", "level"]
        for table in schemas.TABLES:
            assert spark.table(f"corpusloom_test.{table}").columns == schemas.empty(spark, table).columns
        # rows that are there read the default; so do later ones that don't name the column
        catalog.create(spark, "corpusloom_test.t", "a int")
        spark.sql("INSERT INTO corpusloom_test.t VALUES (1)")
        assert catalog.add_columns(spark, "corpusloom_test.t", [("A", "int", 3), ("b", "string", "it's \\ so"), ("c", "int", None)]) == ["b", "c"]
        spark.sql("INSERT INTO corpusloom_test.t (a) VALUES (2)")
        assert sorted(tuple(r) for r in spark.table("corpusloom_test.t").collect()) == [(1, "it's \\ so", None), (2, "it's \\ so", None)]
    finally:
        spark.sql("DROP DATABASE corpusloom_test CASCADE")


def test_broken_pages_take_linear_time(spark):
    pages = ['<a href="x.pdf">' * 60_000, "<a " * 300_000, "<" * 1_000_000, "<a href='" * 100_000, '<a href="x.pdf">' + "<" * 900_000, "<a href" + " " * 900_000]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    files.html_links(df.limit(0), ["id"]).collect()
    began = time.time()
    assert sorted((r["id"], r["href"]) for r in files.html_links(df, ["id"]).collect()) == [(0, "x.pdf"), (4, "x.pdf")]
    assert time.time() - began < 20


def test_links_that_stay_open(spark):
    html = "<A data-href='n.pdf' HREF = 'a.pdf' class=x>One<a href=\"b.docx\">Two <b>bold</B></A > out <abbr href='c.pdf'>no</abbr><a\nhref='d.pptx'>3 < 4 & <i"
    got = files.html_links(spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<a>no</a>")], "id int, html string"), ["id"]).collect()
    assert sorted((r["href"], r["title"]) for r in got) == [("a.pdf", "One"), ("b.docx", "Two bold"), ("d.pptx", "3 < 4 & <i")]


KINDS = ("vector", "derivative", "below", "power", "greek", "letter")


def piece(rng: random.Random) -> tuple[str, str, list[tuple[str, str]]]:
    """A part of an equation, made with the variables it stands for: (LaTeX, kind, names)."""
    letter, greek = lambda: rng.choice("abcdfghxyzABE"), lambda: rng.choice(latex.GREEK)
    kind = rng.choice((*KINDS, "none"))
    if kind == "vector":
        a, g = letter(), greek()
        return rng.choice([rf"\vec{{{a} \{g}}}", rf"\mathbf {{\{g} {a}}}"]), kind, [g, a]
    if kind == "derivative":
        a, b = letter(), letter()
        return rf"\frac{{\partial {a}}}{{\partial {b}}}", kind, [a, b]
    if kind == "below":
        a, g = letter(), greek()
        return rng.choice([(rf"{a}_{{\{g} x}}", kind, [f"{a}_{g}"]), (rf"\{g}_{{12k, 3}}", kind, [f"{g}_12k"]), (rf"\sum_{{{a}=1}}", kind, []), (rf"{a}_{{\text{{max}}}}", kind, [f"{a}_text"])])
    if kind == "power":
        a = letter()
        return rng.choice([(rf"{a}^{{2k}}", kind, [a]), (rf"\exp^{{{a}}}", kind, [])])
    if kind == "greek":
        g = greek()
        return rf"\{g} ", kind, [g]
    if kind == "letter":
        a, b = letter(), letter()
        return rng.choice([(f"{a}_{b} ", kind, [a, b]), (f"2{a}3 ", kind, [a]), (f"({a}/{b})", kind, [a, b]), (rf"\sqrt{{{a}}}", kind, [a])])
    return rng.choice([r"\sin ", "word ", "$$", r"\llap{a b}", r"\cdot ", r"\marginpar {z}", r"\left(", "+ 12 "]), kind, []


def test_variables_are_those_that_the_parts_were_made_of():
    rng = random.Random(3)
    for _ in range(3000):
        parts = [piece(rng) for _ in range(rng.randint(0, 7))]
        want = []
        for kind in KINDS:
            mine = [n for _, k, names in parts if k == kind for n in names]
            if kind == "vector":  # Greek letters of all vectors before the others
                mine = [n for n in mine if n in latex.GREEK] + [n for n in mine if n not in latex.GREEK]
            want += mine
        stop = {*latex.CONSTANTS, *latex.OPERATORS, *latex.COMMANDS}
        eq = " + ".join(p for p, _, _ in parts)
        assert latex.variables_of(eq) == [n for n in dict.fromkeys(want) if n.lower() not in stop], eq


def test_chunks_against_a_loop(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "bc", "\n", "\n\n", "\U0001f600", " "], k=rng.randint(1, 60))) for _ in range(400)] + ["x" * 10, "x" * 11, "", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    for size in (1, 2, 3, 10):
        for (t,), got, fixed in zip(df.collect(), [r[0] for r in df.select(T.chunks_paragraphs(F.col("t"), size)).collect()], [r[0] for r in df.select(T.chunks_fixed(F.col("t"), size)).collect()], strict=True):
            want, rest = [], t
            while rest:
                blank = rest.rfind("\n\n", 0, size) if len(rest) > size else -1
                n = blank if blank > 0 else size
                want.append(rest[:n])
                rest = rest[n:]
            assert got == (None if t is None else want), (t, size)
            assert fixed == (None if t is None else [t[i : i + size] for i in range(0, len(t), size)])
    long = spark.range(1).select(F.repeat(F.lit("ab\n\ncdé "), 1_000_000).alias("t"))
    began = time.time()
    assert long.select(F.size(T.chunks_paragraphs(F.col("t"), 200_000)), F.size(T.chunks_fixed(F.col("t"), 1000))).first()[1] == 8000
    assert time.time() - began < 20


def test_cleaning(spark):
    for eq, want in [("  a  $$ b\n\tc ", "a b c"), (r"\ \ x", "\\x"), (r"\\\\alpha", r"\alpha"), (r"\llap{a}b\marginpar  {c d}", "b"), (r"\llap{open", r"\llap{open"), ("", ""), ("$$", "")]:
        assert latex.cleaned(eq) == want
    began = time.time()
    for eq in ("x_{" * 50_000 + "}" * 50_000, r"\llap{" * 100_000, "{" * 200_000, r"\vec{" * 50_000 + "}" * 50_000):
        latex.variables_of(eq)
    assert time.time() - began < 10
    got = [r[0] for r in spark.createDataFrame([("$$x$$",), (None,)], "t string").select(latex.clean_latex(F.col("t"))).collect()]
    assert got == ["x", None]
    names = spark.sql("SELECT array('x', 'Sin', 'E', 'omega') AS n").select(latex.real_variables(F.col("n"))).first()[0]
    assert names == ["x", "omega"]


def test_files_are_written_listed_and_read_in_many_tasks(spark, tmp_path, monkeypatch):
    """Tasks go by the number of files, and no name passes the driver's file index."""
    monkeypatch.setattr("corpusloom.sinks.row_files.FILES_A_TASK", 20)
    monkeypatch.setattr(files, "READ_FILES", 20)
    want = {(f"d{n % 3}/e", f"{n} +%é"): f"text {n}\n" for n in range(100)}
    rows = spark.createDataFrame([(f"{d}/{n}.md", text) for (d, n), text in want.items()] + [("d0/empty.md", ""), ("top.txt", "no")], "name string, content string").coalesce(1)
    write_files(rows, f"{tmp_path}/out", unique=True)
    for root in (f"{tmp_path}/out", f"file://{tmp_path}/out"):
        found = files.whole_texts(spark, root)
        back = found.withColumn("at", F.spark_partition_id()).collect()
        assert {(r["path"].removeprefix(f"{root}/").rpartition("/")[0], r["chapter"]): r["content"] for r in back} == want
        assert len(back) == 100 and len({r["at"] for r in back}) > 3
        assert "FileScan text" not in found._jdf.queryExecution().executedPlan().toString()
