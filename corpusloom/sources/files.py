"""File sources: one row a file, a slide, a section or a link."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Iterator
from contextlib import suppress
from fnmatch import fnmatchcase
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip, url_stem, url_suffix
from corpusloom.sinks.row_files import files_told, filesystem
from corpusloom.tables import drop_folder, written

LAYOUT = "type string, text string, text_format string, img_path string, image_caption array<string>, image_footnote array<string>, table_body string, page_idx int"
SUPPORTED = ("pdf", "pptx", "docx", "txt", "md", "xlsx")
LINKED = ("pdf", "pptx", "docx")
#: Tasks that list folders at once; files that a task reads, and bytes of them in a batch.
LISTERS, READ_FILES, READ_BYTES = 200, 20_000, 1 << 22


def file_path() -> Column:
    """The path of the file that a row is read from, as it is named there (not as in a URI)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, bytes) of the files under a folder whose name fits the pattern, also in folders
    of any depth; names that begin with `_` or `.` are left out. Each round lists all folders of
    one depth in tasks, so the driver holds no names; it counts the folders that come next."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        for b in batches:
            for top in b.column(0).to_pylist():
                kept = ((f"{top}/{n}", d, z) for n, d, z in _entries(system, root + top[len(folder) :]) if not n.startswith(("_", ".")) and (d or fnmatchcase(n, pattern)))
                while some := list(islice(kept, 10_000)):
                    path, down, size = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(down, pa.bool_()), pa.array(size, pa.int64())], names=["path", "down", "bytes"])

    folder = folder.rstrip("/")
    found, level = [], spark.createDataFrame([(folder,)], "path string")
    while True:
        seen = written(level.mapInArrow(look, "path string, down boolean, bytes long"), "listing")
        found.append(seen.where("NOT down").select("path", "bytes"))
        below = seen.where("down").select("path")
        if not (n := below.count()):
            break
        level = below.repartition(min(n, LISTERS))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _entries(system: fs.FileSystem, root: str) -> Iterator:
    """(name, whether a folder, bytes) of what lies in a folder. A local folder of any size is
    read a name at a time."""
    if not isinstance(system, fs.LocalFileSystem):
        yield from ((x.base_name, x.type == fs.FileType.Directory, x.size) for x in system.get_file_info(fs.FileSelector(root)))
        return
    with os.scandir(root) as names:
        for x in names:
            down = x.is_dir()
            yield x.name, down, None if down else x.stat().st_size


def delete_files(spark: SparkSession, folder: str) -> int:
    """Deletes a folder that nothing reads any more, its files in tasks of READ_FILES; how many
    these were. Few files go from the driver at once, and aren't counted."""
    gone = 0
    if files_told(folder) > READ_FILES:

        def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = filesystem(folder)
            for b in batches:
                n = 0
                for path in b.column(0).to_pylist():
                    with suppress(FileNotFoundError):  # a task that ran before this one
                        system.delete_file(root + path[len(folder) :])
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

        folder = folder.rstrip("/")
        there = listed(spark, folder, "*").select("path")
        dealt = there.repartition(max(1, -(-there.count() // READ_FILES)), "path")
        gone = dealt.mapInArrow(delete, "files long").agg(F.sum("files")).first()[0] or 0
    drop_folder(spark, folder)
    return gone


def contents(files: DataFrame, folder: str) -> DataFrame:
    """(path, raw) of files listed under the folder, read in tasks of READ_FILES files each. A batch of files
    ends at READ_BYTES."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, raws, size = [], [], 0
        system, root = filesystem(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with system.open_input_stream(root + path[len(folder) :]) as f:
                    raws.append(f.read())
                paths.append(path)
                size += len(raws[-1])
                if size >= READ_BYTES or len(paths) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.binary())], names=["path", "raw"])
                    paths, raws, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.binary())], names=["path", "raw"])

    return files.select("path").repartition(max(1, -(-files.count() // READ_FILES)), "path").mapInArrow(read, "path string, raw binary")


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, source, chapter, content) of every file under a folder: the folder above is the
    source, the stem the chapter. Names and texts are read in tasks, so many small files cost
    the driver nothing; each file is a row, but those without a byte are left out."""
    files = contents(listed(spark, folder, pattern).where("bytes > 0"), folder.rstrip("/"))
    parts = F.split("path", "/")
    named = files.select("path", F.col("raw").cast("string").alias("content"))
    return named.select("path", F.element_at(parts, -2).alias("source"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "").alias("chapter"), "content")


def chapter_files(spark: SparkSession, folder: str) -> DataFrame:
    """(book, chapter, position, content) of the text files in `chapters` folders; the position
    goes by name, so 10 comes before 2."""
    texts = whole_texts(spark, folder, "*.txt").where("source = 'chapters'")
    by_name = Window.partitionBy("book").orderBy("chapter", "path")
    return texts.withColumn("book", F.element_at(F.split("path", "/"), -3)).select("book", "chapter", F.row_number().over(by_name).cast("long").alias("position"), "content")


def chapter_text(chapters: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Chapters with their content, '' where there is none."""
    return chapters.join(texts.select(key, "content"), key, "left").withColumn("content", F.coalesce("content", F.lit("")))


def layout(spark: SparkSession, path: str) -> DataFrame:
    """Entries of layout JSON files (an array each), with the file and the place in it."""
    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in LAYOUT.split(", "))
    raw = spark.read.text(path, wholetext=True).select(file_path().alias("path"), F.posexplode(F.from_json("value", f"array<struct<{fields}>>")).alias("pos", "e"))
    return raw.select("path", "pos", "e.*")


def layout_pages(entries: DataFrame, group: list[str], start: Column) -> DataFrame:
    """(group, page, text): texts of each page joined by newlines; discarded entries, and ones
    without text or page, are left out. start: the first page that was asked for (from 0)."""
    kept = entries.where("type <> 'discarded' AND page_idx IS NOT NULL AND coalesce(text, '') <> ''").withColumn("page", start + F.col("page_idx") + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy(*group, "page").agg(text.alias("text"))


def content_type(kind: Column) -> Column:
    """Layout types as content types: image is figure; unknown ones are null."""
    return F.when(kind.isin("text", "table", "equation"), kind).when(kind == "image", "figure")


def entry_title(entries: DataFrame) -> DataFrame:
    """Layout entries with title and content: of figures and tables the first caption and
    captions, body and footnotes; of equations their text; of others no title."""
    caption = F.try_element_at("image_caption", F.lit(1))
    parts = F.concat_ws("\n\n", F.array_join("image_caption", "\n"), "table_body", F.array_join("image_footnote", "\n"))
    fig = F.col("type").isin("image", "table")
    return entries.withColumns({"title": F.when(fig, caption), "content": F.when(fig, parts).otherwise(F.coalesce("text", F.lit("")))})


def without_tags(c: Column) -> Column:
    """Without `<...>`. A `<` that nothing closes stays; only the part up to the last `>` is
    searched, so that each `<` there ends and no text is read twice."""
    tail = F.substring_index(c, ">", -1)
    head = F.substring(c, F.lit(1), F.length(c) - F.length(tail))
    return F.concat(F.regexp_replace(head, r"<[^>]*>", ""), tail)


def html_links(pages: DataFrame, keep: list[str], html: str = "html", suffixes: tuple[str, ...] | None = LINKED) -> DataFrame:
    """(keep..., href, title, file_type): links of each page whose path has one of the
    suffixes (None: any), each href once, the first; a blank title becomes the file's stem.

    A page is cut once where a link's tag opens; a link ends at its end tag, where the next one
    opens, or with the page. Each piece is read once, so broken pages cost no more than others.
    """
    piece = F.slice(F.split(html, r"(?i)<a(?=\s)"), 2, 1 << 30)
    rows = pages.select(*keep, F.posexplode(piece).alias("pos", "piece"))
    rows = rows.select(*keep, "pos", F.regexp_extract("piece", r"""(?i)^[^>]*?\shref\s*+=\s*+["']([^"']*+)["']""", 1).alias("href"), F.regexp_extract("piece", r"""(?is)^[^>]*?\shref\s*+=\s*+["'][^"']*+["'][^>]*+>(.*)$""", 1).alias("rest"))
    rows = rows.where("href <> ''").withColumn("file_type", url_suffix(F.col("href")))
    if suffixes is not None:
        rows = rows.where(F.col("file_type").isin(*suffixes))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keep, "href").orderBy("pos"))).where("_n = 1")
    label = strip(without_tags(F.split("rest", r"(?i)</a\s*>", 2)[0]))
    return first.select(*keep, "href", F.when(label != "", label).otherwise(url_stem(F.col("href"))).alias("title"), "file_type")


def supported(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(*SUPPORTED)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def slides(spark: SparkSession, folder: str) -> DataFrame:
    """(path, number, text) of each slide of the .pptx files under a folder: texts of its
    paragraphs, stripped, blank ones left out, joined by newlines."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
                    for number, name in sorted(names):
                        paragraphs = ("".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in ElementTree.fromstring(z.read(name)).iter(f"{_A}p"))
                        rows.append((path, number, "\n".join(x for x in paragraphs if x)))
            yield pd.DataFrame(rows, columns=["path", "number", "text"])

    return _binary(spark, folder, "*.pptx").mapInPandas(read, "path string, number long, text string")


def doc_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, pos, heading, text) of the paragraphs of the .docx files under a folder."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, raw in zip(f["path"], f["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    body = ElementTree.fromstring(z.read("word/document.xml"))
                for pos, p in enumerate(body.iter(f"{_W}p")):
                    style = p.find(f"{_W}pPr/{_W}pStyle")
                    heading = style is not None and (style.get(f"{_W}val") or "").startswith("Heading")
                    rows.append((path, pos, heading, "".join(t.text or "" for t in p.iter(f"{_W}t"))))
            yield pd.DataFrame(rows, columns=["path", "pos", "heading", "text"])

    return _binary(spark, folder, "*.docx").mapInPandas(read, "path string, pos long, heading boolean, text string")


def doc_sections(paragraphs: DataFrame) -> DataFrame:
    """(path, number, title, text): paragraphs under the heading before them; what stands
    before the first is "Introduction"; a heading without text gives nothing."""
    clean = paragraphs.withColumn("text", strip(F.col("text"))).where("text <> ''")
    w = Window.partitionBy("path").orderBy("pos")
    blocks = clean.withColumn("b", F.sum(F.col("heading").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    made = blocks.groupBy("path", "b").agg(F.max(F.when(F.col("heading"), F.col("text"))).alias("title"), body.alias("text")).where("text <> ''")
    return made.select("path", F.row_number().over(Window.partitionBy("path").orderBy("b")).cast("long").alias("number"), F.coalesce("title", F.lit("Introduction")).alias("title"), "text")


def _binary(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def is_scanned(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, scanned): none of the first five pages has over 100 characters when stripped."""
    told = (F.col(page) <= 5) & (F.length(strip(F.col(text))) > 100)
    return pages.groupBy(doc).agg((~F.coalesce(F.bool_or(told), F.lit(False))).alias("scanned"))
