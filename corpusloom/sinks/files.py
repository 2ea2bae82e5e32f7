"""File sinks: descriptions as Markdown, chapters and entries as files, JSON log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sinks.row_files import write_files

# Folders of the kinds of material.
CATEGORIES = {"lecture_slides": "lectures", "tutorial_questions": "tutorials", "tutorial_solutions": "tutorials/solutions", "past_exam_papers": "exams", "lab_manual": "labs", "reference_notes": "notes", "other": "other"}


def folder_of(category: Column) -> Column:
    """The folder of a category; unknown ones go to `other`."""
    pairs = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, category), F.lit("other"))


# The headings and line forms of a description; what is written must be read back.
def description_md(d: Column) -> Column:
    """A chapter description (struct) as Markdown; what `description_from_md` reads."""
    aliases = lambda c: F.when(F.size(c["aliases"]) > 0, F.concat(F.lit(" (aliases: "), F.array_join(c["aliases"], ", "), F.lit(")"))).otherwise("")
    concept = lambda c: F.concat(F.lit("- ["), c["classification"], F.lit("] "), c["name"], aliases(c), F.lit("\n  "), c["description"], F.lit("\n"))
    items = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")
    parts = [
        F.lit("# "), d["chapter_title"], F.lit("\n\n**Source**: "), d["source_textbook"], F.lit("\n**Chapter**: "), d["chapter_number"],
        F.lit("\n**Pages**: "), d["page_range"]["start"].cast("string"), F.lit("-"), d["page_range"]["end"].cast("string"),
        F.lit("\n\n## Summary\n\n"), d["summary"], F.lit("\n\n## Key Concepts\n\n"), F.array_join(F.transform(d["key_concepts"], concept), ""),
        F.lit("\n## Prerequisites\n\n"), items(d["prerequisites"]), F.lit("\n## Mathematical Content\n\n"), items(d["mathematical_content"]),
        F.lit("\n## Figures\n\n**Has Figures**: "), F.when(d["has_figures"], "Yes").otherwise("No"), F.lit("\n"), items(d["figure_descriptions"]),
    ]
    return F.concat(*parts)


def description_from_md(text: Column) -> Column:
    """The record in a description. A concept's description is the indented line after it."""
    field = lambda name: F.trim(F.regexp_extract(text, rf"(?m)^\*\*{name}\*\*:(.*)$", 1))
    section = lambda name: F.regexp_extract(text, rf"(?s)(?:^|\n)## {name}\n(.*?)(?:\n## |\z)", 1)
    items = lambda name: F.transform(F.filter(F.split(section(name), "\n"), lambda x: x.startswith("- ")), lambda x: F.trim(F.substring(x, F.lit(3), F.length(x))))
    shape = r"(?m)^- \[(EXPLAINS|USES)\] (.+?)(?:\s+\(aliases: (.+?)\))?$(?:\n {2}(.*)$)?"
    group = lambda n: F.regexp_extract_all(section("Key Concepts"), F.lit(shape), n)
    rows = F.arrays_zip(group(1).alias("c"), group(2).alias("n"), group(3).alias("a"), group(4).alias("d"))
    split = lambda a: F.when(F.coalesce(a, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(a, ","), lambda x: F.trim(x)))
    concept = lambda r: F.struct(F.trim(r["n"]).alias("name"), split(r["a"]).alias("aliases"), r["c"].alias("classification"), F.trim(F.coalesce(r["d"], F.lit(""))).alias("description"))
    summary = F.array_join(F.filter(F.split(section("Summary"), "\n"), lambda x: (F.rtrim(x) != "") & ~x.startswith("#")), " ")
    return F.struct(
        field("Source").alias("source_textbook"),
        field("Chapter").alias("chapter_number"),
        F.trim(F.regexp_extract(text, r"(?m)^# (.*)$", 1)).alias("chapter_title"),
        F.struct(F.regexp_extract(field("Pages"), r"^(\d+)\s*-", 1).try_cast("int").alias("start"), F.regexp_extract(field("Pages"), r"-\s*(\d+)$", 1).try_cast("int").alias("end")).alias("page_range"),
        F.trim(summary).alias("summary"),
        F.transform(rows, concept).alias("key_concepts"),
        items("Prerequisites").alias("prerequisites"),
        items("Mathematical Content").alias("mathematical_content"),
        F.contains(field("Has Figures"), F.lit("Yes")).alias("has_figures"),
        items("Figures").alias("figure_descriptions"),
    )


def write_content(entries: DataFrame, folder: str) -> None:
    """Entries (book, chapter, index, content_type, content): a file each, by type and index in
    the content folder of the chapter; entries without a type are left out. Again is as once."""
    name = F.concat_ws("/", "book", F.lit("chapters"), F.col("chapter").cast("string"), F.lit("content"), F.concat_ws("_", "content_type", F.col("index").cast("string")))
    write_files(entries.where("content_type IS NOT NULL").select(F.concat(name, F.lit(".md")).alias("name"), "content"), folder)


def write_new_files(files: DataFrame, folder: str) -> None:
    """Files (name, category, content) by folder of their category, but none that is there; of
    several with one name and folder the first by content."""
    write_files(files.select(F.concat_ws("/", folder_of(F.col("category")), "name").alias("name"), "content"), folder, keep=True)


def write_chapters(chapters: DataFrame, folder: str) -> None:
    """Chapters (book, number, content): a text file each, by number in the chapters folder of
    the book. Again is as once."""
    name = F.concat(F.concat_ws("/", F.col("book").cast("string"), F.lit("chapters"), F.col("number").cast("string")), F.lit(".txt"))
    write_files(chapters.select(name.alias("name"), "content"), folder)


def log_lines(rows: DataFrame) -> DataFrame:
    """(value): rows as JSON lines; nulls are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
