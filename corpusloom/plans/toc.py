"""From a table of contents to chapters and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.interval import holds_child, lead_intervals
from corpusloom.operators.islands import backfill_positive

# Titles that aren't chapters.
META_TITLES = ("contents", "preface", "index", "bibliography", "list of contributors", "foreword", "acknowledgments", "acknowledgements", "about the authors", "about the author", "about the editor", "about the editors", "appendix", "glossary", "table of contents")
SECTION_NUMBER = r"(?U)^\d+\.\d+"


def is_meta(title: Column) -> Column:
    return F.lower(strip(title)).isin(*META_TITLES)


def drop_meta(entries: DataFrame, group: list[str], title: str) -> DataFrame:
    """Without meta titles; a group of nothing else keeps all."""
    kept = F.sum(F.when(is_meta(F.col(title)), 0).otherwise(1)).over(Window.partitionBy(*group))
    return entries.withColumn("_kept", kept).where((F.col("_kept") == 0) | ~is_meta(F.col(title))).drop("_kept")


def detect_chapters(toc: DataFrame, group: list[str]) -> DataFrame:
    """Chapters among the entries (group, pos, level, title, page) of tables of contents.

    Pages of 0 or less take the next positive one. Without level-2 entries, or where more
    than half of them are numbered as sections, level 1 is the chapters. Otherwise level-1
    entries that hold level-2 ones are parts: if none does, level 1 again; if all do, level
    2; else level 2 and what is no part. Without level-1 entries, level 2. Meta titles go.
    """
    filled = backfill_positive(toc, group, ["pos"], "page")
    two = filled.where("level IN (1, 2)")
    over = Window.partitionBy(*group)
    flagged = holds_child(two, group, "page", "pos", "level").withColumns(
        {
            "_n1": F.count_if(F.col("level") == 1).over(over),
            "_n2": F.count_if(F.col("level") == 2).over(over),
            "_numbered": F.count_if((F.col("level") == 2) & strip(F.col("title")).rlike(SECTION_NUMBER)).over(over),
            "_parts": F.count_if(F.col("has_child")).over(over),
        }
    )
    top_only = (F.col("_n2") == 0) | ((F.col("_n1") > 0) & ((F.col("_numbered") * 2 > F.col("_n2")) | (F.col("_parts") == 0)))
    chosen = F.when(top_only, F.col("level") == 1).otherwise((F.col("level") == 2) | ~F.col("has_child"))
    return drop_meta(flagged.where(chosen).select(toc.columns), group, "title")


def chapters_with_default(chapters: DataFrame, books: DataFrame, book: str, total: str) -> DataFrame:
    """(book, number, title, page_start, page_end): chapters as intervals; a book without any
    has one, "Full Document"."""
    ends = lead_intervals(chapters.join(books.select(book, total), book), [book], "page", "pos", F.col(total))
    rows = ends.select(book, "number", "title", F.col("page").alias("page_start"), "page_end")
    bare = books.join(chapters.select(book).distinct(), book, "left_anti")
    return rows.unionByName(bare.select(book, F.lit(1).cast("long").alias("number"), F.lit("Full Document").alias("title"), F.lit(1).cast(rows.schema["page_start"].dataType).alias("page_start"), F.col(total).cast(rows.schema["page_end"].dataType).alias("page_end")))
