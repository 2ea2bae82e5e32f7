"""Runs of neighbouring rows: filling, batching and merging.

Breaks are flagged by the row before, numbered by a running sum, and each number is a group.
Groups of any size are dealt over the tasks (operators/ordered.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import same_title, strip
from corpusloom.operators.ordered import Ordered, next_after, previous, sum_before

HEADING = r"(?U)^\d+\.\d+(\.\d+)*\s+.+$"
HEADING_CHARS = 150


def backfill_positive(df: DataFrame, group: list[str], order: list[str], col: str, out: str | None = None, spread: bool | None = None) -> DataFrame:
    """Values of 0 or less take the next positive one in order; if none follows they stay."""
    positive = F.when(F.col(col) > 0, F.col(col))
    rows = Ordered(df, group, order, spread).add(_ahead=next_after(positive)).done()
    return rows.withColumn(out or col, F.coalesce(positive, F.col("_ahead"), F.col(col))).drop("_ahead")


def _numbered(rows: Ordered, same: Column, out: str = "island") -> DataFrame:
    """Runs from 1: a row starts one unless `same` holds (null doesn't)."""
    rows.rows = rows.rows.withColumn("_break", F.when(same, 0).otherwise(1))
    return rows.add(_runs=sum_before(F.col("_break"))).done().withColumn(out, (F.col("_runs") + F.col("_break")).cast("long")).drop("_break", "_runs")


def number_islands(df: DataFrame, group: list[str], order: list[str], same: Column, out: str = "island", spread: bool | None = None) -> DataFrame:
    """Numbers runs from 1: a row starts one unless `same` holds (null doesn't)."""
    return _numbered(Ordered(df, group, order, spread), same, out)


def contiguous_batches(df: DataFrame, group: list[str], lo: str, hi: str, tie: str, spread: bool | None = None) -> DataFrame:
    """Intervals whose start follows the end before by one, as batches: (group, island, lo,
    hi, n)."""
    rows = Ordered(df, group, list(dict.fromkeys([lo, tie])), spread).add(_prev=previous(F.col(hi)))
    return _numbered(rows, F.col("_prev.v") + 1 == F.col(lo)).groupBy(*group, "island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n"))


def key_islands(df: DataFrame, group: list[str], order: list[str], key: str, spread: bool | None = None) -> DataFrame:
    """Rows with the number of their run of one key (nulls are one key)."""
    rows = Ordered(df, group, order, spread).add(_prev=previous(F.col(key)))
    return _numbered(rows, F.col("_prev").isNotNull() & F.col("_prev.v").eqNullSafe(F.col(key))).drop("_prev")


def ordered_concat(value: str, order: list[str], sep: str) -> Column:
    """Aggregate: values joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))), lambda x: x["_v"]), sep)


def merge_by_section(entries: DataFrame, group: list[str], order: str, spread: bool | None = None) -> DataFrame:
    """Merges neighbouring text entries of one section: (group, order, type, page, text).

    entries: group, order, type, page, text, section, title (of the section). Anything but
    text breaks a run. Texts equal to the title are dropped; a run becomes `## title` and
    its texts, apart by blank lines, at the page of its first entry; a run of titles only
    vanishes. Blank texts are dropped beforehand. Runs without a section have no heading.
    """
    text = F.col("type") == "text"
    clean = entries.withColumn("text", F.when(text, strip(F.col("text"))).otherwise(F.col("text"))).where(~text | (F.col("text") != ""))
    rows = Ordered(clean, group, [order], spread).add(_prev=previous(F.struct("type", "section")))
    runs = _numbered(rows, text & (F.col("_prev.v.type") == "text") & F.col("_prev.v.section").eqNullSafe(F.col("section")))
    body = F.array_sort(F.collect_list(F.when(~(text & F.coalesce(same_title(F.col("text"), F.col("title")), F.lit(False))), F.struct(order, F.col("text").alias("t")))))
    made = runs.groupBy(*group, "island").agg(F.min(order).alias(order), F.min_by("type", order).alias("type"), F.min_by("page", order).alias("page"), F.min_by("title", order).alias("title"), body.alias("_b"))
    joined = F.array_join(F.transform("_b", lambda x: x["t"]), "\n\n")
    whole = F.when((F.col("type") == "text") & F.col("title").isNotNull(), F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), joined)).otherwise(joined)
    return made.where((F.col("type") != "text") | (F.size("_b") > 0)).select(*group, order, "type", "page", whole.alias("text"))


def is_heading(text: Column) -> Column:
    """A numbered heading line of under 150 characters, such as `1.2 Title`."""
    return text.rlike(HEADING) & (F.length(text) < HEADING_CHARS)


def carry_heading(entries: DataFrame, group: list[str], order: str, spread: bool | None = None) -> DataFrame:
    """Merges text entries under the numbered heading before them: (group, order, type, page,
    text). A heading starts a block even if nothing follows; anything but text ends one."""
    text = F.col("type") == "text"
    clean = entries.withColumn("text", F.when(text, strip(F.col("text"))).otherwise(F.col("text"))).where(~text | (F.col("text") != ""))
    clean = clean.withColumn("_h", text & is_heading(F.col("text")))
    runs = _numbered(Ordered(clean, group, [order], spread).add(_prev=previous(F.col("type"))), text & ~F.col("_h") & (F.col("_prev.v") == "text"))
    piece = F.when(F.col("_h"), F.concat(F.lit("## "), F.col("text"))).otherwise(F.col("text"))
    runs = runs.withColumn("_p", piece)
    return runs.groupBy(*group, "island").agg(F.min(order).alias(order), F.min_by("type", order).alias("type"), F.min_by("page", order).alias("page"), ordered_concat("_p", [order], "\n\n").alias("text")).drop("island")
