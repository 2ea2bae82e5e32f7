"""Scored entries of a table of contents, and material that matches them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clamp
from corpusloom.operators.rank import top_k_or_threshold


def topics(summaries: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., ordinal, topic): `title: description` or the title; numbered from 1 before
    those without a title are left out. JSON that can't be read has none."""
    schema = "struct<topics: array<struct<title: string, description: string>>>"
    parsed = summaries.select(*keep, F.posexplode(F.from_json("summary_json", schema)["topics"]).alias("pos", "t"))
    text = F.when(F.coalesce(F.col("t.description"), F.lit("")) != "", F.concat(F.col("t.title"), F.lit(": "), F.col("t.description"))).otherwise(F.col("t.title"))
    return parsed.where(F.coalesce(F.col("t.title"), F.lit("")) != "").select(*keep, (F.col("pos") + 1).cast("long").alias("ordinal"), text.alias("topic"))


def repaired_scores(entries: DataFrame, scores: Column, pos: str) -> DataFrame:
    """Entries with the score at their place in a list (from 0): missing ones are 0, those
    beyond the entries are left out; between 0 and 1."""
    at = F.try_element_at(scores, (F.col(pos) + 1).cast("int"))
    return entries.withColumn("score", clamp(F.coalesce(at, F.lit(0.0))))


def relevance_funnel(scored: DataFrame, group: list[str], k: int = 5, least: float = 0.4) -> DataFrame:
    """scored: group, entry_id, parent_id, level (1 to 3), score. Entries are kept under a
    parent that qualifies on the level above; level 1 all."""
    one, two, three = (scored.where(F.col("level") == n) for n in (1, 2, 3))
    up = lambda rows: top_k_or_threshold(rows, group, "score", "entry_id", k, least).select(*group, F.col("entry_id").alias("parent_id"))
    two = two.join(up(one), [*group, "parent_id"], "left_semi").select(scored.columns)
    three = three.join(up(two), [*group, "parent_id"], "left_semi").select(scored.columns)
    return one.unionByName(two).unionByName(three)


def extraction_status(chapters: DataFrame, book: str, status: str) -> DataFrame:
    """(book, extracted, total, pipeline_status): fully or partially extracted."""
    done = F.count_if(F.col(status) == "extracted")
    return chapters.groupBy(book).agg(done.alias("extracted"), F.count(F.lit(1)).alias("total")).withColumn("pipeline_status", F.when(F.col("extracted") == F.col("total"), "fully_extracted").otherwise("partially_extracted"))


def progress(done: Column, total: Column) -> Column:
    return F.round(0.3 + 0.5 * done / F.greatest(total, F.lit(1)), 2)
