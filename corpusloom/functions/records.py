"""Expressions on records: typed descriptions, prompts, payloads and landed parser output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import parse_json
from corpusloom.operators.islands import ordered_concat

# Media types by suffix, and the formats that a reader is there for.
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}
READERS = ("txt", "md", "docx", "pptx")
#: JSON of a description as a model returns it.
DESCRIPTION = "summary string, key_concepts array<struct<name: string, aliases: array<string>, classification: string, description: string>>"


def typed_description(c: Column) -> Column:
    """A description from JSON: concepts without a name go, and a classification that is
    neither EXPLAINS nor USES is USES; null if the text isn't an object."""
    d = parse_json(c, DESCRIPTION)
    kind = lambda x: F.when(F.upper(x["classification"]).isin("EXPLAINS", "USES"), F.upper(x["classification"])).otherwise("USES")
    concept = lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["aliases"], F.array().cast("array<string>")).alias("aliases"), kind(x).alias("classification"), F.coalesce(x["description"], F.lit("")).alias("description"))
    return F.when(d.isNotNull(), F.struct(F.coalesce(d["summary"], F.lit("")).alias("summary"), F.transform(F.filter(F.coalesce(d["key_concepts"], F.array().cast("array<struct<name: string, aliases: array<string>, classification: string, description: string>>")), lambda x: F.coalesce(x["name"], F.lit("")) != ""), concept).alias("key_concepts")))


def fill(template: str, **values: Column) -> Column:
    """A prompt: each {name} of the template replaced by its column; null is empty."""
    parts, rest = [], template
    while rest:
        at = min((i for i in (rest.find("{" + k + "}") for k in values) if i >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = rest[at + 1 : rest.index("}", at)]
        parts += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit(""))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def distinct_in_order(a: Column) -> Column:
    """Strings of an array, each once, at its first place; nulls and blank ones go."""
    return F.array_distinct(F.filter(a, lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))


def data_url(content: Column, suffix: Column) -> Column:
    """Bytes as a base64 url of their suffix's media type; unknown suffixes are PNG."""
    kinds = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.concat(F.lit("data:"), F.coalesce(F.try_element_at(kinds, F.lower(suffix)), F.lit("image/png")), F.lit(";base64,"), F.base64(content))


def reader_for(path: Column) -> Column:
    """The reader of a file by its lower-cased suffix; PDF and unknown ones have none (null)."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix.isin(*READERS), suffix)


def require_reader(path: Column) -> Column:
    """As reader_for, but a file without a reader fails the job."""
    return F.coalesce(reader_for(path), F.raise_error(F.concat(F.lit("no reader for "), path)))


def bookmarks(rows: DataFrame, key: list[str], json: str) -> DataFrame:
    """(key..., pos, level, title, page) from landed outlines: JSON arrays of [level, title,
    page]; blank titles stay, entries that aren't of that form go."""
    items = F.from_json(F.col(json), "array<array<string>>")
    out = rows.select(*key, F.posexplode(items).alias("pos", "x")).where(F.size("x") == 3)
    return out.select(*key, F.col("pos").cast("long").alias("pos"), F.col("x")[0].try_cast("long").alias("level"), F.col("x")[1].alias("title"), F.col("x")[2].try_cast("long").alias("page")).where("level IS NOT NULL AND page IS NOT NULL")


def pages_text(pages: DataFrame, group: list[str], page: str, text: str, first: Column, last: Column, sep: str = "\n") -> DataFrame:
    """(group..., text): landed page texts from first to last, in order of pages."""
    return pages.where(F.col(page).between(first, last)).groupBy(*group).agg(ordered_concat(text, [page], sep).alias("text"))


def page_cache(pages: DataFrame, group: list[str], page: str, text: str) -> DataFrame:
    """(group..., cache): a JSON object of page texts, numbers as strings, in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(page).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("v"))))
    return pages.groupBy(*group).agg(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["k"].cast("string").alias("k"), e["v"].alias("v"))))).alias("cache"))
