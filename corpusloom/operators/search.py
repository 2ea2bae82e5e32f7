"""Keyword search over documents, with aliases and snippets."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.tables import discard, written

# Names of concepts and other names for them.
CONCEPT_ALIASES = {
    "z-transform": ["z transform", "zt", "z-domain", "z domain"],
    "laplace transform": ["laplace", "s-domain", "s domain", "lt"],
    "fourier transform": ["fourier", "ft", "dft", "fft", "frequency domain"],
    "transfer function": ["tf", "h(s)", "h(z)", "g(s)", "g(z)"],
    "state space": ["state-space", "state space representation", "state variable"],
    "pid controller": ["pid", "proportional integral derivative"],
    "bode plot": ["bode diagram", "frequency response"],
    "nyquist": ["nyquist criterion", "nyquist plot", "nyquist stability"],
    "root locus": ["root-locus", "rl"],
}
#: Characters of keywords that one automaton is made of, about; more go in blocks.
BLOCK_CHARS = 4_000_000
_AUTOMATA: dict[str, tuple] = {}


def concept_aliases(spark: SparkSession) -> DataFrame:
    """(canonical, alias) of the known concepts."""
    return spark.createDataFrame([(c, a) for c, xs in CONCEPT_ALIASES.items() for a in xs], "canonical string, alias string")


def expand_keywords(keywords: DataFrame, aliases: DataFrame) -> DataFrame:
    """(keyword): lower-cased keywords, the aliases of those that are canonical names, and for
    those that are aliases the canonical name and its other aliases; each once.

    aliases: (canonical, alias).
    """
    kw = keywords.select(F.lower("keyword").alias("keyword"))
    al = aliases.select(F.lower("canonical").alias("canonical"), F.lower("alias").alias("alias"))
    names = al.select("canonical", F.col("alias").alias("name")).unionByName(al.select("canonical", F.col("canonical").alias("name")))
    hit = kw.join(names, kw["keyword"] == names["name"]).select("canonical").distinct()
    return kw.unionByName(names.join(hit, "canonical", "left_semi").select(F.col("name").alias("keyword"))).distinct()


def _automaton(shared: Broadcast) -> tuple:
    """An automaton over the keywords, made once a worker, and whether one is empty."""
    import ahocorasick

    name, keywords = shared.value
    if name not in _AUTOMATA:
        made = ahocorasick.Automaton()
        for k in keywords:
            if k:
                made.add_word(k, k)
        made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[name] = (made if len(made) else None, "" in keywords)
    return _AUTOMATA[name]


def _blocks(keywords: DataFrame) -> list[list[str]]:
    """The keywords, each once, in blocks of a bounded size."""
    rows = written(keywords.where("keyword IS NOT NULL").select("keyword").distinct(), "keywords")
    chars = rows.agg(F.sum(F.length("keyword") + 1)).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    part = F.pmod(F.xxhash64("keyword"), F.lit(blocks))
    found = [sorted(r["keyword"] for r in rows.where(part == i).collect()) for i in range(blocks)]
    discard(rows)
    return found


def _finder(shared: Broadcast, around: int) -> Callable[[Column, Column], Column]:
    item = pa.struct([("keyword", pa.string()), ("line", pa.int64()), ("snippet", pa.string())])

    @F.arrow_udf("array<struct<keyword: string, line: long, snippet: string>>")
    def find(texts: pa.Array, lows: pa.Array) -> pa.Array:
        (automaton, empty), found = _automaton(shared), []
        for t, low in zip(texts, lows, strict=True):
            low = low.as_py()
            if low is None:
                found.append([])
                continue
            first: dict[str, int] = {"": 0} if empty else {}
            for end, k in automaton.iter(low) if automaton else ():
                if k not in first:
                    first[k] = end - len(k) + 1
            hits, lines, at, n = [], None, 0, 1
            for k, place in sorted(first.items(), key=lambda x: (x[1], x[0])):
                n, at = n + low.count("\n", at, place), place
                lines = t.as_py().split("\n") if lines is None else lines
                hits.append({"keyword": k, "line": n, "snippet": None if "\n" in k else "\n".join(lines[max(n - 1 - around, 0) : n + around])})
            found.append(hits)
        return pa.array(found, pa.list_(item))

    return find


def keyword_lines(docs: DataFrame, keywords: DataFrame, text: str, around: int = 2) -> DataFrame:
    """docs x the keywords that they hold, ignoring case, word ends or not, with `line` (of the
    first hit, from 1) and `snippet` (that line with those around it; null if the keyword holds
    a line's end). Repeated keywords count once; an empty one is in every text.

    All keywords make one automaton, which reads a lower-cased text once, however many they
    are. Keywords are collected and sent in blocks of BLOCK_CHARS, each of which reads the
    texts again. Null texts hold nothing; columns `keyword`, `line` and `snippet` are replaced.
    """
    keep, out = [F.col(f"`{c}`") for c in docs.columns if c not in ("keyword", "line", "snippet")], None
    for block in _blocks(keywords):
        find = _finder(docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block)), around)
        rows = docs.select(*keep, find(F.col(text), F.lower(text)).alias("_hits")).select(*keep, F.explode("_hits").alias("_h")).select(*keep, "_h.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def keyword_hits(docs: DataFrame, keywords: DataFrame, text: str) -> DataFrame:
    """docs x keywords that they hold, as `keyword_lines` finds them. Only lower-cased texts
    go to Python and only keywords come back."""
    keep, out = [F.col(f"`{c}`") for c in docs.columns if c not in ("keyword", "line", "snippet")], None
    for block in _blocks(keywords):
        find = _names(docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, block)))
        rows = docs.select(*keep, F.explode(find(F.lower(text))).alias("keyword"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _names(shared: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf("array<string>")
    def find(lows: pa.Array) -> pa.Array:
        (automaton, empty), found = _automaton(shared), []
        for low in lows:
            low = low.as_py()
            names = {k for _, k in automaton.iter(low)} if automaton and low is not None else set()
            found.append(sorted(names | {""} if empty and low is not None else names))
        return pa.array(found, pa.list_(pa.string()))

    return find


def in_library(source: Column, library: str | None, math: str = "math_library") -> Column:
    """Sources of a library type: "math", "course" (all but math), or any."""
    return {"math": source == math, "course": source != math}.get(library or "", F.lit(True))


def snippet(text: Column, keyword: Column, around: int = 2) -> Column:
    """The first line that holds the keyword, with the lines around it; null if none does."""
    low = F.lower(text)
    at = F.position(keyword, low)
    above = F.substring(low, F.lit(1), at)  # up to the hit's first character
    line = F.length(above) - F.length(F.replace(above, F.lit("\n"), F.lit(""))) + 1
    start = F.greatest(line - around, F.lit(1))
    return F.when((at > 0) & ~F.contains(keyword, F.lit("\n")), F.array_join(F.slice(F.split(text, "\n"), start, line + around - start + 1), "\n"))


def matched_lines(text: Column, keyword: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.contains(F.lower(x), keyword))
