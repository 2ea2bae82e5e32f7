"""URL filters: rules first, then segmented words scored by naive Bayes.

Host labels and path tokens are split into words by a unigram Viterbi search over the counts
of all words in the visible text of all pages; a multinomial naive Bayes model, counted over
the tokens of all urls that a rule decides, judges the rest. Word counts are a count-min
sketch, tokens are hashed: both are of a fixed size whatever the corpus, so they can be
broadcast, and no word or token is left out, however long. Each task splits a repeated name
once. Pages are read from left to right once, whatever tags they leave open.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the word counts, in each of ROWS rows; the estimate is the least of a word's
#: buckets, never under its count, and over it by 2.8 / WORD_BUCKETS of all words with a chance
#: of 0.14 at most. Buckets of the tokens.
WORD_BUCKETS, ROWS, TOKEN_BUCKETS = 1 << 21, 2, 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without a ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(rules: list[tuple[str, str]]) -> dict[str, list[tuple[int, str, str, str]]]:
    """Rules by host: (length, rule, verdict, path), the longest first."""
    table: dict[str, list] = {}
    for what, rule in rules:
        host, slash, path = rule.partition("/")
        table.setdefault(host, []).append((len(rule), rule, what, slash + path))
    return {h: sorted(set(rs), reverse=True) for h, rs in table.items()}


def find_rule(table: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule that fits, found by the host and the names above it."""
    best, at = None, 0
    while at >= 0:
        for r in table.get(host[at:], ()):
            if path.startswith(r[3]):
                best = max(best or r, r)
                break
        at = host.find(".", at) + 1 or -1
    return (best[1], best[2]) if best else (None, None)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else of nulls. rules: (verdict, host
    and path as one string), any number; a rule fits its host and all subdomains where the path
    starts with the rule's."""
    table = rule_table(rules)

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([find_rule(table, h, p) for h, p in zip(hosts, paths, strict=True)], columns=["rule", "verdict"], dtype=object)

    return judge(host, path)


def word_buckets(word: str) -> list[int]:
    """The word's place in each row of the sketch."""
    h = xxhash.xxh3_64_intdigest(word)
    return [row * WORD_BUCKETS + ((h >> (32 * row)) & 0xFFFFFFFF) % WORD_BUCKETS for row in range(ROWS)]


@dataclass
class Lexicon:
    """Log-probabilities of words; a character that no word covers costs as much as a rare
    word, so it wins only where no words fit."""

    counts: np.ndarray  # the sketch, rows one after the other
    total: int
    lengths: tuple[int, ...] = ()  # of the words that occur, the longest first
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict)
    costs: dict[str, float | None] = field(default_factory=dict)

    @property
    def unknown(self) -> float:
        return math.log(0.1 / max(1, self.total))

    def cost(self, word: str) -> float | None:
        """Of a word of two letters or more that occurs; null of any other."""
        if word not in self.costs:
            n = int(min(self.counts[b] for b in word_buckets(word))) if len(word) > 1 else 0
            self.costs[word] = math.log(n / self.total) - 0.1 if n else None
        return self.costs[word]

    def split(self, name: str) -> tuple[str, ...]:
        """The likeliest words of a name; ties go to the longer last word. Runs of characters
        outside all words come out as one piece."""
        if name in self.memo:
            return self.memo[name]
        n = len(name)
        best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for size in (*self.lengths, 1):
                i = j - size
                if i < 0:
                    continue
                c = self.unknown if size == 1 else self.cost(name[i:j])
                if c is not None and best[i] + c > best[j]:
                    best[j], back[j] = best[i] + c, i
        words, j = [], n
        while j:
            i = back[j]
            known = self.cost(name[i:j]) is not None
            if words and not known and not words[-1][1]:
                words[-1] = (name[i:j] + words[-1][0], False)
            else:
                words.append((name[i:j], known))
            j = i
        if len(self.costs) > 500_000:
            self.memo.clear()
            self.costs.clear()
        self.memo[name] = tuple(w for w, _ in reversed(words))
        return self.memo[name]


_ENDS = re.compile(r"(?i)</(script|style)\s*>")
_STARTS = re.compile(r"(?i)<(script|style)\b")
_WORD = re.compile(r"[^\W\d_]{2,}")


def visible_text(page: str) -> str:
    """The page with a space for each tag, and for each script or style with all that is in it.
    A `<` that no `>` follows is text; a script without an end is a tag, its content text."""
    ends: dict[str, list[tuple[int, int]]] = {"script": [], "style": []}
    for m in _ENDS.finditer(page):
        ends[m[1].lower()].append(m.span())
    for spans in ends.values():
        spans.reverse()  # the next one is the last of the list
    out, at, last = [], 0, page.rfind(">")
    while 0 <= (start := page.find("<", at)) < last:
        out.append(page[at:start])
        at = 0
        if m := _STARTS.match(page, start):
            spans = ends[m[1].lower()]
            while spans and spans[-1][0] < m.end():
                spans.pop()
            at = spans[-1][1] if spans else 0
        at = at or page.find(">", start) + 1
    return " ".join([*out, page[at:]])


def page_words(page: str) -> list[str]:
    """Words of a page's visible text: runs of two or more letters, in lower case."""
    return _WORD.findall(html.unescape(visible_text(page)).lower())


def fit_lexicon(pages: DataFrame, html_col: str = "html") -> Lexicon:
    """Counts of all words in the visible text of all pages, and the lengths that occur. At most
    ROWS * WORD_BUCKETS rows and one a length reach the driver; a page has no more lengths
    than the root of twice its characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, lengths = np.zeros(ROWS * WORD_BUCKETS, np.int64), Counter(), set()

        def add() -> None:
            for w, n in seen.items():
                counts[word_buckets(w)] += n
                lengths.add(len(w))
            seen.clear()

        for b in batches:
            for page in b.column(0):
                seen.update(page_words(page.as_py() or ""))
                if len(seen) > 100_000:
                    add()
        add()
        at = np.flatnonzero(counts)
        for s in range(0, len(at), 100_000):
            w = at[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(counts[w])], names=["bucket", "n"])
        if lengths:  # under zero, beside the buckets
            yield pa.RecordBatch.from_arrays([pa.array([-n for n in lengths], pa.int32()), pa.array([1] * len(lengths), pa.int64())], names=["bucket", "n"])

    sums = pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(ROWS * WORD_BUCKETS, np.int64)
    at, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    counts[at[at >= 0]] = n[at >= 0]
    return Lexicon(np.minimum(counts, 0xFFFFFFFF).astype(np.uint32), int(counts[:WORD_BUCKETS].sum()), tuple(int(-b) for b in np.sort(at[at < 0])))


_TOKEN = re.compile(r"[^\W_]+")


def tokens(lexicon: Lexicon, host: str, path: str) -> list[str]:
    """Words of host and path, marked by where they stand; runs of digits are one token."""
    out = []
    for mark, text in (("h:", host), ("p:", path.lower())):
        for piece in _TOKEN.findall(text):
            if piece.isdigit():
                out.append(mark + "0")
            else:
                out += [mark + w for w in lexicon.split(piece)]
    return out


def token_buckets(lexicon: Lexicon, host: str, path: str) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) % TOKEN_BUCKETS for t in tokens(lexicon, host, path)], np.int64)


@dataclass
class Judge:
    weight: np.ndarray  # log-odds for blocking, float32 by bucket of tokens
    prior: float

    def score(self, lexicon: Lexicon, host: str, path: str) -> float:
        return self.prior + float(self.weight[token_buckets(lexicon, host, path)].sum(dtype=np.float64))


def fit_judge(urls: DataFrame, shared: Broadcast, seeds: dict[str, int] | None = None) -> Judge:
    """urls: host, path, verdict (of a rule); shared: the lexicon, broadcast. Tokens of all of them are counted by bucket;
    buckets without any are no evidence. seeds: words that speak for blocking before any url is
    seen, and how often each counts. Without labelled urls the seeds alone speak."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, TOKEN_BUCKETS + 1), np.int64)  # block, allow; the last counts urls
        for b in batches:
            for (h, p, v), n in Counter(zip(*(c.to_pylist() for c in b.columns), strict=True)).items():
                row = seen[0 if v == "block" else 1]
                row[TOKEN_BUCKETS] += n
                np.add.at(row, token_buckets(shared.value, h, p), n)
        at = np.flatnonzero(seen.any(axis=0))
        for s in range(0, len(at), 100_000):
            w = at[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(seen[0, w]), pa.array(seen[1, w])], names=["bucket", "block", "allow"])

    # at most TOKEN_BUCKETS rows
    sums = urls.select("host", "path", "verdict").mapInArrow(count, "bucket int, block long, allow long").groupBy("bucket").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).toArrow()
    have = np.zeros((2, TOKEN_BUCKETS + 1), np.float64)
    have[0, sums.column("bucket").to_numpy()] = sums.column("block").to_numpy()
    have[1, sums.column("bucket").to_numpy()] = sums.column("allow").to_numpy()
    docs, have = have[:, -1], have[:, :-1].copy()
    for word, n in (seeds or {}).items():
        for mark in ("h:", "p:"):
            have[0, xxhash.xxh3_64_intdigest(mark + word) % TOKEN_BUCKETS] += n
    known = have.any(axis=0)
    block, allow = have + 0.5 * known
    odds = np.zeros(TOKEN_BUCKETS)
    odds[known] = np.log(block[known] / block.sum()) - np.log(allow[known] / allow.sum())
    return Judge(odds.astype(np.float32), math.log((docs[0] + 1) / (docs[1] + 1)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", html_col: str = "html", seeds: dict[str, int] | None = None) -> DataFrame:
    """pages plus host, path, rule, verdict and score (the model's log-odds for blocking;
    null where a rule decides). Columns of those names are replaced.

    Null urls and ones without :// have empty host and path, and are judged by the model's
    prior. Ties (odds of exactly 0) allow. Repeated rows stay. Null and empty pages have no
    words; very long ones are read whole. An empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    named = pages.withColumns({"_h": host, "_p": path}).withColumn("_d", rule_for(F.col("_h"), F.col("_p"), rules)).withColumns({"_r": F.col("_d.rule"), "_v": F.col("_d.verdict")})
    spark = pages.sparkSession
    words = spark.sparkContext.broadcast(fit_lexicon(pages, html_col))
    judge = fit_judge(named.where("_v IS NOT NULL").select(F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_v").alias("verdict")), words, seeds)
    shared = spark.sparkContext.broadcast(judge)

    @F.pandas_udf("double")
    def odds(hosts, paths, verdicts):
        memo: dict[tuple[str, str], float] = {}
        out = []
        for h, p, v in zip(hosts, paths, verdicts, strict=True):
            if v is not None:
                out.append(None)
                continue
            if (h, p) not in memo:
                memo[h, p] = shared.value.score(words.value, h, p)
            out.append(memo[h, p])
        return pd.Series(out, dtype="float64")

    scored = named.withColumn("_s", odds("_h", "_p", "_v"))
    chosen = F.coalesce("_v", F.when(F.col("_s") > 0, "block").otherwise("allow"))
    return scored.select(*keep, F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_r").alias("rule"), chosen.alias("verdict"), F.when(F.col("_v").isNull(), F.col("_s")).alias("score"))
