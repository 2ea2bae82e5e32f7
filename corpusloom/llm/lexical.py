"""Ranked lexical search with hashed max-sketches.

A first pass over the texts keeps, for each document, its number of terms and how often it
holds each term of the queries. A second pass, over these numbers only, gives document counts
of the terms and so all impacts (what one term adds to a document's score). Each document's
impacts fold into a sketch: coordinate h holds the largest impact of the document's terms that
hash to h. The sketch's values at a query's terms sum to an upper bound of its score, for a
block of documents and queries at once. Documents are scored exactly in descending order of
their bounds, until no bound reaches the k-th best score.

A query's threshold starts from the k-th best score of a share of the documents, which is
found in the same way; shares grow geometrically up to all of them. So what leaves the tasks
is a few dozen times k rows a query, whatever the corpus.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import discard, materialize, text_bytes

#: Coordinates of a sketch.
WIDTH = 512
#: Terms, and queries, of one block of queries, about; what is broadcast at once.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 4096
#: Documents that the first thresholds come from, and by how much more each next pass looks at.
FIRST_DOCS, GROWTH = 8192, 32
#: Documents sketched at once, and scored exactly at once, in a task.
BLOCK_DOCS, STEP = 1024, 64
#: Bytes of a text that are split into terms at once.
PART = 1 << 22
#: ASCII characters other than letters and digits become spaces, A-Z become a-z.
FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """All terms of a UTF-8 text in order, a list for each part; a part ends between terms."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PART)
        part = raw[at:end].translate(FOLD)
        cut = part.rfind(b" ") + 1
        if end < len(raw) and cut:
            part, end = part[:cut], at + cut
        while end < len(raw) and part[-1] != 32:  # one term longer than a part
            more = raw[end : end + PART].translate(FOLD)
            cut = more.find(b" ") + 1 or len(more)
            part, end = part + more[:cut], end + cut
        yield part.split()
        at = end


@dataclass
class Queries:
    """A block of queries: vocabulary (term: number) and each query's term numbers."""

    vocabulary: dict[bytes, int]
    items: list[np.ndarray]


@dataclass
class Weights:
    weight: np.ndarray  # int64, by term number
    documents: int  # with at least one term
    length: int  # terms of all documents


def weigh(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))), never negative as df is at most N."""
    return np.array([floor(1000 * log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def count_terms(docs: DataFrame, queries: Queries, id_col: str, text_col: str) -> DataFrame:
    """(key, n, terms, tfs): n terms in all, and the numbers and counts of those in the
    vocabulary. Documents without a term have no row."""
    shared = docs.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            rows, size, ids, tfs = [], [], [], []
            raw, off = text_bytes(b.column(1))
            for i in range(len(b)):
                n, found = 0, Counter()
                for part in terms(raw[off[i] : off[i + 1]].tobytes()):
                    n += len(part)
                    found.update(map(number, part))
                if n:
                    found.pop(None, None)
                    known = sorted(found)
                    rows.append(i)
                    size.append(n)
                    ids.append(np.array(known, np.int32))
                    tfs.append(np.array([found[t] for t in known], np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int32())), pa.array(size, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["key", "n", "terms", "tfs"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, n long, terms array<int>, tfs array<long>")


def document_counts(counted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term; at most `size` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(df[have])], names=["term", "n"])

    found = counted.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size, np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return df


def impacts(weights: Weights, n: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """What each (document, term) adds to a score; n by document, sizes its terms kept."""
    m = np.array([50 + 50 * x * weights.documents // weights.length for x in n.tolist()], np.int64)
    return weights.weight[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * np.repeat(m, sizes)))


def coordinate(ids: np.ndarray, width: int) -> np.ndarray:
    """A term number's coordinate, by multiplicative hashing."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % width


def sketches(n_docs: int, doc: np.ndarray, ids: np.ndarray, impact: np.ndarray, width: int) -> np.ndarray:
    """documents x width: the largest impact at each coordinate."""
    out = np.zeros((n_docs, width))
    np.maximum.at(out, (doc, coordinate(ids, width)), impact)
    return out


def lookups(items: list[np.ndarray], width: int) -> np.ndarray:
    """width x items: how many of the item's terms look at each coordinate."""
    return np.stack([np.bincount(coordinate(t, width), minlength=width) for t in items], axis=1).astype(np.float64)


@dataclass
class Best:
    """An item's best documents so far: (-score, id) ascending, k at most. `least` is a score
    that k documents are known to reach."""

    k: int
    least: int
    rows: list[tuple] = field(default_factory=list)

    def add(self, new: list[tuple]) -> None:
        self.rows = sorted(self.rows + new)[: self.k]
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])


def exact(keys: np.ndarray, impact: np.ndarray, size: int, docs: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Exact scores of some documents of a block for one item. keys: document * size + term,
    ascending, with the impact of each."""
    if not len(keys):
        return np.zeros(len(docs), np.int64)
    want = docs[:, None] * size + item[None]
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, impact[at], 0).sum(axis=1)


def candidates(counted: DataFrame, queries: Queries, weights: Weights, least: np.ndarray, k: int, width: int) -> DataFrame:
    """(item, score, key): for every task and item its documents with the k best scores of at
    least `least` (by item) and above 0; ties by key, nulls first."""
    size = len(queries.vocabulary)
    shared = counted.sparkSession.sparkContext.broadcast((queries.items, weights, least))
    integral = isinstance(counted.schema["key"].dataType, T.IntegralType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w, floor_ = shared.value
        look = lookups(items, width) if items else np.zeros((width, 0))
        best = [Best(k, max(1, int(x))) for x in floor_]
        kind = None
        for whole in batches:
            kind = whole.schema.field(0).type
            for s in range(0, len(whole), BLOCK_DOCS):
                b = whole.slice(s, BLOCK_DOCS)
                off = b.column(2).offsets.to_numpy()
                sizes = np.diff(off)
                ids, tfs = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(len(b)), sizes)
                impact = impacts(w, b.column(1).to_numpy(), sizes, ids, tfs)
                # doubles are exact below 2^53; above, the factor outweighs their rounding
                bounds = sketches(len(b), doc, ids, impact, width) @ look * (1 + 1e-9)
                keys = doc * size + ids
                names = b.column(0).to_pylist()
                for j in np.flatnonzero(bounds.max(axis=0) >= [x.least for x in best]):
                    order = np.flatnonzero(bounds[:, j] >= best[j].least)
                    order = order[np.argsort(-bounds[order, j], kind="stable")]
                    for at in range(0, len(order), STEP):
                        some = order[at : at + STEP]
                        if bounds[some[0], j] < best[j].least:
                            break
                        score = exact(keys, impact, size, some, items[j])
                        good = np.flatnonzero(score >= best[j].least)
                        best[j].add([(-int(score[i]), names[some[i]] is not None, names[some[i]]) for i in good])
        out = [(j, -r[0], r[2]) for j, x in enumerate(best) for r in x.rows]
        if out:
            item, score, key = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(key, kind)], names=["item", "score", "key"])

    kind = counted.schema["key"].dataType.simpleString()
    if not integral and not isinstance(counted.schema["key"].dataType, T.StringType):
        raise TypeError(f"ids must be integers or strings, not {kind}")
    return counted.mapInArrow(run, f"item int, score long, key {kind}")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, queries: Queries, k: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """(item, rank, key, score) for one block of queries; written to the shared folder."""
    counted = materialize(count_terms(docs, queries, id_col, text_col), "lexical")
    n, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = Weights(weigh(document_counts(counted, len(queries.vocabulary)), n), n, max(1, length))
    least, share = np.zeros(len(queries.items), np.int64), min(1.0, FIRST_DOCS / max(1, n))
    while True:
        some = counted if share >= 1 else counted.where(F.pmod(F.xxhash64(F.lit("lexical"), "key", "n", "terms"), F.lit(1 << 30)) < int(share * (1 << 30)))
        found = _top(candidates(some, queries, weights, least, k, width), k)
        if share >= 1:
            done = materialize(found, "lexical-ranks")
            discard(counted)
            return done
        for r in found.where(F.col("rank") == k).select("item", "score").collect():  # a row a query
            least[r["item"]] = max(least[r["item"]], r["score"])
        share = min(1.0, share * GROWTH)


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", width: int = WIDTH) -> DataFrame:
    """(item id, rank, document id, score): each item's k best documents with a score above 0.

    Terms are the maximal runs of ASCII letters and digits and of characters over 127, A-Z
    lower-cased. A term weighs floor(1000 ln((2N + 2) / (2 df + 1))) and adds that times
    1e9 tf div (1000 tf + 20 m), with m = 50 + 50 n N div L, once an item. N documents have a
    term, L are all their terms, n a document's, df the documents with the term, tf its
    occurrences in the document. Equal scores rank by ascending id, null ids first.

    Null and empty texts hold no terms. Every row is a document, and an item, of its own, so
    repeated rows rank one by one, and repeated or null item ids each get their ranks.
    Items without a term, or without a match, and empty tables give no rows. Texts of any
    length are read whole, a part at a time. Other columns aren't read, so their names can't
    clash. Ids of documents are integers or strings. Items go in blocks of about BLOCK_TERMS
    terms and BLOCK_ITEMS items (more only where a single item has more); each block reads the
    documents again.
    """
    spark = docs.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(1))
            found = [sorted({t for part in terms(raw[off[i] : off[i + 1]].tobytes()) for t in part}) for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    numbered = items.select(F.col(item_col).alias("id"), F.col("text").cast("string").cast("binary").alias("text")).withColumn("item", F.monotonically_increasing_id())
    asked = materialize(numbered, "lexical-items")
    words = materialize(asked.select("item", "text").mapInArrow(split, "item long, terms array<binary>"), "lexical-terms")
    n, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK_TERMS), -(-n // BLOCK_ITEMS))
    out = None
    for b in range(blocks):
        rows = words.where((F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) & (F.size("terms") > 0)).orderBy("item").collect()  # a block's terms
        vocabulary: dict[bytes, int] = {}
        lists = [np.array(sorted(vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]), np.int64) for r in rows]
        numbers = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], "item int, number long")
        found = search_block(docs, Queries(vocabulary, lists), k, id_col, text_col, width).join(F.broadcast(numbers), "item")
        out = found if out is None else out.unionByName(found)
    named = out.join(asked.select("id", F.col("item").alias("number")), "number")
    return named.select(F.col("id").alias(item_col), "rank", F.col("key").alias(id_col), "score")
