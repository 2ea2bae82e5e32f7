"""Approximate nearest neighbours: a forest of random-projection trees.

The trees are fitted on a bounded sample; every row lies in one leaf of each tree. A query
walks all trees through one shared priority queue, nearest cells first, until the leaves it
has reached should hold a share of all rows, and never enters a cell whose planes prove that
nothing in it can be among its k nearest. Rows and queries meet by leaf: a row travels to its
leaf of each tree, if any query has reached that, a query to each leaf it has reached. There,
rows are ranked exactly, and only the best k of a leaf leave it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

#: Rows the trees are fitted on, chosen by a hash of the id, and those of them that bound the
#: distance of a query's k-th nearest.
SAMPLE_ROWS, BOUND_ROWS = 20_000, 1024
TREES = 8
#: A leaf should hold a LEAVES-th of all rows, within these limits; what the sample can tell
#: apart (4 of its rows a leaf) limits the depth as well.
LEAVES, LEAF_ROWS = 128, (8, 256)
#: Share of all rows that the leaves of one query should hold, trees together (a row counts
#: once a tree). Vectors without structure need as large a share of a large table as of a
#: small one: see the README's table of recall.
SEARCH_SHARE = 0.96
#: Rows and queries that meet in one group; larger leaves are dealt out to several.
ROW_BLOCK, QUERY_BLOCK = 16_384, 4096
#: Components of differences that are held at once; at least those of one query in a group.
COMPARED = 1 << 20
#: Lengths of vectors that have a forest of their own, the commonest ones; vectors of other
#: lengths are compared exactly with all of their length.
MOST_LENGTHS = 16


@dataclass
class Forest:
    depth: int
    normals: np.ndarray  # trees x inner nodes x dimensions
    cuts: np.ndarray  # trees x inner nodes
    rows: np.ndarray  # trees x leaves: rows expected
    some: np.ndarray  # rows of the table that bound distances


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def fit(rows: DataFrame, n: int, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, leaf_rows: int | None = None, seed: int = 42) -> Forest:
    """rows: id, vec (usable, one length), n of them."""
    leaf_rows = leaf_rows or min(max(n // LEAVES, LEAF_ROWS[0]), LEAF_ROWS[1])
    pick = rows if n <= sample_rows else rows.where(F.pmod(F.xxhash64(F.lit("ann"), "id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    x = np.array([r[0] for r in pick.select("vec").collect()], np.float64)
    dim = x.shape[1] if len(x) else 1
    depth = max(0, min(int(np.ceil(np.log2(max(1, n / leaf_rows)))), int(np.log2(max(1, len(x) / 4)))))
    rng = np.random.default_rng(seed)
    normals = np.zeros((trees, (1 << depth) - 1, dim))
    cuts = np.zeros((trees, (1 << depth) - 1))
    counts = np.zeros((trees, 1 << depth))
    for t in range(trees):
        parts = [np.arange(len(x))]
        for level in range(depth):
            after = []
            for k, part in enumerate(parts):
                node = (1 << level) - 1 + k
                w, cut = _plane(x[part], rng)
                normals[t, node], cuts[t, node] = w, cut
                side = x[part] @ w
                after += [part[side <= cuts[t, node]], part[side > cuts[t, node]]]
            parts = after
        counts[t] = [len(p) for p in parts]
    return Forest(depth, normals, cuts, counts * (n / max(1, len(x))), x[rng.permutation(len(x))[:BOUND_ROWS]])


def _plane(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A random plane that follows the data: normal to the line through the centres of two
    groups grown from two random points, halfway between them; if that leaves one side with
    under a tenth, at the median. Equal points get a random direction."""
    w = np.zeros(x.shape[1])
    if len(x) > 1:
        some = x[rng.choice(len(x), min(len(x), 400), replace=False)]
        a, b = some[0], some[1]
        for _ in range(6):
            near_a = ((some - a) ** 2).sum(axis=1) < ((some - b) ** 2).sum(axis=1)
            if near_a.all() or not near_a.any():
                break
            a, b = some[near_a].mean(axis=0), some[~near_a].mean(axis=0)
        w = a - b
    if not w.any():
        w = rng.normal(size=x.shape[1])
        w /= np.linalg.norm(w)
        return w, float(np.median(x @ w)) if len(x) else 0.0
    w = w / np.linalg.norm(w)
    side, cut = x @ w, float((a + b) @ w / 2)
    if not 0.1 <= (side > cut).mean() <= 0.9:
        cut = float(np.median(side))
    return w, cut


def leaves(forest: Forest, x: np.ndarray) -> np.ndarray:
    """rows x trees: the leaf of each row in each tree."""
    trees = len(forest.normals)
    node = np.zeros((len(x), trees), np.int64)
    for _ in range(forest.depth):
        for t in range(trees):
            at = node[:, t]
            side = np.einsum("ij,ij->i", x, forest.normals[t, at]) > forest.cuts[t, at]
            node[:, t] = 2 * at + 1 + side
    return node - ((1 << forest.depth) - 1)


def probe(forest: Forest, x: np.ndarray, search_rows: float, k: int) -> np.ndarray:
    """trees x leaves: whether a query enters the leaf. Cells come in order of the sum of their
    squared margins; those beyond a plane farther than the k nearest reach are never entered."""
    trees, inner = forest.cuts.shape
    margin = np.einsum("tnd,d->tn", forest.normals, x) - forest.cuts if inner else np.zeros((trees, 0))
    reach = np.inf
    if len(forest.some) > k:
        # the k + 1 nearest of some rows, as one of them may be the query itself
        reach = float(np.sqrt(np.partition(((forest.some - x) ** 2).sum(axis=1), k)[k])) * (1 + 1e-9)
    queue = [(0.0, t, 0) for t in range(trees)]
    found, seen = np.zeros((trees, inner + 1), bool), 0.0
    while queue and seen < search_rows:
        cost, t, node = heapq.heappop(queue)
        while node < inner:
            m = margin[t, node]
            if abs(m) <= reach:
                heapq.heappush(queue, (cost + m * m, t, 2 * node + (1 if m > 0 else 2)))
            node = 2 * node + (2 if m > 0 else 1)
        found[t, node - inner] = True
        seen += forest.rows[t, node - inner]
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Arrow lists of floats or doubles, all of one length, as rows of doubles."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, search_share: float = SEARCH_SHARE, trees: int = TREES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id_col>, score): for each query its k nearest rows by Euclidean
    distance in double precision, itself left out; ties go to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part,
    nor do null ids. Vectors of different lengths are never near each other; there may be any
    number of lengths. A search_share of `trees` or more is exact. Of rows with one vector only
    the k + 1 smallest ids can be among k nearest, so only those are indexed; repeated rows and
    repeated queries count once. An id with several vectors, of a query or a row, is as near as
    the nearest of them. Fewer rows give fewer neighbours, empty tables none. Other columns
    aren't read, so their names can't clash.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    # floats travel as such and become doubles where they are compared
    vec = "array<float>" if {t.schema[vec_col].dataType.simpleString() for t in (rows, queries)} == {"array<float>"} else "array<double>"
    whole = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast(vec).alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast(vec).alias("vec")).where(F.col("query_id").isNotNull() & usable(F.col("vec")))
    asked = asked.dropDuplicates(["query_id", "vec"])
    size = F.size("vec")
    lengths = whole.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(MOST_LENGTHS + 1).collect()
    if not lengths:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    own = [r["d"] for r in lengths[:MOST_LENGTHS]]
    found = [_by_forest(whole.where(size == d), asked.where(size == d), k, search_share, trees, kind) for d in own]
    if len(lengths) > MOST_LENGTHS:
        rest = materialize(_indexed(whole.where(~size.isin(own)), k).select(size.alias("cell"), "id", "vec"), "vectors")
        found.append(_meet(rest, asked.where(~size.isin(own)).select(size.alias("cell"), "query_id", "vec"), k, kind))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    once = reduce(DataFrame.unionByName, found).groupBy("query_id", "id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def _indexed(rows: DataFrame, k: int) -> DataFrame:
    """Of each vector, the k + 1 smallest ids."""
    return rows.dropDuplicates(["vec", "id"]).withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1).drop("n")


def _by_forest(whole: DataFrame, asked: DataFrame, k: int, search_share: float, trees: int, kind: str) -> DataFrame:
    """(query_id, id, score): for vectors of one length, the k nearest in each leaf reached."""
    kept = materialize(_indexed(whole, k), "vectors")
    n, vec = kept.count(), whole.schema["vec"].dataType.simpleString()
    forest = whole.sparkSession.sparkContext.broadcast(fit(kept, n, trees))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            if b.num_rows:
                cell = leaves(f, _matrix(pa.chunked_array([b.column(1)]))) + np.arange(len(f.normals)) * (1 << f.depth)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(f.normals), pa.int32()), pa.array(cell.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, cells], names=["id", "vec", "cells"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for b in batches:
            if b.num_rows:
                cells = [np.flatnonzero(probe(f, v, search_share * n, k)).astype(np.int32) for v in _matrix(pa.chunked_array([b.column(1)]))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=["query_id", "vec", "cells"])

    placed = kept.mapInArrow(place, f"id {kind}, vec {vec}, cells array<int>").select(F.explode("cells").alias("cell"), "id", "vec")
    # a walk takes milliseconds and a query few bytes, so tasks go by queries, not by bytes
    tasks = max(whole.sparkSession.sparkContext.defaultParallelism, -(-asked.count() // QUERY_BLOCK))
    probes = materialize(asked.repartition(tasks, "query_id", "vec").mapInArrow(walk, f"query_id {kind}, vec {vec}, cells array<int>"), "probes")
    # sizes of at most trees x leaves cells
    return _meet(placed, probes.select(F.explode("cells").alias("cell"), "query_id", "vec"), k, kind, small=True)


def _meet(rows: DataFrame, asked: DataFrame, k: int, kind: str, small: bool = False) -> DataFrame:
    """(query_id, id, score): rows (cell, id, vec) meet the queries (cell, query_id, vec) of
    their cell, in groups of about ROW_BLOCK rows and QUERY_BLOCK queries; the k nearest of
    each group. Rows of cells without a query stay where they are. small: the cells are few
    enough to broadcast their sizes."""
    count = lambda t, block, name: t.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = count(rows, ROW_BLOCK, "blocks").join(count(asked, QUERY_BLOCK, "parts"), "cell")
    sizes = F.broadcast(materialize(sizes, "cells")) if small else materialize(sizes, "cells")

    def rank(some: pa.Table, ask: pa.Table) -> pa.Table:
        ids, qids = some.column("id").to_numpy(), ask.column("query_id").to_numpy()
        asking, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(ids) and len(qids):
            x, v, order = _matrix(some.column("vec")), _matrix(ask.column("vec")), np.unique(ids, return_inverse=True)[1]
            step = max(1, COMPARED // x.size)
            for i in range(0, len(v), step):
                score = np.sqrt(((x[None] - v[i : i + step, None]) ** 2).sum(axis=2))
                own = ids[None] == qids[i : i + step, None]
                score[own] = np.inf
                last = np.partition(score, k - 1, axis=1)[:, k - 1 : k] if len(ids) > k else np.inf
                q, at = np.nonzero((score <= last) & ~own)
                by = np.lexsort((order[at], score[q, at], q))
                q, at = q[by], at[by]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, at = q[best], at[best]
                asking.append(q + i)
                found.append(at)
                scores.append(score[q, at])
        return pa.table({"query_id": ask.column("query_id").take(pa.array(np.concatenate(asking))), "id": some.column("id").take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(scores))})

    deal = lambda key, most: F.pmod(F.xxhash64(key), F.col(most)).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    placed = rows.join(sizes, "cell").select("cell", deal("id", "blocks").alias("block"), every("parts").alias("part"), "id", "vec")
    dealt = asked.join(sizes, "cell").select("cell", every("blocks").alias("block"), deal("query_id", "parts").alias("part"), "query_id", "vec")
    return placed.groupBy("cell", "block", "part").cogroup(dealt.groupBy("cell", "block", "part")).applyInArrow(rank, f"query_id {kind}, id {kind}, score double")
