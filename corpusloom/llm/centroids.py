"""Exact centroid clustering, with a vantage-point tree over the centroids.

Vectors become integers, so that sums, distances and ties are exact and don't depend on how
rows are dealt. Each round builds a tree over the centroids and broadcasts it (both have a
size set by k and the number of components); every vector is searched for best-first, with
branch and bound. The tasks add up their vectors by cluster and component, and only these
k x components sums reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

#: Centroids in a leaf of the tree, at most.
LEAF = 4
#: Vectors searched for at once in a task.
BLOCK = 2048
_FAR = np.iinfo(np.int64).max


@dataclass
class Tree:
    """Node i has the centroids members[i] (an inner node one, its vantage point) and the
    children `child[i]`, whose centroids are between low[i] and high[i] away from that."""

    centroids: np.ndarray
    members: list[np.ndarray]
    child: np.ndarray  # nodes x 2, -1 in leaves
    low: np.ndarray  # nodes x 2
    high: np.ndarray


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all x to all c, both int64."""
    d = x[:, None, :] - c[None]
    return np.einsum("ijk,ijk->ij", d, d)


def build(centroids: np.ndarray, leaf: int = LEAF) -> Tree:
    """A balanced tree: the vantage point of a node is the one of its centroids that is
    farthest from the first; the nearer half of the others is one child, the rest the other."""
    members, child, low, high = [], [], [], []
    todo = [(np.arange(len(centroids)), -1, 0)]
    while todo:
        have, parent, side = todo.pop()
        node = len(members)
        if parent >= 0:
            child[parent][side] = node
        child.append([-1, -1])
        low.append([0.0, 0.0])
        high.append([0.0, 0.0])
        if len(have) <= max(2, leaf):  # two or more others make two children
            members.append(have)
            continue
        vantage = have[int(squared(centroids[have[:1]], centroids[have])[0].argmax())]
        rest = have[have != vantage]
        away = squared(centroids[[vantage]], centroids[rest])[0]
        order = np.argsort(away, kind="stable")
        rest, away = rest[order], np.sqrt(away[order].astype(np.float64))
        half = len(rest) // 2
        members.append(np.array([vantage]))
        low[node], high[node] = [away[0], away[half]], [away[half - 1], away[-1]]
        todo += [(np.sort(rest[half:]), node, 1), (np.sort(rest[:half]), node, 0)]
    return Tree(centroids, members, np.array(child, np.int32).reshape(-1, 2), np.array(low).reshape(-1, 2), np.array(high).reshape(-1, 2))


def search(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, exact squared distance) of each row of x; of
    centroids equally near the one with the smallest number.

    Every vector has its own queue of nodes, ordered by the least distance that the triangle
    inequality leaves; a step takes the first node of each queue, and vectors that are at the
    same node are compared together. A vector is done when its first node is farther than the
    best centroid so far; at the same distance the node is still entered, for ties. Bounds are
    in doubles, widened by more than their rounding, and leaf distances are integers.
    """
    n = len(x)
    best, who = np.full(n, _FAR), np.full(n, len(tree.centroids))
    queue = np.full((n, len(tree.members)), np.inf)
    queue[:, 0] = 0
    live = np.arange(n)
    while len(live):
        node = queue[live].argmin(axis=1)
        bound = queue[live, node]
        go = (bound < np.inf) & (bound <= np.sqrt(best[live].astype(np.float64)) * (1 + 1e-12))
        live, node, bound = live[go], node[go], bound[go]
        queue[live, node] = np.inf
        for u in np.unique(node):
            at = np.flatnonzero(node == u)
            rows, have = live[at], tree.members[u]
            d = squared(x[rows], tree.centroids[have])
            first = d.argmin(axis=1)  # members are in ascending order
            near, number = d[np.arange(len(rows)), first], have[first]
            better = (near < best[rows]) | (near == best[rows]) & (number < who[rows])
            best[rows[better]], who[rows[better]] = near[better], number[better]
            if tree.child[u, 0] >= 0:
                away = np.sqrt(d[:, 0].astype(np.float64))
                for side in (0, 1):
                    lo, hi = tree.low[u, side], tree.high[u, side]
                    least = np.maximum(away - hi, lo - away) - 1e-9 * (away + hi + 1)
                    queue[rows, tree.child[u, side]] = np.maximum(least, bound[at])
    return who, best


def largest_component(dims: int) -> int:
    """Integer components up to this keep every squared distance of two vectors in a long."""
    return isqrt(((1 << 63) - 1) // max(1, dims)) // 2


def integer_vectors(vec: Column, dims: int, scale: int) -> tuple[Column, Column]:
    """(whether the vector takes part, floor(scale * component) of each component)."""
    wide = lambda x: x.cast("double") * F.lit(float(scale))
    fits = lambda x: F.coalesce(~F.isnan(wide(x)) & (F.abs(wide(x)) <= F.lit(float(largest_component(dims)))), F.lit(False))
    return F.coalesce((F.size(vec) == dims) & F.forall(vec, fits), F.lit(False)), F.transform(vec, lambda x: F.floor(wide(x)))


def start(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k points with the smallest sha256 of `seed:id` (a null id is empty), in that
    order, ties by components."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    first = points.select(F.sha2(text.cast("binary"), 256).alias("h"), "_x").orderBy("h", "_x").limit(k).collect()  # k rows
    return np.array([r["_x"] for r in first], np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def sums(points: DataFrame, tree: Tree) -> dict[tuple[int, int], tuple[int, int]]:
    """(count, sum) by cluster and component: at most centroids x components rows."""
    spark, (k, dims) = points.sparkSession, tree.centroids.shape
    shared = spark.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            x = _matrix(b.column(0), dims)
            for s in range(0, len(x), BLOCK):
                part = x[s : s + BLOCK]
                who, _ = search(shared.value, part)
                by = np.argsort(who, kind="stable")
                found, first = np.unique(who[by], return_index=True)
                n += np.bincount(who, minlength=k)
                total[found] += np.add.reduceat(part[by], first, axis=0)
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(have, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(have))), pa.array(np.repeat(n[have], dims)), pa.array(total[have].ravel())],
            names=["c", "i", "n", "s"],
        )

    part = points.select("_x").mapInArrow(run, "c int, i int, n long, s long")
    rows = part.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    shared.destroy()
    return {(r["c"], r["i"]): (r["n"], int(r["s"])) for r in rows}


def assign(points: DataFrame, tree: Tree) -> DataFrame:
    """(_id, cluster, distance) of every point."""
    dims, shared = tree.centroids.shape[1], points.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims)
            for s in range(0, len(x), BLOCK):
                who, best = search(shared.value, x[s : s + BLOCK])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, len(who)), pa.array(who.astype(np.int32)), pa.array(best)], names=["_id", "cluster", "distance"])

    return points.mapInArrow(run, f"_id {points.schema['_id'].dataType.simpleString()}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256), one row a
    vector that takes part.

    Vectors with exactly `dims` components, none null, NaN or infinite, take part, each
    component as floor(scale * x); so large ones that a squared distance might not fit a long
    (`largest_component`: about 740,000 for 64 components and a scale of 256) take none.
    Centroids start as the k vectors whose `seed:id` hashes smallest; each of `rounds` rounds
    assigns all vectors and moves centroids to the floor of their vectors' mean; empty ones
    stay. Then all are assigned once more. Ties go to the smaller number.

    Repeated rows and ids count as often as they come and null ids stay; with fewer vectors
    than k there are fewer centroids. Sums of distances beyond a long are null. No vectors, no
    rows. Other columns aren't read, so their names can't clash.
    """
    spark = rows.sparkSession
    takes, ints = integer_vectors(F.col(vec_col), dims, scale)
    kind = "int" if largest_component(dims) < 1 << 31 else "long"
    points = materialize(rows.where(takes).select(F.col(id_col).alias("_id"), ints.cast(f"array<{kind}>").alias("_x")), "centroid-points")
    centroids = start(points, k, seed).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = centroids.copy()
        for (c, i), (n, s) in sums(points, build(centroids)).items():
            centroids[c, i] = s // n
    done = points.select("_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    if len(centroids):
        done = materialize(assign(points, build(centroids)), "centroid-members")
    held = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    long = lambda x: x if x < 1 << 63 else None
    inertia = long(sum(held.values()))
    facts = [(c, long(held[c]), inertia, [int(x) for x in centroids[c]], digest(centroids[c])) for c in sorted(held)]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
