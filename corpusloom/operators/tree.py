"""Trees and layers of graphs kept as parent pointers.

Paths to the root are found by pointer doubling: in each round a node takes over the pointer
of the node that it points to, so a depth of d takes log2(d) joins, whatever the number of
nodes. Each round is written, so plans stay small and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.tables import discard, written


def _pointers(nodes: DataFrame, key: str, parent: str, label: Column) -> DataFrame:
    """(k, up, l): one row a key; up is null where the parent isn't there."""
    t = nodes.select(F.col(key).alias("k"), F.struct(F.col(parent).alias("p"), label.cast("string").alias("l")).alias("v"))
    t = t.groupBy("k").agg(F.min("v").alias("v")).select("k", "v.p", "v.l")
    # spread by another hash than the join's, so that a parent of very many can be split
    have = t.where("k IS NOT NULL").select(F.col("k").alias("up"))
    return t.repartition(F.xxhash64("k")).join(have, F.col("p") == F.col("up"), "left").select("k", "up", "l")


def _doubled(start: DataFrame, joined: Column | None) -> tuple[DataFrame, int]:
    """Rounds of (k, up, hops, path) until no pointer is left, or those left can't end; and
    how many are left. Without `joined` paths aren't kept. Rows that have arrived move to a
    table of their own and are read by later rounds, but not joined again."""
    fields = ["k", "up", "hops", *(["path"] if joined is not None else [])]
    now = written(start.select(*fields), "tree")
    n, rounds = now.count(), 0
    left = now.where("up IS NOT NULL").count()
    while left and (1 << rounds) <= n:
        over = now.where("k IS NOT NULL").select(*(F.col(c).alias(f"_{c}") for c in fields))
        moved = now.where("up IS NOT NULL").join(over, F.col("up") == F.col("_k"))
        path = [joined.alias("path")] if joined is not None else []
        after = moved.select("k", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).alias("hops"), *path)
        after = written(now.where("up IS NULL").unionByName(after), "tree")
        discard(now)
        now, rounds = after, rounds + 1
        left = now.where("up IS NOT NULL").count()
    return now, left


def depths(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, depth): roots (no parent, or one that isn't there) have 1; nodes on a cycle, and
    those under one, have a null depth."""
    t = _pointers(nodes, key, parent, F.lit(None))
    found, _ = _doubled(t.withColumn("hops", F.lit(1).cast("long")), None)
    return found.select(F.col("k").alias(key), F.when(F.col("up").isNull(), F.col("hops")).alias("depth"))


def cycles(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key) of the nodes that lie on a cycle or under one."""
    return depths(nodes, key, parent).where("depth IS NULL").select(key)


def paths(nodes: DataFrame, key: str, parent: str, label: Column, sep: str = "/") -> DataFrame:
    """(key, path, depth) of each node reached from a root (no parent, or one that isn't
    there), of any depth. Nodes on a cycle or under one have no root and so no row (`cycles`
    lists them). A repeated key, or a null one, counts once, with its least parent and label;
    a null label is empty."""
    t = _pointers(nodes, key, parent, label)
    flat = written(t, "tree-nodes")
    found, left = _doubled(flat.withColumn("hops", F.lit(1).cast("long")), None)
    rows = flat
    if left:  # paths of what never ends would double in every round
        rows = flat.join(found.where("up IS NULL AND k IS NOT NULL").select("k"), "k", "left_semi").unionByName(flat.where("k IS NULL"))
    start = rows.select("k", "up", F.lit(1).cast("long").alias("hops"), F.coalesce("l", F.lit("")).alias("path"))
    done, _ = _doubled(start, F.concat("_path", F.lit(sep), "path"))
    discard(found)
    return done.select(F.col("k").alias(key), "path", F.col("hops").alias("depth"))


def layers(nodes: DataFrame, edges: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """(key, layer) of a directed graph: 0 without an incoming edge, else one more than the
    highest layer of the nodes that point to it (the longest way from a start). Nodes on a
    cycle, and those behind one, have a null layer. Edges with an end that isn't there are left
    out, repeated ones and self-loops count as edges.

    Starts are peeled off, layer by layer: a node whose last incoming edge goes is in the
    next layer. A round joins only the edges that leave the layer peeled last, so there are
    as many rounds as layers, and each edge travels once.
    """
    names = nodes.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    e = e.join(names.select(F.col("k").alias("s")), "s", "left_semi").join(names.select(F.col("k").alias("t")), "t", "left_semi")
    e = written(e, "layer-edges")
    waits = written(names.join(e.groupBy(F.col("t").alias("k")).agg(F.count(F.lit(1)).alias("n")), "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n")), "layer-waits")
    tables, layer = [], 0
    ready = written(waits.where("n = 0").select("k", F.lit(0).alias("layer")), "layer")
    while ready.take(1):
        tables.append(ready)
        layer += 1
        gone = e.join(ready.select(F.col("k").alias("s")), "s", "left_semi").groupBy(F.col("t").alias("k")).agg(F.count(F.lit(1)).alias("gone"))
        gone = written(gone, "layer-gone")
        less = written(waits.where("n > 0").join(gone, "k", "left").select("k", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")), "layer-waits")
        discard(waits)
        discard(gone)
        # what waits for nothing now was reached in this round
        ready = written(less.where("n = 0").select("k", F.lit(layer).alias("layer")), "layer")
        waits = less
    out = waits.where("n > 0").select("k", F.lit(None).cast("int").alias("layer"))
    for table in tables:
        out = out.unionByName(table)
    return out.select(F.col("k").alias(key), "layer")


def flatten(levels: list[tuple[str, DataFrame]], sep: str = " > ") -> DataFrame:
    """Levels of a tree as entries (entry_id, entry_type, entry_title, level, parent_id, path).

    levels: (type, table with id, title, parent_id); the top one's parent_id isn't read.
    A child whose parent is missing is left out; a blank title becomes `Type` and its id.
    """
    out, above = None, None
    for depth, (kind, table) in enumerate(levels, 1):
        title = F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit(kind.capitalize() + " "), F.col("id").cast("string"))).otherwise(F.col("title"))
        t = table.select(F.col("id").cast("string").alias("entry_id"), title.alias("entry_title"), (F.col("parent_id").cast("string") if above is not None else F.lit(None).cast("string")).alias("parent_id"))
        if above is None:
            rows = t.withColumn("path", F.col("entry_title"))
        else:
            up = above.select(F.col("entry_id").alias("parent_id"), F.col("path").alias("_up"))
            rows = t.join(up, "parent_id").withColumn("path", F.concat_ws(sep, "_up", "entry_title")).drop("_up")
        above = rows
        rows = rows.select("entry_id", F.lit(kind).alias("entry_type"), "entry_title", F.lit(depth).cast("long").alias("level"), "parent_id", "path")
        out = rows if out is None else out.unionByName(rows)
    return out
