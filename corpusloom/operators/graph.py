"""Concept graphs: nodes and edges as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.rank import first_by_key
from corpusloom.tables import tasks_for, written


def valid_edges(edges: DataFrame, nodes: DataFrame, types: list[str] | None = None, src: str = "source_node_id", dst: str = "target_node_id", kind: str = "relationship_type", key: str = "id") -> DataFrame:
    """Edges of a known type whose two ends are nodes."""
    kept = edges.where(F.col(kind).isin(types)) if types else edges
    ids = nodes.select(F.col(key).alias("_n")).distinct()
    return kept.join(ids, kept[src] == ids["_n"], "left_semi").join(ids, kept[dst] == ids["_n"], "left_semi")


def incidence(edges: DataFrame, node, src: str, dst: str) -> DataFrame:
    """Edges at a node with their direction; a loop comes twice. Ends needn't exist."""
    return edges.where(F.col(src) == node).withColumn("direction", F.lit("outgoing")).unionByName(edges.where(F.col(dst) == node).withColumn("direction", F.lit("incoming")))


def co_occurrence(members: DataFrame, item: str, shared: str, block: int = 2048) -> DataFrame:
    """Pairs (a < b) of items that share something, and how many things. Nulls share nothing.

    Grows with the square of an item list; meant for short lists of things such as the
    variables of equations or the lines of an order. A list of over `block` items is dealt out
    to blocks; each pair of blocks meets by itself, so that no list is squared in one task.
    Meetings are counted first, and there are as many tasks as they need.
    """
    m = written(members.select(F.col(item).alias("i"), F.col(shared).alias("s")).where("i IS NOT NULL AND s IS NOT NULL").distinct(), "members")
    lists = m.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    long = lists.select("s", F.ceil(F.col("n") / block).cast("int").alias("blocks")).where("blocks > 1")
    dealt = m.join(long, "s", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, every = F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = dealt.select("s", mine.alias("x"), every.alias("y"), F.col("i").alias("a"))
    b = dealt.select("s", every.alias("x"), mine.alias("y"), F.col("i").alias("b"))
    meetings, items = lists.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0, m.agg(F.approx_count_distinct("i")).first()[0]
    n, on = tasks_for(meetings), ["s", "x", "y"]
    met = a.repartition(n, *on).join(b.repartition(n, *on).hint("merge"), on).where("a < b").select("a", "b")
    if meetings < 4 * items * items:  # few pairs come again, so rows travel as they are, to as many tasks
        met = met.repartition(n, "a", "b")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def title_ids(nodes: DataFrame, title: str, key: str, order: str, scope: list[str] | None = None) -> DataFrame:
    """(scope..., title, id): the last node of each title."""
    return first_by_key(nodes, [F.col(c) for c in [*(scope or []), title]], [F.desc(order)]).select(*(scope or []), title, key)


def resolve_titles(relations: DataFrame, ids: DataFrame, title: str, key: str, source: str = "source", target: str = "target", scope: list[str] | None = None) -> DataFrame:
    """Relations by title as edges by id; those with an unknown title are dropped."""
    on = scope or []
    a = ids.select(*on, F.col(title).alias(source), F.col(key).alias("source_node_id"))
    b = ids.select(*on, F.col(title).alias(target), F.col(key).alias("target_node_id"))
    return relations.join(a, [*on, source]).join(b, [*on, target])


def first_concepts(concepts: DataFrame, title: str, order: list[str]) -> DataFrame:
    """One concept a title, the first in reading order: what concurrent writers would race
    for is decided by place."""
    return first_by_key(concepts, [F.col(title)], [F.col(o) for o in order])


def group_edges(responses: DataFrame, section: str = "section_id") -> DataFrame:
    """(section, group, title, relationship_type, confidence): a `contains` edge for each
    member of each concept group, also where the member is known from elsewhere."""
    groups = responses.select(section, F.posexplode("concept_groups").alias("gpos", "g"))
    return groups.select(section, "gpos", F.col("g.name").alias("group"), F.posexplode("g.members").alias("mpos", "m")).select(
        section, "gpos", "mpos", "group", F.col("m.title").alias("title"), F.lit("contains").alias("relationship_type"), F.lit(1.0).alias("confidence")
    )


def node_count(responses: DataFrame) -> DataFrame:
    """Nodes that responses stand for: each group and its members."""
    return responses.select(F.explode("concept_groups").alias("g")).agg(F.sum(F.size("g.members") + 1).alias("n"))


def component_uses(enrichment: DataFrame, key: str = "node_id") -> DataFrame:
    """`uses` edges from equations to the linked nodes of calculated components."""
    c = enrichment.select(F.col(key).alias("source_node_id"), F.explode("equation_components").alias("c"))
    return c.where("c.type = 'calculated' AND c.linked_node_id IS NOT NULL AND c.linked_node_id <> ''").select(
        "source_node_id", F.col("c.linked_node_id").alias("target_node_id"), F.lit("uses").alias("relationship_type"), F.format_string("%s (%s)", "c.symbol", "c.name").alias("reasoning")
    )


def visible_nodes(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """Nodes whose chapter, and section if they have one, are expanded; chapters always."""
    open_ids = expanded.select(F.col("id").alias("_o")).distinct()
    top = nodes.where("level = 'chapter'")
    rest = nodes.where("level <> 'chapter'").join(open_ids, F.col("source_chapter_id") == F.col("_o"), "left_semi")
    loose, bound = rest.where("source_section_id IS NULL OR level = 'section'"), rest.where("source_section_id IS NOT NULL AND level <> 'section'")
    return top.unionByName(loose).unionByName(bound.join(open_ids, F.col("source_section_id") == F.col("_o"), "left_semi"))
