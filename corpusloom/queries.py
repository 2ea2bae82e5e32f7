"""Queries over the driver's tables, each with the SQL that must give the same rows.

Names begin with the ids of the operators that a query applies.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import records
from corpusloom.operators import graph, interval, islands, mutate, ordered, rank, scans, search, tree
from corpusloom.plans import catalog, relevance, schemas, toc
from corpusloom.sinks import files as sinks
from corpusloom.sinks import office
from corpusloom.sinks.files import folder_of
from corpusloom.sinks.row_files import write_files
from corpusloom.sources import files
from corpusloom.streaming import chunks, state
from corpusloom.tables import scratch, tasks_for, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

    def rows(self, data: list, schema: str) -> DataFrame:
        return self._spark.createDataFrame(data, schema)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


# --- scans ---


@query("src01_sorted_scan", "SELECT s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name)::BIGINT AS position FROM supplier")
def _(t):
    return rank.top_n(t.supplier, ["s_nationkey"], [F.col("s_name")], 1 << 30).select("s_suppkey", "s_name", "position")


@query("src02_optional_filter", "SELECT doc_id, source, n_chars FROM documents WHERE source = 'src3'")
def _(t):
    return t.documents.where("source = 'src3'").select("doc_id", "source", "n_chars")


@query("src03_point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def _(t):
    return t.customer.where("c_custkey = 42").limit(1).select("c_custkey", "c_name", "c_acctbal")


@query("src06_key_and_status", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def _(t):
    return t.orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("src07_roots_null_or_blank", "SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN '' ELSE c_mktsegment END AS parent FROM customer) WHERE parent IS NULL OR parent = ''")
def _(t):
    seg = F.col("c_mktsegment")
    return t.customer.select("c_custkey", F.when(seg == "BUILDING", None).when(seg == "MACHINERY", "").otherwise(seg).alias("parent")).where("parent IS NULL OR parent = ''").select("c_custkey")


@query("src09_two_way_order", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, n_chars DESC, doc_id)::BIGINT AS position FROM documents")
def _(t):
    return rank.top_n(t.documents, ["source"], [F.col("lang"), F.desc("n_chars"), F.col("doc_id")], 1 << 30).select("doc_id", "position")


@query("src10_nulls_first", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 31 END NULLS FIRST, event_id)::BIGINT AS position FROM events")
def _(t):
    page = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 31)
    return rank.top_n(t.events.withColumn("page", page), ["event_type"], [F.col("page"), F.col("event_id")], 1 << 30).select("event_id", "position")


@query("src11_messages_in_order", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS position FROM conversations")
def _(t):
    return rank.top_n(t.conversations, ["conv_id"], [F.col("turn")], 1 << 30).select("conv_id", "turn", "role", "position")


@query("src14_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def _(t):
    return rank.latest_per_key(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("src15_default_status", "SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END, 'none') AS status FROM documents d LEFT JOIN labels USING (doc_id)")
def _(t):
    named = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("status"))
    return t.documents.select("doc_id").join(named, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("none")).alias("status"))


@query("src34_first_50_of_batch", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 50")
def _(t):
    return rank.top_n(t.events, ["event_type"], [F.col("ts"), F.col("event_id")], 50).select("event_id", "event_type")


LINKS_SQL = r"""
WITH l AS (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1), regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2))) AS p,
  generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1), 1) AS pos FROM pages),
r AS (SELECT page_id, p[1] AS href, p[2] AS txt, pos FROM l WHERE p[1] <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS n FROM r)
SELECT page_id, href,
  CASE WHEN trim(regexp_replace(txt, '<[^>]*>', '', 'g')) <> '' THEN trim(regexp_replace(txt, '<[^>]*>', '', 'g'))
    ELSE regexp_replace(regexp_extract(href, '([^/?#]*)(?:[?#].*)?$', 1), '\.[A-Za-z0-9]+$', '') END AS title,
  lower(regexp_extract(regexp_extract(href, '^([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) AS file_type
FROM f WHERE n = 1
"""


@query("src28_agg14_link_scan", LINKS_SQL)
def _(t):
    return files.html_links(t.pages, ["page_id"], suffixes=None)


# --- changes of tables ---


@query("snk01_append_with_id", "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t):
    return mutate.append(t.customer.select("c_custkey", "c_name"), t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")))


@query("snk02_insert_ignore", "SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 50 UNION ALL SELECT c_custkey, c_name || ' new' FROM customer WHERE c_custkey BETWEEN 51 AND 90")
def _(t):
    c = t.customer.select("c_custkey", "c_name")
    return mutate.insert_ignore(c.where("c_custkey <= 50"), c.where("c_custkey BETWEEN 30 AND 90").withColumn("c_name", F.concat("c_name", F.lit(" new"))), ["c_custkey"])


@query("snk03_upsert_latest", "WITH n AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1) SELECT * FROM n UNION ALL SELECT c_custkey, 'none', 0.0 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM n)")
def _(t):
    table = t.customer.select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type"), F.lit(0.0).alias("value"))
    new = rank.latest_per_key(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value")
    return mutate.upsert(table, new, ["user_id"])


@query("snk04_upsert_keep_id", "SELECT 'old' || c_custkey AS id, c_custkey, CASE WHEN c_custkey > 20 THEN 'b' ELSE 'a' END AS v FROM customer WHERE c_custkey <= 40 UNION ALL SELECT 'new' || c_custkey, c_custkey, 'b' FROM customer WHERE c_custkey BETWEEN 41 AND 60")
def _(t):
    old = t.customer.where("c_custkey <= 40").selectExpr("concat('old', c_custkey) AS id", "c_custkey", "'a' AS v")
    return mutate.upsert_keep_id(old, t.customer.where("c_custkey BETWEEN 21 AND 60").selectExpr("concat('new', c_custkey) AS id", "c_custkey", "'b' AS v"), ["c_custkey"])


@query("snk05_replace_by_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 3 <> 0 UNION ALL SELECT o_custkey, min(o_orderkey), round(sum(o_totalprice), 2) FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    new = o.where("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.round(F.sum("o_totalprice"), 2).alias("o_totalprice"))
    return mutate.replace_by_key(o, new, ["o_custkey"])


@query("snk07_update_column", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    return mutate.set_where(t.orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderkey") % 5 == 0, {"o_orderstatus": F.lit("X")})


@query("snk08_snk09_patch", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(t):
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    changes = c.where("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 8 != 0, F.concat("c_name", F.lit("!"))).alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return mutate.patch(c, changes, ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


@query("snk10_delete_where", "SELECT event_id FROM events WHERE NOT coalesce(value > 50, false)")
def _(t):
    return mutate.delete_where(t.events, F.col("value") > 50).select("event_id")


@query("snk11_snk12_cascade_delete", "WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT * FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n))) SELECT 'nation' AS tbl, n_nationkey::BIGINT AS id FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', c_custkey FROM c UNION ALL SELECT 'orders', o_orderkey FROM o")
def _(t):
    left = mutate.cascade_delete({"nation": t.nation, "customer": t.customer, "orders": t.orders}, [("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey")], "nation", F.col("n_regionkey") == 1)
    keys = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey"}
    parts = [left[n].select(F.lit(n).alias("tbl"), F.col(k).cast("long").alias("id")) for n, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("snk18_fn28_category_folders", "SELECT name, folder FROM (SELECT p_name AS name, CASE WHEN p_size % 4 = 0 THEN 'lectures' WHEN p_size % 4 = 1 THEN 'exams' ELSE 'other' END AS folder, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def _(t):
    cat = F.when(F.col("p_size") % 4 == 0, "lecture_slides").when(F.col("p_size") % 4 == 1, "past_exam_papers").when(F.col("p_size") % 4 == 2, "mystery")
    return rank.first_by_key(t.part, [F.col("p_name")], [F.col("p_partkey")]).select(F.col("p_name").alias("name"), folder_of(cat).alias("folder"))


@query("snk21_json_lines", "SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"' || CASE WHEN event_id % 3 = 0 THEN ',\"user_id\":' || user_id ELSE '' END || '}' AS value FROM events")
def _(t):
    rec = F.struct("event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("user_id"))
    return t.events.select("event_id", F.to_json(rec).alias("value"))


# --- projections ---


@query("prj01_json_props", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, coalesce(json_extract_string(props, '$.confidence')::DOUBLE, 1.0) AS confidence FROM events")
def _(t):
    p = F.from_json("props", "k int, confidence double")
    return t.events.select("event_id", p["k"].alias("k"), F.coalesce(p["confidence"], F.lit(1.0)).alias("confidence"))


@query("prj03_jn05_tree_flat", "SELECT r_regionkey::VARCHAR AS entry_id, 'region' AS entry_type, r_name AS entry_title, 1::BIGINT AS level, NULL::VARCHAR AS parent_id, r_name AS path FROM region UNION ALL SELECT n_nationkey::VARCHAR, 'nation', n_name, 2, n_regionkey::VARCHAR, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_custkey::VARCHAR, 'customer', CASE WHEN c_custkey % 10 = 0 THEN 'Customer ' || c_custkey ELSE c_name END, 3, c_nationkey::VARCHAR, r_name || ' > ' || n_name || ' > ' || CASE WHEN c_custkey % 10 = 0 THEN 'Customer ' || c_custkey ELSE c_name END FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return tree.flatten(
        [
            ("region", t.region.selectExpr("r_regionkey AS id", "r_name AS title")),
            ("nation", t.nation.selectExpr("n_nationkey AS id", "n_name AS title", "n_regionkey AS parent_id")),
            ("customer", t.customer.selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS title", "c_nationkey AS parent_id")),
        ]
    )


@query("prj05_safe_int", "SELECT c_custkey, coalesce(try_cast(right(c_name, 4) AS INT), -1) AS a, coalesce(try_cast(c_mktsegment AS INT), -1) AS b FROM customer")
def _(t):
    return t.customer.select("c_custkey", T.safe_int(F.right("c_name", F.lit(4)), -1).alias("a"), T.safe_int(F.col("c_mktsegment"), -1).alias("b"))


@query("prj06_flt15_content_type", "SELECT event_id, CASE event_type WHEN 'click' THEN 'figure' WHEN 'view' THEN 'text' END AS content_type FROM events WHERE event_type IN ('click', 'view')")
def _(t):
    kind = F.when(F.col("event_type") == "click", "image").when(F.col("event_type") == "view", "text").otherwise("discarded")
    return t.events.select("event_id", files.content_type(kind).alias("content_type")).where("content_type IS NOT NULL")


@query("prj08_prj09_topics", "SELECT conv_id, ordinal, topic FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS ordinal, CASE WHEN role = 'system' THEN '' WHEN role = 'user' THEN substr(text, 1, 20) ELSE substr(text, 1, 20) || ': ' || role END AS topic FROM conversations) WHERE topic <> ''")
def _(t):
    item = F.struct("turn", F.struct(F.when(F.col("role") == "system", "").otherwise(F.substring("text", 1, 20)).alias("title"), F.when(F.col("role") != "user", F.col("role")).otherwise("").alias("description")).alias("x"))
    made = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    summaries = made.select("conv_id", F.to_json(F.struct(F.transform("xs", lambda v: v["x"]).alias("topics"))).alias("summary_json"))
    return relevance.topics(summaries, ["conv_id"])


@query("prj11_positional_index", "SELECT l_orderkey, l_linenumber, l_partkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::BIGINT AS idx FROM lineitem")
def _(t):
    return rank.top_n(t.lineitem, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], 1 << 30, "idx").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("idx") - 1).alias("idx"))


@query("prj14_dimension_default", "SELECT event_id, CASE event_type WHEN 'click' THEN 'solid' WHEN 'view' THEN 'dashed' ELSE 'dotted' END AS style FROM events")
def _(t):
    dim = t.rows([("click", "solid"), ("view", "dashed")], "event_type string, style string")
    return t.events.join(F.broadcast(dim), "event_type", "left").select("event_id", F.coalesce("style", F.lit("dotted")).alias("style"))


@query("prj15_badge", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount > 0.07 THEN 'High' WHEN l_discount >= 0.04 THEN 'Medium' ELSE 'Low' END AS badge FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", rank.badge(F.col("l_discount"), 0.07, 0.04).alias("badge"))


@query("prj17_previews", "SELECT source, string_agg(CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END, chr(10) ORDER BY n) AS preview FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20 GROUP BY source")
def _(t):
    short = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text"))
    first = rank.top_n(t.documents, ["source"], [F.col("doc_id")], 20).withColumn("short", short)
    return first.groupBy("source").agg(islands.ordered_concat("short", ["position"], "\n").alias("preview"))


@query("prj18_prompt_history", "SELECT conv_id, 0::BIGINT AS ordinal, 'system' AS role, 'You explain.' AS text FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT, role, text FROM conversations UNION ALL SELECT conv_id, count(*) + 1, 'user', 'Why?' FROM conversations GROUP BY conv_id")
def _(t):
    c = rank.top_n(t.conversations, ["conv_id"], [F.col("turn")], 1 << 30, "ordinal").select("conv_id", "ordinal", "role", "text")
    ends = t.conversations.groupBy("conv_id").agg((F.count(F.lit(1)) + 1).alias("ordinal"))
    head = ends.select("conv_id", F.lit(0).cast("long").alias("ordinal"), F.lit("system").alias("role"), F.lit("You explain.").alias("text"))
    return head.unionByName(c).unionByName(ends.select("conv_id", "ordinal", F.lit("user").alias("role"), F.lit("Why?").alias("text")))


@query("prj19_component_uses", "SELECT l_orderkey AS source_node_id, l_partkey AS target_node_id, 'uses' AS relationship_type, l_returnflag || ' (' || l_linestatus || ')' AS reasoning FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 <> 0")
def _(t):
    c = F.struct(F.when(F.col("l_linenumber") == 1, "calculated").otherwise("given").alias("type"), F.when(F.col("l_partkey") % 3 != 0, F.col("l_partkey").cast("string")).otherwise("").alias("linked_node_id"), F.col("l_returnflag").alias("symbol"), F.col("l_linestatus").alias("name"))
    made = t.lineitem.groupBy(F.col("l_orderkey").alias("node_id")).agg(F.collect_list(c).alias("equation_components"))
    return graph.component_uses(made).withColumn("target_node_id", F.col("target_node_id").cast("long"))


@query("prj20_agg16_group_edges", "SELECT o_custkey AS section_id, o_orderstatus AS grp, o_orderkey AS title, 'contains' AS relationship_type, 1.0::DOUBLE AS confidence FROM orders")
def _(t):
    groups = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("title"))).alias("members"))
    responses = groups.groupBy(F.col("o_custkey").alias("section_id")).agg(F.collect_list(F.struct(F.col("o_orderstatus").alias("name"), "members")).alias("concept_groups"))
    return graph.group_edges(responses).select("section_id", F.col("group").alias("grp"), "title", "relationship_type", "confidence")


@query("agg16_node_count", "SELECT (sum(n + 1))::BIGINT AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderstatus)")
def _(t):
    groups = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("title"))).alias("members"))
    return graph.node_count(groups.groupBy("o_custkey").agg(F.collect_list(F.struct("members")).alias("concept_groups")))


@query("prj21_nodes_from_rows", "SELECT 'n' || n_nationkey AS id, n_name AS title, 'chapter' AS level, NULL::VARCHAR AS source_section_id FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, 'section', 'n' || s_nationkey FROM supplier")
def _(t):
    chapters = t.nation.selectExpr("concat('n', n_nationkey) AS id", "n_name AS title", "'chapter' AS level")
    sections = t.supplier.selectExpr("concat('s', s_suppkey) AS id", "s_name AS title", "'section' AS level", "concat('n', s_nationkey) AS source_section_id")
    return sections.unionByName(chapters, allowMissingColumns=True).select("id", "title", "level", "source_section_id")


# --- filters ---


@query("flt03_enum_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("flt07_meta_titles_guarded", "SELECT p_brand, p_partkey FROM (SELECT *, p_size % 5 <> 0 AND p_brand <> 'Brand#11' AS ok, sum(CASE WHEN p_size % 5 <> 0 AND p_brand <> 'Brand#11' THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS kept FROM part) WHERE kept = 0 OR ok")
def _(t):
    title = F.when((F.col("p_size") % 5 == 0) | (F.col("p_brand") == "Brand#11"), " Preface ").otherwise(F.col("p_name"))
    return toc.drop_meta(t.part.withColumn("title", title), ["p_brand"], "title").select("p_brand", "p_partkey")


@query("flt09_jn09_valid_edges", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'R') AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 20) AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def _(t):
    nodes = t.part.where("p_size > 20").select(F.concat(F.lit("p"), "p_partkey").alias("id")).unionByName(t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")))
    edges = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("p"), "l_partkey").alias("source_node_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_node_id"), F.col("l_returnflag").alias("relationship_type"))
    return graph.valid_edges(edges, nodes, ["A", "R"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("flt10_preselect", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.quality, 0) > 0.5")
def _(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where("coalesce(quality, 0) > 0.5").select("doc_id")


@query("flt12_name_search", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '#0000000' || '1')")
def _(t):
    return t.customer.where(F.contains(F.lower("c_name"), F.lower(F.lit("#00000001")))).select("c_custkey", "c_name")


@query("flt14_matched_lines", r"SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the'))[1] AS first_line, len(list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'the')))::BIGINT AS n FROM documents WHERE contains(lower(text), 'the')")
def _(t):
    lines = search.matched_lines(F.col("text"), F.lit("the"))
    return t.documents.where(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", lines.alias("m")).select("doc_id", F.col("m")[0].alias("first_line"), F.size("m").cast("long").alias("n"))


@query("fn01_fn05_flt16_clean_lines", r"SELECT doc_id, pos, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS pos, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> ''")
def _(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "l"))
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), T.strip(F.col("l")).alias("line")).where("line <> ''")


@query("flt17_scanned", "SELECT conv_id, NOT coalesce(bool_or(turn < 5 AND length(trim(text)) > 400), false) AS scanned FROM conversations GROUP BY conv_id")
def _(t):
    c = t.conversations.select("conv_id", (F.col("turn") + 1).alias("page"), F.when(F.length(T.strip(F.col("text"))) > 400, F.repeat(F.lit("x"), F.lit(101))).otherwise("").alias("t"))
    return files.is_scanned(c, "conv_id", "page", "t")


@query("flt18_url_policy", r"SELECT page_id, regexp_matches(url, '^https?://') AND lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) NOT IN ('spam-farm.example.org', 'tionsh.example.net') AS allowed FROM pages")
def _(t):
    return t.pages.select("page_id", T.allowed_url(F.col("url"), ["spam-farm.example.org", "tionsh.example.net"]).alias("allowed"))


@query("flt19_path_prefix", "SELECT page_id FROM pages WHERE starts_with(url, 'https://www.')")
def _(t):
    return t.pages.where(F.col("url").startswith("https://www.")).select("page_id")


@query("flt22_level_threshold", "SELECT event_id FROM events WHERE event_type IN ('purchase', 'error')")
def _(t):
    level = F.when(F.col("event_type") == "purchase", "WARN").when(F.col("event_type") == "error", "error").otherwise("debug")
    return t.events.where(chunks.level_at_least(level, "warn")).select("event_id")


@query("flt23_supported_files", r"SELECT p_partkey FROM part WHERE p_size % 3 <> 2")
def _(t):
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".PDF").when(F.col("p_size") % 3 == 1, ".docx").otherwise(".exe"))
    return t.part.where(files.supported(name)).select("p_partkey")


@query("flt24_json_nonempty", "SELECT event_id FROM events WHERE event_id % 3 = 0 AND coalesce(json_extract_string(props, '$.k'), '') <> ''")
def _(t):
    meta = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise("{broken")
    return t.events.where(F.coalesce(T.parse_json(meta, "k string")["k"], F.lit("")) != "").select("event_id")


@query("flt25_qualifying_runs", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE'))")
def _(t):
    ok = t.customer.where(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE")).select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(ok, "o_custkey", "left_semi").select("o_custkey", "o_orderkey")


# --- joins ---

POINTS = "p AS (SELECT o_orderkey, (o_custkey % 5)::INT AS grp, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 83)::INT END AS page FROM orders)"
INTERVALS = "i AS (SELECT p_partkey AS sec, (p_partkey % 5)::INT AS grp, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS lo, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_size - 2 ELSE p_size + (p_partkey % 6)::INT END AS hi, (p_partkey % 3)::INT + 1 AS level FROM part)"


def points(t):
    return t.orders.select("o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("grp"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 83).cast("int")).alias("page"))


def intervals(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("sec"),
        (k % 5).cast("int").alias("grp"),
        F.when(k % 17 != 0, size).alias("lo"),
        F.when(k % 13 == 0, None).when(k % 7 == 0, size - 2).otherwise(size + (k % 6).cast("int")).alias("hi"),
        ((k % 3) + 1).cast("int").alias("level"),
    )


@query("jn01_interval_first", f"WITH {POINTS}, {INTERVALS} SELECT o_orderkey, sec FROM (SELECT o_orderkey, sec, row_number() OVER (PARTITION BY o_orderkey ORDER BY lo, sec) AS n FROM p JOIN i ON p.grp = i.grp AND page BETWEEN lo AND hi) WHERE n = 1")
def _(t):
    return interval.assign_first(points(t), intervals(t), ["grp"], "page", "lo", "hi", "sec").select("o_orderkey", "sec")


@query("jn02_interval_first_or_nearest", f"WITH {POINTS}, {INTERVALS} SELECT o_orderkey, sec FROM (SELECT o_orderkey, sec, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE WHEN page IS NULL THEN 0 WHEN page BETWEEN lo AND hi THEN 1 ELSE 2 END, CASE WHEN page IS NULL OR page BETWEEN lo AND hi THEN 0 ELSE abs(page - coalesce(lo, 1000000000)) END, lo NULLS FIRST, sec) AS n FROM p JOIN i ON p.grp = i.grp) WHERE n = 1")
def _(t):
    return interval.assign_or_nearest(points(t), intervals(t), ["grp"], "page", "lo", "hi", "sec").select("o_orderkey", "sec")


@query("jn03_interval_deepest", f"WITH {POINTS}, {INTERVALS}, j AS (SELECT sec, grp, level, coalesce(lo, 0) AS lo, greatest(coalesce(hi, coalesce(lo, 0)), coalesce(lo, 0)) AS hi FROM i) SELECT o_orderkey, sec FROM (SELECT o_orderkey, sec, row_number() OVER (PARTITION BY o_orderkey ORDER BY level DESC, j.lo, sec) AS n FROM p LEFT JOIN j ON p.grp = j.grp AND page BETWEEN j.lo AND j.hi) WHERE n = 1")
def _(t):
    return interval.assign_deepest(points(t), intervals(t), ["grp"], "page", "lo", "hi", "level", "sec").select("o_orderkey", "sec")


@query("jn04_flt08_range_children", "SELECT a.p_partkey AS parent, b.p_partkey AS child FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size BETWEEN a.p_size AND a.p_size + 4")
def _(t):
    up = t.part.select("p_brand", F.col("p_partkey").alias("parent"), F.col("p_size").alias("lo"), (F.col("p_size") + 4).alias("hi"))
    low = t.part.select("p_brand", F.col("p_partkey").alias("child"), F.col("p_size").alias("page"))
    return interval.range_children(up, low, ["p_brand"], "lo", "hi", "page", "parent").select("parent", "child")


@query("jn04_flt08_range_children_whole", "SELECT a.p_partkey AS parent, b.p_partkey AS child FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size BETWEEN a.p_size AND a.p_size + 4")
def _(t):
    up = t.part.select("p_brand", F.col("p_partkey").alias("parent"), F.col("p_size").alias("lo"), (F.col("p_size") + 4).alias("hi"))
    low = t.part.select("p_brand", F.col("p_partkey").alias("child"), F.col("p_size").alias("page"))
    return interval.range_children(up, low, ["p_brand"], "lo", "hi", "page", "parent").select("parent", "child")


@query("jn06_tree_paths", "WITH RECURSIVE t(id, parent, name) AS (SELECT 'r' || r_regionkey, NULL::VARCHAR, r_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer), w(id, path, depth) AS (SELECT id, name, 1::BIGINT FROM t WHERE parent IS NULL UNION ALL SELECT t.id, w.path || '/' || t.name, w.depth + 1 FROM t JOIN w ON t.parent = w.id) SELECT id, path, depth FROM w")
def _(t):
    nodes = t.region.selectExpr("concat('r', r_regionkey) AS id", "cast(NULL AS string) AS parent", "r_name AS name")
    nodes = nodes.unionByName(t.nation.selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS parent", "n_name AS name"))
    nodes = nodes.unionByName(t.customer.selectExpr("concat('c', c_custkey) AS id", "concat('n', c_nationkey) AS parent", "c_name AS name"))
    return tree.paths(nodes, "id", "parent", F.col("name"))


@query("jn07_inner_lookup", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def _(t):
    return t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(t.customer.where("c_acctbal > 0").select("c_custkey", "c_name"), "c_custkey").select("o_orderkey", "c_name")


@query("jn08_left_last_wins", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) ON c_custkey = o_custkey AND n = 1")
def _(t):
    last = rank.latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return t.customer.select("c_custkey").join(last, "c_custkey", "left")


@query("jn10_resolve_titles", "WITH ids AS (SELECT p_name, max(p_partkey) AS id FROM part GROUP BY p_name), r AS (SELECT a.p_name AS source, CASE WHEN a.p_partkey % 9 = 0 THEN 'no such part' ELSE b.p_name END AS target, a.p_partkey AS k FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT k, x.id AS source_node_id, y.id AS target_node_id FROM r JOIN ids x ON x.p_name = r.source JOIN ids y ON y.p_name = r.target")
def _(t):
    ids = graph.title_ids(t.part, "p_name", "p_partkey", "p_partkey")
    nxt = t.part.select((F.col("p_partkey") - 1).alias("k"), F.col("p_name").alias("n"))
    r = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("source")).join(nxt, "k").select("k", "source", F.when(F.col("k") % 9 == 0, "no such part").otherwise(F.col("n")).alias("target"))
    return graph.resolve_titles(r, ids, "p_name", "p_partkey").select("k", "source_node_id", "target_node_id")


@query("jn11_resolve_in_section", "WITH ids AS (SELECT l_orderkey, l_partkey % 4 AS t, max(l_linenumber) AS id FROM lineitem GROUP BY 1, 2), r AS (SELECT DISTINCT l_orderkey, l_partkey % 4 AS s, (l_partkey + 1) % 4 AS g FROM lineitem) SELECT r.l_orderkey, x.id AS source_node_id, y.id AS target_node_id FROM r JOIN ids x ON x.l_orderkey = r.l_orderkey AND x.t = s JOIN ids y ON y.l_orderkey = r.l_orderkey AND y.t = g")
def _(t):
    items = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4).alias("t"), ((F.col("l_partkey") + 1) % 4).alias("g"))
    ids = graph.title_ids(items, "t", "l_linenumber", "l_linenumber", ["l_orderkey"])
    r = items.select("l_orderkey", F.col("t").alias("source"), F.col("g").alias("target")).distinct()
    return graph.resolve_titles(r, ids, "t", "l_linenumber", scope=["l_orderkey"]).select("l_orderkey", "source_node_id", "target_node_id")


@query("jn12_node_incidence", "SELECT l_orderkey, l_partkey, l_suppkey, 'outgoing' AS direction FROM lineitem WHERE l_partkey = 7 UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 'incoming' FROM lineitem WHERE l_suppkey = 7")
def _(t):
    return graph.incidence(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), 7, "l_partkey", "l_suppkey")


@query("jn13_agg06_cooccurrence", "WITH m AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2")
def _(t):
    return graph.co_occurrence(t.lineitem, "l_partkey", "l_orderkey")


@query("jn13_agg06_cooccurrence_whole", "WITH m AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM m x JOIN m y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2")
def _(t):
    return graph.co_occurrence(t.lineitem, "l_partkey", "l_orderkey")


ALIASES = [("the", "teh"), ("thing", "thang"), ("der", "ther"), ("que", "kue")]
WORDS = [("Teh",), ("que",), ("zzz",)]
EXPANDED = "k(keyword) AS (VALUES ('teh'), ('the'), ('que'), ('kue'), ('zzz'))"


@query("jn15_set05_alias_expansion", f"WITH {EXPANDED} SELECT keyword FROM k")
def _(t):
    return search.expand_keywords(t.rows(WORDS, "keyword string"), t.rows(ALIASES, "canonical string, alias string"))


@query("jn14_flt05_keyword_hits", f"WITH {EXPANDED} SELECT doc_id, keyword FROM documents, k WHERE contains(lower(text), keyword)")
def _(t):
    kw = search.expand_keywords(t.rows(WORDS, "keyword string"), t.rows(ALIASES, "canonical string, alias string"))
    return search.keyword_hits(t.documents.select("doc_id", "text"), kw, "text").select("doc_id", "keyword")


FLAGSHIP_SQL = f"""
WITH {EXPANDED},
h AS (SELECT d.doc_id, keyword, text, list_position(list_transform(string_split(text, chr(10)), lambda x: contains(lower(x), keyword)), true) AS hit FROM documents d, k WHERE contains(lower(text), keyword)),
c AS (SELECT h.doc_id, keyword, array_to_string(string_split(text, chr(10))[greatest(hit - 2, 1):hit + 2], chr(10)) AS snippet,
  CASE WHEN quality = 1 THEN 'EXPLAINS' ELSE 'USES' END AS class, CASE WHEN quality IS NULL THEN 0.5 WHEN toxic = 1 THEN 0.1 ELSE 0.9 END AS confidence
  FROM h LEFT JOIN labels l ON l.doc_id = h.doc_id)
SELECT doc_id, keyword, snippet, class, confidence::DOUBLE AS confidence, row_number() OVER (PARTITION BY keyword ORDER BY CASE WHEN class = 'EXPLAINS' THEN 0 ELSE 1 END, confidence DESC, doc_id)::BIGINT AS position FROM c WHERE confidence >= 0.3
"""


@query("jn08_win14_ord02_search", FLAGSHIP_SQL)
def flagship(t):
    kw = search.expand_keywords(t.rows(WORDS, "keyword string"), t.rows(ALIASES, "canonical string, alias string"))
    hits = search.keyword_lines(t.documents.select("doc_id", "text"), kw, "text").drop("text", "line")
    told = t.labels.select("doc_id", "quality", "toxic")
    classed = hits.join(told, "doc_id", "left").select("doc_id", "keyword", "snippet", F.when(F.col("quality") == 1, "EXPLAINS").otherwise("USES").alias("class"), F.when(F.col("quality").isNull(), 0.5).when(F.col("toxic") == 1, 0.1).otherwise(0.9).alias("confidence"))
    # snippets stay behind while rows are put in order
    rows = written(classed.withColumn("_row", F.monotonically_increasing_id()), "hits")
    ranked = rank.rank_classified(rows.drop("snippet"), "class", "confidence", "doc_id", group=["keyword"])
    return ranked.join(rows.select("_row", "snippet").hint("merge"), "_row").select("doc_id", "keyword", "snippet", "class", "confidence", "position")


@query("jn16_jn17_positional", "SELECT conv_id, turn, role, CASE turn WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.0 END::DOUBLE AS score FROM conversations")
def _(t):
    return relevance.repaired_scores(t.conversations.select("conv_id", "turn", "role"), F.array(F.lit(0.5), F.lit(1.7), F.lit(-2.0)), "turn")


@query("jn18_agg09_holds_child", "WITH e AS (SELECT p_brand AS g, p_partkey AS pos, p_size AS page, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS level FROM part), a AS (SELECT *, lead(page) OVER (PARTITION BY g ORDER BY page, pos) AS nxt FROM e WHERE level = 1) SELECT pos, EXISTS (SELECT 1 FROM e WHERE e.g = a.g AND e.level = 2 AND e.page >= a.page AND (a.nxt IS NULL OR e.page < a.nxt)) AS has_child FROM a")
def _(t):
    e = t.part.select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("page"), F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(2).alias("level"))
    return interval.holds_child(e, ["g"], "page", "pos", "level").where("level = 1").select("pos", "has_child")


@query("jn19_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("jn20_visible_nodes", "WITH opened AS (SELECT 'c' || n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 3 = 0), n AS (SELECT 'c' || n_nationkey AS id, 'chapter' AS level, NULL AS ch, NULL AS se FROM nation UNION ALL SELECT 's' || s_suppkey, 'section', 'c' || s_nationkey, NULL FROM supplier UNION ALL SELECT 'p' || p_partkey, 'concept', 'c' || (p_partkey % 25), CASE WHEN p_partkey % 4 <> 0 THEN 's' || (p_partkey % 10 + 1) END FROM part) SELECT id FROM n WHERE level = 'chapter' OR (ch IN (SELECT id FROM opened) AND (se IS NULL OR se IN (SELECT id FROM opened)))")
def _(t):
    nodes = t.nation.selectExpr("concat('c', n_nationkey) AS id", "'chapter' AS level", "cast(NULL AS string) AS source_chapter_id", "cast(NULL AS string) AS source_section_id")
    nodes = nodes.unionByName(t.supplier.selectExpr("concat('s', s_suppkey) AS id", "'section' AS level", "concat('c', s_nationkey) AS source_chapter_id", "cast(NULL AS string) AS source_section_id"))
    nodes = nodes.unionByName(t.part.selectExpr("concat('p', p_partkey) AS id", "'concept' AS level", "concat('c', p_partkey % 25) AS source_chapter_id", "CASE WHEN p_partkey % 4 <> 0 THEN concat('s', p_partkey % 10 + 1) END AS source_section_id"))
    opened = t.nation.where("n_nationkey % 2 = 0").selectExpr("concat('c', n_nationkey) AS id").unionByName(t.supplier.where("s_suppkey % 3 = 0").selectExpr("concat('s', s_suppkey) AS id"))
    return graph.visible_nodes(nodes, opened).select("id")


@query("jn21_title_or_id", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(p_name, l_partkey::VARCHAR) AS title FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON p_partkey = l_partkey")
def _(t):
    names = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(names, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("p_name", F.col("l_partkey").cast("string")).alias("title"))


@query("jn22_agg05_sections_with_entries", f"WITH {POINTS}, {INTERVALS}, a AS (SELECT o_orderkey, sec, grp FROM (SELECT o_orderkey, sec, p.grp, row_number() OVER (PARTITION BY o_orderkey ORDER BY lo, sec) AS n FROM p JOIN i ON p.grp = i.grp AND page BETWEEN lo AND hi AND p.grp < 3) WHERE n = 1) SELECT grp::VARCHAR || '/' || sec AS path, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS entries FROM a GROUP BY grp, sec UNION ALL SELECT 'CH' || grp, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FROM p WHERE grp NOT IN (SELECT grp FROM a) GROUP BY grp")
def _(t):
    p, i = points(t), intervals(t)
    hit = interval.assign_first(p, i.where("grp < 3"), ["grp"], "page", "lo", "hi", "sec").withColumn("k", F.col("o_orderkey").cast("string"))
    made = hit.groupBy("grp", "sec").agg(islands.ordered_concat("k", ["o_orderkey"], ",").alias("entries")).select(F.concat_ws("/", "grp", "sec").alias("path"), "entries")
    bare = p.join(hit.select("grp").distinct(), "grp", "left_anti").withColumn("k", F.col("o_orderkey").cast("string"))
    return made.unionByName(bare.groupBy("grp").agg(islands.ordered_concat("k", ["o_orderkey"], ",").alias("entries")).select(F.concat(F.lit("CH"), "grp").alias("path"), "entries"))


# --- aggregations ---


@query("agg01_zero_filled_counts", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey > 140) AS customers FROM nation")
def _(t):
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    c = t.customer.where("c_custkey > 140").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    return t.nation.select("n_nationkey").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").fillna(0, ["suppliers", "customers"])


@query("agg02_count_per_category", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg03_score_bands", "SELECT l_returnflag, count(*) FILTER (l_discount > 0.07) AS high, count(*) FILTER (l_discount BETWEEN 0.04 AND 0.07) AS partial, count(*) FILTER (l_discount > 0 AND l_discount < 0.04) AS low FROM lineitem GROUP BY 1")
def _(t):
    return rank.score_bands(t.lineitem, ["l_returnflag"], "l_discount", 0.07, 0.04)


@query("agg04_status_rollup", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS extracted, count(*) AS total, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'fully_extracted' ELSE 'partially_extracted' END AS pipeline_status FROM orders GROUP BY 1")
def _(t):
    return relevance.extraction_status(t.orders.withColumn("s", F.when(F.col("o_orderstatus") == "F", "extracted")), "o_custkey", "s")


@query("agg07_batch_bounds", "SELECT p_brand, min(p_size) AS first, max(p_size + 3) AS last FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy("p_brand").agg(F.min("p_size").alias("first"), F.max(F.col("p_size") + 3).alias("last"))


@query("agg08_pattern_ratio", r"SELECT c_nationkey, avg(CASE WHEN regexp_matches(c_name, '0[1-4]$') THEN 1.0 ELSE 0.0 END) > 0.04 AS mostly FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_nationkey").agg((F.avg(F.col("c_name").rlike("0[1-4]$").cast("int")) > 0.04).alias("mostly"))


@query("agg10_ordered_concat", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg(islands.ordered_concat("text", ["turn"], "\n").alias("text"))


@query("agg11_chunk_messages", "SELECT conv_id, string_agg(role, '' ORDER BY turn) AS message FROM conversations GROUP BY conv_id")
def _(t):
    return chunks.join_chunks(t.conversations, "conv_id", "turn", "role").select("conv_id", "message")


@query("agg12_merge_descriptions", "WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), k AS (SELECT source, lang, min(n) AS f FROM d GROUP BY 1, 2) SELECT a.source, any_value(substr(text, 1, 30)) FILTER (n = 1) || '...' AS summary, bool_or(n_chars > 5000) AS has_figures, any_value(x.langs) AS langs FROM d a JOIN (SELECT source, string_agg(lang, ',' ORDER BY f) AS langs FROM k GROUP BY 1) x ON x.source = a.source GROUP BY a.source")
def _(t):
    firsts = rank.first_by_key(t.documents, [F.col("source"), F.lower("lang")], [F.col("doc_id")])
    langs = firsts.groupBy("source").agg(islands.ordered_concat("lang", ["doc_id"], ",").alias("langs"))
    whole = t.documents.groupBy("source").agg(F.concat(F.min_by(F.substring("text", 1, 30), "doc_id"), F.lit("...")).alias("summary"), F.bool_or(F.col("n_chars") > 5000).alias("has_figures"))
    return whole.join(langs, "source")


@query("agg13_agg15_dedup_first_wins", "SELECT name, p_partkey FROM (SELECT p_name AS name, p_partkey, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def _(t):
    return rank.first_by_key(t.part, [F.lower("p_name")], [F.col("p_partkey")]).select(F.col("p_name").alias("name"), "p_partkey")


@query("agg15_first_concepts", "SELECT p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_size, p_partkey) AS n FROM part) WHERE n = 1")
def _(t):
    return graph.first_concepts(t.part, "p_name", ["p_brand", "p_size", "p_partkey"]).select("p_name", "p_partkey")


@query("agg17_text_counts", "SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang <> 'en') AS other, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def _(t):
    return t.documents.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") != "en").alias("other"), F.sum(F.length("text")).alias("chars"))


@query("agg18_progress", "SELECT o_custkey, round(0.3 + 0.5 * count(*) FILTER (o_orderstatus = 'F') / greatest(count(*), 1), 2) AS progress FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(relevance.progress(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("progress"))


@query("agg19_exists", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS pending FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("pending"))


@query("agg20_single_child", "SELECT c_custkey FROM (SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, c_custkey % 9) AS n FROM customer) WHERE n = 1")
def _(t):
    one = t.customer.groupBy("c_nationkey", "c_mktsegment", F.col("c_custkey") % 9).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("c_custkey"))
    return one.where("n = 1").select("c_custkey")


@query("agg21_conditional_concat", "SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS asked, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS told FROM conversations GROUP BY 1")
def _(t):
    c = t.conversations.withColumns({"a": F.when(F.col("role") == "user", F.col("text")), "b": F.when(F.col("role") == "assistant", F.col("text"))})
    return c.groupBy("conv_id").agg(islands.ordered_concat("a", ["turn"], "\n").alias("asked"), islands.ordered_concat("b", ["turn"], "\n").alias("told"))


@query("agg22_panel_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS deferred FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") != "F").alias("deferred"))


# --- windows ---


@query("win01_lead_intervals", "SELECT p_brand, p_partkey, row_number() OVER w AS number, coalesce(lead(p_size) OVER w - 1, 60) AS page_end FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size, p_partkey)")
def _(t):
    return interval.lead_intervals(t.part, ["p_brand"], "p_size", "p_partkey", F.lit(60)).select("p_brand", "p_partkey", "number", "page_end")


@query("win02_lead_in_parent", "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) - 1, o_custkey + 100000) AS page_end FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    lines, n = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), tasks_for(t.lineitem.count())
    ends = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") + 100000).alias("_end"))
    # the join and the window keep this layout, so a task sorts as many rows whatever the table
    rows = lines.repartition(n, "l_orderkey").join(ends.repartition(n, "l_orderkey"), "l_orderkey")
    return interval.lead_intervals(rows, ["l_orderkey"], "l_partkey", "l_linenumber", F.col("_end")).select("l_orderkey", "l_linenumber", "l_partkey", "page_end")


@query("win03_next_qualifying", "SELECT p_partkey, greatest(coalesce(first_value(CASE WHEN p_partkey % 3 < 2 THEN p_size END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, p_size), p_size) AS page_end FROM part")
def _(t):
    return interval.next_qualifying_end(t.part.withColumn("level", F.col("p_partkey") % 3 + 1), ["p_brand"], "p_size", "p_partkey", "level").select("p_partkey", "page_end")


@query("win04_backfill_positive", "SELECT event_id, coalesce(first_value(CASE WHEN x > 0 THEN x END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), x) AS x FROM (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id END AS x FROM events)")
def _(t):
    e = t.events.select("event_id", "event_type", F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("event_id")).alias("x"))
    return islands.backfill_positive(e, ["event_type"], ["event_id"], "x").select("event_id", "x")


@query("win05_contiguous_batches", "WITH f AS (SELECT c_nationkey, c_custkey, c_custkey + c_custkey % 3 AS hi FROM customer), g AS (SELECT *, sum(CASE WHEN lag_hi + 1 = c_custkey THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY c_custkey) AS island FROM (SELECT *, c_nationkey % 2 AS k, lag(hi) OVER (PARTITION BY c_nationkey % 2 ORDER BY c_custkey) AS lag_hi FROM f)) SELECT k, min(c_custkey) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY k, island")
def _(t):
    c = t.customer.select((F.col("c_nationkey") % 2).alias("k"), F.col("c_custkey").alias("lo"), (F.col("c_custkey") + F.col("c_custkey") % 3).alias("hi"))
    return islands.contiguous_batches(c, ["k"], "lo", "hi", "lo").select("k", "lo", "hi", "n")


@query("win06_key_islands", "WITH f AS (SELECT source, doc_id, lang, CASE WHEN row_number() OVER w > 1 AND lag(lang) OVER w = lang THEN 0 ELSE 1 END AS b FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)), g AS (SELECT *, sum(b) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS island FROM f) SELECT source, island, any_value(lang) AS lang, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM g GROUP BY source, island")
def _(t):
    runs = islands.key_islands(t.documents.select("source", "doc_id", "lang"), ["source"], ["doc_id"], "lang").withColumn("k", F.col("doc_id").cast("string"))
    return runs.groupBy("source", "island").agg(F.min("lang").alias("lang"), islands.ordered_concat("k", ["doc_id"], ",").alias("ids"))


def line_place():
    return F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")


MERGE_SQL = """
WITH e AS (SELECT l_orderkey AS g, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity::BIGINT AS pos, CASE WHEN l_returnflag = 'R' THEN 'image' ELSE 'text' END AS type, l_suppkey % 3 AS sec, l_linenumber AS page,
  CASE WHEN l_partkey % 4 = 0 THEN 'Section ' || (l_suppkey % 3) || '..' ELSE 'part ' || l_partkey END AS text FROM lineitem),
f AS (SELECT *, CASE WHEN type = 'text' AND lag(type) OVER w = 'text' AND lag(sec) OVER w = sec THEN 0 ELSE 1 END AS b FROM e WINDOW w AS (PARTITION BY g ORDER BY pos)),
i AS (SELECT *, sum(b) OVER (PARTITION BY g ORDER BY pos) AS island FROM f),
a AS (SELECT g, min(pos) AS pos, any_value(type) AS type, arg_min(page, pos) AS page, arg_min(sec, pos) AS sec, string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (type <> 'text' OR NOT (text LIKE 'Section%')) AS body FROM i GROUP BY g, island)
SELECT g, pos, type, page, CASE WHEN type = 'text' THEN '## section ' || sec || chr(10) || chr(10) || body ELSE body END AS text FROM a WHERE type <> 'text' OR body IS NOT NULL
"""


@query("win06_island_merge", MERGE_SQL)
def _(t):
    e = t.lineitem.select(
        F.col("l_orderkey").alias("g"), line_place().alias("pos"), F.when(F.col("l_returnflag") == "R", "image").otherwise("text").alias("type"),
        (F.col("l_suppkey") % 3).alias("section"), F.concat(F.lit("section "), (F.col("l_suppkey") % 3).cast("string")).alias("title"), F.col("l_linenumber").alias("page"),
        F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("Section "), (F.col("l_suppkey") % 3).cast("string"), F.lit(".."))).otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("text"),
    )
    return islands.merge_by_section(e, ["g"], "pos")


HEADING_SQL = """
WITH e AS (SELECT l_orderkey AS g, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity::BIGINT AS pos, CASE WHEN l_returnflag = 'R' THEN 'table' ELSE 'text' END AS type, l_linenumber AS page,
  CASE WHEN l_partkey % 5 = 0 THEN '1.' || l_linenumber || ' Heading ' || l_partkey ELSE 'part ' || l_partkey END AS text, l_partkey % 5 = 0 AND l_returnflag <> 'R' AS h FROM lineitem),
f AS (SELECT *, CASE WHEN type = 'text' AND NOT h AND lag(type) OVER (PARTITION BY g ORDER BY pos) = 'text' THEN 0 ELSE 1 END AS b FROM e),
i AS (SELECT *, sum(b) OVER (PARTITION BY g ORDER BY pos) AS island FROM f)
SELECT g, min(pos) AS pos, any_value(type) AS type, arg_min(page, pos) AS page, string_agg(CASE WHEN h THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY pos) AS text FROM i GROUP BY g, island
"""


@query("win07_heading_carry", HEADING_SQL)
def _(t):
    k = F.col("l_partkey")
    e = t.lineitem.select(
        F.col("l_orderkey").alias("g"), line_place().alias("pos"), F.when(F.col("l_returnflag") == "R", "table").otherwise("text").alias("type"), F.col("l_linenumber").alias("page"),
        F.when(k % 5 == 0, F.concat(F.lit("1."), F.col("l_linenumber").cast("string"), F.lit(" Heading "), k.cast("string"))).otherwise(F.concat(F.lit("part "), k.cast("string"))).alias("text"),
    )
    return islands.carry_heading(e, ["g"], "pos")


BUDGET_SQL = """
WITH r AS (SELECT source, doc_id, text, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'en' THEN 0 ELSE 1 END, doc_id) AS k FROM documents),
o AS (SELECT source, min(k) AS k FROM r WHERE before + n > 20000 GROUP BY source)
SELECT r.source, doc_id, CASE WHEN before + n <= 20000 THEN n ELSE (20000 - before)::BIGINT END::BIGINT AS taken FROM r LEFT JOIN o USING (source) WHERE (o.k IS NULL OR r.k <= o.k) AND (before + n <= 20000 OR 20000 - before - 18 > 500)
"""


@query("win08_budget_take", BUDGET_SQL)
def _(t):
    took = rank.budget_take(t.documents.select("source", "doc_id", "lang", "text"), ["source"], [F.when(F.col("lang") == "en", 0).otherwise(1), F.col("doc_id")], "text", 20000)
    return took.select("source", "doc_id", F.length("text").cast("long").alias("taken"))


@query("win09_recent_distinct", "WITH l AS (SELECT event_type, user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::BIGINT AS position FROM l) SELECT event_type, user_id, position FROM r WHERE position <= 10")
def _(t):
    return rank.recent_distinct(t.events.select("event_type", "user_id", "ts", "event_id"), ["event_type"], "user_id", ["ts", "event_id"]).select("event_type", "user_id", "position")


@query("win10_prefix_budget", "WITH r AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) SELECT conv_id, substr(string_agg(text, chr(10) ORDER BY turn), 1, 600) AS text FROM r WHERE before < 600 GROUP BY conv_id")
def _(t):
    return rank.prefix_budget(t.conversations, ["conv_id"], [F.col("turn")], "text", 600)


@query("win11_set01_topk_or_threshold", "SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 5 OR c_acctbal >= 9000")
def _(t):
    return rank.top_k_or_threshold(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey", 5, 9000.0).select("c_custkey")


FUNNEL_SQL = """
WITH s AS (SELECT 0 AS g, 'r' || r_regionkey AS entry_id, NULL AS parent_id, 1 AS level, r_regionkey / 5.0 AS score FROM region
  UNION ALL SELECT 0, 'n' || n_nationkey, 'r' || n_regionkey, 2, n_nationkey / 25.0 FROM nation UNION ALL SELECT 0, 'c' || c_custkey, 'n' || c_nationkey, 3, (c_custkey % 10) / 10.0 FROM customer),
q AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, entry_id) AS n FROM s WHERE level = 1) WHERE n <= 2 OR score >= 0.7),
t AS (SELECT * FROM s WHERE level = 2 AND parent_id IN (SELECT entry_id FROM q)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, entry_id) AS n FROM t) WHERE n <= 2 OR score >= 0.7)
SELECT entry_id, level FROM s WHERE level = 1 UNION ALL SELECT entry_id, level FROM t UNION ALL SELECT entry_id, level FROM s WHERE level = 3 AND parent_id IN (SELECT entry_id FROM u)
"""


@query("win12_relevance_funnel", FUNNEL_SQL)
def _(t):
    s = t.region.selectExpr("0 AS g", "concat('r', r_regionkey) AS entry_id", "cast(NULL AS string) AS parent_id", "1 AS level", "r_regionkey / 5.0D AS score")
    s = s.unionByName(t.nation.selectExpr("0 AS g", "concat('n', n_nationkey) AS entry_id", "concat('r', n_regionkey) AS parent_id", "2 AS level", "n_nationkey / 25.0D AS score"))
    s = s.unionByName(t.customer.selectExpr("0 AS g", "concat('c', c_custkey) AS entry_id", "concat('n', c_nationkey) AS parent_id", "3 AS level", "(c_custkey % 10) / 10.0D AS score"))
    return relevance.relevance_funnel(s, ["g"], 2, 0.7).select("entry_id", "level")


@query("win13_chunk_fixed", "SELECT doc_id, i::BIGINT AS pos, substr(text, i * 1000 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(((length(text) + 999) // 1000)::BIGINT)) AS i FROM documents)")
def _(t):
    return t.documents.select("doc_id", F.posexplode(T.chunks_fixed(F.col("text"), 1000)).alias("pos", "chunk")).withColumn("pos", F.col("pos").cast("long"))


@query("win14_snippet", "WITH h AS (SELECT doc_id, string_split(text, chr(10)) AS ls, list_position(list_transform(string_split(text, chr(10)), lambda x: contains(lower(x), 'tion')), true) AS hit FROM documents WHERE contains(lower(text), 'tion')) SELECT doc_id, array_to_string(ls[greatest(hit - 2, 1):hit + 2], chr(10)) AS snippet FROM h")
def _(t):
    return t.documents.where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id", search.snippet(F.col("text"), F.lit("tion")).alias("snippet"))


# --- order, limits, sets ---


@query("ord03_score_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)::BIGINT AS position FROM customer")
def _(t):
    return rank.top_n(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 1 << 30).select("c_custkey", "position")


@query("lim01_single_latest", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def _(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id")


@query("lim02_first_fifty", "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n <= 50")
def _(t):
    return rank.top_n(t.lineitem, ["l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 50).select("l_orderkey", "l_partkey")


@query("lim05_last_by_filter", "SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(t):
    return t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))


@query("lim06_every_fifth", "SELECT event_id FROM events WHERE event_id % 5 = 0")
def _(t):
    return t.events.where("event_id % 5 = 0").select("event_id")


@query("set02_union_of_levels", "SELECT p_partkey FROM part WHERE p_size = 1 UNION ALL SELECT p_partkey FROM part WHERE p_size <= 2")
def _(t):
    return t.part.where("p_size = 1").select("p_partkey").unionByName(t.part.where("p_size <= 2").select("p_partkey"))


@query("set04_selected_or_deferred", "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'extracting' ELSE 'deferred' END AS state FROM orders")
def _(t):
    chosen = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_s", F.lit(True))
    return t.orders.select("o_orderkey").join(chosen, "o_orderkey", "left").select("o_orderkey", F.when(F.col("_s"), "extracting").otherwise("deferred").alias("state"))


@query("set06_array_difference", "SELECT conv_id, array_to_string(list_sort(list_filter(list_distinct(list(role)), lambda x: x NOT IN ('system', 'tool'))), ',') AS roles FROM conversations GROUP BY conv_id")
def _(t):
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.array_except(F.collect_set("role"), F.array(F.lit("system"), F.lit("tool")))), ",").alias("roles"))


@query("set07_default_chapter", "WITH b AS (SELECT c_custkey, 500 + c_nationkey AS total FROM customer), ch AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS number, o_orderstatus AS title, (o_orderkey % 400)::INT AS page_start, coalesce(lead((o_orderkey % 400)::INT) OVER w - 1, total) AS page_end FROM orders JOIN b ON c_custkey = o_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY (o_orderkey % 400)::INT, o_orderkey)) SELECT o_custkey, number, title, page_start, page_end FROM ch UNION ALL SELECT c_custkey, 1, 'Full Document', 1, total FROM b WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    books = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.lit(500) + F.col("c_nationkey")).alias("total"))
    ch = t.orders.select("o_custkey", F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("title"), (F.col("o_orderkey") % 400).cast("int").alias("page"))
    return toc.chapters_with_default(ch, books, "o_custkey", "total")


# --- scalar functions ---


@query("fn03_fn04_fn06_strings", "SELECT p_partkey, rtrim(p_name || '...', '.') AS a, substr(p_name, 1, 4) AS b, replace(p_type, ' ', '_') AS c, regexp_matches(p_brand, '^Brand#[12]') AS d FROM part")
def _(t):
    return t.part.select("p_partkey", F.regexp_replace(F.concat("p_name", F.lit("...")), r"\.+$", "").alias("a"), F.substring("p_name", 1, 4).alias("b"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("c"), F.col("p_brand").rlike("^Brand#[12]").alias("d"))


@query("fn08_regex_groups", r"SELECT p_partkey, regexp_extract('- [USES] ' || p_name || ' (aliases: a, b)', '^- \[([A-Z]+)\] (.*?)(?: \(aliases: ([^)]*)\))?$', 2) AS name FROM part")
def _(t):
    line = F.concat(F.lit("- [USES] "), "p_name", F.lit(" (aliases: a, b)"))
    return t.part.select("p_partkey", F.regexp_extract(line, r"^- \[([A-Z]+)\] (.*?)(?: \(aliases: ([^)]*)\))?$", 2).alias("name"))


@query("fn09_fn18_fenced_json", "SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN json_extract_string(props, '$.k') END AS k FROM events")
def _(t):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("no json here")
    return t.events.select("event_id", T.parse_json(said, "k string")["k"].alias("k"))


@query("fn14_clamp", "SELECT c_custkey, greatest(0.0, least(1.0, c_acctbal / 5000)) AS x FROM customer")
def _(t):
    return t.customer.select("c_custkey", T.clamp(F.col("c_acctbal") / 5000).alias("x"))


@query("fn15_src16_mask", "SELECT c_custkey, CASE WHEN length(v) <= 4 THEN v ELSE '****...' || right(v, 4) END AS v FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'abcd' ELSE c_name END AS v FROM customer)")
def _(t):
    v = F.when(F.col("c_custkey") % 5 == 0, "abcd").otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", T.mask(v).alias("v"))


@query("fn16_fn17_safe_values", "SELECT c_custkey, coalesce(try_cast(CASE WHEN c_custkey % 2 = 0 THEN '0.25' ELSE 'high' END AS DOUBLE), 1.0) AS x, CASE WHEN lower(c_mktsegment) IN ('building', 'household') THEN lower(c_mktsegment) ELSE 'concept' END AS e FROM customer")
def _(t):
    v = F.when(F.col("c_custkey") % 2 == 0, "0.25").otherwise("high")
    return t.customer.select("c_custkey", T.safe_double(v).alias("x"), T.clamp_enum(F.concat(F.lit(" "), "c_mktsegment"), ["building", "household"], "concept").alias("e"))


@query("fn20_url_parts", r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, lower(regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '\.([A-Za-z0-9]+)$', 1)) AS suffix FROM pages")
def _(t):
    return t.pages.select("page_id", T.url_host(F.col("url")).alias("host"), T.url_suffix(F.col("url")).alias("suffix"))


@query("fn21_frames", "SELECT conv_id, turn, role AS chunk FROM conversations a WHERE turn % 4 <> 2 AND turn < coalesce((SELECT min(turn) FROM conversations b WHERE b.conv_id = a.conv_id AND turn >= 5 AND turn % 4 <> 2), 1000)")
def _(t):
    line = F.when(F.col("turn") % 4 == 2, "lost").when(F.col("turn") >= 5, "data: [DONE]").otherwise(F.concat(F.lit("data: "), "role"))
    return chunks.decode_frames(t.conversations.select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line")


@query("fn24_fn25_fn26_titles_links", "SELECT p_partkey, replace(p_name, ' ', ' ') AS title, CASE WHEN p_partkey % 3 = 0 THEN 'x note' ELSE p_name || chr(10) || chr(10) || 'note' END AS told, CASE WHEN p_partkey % 4 IN (0, 1) THEN 'https://example.org' ELSE 'https://ok.example/' || p_partkey END AS link FROM part")
def _(t):
    k = F.col("p_partkey")
    path = F.concat(F.lit("/a/b/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".pdf"))
    link = F.when(k % 4 == 0, "").when(k % 4 == 1, "https://LibGen.example/x").otherwise(F.concat(F.lit("https://ok.example/"), k.cast("string")))
    return t.part.select("p_partkey", T.path_title(path).alias("title"), T.ensure_suffix(F.when(k % 3 == 0, "x note").otherwise(F.col("p_name")), "note").alias("told"), T.safe_link(link, "https://example.org").alias("link"))


# the variables that the equation below has, in the order of the steps: of the derivative, with
# subscripts, single letters
@query("fn10_fn13_equation_variables", "SELECT p_partkey, 'f,x,omega_c,T_' || (p_partkey % 7) || ',g,y' AS variables, true AS is_parseable FROM part")
def _(t):
    eq = F.concat(F.lit(r"$$\omega_{c} = \sqrt{g/y} + T_{"), (F.col("p_partkey") % 7).cast("string"), F.lit(r"} \frac{\partial f}{\partial x}$$"))
    return t.part.select("p_partkey", T.parse_equation(eq).alias("e")).select("p_partkey", F.array_join("e.variables", ",").alias("variables"), "e.is_parseable")


# --- scans by key, guards and records ---


@query("src04_by_key_in_order", "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber)::BIGINT AS position FROM lineitem")
def _(t):
    return scans.positions(t.lineitem, ["l_orderkey"], [F.col("l_partkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_partkey", "position")


@query("src05_by_key", "SELECT event_id, event_type FROM events WHERE user_id = 7")
def _(t):
    return scans.lookup(t.events, user_id=7).select("event_id", "event_type")


@query("src08_children_of_parent", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey)::BIGINT AS position FROM customer WHERE c_nationkey = 3")
def _(t):
    return scans.positions(scans.lookup(t.customer, c_nationkey=3), ["c_nationkey"], [F.col("c_custkey")]).select("c_custkey", "position")


@query("src12_relevance_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 3, p_size, p_partkey)::BIGINT AS position FROM part")
def _(t):
    return scans.positions(t.part, ["p_brand"], [F.col("p_partkey") % 3, F.col("p_size"), F.col("p_partkey")]).select("p_partkey", "position")


@query("src13_optional_level", "SELECT doc_id, 'one' AS q FROM documents WHERE source = 'src1' AND lang = 'en' UNION ALL SELECT doc_id, 'any' FROM documents WHERE source = 'src1'")
def _(t):
    one, every = scans.lookup(t.documents, source="src1", lang="en"), scans.lookup(t.documents, source="src1", lang=None)
    return one.select("doc_id", F.lit("one").alias("q")).unionByName(every.select("doc_id", F.lit("any").alias("q")))


@query("src17_summary_by_key", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id = 8")
def _(t):
    return scans.lookup(t.labels, doc_id=8).select("doc_id", "quality", "toxic")


@query("src21_bookmarks", "SELECT n_nationkey AS book, 0::BIGINT AS pos, 1::BIGINT AS level, n_name AS title, (n_nationkey + 1)::BIGINT AS page FROM nation UNION ALL SELECT n_nationkey, 2, 2, 'Part', (n_nationkey + 5)::BIGINT FROM nation")
def _(t):
    outline = F.concat(F.lit('[[1, "'), F.col("n_name"), F.lit('", '), (F.col("n_nationkey") + 1).cast("string"), F.lit('], ["x"], [2, "Part", '), (F.col("n_nationkey") + 5).cast("string"), F.lit("]]"))
    return records.bookmarks(t.nation.select(F.col("n_nationkey").alias("book"), outline.alias("outline")), ["book"], "outline")


@query("src22_page_range_text", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn BETWEEN 1 AND 3 GROUP BY conv_id")
def _(t):
    return records.pages_text(t.conversations, ["conv_id"], "turn", "text", F.lit(1), F.lit(3))


ROUTED_SQL = "WITH e AS (SELECT l_orderkey % 10 AS grp, l_orderkey, l_linenumber, l_partkey, l_partkey % 40 AS page, CASE l_suppkey % 5 WHEN 0 THEN 'discarded' WHEN 1 THEN 'image' WHEN 2 THEN 'header' WHEN 3 THEN 'table' ELSE 'text' END AS type FROM lineitem), c AS (SELECT g.range AS grp, i.range AS chapter, i.range * 8 AS lo, i.range * 8 + 9 AS hi FROM range(10) g, range(5) i) SELECT l_orderkey, l_linenumber, l_partkey, chapter, CASE WHEN type = 'image' THEN 'figure' ELSE type END AS content_type FROM (SELECT e.*, chapter, row_number() OVER (PARTITION BY e.grp, l_orderkey, l_linenumber, l_partkey, page, type ORDER BY lo) AS n FROM e JOIN c ON e.grp = c.grp AND page BETWEEN lo AND hi) WHERE n = 1 AND type IN ('text', 'table', 'image')"


@query("src24_routed_to_chapters", ROUTED_SQL)
def _(t):
    kinds = F.element_at(F.array(*map(F.lit, ("discarded", "image", "header", "table", "text"))), (F.col("l_suppkey") % 5 + 1).cast("int"))
    e = t.lineitem.select((F.col("l_orderkey") % 10).alias("grp"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 40).alias("page"), files.content_type(kinds).alias("content_type")).where("content_type IS NOT NULL").distinct()
    c = t.rows([(g, i, i * 8, i * 8 + 9) for g in range(10) for i in range(5)], "grp long, chapter long, lo long, hi long")
    return interval.assign_first(e, c, ["grp"], "page", "lo", "hi", "chapter").select("l_orderkey", "l_linenumber", "l_partkey", "chapter", "content_type")


@query("src27_src29_reader_by_suffix", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'docx' WHEN 1 THEN NULL WHEN 2 THEN 'md' ELSE NULL END AS reader FROM part")
def _(t):
    path = F.concat(F.lit("/in/a.b/"), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, (".DocX", ".pdf", ".md", "/noext"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return t.part.select("p_partkey", records.reader_for(path).alias("reader"))


@query("snk06_append_nothing", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def _(t):
    have = t.supplier.select("s_suppkey", "s_name")
    new = t.customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name"))
    return mutate.append(mutate.append(have, new.where("false")), new)


@query("snk17_page_cache", "SELECT conv_id, '{' || string_agg('\"' || turn || '\":\"' || role || '\"', ',' ORDER BY turn) || '}' AS cache FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY conv_id")
def _(t):
    return records.page_cache(t.conversations.select("conv_id", "turn", "role").distinct(), ["conv_id"], "turn", "role")


@query("prj02_camel_case", 'SELECT c_custkey AS "cCustkey", c_name AS "cName" FROM customer')
def _(t):
    return scans.camel_case(t.customer.select("c_custkey", "c_name"))


@query("prj04_progress_status", "SELECT d.doc_id, coalesce(CASE WHEN toxic = 0 THEN 'done' END, 'pending') AS status FROM documents d LEFT JOIN labels USING (doc_id)")
def _(t):
    return scans.with_status(t.documents.select("doc_id"), t.labels.select("doc_id", F.when(F.col("toxic") == 0, "done").alias("status")), "doc_id", "status", "pending")


@query("prj10_topics_or_empty", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS topics FROM customer")
def _(t):
    raw = F.when(F.col("c_custkey") % 3 == 0, "not json").otherwise(F.concat(F.lit('[{"title": "'), "c_name", F.lit('"}]')))
    return t.customer.select("c_custkey", F.array_join(F.transform(T.parse_json_list(raw, "struct<title: string>"), lambda x: x["title"]), ",").alias("topics"))


@query("prj12_typed_description", "SELECT p_partkey, p_name AS summary, 'a:' || CASE WHEN p_partkey % 2 = 0 THEN 'EXPLAINS' ELSE 'USES' END || ':0' AS concepts FROM part")
def _(t):
    made = F.concat(F.lit('```json\n{"summary": "'), "p_name", F.lit('", "key_concepts": [{"name": "a", "classification": "'), F.when(F.col("p_partkey") % 2 == 0, "explains").otherwise("other"), F.lit('"}, {"name": ""}]}\n```'))
    d = t.part.select("p_partkey", records.typed_description(made).alias("d"))
    return d.select("p_partkey", "d.summary", F.array_join(F.transform("d.key_concepts", lambda x: F.concat_ws(":", x["name"], x["classification"], F.size(x["aliases"]).cast("string"))), ",").alias("concepts"))


@query("prj13_flow_nodes", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'chapterNode' WHEN 1 THEN 'sectionNode' ELSE 'conceptNode' END AS type, replace(p_name, ' ', ' ') AS label FROM part")
def _(t):
    level = F.element_at(F.array(*map(F.lit, ("chapter", "section", "other"))), (F.col("p_size") % 3 + 1).cast("int"))
    return scans.flow_nodes(t.part.select("p_partkey", level.alias("level"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("title")), "level", "title").select("p_partkey", "type", "label")


@query("flt01_null_or_blank", "SELECT c_custkey FROM customer WHERE c_nationkey = 4 AND (nullif(c_mktsegment, 'BUILDING') IS NULL OR c_mktsegment = '')")
def _(t):
    return scans.lookup(t.customer, c_nationkey=4).where(scans.blank(F.nullif("c_mktsegment", F.lit("BUILDING")))).select("c_custkey")


@query("flt02_in_set", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(t):
    return scans.in_set(t.orders.select("o_orderkey", "o_custkey"), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey", "o_custkey")


@query("flt11_split_by_class", "SELECT doc_id, quality::BIGINT AS kind FROM labels WHERE quality IN (0, 1)")
def _(t):
    parts = scans.split_by(t.labels, "quality", [0, 1])
    return parts[0].select("doc_id", F.lit(0).cast("long").alias("kind")).unionByName(parts[1].select("doc_id", F.lit(1).cast("long").alias("kind")))


@query("flt13_status_differs", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'P') IS DISTINCT FROM 'F'")
def _(t):
    return t.orders.where(scans.differs(F.nullif("o_orderstatus", F.lit("P")), "F")).select("o_orderkey")


@query("flt20_state_guard", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN 'expected O, is ' || o_orderstatus END AS rejected FROM orders")
def _(t):
    return scans.guard(t.orders, "o_orderstatus", "O").select("o_orderkey", "rejected")


@query("flt21_extracted_only", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def _(t):
    return scans.in_set(t.documents, scans.lookup(t.labels, quality=1), "doc_id").select("doc_id")


@query("ord01_mixed_directions", "SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_suppkey, l_linenumber DESC)::BIGINT AS position FROM lineitem")
def _(t):
    return scans.positions(t.lineitem, ["l_orderkey"], [F.desc("l_quantity"), F.col("l_suppkey"), F.desc("l_linenumber")]).select("l_orderkey", "l_linenumber", "l_suppkey", "position")


@query("ord04_by_page", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)::BIGINT AS position FROM part")
def _(t):
    return scans.positions(t.part, ["p_brand"], [F.col("p_size"), F.col("p_partkey")]).select("p_partkey", "position")


@query("ord05_by_path", "SELECT page_id, row_number() OVER (PARTITION BY lang ORDER BY url, page_id)::BIGINT AS position FROM (SELECT page_id, url, coalesce(regexp_extract(html, 'lang=.(..)', 1), '') AS lang FROM pages)")
def _(t):
    return scans.positions(t.pages.select("page_id", "url", F.coalesce(F.regexp_extract("html", "lang=.(..)", 1), F.lit("")).alias("lang")), ["lang"], [F.col("url"), F.col("page_id")]).select("page_id", "position")


@query("lim03_top_five_parents", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 5")
def _(t):
    return rank.top_n(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 5).select("c_nationkey", "c_custkey")


@query("lim04_first_pages", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n <= 3")
def _(t):
    return rank.top_n(t.conversations, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], 3).select("conv_id", "turn")


@query("set03_union_of_lists", "SELECT c_nationkey AS k, c_custkey AS id FROM customer UNION ALL SELECT s_nationkey, s_suppkey FROM supplier UNION ALL SELECT s_nationkey, s_suppkey FROM supplier")
def _(t):
    s = t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    return mutate.append(mutate.append(t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id")), s), s)


@query("fn27_prompt", "SELECT p_partkey, 'Rate ' || p_name || ' (' || p_size || '): ' || p_name || '.' AS prompt FROM part")
def _(t):
    return t.part.select("p_partkey", records.fill("Rate {name} ({size}): {name}.", name=F.col("p_name"), size=F.col("p_size")).alias("prompt"))


@query("fn29_fn30_numbers_lists", "SELECT p_partkey, abs(p_size - 25)::BIGINT AS gap, greatest(p_size, 10)::BIGINT AS most, least(p_size, 10)::BIGINT AS few, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS names FROM part")
def _(t):
    size = F.col("p_size").cast("long")
    names = F.array(F.col("p_brand"), F.lit(" "), F.col("p_type"), F.col("p_brand"), F.lit(None))
    return t.part.select("p_partkey", F.abs(size - 25).alias("gap"), F.greatest(size, F.lit(10).cast("long")).alias("most"), F.least(size, F.lit(10).cast("long")).alias("few"), F.array_join(records.distinct_in_order(names), "|").alias("names"))


@query("fn31_data_url", "SELECT p_partkey, 'data:image/' || CASE p_partkey % 3 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' ELSE 'png' END || ';base64,' || base64(encode(p_name)) AS url FROM part")
def _(t):
    suffix = F.element_at(F.array(*map(F.lit, ("JPG", "png", "bmp"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", records.data_url(F.encode("p_name", "UTF-8"), suffix).alias("url"))


# --- wide intervals, large groups, deep trees, streams ---


@query("jn01_wide_intervals", "WITH p AS (SELECT o_orderkey, o_orderkey * 7919000003 AS page FROM orders), i AS (SELECT p_partkey AS sec, p_partkey * 3000000017 AS lo, p_partkey * 3000000017 + p_size * 20000000000 AS hi FROM part) SELECT o_orderkey, sec FROM (SELECT o_orderkey, sec, row_number() OVER (PARTITION BY o_orderkey ORDER BY lo, sec) AS n FROM p JOIN i ON page BETWEEN lo AND hi) WHERE n = 1")
def _(t):
    p = t.orders.select("o_orderkey", F.lit(0).alias("g"), (F.col("o_orderkey") * 7919000003).alias("page"))
    i = t.part.select(F.lit(0).alias("g"), F.col("p_partkey").alias("sec"), (F.col("p_partkey") * 3000000017).alias("lo"), (F.col("p_partkey") * 3000000017 + F.col("p_size") * F.lit(20000000000)).alias("hi"))
    return interval.assign_first(p, i, ["g"], "page", "lo", "hi", "sec").select("o_orderkey", "sec")


@query("win04_one_group", "SELECT event_id, coalesce(first_value(CASE WHEN x > 0 THEN x END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), x) AS x FROM (SELECT event_id, CASE WHEN event_id % 7 < 5 THEN 0 ELSE event_id END AS x FROM events)")
def _(t):
    e = t.events.select("event_id", F.lit(0).alias("g"), F.when(F.col("event_id") % 7 < 5, 0).otherwise(F.col("event_id")).alias("x"))
    return islands.backfill_positive(e, ["g"], ["event_id"], "x", spread=True).select("event_id", "x")


@query("win06_one_group", "WITH f AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS b FROM events) SELECT event_id, event_type, sum(b) OVER (ORDER BY event_id)::BIGINT AS island FROM f")
def _(t):
    return islands.key_islands(t.events.select("event_id", "event_type", F.lit(0).alias("g")), ["g"], ["event_id"], "event_type", spread=True).select("event_id", "event_type", "island")


@query("win08_one_group", "SELECT doc_id, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS before, lag(lang) OVER v AS prev, lead(lang) OVER v AS next FROM documents WINDOW v AS (ORDER BY doc_id), w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(t):
    d = ordered.Ordered(t.documents.select("doc_id", "lang", F.length("text").alias("n"), F.lit(0).alias("g")), ["g"], ["doc_id"], spread=True)
    d.add(before=ordered.sum_before(F.col("n")), _p=ordered.previous(F.col("lang")), _f=ordered.following(F.col("lang")))
    return d.done().select("doc_id", "before", F.col("_p.v").alias("prev"), F.col("_f.v").alias("next"))


CHAIN_SQL = """
WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 <> 0 THEN lag(o_orderkey) OVER (ORDER BY o_orderkey) END AS up FROM orders)
SELECT id, row_number() OVER (PARTITION BY g ORDER BY id) AS depth FROM (SELECT id, count(*) FILTER (up IS NULL) OVER (ORDER BY id) AS g FROM t)
"""


@query("jn06_deep_chains", CHAIN_SQL)
def _(t):
    o = ordered.Ordered(t.orders.select(F.col("o_orderkey").alias("id"), F.lit(0).alias("g")), ["g"], ["id"], spread=True).add(_p=ordered.previous(F.col("id"))).done()
    return tree.depths(o.select("id", F.when(F.col("id") % 97 != 0, F.col("_p.v")).alias("up")), "id", "up")


LAYERS_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'p' || l_partkey AS s, 's' || l_suppkey AS t FROM lineitem
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0 UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT 'p' || p_partkey, 'r' || (p_partkey % 5) FROM part),
v AS (SELECT s AS k FROM e UNION SELECT t FROM e),
w(k, layer) AS (SELECT k, 0 FROM v WHERE k NOT IN (SELECT t FROM e) UNION SELECT e.t, w.layer + 1 FROM w JOIN e ON e.s = w.k)
SELECT k, max(layer)::INTEGER AS layer FROM w GROUP BY k
"""


@query("prj16_layers", LAYERS_SQL)
def _(t):
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    e = t.lineitem.select(named("p", "l_partkey").alias("s"), named("s", "l_suppkey").alias("t"))
    e = e.unionByName(t.supplier.where("s_suppkey % 3 <> 0").select(named("s", "s_suppkey").alias("s"), named("n", "s_nationkey").alias("t")))
    e = e.unionByName(t.nation.select(named("n", "n_nationkey").alias("s"), named("r", "n_regionkey").alias("t")))
    e = e.unionByName(t.part.select(named("p", "p_partkey").alias("s"), F.concat(F.lit("r"), (F.col("p_partkey") % 5).cast("string")).alias("t")))
    return tree.layers(e.select(F.col("s").alias("k")).union(e.select("t")), e, "k", "s", "t")


@query("src31_streamed_chunks", "SELECT conv_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn, role, text) AS message, true AS closed FROM conversations GROUP BY conv_id")
def _(t):
    whole = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("text"))
    cut = whole.select("conv_id", F.posexplode(F.concat(T.chunks_fixed(F.col("text"), 400), F.array(F.lit(chunks.DONE)))).alias("seq", "chunk"))
    # a restarted stream repeats some chunks, and files hold them out of order
    sent = cut.unionByName(cut.where("seq % 3 = 1")).withColumn("seq", F.col("seq").cast("long"))
    once = state.drained(state.in_order(state.replayed(sent), "conv_id", "seq", "chunk"))
    told = chunks.join_chunks(once.where("NOT closed"), "conv_id", "seq", "chunk")
    return told.join(once.where("closed").select("conv_id", "closed"), "conv_id")


@query("snk23_ring_buffer", "SELECT user_id, position, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::BIGINT AS position FROM events) WHERE position <= 5")
def _(t):
    e = t.events.select("user_id", F.unix_micros("ts").alias("at") if dict(t.events.dtypes)["ts"] == "timestamp" else F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    kept = state.ring(state.replayed(e), "user_id", F.col("at"), F.col("event_id"), F.col("event_type"), 5)
    return state.newest(state.drained(kept), "user_id").select("user_id", "position", F.col("tie").alias("event_id"), F.col("payload").alias("event_type"))


# --- equations of several forms ---


EQUATIONS_SQL = """
WITH a AS (SELECT p_partkey, p_partkey % 6 AS form, chr((97 + p_partkey % 26)::INTEGER) AS a FROM part),
l AS (SELECT p_partkey, form, CASE form WHEN 0 THEN ['alpha', a, 'B'] WHEN 1 THEN [a, 't'] WHEN 2 THEN [a || '_omega', 'n'] WHEN 3 THEN ['theta', a, 'b'] WHEN 4 THEN []::VARCHAR[] ELSE [a, 'f', 'x'] END AS names FROM a),
u AS (SELECT p_partkey, unnest(names) AS name, unnest(range(len(names))) AS nr FROM l),
d AS (SELECT p_partkey, name, min(nr) AS nr FROM u WHERE name NOT IN ('e', 'i') GROUP BY ALL)
SELECT l.p_partkey, coalesce(v, '') AS variables, form <> 4 AS is_parseable
FROM l LEFT JOIN (SELECT p_partkey, string_agg(name, ',' ORDER BY nr) AS v FROM d GROUP BY p_partkey) USING (p_partkey)
"""


@query("fn10_fn13_equation_forms", EQUATIONS_SQL)
def _(t):
    forms = [r"$$\vec{%} \cdot \mathbf{B \alpha}$$", r"\frac{\partial %}{\partial t} + %^{2}", r"\sum_{k=1}^{n} %_{\omega} \llap{z}", r"\\  \theta = %_b", None, r"\int_{0}^{%} f(x) \, dx"]
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 6 + 1).cast("int"))
    eq = F.replace(form, F.lit("%"), F.chr(97 + F.col("p_partkey") % 26))
    return t.part.select("p_partkey", T.parse_equation(eq).alias("e")).select("p_partkey", F.array_join("e.variables", ",").alias("variables"), "e.is_parseable")


# --- files: the tables written as files and read again ---


def by_files(t: Tables, name: str, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What read makes of the files that write puts in a folder of its own; the rows are written
    before the folder goes."""
    folder = scratch(t._spark, name)
    write(folder)
    rows = written(read(folder), f"{name}-rows")
    files.delete_files(t._spark, folder)
    return rows


@query("snk16_src19_chapter_files", "SELECT conv_id::VARCHAR AS book, (turn + 1)::VARCHAR AS chapter, row_number() OVER (PARTITION BY conv_id ORDER BY (turn + 1)::VARCHAR)::BIGINT AS position, sha256(text) AS content_sha256 FROM conversations WHERE text <> ''")
def _(t):
    chapters = t.conversations.select(F.col("conv_id").cast("string").alias("book"), (F.col("turn") + 1).alias("number"), F.col("text").alias("content"))
    read = lambda folder: files.chapter_files(t._spark, folder).select("book", "chapter", "position", F.sha2("content", 256).alias("content_sha256"))
    return by_files(t, "snk16", lambda folder: sinks.write_chapters(chapters, folder), read)


@query("src20_chapter_or_blank", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE '' END AS content FROM conversations")
def _(t):
    chapters = t.conversations.select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("k"))
    there = t.conversations.where("turn % 2 = 0").select(F.col("conv_id").alias("book"), F.col("turn").alias("number"), F.col("text").alias("content"))
    texts = lambda folder: files.chapter_files(t._spark, folder).select(F.concat_ws("/", "book", "chapter").alias("k"), "content")
    return by_files(t, "src20", lambda folder: sinks.write_chapters(there, folder), lambda folder: files.chapter_text(chapters, texts(folder), "k").drop("k"))


ENTRY_FILES_SQL = """
WITH e AS (SELECT coalesce(source, 'none') AS book, coalesce(lang, 'none') AS chapter, doc_id, text, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i FROM documents),
n AS (SELECT book, chapter, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'figure' END || '_' || i AS entry, text FROM e WHERE doc_id % 4 <> 3)
SELECT book, chapter, entry, row_number() OVER (PARTITION BY book ORDER BY chapter || '/content/' || entry || '.md')::BIGINT AS position, sha256(text) AS content_sha256 FROM n WHERE text <> ''
"""


@query("snk14_src18_entry_files", ENTRY_FILES_SQL)
def _(t):
    named = t.documents.select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("book"), F.coalesce("lang", F.lit("none")).alias("chapter"))
    kind = F.element_at(F.array(*map(F.lit, ("text", "table", "image", "aside"))), (F.col("doc_id") % 4 + 1).cast("int"))
    entries = named.withColumn("index", F.row_number().over(Window.partitionBy("book", "chapter").orderBy("doc_id")))
    entries = entries.select("book", "chapter", "index", files.content_type(kind).alias("content_type"), F.col("text").alias("content"))

    def read(folder: str) -> DataFrame:
        rows = files.whole_texts(t._spark, folder)
        part = lambda n: F.regexp_extract("path", r"([^/]+)/chapters/([^/]+)/content/([^/]+)\.md$", n)
        rows = rows.select(part(1).alias("book"), part(2).alias("chapter"), part(3).alias("entry"), "path", "content")
        return rows.select("book", "chapter", "entry", F.row_number().over(Window.partitionBy("book").orderBy("path")).cast("long").alias("position"), F.sha2("content", 256).alias("content_sha256"))

    return by_files(t, "snk14", lambda folder: sinks.write_content(entries, folder), read)


@query("snk18_new_files_only", "SELECT CASE p_size % 4 WHEN 0 THEN 'lectures' WHEN 1 THEN 'exams' ELSE 'other' END AS folder, p_partkey || ' ' || p_name || '+%' AS name, CASE WHEN p_partkey % 3 = 0 THEN 'first ' ELSE 'second ' END || p_type AS content FROM part")
def _(t):
    cat = F.when(F.col("p_size") % 4 == 0, "lecture_slides").when(F.col("p_size") % 4 == 1, "past_exam_papers").otherwise("mystery")
    made = lambda word: t.part.select(F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit("+%.md")).alias("name"), cat.alias("category"), F.concat(F.lit(word), "p_type").alias("content"), "p_partkey")

    def write(folder: str) -> None:
        sinks.write_new_files(made("first ").where("p_partkey % 3 = 0"), folder)
        sinks.write_new_files(made("second "), folder)

    return by_files(t, "snk18", write, lambda folder: files.whole_texts(t._spark, folder).select(F.col("source").alias("folder"), F.col("chapter").alias("name"), "content"))


LAYOUT_SQL = """
SELECT l_suppkey, (l_partkey % 7 + 1)::INTEGER AS page, string_agg('o' || l_orderkey || '.' || l_linenumber, chr(10) ORDER BY l_orderkey, l_linenumber) AS text
FROM lineitem WHERE l_linenumber % 4 <> 2 AND l_linenumber <> 5 AND l_partkey % 7 <> 6 GROUP BY ALL
"""


@query("src23_layout_files", LAYOUT_SQL)
def _(t):
    kind = F.element_at(F.array(*map(F.lit, ("text", "table", "discarded", "equation"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    text = F.when(F.col("l_linenumber") == 5, "").otherwise(F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")))
    idx = F.when(F.col("l_partkey") % 7 != 6, (F.col("l_partkey") % 7).cast("int"))
    entry = F.struct("l_orderkey", "l_linenumber", kind.alias("type"), text.alias("text"), idx.alias("page_idx"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["type"].alias("type"), e["text"].alias("text"), e["page_idx"].alias("page_idx")))
    made = t.lineitem.groupBy("l_suppkey").agg(F.to_json(listed).alias("content")).withColumn("name", F.concat(F.col("l_suppkey").cast("string"), F.lit("/layout.json")))

    def read(folder: str) -> DataFrame:
        pages = files.layout_pages(files.layout(t._spark, f"{folder}/*/layout.json"), ["path"], F.lit(0))
        return pages.select(F.element_at(F.split("path", "/"), -2).cast("long").alias("l_suppkey"), "page", "text")

    return by_files(t, "src23", lambda folder: write_files(made, folder, unique=True), read)


DESCRIPTION_SQL = """
SELECT p_brand AS source_textbook, p_partkey::VARCHAR AS chapter_number, p_name AS chapter_title, p_size::INTEGER AS page_start, (p_size + 9)::INTEGER AS page_end, 'About ' || p_name || '.' AS summary,
  p_name || '|x,y|EXPLAINS|main;' || p_type || '||USES|aux' AS concepts, CASE WHEN p_partkey % 2 = 0 THEN p_type || ',algebra' ELSE '' END AS prerequisites, p_partkey % 3 = 0 AS has_figures FROM part
"""


@query("src35_snk15_description_files", DESCRIPTION_SQL)
def _(t):
    none = F.array().cast("array<string>")
    concept = lambda name, aliases, kind, text: F.struct(name.alias("name"), aliases.alias("aliases"), F.lit(kind).alias("classification"), F.lit(text).alias("description"))
    name, kind, key = F.col("p_name"), F.col("p_type"), F.col("p_partkey")
    d = F.struct(
        name.alias("chapter_title"), F.col("p_brand").alias("source_textbook"), key.cast("string").alias("chapter_number"), F.struct(F.col("p_size").alias("start"), (F.col("p_size") + 9).alias("end")).alias("page_range"),
        F.concat(F.lit("About "), name, F.lit(".")).alias("summary"), F.array(concept(name, F.array(F.lit("x"), F.lit("y")), "EXPLAINS", "main"), concept(kind, none, "USES", "aux")).alias("key_concepts"),
        F.when(key % 2 == 0, F.array(kind, F.lit("algebra"))).otherwise(none).alias("prerequisites"), none.alias("mathematical_content"), (key % 3 == 0).alias("has_figures"), none.alias("figure_descriptions"),
    )
    made = t.part.select(F.concat(F.col("p_brand"), F.lit("/chapter_"), key.cast("string"), F.lit(".md")).alias("name"), sinks.description_md(d).alias("content"))

    def read(folder: str) -> DataFrame:
        back = files.whole_texts(t._spark, folder).select(sinks.description_from_md(F.col("content")).alias("d")).select("d.*")
        told = F.array_join(F.transform("key_concepts", lambda c: F.concat_ws("|", c["name"], F.array_join(c["aliases"], ","), c["classification"], c["description"])), ";")
        return back.select("source_textbook", "chapter_number", "chapter_title", F.col("page_range.start").alias("page_start"), F.col("page_range.end").alias("page_end"), "summary", told.alias("concepts"), F.array_join("prerequisites", ",").alias("prerequisites"), "has_figures")

    return by_files(t, "src35", lambda folder: write_files(made, folder, unique=True), read)


def _of_ten(t: Tables, suffix: str, *fields: Column) -> tuple[DataFrame, Column]:
    """Parts in order, ten to a file, and the column of a read path that names the ten."""
    rows = F.array_sort(F.collect_list(F.struct("p_partkey", *fields)))
    made = t.part.groupBy(F.expr("p_partkey div 10").alias("k")).agg(rows.alias("rows")).withColumn("name", F.concat(F.lit("m/"), F.col("k").cast("string"), F.lit(suffix)))
    return made, F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("k")


@query("src25_slide_files", "SELECT p_partkey // 10 AS k, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey)::BIGINT AS number, p_name || chr(10) || '<' || p_type || '> & é' AS text FROM part")
def _(t):
    made, k = _of_ten(t, ".pptx", F.concat(F.lit("  "), "p_name", F.lit("\n\n<"), "p_type", F.lit("> & é ")).alias("text"))
    deck = made.select("name", office.slide_deck(F.transform("rows", lambda r: r["text"])).alias("content"))
    return by_files(t, "src25", lambda folder: write_files(deck, folder, unique=True), lambda folder: files.slides(t._spark, folder).select(k, "number", "text"))


SECTIONS_SQL = """
WITH p AS (SELECT p_partkey // 10 AS k, p_partkey * 2 AS o, p_size % 3 = 0 AS heading, p_name AS text FROM part UNION ALL SELECT p_partkey // 10, p_partkey * 2 + 1, false, p_type FROM part WHERE p_size % 2 = 0),
b AS (SELECT *, sum(heading::INTEGER) OVER (PARTITION BY k ORDER BY o) AS b FROM p),
s AS (SELECT k, b, coalesce(max(text) FILTER (heading), 'Introduction') AS title, string_agg(text, chr(10) ORDER BY o) FILTER (NOT heading) AS text FROM b GROUP BY k, b)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY b)::BIGINT AS number, title, text FROM s WHERE text IS NOT NULL
"""


@query("src26_document_files", SECTIONS_SQL)
def _(t):
    made, k = _of_ten(t, ".docx", (F.col("p_size") % 3 == 0).alias("heading"), F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("  ").alias("body"))
    lines = made.select("name", F.flatten(F.transform("rows", lambda r: F.array(F.struct(r["heading"].alias("h"), r["p_name"].alias("t")), F.struct(F.lit(False).alias("h"), r["body"].alias("t"))))).alias("lines"))
    paper = lines.select("name", office.word_document(F.transform("lines", lambda x: x["h"]), F.transform("lines", lambda x: x["t"])).alias("content"))
    return by_files(t, "src26", lambda folder: write_files(paper, folder, unique=True), lambda folder: files.doc_sections(files.doc_paragraphs(t._spark, folder)).select(k, "number", "title", "text"))


# --- chunks and aliases ---


PARAGRAPHS_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents WHERE text <> ''),
c AS (
  SELECT doc_id, 0 AS pos, ''::VARCHAR AS chunk, t AS rest FROM d
  UNION ALL SELECT doc_id, pos + 1, substr(rest, 1, n), substr(rest, n + 1) FROM (
    SELECT *, CASE WHEN length(rest) <= 1000 THEN length(rest) WHEN back BETWEEN 1 AND 998 THEN 999 - back ELSE 1000 END AS n
    FROM (SELECT *, strpos(reverse(substr(rest, 1, 1000)), chr(10) || chr(10)) AS back FROM c WHERE rest <> '')))
SELECT doc_id, (pos - 1)::BIGINT AS pos, sha256(chunk) AS chunk_sha256 FROM c WHERE pos > 0
"""


@query("win13_chunk_paragraphs", PARAGRAPHS_SQL)
def _(t):
    cut = T.chunks_paragraphs(F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")), 1000)
    return t.documents.select("doc_id", F.posexplode(cut).alias("pos", "chunk")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.sha2("chunk", 256).alias("chunk_sha256"))


TABLE_ALIASES_SQL = """
WITH al AS (SELECT DISTINCT lower(p_name || ' ' || p_brand) AS c, lower(p_name || ' ' || p_partkey) AS a FROM part),
n AS (SELECT c, a AS name FROM al UNION SELECT c, c FROM al),
kw AS (SELECT lower(p_name || ' ' || p_partkey) AS k FROM part WHERE p_size < 3 UNION SELECT lower(p_name || ' ' || p_brand) FROM part WHERE p_size = 3 UNION SELECT lower(p_type) FROM part)
SELECT k AS keyword FROM kw UNION SELECT name FROM n WHERE c IN (SELECT c FROM kw JOIN n ON k = name)
"""


@query("jn15_set05_table_aliases", TABLE_ALIASES_SQL)
def _(t):
    brand, part = F.concat_ws(" ", "p_name", "p_brand"), F.concat_ws(" ", "p_name", "p_partkey")
    asked = t.part.where("p_size < 3").select(part.alias("keyword")).union(t.part.where("p_size = 3").select(brand)).union(t.part.select("p_type"))
    return search.expand_keywords(asked, t.part.select(brand.alias("canonical"), part.alias("alias")))


# --- catalog ---


def old_textbooks(t: Tables) -> str:
    """A table of the first schema with the suppliers as its rows, extended twice."""
    name = f"corpusloom_{uuid.uuid4().hex}"
    catalog.create(t._spark, name, schemas.TABLES["textbooks"])
    have = {"id": F.col("s_suppkey").cast("string"), "title": F.col("s_name"), "course": F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey").cast("string"))}
    cols = [c.split()[0] for c in schemas.TABLES["textbooks"].split(", ")]
    t.supplier.select(*(have.get(c, F.lit(None).cast("string")).alias(c) for c in cols)).write.mode("append").saveAsTable(name)
    later = [(c, kind, v) for table, c, kind, v in schemas.ADDED if table == "textbooks"]
    if catalog.add_columns(t._spark, name, later) != [c for c, _, _ in later] or catalog.add_columns(t._spark, name, later):
        raise AssertionError("columns are added once")
    return name


@query("snk13_added_columns", "SELECT s_suppkey::VARCHAR AS id, s_name AS title, NULL::VARCHAR AS course_id, 'uploaded' AS pipeline_status FROM supplier")
def _(t):
    name = old_textbooks(t)
    rows = written(t._spark.table(name).select("id", "title", "course_id", "pipeline_status"), "snk13-rows")
    t._spark.sql(f"DROP TABLE {name}")
    return rows


CATALOG_SQL = """
SELECT position::INTEGER AS position, "column", 'string' AS type, CASE kind WHEN 0 THEN 0 WHEN 1 THEN (SELECT count(*) FROM supplier) ELSE (SELECT count(*) FROM supplier WHERE s_nationkey % 2 = 0) END AS filled
FROM (VALUES (1, 'id', 1), (2, 'title', 1), (3, 'filepath', 0), (4, 'course', 2), (5, 'library_type', 0), (6, 'processed_at', 0), (7, 'created_at', 0), (8, 'course_id', 0), (9, 'pipeline_status', 1)) v(position, "column", kind)
"""


@query("src33_catalog_columns", CATALOG_SQL)
def _(t):
    name = old_textbooks(t)
    cols, rows = catalog.columns(t._spark, name), t._spark.table(name)
    filled = rows.agg(*(F.count(c).alias(c) for c in rows.columns)).unpivot([], rows.columns, "column", "filled")
    told = written(cols.join(filled, "column").select("position", "column", "type", "filled"), "src33-rows")
    t._spark.sql(f"DROP TABLE {name}")
    return told
