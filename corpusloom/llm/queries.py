"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann_forest, centroids, chat, langid, lexical, media, packing, quality, secret_scan, sentencepiece_scan, simhash, suffix_dedup, url_filter
from corpusloom.llm.common import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "continued", "continues")


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Pieces of all documents, and whether they decode to the text."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("want", F.xxhash64(F.translate(F.coalesce("text", F.lit("")), sentencepiece_scan.MARK, " ")))
    # written in between, so that a task holds one Python worker at a time
    done = sentencepiece_scan.decode(materialize(sentencepiece_scan.encode(docs, path, keep=["want"]), "pieces"), path)
    return done.select(
        "doc_id",
        (F.length("ids") / 2).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.col("score").cast("long").alias("score"),
        F.length("decoded").cast("long").alias("n_chars"),
        (F.xxhash64("decoded") == F.col("want")).alias("lossless"),
    )


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of each hundredth vector among all."""
    rows = table(spark, sf_dir, "embeddings")
    return ann_forest.nearest(rows, rows.where("vec_id % 100 = 0"))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as media, found again through its page, and read back."""
    stored = media.store(table(spark, sf_dir, "documents"), "doc_id", "text")
    items = media.interleave(stored.select("doc_id", "n_bytes", "html"), ["doc_id", "n_bytes"]).where("kind = 'media'")
    found = media.resolve(items, media.media_features(stored.select("media")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.where("quality IS NOT NULL").select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn by importance: as many as the model finds acceptable."""
    docs = table(spark, sf_dir, "documents")
    return quality.resample(docs, quality.fit(docs, good_labels(table(spark, sf_dir, "labels"))))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and their components at 4 bits or fewer."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return langid.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what is read back from the formatted text."""
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    made = chat.format_chats(rows)
    turns, loss = chat.read_turns(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return made.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes removed from all documents."""
    done = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("_size").alias("n_bytes"),
        (F.col("_size") - F.length("_kept")).cast("long").alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item, among all."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters, after five rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents: by the base rules, and those that the learned formats add."""
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat("base", F.transform("added", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))))
    base = F.sha2(secret_scan.written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *(number(k) for k in secret_scan.KINDS), base, secret_scan.written(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


OP11_SQL = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS MATERIALIZED (
  SELECT r, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')) AS term FROM docs),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS MATERIALIZED (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM sizes),
items AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, coalesce(text, '') AS text FROM benchmark),
asked AS (
  SELECT DISTINCT i, term FROM (
    SELECT i, unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')) AS term FROM items)),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term, nd),
scored AS (
  SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (r), total GROUP BY i, r)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST))::INTEGER AS rank, doc_id, score
FROM scored JOIN docs USING (r) JOIN items USING (i) WHERE score > 0
QUALIFY rank <= 50
"""

OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w IS NOT DISTINCT FROM role AS same,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS nr,
    length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS nt
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(nt + CASE WHEN same THEN 7 ELSE 8 + nr + 8 + 7 END)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op12_sql(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    """Each round compares all vectors with all centroids."""
    near = "SELECT r, min(d) AS distance, arg_min(c, (d, c)) AS cluster FROM (SELECT r, c, list_sum(list_transform(list_zip(k.p, m.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, {m} m) GROUP BY r"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(m=f'c{i}')})")
        steps.append(f"s{i} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM a{i} JOIN parts USING (r) GROUP BY cluster, i)")
        steps.append(f"m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS p FROM s{i} GROUP BY cluster)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.p, o.p) AS p FROM c{i} o LEFT JOIN m{i} m ON m.cluster = c)")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, unnest(range({dims})) AS i, unnest(p) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, p) - 1 AS c, p FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, p FROM kept ORDER BY h, p LIMIT {k})),
{", ".join(steps)},
final AS MATERIALIZED ({near.format(m=f"c{rounds}")})
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m.p, ',')) AS centroid_sha256
FROM final JOIN kept USING (r) JOIN c{rounds} m ON m.c = cluster
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_ann": op3_ann,
    "op4_url_filter": op4_url_filter,
    "op5_media": op5_media,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_chat": op9_chat,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_lexical": op11_lexical,
    "op12_centroids": op12_centroids,
    "op13_secrets": op13_secrets,
}
SQL: dict[str, str] = {"op9_chat": OP9_SQL, "op11_lexical": OP11_SQL, "op12_centroids": op12_sql()}
