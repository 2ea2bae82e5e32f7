"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and reads it again as the next stage's docs. All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, packing, quality, simhash, suffix_dedup
from corpusloom.llm.common import materialize
from corpusloom.llm.queries import good_labels, held_out, table

#: Documents whose language is known with less than this are rejected.
LEAST_SCORE = 0.5
#: Bytes of one Arrow batch; whole texts are long, and each Python worker holds a batch or two.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(stage):
    """The stage with the session's Arrow batches bounded by bytes, unless by fewer already.
    The setting stays, as stages run after they return."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # Spark reads its own byte sizes, such as 64m; what isn't above 0 is no bound
        have = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
        if not 0 < have <= BATCH_BYTES:
            spark.conf.set(_BATCH, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


def whole(docs: DataFrame) -> F.Column:
    """All columns as one, so that no name can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")


@bounded_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that was learned; null texts and texts without a letter
    go. Null and repeated ids are rows like any other (null ids are never held out); an empty
    table stays empty."""
    model = langid.fit(docs.where(~held_out()))
    told = langid.predict(docs.select("text", whole(docs)), model)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_row.*")


@bounded_batches
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws as many documents as the model finds acceptable, by Gumbel top-k: junk and toxic
    ones weigh too little. Null texts weigh as ordinary ones; null and repeated ids are rows
    like any other; an empty table stays empty."""
    model = quality.fit(docs, good_labels(table(spark, sf_dir, "labels")))
    return quality.resample(docs.select("doc_id", "text", whole(docs)), model, extra=["_row"]).select("_row.*")


@bounded_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies (five words, similarity 0.8).

    A group's rows with that id stay, all of them if the id repeats; null ids stay.
    """
    groups = simhash.near_copy_groups(docs, words=5, similarity=0.8).where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id IS NULL").unionByName(docs.join(groups, "doc_id", "left_semi")).select(docs.columns)


@bounded_batches
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings of 100 bytes that start earlier in the corpus; characters that
    are only partly covered stay whole. Documents that end up empty go; texts without
    repeats, null ones too, stay as they are. Rows with one id and different texts are
    documents of their own."""
    done = suffix_dedup.drop_repeats(docs.select("doc_id", "text", whole(docs)), characters=True)
    cut = F.size("_spans") > 0
    done = done.withColumn("_new", F.when(cut, F.col("_kept").cast("string")).otherwise(F.col("text")))
    fresh = {"text": F.col("_new"), "n_chars": F.when(cut, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return done.where("NOT (size(_spans) > 0 AND _new = '')").select(*(fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


@bounded_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: one row a piece. Null and empty texts
    are their end token alone; null and repeated ids are packed like any other."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language ID", language), ("quality classifier", classify), ("SimHash near-dedup", near_copies), ("suffix-array dedup", repeats), ("packing", pack)]

#: Trained models and tokenizers can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
