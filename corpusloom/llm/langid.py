"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken in the tasks and summed by bucket; the log-probability matrix
(buckets x languages, a few MB whatever the corpus) is broadcast, and whole texts are
scored in numpy, a batch of n-grams at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SLICE_BYTES, slices, text_bytes

BUCKETS = 1 << 15
#: Labelled rows that the model is fitted on: about this many, chosen by a hash of the id.
TRAIN_ROWS = 20_000
ORDERS = (2, 3)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages
    log_prior: np.ndarray


def ngram_buckets(raw: np.ndarray, orders: tuple[int, ...] = ORDERS) -> list[tuple[int, np.ndarray]]:
    """For each order n, the bucket of the n-gram that starts at each byte (A-Z lower-cased,
    digits and white space made equal); the last n - 1 are of no use."""
    x = _FOLD[raw].astype(np.uint32)
    out = []
    for n in orders:
        if len(x) < n:
            out.append((n, np.zeros(0, np.uint32)))
            continue
        h = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            h = h * np.uint32(257) + x[k : len(x) - n + 1 + k]
        h = (h * np.uint32(2654435761)) >> np.uint32(32 - 15)
        out.append((n, h))
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[9:14] = 32


def fit(docs: DataFrame, label: str = "lang", text: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Fit on about train_rows rows with a label and a text, chosen by a hash of their id
    (all of them, if there are no more). No labelled row gives a model without languages."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), F.col(text).cast("string").alias("text"), F.col(id_col).alias("id"))
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            raw, off = text_bytes(b.column(1))
            langs = b.column(0).to_pylist()
            for i, lang in enumerate(langs):
                t = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                docs_of[lang] = docs_of.get(lang, 0) + 1
                text = raw[off[i] : off[i + 1]]
                for n in ORDERS:
                    for s in range(0, len(text) - n + 1, SLICE_BYTES):
                        t += np.bincount(dict(ngram_buckets(text[s : s + SLICE_BYTES + n - 1], (n,)))[n], minlength=BUCKETS)
        for lang, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([docs_of[lang]], pa.int64()), pa.array([t.astype("<i8").tobytes()], pa.binary())], names=["label", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for b in batches:
            for lang, k, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                have = total.setdefault(lang, [0, np.zeros(BUCKETS, np.int64)])
                have[0] += k
                have[1] += np.frombuffer(raw, "<i8")
        for lang, (k, t) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([k], pa.int64()), pa.array([t.tobytes()], pa.binary())], names=["label", "n", "counts"])

    schema = "label string, n long, counts binary"
    part = rows.select("label", "text").mapInArrow(count, schema)
    spread = part.repartition(8, F.xxhash64("counts")).mapInArrow(add, schema)
    found: dict[str, list] = {}
    for r in spread.collect():  # languages x 8 vectors
        have = found.setdefault(r["label"], [0, np.zeros(BUCKETS, np.int64)])
        have[0] += r["n"]
        have[1] += np.frombuffer(bytes(r["counts"]), "<i8")
    langs = sorted(found)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    counts = np.array([found[x][1] for x in langs], np.float64) + 0.5
    prior = np.array([found[x][0] for x in langs], np.float64)
    return LanguageModel(langs, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)), np.log(prior / prior.sum()))


def log_likelihoods(model: LanguageModel, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """documents x languages, for texts given as bytes and offsets."""
    out = np.tile(model.log_prior, (len(off) - 1, 1))
    for i, j in slices(off):
        part, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        if len(part) > SLICE_BYTES:
            # one long text, in parts that share the bytes of an n-gram less one
            for n in ORDERS:
                for s in range(0, len(part) - n + 1, SLICE_BYTES):
                    h = dict(ngram_buckets(part[s : s + SLICE_BYTES + n - 1], (n,)))[n]
                    out[i] += model.log_prob[h].sum(axis=0, dtype=np.float64)
            continue
        for n, h in ngram_buckets(part):
            ends = np.maximum(o[1:] - (n - 1), o[:-1])
            score = np.zeros((len(h) + 1, len(model.languages)))
            np.cumsum(model.log_prob[h], axis=0, dtype=np.float64, out=score[1:])
            out[i:j] += score[np.minimum(ends, len(h))] - score[np.minimum(o[:-1], len(h))]
    return out


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior, 0 to 1) in place of any such columns.

    A null text, one without a letter, or a model without languages gives `und` and 0.
    Only the text is looked at; all other columns and repeated rows stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def score(texts: pa.Array, has: pa.Array) -> pa.Array:
        m, raw, off = shared.value, *text_bytes(texts)
        known = has.to_numpy(zero_copy_only=False).astype(bool)
        pred, best = np.full(len(texts), "und", object), np.zeros(len(texts))
        if m.languages and len(texts):
            ll = log_likelihoods(m, raw, off)
            top = ll.argmax(axis=1)
            post = 1 / np.exp(np.clip(ll - ll.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
            pred[known] = np.array(m.languages, object)[top[known]]
            best[known] = post[known]
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(best)], ["lang_pred", "score"])

    return docs.select(*keep, score(F.col(text_col).cast("string"), letter).alias("_p")).select(*keep, "_p.lang_pred", "_p.score")
