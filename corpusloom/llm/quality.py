"""Quality by importance resampling.

Two generative models of hashed n-grams (words, starts of words and pairs of words, each as
often as it occurs), one of a target sample and one of all raw text, score every document, and documents
are sampled without replacement by Gumbel top-k. Model sizes are fixed; counts are taken in
the tasks over whole texts and summed by bucket.

A document's log-weight is the log-likelihood ratio, target over raw, of its least likely
passage: the smallest sum over any run of consecutive n-grams, where each n-gram that is
added also costs PASSAGE (passages of raw text end, n-gram by n-gram, with a constant
chance). No run has a sum above 0, so an ordinary document weighs 0 whatever its length,
while the plain sum over a long document drowns a bad paragraph in ordinary text.

Without k or a share, as many documents are drawn as lie above a limit on the log-weight
that is set on labelled documents; which ones, the Gumbel keys decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SLICE_BYTES, materialize, slices, text_bytes

BITS = 20
#: Buckets of words, as many again of starts of words, and of pairs.
BUCKETS = 1 << BITS
KINDS = 3
#: Bytes of a longer word that are its start, which its inflected forms share.
START = 4
#: Labelled documents that the limit is set on, and target documents counted; about so many.
TRAIN_ROWS, TARGET_ROWS = 20_000, 100_000
#: Expected target counts that weigh as much as those seen, of words, starts and pairs.
PRIORS = (0.5, 10.0, 50.0)
#: What each n-gram of a passage costs.
PASSAGE = 0.1
#: What Gumbel noise is multiplied by; at 1 the sample follows the plain likelihood ratios,
#: below it the ratios' powers, which leaves less of a document's fate to chance.
TEMPERATURE = 0.25
#: Bad documents kept that weigh as much as one good document lost, when the limit is set.
LOST = 2

_WORD = np.zeros(256, np.uint8)  # folded byte of a word, 0 between words
_WORD[128:] = np.arange(128, 256)
_WORD[48:58] = 48
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_MARK = np.zeros(256, bool)  # ASCII marks count as words of one character
_MARK[33:127] = True
_MARK[_WORD > 0] = False


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


_POWERS = _mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the start or 0 for words that aren't longer, document) of each word of
    texts given as bytes and offsets, in order.

    Words are runs of ASCII letters, digits (all equal) and bytes over 127, A-Z lower-cased,
    and each ASCII mark alone. None crosses documents.
    """
    n = len(raw)
    w, place = _WORD[raw], np.arange(n, dtype=np.int32)
    inside = w > 0
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    mark = _MARK[raw]
    first = inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1])
    final = inside & ~(np.concatenate((inside[1:], [False])) & ~edge[1:])
    start, end = np.flatnonzero(first), np.flatnonzero(final) + 1
    at = place - np.maximum.accumulate(np.where(first, place, 0))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(np.where(inside, w * _POWERS[np.minimum(at, 63)], np.uint64(0)), dtype=np.uint64, out=total[1:])
    hashes = np.zeros(n, np.uint64)
    hashes[start] = _mix(total[end] - total[start])
    hashes[mark] = _mix(raw[mark] * np.uint64(0x1F35C9D7))
    starts, long = np.zeros(n, np.uint64), start[end - start > START]
    starts[long] = _mix(total[long + START] - total[long]) | np.uint64(1)
    where = np.flatnonzero(first | mark)
    return hashes[where], starts[where], np.searchsorted(off, where, side="right") - 1


def grams(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(number of the first document, document of each word after that, the word's KINDS of
    buckets, whether the first document goes on from the last part). The pair of a word is
    with the one before it; kinds that a word hasn't are -1. Texts over SLICE_BYTES come in parts, cut
    between words where there is a cut, so memory is bounded whatever a text's length."""
    for i, j in slices(off, SLICE_BYTES):
        size, at, before = int(off[j] - off[i]), 0, None
        while at < size or at == 0:
            end = size
            if size > SLICE_BYTES and size - at > SLICE_BYTES:
                end = at + SLICE_BYTES
                gap = np.flatnonzero(_WORD[raw[off[i] + at : off[i] + end]] == 0)
                end = at + int(gap[-1]) + 1 if len(gap) else end
            part = raw[off[i] + at : off[i] + end]
            local = off[i : j + 1] - off[i] if end - at == size else np.array([0, end - at])
            h, start, doc = words(part, local)
            prev, same = np.roll(h, 1), np.concatenate(([False], doc[1:] == doc[:-1]))
            if len(h):
                if before is not None:
                    prev[0], same[0] = before, True
                before = h[-1]
            pair = _mix(h * np.uint64(0x9E3779B97F4A7C15) ^ (prev << np.uint64(1)) ^ np.uint64(77))
            shift = np.uint64(64 - BITS)
            found = np.stack(((h >> shift).astype(np.int64), np.where(start > 0, (start >> shift).astype(np.int64) + BUCKETS, -1), np.where(same, (pair >> shift).astype(np.int64) + 2 * BUCKETS, -1)))
            yield i, doc, found, at > 0
            at = end
            if not size:
                break


def count_grams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all n-grams of all whole texts by bucket, of all and of the target.
    docs: text string, target boolean. At most KINDS * BUCKETS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = np.zeros(KINDS * BUCKETS, np.uint32), np.zeros(KINDS * BUCKETS, np.uint32)
        for b in batches:
            raw, off = text_bytes(b.column(0))
            chosen = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, doc, found, _ in grams(raw, off):
                np.add.at(every, found[found >= 0], 1)
                found = found[:, chosen[i + doc]]
                np.add.at(target, found[found >= 0], 1)
        at = np.flatnonzero(every)
        for s in range(0, len(at), 100_000):
            w = at[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(every[w].astype(np.int64)), pa.array(target[w].astype(np.int64))], names=["bucket", "n", "t"])

    sums = docs.select("text", "target").mapInArrow(run, "bucket int, n long, t long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    every, target = np.zeros(KINDS * BUCKETS, np.int64), np.zeros(KINDS * BUCKETS, np.int64)
    at = sums.column("bucket").to_numpy()
    every[at], target[at] = sums.column("n").to_numpy(), sums.column("t").to_numpy()
    del sums, at
    pa.default_memory_pool().release_unused()  # up to 60 MB that the driver needs no more
    return every, target


@dataclass
class RatioModel:
    log_ratio: np.ndarray  # float32, by bucket; a last 0 for what there isn't
    limit: float


def log_ratios(every: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of the ratio of the two models' probabilities by bucket; a bucket's probability
    is its smoothed share of its kind."""
    out = []
    for r, t, prior in zip(every.reshape(KINDS, -1).astype(np.float64), target.reshape(KINDS, -1).astype(np.float64), PRIORS, strict=True):
        out.append(np.log(t + prior) - np.log(r * (t.sum() / max(1.0, r.sum())) + prior))
    return np.concatenate([*out, [0.0]]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, target_rows: int = TARGET_ROWS) -> RatioModel:
    """labels: (id, good boolean). Target: good documents, about target_rows of them, chosen
    by a hash of the id; raw: all documents. The limit is the one that errs least on about
    train_rows labelled documents (three tenths of them at most) that aren't in the target,
    a lost good one counting LOST times.

    A document that is labelled more than once is good only if all labels say so; labels
    without a document, or with a null id, say nothing. Repeated documents count each time.
    Without good documents, or without documents, the limit is -inf: nothing is unacceptable.
    """
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("good").alias("good"))
    sizes = known.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()
    good = sum(r["n"] for r in sizes if r["good"])
    total = sum(r["n"] for r in sizes)
    if not good:
        return RatioModel(np.zeros(KINDS * BUCKETS + 1, np.float32), -np.inf)
    share = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 30))
    apart = int((1 << 30) * (1 - min(0.3, train_rows / max(1, total))))
    some = known.where(F.col("good") & (share < int(apart * min(1.0, target_rows / good)))).select("id", F.lit(True).alias("target"))
    # both lists of ids are of a bounded size, so texts stay where they are
    every, target = count_grams(text.join(F.broadcast(some), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target")))
    model = RatioModel(log_ratios(every, target), -np.inf)
    few = known.where(share >= apart)
    scored = score(text.join(F.broadcast(few), "id"), model, "id", "text", ["good"]).select("good", "log_weight").toArrow()  # about train_rows pairs
    weight, ok = scored.column("log_weight").to_numpy(), scored.column("good").to_numpy(zero_copy_only=False).astype(bool)
    model.limit = best_limit(weight, ok)
    return model


def best_limit(weight: np.ndarray, good: np.ndarray) -> float:
    """The limit with the least cost of good documents under it (LOST each) and others above."""
    by = np.argsort(weight, kind="stable")
    weight, good = weight[by], good[by]
    # under a limit before place i, places 0..i-1 go
    cost = np.concatenate(([0], np.cumsum(np.where(good, LOST, -1))))
    real = np.concatenate(([True], weight[1:] > weight[:-1], [False]))[: len(cost)]
    cost = np.where(real, cost, np.iinfo(np.int64).max)
    i = int(cost.argmin())
    return float(weight[i] + weight[i - 1]) / 2 if 0 < i < len(weight) else -np.inf


def log_weights(model: RatioModel, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The log-weight of each text given as bytes and offsets; 0 without words."""
    n = len(off) - 1
    out, tail = np.zeros(n), 0.0
    for i, doc, found, goes_on in grams(raw, off):
        tail = tail if goes_on else 0.0
        if not len(doc):
            continue
        x = model.log_ratio[found].sum(axis=0, dtype=np.float64) + PASSAGE
        after = np.cumsum(x)
        before = after - x
        start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        base = np.repeat(before[start], np.diff(np.append(start, len(doc))))
        before, after = before - base, after - base
        before[0] = max(before[0], -tail)  # the best run that goes on from the last part
        apart = (max(float(before.max()), 0.0) - float(before.min()) + 1) * doc
        run = after - (np.maximum.accumulate(before + apart) - apart)
        least = np.minimum(np.minimum.reduceat(run, start), 0)
        out[i + doc[start]] = np.minimum(out[i + doc[start]], least)
        tail = min(float(run[-1]), 0.0)
    return out


def score(docs: DataFrame, model: RatioModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, keep..., log_weight), one row a document. Null and empty texts weigh 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def weights(texts: pa.Array) -> pa.Array:
        return pa.array(log_weights(shared.value, *text_bytes(texts)))

    return docs.select(id_col, *keep, weights(F.col(text_col).cast("string")).alias("log_weight"))


def gumbel_key(log_weight: Column, noise: Column, temperature: float = TEMPERATURE) -> Column:
    """Log-weight plus Gumbel noise from a 64-bit hash, times temperature."""
    u = (F.shiftrightunsigned(noise, 11).cast("double") + 0.5) / float(1 << 53)
    return log_weight - F.lit(temperature) * F.log(-F.log(u))


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a column of doubles without nulls or NaN; None if there are
    fewer. Each round counts rows in at most 4096 ranges and narrows to one of them; at most
    4096 values reach the driver."""
    n, lo, hi = rows.agg(F.count(key), F.min(key), F.max(key)).first()
    if k < 1 or n < k:
        return None
    while n > 4096 and hi > lo:
        width = (hi - lo) / 4096
        if width == 0 or len(np.unique(np.linspace(lo, hi, 4097))) < 3:
            # neighbouring doubles: only these two values are left
            return hi if k <= rows.where(F.col(key) == hi).count() else lo
        place = F.least(F.floor((F.col(key) - lo) / width), F.lit(4095)).cast("int")
        found = rows.where(F.col(key).between(lo, hi)).groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["p"]):
            if r["n"] >= k:
                break
            k -= r["n"]
        n, lo, hi = r["n"], r["lo"], r["hi"]
    if hi == lo:
        return lo
    values = sorted((r[0] for r in rows.where(F.col(key).between(lo, hi)).select(key).collect()), reverse=True)
    return values[k - 1]


def resample(docs: DataFrame, model: RatioModel, k: int | None = None, share: float | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", extra: list[str] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """The documents drawn: (id, log_weight, gumbel_key); with `extra`, the columns named
    there come along, under names other than these.

    Drawn are the k largest log_weight + Gumbel noise, a sample without replacement by
    importance weight; or a share of all documents; or, with neither, as many as the model
    finds acceptable (log_weight at its limit or above). The noise depends on seed, id and
    text, so repeated rows are drawn together; null ids are documents like any other, null
    texts weigh 0. If keys tie at the k-th place, all that tie are drawn. k of 0 or less draws
    none. An empty table gives no rows.
    """
    keep = [c for c in extra or [] if c != id_col]
    noised = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col).cast("string")).alias("_noise"))
    keyed = lambda keep: score(noised, model, id_col, "_text", [*keep, "_noise"]).withColumn("gumbel_key", gumbel_key(F.col("log_weight"), F.col("_noise"), temperature)).drop("_noise")
    scored = materialize(keyed([]), "quality")
    if k is None:
        k = scored.where(F.col("log_weight") >= model.limit).count() if share is None else int(share * scored.count())
    least = kth_largest(scored, "gumbel_key", k)
    # columns that come along are not written: their rows are scored once more
    scored = keyed(keep) if keep else scored
    if least is None:
        return scored if k > 0 else scored.where(F.lit(False))
    return scored.where(F.col("gumbel_key") >= least)
