"""SimHash near-duplicate detection with pivot distance tables.

Fingerprints that may be near meet in buckets. In a bucket, the Hamming distances of each
fingerprint to fixed reference fingerprints (pivots) are tabled; by the triangle inequality
a pair whose table rows differ by more than the radius in any coordinate can't be near and
is discarded; survivors are verified. Only a spanning set of links leaves a bucket, never
all pairs. Buckets that are too large are dealt out as pairs of blocks, so nothing is
dropped and no task holds a whole one. Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dealt, discard, materialize, slices, text_bytes

#: Reference fingerprints: how many, and the seed they are drawn with.
PIVOTS, PIVOT_SEED = 16, 42
#: Rows of one bucket that are compared within one group; larger buckets go as pairs of blocks.
BLOCK = 1024
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(raw: bytes, words: int, seed: int = 42) -> list[int]:
    """XXH64 of each shingle of `words` words of a text (A-Z lower-cased, words split at
    ASCII white space), repeats included; fewer words: of the whole sequence; none: none."""
    ws = raw.translate(LOWER).split()
    if len(ws) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(ws), seed)] if ws else []
    joined = b" ".join(ws)
    ends = np.cumsum([len(w) + 1 for w in ws])
    starts = np.concatenate(([0], ends[: len(ws) - words])).tolist()
    h, stops = xxhash.xxh64_intdigest, (ends[words - 1 :] - 1).tolist()
    return [h(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)]


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 if there are none."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(hashes[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long): the 64-bit SimHash of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(1))
            data, fps = raw.tobytes(), np.zeros(b.num_rows, np.uint64)
            for i in range(b.num_rows):
                fps[i] = majority(np.array(shingle_hashes(data[off[i] : off[i + 1]], words), np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long").withColumnRenamed("key", id_col)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (uint64) to the pivots, one row each."""
    pivots = np.random.default_rng(PIVOT_SEED).integers(0, 1 << 63, PIVOTS, np.uint64) * np.uint64(2) + np.uint64(1)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def near(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a, b) lie within radius: pivots discard, popcount verifies."""
    keep = np.arange(len(a))
    for p in range(0, PIVOTS, 4):
        if not len(keep):
            return keep
        far = np.abs(table[a[keep], p : p + 4] - table[b[keep], p : p + 4]).max(axis=1) > radius
        keep = keep[~far]
    return keep[np.bitwise_count(fps[a[keep]] ^ fps[b[keep]]) <= radius]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component of n items linked by pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def bucket_links(rows: DataFrame, prepare: Callable[[pd.DataFrame], Callable[[np.ndarray, np.ndarray], np.ndarray]], about: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Links (a, b) among rows that share a bucket.

    rows: bucket long, node long; about: what prepare() reads besides, one row a node, joined
    to rows only where a bucket has company. prepare() gets a frame and returns a function
    that gets two arrays of row numbers and says which pairs are links. A bucket of more than `block` rows (BLOCK) is compared as pairs of blocks, each a group of its own.
    """
    sizes = dealt(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket")
    sized = rows.join(sizes, "bucket")
    extra = [c for c in about.columns if c != "node"] if about is not None else []
    if about is not None:
        sized = sized.join(about, "node")
    blocks = F.ceil(F.col("size") / (block or BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    placed = sized.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        "node", *extra, F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g"), F.col("bucket"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")
    )
    cols = ["g", "bucket", "x", "y", "node", *extra]
    placed = placed.select(cols).repartition("g").sortWithinPartitions("g", "bucket", "x", "y", "node")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for f in frames:
            if not len(f):
                continue
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            key = f[["g", "bucket", "x", "y"]].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            last = int(new[-1]) if len(new) else 0
            rest = f.iloc[last:].reset_index(drop=True)
            if last:
                yield links(f.iloc[:last].reset_index(drop=True), key[:last])
        if rest is not None:
            yield links(rest, rest[["g", "bucket", "x", "y"]].to_numpy())

    def links(f: pd.DataFrame, key: np.ndarray) -> pd.DataFrame:
        n = len(f)
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(axis=1))))
        size = np.bincount(group)[group]
        place = np.arange(n) - np.searchsorted(group, group)
        found_a, found_b, node = [], [], f["node"].to_numpy()
        live = np.flatnonzero(size > 1)
        verify = prepare(f) if len(live) else None
        step = 1
        while len(live):
            live = live[place[live] + step < size[live]]
            hit = verify(live, live + step) if len(live) else live
            found_a.append(live[hit])
            found_b.append(live[hit] + step)
            step += 1
        a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
        b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
        _, same = np.unique(node, return_inverse=True)
        root = roots(n, a, b)
        member = np.flatnonzero(root != np.arange(n))
        out = pd.DataFrame({"a": node[root[member]], "b": node[member]}).drop_duplicates()
        return out[out.a != out.b]

    return placed.mapInPandas(run, "a long, b long")


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches; links: a, b long.

    Alternating large-star and small-star steps; each round is two grouped minimums and
    joins over what links remain, written to the shared folder in place of the last round's.
    No row leaves the cluster but one number a round.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = dealt(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = dealt(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        old, edges = edges, materialize(small, name)
        discard(old)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def block_keys(fp: Column, radius: int) -> Column:
    """Buckets for fingerprints within `radius` bits: 64 bits in radius + 2 blocks, so near
    ones agree in two blocks at least; a bucket for each pair of blocks and its bits."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    part = [F.shiftrightunsigned(F.shiftleft(fp, 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i]) for i in range(n)]
    return F.array(*(F.xxhash64(F.lit(i), F.lit(j), part[i], part[j]) for i, j in combinations(range(n), 2)))


def near_fingerprints(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all fingerprints within `radius` bits; fps: distinct fp."""
    rows = fps.select(F.col("fp").alias("node"), F.explode(block_keys(F.col("fp"), radius)).alias("bucket"))

    def prepare(f: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        x = f["node"].to_numpy().view(np.uint64)
        table = pivot_table(x)
        return lambda a, b: near(x, table, a, b, radius)

    return bucket_links(rows, prepare)


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint of 16 hex digits, component_id): documents whose fingerprints are
    linked at `radius` or fewer differing bits, each with the smallest id it reaches.

    Null, empty and blank texts have fingerprint zero and are linked like any other.
    Repeated rows stay; documents with a null id get a row, and name no component unless
    theirs has no other id. Other columns aren't read. An empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, words, id_col, text_col), "simhash").withColumnRenamed(id_col, "id")
    firsts = fps.groupBy("fp").agg(F.min("id").alias("first"))
    comp = components(near_fingerprints(firsts.select("fp"), radius), "simhash-links")
    named = firsts.join(comp, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    least = dealt(named.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    members = named.join(least, "root").select("fp", "component_id")
    return fps.join(members, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies at a stated similarity of shingle sets ---

#: Minimum hashes for candidate buckets: bands of rows; and for the estimate of similarity.
BANDS, BAND_ROWS, SKETCH = 10, 2, 128
#: How far under the similarity an estimate may lie for a pair to be compared exactly; and
#: rows of one group of candidates that are compared so at once.
SLACK, EXACT_BLOCK = 0.15, 512
_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 31, SKETCH).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH minimum hashes (uint32) of a set of shingle hashes."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(h), 1024):
        np.minimum(low, (h[i : i + 1024, None] * _MULTIPLIERS).min(axis=0), out=low)
    return low


def near_copy_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): documents whose sets of `words`-word shingles have a Jaccard
    similarity of `similarity` or more, and exact copies.

    One row is kept a distinct shingle sequence. Candidates share BAND_ROWS minimum hashes
    in one of BANDS bands; a pair at similarity 0.8 shares none with a chance of 4e-5.
    Pivot tables and SimHash distance at `radius` bits, of sets without repeats, discard (0.8 of a set differ in 9.7
    bits on average, over 20 with a chance of 4e-4), and so does an estimate by 128 minimum
    hashes that lies more than SLACK under the similarity (0.65 for 0.8, whose standard error
    is 0.035: a chance of 4e-5). The texts of such candidates are read again; their sets of
    shingle hashes travel to the candidates' components, where pairs are compared exactly. Blank and null texts are copies of each
    other only. Ties, repeated rows, null ids as in simhash_components.
    """

    def hashed(raw: memoryview) -> tuple[np.ndarray, int]:
        h = np.array(shingle_hashes(bytes(raw), words), np.uint64)
        return np.unique(h), int.from_bytes(xxhash.xxh64_digest(h.tobytes(), 1), "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(1))
            data = memoryview(raw)
            for i, j in slices(off):
                content, fps, marks = [], [], []
                for k in range(i, j):
                    once, whole = hashed(data[off[k] : off[k + 1]])
                    content.append(whole)
                    fps.append(majority(once))
                    marks.append(sketch(once).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(content, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(marks, pa.binary())], names=["id", "content", "fp", "marks"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(0))
            data = memoryview(raw)
            for i, j in slices(off):
                found = [hashed(data[off[k] : off[k + 1]]) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([pa.array([c for _, c in found], pa.int64()), pa.array([h.astype("<u8").tobytes() for h, _ in found], pa.binary())], names=["node", "grams"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts_of = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(texts_of.mapInArrow(run, f"id {kind}, content long, fp long, marks binary"), "near-copies")
    texts = rows.groupBy("content").agg(F.min("id").alias("first"), F.first("fp").alias("fp"), F.first("marks").alias("marks"))
    width = 4 * BAND_ROWS
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("marks", 1 + width * i, width)) for i in range(BANDS)))
    cand = texts.select(F.col("content").alias("node"), F.explode(bands).alias("bucket"))
    about = texts.select(F.col("content").alias("node"), "fp", "marks")

    def prepare(f: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        x = f["fp"].to_numpy().view(np.uint64)
        table = pivot_table(x)
        signs = np.frombuffer(b"".join(f["marks"]), "<u4").reshape(-1, SKETCH)

        def verify(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            hit = near(x, table, a, b, radius)
            keep = [hit[:0]]
            for i in range(0, len(hit), 65536):
                h = hit[i : i + 65536]
                keep.append(h[(signs[a[h]] == signs[b[h]]).mean(axis=1) >= similarity - SLACK])
            return np.concatenate(keep)

        return verify

    def prepare_exact(f: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        signs = np.frombuffer(b"".join(f["marks"]), "<u4").reshape(-1, SKETCH)
        sets = [np.frombuffer(g, "<u8") for g in f["grams"]]
        size = np.array([len(x) for x in sets])
        label, linked = np.arange(len(f)), [np.zeros((2, 0), np.int64)]

        def verify(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Pairs that are links and not yet connected by others."""
            nonlocal label
            small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            maybe = np.flatnonzero((label[a] != label[b]) & (small >= similarity * large - 1e-9))
            hit = []
            for i in range(0, len(maybe), 65536):
                m = maybe[i : i + 65536]
                for j in m[(signs[a[m]] == signs[b[m]]).mean(axis=1) >= similarity - SLACK].tolist():
                    both = len(np.intersect1d(sets[a[j]], sets[b[j]], assume_unique=True))
                    if both >= similarity * (size[a[j]] + size[b[j]] - both) - 1e-9:
                        hit.append(j)
            hit = np.array(hit, np.int64)
            if len(hit):
                linked.append(np.stack((a[hit], b[hit])))
                label = roots(len(label), *np.concatenate(linked, axis=1))
            return hit

        return verify

    maybe = materialize(components(bucket_links(cand, prepare, about), "near-copies-maybe"), "near-copies-groups")
    # the root names its group and stands in it too
    group = maybe.unionByName(maybe.select(F.col("root").alias("node"), "root")).distinct()
    # only the texts of candidates are read again, for their sets of shingles; one of each content
    asked = texts.join(group.select(F.col("node").alias("content")), "content", "left_semi").select(F.col("first").alias("want"), F.col("content").alias("node"), "marks")
    wanted = asked.select("want").distinct()
    again = texts_of.join(wanted, texts_of["id"].eqNullSafe(wanted["want"]), "left_semi").select("text").mapInArrow(sets, "node long, grams binary")
    shown = again.join(asked.select("node", "marks"), "node").dropDuplicates(["node"])
    comp = components(bucket_links(group.select(F.col("root").alias("bucket"), "node"), prepare_exact, shown, EXACT_BLOCK), "near-copies-links")
    named = texts.select("content", "first").join(comp, F.col("content") == F.col("node"), "left").select("content", F.coalesce("root", "content").alias("root"), "first")
    least = dealt(named.groupBy("root").agg(F.min("first").alias("component_id")), "root")
    return rows.select("id", "content").join(named.join(least, "root").select("content", "component_id"), "content").select(F.col("id").alias(id_col), "component_id")
