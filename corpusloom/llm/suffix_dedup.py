"""Removal of repeated byte strings by bounded suffix intervals.

Two equal strings of `length` bytes hold the same anchor at the same place: the leftmost of
the smallest 16-byte hashes inside them. So each run of string starts that share an anchor
becomes one row with the anchor's hash and a hash of the run's bytes (its context). Hashes
only say who must meet; what repeats is decided on the bytes:

* where an anchor has several contexts, one copy of each goes to the anchor's block;
* where a context has several copies, the first two go to a block of the first one's, joined
  to the runs beside them;
* contexts of hot anchors fall into pieces of PIECE starts that meet by the bytes that the
  piece's strings share: a piece has few different forms, however many documents hold it,
  and its first and last copies go to that block.

A breadth-first backward extension on a block's Burrows-Wheeler transform derives the common
prefixes of neighbouring suffixes by increasing value and stops at `length`; the intervals
still unbroken hold the strings that repeat. All but the earliest are removed; the third and
further copies of a context go if the second one did.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import dealt, discard, free_name, materialize, slices, text_bytes

GRAM = 16
#: Bytes of contexts that one transform covers.
BLOCK_BYTES = 1 << 17
#: Bytes whose anchors are found at once, under 2^24; longer texts go as overlapping parts.
MOST_BYTES = 1 << 20
#: Contexts of an anchor beyond which it is hot: in one batch, and in one task. Starts in a piece
#: of a hot one's context.
HOT_BATCH, HOT, PIECE = 32, 512, 4
#: Rows of one anchor beyond which a task doesn't hold them together.
MOST_ROWS = 200_000
#: Starts of a first copy whose runs share a block, as a power of two.
REGION = 15
#: What a run is sent for: to meet other contexts, to meet its first copy, or nothing but the
#: verdict on another copy.
NEED, PAIR, REST = 0, 1, 2
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mix(*parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of longs."""
    h = np.uint64(0)
    for p in parts:
        h = (h ^ p.view(np.uint64)) * _MULTIPLIER
        h = h ^ (h >> np.uint64(29))
    return (h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def anchors(x: np.ndarray, length: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """For bytes x (under 2^24): the GRAM-gram hashes, and the anchor of the string of
    `length` bytes at each place."""
    h = x.astype(np.uint64) + np.uint64(1)
    mult, m = np.full(1, 0x9E3779B97F4A7C15, np.uint64), 1
    while m < GRAM:
        h = h[: len(h) - m] * mult + h[m:]
        mult = mult * mult
        m *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    window, width = length - GRAM + 1, 1
    low = key
    while width * 2 <= window:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    return h, (low & np.uint64(0xFFFFFF)).astype(np.int64)


def runs(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document number, first start, last start, anchor hash, context hash, anchor's place)
    of each run of starts with one anchor, in the documents given as bytes and offsets. A text
    over MOST_BYTES goes as parts that share length - 1 bytes, so each start lies in one; a run
    that crosses parts comes as two, whose contexts meet the others of their anchor."""
    if len(raw) > MOST_BYTES:
        parts = []
        for d in range(len(off) - 1):
            for s in range(int(off[d]), max(int(off[d]) + 1, int(off[d + 1]) - length + 1), MOST_BYTES - length + 1):
                some = raw[s : min(s + MOST_BYTES, int(off[d + 1]))]
                _, first, last, anchor, ctx, at = runs(some, np.array([0, len(some)]), length)
                by = s - off[d]
                parts.append((np.full(len(first), d), first + by, last + by, anchor, ctx, at + by))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    sizes = np.diff(off)
    if len(raw) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    h, at = anchors(raw, length)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    ok = np.arange(len(at)) + length <= off[doc + 1]
    p = np.flatnonzero(ok)
    if not len(p):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z, z
    a = at[p]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)))
    first, last = p[new], np.concatenate((p[np.flatnonzero(new)[1:] - 1], p[-1:]))
    hashed, view = xxhash.xxh3_64_intdigest, memoryview(raw.tobytes())
    ctx = np.array([hashed(view[s:e]) for s, e in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64).view(np.int64)
    d = doc[first]
    return d, first - off[d], last - off[d], h[a[new]].view(np.int64), ctx, a[new] - off[d]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of text (uint8, 0 ends a context) sorted by their first `depth` symbols or
    more, by doubling; and the values of neighbours' common prefixes below 8 (else -1)."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    diff = sorted_key[1:] ^ sorted_key[:-1]
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    new = np.concatenate(([True], diff != 0))
    shared = np.zeros(n - 1, np.int16)
    for k in range(8, 64, 8):
        shared += diff < np.uint64(1 << k)
    lcp[1:n] = np.where(new[1:], shared, -1)
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1  # what lies beyond the end
    bits, reach = n.bit_length(), 8
    while reach < depth:
        head = np.concatenate((new, [True]))
        tied = np.flatnonzero(~(head[:-1] & head[1:]))
        if not len(tied):
            break
        who = order[tied]
        g, second = rank[who], rank[np.minimum(who + reach, n)] + 1
        if 3 * bits < 64:  # rank, next rank and place in one number: sorting values is faster than sorting places
            both = np.sort(g << (2 * bits) | second << bits | who)
            who, pair = both & ((1 << bits) - 1), both >> bits
        else:
            pair = g * (n + 1) + second
            again = np.argsort(pair)
            who, pair = who[again], pair[again]
        order[tied] = who
        apart = np.concatenate(([True], pair[1:] != pair[:-1]))
        new = np.ones(n, bool)
        new[tied] = apart
        rank[who] = np.maximum.accumulate(np.where(apart, tied, 0))
        reach *= 2
    return order, lcp


def common_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, lcp) where lcp[i] is the common prefix of suffixes order[i - 1] and
    order[i] if under `length`, else -1.

    Level by level: the interval of each string w whose right end was found at the last
    level is extended backwards by every symbol before it; the extension's right end, if not
    yet known, is a common prefix of the level's value.
    """
    n = len(text)
    order, lcp = suffix_order(text, length)
    before = text[order - 1]  # the transform; order 0 wraps to the last symbol
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # backward extension of one place
    step[by_symbol] = np.arange(n)
    ends = np.flatnonzero(lcp[1:] == 7) + 1  # right ends (exclusive) found at the last level
    cuts = np.flatnonzero(lcp >= 0)
    left = cuts[np.searchsorted(cuts, ends) - 1]
    right = ends
    for level in range(8, length):
        if not len(left):
            break
        size = right - left
        one = size == 1  # of one place, so of one symbol
        single = left[one]
        low, sym = step[single], before[single]
        high = low + 1
        if len(single) < len(left):
            left, size = left[~one], size[~one]
            total = np.cumsum(size)
            place = np.arange(total[-1]) - np.repeat(total - size - left, size)
            part = np.repeat(np.arange(len(left)) << 8, size) | before[place]
            by = np.argsort(part, kind="stable")
            to, part = step[place[by]], part[by]
            edge = np.flatnonzero(part[1:] != part[:-1])
            low = np.concatenate((low, to[:1], to[edge + 1]))
            high = np.concatenate((high, to[edge] + 1, to[-1:] + 1))
            sym = np.concatenate((sym, part[:1] & 255, part[edge + 1] & 255))
        keep = (sym > 0) & (lcp[high] < 0)
        low, high = low[keep], high[keep]
        lcp[high] = level
        left, right = low, high
    return order, lcp


def repeated(contexts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Ranges (number of context, from, to) of starts, relative to their context, of strings
    that also start earlier, by (doc, place), in these contexts."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    off = np.cumsum(sizes + 1) - (sizes + 1)
    seen = np.flatnonzero(np.bincount(joined, minlength=256))
    code = np.zeros(256, np.uint8)
    code[seen] = np.arange(1, len(seen) + 1) if len(seen) < 256 else seen
    text = code[joined]
    text[off + sizes] = 0
    order, lcp = common_prefixes(text, length)
    n = len(text)
    broken = np.flatnonzero(lcp[:n] >= 0)  # first places of intervals of strings
    many = np.diff(np.append(broken, n)) > 1
    if not many.any():
        return []
    left = broken[many]
    size = np.append(broken, n)[1:][many] - left
    begin = np.cumsum(size) - size
    who = order[np.arange(int(size.sum())) + np.repeat(left - begin, size)]
    ctx = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)[who]
    _, number = np.unique(doc, return_inverse=True)
    # the earliest by document, then place; strings that run over a context's end don't count
    when = (number[ctx].astype(np.int64) << 40) + start[ctx] + who - off[ctx]
    fit = who + length <= (off + sizes)[ctx]
    when = np.where(fit, when, np.iinfo(np.int64).max)
    later = fit & (when != np.repeat(np.minimum.reduceat(when, begin), size))
    gone = np.zeros(n, bool)
    gone[who[later]] = True
    at = np.flatnonzero(gone)
    if not len(at):
        return []
    ctx = np.searchsorted(off, at, side="right") - 1
    new = np.concatenate(([True], at[1:] != at[:-1] + 1))  # a context's last bytes start no string
    last = np.concatenate((at[np.flatnonzero(new)[1:] - 1], at[-1:]))
    ctx = ctx[new]
    return list(zip(ctx.tolist(), (at[new] - off[ctx]).tolist(), (last - off[ctx]).tolist(), strict=True))


def removals(docs: DataFrame, length: int = 100) -> DataFrame:
    """(id, ranges of from and to): byte ranges to remove, in one row or several a document. docs: id long, text string; rows with equal ids
    are one document, repeated."""
    hot_batch, hot_task, most_rows, region, block_bytes, search = HOT_BATCH, HOT, MOST_ROWS, REGION, BLOCK_BYTES, repeated
    raw_docs = docs.select("id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(1))
            ids, parts = b.column(0).to_numpy(), []
            for i, j in slices(off):
                d, first, last, anchor, ctx, at = runs(raw[off[i] : off[j]], off[i : j + 1] - off[i], length)
                parts.append((ids[i + d], first << 16 | (last - first) << 8 | (at - first), anchor, ctx))
            key, place, anchor, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield from _send(key, place, anchor, ctx, hot_batch)

    found = raw_docs.mapInArrow(find, "g long, anchor long, ctx long, id long, place long, kind byte")
    met = found.repartition("g").sortWithinPartitions("g", "anchor", "ctx", "id", "place")
    told = materialize(met.mapInArrow(lambda batches: _meet(batches, hot_task, most_rows, region), "kind byte, hot boolean, id long, place long, at long, ref long"), "suffix-runs")

    # the bytes of runs that must meet others
    needs = told.where(F.col("kind") < REST).groupBy("id").agg(F.collect_list(F.struct("kind", "hot", "at", "place")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _cut(b, length)

    texts = materialize(raw_docs.join(needs, "id").mapInArrow(cut, "block long, form long, hot boolean, id long, first int, last int, bytes binary"), "suffix-texts")
    hot = texts.where("hot")
    forms = materialize(hot.groupBy("block", "form").agg(F.min(F.struct("id", "first")).alias("least"), F.max(F.struct("id", "first")).alias("most"), F.first("bytes").alias("bytes")), "suffix-forms")
    nothing = F.lit(None).cast("long").alias("form")
    meeting = texts.where("NOT hot").select("block", nothing, "id", "first", "bytes").unionByName(forms.select("block", nothing, "least.id", "least.first", "bytes")).unionByName(forms.where("least <> most").select("block", "form", "most.id", "most.first", "bytes"))
    block = meeting.repartition("block").sortWithinPartitions("block")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.column(4).nbytes
            if size >= block_bytes:
                t = pa.Table.from_batches(held).combine_chunks()
                keys = t.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield from _blocks(t.slice(0, cut), length, block_bytes, search)
                held = t.slice(cut).to_batches()
                size = sum(x.column(4).nbytes for x in held)
        if held:
            yield from _blocks(pa.Table.from_batches(held).combine_chunks(), length, block_bytes, search)

    decided = materialize(block.mapInArrow(extend, "id long, a int, b int, block long, form long"), "suffix-decided")

    # copies that were not sent go as the ones that were
    verdict = decided.where("form IS NOT NULL").select("block", "form").distinct().join(forms.select("block", "form", "least", "most"), ["block", "form"])
    between = hot.select("block", "form", "id", "first", "last").join(dealt(verdict, "block", "form"), ["block", "form"]).where("(id <> least.id OR first <> least.first) AND (id <> most.id OR first <> most.first)")
    span = lambda a, b: F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias("spans")
    starts = decided.select("id", span("a", "b")).unionByName(between.select("id", span("first", "last")))
    rest = told.where(F.col("kind") == REST)
    second = _inherited(rest.where("NOT hot"), starts)
    starts = materialize(starts.unionByName(second), "suffix-starts")
    for table in (texts, forms, decided):
        discard(table)
    every = starts.unionByName(_inherited(rest.where("hot"), starts))
    # written, so that a task of the last stage holds one Python worker at a time
    ranges = materialize(every.select("id", F.transform("spans", lambda x: F.struct(x["a"].alias("from"), (x["b"] + length).alias("to"))).alias("ranges")), "suffix-ranges")
    for table in (told, starts):
        discard(table)
    return ranges


def _send(key: np.ndarray, place: np.ndarray, anchor: np.ndarray, ctx: np.ndarray, hot_batch: int) -> Iterator[pa.RecordBatch]:
    """A batch's runs and the group that each travels to. The first two copies of a context go
    to their anchor's group, or, if it has many contexts here, to the context's, and a marker
    tells the anchor's; further copies go anywhere, with a reference to the second."""
    by = np.lexsort((place, key, ctx, anchor))
    key, place, anchor, ctx = key[by], place[by], anchor[by], ctx[by]
    if len(key):
        again = (key[1:] == key[:-1]) & (place[1:] == place[:-1]) & (ctx[1:] == ctx[:-1]) & (anchor[1:] == anchor[:-1])
        keep = np.concatenate(([True], ~again))
        key, place, anchor, ctx = key[keep], place[keep], anchor[keep], ctx[keep]
    n = len(key)
    other = np.ones(n, bool)
    other[1:] = anchor[1:] != anchor[:-1]
    fresh = other.copy()
    fresh[1:] |= ctx[1:] != ctx[:-1]
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    number = np.cumsum(other) - 1
    many = np.bincount(number, weights=fresh)[number] >= hot_batch if n else np.zeros(0, bool)
    copy = np.arange(n) - start >= 2
    second = np.minimum(start + 1, max(n - 1, 0))
    mark = np.flatnonzero(other & many)
    zero = np.zeros(len(mark), np.int64)
    g = np.where(copy, _mix(key, place), np.where(many, _mix(anchor, ctx), anchor))
    kind = np.where(copy, 1, np.where(many, 2, 0))
    cols = [np.concatenate(x) for x in ((g, anchor[mark]), (np.where(copy, key[second], anchor), anchor[mark]), (np.where(copy, place[second] >> 16, ctx), zero), (key, zero), (place, zero), (kind, zero + 3))]
    for s in range(0, len(cols[0]), 100_000):
        part = [c[s : s + 100_000] for c in cols]
        part[5] = part[5].astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], names=["g", "anchor", "ctx", "id", "place", "kind"])


def _meet(batches: Iterator[pa.RecordBatch], hot_task: int, most_rows: int, region: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of whole groups, and what each is to be sent for. A group of over most_rows
    rows is settled in parts; it counts as hot, so none of its contexts needs the others."""
    rest: pa.Table | None = None
    large = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        g = t.column(0).to_numpy()
        if not len(g):
            continue
        cut = int(np.searchsorted(g, g[-1]))
        rest = t.slice(cut)
        if cut:
            yield from _settle(t.slice(0, cut), large, hot_task, region)
        if rest.num_rows > most_rows:
            large = int(g[-1])
            yield from _settle(rest, large, hot_task, region)
            rest = None
    if rest is not None:
        yield from _settle(rest, large, hot_task, region)


def _settle(t: pa.Table, large: int | None, hot_task: int, region: int) -> Iterator[pa.RecordBatch]:
    g, anchor, ctx, key, place, kind = (t.column(i).to_numpy() for i in range(6))
    out = []
    lost = kind == 1  # copies with a reference to the second of their batch
    out.append((np.full(int(lost.sum()), REST), np.ones(int(lost.sum()), bool), key[lost], place[lost], anchor[lost], ctx[lost]))
    marked = np.isin(g, g[kind == 3]) if (kind == 3).any() else np.zeros(len(g), bool)
    keep = (kind == 0) | (kind == 2)
    g, anchor, ctx, key, place, kind, marked = (x[keep] for x in (g, anchor, ctx, key, place, kind, marked))
    n = len(g)
    if n:
        group = np.ones(n, bool)
        group[1:] = (g[1:] != g[:-1]) | (anchor[1:] != anchor[:-1])
        fresh = group.copy()
        fresh[1:] |= ctx[1:] != ctx[:-1]
        same = ~fresh
        same[1:] &= (key[1:] == key[:-1]) & (place[1:] == place[:-1])
        g, anchor, ctx, key, place, kind, marked, group, fresh = (x[~same] for x in (g, anchor, ctx, key, place, kind, marked, group, fresh))
        n = len(g)
        number = np.cumsum(group) - 1
        forms = np.bincount(number, weights=fresh)[number]
        hot = (forms > hot_task) | marked | (kind == 2)
        if large is not None:
            hot |= g == large
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        nth = np.arange(n) - start
        several = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1] > 1
        second = np.minimum(start + 1, n - 1)
        zero = np.zeros(n, np.int64)
        route = _mix(key[start], place[start] >> (16 + region))
        for what, rows, at, ref in ((NEED, fresh & ((forms > 1) | hot), anchor, zero), (PAIR, several & (nth < 2), route, zero), (REST, nth >= 2, key[second], place[second] >> 16)):
            w = np.flatnonzero(rows)
            out.append((np.full(len(w), what), hot[w] & (what == NEED), key[w], place[w], at[w], ref[w]))
    what, hot, key, place, at, ref = (np.concatenate(x) for x in zip(*out, strict=True))
    for s in range(0, len(what), 100_000):
        w = slice(s, s + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(what[w].astype(np.int8)), pa.array(hot[w]), pa.array(key[w]), pa.array(place[w]), pa.array(at[w]), pa.array(ref[w])], names=["kind", "hot", "id", "place", "at", "ref"])


def _cut(b: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Documents (id, raw, runs) to the bytes that go to blocks. Runs that go with a first copy
    are joined where one's starts follow the other's."""
    lists, docs = b.column(2), b.column(1)
    sizes = np.diff(lists.offsets.to_numpy())
    fields = lists.flatten()
    kind, hot, at, place = (fields.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    first = place >> 16
    last, anchor_at = first + (place >> 8 & 0xFF), first + (place & 0xFF)
    ends = np.cumsum(sizes)
    out: list[list] = [[] for _ in range(7)]
    size = 0
    for d, key in enumerate(b.column(0).to_pylist()):
        raw = memoryview(docs[d].as_buffer())
        lo = ends[d] - sizes[d]
        mine = np.arange(lo, ends[d])
        pairs = mine[kind[mine] == PAIR]
        pairs = pairs[np.lexsort((first[pairs], at[pairs]))]
        new = np.ones(len(pairs), bool)
        new[1:] = (at[pairs][1:] != at[pairs][:-1]) | (first[pairs][1:] != last[pairs][:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:] - 1, len(pairs) - 1) if len(pairs) else heads
        found = list(zip(at[pairs[heads]].tolist(), first[pairs[heads]].tolist(), last[pairs[tails]].tolist(), strict=True))
        cold = mine[(kind[mine] == NEED) & ~hot[mine]]
        found += zip(at[cold].tolist(), first[cold].tolist(), last[cold].tolist(), strict=True)
        rows = [(block, 0, False, x, y) for block, x, y in found]
        for i in mine[(kind[mine] == NEED) & hot[mine]].tolist():
            # pieces by their starts' place against the anchor; each meets those that share the
            # bytes which all its strings share
            a, p = int(at[i]).to_bytes(8, "little", signed=True), int(anchor_at[i])
            for q in range((int(first[i]) - p) // PIECE, (int(last[i]) - p) // PIECE + 1):
                s = p + q * PIECE
                x, y = max(int(first[i]), s), min(int(last[i]), s + PIECE - 1)
                block = xxhash.xxh3_64_intdigest(a + q.to_bytes(2, "little", signed=True) + bytes(raw[s + PIECE - 1 : s + length]))
                form = xxhash.xxh3_64_intdigest(bytes(raw[x : y + length]), seed=x - p & 0xFFFF)
                rows.append((_signed(block), _signed(form), True, x, y))
        for block, form, is_hot, x, y in rows:
            for c, v in zip(out, (block, form, is_hot, key, x, y, raw[x : y + length]), strict=True):
                c.append(v)
            size += y + length - x
        if size > 1 << 22:
            yield _texts(out)
            out, size = [[] for _ in range(7)], 0
    yield _texts(out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _texts(cols: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(map(bytes, c) if t == pa.binary() else c, t) for c, t in zip(cols, types, strict=True)], names=["block", "form", "hot", "id", "first", "last", "bytes"])


def _blocks(t: pa.Table, length: int, block_bytes: int, search: Callable) -> Iterator[pa.RecordBatch]:
    """Whole blocks, transformed together up to block_bytes: the ranges of starts to remove,
    and the form of a last copy that goes as a whole."""
    if not t.num_rows:
        return
    block, form, key, first = t.column(0).to_numpy(), t.column(1), t.column(2).to_numpy(), t.column(3).to_numpy().astype(np.int64)
    raw = t.column(4).to_pylist()
    size = np.array([len(x) for x in raw])
    last_copy, form = ~form.is_null().to_numpy(), form.fill_null(0).to_numpy()
    ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, t.num_rows)
    total, start = np.cumsum(size), 0
    while start < t.num_rows:
        most = int(np.searchsorted(total, (total[start - 1] if start else 0) + block_bytes, side="right"))
        i = int(np.searchsorted(ends, most, side="right")) - 1
        end = int(ends[i]) if i >= 0 and ends[i] > start else int(ends[np.searchsorted(ends, start, side="right")])
        found = search(raw[start:end], key[start:end], first[start:end], length)
        if found:
            ctx, a, b = (np.array(x) for x in zip(*found, strict=True))
            ctx += start
            whole = last_copy[ctx] & (a == 0) & (b == size[ctx] - length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[ctx]), pa.array((first[ctx] + a).astype(np.int32)), pa.array((first[ctx] + b).astype(np.int32)), pa.array(block[ctx]), pa.array(form[ctx], pa.int64(), mask=~whole)],
                names=["id", "a", "b", "block", "form"],
            )
        start = end


def _inherited(rest: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, spans of a and b): the runs whose reference's starts are all among those to remove.
    A document's runs that refer to one document travel as one row."""

    @F.pandas_udf("array<struct<a: int, b: int>>")
    def joined(lists):
        rows = []
        for rs in lists:
            out: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in rs):
                if out and a <= out[-1][1] + 1:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            rows.append([{"a": a, "b": b} for a, b in out])
        return pd.Series(rows)

    first, size = F.shiftright("place", 16).cast("int"), F.shiftright("place", 8).bitwiseAND(F.lit(255)).cast("int")
    asked = rest.groupBy("at", "id").agg(F.collect_list(F.struct(first.alias("a"), (first + size).alias("b"), F.col("ref").cast("int").alias("ref"))).alias("runs"))
    wanted = starts.join(rest.select(F.col("at").alias("id")).distinct(), "id", "left_semi")
    have = dealt(wanted.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("r")), "id").select(F.col("id").alias("at"), joined("r").alias("r"))
    covered = lambda x: F.exists("r", lambda r: (r["a"] <= x["ref"]) & (r["b"] >= x["ref"] + x["b"] - x["a"]))
    found = dealt(asked, "at", "id").join(have, "at").select("id", F.transform(F.filter("runs", covered), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("spans"))
    return found.where(F.size("spans") > 0)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs plus `_doc`, a long: a document is earlier than another if its number is smaller.

    Integral ids that don't repeat are their own numbers. Otherwise documents are numbered by
    id (nulls first), then by a hash of the text; rows with one id and one text are one
    document, except that null ids are all different.
    """
    kind = docs.schema[id_col].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        n, different = docs.agg(F.count(F.lit(1)), F.count_distinct(F.col(id_col))).first()
        if n == different:
            return docs.withColumn("_doc", F.col(id_col).cast("long"))
    row = free_name(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "suffix-rows")
    own = F.when(F.col(id_col).isNull(), F.col(row)).otherwise(-1)
    keys = rows.select(row, F.col(id_col).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("text"), own.alias("own"))
    parts = keys.groupBy("key", "text", "own").agg(F.min(row).alias("least")).repartitionByRange("key", "text", "own").sortWithinPartitions("key", "text", "own")
    placed = materialize(parts.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "suffix-order")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # one row a task
    base = docs.sparkSession.createDataFrame([(p, sum(n for q, n in sizes if q < p)) for p, _ in sizes], "part int, base long")
    numbers = placed.join(F.broadcast(base), "part").select("key", "text", "own", (F.col("base") + F.col("place")).alias("_doc"))
    same = [keys[c].eqNullSafe(numbers[c]) for c in ("key", "text", "own")]
    return rows.join(keys.join(numbers, same[0] & same[1] & same[2]).select(row, "_doc"), row).drop(row)


def whole_characters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The part of bytes a..b of a UTF-8 text that covers whole characters."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def drop_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", characters: bool = False) -> DataFrame:
    """docs plus `_kept` (binary: the bytes that stay), `_spans` (the maximal removed byte
    ranges) and `_size`.

    A byte goes if it lies in a string of `length` bytes that also starts earlier: in a
    document with a smaller id, or before in the same one; judged on the input. Null and
    empty texts have nothing to remove. Repeated rows are one document and all stay alike;
    different texts under one id are documents of their own, by an order of their hashes;
    null ids come first and are all different. Other columns stay, under names other than
    `_doc` and those returned. Empty tables give no rows. Memory doesn't grow with a text but
    for the text itself. With `characters`, a character that a span covers in part stays whole
    in `_kept`.
    """
    cols = docs.columns
    rows = numbered(docs, id_col, text_col)
    gone = removals(rows.select(F.col("_doc").alias("id"), F.col(text_col).cast("string").alias("text")), length)
    ranges = dealt(gone.groupBy("id").agg(F.flatten(F.collect_list("ranges")).alias("_ranges")), "id").withColumnRenamed("id", "_doc")

    @F.pandas_udf("struct<kept binary, spans array<struct<from: int, to: int>>, size long>")
    def keep(texts, ranges):
        rows = []
        for raw, rs in zip(texts, ranges, strict=True):
            raw = raw or b""
            spans: list[list[int]] = []
            for a, b in sorted((r["from"], r["to"]) for r in (rs if rs is not None else ())):
                if a >= len(raw):
                    continue
                b = min(b, len(raw))
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            at, kept = 0, []
            for a, b in spans:
                if characters:
                    a, b = whole_characters(raw, a, b)
                kept.append(raw[at:a])
                at = b
            rows.append((b"".join([*kept, raw[at:]]), [{"from": a, "to": b} for a, b in spans], len(raw)))
        return pd.DataFrame(rows, columns=["kept", "spans", "size"])

    joined = rows.join(ranges, "_doc", "left")
    return joined.select(*cols, keep(F.col(text_col).cast("string").cast("binary"), "_ranges").alias("_r")).select(*cols, F.col("_r.kept").alias("_kept"), F.col("_r.spans").alias("_spans"), F.col("_r.size").alias("_size"))
