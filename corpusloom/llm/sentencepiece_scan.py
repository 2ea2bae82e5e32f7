"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text's pieces are those of the best path: the greatest sum of piece scores, and on ties
the earliest start of the last piece that differs. Texts over `chunk` characters are split
into chunks that different tasks work on:

1. each chunk yields a transfer matrix: entry (s, t) is its best score when the piece before
   reaches s characters into it and its own last piece reaches t into the next;
2. matrices are combined by the max-plus product, in blocks and then over blocks, which
   gives the best scores at each chunk's start (a vector over s);
3. with that vector each chunk finds, by itself, which s leads to each t; following those
   maps from the end fixes every boundary;
4. each chunk is traced back between its two boundaries, independently.

No piece holds the word mark after another character, so the best path always breaks before
a word; words are found once and remembered, and only the ragged ends of a chunk are
searched for all boundary states.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

MARK = "▁"
CHUNK, BLOCK = 32_768, 256
CACHE_WORDS = 150_000
#: Words up to this length are searched together.
LONG = 40
NONE = float("-inf")
_MODELS: dict[str, Vocabulary] = {}


class Vocabulary:
    """Pieces and scores of a SentencePiece file; characters without a piece fall back to
    bytes at the least score less 10 (the library's penalty)."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (i, float(model.get_score(i))) for i in plain}
        self.unknown = min(s for _, s in self.pieces.values()) - 10
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("a model with byte pieces is needed")
        self.longest = max(map(len, self.pieces))
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces may hold the word mark only at their start")
        self.joined = set("".join(p for p in self.pieces if len(p) > 1))
        self.bytes = [b""] * n
        for p, (i, _) in self.pieces.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in self.joined)
        self.words_of = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.words: dict[str, tuple[bytes, float]] = {}

    @cached_property
    def trie(self) -> dict:
        """Pieces by character; "" holds the score of the piece that ends there."""
        root: dict = {}
        for p, (_, score) in self.pieces.items():
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = score
        return root

    def _flatten(self) -> None:
        """The trie as sorted (node, character) keys, for searching many words at once."""
        keys, child, self.node_id, self.node_score = [], [], [-1], [NONE]
        ids = {0: self.trie}
        names = {0: ""}
        for number in range(1 << 30):
            if number not in ids:
                break
            node, name = ids.pop(number), names.pop(number)
            if "" in node:
                self.node_id[number], self.node_score[number] = self.pieces[name][0], node[""]
            for c, below in node.items():
                if c:
                    new = len(self.node_id)
                    self.node_id.append(-1)
                    self.node_score.append(NONE)
                    ids[new], names[new] = below, name + c
                    keys.append(number << 21 | ord(c))
                    child.append(new)
        by = np.argsort(keys)
        self.keys, self.child = np.array(keys, np.int64)[by], np.array(child, np.int32)[by]
        self.node_id, self.node_score = np.array(self.node_id, np.int32), np.array(self.node_score)

    def many_words(self, words: list[str]) -> list[tuple[bytes, float]]:
        """As word(), for words of up to LONG characters at once."""
        if not hasattr(self, "keys"):
            self._flatten()
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, width).astype(np.int64)
        best, back, piece = np.full((n, width + 1), NONE), np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        best[:, 0] = 0.0
        last = len(self.keys) - 1
        for i in range(width):
            rows = np.flatnonzero((size > i) & (best[:, i] > NONE))
            here, node, alone = best[rows, i], np.zeros(len(rows), np.int64), rows
            j = i
            while len(rows):
                key = node << 21 | codes[rows, j]
                at = np.minimum(np.searchsorted(self.keys, key), last)
                ok = (self.keys[at] == key) & (size[rows] > j)
                rows, here, node = rows[ok], here[ok], self.child[at[ok]].astype(np.int64)
                j += 1
                score = here + self.node_score[node]
                if j == i + 1:
                    alone = np.setdiff1d(alone, rows[score > NONE], assume_unique=True)
                up = score > best[rows, j] if len(rows) else ok[:0]
                best[rows[up], j], back[rows[up], j], piece[rows[up], j] = score[up], i, self.node_id[node[up]]
                if j == width:
                    break
            score = best[alone, i] + self.unknown
            up = score > best[alone, i + 1]
            best[alone[up], i + 1], back[alone[up], i + 1], piece[alone[up], i + 1] = score[up], i, -1
        out, total = np.zeros((n, width), np.int32), best[np.arange(n), size]
        count, at = np.zeros(n, np.int64), size.copy()
        rows = np.flatnonzero(at > 0)
        while len(rows):
            out[rows, count[rows]] = piece[rows, at[rows]]
            count[rows] += 1
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        odd = set(np.flatnonzero((out < 0).any(axis=1)).tolist())
        flat = out.astype("<u2")[:, ::-1].tobytes()
        return [self.word(words[k]) if k in odd else (flat[2 * ((k + 1) * width - c) : 2 * (k + 1) * width], t) for k, (c, t) in enumerate(zip(count.tolist(), total.tolist(), strict=True))]

    def search(self, text: str, start: dict[int, float], end: int) -> tuple[list[float], list[int]]:
        """Best scores at each place up to `end`, and where the piece that ends there began
        (-1: before the text). start: scores of places reached from before."""
        n = min(len(text), end)
        best, back = [NONE] * (n + 1), [-1] * (n + 1)
        trie, unknown = self.trie, self.unknown
        for s, v in start.items():
            if s <= n:
                best[s] = v
        # starts in order and only better scores taken, so ties keep the earliest start
        for i in range(n):
            here = best[i]
            if here == NONE:
                continue
            node, j = trie, i
            while j < n:
                node = node.get(text[j])
                if node is None:
                    break
                j += 1
                c = node.get("")
                if c is not None and here + c > best[j]:
                    best[j], back[j] = here + c, i
            if text[i] not in trie or "" not in trie[text[i]]:
                if here + unknown > best[i + 1]:
                    best[i + 1], back[i + 1] = here + unknown, i
        return best, back

    def ids(self, piece: str) -> list[int]:
        p = self.pieces.get(piece)
        return [p[0]] if p else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]

    def trace(self, text: str, back: list[int], end: int) -> tuple[int, list[int]]:
        """(place where the path enters, ids from there to end)."""
        pieces = []
        while back[end] >= 0 and end:
            pieces.append(text[back[end] : end])
            end = back[end]
        return end, [i for p in reversed(pieces) for i in self.ids(p)]

    def word(self, w: str) -> tuple[bytes, float]:
        best, back = self.search(w, {0: 0.0}, len(w))
        return array("H", self.trace(w, back, len(w))[1]).tobytes(), best[-1]

    def learn(self, words: list[str]) -> None:
        """Remember words that aren't known, short ones together."""
        words.sort(key=len)
        short = [w for w in words if len(w) <= LONG]
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            self.words.update(zip(part, self.many_words(part), strict=True))
        for w in words[len(short) :]:
            self.words[w] = self.word(w)

    def encode_many(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """As encode_marked, for several texts; their words are looked up together."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        cut = [self.words_of.findall(t) for t in texts]
        self.learn(list({w for ws in cut for w in ws}.difference(self.words)))
        get = self.words.__getitem__
        out = []
        for ws in cut:
            found = list(map(get, ws))
            out.append((b"".join([x[0] for x in found]), sum([x[1] for x in found])))
        return out

    def encode_marked(self, text: str) -> tuple[bytes, float]:
        """Ids (little-endian uint16) and score of marked text from word to word."""
        ws = self.words_of.findall(text)
        known = self.words
        self.learn([w for w in set(ws) if w not in known])
        found = [known[w] for w in ws]
        return b"".join([x[0] for x in found]), sum([x[1] for x in found])

    def cuts(self, text: str) -> tuple[int, int] | None:
        """First and last place within text (ends left out) where every path breaks."""
        at = [m.start() for m in re.finditer(f"(?<=[^{MARK}]){MARK}", text)]
        return (at[0], at[-1]) if at else None

    # chunks: text is the chunk and up to longest - 1 characters after it; n the chunk's own

    def matrix(self, text: str, n: int, last: bool) -> np.ndarray:
        k = self.longest
        out = np.full((k, k), NONE)
        cut = self.cuts(text[:n])
        if cut is None:
            for s in range(min(k, n + 1)):
                out[s] = self._ends(text, {s: 0.0}, n, last)
            return out
        middle = self.encode_marked(text[cut[0] : cut[1]])[1]
        tail = self._ends(text[cut[1] :], {0: 0.0}, n - cut[1], last)
        for s in range(min(k, cut[0] + 1)):
            head = self.search(text[s : cut[0]], {0: 0.0}, cut[0] - s)[0][-1]
            out[s] = head + middle + tail
        return out

    def _ends(self, text: str, start: dict[int, float], n: int, last: bool) -> np.ndarray:
        """Best scores of paths whose last piece begins before n and ends at n + t."""
        best, _ = self.search(text, start, n)
        k, out = self.longest, np.full(self.longest, NONE)
        out[0] = best[n]
        for t in range(1, 1 if last else k):
            out[t] = max((best[i] + self.pieces[text[i : n + t]][1] for i in range(max(0, n + t - k), n) if text[i : n + t] in self.pieces and n + t <= len(text)), default=NONE)
        return out

    def entries(self, text: str, n: int, last: bool, start: dict[int, float]) -> list[int]:
        """For each t, the s by which the best path enters; one for all t behind a cut."""
        cut = self.cuts(text[:n])
        if cut is not None:
            _, back = self.search(text[: cut[0]], start, cut[0])
            return [self.trace(text[: cut[0]], back, cut[0])[0]] * self.longest
        return [self.between(text, n, t, start)[0] for t in range(1 if last else self.longest)]

    def between(self, text: str, n: int, t: int, start: dict[int, float]) -> tuple[int, bytes]:
        """(s, ids) of the best path through a chunk that ends t characters after it."""
        cut = self.cuts(text[:n])
        if cut is None:
            begin, part, seeds = 0, text, start
        else:
            begin, part, seeds = cut[1], text[cut[1] :], {0: 0.0}
        end = n - begin
        best, back = self.search(part, seeds, end)
        if t == 0:
            enter, ids = self.trace(part, back, end)
        else:
            options = [(best[i] + self.pieces[part[i : end + t]][1], -i) for i in range(max(0, end + t - self.longest), end) if part[i : end + t] in self.pieces and len(part) >= end + t and best[i] > NONE]
            if not options:
                return 0, b""
            i = -max(options)[1]
            enter, ids = self.trace(part, back, i)
            ids = ids + self.ids(part[i : end + t])
        raw = np.array(ids, "<u2").tobytes()
        if cut is None:
            return enter, raw
        head = text[: cut[0]]
        _, back = self.search(head, start, cut[0])
        enter, first = self.trace(head, back, cut[0])
        return enter, np.array(first, "<u2").tobytes() + self.encode_marked(text[cut[0] : cut[1]])[0] + raw

    def decode(self, ids: bytes) -> str:
        get = self.bytes.__getitem__
        text = b"".join(map(get, np.frombuffer(ids, "<u2").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def vocabulary(path: str) -> Vocabulary:
    if path not in _MODELS:
        _MODELS[path] = Vocabulary(path)
    return _MODELS[path]


def mark(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def encode(docs: DataFrame, model: str, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, keep..., ids binary, score double): pieces of each whole text, as little-endian
    uint16. Null and empty texts have none and score 0; an empty table gives none. Repeated rows
    and null ids stay. Of paths with equal scores the one whose last pieces start earliest is
    taken, in chunks as in whole texts. A literal word mark in a text decodes to a space, as in
    the library. Columns of docs that keep doesn't name aren't read, so any name may occur;
    those it names are called other than ids, score, _text and _row."""
    if chunk < 64:
        raise ValueError("chunks of 64 characters at least")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(id_col, *keep).schema)
    named = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("_text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                found = v.encode_many([mark(x or "") for x in c.column(c.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*c.columns[:-1], pa.array([x[0] for x in found], pa.binary()), pa.array([float(x[1]) for x in found], pa.float64())], names=[*c.schema.names[:-1], "ids", "score"])

    small = named.where(F.coalesce(F.length("_text"), F.lit(0)) < chunk).mapInArrow(short, f"{kind}, ids binary, score double")
    return small.unionByName(_encode_giants(named.where(F.length("_text") >= chunk), model, chunk, [id_col, *keep]))


def _encode_giants(docs: DataFrame, model: str, chunk: int, keep: list[str]) -> DataFrame:
    giants = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "giants")
    look = 64  # at least the longest piece

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of each text, 64 a batch: a text is read once, from left to right."""
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                m = mark(text.as_py())
                size = -(-len(m) // chunk)
                for i in range(0, size, 64):
                    at = range(i, min(i + 64, size))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row] * len(at), pa.int64()),
                            pa.array(at, pa.int32()),
                            pa.array([c == size - 1 for c in at]),
                            pa.array([min(chunk, len(m) - c * chunk) for c in at], pa.int32()),
                            pa.array([m[c * chunk : (c + 1) * chunk + look] for c in at]),
                        ],
                        names=["_row", "c", "last", "n", "text"],
                    )

    pieces = giants.select("_row", "_text").mapInArrow(cut, "_row long, c int, last boolean, n int, text string")
    chunks = materialize(pieces.repartition("_row", "c"), "giant-chunks")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for f in frames:
            yield pd.DataFrame({"_row": f["_row"], "c": f["c"], "m": [v.matrix(t, n, last).ravel() for t, n, last in zip(f["text"], f["n"], f["last"], strict=True)]})

    made = materialize(chunks.select("_row", "c", "n", "last", "text").mapInPandas(matrices, "_row long, c int, m array<double>"), "giant-matrices")
    block = F.floor(F.col("c") / BLOCK).cast("int")

    def square(m) -> np.ndarray:
        x = np.asarray(m, np.float64)
        k = int(round(len(x) ** 0.5))
        return x.reshape(k, k)

    def combine(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("c")
        whole = None
        for m in f["m"]:
            whole = square(m) if whole is None else product(whole, square(m))
        return pd.DataFrame({"_row": f["_row"].iloc[:1], "b": f["b"].iloc[:1], "m": [whole.ravel()]})

    def first_vectors(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("b")
        k = square(f["m"].iloc[0]).shape[0]
        at, out = np.full(k, NONE), []
        at[0] = 0.0
        for m in f["m"]:
            out.append(at)
            at = (at[:, None] + square(m)).max(axis=0)
        return pd.DataFrame({"_row": f["_row"], "b": f["b"], "v": out})

    def vectors(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("c")
        at, out = np.asarray(f["v"].iloc[0], np.float64), []
        for m in f["m"]:
            out.append(at)
            at = (at[:, None] + square(m)).max(axis=0)
        total = at[0]
        return pd.DataFrame({"_row": f["_row"], "c": f["c"], "v": out, "total": total})

    blocks = made.withColumn("b", block).groupBy("_row", "b").applyInPandas(combine, "_row long, b int, m array<double>")
    starts = blocks.groupBy("_row").applyInPandas(first_vectors, "_row long, b int, v array<double>")
    at_chunks = materialize(made.withColumn("b", block).join(starts, ["_row", "b"]).groupBy("_row", "b").applyInPandas(vectors, "_row long, c int, v array<double>, total double"), "giant-vectors")

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for f in frames:
            yield pd.DataFrame({"_row": f["_row"], "c": f["c"], "f": [v.entries(t, n, last, _starts(at)) for t, n, last, at in zip(f["text"], f["n"], f["last"], f["v"], strict=True)]})

    def follow(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("c", ascending=False)
        t, out = 0, []
        for m in f["f"]:
            out.append(t)
            t = int(m[t])
        return pd.DataFrame({"_row": f["_row"], "c": f["c"], "t": out})

    ready = chunks.join(at_chunks.select("_row", "c", "v"), ["_row", "c"])
    exits = ready.mapInPandas(maps, "_row long, c int, f array<int>").groupBy("_row").applyInPandas(follow, "_row long, c int, t int")

    def traces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(model)
        for f in frames:
            yield pd.DataFrame({"_row": f["_row"], "c": f["c"], "ids": [v.between(x, n, t, _starts(at))[1] for x, n, t, at in zip(f["text"], f["n"], f["t"], f["v"], strict=True)]})

    traced = ready.join(exits, ["_row", "c"]).select("_row", "c", "n", "t", "v", "text").mapInPandas(traces, "_row long, c int, ids binary")
    whole = traced.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("c", "ids"))).alias("x"))
    joined = F.unhex(F.array_join(F.transform("x", lambda r: F.hex(r["ids"])), ""))
    # a document's score is its vector product over all blocks
    scores = at_chunks.withColumn("b", block).groupBy("_row").agg(F.max_by("total", "c").alias("score"))
    return giants.select("_row", *keep).join(whole, "_row").join(scores, "_row").select(*keep, joined.alias("ids"), "score")


def _starts(v) -> dict[int, float]:
    return {s: float(x) for s, x in enumerate(v) if x is not None and x > NONE}


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the texts that the ids stand for. Null ids give null."""

    @F.pandas_udf("string")
    def text(ids):
        v = vocabulary(model)
        return pd.Series([None if x is None else v.decode(bytes(x)) for x in ids])

    return encoded.withColumn(out_col, text(ids_col))
