"""Packing token sequences: concatenate and cut.

First pass: each task tokenizes its documents, keeps a running token count, and the
result is written once to the shared folder. The totals of the tasks (one small row for
each) give every task its global offset by a prefix sum. Second pass: each document's
global offset is its task's offset plus its own, and fixed windows are cut from that;
a document that crosses a window's end leaves a boundary record (`continues`/`continued`).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, slices, text_bytes

PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, continued boolean, continues boolean"

#: How byte-level BPE cuts a text before merging; a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that the tokenizer's own library takes at once.
AT_ONCE = 64
#: White space that tiktoken's look-ahead can step back over at once; longer runs, which it
#: fails on from about a million on, go to the tokenizer's own library.
LONGEST_BLANK = 250_000
_BLANK = re.compile(r"\s{%d}" % LONGEST_BLANK)
_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


class TextEncoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    A byte-level BPE file whose merges stand in the order of their ids is merged by rank, which
    tiktoken does several times faster from the same file. Texts that hold an added token's
    string or a very long run of white space, and all texts of any other file, go to the
    tokenizers library itself. With
    `special` unset the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.special = path, special
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = [*file["model"]["vocab"].values(), *(t["id"] for t in file.get("added_tokens", []))]
        self.wide = np.dtype("<u2") if max(ids) < 1 << 16 else np.dtype("<u4")
        self.added = [t["content"] for t in file.get("added_tokens", []) if special or not t["special"]]
        self.fast = by_rank(file)

    @cached_property
    def tokenizer(self):
        """The library's own tokenizer, loaded where a text needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = not self.special
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as bytes of dtype `wide`, one item a text."""
        if self.fast is None:
            return self._own(texts)
        one, wide = self.fast.encode_to_numpy, self.wide
        slow = lambda x: any(a in x for a in self.added) or len(x) >= LONGEST_BLANK and _BLANK.search(x) is not None
        out = [None if slow(x) else one(x, disallowed_special=()).astype(wide).tobytes() for x in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._own([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _own(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), AT_ONCE):
            out += [np.array(e.ids, self.wide).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + AT_ONCE], add_special_tokens=False)]
        return out


def byte_characters() -> dict[str, int]:
    """The characters that byte-level BPE files write bytes as: printable Latin-1 characters
    stand for themselves, the other bytes, in order, for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def by_rank(file: dict):
    """A tiktoken encoding of the tokenizer file's model, where it merges by rank; else None."""
    model, pre = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file.get("normalizer") or file.get("post_processor") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    import tiktoken

    vocab, byte = model["vocab"], byte_characters()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [vocab[a + b] for a, b in pairs]
    added = {t["content"] for t in file.get("added_tokens", [])}
    known = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in added}
    if any(y <= x for x, y in zip(ids, ids[1:], strict=False)) or len(known) != 256 + len(ids) or not all(bytes([b]) in known for b in range(256)):
        return None
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})


def encoder(path: str, special: bool = True) -> TextEncoder:
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = TextEncoder(path, special)
    return _ENCODERS[path, special]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """One row a document: its ids with end_id, its task, and the tokens before it in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, done = encoder(tokenizer, special), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.wide).tobytes()
        for b in batches:
            _, off = text_bytes(b.column(1))
            for i, j in slices(off):
                c = b.slice(i, j - i)
                ids = [x + end for x in enc.encode([x or "" for x in c.column(1).to_pylist()])]
                n = np.array([len(x) // enc.wide.itemsize for x in ids], np.int64)
                before = done + np.cumsum(n) - n
                done += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [c.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), pa.array(np.full(len(n), enc.wide.itemsize, np.int32)), pa.array(ids, pa.binary())],
                    names=["key", "part", "before", "n", "wide", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"key {kind}, part int, before long, n long, wide int, ids binary")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """Pack all documents into windows of `window` tokens; only the last window may be short.

    Returns one row a piece: the id, start (tokens of the document before it), length,
    doc_tokens, sequence_id, offset in the sequence, ids (little-endian uint32 bytes),
    continued and continues (whether the document also lies before or after the piece).

    Null and empty texts are a document of end_id alone. Repeated rows are packed as
    often as they come. An empty table gives no rows. Null ids are kept as null. Very long
    texts give as many pieces as they fill windows. Other columns aren't read, so their names
    can't clash. The order is that of the input's partitions; each id lies in exactly one
    piece. Added tokens' strings in a text are those tokens, as the library has it;
    `special` unset takes the strings of special ones for ordinary text.
    """
    spark = docs.sparkSession
    rows = materialize(tokenize(docs, tokenizer, end_id, id_col, text_col, special), "packing")
    totals = {r["part"]: r["total"] for r in rows.groupBy("part").agg(F.sum("n").alias("total")).collect()}
    parts = sorted(totals)
    ends = np.cumsum([totals[p] for p in parts]) if parts else np.zeros(0, np.int64)
    base = spark.createDataFrame([(p, int(e - totals[p])) for p, e in zip(parts, ends, strict=True)], "part int, base long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out, keys = b.column(1).to_numpy() + b.column(2).to_numpy(), [], []
            for i, (g, wide, raw) in enumerate(zip(at.tolist(), b.column(3).to_pylist(), b.column(4), strict=True)):
                ids = np.frombuffer(raw.as_buffer(), f"<u{wide}").astype("<u4")
                n, s = len(ids), 0
                while s < n:
                    e = min(n, s + window - (g + s) % window)
                    out.append((s, e - s, n, (g + s) // window, (g + s) % window, ids[s:e].tobytes(), s > 0, e < n))
                    keys.append(i)
                    s = e
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64()] * 5 + [pa.binary(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[b.schema.names[0], "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "continued", "continues"])

    kind = rows.schema["key"].dataType.simpleString()
    placed = rows.join(F.broadcast(base), "part").select("key", "before", "base", "wide", "ids")
    return placed.mapInArrow(cut, f"key {kind}, {PIECES}").withColumnRenamed("key", id_col)


def padding(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """Tokens of padding for each sequence; a length that is a power of two needs none."""
    n = F.sum("length")
    power = F.bit_count(n) == 1
    return pieces.groupBy("sequence_id").agg(n.alias("tokens"), F.when(power, 0).otherwise(F.lit(window) - n).cast("long").alias("padding"))
