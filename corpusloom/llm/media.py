"""Media columns: interleaved document sequences.

A page's HTML is parsed into ordered items, texts and media references with captions.
Payloads live in a media table keyed by digest; references are resolved by a join on the
digest that carries features, not payloads. Every item keeps its place and its caption.
Media are stored as WAV files of 8-bit mono samples.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dealt, materialize, slices, text_bytes

#: Payloads are filled with spaces up to a positive multiple of this.
UNIT = 192
RATE = 8000
ITEM = "struct<pos: int, kind: string, text: string, ref: string, caption: string>"
_BLOCKS = {"p", "div", "article", "section", "main", "header", "footer", "nav", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "blockquote", "pre", "body", "html", "figure"}
_MEDIA = {"img", "audio", "video", "source"}
_SILENT = {"script", "style", "noscript", "template", "title"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []  # kind, text, ref, caption
        self.words: list[str] = []
        self.silent = 0
        self.caption: list[str] | None = None
        self.figure: list[int] = []

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA:
            have = dict(attrs)
            if have.get("src"):
                self.flush()
                self.items.append(["media", None, have["src"], have.get("alt") or None])
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure.append(len(self.items))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.items[self.figure[-1] :] if self.figure else ():
                if item[0] == "media":
                    item[3] = text or item[3]
        elif tag in _BLOCKS:
            self.flush()
            if tag == "figure" and self.figure:
                self.figure.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse_page(page: str | None) -> list[dict]:
    """Ordered items of a page: texts between block tags, media with src and caption (the
    figure's, else alt). Null, empty and broken pages give what can be read, at worst none."""
    p = _Page()
    p.feed(page or "")
    p.close()
    p.flush()
    return [{"pos": i, "kind": k, "text": t, "ref": r, "caption": c} for i, (k, t, r, c) in enumerate(p.items)]


def interleave(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """(keep..., pos, kind, text, ref, caption): one row an item of each page, in order by
    pos. A page without items gives no rows."""

    @F.pandas_udf(f"array<{ITEM}>")
    def parse(texts):
        import pandas as pd

        return pd.Series([parse_page(x) for x in texts])

    return pages.select(*keep, F.explode(parse(F.col(html_col).cast("string"))).alias("i")).select(*keep, "i.*")


def wav(payload: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(stored: bytes) -> bytes:
    """The samples of a stored WAV file, found by walking its chunks."""
    at = 12
    while at + 8 <= len(stored):
        kind, n = stored[at : at + 4], struct.unpack("<I", stored[at + 4 : at + 8])[0]
        if kind == b"data":
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def features(payload: bytes) -> str:
    """Loudness, mean, sign changes around the mean and spread of 8-bit samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    mean = x.mean()
    c = x - mean
    turns = np.count_nonzero(np.signbit(c[1:]) != np.signbit(c[:-1])) / len(x)
    return f"seconds={len(x) / RATE:.6f};mean={mean:.4f};rms={np.sqrt((c * c).mean()):.4f};zcr={turns:.6f};min={int(x.min())};max={int(x.max())}"


def store(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts as media: (id, html, digest, n_bytes, media), written to the shared folder.

    A text's UTF-8 bytes, filled with spaces to a positive multiple of UNIT, are the samples
    of a WAV file; its page shows the file by its digest. Null texts are empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(1))
            for i, j in slices(off, 1 << 23):
                pages, digests, sizes, media = [], [], [], []
                for k in range(i, j):
                    body = raw[off[k] : off[k + 1]].tobytes()
                    file = wav(body.ljust(max(UNIT, -(-len(body) // UNIT) * UNIT)))
                    digest = hashlib.sha256(file).hexdigest()
                    pages.append(f'<article><p>Text of {len(body)} bytes.</p><figure><audio src="sha256:{digest}"></audio><figcaption>{html.escape(str(b.column(0)[k].as_py()))}</figcaption></figure></article>')
                    digests.append(digest)
                    sizes.append(len(body))
                    media.append(file)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(pages), pa.array(digests), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["key", "html", "digest", "n_bytes", "media"])

    kind = texts.schema[id_col].dataType.simpleString()
    out = texts.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"key {kind}, html string, digest string, n_bytes long, media binary")
    return materialize(out, "media").withColumnRenamed("key", id_col)


def media_features(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """One row a stored file: its digest and what is computed from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for m in b.column(0):
                file = m.as_buffer().to_pybytes()
                payload = samples(file)
                row = (hashlib.sha256(file).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), features(payload))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"
    return stored.select(media_col).mapInArrow(run, schema)


def resolve(items: DataFrame, feats: DataFrame, ref_col: str = "ref") -> DataFrame:
    """Items with the features of the media they refer to as sha256:<digest>.

    Files are collapsed to one row a digest first; references that resolve to nothing, and
    texts, keep null features, so every item stays at its place.
    """
    per = dealt(feats.groupBy("digest").agg(*(F.first(c).alias(c) for c in feats.columns if c != "digest")), "digest")
    ref = F.when(F.col(ref_col).startswith("sha256:"), F.substring(ref_col, 8, 64))
    return items.withColumn("_d", ref).join(per.withColumnRenamed("digest", "_d"), "_d", "left").withColumnRenamed("_d", "media_sha256")
