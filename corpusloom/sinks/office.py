"""Slides and documents as bytes of an Office file, for `row_files`: the least that readers need."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DRAWING = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_STAMP = (1980, 1, 1, 0, 0, 0)  # equal input, equal bytes


def _zipped(parts: list[tuple[str, str]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts:
            z.writestr(zipfile.ZipInfo(name, _STAMP), text)
    return out.getvalue()


def slide_deck(texts: Column) -> Column:
    """An array of slide texts as a .pptx: a slide each, a paragraph for each line."""

    @F.pandas_udf("binary")
    def deck(rows: pd.Series) -> pd.Series:
        slide = lambda t: f"<p {_DRAWING}>" + "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in t.split("\n")) + "</p>"
        return pd.Series([_zipped([(f"ppt/slides/slide{i}.xml", slide(t or "")) for i, t in enumerate(r, 1)]) for r in rows], dtype=object)

    return deck(texts)


def word_document(headings: Column, texts: Column) -> Column:
    """Arrays of whether a paragraph is a heading and of its text as a .docx."""

    @F.pandas_udf("binary")
    def document(marks: pd.Series, rows: pd.Series) -> pd.Series:
        style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
        body = lambda m, r: "".join(f"<w:p>{style if h else ''}<w:r><w:t>{escape(t or '')}</w:t></w:r></w:p>" for h, t in zip(m, r, strict=True))
        return pd.Series([_zipped([("word/document.xml", f"<w:document {_WORD}><w:body>{body(m, r)}</w:body></w:document>")]) for m, r in zip(marks, rows, strict=True)], dtype=object)

    return document(headings, texts)
