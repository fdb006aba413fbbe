"""Text that a reader sees on a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

_HIDDEN = {"script", "style", "noscript", "template"}
_BLOCKS = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: list[str] = []
        self.body: list[str] = []
        self.hidden = 0
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag in _BLOCKS:
            self.body.append(" ")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in _BLOCKS:
            self.body.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            (self.title if self.in_title else self.body).append(data)


def _plain(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", "".join(parts)).strip()


def read(html: str | None) -> tuple[str, str]:
    """(title, body), white space runs as one blank; empty for null."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return _plain(reader.title), _plain(reader.body)


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, title and body; one narrow pass in Arrow batches."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=[id_col, "title", "body"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(apply, f"{id_col} {kind}, title string, body string")
