"""Text files as pages of fixed-pitch lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TextPage:
    """Letter paper, 72-point margins, an 11-point face of 0.6 em, leading 1.35: 70 columns, 43 lines."""

    size: float = 11.0
    width: float = 612.0
    height: float = 792.0
    margin: float = 72.0
    leading: float = 1.35
    tab: int = 4

    @property
    def columns(self) -> int:
        return int((self.width - 2 * self.margin) / (self.size * 0.6) + 1e-9)

    @property
    def rows(self) -> int:
        return int((self.height - 2 * self.margin) / (self.size * self.leading) + 1e-9)


def wrap(line: str, columns: int) -> list[str]:
    """Greedy wrap at blanks; a word wider than the line is broken by character."""
    if len(line) <= columns:
        return [line]
    out, current = [], ""
    for word in line.split(" "):
        joined = f"{current} {word}" if current else word
        if len(joined) <= columns:
            current = joined
            continue
        if current:
            out.append(current)
        while len(word) > columns:
            out.append(word[:columns])
            word = word[columns:]
        current = word
    return [*out, current] if current or not out else out


def printable(text: str) -> tuple[str, int]:
    """Characters that the face can't show (beyond Latin-1, or controls) as ?, and how many there were."""
    out = "".join(c if 32 <= ord(c) < 127 or 160 <= ord(c) < 256 else "?" for c in text)
    return out, sum(a != b for a, b in zip(text, out, strict=True))


def text_pages(docs: DataFrame, layout: TextPage | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, page, row, text, replaced: the lines of every document on its pages, both from 1.

    A line that is exactly a form feed starts a page. Null texts have one empty page.
    """
    layout = layout or TextPage()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "page", "row", "text", "replaced"]
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page, row = 1, 0
                for line in (text or "").replace("\r\n", "\n").replace("\r", "\n").replace("\t", " " * layout.tab).split("\n"):
                    if line == "\f":
                        page, row = page + 1, 0
                        continue
                    clean, replaced = printable(line)
                    for k, part in enumerate(wrap(clean, layout.columns)):
                        if row == layout.rows:
                            page, row = page + 1, 0
                        row += 1
                        for c, v in zip(columns, (doc_id, page, row, part, replaced if not k else 0), strict=True):
                            c.append(v)
                if len(columns[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *map(pa.array, columns[1:])], names)
                    columns = [[], [], [], [], []]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), *map(pa.array, columns[1:])], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, page long, row long, text string, replaced long"
    )
