"""hOCR: words with boxes and confidence, and the line metrics in force."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import decode_entities

_TAG = re.compile(r"<(/?)(span|div)\b([^>]*)>", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
#: The classes of elements that set the line in force.
LINES = {"ocr_line", "ocr_textfloat", "ocr_header", "ocr_caption"}


#: Words that are gathered before they are handed on.
WORDS = 16_384


def fields(title: str) -> dict[str, list[float]]:
    """The numbers of each property of a title attribute: `bbox 1 2 3 4; x_wconf 90`. Properties without numbers are left out."""
    found = {}
    for part in title.split(";"):
        name, *values = part.split() or [""]
        try:
            found[name] = [float(v) for v in values]
        except ValueError:
            continue
    return found


def _box(title: dict[str, list[float]]) -> tuple[int, ...] | None:
    box = title.get("bbox", [])
    return tuple(int(v) for v in box) if len(box) == 4 else None


def page_box(hocr: str) -> tuple[int, ...]:
    """The box of the page element; a text without one is an error."""
    for m in _TAG.finditer(hocr):
        attributes = _attributes(m[3]) if not m[1] else {}
        if "ocr_page" in attributes.get("class", "").split():
            box = _box(fields(attributes.get("title", "")))
            if box is not None:
                return box
    raise ValueError("no page with a box")


def _attributes(tag: str) -> dict[str, str]:
    return {name.lower(): double or single for name, double, single in _ATTRIBUTE.findall(tag)}


def words(hocr: str) -> list[tuple]:
    """(text, x0, y0, x1, y1, confidence, baseline, size). A word with a text but without a box, with an empty one, or without
    an end is an error; one without a text is left out.

    The line that began last is in force. If it has a baseline, a word's is that at its centre, and its size is the line's
    x_size or else the height of its box; they are None otherwise.
    """
    out: list[tuple] = []
    open_: list[tuple[int, tuple[int, ...] | None, float, tuple | None] | None] = []
    line: tuple[int, int, float, float, float] | None = None
    for m in _TAG.finditer(hocr):
        if not m[1]:
            attributes = _attributes(m[3])
            classes, title = set(attributes.get("class", "").split()), fields(attributes.get("title", ""))
            box = _box(title)
            if "ocrx_word" in classes:
                open_.append((m.end(), box, (title.get("x_wconf") or [0.0])[0], line))
                continue
            if box and classes & LINES:
                base = title.get("baseline", [])
                size = (title.get("x_size") or [float(box[3] - box[1])])[0]
                line = (box[0], box[3], base[0], base[1], size) if len(base) > 1 else None
            open_.append(None)
            continue
        word = open_.pop() if open_ else None
        if word is None:
            continue
        start, box, conf, own = word
        text = " ".join(decode_entities(re.sub(r"<[^>]*>", "", hocr[start : m.start()])).split())
        if not text:
            continue
        if box is None:
            raise ValueError(f"{text!r} has no box")
        x0, y0, x1, y1 = box
        if x1 <= x0 or y1 <= y0:
            raise ValueError(f"empty box of {text!r}")
        base = None if own is None else own[1] + own[2] * ((x0 + x1) / 2 - own[0]) + own[3]
        out.append((text, x0, y0, x1, y1, conf, base, own[4] if own is not None and own[4] > 0 else None))
    if any(open_):
        raise ValueError("a word without an end")
    return out


def hocr_words(pages: DataFrame, id_col: str, hocr_col: str) -> DataFrame:
    """id, word_idx, text, x0, y0, x1, y1, conf, baseline, size, page_width, page_height: a row a word.

    A task holds one page's text and words and at most WORDS more words at a time, however many pages come in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "word_idx", "text", "x0", "y0", "x1", "y1", "conf", "baseline", "size", "page_width", "page_height"]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 3, pa.int64(), pa.int64()]

        def written(rows: list[tuple], id_kind: pa.DataType) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [id_kind, *kinds], strict=True)], names)

        for batch in batches:
            rows: list[tuple] = []
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                if not t.is_valid:
                    continue
                own, hocr = i.as_py(), t.as_py()
                x0, y0, x1, y1 = page_box(hocr)
                rows += [(own, k, *w, x1 - x0, y1 - y0) for k, w in enumerate(words(hocr))]
                if len(rows) >= WORDS:
                    yield written(rows, batch.column(0).type)
                    rows = []
            if rows:
                yield written(rows, batch.column(0).type)

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(hocr_col).alias("hocr")).mapInArrow(
        run, f"id {kind}, word_idx long, text string, x0 long, y0 long, x1 long, y1 long, conf double, baseline double, size double, page_width long, page_height long"
    )
