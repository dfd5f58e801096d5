"""PDF bytes as span rows, by a replaceable extractor; recognition engines are replaceable in the same way."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: (page_num, width, height, block_no, line_no, span_no, text, size, bold, italic, mono, x0, y0, x1, y1, link) rows of a file.
Extractor = Callable[[bytes, str | None, int | None], list[tuple]]
COLUMNS = ("page_num", "width", "height", "block_no", "line_no", "span_no", "text", "size", "bold", "italic", "mono", "x0", "y0", "x1", "y1", "link")
TYPES = ("int", "double", "double", "int", "int", "int", "string", "double", "boolean", "boolean", "boolean", "double", "double", "double", "double", "string")
SCHEMA = "path string, " + ", ".join(f"{c} {t}" for c, t in zip(COLUMNS, TYPES)) + ", error string"


def mupdf(raw: bytes, password: str | None, pages: int | None) -> list[tuple]:
    """Extractor for machines that have PyMuPDF."""
    import fitz  # noqa: PLC0415

    doc = fitz.open(stream=raw, filetype="pdf")
    if doc.needs_pass and not doc.authenticate(password or ""):
        raise PermissionError("encrypted")
    out = []
    for n, page in enumerate(doc, 1):
        if pages and n > pages:
            break
        for b, block in enumerate(page.get_text("dict")["blocks"]):
            for ln, line in enumerate(block.get("lines", ())):
                for s, span in enumerate(line["spans"]):
                    f, font = span["flags"], span["font"].lower()
                    out.append((n, page.rect.width, page.rect.height, b, ln, s, span["text"], span["size"], bool(f & 16) or "bold" in font, bool(f & 2) or "italic" in font, bool(f & 8) or "mono" in font or "courier" in font, *span["bbox"], None))
    return out


def spans(files: DataFrame, extractor: Extractor = mupdf, password: str | None = None, preview_pages: int | None = None) -> DataFrame:
    """Rows of SCHEMA for files (path, content); a file that cannot be read gives one row with its error."""
    arrow = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                try:
                    rows += [(path, *r, None) for r in extractor(raw or b"", password, preview_pages)]
                except Exception as e:  # one file must not end the batch
                    rows.append((path, *[None] * len(COLUMNS), str(e) or type(e).__name__))
            cols = list(zip(*rows)) if rows else [()] * (len(COLUMNS) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, t in zip(cols, ("string", *TYPES, "string"))], names=["path", *COLUMNS, "error"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)
