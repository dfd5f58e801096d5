"""Laid-out documents as Markdown: lines to blocks, blocks to text, pages to documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import text as tx
from ..functions.equations import line_with_math
from . import structure as ls

# Words that stand on either side of a hyphen of their own.
COMPOUND_HALVES = frozenset({
    "one", "two", "three", "half", "full", "long", "short", "term", "time", "left", "right", "wing", "party", "state", "post", "pre",
    "anti", "pro", "non", "self", "well", "known", "based", "led", "made", "wide", "high", "low", "old", "new", "far", "near",
    "cross", "multi", "inter", "intra", "sub", "super", "counter", "over", "under", "out", "off", "back", "front", "progressive", "conservative", "liberal",
    "socialist", "democratic", "government", "east", "west", "north", "south", "central", "middle", "first", "second", "third", "fourth", "public", "private", "civil",
    "military", "legal", "human", "rights", "media", "social", "political", "economic", "national", "regional", "local", "global", "world", "war", "line", "level",
    "scale", "year", "day", "week", "month", "hour", "risk", "free", "hard", "soft", "open", "closed", "read", "write", "data", "driven",
    "making", "taking", "seeking", "building", "related", "linked", "socio", "politico", "juridico", "medico", "tecnico", "teorico", "practico", "norte", "sur", "este",
    "oeste", "auto", "franco", "hispano", "latino", "afro", "euro", "ibero", "arabe", "ruso", "corto", "largo", "medio", "plazo", "alto", "bajo",
    "nuevo", "viejo",
})
#: Cells of a table set by spaces have at most so many characters; share of its rows that must agree in columns.
CELL_CHARS, SAME_COLUMNS = 40, 0.7
#: A short line that ends no sentence joins the next.
SENTENCE_ENDS = (".", "!", "?", ":", ";", "…", "---")

_LIST = re.compile(rf"\s*(?:[{tx.BULLETS}\-*]|\d+[.)]|[a-zA-Z][.)]\s|\([a-zA-Z0-9]+\))")
_BULLET = re.compile(rf"^(\s*)[{tx.BULLETS}\-*]\s*")
_CODE = re.compile(tx.CODE_SYNTAX)
_WORD = re.compile(r"[^\W\d_]+")


def divides(left: str, right: str) -> bool:
    """Whether the hyphen that ends ``left`` divides a word that ``right`` goes on with, or is the author's own."""
    if not left or left[-1] not in "-‐‑":
        return False
    a, b = _WORD.findall(left[:-1]), _WORD.match(right)
    if not a or not b:
        return False
    if right[:1].isupper() and not left[:-1].isupper():
        return False
    return not (a[-1].lower() in COMPOUND_HALVES and b[0].lower() in COMPOUND_HALVES)


def rejoined(lines: list[str]) -> list[str]:
    """Lines with divided words joined: the rest of the word moves to the line it began on; an author's hyphen keeps
    both halves together."""
    out: list[str] = []
    for x in lines:
        if out and out[-1] and out[-1][-1:] in "-‐‑" and (m := re.match(r"\s*(\S+)\s*(.*)", x, re.S)) and _WORD.match(m[1]):
            keep = out[-1] if not divides(out[-1], m[1]) else out[-1][:-1]
            if divides(out[-1], m[1]) or out[-1][-2:-1].isalpha():
                out[-1] = keep + m[1]
                if m[2]:
                    out.append(m[2])
                continue
        out.append(x)
    return out


def table_rows(lines: list[str]) -> list[list[str]] | None:
    """Rows of a block set as a table with pipes or with gaps; null if it is none."""
    piped = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines if "|" in x and not re.fullmatch(r"[\s|:-]*", x)]
    piped = [r for r in piped if len(r) > 1]
    if len(piped) > 1:
        return piped
    if len(lines) < 2:
        return None
    gaps = [re.split(r"\t+| {2,}", x.strip()) for x in lines]
    widths = [len(r) for r in gaps]
    mode = max(sorted(set(widths)), key=widths.count)
    if min(widths) < 2 or widths.count(mode) < SAME_COLUMNS * len(widths) or any(len(c) > CELL_CHARS for r in gaps for c in r):
        return None
    return [r + [""] * (mode - len(r)) if len(r) <= mode else [*r[: mode - 1], " ".join(r[mode - 1 :])] for r in gaps]


def block_markdown(lines: list[tuple[str, int, bool]]) -> list[tuple[str, str]]:
    """(kind, Markdown) pieces of a block of (text, heading level, mono) lines."""
    out: list[tuple[str, str]] = []
    texts = [t for t, _, _ in lines]
    code = [t for t in texts if _CODE.search(t)]
    if all(m for _, _, m in lines) and len(code) > 1 and len(code) >= 0.3 * len(texts):
        return [("code", "```\n" + "\n".join(texts) + "\n```")]
    if not any(level for _, level, _ in lines) and (rows := table_rows(texts)):
        return [("table", md.table(rows))]
    k = 0
    while k < len(lines):
        text, level, _ = lines[k]
        j = k
        if level:
            while j < len(lines) and lines[j][1] == level:
                j += 1
            out.append(("heading", "#" * level + " " + " ".join(t.strip() for t in texts[k:j])))
        else:
            while j < len(lines) and not lines[j][1]:
                j += 1
            part = texts[k:j]
            if part[0].strip().startswith(("> ", "» ")):
                out.append(("quote", "\n".join("> " + re.sub(r"^\s*[>»]\s*", "", t) for t in part)))
            else:
                shown = [line_with_math(_BULLET.sub(r"\1- ", t)) if not t.startswith("$") else t for t in rejoined(part)]
                shown = [re.sub(r"^(#{1,6}\s)", r"\\\1", t) for t in shown]
                out.append(("list" if _LIST.match(part[0]) else "text", md.reflowed(shown)))
        k = j
    return out


def page_markdown(blocks: list[list[tuple[str, int, bool]]]) -> str:
    """Blocks of a page; a paragraph that ends no sentence takes the next one in."""
    out: list[tuple[str, str]] = []
    for b in blocks:
        for kind, text in block_markdown(b):
            before = out[-1] if out else ("", "")
            if kind == before[0] == "text" and not before[1].rstrip().endswith(SENTENCE_ENDS):
                lines = rejoined([before[1], text])
                out[-1] = ("text", " ".join(lines))
            elif kind == before[0] == "list" or kind == before[0] == "heading" and text.split(" ")[0] == before[1].split(" ")[0]:
                out[-1] = (kind, before[1] + ("\n" + text if kind == "list" else " " + text.split(" ", 1)[1]))
            else:
                out.append((kind, text))
    return "\n\n".join(t for _, t in out if t)


def pages_markdown(spans: DataFrame) -> DataFrame:
    """(doc_id, page_num, markdown): pages without running lines and page numbers, with headings, lists, tables, code,
    quotes and formulas."""
    x = ls.lines(spans)
    level = ls.headings(x, ls.body_sizes(spans)).select(*ls.LINE, "level")
    body = ls.without_running(x).join(level, ls.LINE, "left").withColumn("level", F.coalesce("level", F.lit(0)))
    pages = body.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("block_no", "line_no", "text", "level", "mono"))).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lines in b.column("lines").to_pylist():
                blocks: dict[int | None, list[tuple[str, int, bool]]] = {}
                for ln in lines:
                    blocks.setdefault(ln["block_no"], []).append((ln["text"], ln["level"], ln["mono"]))
                out.append(page_markdown(list(blocks.values())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("page_num"), pa.array(out, pa.string())], names=["doc_id", "page_num", "markdown"])

    return pages.mapInArrow(run, f"doc_id {dict(spans.dtypes)['doc_id']}, page_num {dict(spans.dtypes)['page_num']}, markdown string")


def documents_markdown(spans: DataFrame, page_marks: bool = True, page_breaks: bool = False) -> DataFrame:
    """(doc_id, markdown): pages in order, with a mark before each page that has text and the mark of the cover's end."""
    p = pages_markdown(spans).filter(F.col("markdown") != "")
    x = ls.lines(spans)
    cover = ls.cover_ends(x, ls.headings(x, ls.body_sizes(spans))).withColumnRenamed("page_num", "starts")
    mark = F.concat(F.lit("<!-- p."), F.col("page_num").cast("string"), F.lit(" -->\n\n")) if page_marks else F.lit("")
    text = F.concat(F.when(F.col("page_num") == F.col("starts"), "<!-- end-of-cover -->\n\n").otherwise(""), mark, F.col("markdown"))
    p = p.join(cover, "doc_id", "left").withColumn("markdown", text)
    gap = "\n\n---\n\n" if page_breaks else "\n\n"
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "markdown"))), lambda x: x["markdown"]), gap).alias("markdown"))
