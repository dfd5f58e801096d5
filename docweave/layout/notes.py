"""Footnotes and links of laid-out documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import web as wb
from .structure import LINE, PAGE_HEIGHT

#: Share of the height below which notes stand; note and call sizes against the body; least overlap of a link.
NOTE_ZONE, NOTE_SIZE, CALL_SIZE = 0.82, 0.92, 0.85
LINK_OVERLAP = 0.05
MARKER = r"^\s*(?:\(|\[)?([0-9]{1,3}|[⁰¹²³⁴⁵⁶⁷⁸⁹]{1,3}|[*†‡§])(?:\)|\]|\.)?\s*(?=\S)"


def footnotes(lines: DataFrame, spans: DataFrame, bodies: DataFrame) -> DataFrame:
    """(doc_id, page_num, marker, number, text, anchored): notes in the lower zone of a page in small type.

    A line that begins with a marker opens a note, the following ones go on with it; notes are numbered through the
    document in reading order; a note is anchored by the first span of its marker on the page that is set smaller than
    the body or as a superscript, above the zone."""
    height = F.when(F.coalesce("height", F.lit(0.0)) > 0, F.col("height")).otherwise(PAGE_HEIGHT)
    z = lines.join(bodies, "doc_id").filter((F.col("y0") >= NOTE_ZONE * height) & (F.col("size") <= NOTE_SIZE * F.col("body")) & ~tx.is_page_number(F.col("text")))
    z = z.withColumn("raw", F.regexp_extract("text", MARKER, 1))
    down = W.partitionBy("doc_id", "page_num").orderBy("y0", "block_no", "line_no")
    z = z.withColumn("turn", F.sum((F.col("raw") != "").cast("int")).over(down)).filter("turn > 0")
    part = F.when(F.col("raw") != "", F.regexp_replace("text", MARKER, "")).otherwise(F.col("text"))
    notes = z.groupBy("doc_id", "page_num", "turn").agg(
        F.max(F.when(F.col("raw") != "", tx.note_marker(F.col("raw")))).alias("marker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "block_no", "line_no", tx.strip(part).alias("t")))), lambda x: x["t"]), " ").alias("text")
    )
    numbered = notes.withColumn("number", F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "turn")))
    s = spans.dropDuplicates().join(bodies, "doc_id")
    small = (F.col("size") <= CALL_SIZE * F.col("body")) | F.col("text").rlike("^[⁰¹²³⁴⁵⁶⁷⁸⁹]+$")
    calls = s.filter(small & (F.col("y0") < NOTE_ZONE * height)).select("doc_id", "page_num", tx.note_marker(F.col("text")).alias("marker")).distinct().withColumn("anchored", F.lit(True))
    return numbered.join(calls, ["doc_id", "page_num", "marker"], "left").select("doc_id", "page_num", "marker", "number", "text", F.coalesce("anchored", F.lit(False)).alias("anchored"))


def linked_spans(spans: DataFrame, links: DataFrame) -> DataFrame:
    """Spans with ``target``: of the link rectangles (doc_id, page_num, x0, y0, x1, y1, target) on their page the one
    that covers most of them, more than LINK_OVERLAP; fragments of the same page and files of a disk are no links.

    The pages are the join key, so a rectangle meets only the spans of its page."""
    use = links.filter(F.col("target").isNotNull() & (F.col("target") != "") & ~F.col("target").rlike("^(?:#|file:)"))
    r = use.select("doc_id", "page_num", *[F.col(c).alias(f"l_{c}") for c in ("x0", "y0", "x1", "y1")], "target")
    key = [*LINE, "span_no"]
    share = wb.overlap(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"l_{c}") for c in ("x0", "y0", "x1", "y1")))
    best = spans.join(r, ["doc_id", "page_num"]).withColumn("share", share).filter(F.col("share") > LINK_OVERLAP).groupBy(*key).agg(F.max_by("target", F.struct("share", "target")).alias("target"))
    return spans.join(best, key, "left")


def links_without_anchor(spans: DataFrame, links: DataFrame) -> DataFrame:
    """Links (doc_id, page_num, target) that no span carries."""
    used = linked_spans(spans, links).filter(F.col("target").isNotNull()).select("doc_id", "page_num", "target").distinct()
    return links.select("doc_id", "page_num", "target").distinct().join(used, ["doc_id", "page_num", "target"], "left_anti")


def promoted_by_outline(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """Lines with ``outline_level``: 1 to 4 where an outline entry (doc_id, page_num, level, title) of their page has
    the same key; of several equal lines of a page the first."""
    o = outline.select("doc_id", "page_num", tx.repetition_key(F.col("title"), True).alias("key"), F.least(F.greatest("level", F.lit(1)), F.lit(4)).alias("lv")).groupBy("doc_id", "page_num", "key").agg(F.min("lv").alias("lv"))
    x = lines.withColumn("key", tx.repetition_key(F.col("text"), True))
    rank = F.row_number().over(W.partitionBy("doc_id", "page_num", "key").orderBy("block_no", "line_no"))
    return x.withColumn("rn", rank).join(o.filter(F.col("key") != ""), ["doc_id", "page_num", "key"], "left").withColumn("outline_level", F.when(F.col("rn") == 1, F.col("lv"))).drop("rn", "lv", "key")
