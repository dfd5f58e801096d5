"""Images, rules and table boxes of laid-out pages, and decisions about recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structure import PAGE_HEIGHT, REPEAT_LEAST, REPEAT_SHARE

#: Smallest side, largest aspect, least bytes where the size is unknown, least side and area on the page in points.
SIDE, ASPECT, BYTES, PAGE_SIDE, PAGE_AREA = 50, 6.0, 1500, 15.0, 400.0
#: Share of the height that is margin for images; shares that bound a footnote rule; slack around a table's box.
IMAGE_MARGIN, RULE_HEIGHT, RULE_TOP, RULE_BOTTOM, RULE_LEAST, RULE_MOST, TABLE_SLACK = 0.15, 3.0, 0.55, 0.97, 0.15, 0.85, 5.0
#: A document is recognised anew if fewer than this share of pages have so many characters.
FORCE_SHARE, FORCE_CHARS = 0.25, 250


def is_content_image(width: Column, height: Column, n_bytes: Column, page_width: Column, page_height: Column) -> Column:
    """Large enough, not a bar, and not tiny on the page; without pixel size by its bytes. Nulls are unknown sizes."""
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    pixels = (F.least(width, height) >= SIDE) & (F.greatest(width, height) <= ASPECT * F.least(width, height))
    on_page = page_width.isNull() | page_height.isNull() | ((F.least(page_width, page_height) >= PAGE_SIDE) & (page_width * page_height >= PAGE_AREA))
    return F.when(known, pixels).otherwise(F.coalesce(n_bytes, F.lit(0)) >= BYTES) & on_page


def repeated_images(images: DataFrame) -> DataFrame:
    """(doc_id, digest): margin images (doc_id, page_num, digest, y0, y1, height) seen on three in ten pages, two at
    least; occurrences count, so two on one page are two."""
    h = F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(PAGE_HEIGHT))
    m = images.filter((F.col("y1") < h * IMAGE_MARGIN) | (F.col("y0") > h * (1 - IMAGE_MARGIN)))
    total = images.groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages"))
    n = m.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).join(total, "doc_id")
    return n.filter(F.col("n") >= F.greatest(F.lit(REPEAT_LEAST), F.floor(REPEAT_SHARE * F.col("pages")))).select("doc_id", "digest")


def note_rules(drawings: DataFrame) -> DataFrame:
    """(doc_id, page_num, rule_y): the lowest thin horizontal rule in the lower part of a page."""
    w, h = F.col("width"), F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(PAGE_HEIGHT))
    wide = F.col("x1") - F.col("x0")
    rule = (F.col("y1") - F.col("y0") <= RULE_HEIGHT) & F.col("y0").between(RULE_TOP * h, RULE_BOTTOM * h) & (wide > RULE_LEAST * w) & (wide < RULE_MOST * w)
    return drawings.filter(rule).groupBy("doc_id", "page_num").agg(F.max("y0").alias("rule_y"))


def outside_tables(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """Lines not inside a table's box (doc_id, page_num, x0, y0, x1, y1) of their page, with a little slack."""
    boxes = tables.groupBy("doc_id", "page_num").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("__boxes"))  # the tables of a page

    def inside(b: Column) -> Column:
        s = TABLE_SLACK
        return (F.col("x0") >= b["x0"] - s) & (F.col("y0") >= b["y0"] - s) & (F.col("x1") <= b["x1"] + s) & (F.col("y1") <= b["y1"] + s)

    x = lines.join(boxes, ["doc_id", "page_num"], "left")
    return x.filter(~F.coalesce(F.exists("__boxes", inside), F.lit(False))).drop("__boxes")


def forced_recognition(page_text: DataFrame) -> DataFrame:
    """(doc_id, forced): documents with too few pages of real text; pages delivered twice count once."""
    p = page_text.groupBy("doc_id", "page_num").agg(F.max(F.coalesce("char_count", F.lit(0))).alias("n"))
    return p.groupBy("doc_id").agg((F.count_if(F.col("n") >= FORCE_CHARS) < FORCE_SHARE * F.count("*")).alias("forced"))


def installed_languages(wanted: Column, installed: list[str]) -> Column:
    """Of languages joined by +, those installed; else eng, else the first installed; empty if none is."""
    use = F.array_intersect(F.split(wanted, r"\+"), F.array(*[F.lit(x) for x in installed]).cast("array<string>"))
    default = "eng" if "eng" in installed else installed[0] if installed else ""
    return F.when(F.size(use) > 0, F.array_join(use, "+")).otherwise(default)


def notes_markdown(notes: DataFrame) -> DataFrame:
    """(doc_id, markdown): anchored notes as definitions, then those without a call in a section of their own."""
    x = F.array_sort(F.collect_list(F.struct("number", "anchored", "marker", "text")))
    g = notes.groupBy("doc_id").agg(x.alias("ns"))
    own = F.array_join(F.transform(F.filter("ns", lambda n: n["anchored"]), lambda n: F.concat(F.lit("[^"), n["number"].cast("string"), F.lit("]: "), n["text"])), "\n")
    loose = F.array_join(F.transform(F.filter("ns", lambda n: ~n["anchored"]), lambda n: F.concat(F.lit("- ("), n["marker"], F.lit(") "), n["text"])), "\n")
    return g.select("doc_id", F.concat_ws("\n\n", F.nullif(own, F.lit("")), F.when(loose != "", F.concat(F.lit("## Notes without a call\n\n"), loose))).alias("markdown"))
