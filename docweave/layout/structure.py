"""Laid-out documents as line tables: statistics, running lines, headings, tables, reading order, cover, diagnosis.

Everything here is column expressions, aggregates and windows over spans (doc_id, page_num, block_no, line_no,
span_no, text, size, bold, italic, mono, x0, y0, x1, y1, link); null text counts as empty, and rows repeated exactly
count once where lines are built."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx

#: Page height taken where none is given; share of it that is margin; shares and least counts of repetition.
PAGE_HEIGHT, MARGIN = 842.0, 0.12
REPEAT_SHARE, REPEAT_LEAST, KEY_CHARS = 0.3, 2, 6
HEADING_REPEAT_LEAST, HEADING_KEY_CHARS = 3, 4
#: Body size where a document has no text; text-layer limits in characters a page.
BODY_SIZE = 11.0
ABSENT_CHARS, SCARCE_CHARS, FULL_PAGE_CHARS = 100, 800, 50
#: Shares of the width: of a divider of columns, of the columns' inner edges, and of what spans both; points of overlap.
WIDE, LEFT_MOST, RIGHT_LEAST, SPAN_FROM, SPAN_TO, OVERLAP = 0.6, 0.55, 0.45, 0.375, 0.625, 4.0
#: Pages looked at for credits; characters of a page of body, with a heading and without; width where none is known.
COVER_PAGES, COVER_CHARS, COVER_CHARS_HEADED, PAGE_WIDTH = 8, 400, 200, 600.0
#: A stamp repeated on scans: pages, characters a page, share of pages. Pages of real text, their characters, and all characters.
STAMP_PAGES, STAMP_CHARS, STAMP_SHARE = 5, 160, 0.75
REAL_PAGES, REAL_CHARS, REAL_TOTAL = 4, 200, 1500
# What betrays a page of credits.
CREDITS = (
    "isbn", "deposito legal", "depósito legal", "d.l.", "©", "copyright", "todos los derechos reservados", "reservados todos los derechos", "primera edicion", "primera edición",
    "edita:", "editorial", "impreso en", "printed in", "all rights reserved", "maquetacion", "maquetación",
)

LINE = ["doc_id", "page_num", "block_no", "line_no"]


def lines(spans: DataFrame) -> DataFrame:
    """A row per line: text (spans in order), size (mean weighted by characters, BODY_SIZE if empty), bold and mono if
    any span is, box, page width and height, linked spans."""
    n = F.length(F.coalesce("text", F.lit("")))
    s = spans.dropDuplicates().withColumn("n", n)
    return s.groupBy(*LINE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "").alias("text"),
        F.coalesce(F.sum(F.col("size") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(BODY_SIZE)).alias("size"),
        F.max(F.coalesce("bold", F.lit(False))).alias("bold"), F.max(F.coalesce("mono", F.lit(False))).alias("mono"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("width").alias("width"), F.max("height").alias("height"),
        F.count("link").alias("links"),
    )


def body_sizes(spans: DataFrame) -> DataFrame:
    """(doc_id, body): the size, to a tenth, that most characters have; of equal ones the smaller."""
    s = spans.dropDuplicates().filter(tx.strip(F.col("text")) != "")
    per = s.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum(F.length(tx.strip(F.col("text")))).alias("n"))
    return per.groupBy("doc_id").agg(F.max_by("size", F.struct(F.col("n"), -F.col("size"))).alias("body"))


def body_sizes_without_notes(spans: DataFrame, zone: float = 0.82) -> DataFrame:
    """As body_sizes, over the spans above the zone of footnotes; documents with text only there take all of it."""
    h = F.when(F.coalesce(F.col("height"), F.lit(0.0)) > 0, F.col("height")).otherwise(PAGE_HEIGHT)
    above = body_sizes(spans.filter(F.col("y0") < zone * h))
    return above.unionByName(body_sizes(spans).join(above, "doc_id", "left_anti"))


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    """In the top or bottom strip of the page; lines without coordinates are not."""
    h = F.when(F.coalesce(height, F.lit(0.0)) > 0, height).otherwise(PAGE_HEIGHT)
    return F.coalesce(~((y0 == 0) & (y1 == 0)) & ((y1 < h * MARGIN) | (y0 > h * (1 - MARGIN))), F.lit(False))


def repeated_lines(lines_: DataFrame) -> DataFrame:
    """(doc_id, key, pages): margin lines found on several pages: three in ten, two at least, of documents of two and more."""
    m = lines_.filter(in_margin(F.col("y0"), F.col("y1"), F.col("height"))).withColumn("key", tx.repetition_key(F.col("text"))).filter(F.length("key") >= KEY_CHARS)
    seen = m.groupBy("doc_id", "key").agg(F.count_distinct("page_num").alias("pages"))
    total = lines_.groupBy("doc_id").agg(F.count_distinct("page_num").alias("total"))
    return seen.join(total, "doc_id").filter((F.col("total") >= 2) & (F.col("pages") >= F.greatest(F.lit(REPEAT_LEAST), F.floor(REPEAT_SHARE * F.col("total"))))).select("doc_id", "key", "pages")


def without_running(lines_: DataFrame) -> DataFrame:
    """Lines without repeated margin lines and page numbers in the margin."""
    keyed = lines_.withColumn("key", tx.repetition_key(F.col("text")))
    margin = in_margin(F.col("y0"), F.col("y1"), F.col("height"))
    rep = repeated_lines(lines_).select("doc_id", "key", F.lit(True).alias("repeated"))
    return keyed.join(rep, ["doc_id", "key"], "left").filter(~(margin & (F.coalesce("repeated", F.lit(False)) | tx.is_page_number(F.col("text"))))).drop("key", "repeated")


def headings(lines_: DataFrame, sizes: DataFrame) -> DataFrame:
    """(LINE, text, level): lines that are headings by size or capitals, without those cut off and those repeated on
    many pages of documents of three and more."""
    h = lines_.join(sizes, "doc_id").withColumn("level", tx.heading_level(F.col("text"), F.col("size"), F.col("body"), F.col("bold"))).filter((F.col("level") > 0) & ~tx.ends_cut(F.col("text")))
    h = h.withColumn("key", tx.repetition_key(F.col("text")))
    total = lines_.groupBy("doc_id").agg(F.count_distinct("page_num").alias("total"))
    often = h.filter(F.length("key") >= HEADING_KEY_CHARS).groupBy("doc_id", "key").agg(F.count_distinct("page_num").alias("pages")).join(total, "doc_id")
    often = often.filter((F.col("total") >= 3) & (F.col("pages") >= F.greatest(F.lit(HEADING_REPEAT_LEAST), F.floor(REPEAT_SHARE * F.col("total"))))).select("doc_id", "key")
    return h.join(often, ["doc_id", "key"], "left_anti").select(*LINE, "text", "level")


def text_layers(page_text: DataFrame) -> DataFrame:
    """(doc_id, pages, chars, chars_per_page, median_chars, full_pages, layer): native, ocr, scarce or absent.

    Pages delivered twice count once; the median is the upper one of the pages with FULL_PAGE_CHARS and more. A layer is
    absent where scans bear only a short stamp, or where the mean or the median is under ABSENT_CHARS or most pages are
    empty, unless several pages hold real text. Recognised documents that have text are ocr.
    Without has_images or ocr_aplicado no page has images or was recognised."""
    def told(name: str) -> Column:
        return F.max(F.coalesce(F.col(name), F.lit(False))) if name in page_text.columns else F.lit(False)

    p = page_text.groupBy("doc_id", "page_num").agg(F.max(F.coalesce("char_count", F.lit(0))).alias("n"), told("has_images").alias("images"), told("ocr_aplicado").alias("ocr"))
    full = F.col("n") >= FULL_PAGE_CHARS
    d = p.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.sum("n").alias("chars"), F.sort_array(F.collect_list(F.when(full, F.col("n")))).alias("ns"), F.max("ocr").alias("ocr"),
        F.count_if(F.col("images") & (F.col("n") < STAMP_CHARS)).alias("stamped"),
    )
    d = d.withColumn("full_pages", F.size("ns")).withColumn("chars_per_page", F.bround(F.col("chars") / F.col("pages"), 0).cast("int"))
    d = d.withColumn("median_chars", F.coalesce(F.get("ns", F.floor(F.col("full_pages") / 2).cast("int")), F.lit(0)))
    mean, median = F.col("chars_per_page"), F.col("median_chars")
    stamp = ~F.col("ocr") & (F.col("pages") >= STAMP_PAGES) & (median < STAMP_CHARS) & (F.col("stamped") >= F.floor(STAMP_SHARE * F.col("pages")))
    real = (F.col("full_pages") >= REAL_PAGES) & (median >= max(REAL_CHARS, 2 * ABSENT_CHARS)) & (F.col("chars") >= REAL_TOTAL)
    absent = stamp | (~real & ((mean < ABSENT_CHARS) | ((F.col("pages") - F.col("full_pages")) * 2 > F.col("pages")) | (median < ABSENT_CHARS)))
    layer = F.when(absent, "absent").when(F.col("ocr"), "ocr").when((mean < SCARCE_CHARS) | (median < SCARCE_CHARS), "scarce").otherwise("native")
    return d.select("doc_id", "pages", "chars", "chars_per_page", "median_chars", "full_pages", layer.alias("layer"))


def mostly_scanned(pages: DataFrame) -> DataFrame:
    """(doc_id, whole): documents of three pages and more of which most pages need recognition (page_num, needed)."""
    return pages.groupBy("doc_id").agg(((F.count("*") >= 3) & (F.sum(F.col("needed").cast("int")) * 2 > F.count("*"))).alias("whole"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_num, block_no, x0, y0, x1, y1, width) with ``turn``, from 1.

    A page has two columns if some block ends left of LEFT_MOST, another begins right of RIGHT_LEAST, and two such stand
    side by side. There, wide blocks and those that span the middle divide bands; in a band the blocks that begin in the
    left half come first, each side from top to bottom. Other pages, and those of under three blocks, keep their order."""
    page = W.partitionBy("doc_id", "page_num")
    own = F.coalesce(F.nullif("width", F.lit(0.0)), F.max("x1").over(page), F.lit(PAGE_WIDTH))
    b = blocks.withColumn("__w", own)
    wide = (F.col("x1") - F.col("x0")) >= WIDE * F.col("__w")
    left = ~wide & (F.col("x1") <= LEFT_MOST * F.col("__w"))
    right = ~wide & ~left & (F.col("x0") >= RIGHT_LEAST * F.col("__w"))
    rows = F.struct("y0", "y1")
    b = b.withColumn("__left", F.collect_list(F.when(left, rows)).over(page)).withColumn("__right", F.collect_list(F.when(right, rows)).over(page))  # the blocks of a page
    beside = F.exists("__left", lambda x: F.exists("__right", lambda y: F.greatest(x["y0"], y["y0"]) < F.least(x["y1"], y["y1"]) - OVERLAP))
    b = b.withColumn("__two", (F.count("*").over(page) >= 3) & (F.col("__w") > 0) & F.coalesce(beside, F.lit(False)))
    divider = (wide | ((F.col("x0") < SPAN_FROM * F.col("__w")) & (F.col("x1") > SPAN_TO * F.col("__w")))).cast("int")
    down = W.partitionBy("doc_id", "page_num").orderBy("y0", "x0", "block_no")
    band = F.when(F.col("__two"), F.sum(divider).over(down) * 2 - divider).otherwise(0)
    side = F.when(F.col("__two") & (divider == 0), (F.col("x0") >= 0.5 * F.col("__w")).cast("int")).otherwise(0)
    b = b.withColumn("__band", band).withColumn("__side", side).withColumn("__y", F.when(F.col("__two"), F.col("y0"))).withColumn("__x", F.when(F.col("__two"), F.col("x0")))
    turn = F.row_number().over(W.partitionBy("doc_id", "page_num").orderBy("__band", "__side", "__y", "__x", "block_no"))
    return b.withColumn("turn", turn).drop("__w", "__left", "__right", "__two", "__band", "__side", "__y", "__x")


def cover_ends(lines_: DataFrame, headings_: DataFrame) -> DataFrame:
    """(doc_id, page_num): the first page of body after the last page of credits among the first COVER_PAGES pages but the
    last: one without credits that has COVER_CHARS characters, or COVER_CHARS_HEADED and a heading. Pages count by
    position; lines of a block are joined by line ends, blocks by spaces."""
    text = F.array_sort(F.collect_list(F.struct(F.coalesce("block_no", F.lit(0)).alias("b"), F.coalesce("line_no", F.lit(0)).alias("l"), "text")))
    p = lines_.groupBy("doc_id", "page_num").agg(text.alias("x"))
    gap = F.aggregate("x", F.struct(F.lit("").alias("t"), F.lit(None).cast("int").alias("b")), lambda a, z: F.struct(F.concat(a["t"], F.when(a["b"].isNull(), "").when(a["b"] == z["b"], "\n").otherwise(" "), z["text"]).alias("t"), z["b"].alias("b")))["t"]
    p = p.withColumn("t", tx.strip(gap)).withColumn("credits", reduce(lambda a, b: a | b, (F.lower("t").contains(c) for c in CREDITS)))
    headed = headings_.select("doc_id", "page_num").distinct().withColumn("headed", F.lit(True))
    p = p.select("doc_id", "page_num", F.length("t").alias("chars"), "credits").join(headed, ["doc_id", "page_num"], "left")
    pages = p.groupBy("doc_id").agg(F.sort_array(F.collect_list("page_num")).alias("nums"))  # page numbers only
    p = p.join(pages, "doc_id").withColumn("at", F.array_position("nums", F.col("page_num"))).withColumn("most", F.least(F.lit(COVER_PAGES), F.size("nums") - 1))
    last = F.max(F.when(F.col("credits") & (F.col("at") <= F.col("most")), F.col("at"))).alias("last")
    body = ~F.col("credits") & ((F.col("chars") >= COVER_CHARS) | (F.col("headed") & (F.col("chars") >= COVER_CHARS_HEADED)))
    p = p.drop("nums")
    return p.join(p.groupBy("doc_id").agg(last).filter(F.col("last").isNotNull()), "doc_id").filter((F.col("at") > F.col("last")) & body).groupBy("doc_id").agg(F.min("page_num").alias("page_num"))


def prominent_titles(headings_: DataFrame, lines_: DataFrame) -> DataFrame:
    """(doc_id, title): of the headings on the first three pages the one of the lowest level, then the largest, then first."""
    h = headings_.filter(F.col("page_num") <= 3).join(lines_.select(*LINE, "size"), LINE)
    order = F.struct("level", -F.col("size"), "page_num", "block_no", "line_no")
    return h.groupBy("doc_id").agg(F.min_by(tx.strip(F.col("text")), order).alias("title"))


def pipe_cells(line: Column) -> Column:
    """Cells of a line of a pipe table; empty for other lines and separators."""
    inner = F.regexp_replace(tx.strip(line), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|"), tx.strip)
    return F.when(line.contains("|") & ~inner.rlike(r"^[\s:|-]*$") & (F.size(cells) >= 2), cells).otherwise(F.array().cast("array<string>"))


def spaced_cells(line: Column) -> Column:
    """Cells of a line set in columns by tabs or two and more spaces."""
    return F.transform(F.split(tx.strip(line), r"\t+| {2,}"), tx.strip)
