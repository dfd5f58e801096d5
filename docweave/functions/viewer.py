"""Kinds of Markdown lines, as a viewer would style them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_kinds(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines (doc, line_no, line) with ``kind``: front, code, heading1-4, rule, callout, quote, table, list, link, text.

    The front matter ends at the second --- line if the first line is one; fences toggle code, by running counts over
    the lines of a document."""
    w = W.partitionBy(doc).orderBy("line_no")
    x = F.col("line")
    bar, fence = F.trim(x) == "---", F.ltrim(x).startswith("```")
    d = lines.withColumn("__bars", F.sum(bar.cast("int")).over(w)).withColumn("__fences", F.sum(fence.cast("int")).over(w)).withColumn("__first", F.first(bar).over(w))
    front = F.col("__first") & ((F.col("__bars") < 2) | (bar & (F.col("__bars") == 2)))
    code = fence | (F.pmod(F.col("__fences"), F.lit(2)) == 1)
    level = F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1))
    kind: Column = F.when(front, "front").when(code, "code").when(level > 0, F.concat(F.lit("heading"), F.least(level, F.lit(4)).cast("string"))).when(x.rlike(r"^\s*(?:---+|\*\*\*+|___+)\s*$"), "rule")
    kind = kind.when(x.rlike(r"^\s*>\s*\[!\w+\]"), "callout").when(x.rlike(r"^\s*>"), "quote").when(x.rlike(r"^\s*\|"), "table").when(x.rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), "list").when(x.rlike(r"\]\(|\[\[|<https?://"), "link").otherwise("text")
    return d.withColumn("kind", kind).drop("__bars", "__fences", "__first")
