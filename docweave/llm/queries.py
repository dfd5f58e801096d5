"""Registered queries of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding, language, linkage, mixing, packing, quality, repeated, residue, scanned, web


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return web.parsed_pages(table(spark, d, "web_in"), table(spark, d, "common_words"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.found_lines(table(spark, d, "layout_in"), table(spark, d, "page_text"), table(spark, d, "pdf_meta"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scanned.body_paragraphs(table(spark, d, "layout_in"), table(spark, d, "page_text"), table(spark, d, "pdf_meta"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    blocks = residue.real_articles(_parsed(spark, d))
    return blocks.select("page_id", F.md5(F.encode("t", "UTF-8")).alias("block_md5")).distinct()


def p2_text(spark: SparkSession, d: str) -> DataFrame:
    return web.main_text(residue.real_articles(_parsed(spark, d))).select("page_id", "title", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_records(table(spark, d, "web_in")).select("page_id")


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored_records(table(spark, d, "web_in"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.repeats(*(table(spark, d, t) for t in ("web_in", "web_meta", "layout_in", "page_text", "pdf_meta", "common_words")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated.repeated_lines(table(spark, d, "documents"))


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    return repeated.without_repeated_lines(table(spark, d, "documents").select("doc_id", "text", "sitio", "lineas_suprimidas")).select("doc_id", "text", "removed")


def _sized(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    paragraphs = language.record_paragraphs(*(table(spark, d, t) for t in ("web_in", "layout_in", "page_text", "pdf_meta", "common_words")))
    paragraphs = language.stored(paragraphs, "texts")
    labels = language.record_labels(table(spark, d, "web_meta"), table(spark, d, "pdf_meta"))
    samples = language.language_samples(paragraphs, labels, table(spark, d, "common_words"))
    return language.stored(language.compressed_sizes(paragraphs, samples), "sizes"), labels


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return language.bad_labels(*_sized(spark, d))


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(_sized(spark, d)[0])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pages = _parsed(spark, d)
    return residue.residue_pages(web.Rules(pages).blocks(pages, text=False)).select("page_id")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d), table(spark, d, "pack_specs"))


def p9_schedule(spark: SparkSession, d: str) -> DataFrame:
    return mixing.schedule(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*mixing.schedule(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    kinds = quality.document_kinds(table(spark, d, "documents"), table(spark, d, "common_words"))
    return kinds.filter(F.col("kind") != "prose").select("doc_id", "kind").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_kinds(table(spark, d, "documents"), table(spark, d, "common_words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_text, p3_found, p3_restored, p4_found, p5_found, p5_text, p6_found, p6_segments, p7_found, p8_containers, p8_fill, p9_schedule, p9_shares, p10_found, p10_statistics)}


_EXCESS = (
    "WITH s AS (SELECT doc_id, regexp_replace(lower(trim(sitio)), '^www\\.', '') AS site, text, lineas_suprimidas AS x FROM documents WHERE sitio IS NOT NULL AND trim(sitio) <> ''), "
    "t AS (SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM s UNION ALL SELECT doc_id, site, unnest(x), NULL FROM s), "
    "k AS (SELECT doc_id, site, n, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') AS k FROM t), z AS (SELECT site, count(DISTINCT doc_id) AS docs FROM s GROUP BY 1), "
    "e AS (SELECT k.site, k FROM k JOIN z ON z.site = k.site WHERE length(k) >= 8 GROUP BY k.site, k, docs HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.1 * docs), "
    "f AS (SELECT DISTINCT k.doc_id, k.n::INT AS line_no FROM k JOIN e ON e.site = k.site AND e.k = k.k WHERE k.n IS NOT NULL) "
)


def oracle_sql() -> dict[str, str]:
    """SQL for the queries it can express: the exact rule of problem 5, which the operator's result has to meet, and the
    texts without those lines."""
    return {
        "p5_found": _EXCESS + "SELECT doc_id, line_no FROM f",
        "p5_text": _EXCESS + ", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), "
        "r AS (SELECT doc_id, count(*) AS removed FROM f GROUP BY 1), "
        "kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM l JOIN r USING (doc_id) LEFT JOIN f ON f.doc_id = l.doc_id AND f.line_no = l.n WHERE f.doc_id IS NULL GROUP BY 1) "
        "SELECT d.doc_id, CASE WHEN r.removed IS NULL THEN d.text ELSE coalesce(kept.text, '') END AS text, coalesce(r.removed, 0)::INT AS removed FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id",
    }
