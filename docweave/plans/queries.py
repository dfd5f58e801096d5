"""Registered queries of the core operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import text as tx
from ..functions import viewer as vw
from ..functions import web as wb
from ..html import page as pg
from ..layout import document as dc
from ..layout import images as im
from ..layout import notes as nt
from ..layout import structure as ls
from ..operators import corpus as cp


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def web_records(spark: SparkSession, d: str) -> DataFrame:
    """Each web record once: rows delivered twice have equal content."""
    cols = ["page_id", "url", "url_final", "html", "status", "content_type", "sha256", "lote"]
    return table(spark, d, "web_in").select(*cols).dropDuplicates(["page_id"])


def n(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("int"))


def line_flags(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("line")
    return doc_lines(spark, d).groupBy("doc_id").agg(n(tx.is_page_number(x)).alias("page_numbers"), n(tx.is_list_item(x)).alias("list_items"), n(tx.is_quote(x)).alias("quotes"), n(tx.looks_tabular(x)).alias("tabular"))


def caps_headings(spark: SparkSession, d: str) -> DataFrame:
    x = doc_lines(spark, d).withColumn("level", tx.heading_level(F.col("line"), F.lit(11.0), F.lit(11.0), F.lit(False)))
    return x.filter("level > 0").select("doc_id", "line_no", tx.strip(F.col("line")).alias("heading"), "level", tx.ends_cut(F.col("line")).alias("cut"))


def doc_language(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select("doc_id", tx.vote_words(F.col("text")).alias("words"))
    return x.select("doc_id", tx.vote_of(F.col("words")).alias("lang_found"))


def content_summary(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    links = F.regexp_count(t, F.lit(r"\]\(")) + F.regexp_count(t, F.lit(r"\[\["))
    return table(spark, d, "documents").select("doc_id", F.length(t).alias("chars"), F.regexp_count(t, F.lit(r"\S+")).alias("words"), F.regexp_count(t, F.lit(r"(?m)^#{1,6} ")).alias("headings"), links.alias("links"), tx.search_hits(t, "archivo").alias("hits"))


def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    x = cp.exact_copies(table(spark, d, "documents").select("doc_id", "text"), F.encode("text", "UTF-8"), ["doc_id"])
    return x.filter("copies > 1").select("doc_id", "digest", F.col("first.doc_id").alias("first_id"), "copies")


def size_candidates(spark: SparkSession, d: str) -> DataFrame:
    return cp.size_candidates(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "n_chars", "same")


def formula_lines(spark: SparkSession, d: str) -> DataFrame:
    x = doc_lines(spark, d)
    return x.filter(tx.is_formula(F.col("line"))).select("doc_id", "line_no", tx.strip(F.col("line")).alias("formula"))


def code_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.looks_like_code(F.split("text", "\n", -1)).alias("code")).filter("code")


def pipe_tables(spark: SparkSession, d: str) -> DataFrame:
    x = doc_lines(spark, d).withColumn("cells", ls.pipe_cells(F.col("line"))).filter(F.size("cells") > 0)
    return x.groupBy("doc_id").agg(F.count("*").alias("table_rows"), F.max(F.size("cells")).alias("columns"), F.sum(F.size("cells")).alias("cells"))


def repetition_keys(spark: SparkSession, d: str) -> DataFrame:
    x = doc_lines(spark, d).withColumn("key", tx.repetition_key(F.col("line")))
    return x.filter(F.length("key") >= 6).groupBy("key").agg(F.count("*").alias("uses"), F.count_distinct("doc_id").alias("docs")).filter("docs >= 3")


def normal_spans(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "layout_in").select("doc_id", "page_num", "block_no", "line_no", "span_no", "text", tx.normalise(F.col("text")).alias("plain"))
    return x.filter(F.col("plain") != F.col("text")).select("doc_id", "page_num", "block_no", "line_no", "span_no", "plain").distinct()


def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ls.body_sizes(table(spark, d, "layout_in"))


def line_styles(spark: SparkSession, d: str) -> DataFrame:
    x = ls.lines(table(spark, d, "layout_in"))
    return x.select(*ls.LINE, F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.round("size", 3).alias("size"), "bold", "mono", "links")


def running_lines(spark: SparkSession, d: str) -> DataFrame:
    return ls.repeated_lines(ls.lines(table(spark, d, "layout_in")))


def body_lines(spark: SparkSession, d: str) -> DataFrame:
    x = ls.without_running(ls.lines(table(spark, d, "layout_in")))
    return x.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


def layout_headings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "layout_in")
    return ls.headings(ls.lines(s), ls.body_sizes(s))


def prominent_titles(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "layout_in")
    x = ls.lines(s)
    return ls.prominent_titles(ls.headings(x, ls.body_sizes(s)), x)


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    b = ls.lines(table(spark, d, "layout_in")).groupBy("doc_id", "page_num", "block_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("width").alias("width"))
    return ls.reading_order(b).select("doc_id", "page_num", "block_no", "turn")


def cover_ends(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "layout_in")
    x = ls.lines(s)
    return ls.cover_ends(x, ls.headings(x, ls.body_sizes(s)))


def text_layers(spark: SparkSession, d: str) -> DataFrame:
    return ls.text_layers(table(spark, d, "page_text"))


def _needed(spark: SparkSession, d: str) -> DataFrame:
    """Pages with ``needed``; a page with images counts as covered by them, as the tables hold no image boxes."""
    p = table(spark, d, "page_text").groupBy("doc_id", "page_num").agg(F.max(F.coalesce("char_count", F.lit(0))).alias("n"), F.max(F.coalesce("has_images", F.lit(False))).alias("images"))
    return p.select("doc_id", "page_num", wb.needs_ocr(F.col("n"), F.col("images").cast("double")).alias("needed"))


def ocr_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _needed(spark, d)


def mostly_scanned(spark: SparkSession, d: str) -> DataFrame:
    return ls.mostly_scanned(_needed(spark, d))


def layer_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_meta").select("doc_id", "capa_texto").distinct().groupBy(F.coalesce("capa_texto", F.lit("unknown")).alias("layer")).agg(F.count("*").alias("documents"))


def file_dates(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "pdf_meta").select("doc_id", "fecha_archivo").distinct()
    raw = F.concat(F.lit("D:"), F.regexp_replace(F.regexp_replace("fecha_archivo", r"[-:T]|\+.*$", ""), "Z$", ""), F.when(F.col("fecha_archivo").contains("+"), F.regexp_replace(F.regexp_extract("fecha_archivo", r"(\+\d\d:\d\d)$", 1), ":", "'")).otherwise(""))
    return x.select("doc_id", "fecha_archivo", wb.pdf_date(F.when(F.col("fecha_archivo").rlike(r"^\d{4}-"), raw).otherwise(F.col("fecha_archivo"))).alias("iso"))


def document_names(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "pdf_meta").groupBy("doc_id").agg(F.min("title").alias("title"), F.min("filename").alias("filename"))
    x = x.withColumn("base", tx.slug(F.col("title")))
    return cp.unique_names(x, "base", ["doc_id"], ".md").select("doc_id", "name", tx.useful_title(F.col("title"), F.col("filename")).alias("useful"))


def document_facts(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each laid-out document, a row each."""
    first = [F.min(c).alias(c) for c in ("title", "author", "page_count", "filename", "url_origen", "fecha_archivo", "sha256_pdf", "idioma", "capa_texto", "ocr_motor", "lineas_suprimidas")]
    x = table(spark, d, "pdf_meta").groupBy("doc_id").agg(*first, F.max(F.coalesce("chars_extraidos", F.lit(0))).alias("chars"))
    links = table(spark, d, "layout_in").dropDuplicates().filter(F.col("link").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("links"))
    x = x.join(links, "doc_id", "left").na.fill(0, ["links"])
    return x.withColumn("chars_per_page", F.bround(F.col("chars") / F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)), 0).cast("int"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    return document_facts(spark, d).select("doc_id", fm.block(fm.document_rows(suppressed=True)).alias("front_matter"))


def document_manifest(spark: SparkSession, d: str) -> DataFrame:
    x = document_facts(spark, d)
    return x.select(
        F.col("filename").alias("archivo"), F.col("url_origen").alias("entrada"), F.coalesce("page_count", F.lit(0)).alias("paginas"), "chars", F.col("chars_per_page").alias("chars_pag"), F.coalesce("capa_texto", F.lit("")).alias("capa_texto"),
        F.col("links").alias("enlaces"), F.lit("").alias("avisos"), fm.conversion_state(F.coalesce("capa_texto", F.lit(""))).alias("estado"), "doc_id",
    )


def capture_stamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "web_in").select("page_id", fm.stamp(F.col("arrived_at")).alias("stamp")).distinct()


def page_records(spark: SparkSession, d: str) -> DataFrame:
    x = web_records(spark, d)
    address = F.coalesce("url_final", "url")
    return x.select("page_id", wb.domain(address).alias("domain"), F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), wb.route(address, F.col("content_type"), F.substring("html", 1, 8)).alias("route"), wb.is_url(F.col("url")).alias("is_url"))


def thin_reasons(spark: SparkSession, d: str) -> DataFrame:
    visible = F.regexp_replace("html", "<[^>]*>", " ")
    return web_records(spark, d).filter(F.col("html").isNotNull()).select("page_id", wb.thin_reason(F.col("html"), visible).alias("reason")).filter("reason <> ''")


def new_captures(spark: SparkSession, d: str) -> DataFrame:
    x = web_records(spark, d).withColumn("sha", F.lower("sha256"))
    done = x.filter("lote = 0").select(F.col("sha").alias("key")).union(x.filter("lote = 0").select(F.col("url_final")))
    return cp.still_to_do(x.filter("lote > 0").select("page_id", "lote", "sha", "url_final"), done, ["sha", "url_final"]).select("page_id", "lote")


def output_guard(spark: SparkSession, d: str) -> DataFrame:
    """New results of files of the same name as accepted ones, by the characters taken from each."""
    x = table(spark, d, "pdf_meta").groupBy("doc_id").agg(F.min("filename").alias("filename"), F.min("lote").alias("lote"), F.max(F.coalesce("chars_extraidos", F.lit(0))).alias("n_chars")).filter(F.col("filename").isNotNull())
    old = x.filter("lote = 0").groupBy("filename").agg(F.max("n_chars").alias("n_chars"))
    return cp.guarded(x.filter("lote > 0").select("doc_id", "filename", "n_chars"), old, "filename").select("doc_id", "keep_old")


def section_index(spark: SparkSession, d: str) -> DataFrame:
    return cp.manifest_summary(table(spark, d, "documents").select("source", "n_chars"), "source")


def queue_states(spark: SparkSession, d: str) -> DataFrame:
    return cp.queue_summary(table(spark, d, "documents").select(F.col("source").alias("state"), "n_chars"))


def plan_collection(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "pdf_meta").groupBy("doc_id").agg(F.min("url_origen").alias("path"), F.min("sitio").alias("folder"), F.min("filename").alias("name"), F.min(F.coalesce("chars_extraidos", F.lit(0))).alias("length"), F.min(F.lower("sha256_pdf")).alias("digest"), F.min("lote").alias("lote"))
    existing = x.filter("lote = 0 and digest is not null").select(F.concat_ws("__", "folder", "name").alias("target"), "digest").groupBy("target").agg(F.min("digest").alias("digest"))
    return cp.collection_plan(x, existing).select("path", "state", "note")


def collection_summary(spark: SparkSession, d: str) -> DataFrame:
    return cp.collection_summary(plan_collection(spark, d))


def to_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a text layer whose output was made, here those of the accepted history."""
    names = document_names(spark, d).select("doc_id", "name")
    layers = ls.text_layers(table(spark, d, "page_text")).select("doc_id", "layer")
    made = table(spark, d, "pdf_meta").filter("lote = 0").select("doc_id").distinct().join(names, "doc_id")
    return cp.to_repeat(names.join(layers, "doc_id"), made).select("doc_id", "name")


def work_lines(spark: SparkSession, d: str) -> DataFrame:
    """Work lists, one for each batch, out of the addresses and sections of the records, in every form of row."""
    m = table(spark, d, "web_meta").groupBy("page_id").agg(F.min("seccion").alias("s"), F.min("url_solicitada").alias("u"), F.min("lote").alias("lote")).filter(F.col("u").isNotNull())
    n, p = F.pmod("page_id", F.lit(9)), F.col("page_id").cast("string")
    row = (
        F.when(n == 0, F.concat(F.col("u"), F.lit("  # nota"))).when(n == 1, F.concat(F.lit("a/../p"), p, F.lit(".html ; "), F.col("u"))).when(n == 2, F.concat(F.col("u"), F.lit(" | id_"), p)).when(n == 3, F.concat(F.lit("vea ("), F.col("u"), F.lit(") y https://otra.test/"), p, F.lit(".")))
        .when(n == 4, F.concat(F.lit("[CAPTURA LOCAL] `c/"), p, F.lit(".htm`"))).when(n == 5, F.concat(F.lit("id-"), p, F.lit("\t"), F.col("u"))).when(n == 6, F.concat(F.lit("x/./"), p, F.lit(".HTML"))).when(n == 7, F.concat(F.lit("p.htm;"), F.col("u"), F.lit(";"), p)).otherwise("ruta ; url")
    )
    head = F.when(F.pmod("page_id", F.lit(7)) == 0, F.concat(F.lit("## "), F.coalesce("s", F.lit("Varios")), F.lit(" — notas"))).when(F.pmod("page_id", F.lit(11)) == 0, "# Lista de páginas").otherwise("# Portada")
    return m.select(F.col("lote").alias("list_id"), (F.col("page_id") * 2).alias("line_no"), head.alias("value")).union(m.select("lote", F.col("page_id") * 2 + 1, row))


def work_items(spark: SparkSession, d: str) -> DataFrame:
    return cp.work_items(work_lines(spark, d), base="/listas")


def _link_boxes(spans: DataFrame) -> DataFrame:
    """Rectangles of the links of a page: those of the spans that bear them, a little wider, as drawn around them."""
    box = [(F.col(c) + by).alias(c) for c, by in (("x0", -2.0), ("y0", -1.0), ("x1", 2.0), ("y1", 1.0))]
    return spans.filter(F.col("link").isNotNull()).select("doc_id", "page_num", *box, F.col("link").alias("target")).distinct()


def linked_spans(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "layout_in").dropDuplicates()
    return nt.linked_spans(s.drop("link"), _link_boxes(s)).filter(F.col("target").isNotNull()).select(*ls.LINE, "span_no", "target").distinct()


def loose_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of a page that no span of at most twelve characters carries."""
    s = table(spark, d, "layout_in").dropDuplicates()
    return nt.links_without_anchor(s.filter(F.length("text") <= 12), _link_boxes(s))


def link_counts(spark: SparkSession, d: str) -> DataFrame:
    return ls.lines(table(spark, d, "layout_in")).groupBy("doc_id").agg(F.sum("links").alias("links"), F.count_if(F.col("links") > 0).alias("linked_lines"))


def note_body_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ls.body_sizes_without_notes(table(spark, d, "layout_in"))


def outline_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that an outline names, here that of the headings, deeper by one for each three pages."""
    s = table(spark, d, "layout_in")
    x = ls.lines(s)
    h = ls.headings(x, ls.body_sizes(s))
    outline = h.select("doc_id", "page_num", (F.col("level") + F.floor(F.col("page_num") / 3)).cast("int").alias("level"), F.upper("text").alias("title"))
    return nt.promoted_by_outline(x, outline).filter(F.col("outline_level").isNotNull()).select(*ls.LINE, "outline_level")


def lines_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document outside the boxes of its blocks that are set in columns."""
    x = ls.lines(table(spark, d, "layout_in"))
    boxes = x.filter(tx.looks_tabular(F.col("text"))).groupBy("doc_id", "page_num", "block_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return im.outside_tables(x, boxes).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"))


def spaced_rows(spark: SparkSession, d: str) -> DataFrame:
    x = doc_lines(spark, d).withColumn("cells", ls.spaced_cells(F.col("line"))).filter(F.size("cells") > 1)
    return x.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("columns"), F.sum(F.size("cells")).alias("cells"))


def plain_bullets(spark: SparkSession, d: str) -> DataFrame:
    x = doc_lines(spark, d)
    return x.withColumn("plain", tx.normal_bullet(F.col("line"))).filter(F.col("plain") != F.col("line")).select("doc_id", "line_no", "plain")


def escaped_headings(spark: SparkSession, d: str) -> DataFrame:
    x = doc_lines(spark, d)
    return x.withColumn("escaped", tx.escape_heading(F.col("line"))).filter(F.col("escaped") != F.col("line")).select("doc_id", "line_no", "escaped")


def quoted_titles(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "pdf_meta").select("doc_id", F.concat(F.col("title"), F.lit(' "a\\b" '), F.coalesce("author", F.lit(""))).alias("t")).filter(F.col("t").isNotNull()).distinct()
    q = tx.yaml_quoted(F.col("t"))
    return x.select("doc_id", q.alias("quoted"), tx.yaml_unquoted(q).alias("plain"), tx.yaml_list(F.array("t", F.lit("b"))).alias("listed"))


def markdown_addresses(spark: SparkSession, d: str) -> DataFrame:
    x = web_records(spark, d).select("page_id", F.concat_ws(" ", "url", F.when(F.pmod("page_id", F.lit(3)) == 0, F.lit("(a>b)"))).alias("u"), "url")
    return x.select("page_id", tx.markdown_url(F.when(F.pmod("page_id", F.lit(3)) == 0, F.col("u")).otherwise(F.col("url"))).alias("target"))


def cited_addresses(spark: SparkSession, d: str) -> DataFrame:
    x = doc_lines(spark, d).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit("https?://[^\\s><\"';|]+"), F.lit(0))).alias("raw"))
    return x.select("doc_id", "line_no", cp.clean_address(F.col("raw")).alias("address")).distinct()


def converted(spark: SparkSession, d: str) -> DataFrame:
    x = web_records(spark, d).filter(F.col("html").isNotNull()).select("page_id", F.coalesce("url_final", "url").alias("url"), "html")
    return pg.converted(x.repartition(max(4, spark.sparkContext.defaultParallelism)))


def web_manifest(spark: SparkSession, d: str) -> DataFrame:
    x = converted(spark, d).withColumn("content", wb.content_class(F.col("n_chars"))).withColumn("base", tx.slug(F.col("title")))
    return cp.unique_names(x, "base", ["page_id"], ".md", "-").select("page_id", "name", "title", "site", "lang", "n_chars", "n_blocks", "n_links", "n_images", "content", "criterion")


def web_metadata(spark: SparkSession, d: str) -> DataFrame:
    return converted(spark, d).select("page_id", "title", "author", "description", "site", "lang", "published", "url")


def removed_chrome(spark: SparkSession, d: str) -> DataFrame:
    return converted(spark, d).select("page_id", F.explode("removed").alias("reason")).groupBy("reason").agg(F.count("*").alias("pages"))


def web_markdown(spark: SparkSession, d: str) -> DataFrame:
    x = converted(spark, d).withColumn("content", wb.content_class(F.col("n_chars")))
    body = fm.with_notice(F.col("markdown"), F.col("content"), F.lit(""), F.lit(""))
    head = fm.block([F.concat(F.lit("title: "), tx.yaml_quoted(F.col("title"))), F.concat(F.lit("source_url: "), tx.yaml_quoted(F.coalesce("url", F.lit(""))))])
    return x.select("page_id", F.concat(head, F.lit("\n\n"), body).alias("markdown"))


def layout_markdown(spark: SparkSession, d: str) -> DataFrame:
    return dc.documents_markdown(table(spark, d, "layout_in"))


def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    return vw.line_kinds(doc_lines(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("lines"))


def forced_recognition(spark: SparkSession, d: str) -> DataFrame:
    return im.forced_recognition(table(spark, d, "page_text"))


ALL = (
    line_flags, caps_headings, doc_language, content_summary, exact_copies, size_candidates, formula_lines, code_documents, pipe_tables, repetition_keys, normal_spans, body_sizes, line_styles, running_lines, body_lines, layout_headings, prominent_titles,
    reading_order, cover_ends, text_layers, ocr_decisions, mostly_scanned, layer_histogram, file_dates, document_names, front_matter, document_manifest, capture_stamps, page_records, thin_reasons, new_captures, output_guard, section_index, queue_states, plan_collection, collection_summary,
    to_repeat, work_items, linked_spans, loose_links, link_counts, note_body_sizes, outline_lines, lines_outside_tables, spaced_rows, plain_bullets, escaped_headings, quoted_titles, markdown_addresses, cited_addresses,
    web_manifest, web_metadata, removed_chrome, web_markdown, layout_markdown, line_kinds, forced_recognition,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
