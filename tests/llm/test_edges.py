"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from docweave.llm import encoding, language, linkage, mixing, packing, quality, repeated, residue, scanned, web

WEB_IN = "page_id bigint, url string, url_final string, html string, status int, content_type string, encoding string, sha256 string, captured_at string, lote int, arrived_at timestamp_ntz, host string, k string, blocks string, token string, title string"
WEB_META = "page_id bigint, titulo string, autor string, sitio string, idioma string, sha256_html string, lote int, id bigint, kind string"
LAYOUT = "doc_id bigint, page_num int, width double, height double, block_no int, line_no int, span_no int, text string, size double, bold boolean, italic boolean, mono boolean, x0 double, y0 double, x1 double, y1 double, link string, sitio string, lines string, run boolean"
PAGE_TEXT = "doc_id bigint, page_num int, width double, height double, char_count int, has_images boolean, ocr_aplicado boolean"
PDF_META = "doc_id bigint, title string, author string, sha256_pdf string, idioma string, capa_texto string, lote int, body double"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, sitio string, lineas_suprimidas array<string>, site string, keys string, kind string, n_tokens string"
WORDS, SPECS, MIX = "lang string, word string", "spec_id int, capacity_tokens int, separator_tokens int", "mix_id string, source string, target_share double, max_repeats int"


def rows(spark, schema, data):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in data], schema)


PAGE = "<html><body><nav><a href='/x'>Menú</a></nav><article><h1>Uno</h1><p>La casa de la ciudad está en el norte, y no se puede ver desde aquí.</p></article></body></html>"


def tables(spark, full):
    web_rows = [dict(page_id=1, url="https://a.test/uno-1", html=PAGE, lote=0), dict(page_id=1, url="https://a.test/uno-1", html=PAGE, lote=0), dict(page_id=2), dict(page_id=3, html=""), dict(page_id=4, html="<p>" + "palabra " * 50_000), dict(html=PAGE), dict(page_id=5, html="<div><div>", url="::bad")]
    lay = [dict(doc_id=1, page_num=1, block_no=0, line_no=i, span_no=0, text=t, size=11.0) for i, t in enumerate(("El regis-", "tro de la casa", "fin"))]
    lay += lay[:1] + [dict(doc_id=2), dict(page_num=1, text="x"), dict(doc_id=3, page_num=1, text="", size=8.0), dict(doc_id=4, page_num=1, block_no=0, line_no=0, span_no=0, text="largo " * 20_000, size=11.0)]
    docs = [dict(doc_id=1, text="Una línea larga repetida\notra", sitio="WWW.a.test", source="s"), dict(doc_id=2), dict(doc_id=3, text="", sitio=" ", source="s"), dict(doc_id=4, text="palabra " * 40_000, sitio="a.test", source="s"), dict(doc_id=5, text="\n\n", sitio="a.test", lineas_suprimidas=[None, "Una línea larga repetida"])]
    data = dict(
        web_in=(WEB_IN, web_rows), web_meta=(WEB_META, [dict(page_id=1, idioma="EN"), dict(page_id=1, idioma="EN"), dict()]), layout_in=(LAYOUT, lay), page_text=(PAGE_TEXT, [dict(doc_id=1, page_num=1, ocr_aplicado=True), dict(doc_id=2), dict()]),
        pdf_meta=(PDF_META, [dict(doc_id=1, capa_texto="ocr", idioma=" "), dict(doc_id=1, capa_texto="ocr", idioma=" "), dict()]), documents=(DOCS, docs), common_words=(WORDS, [dict(lang="es", word="de"), dict(lang="en", word="the"), dict()]),
        pack_specs=(SPECS, [dict(spec_id=1, capacity_tokens=64), dict(spec_id=2, capacity_tokens=0), dict()]), mix_targets=(MIX, [dict(mix_id="m", source="s", target_share=0.5), dict(mix_id="m", source="none", target_share=0.5, max_repeats=3), dict()]),
    )
    return {k: rows(spark, s, r if full else []) for k, (s, r) in data.items()}


def run_all(t):
    p3 = [t[k] for k in ("layout_in", "page_text", "pdf_meta")]
    yield "p1", scanned.found_lines(*p3)
    yield "p1 text", scanned.body_paragraphs(*p3)
    parsed = web.parsed_pages(t["web_in"], t["common_words"])
    yield "p2", web.article_blocks(parsed)
    yield "p7", residue.residue_pages(web.article_blocks(parsed))
    yield "p2 kept", residue.real_articles(parsed)
    yield "p2 text", web.main_text(residue.real_articles(parsed))
    yield "p3", encoding.garbled_records(t["web_in"])
    yield "p3 text", encoding.restored_records(t["web_in"])
    yield "p4", linkage.repeats(t["web_in"], t["web_meta"], *p3, t["common_words"])
    yield "p5", repeated.repeated_lines(t["documents"])
    yield "p5 text", repeated.without_repeated_lines(t["documents"])
    paragraphs = language.record_paragraphs(t["web_in"], *p3, t["common_words"])
    labels = language.record_labels(t["web_meta"], t["pdf_meta"])
    sized = language.compressed_sizes(paragraphs, language.language_samples(paragraphs, labels, t["common_words"]))
    yield "p6", language.bad_labels(sized, labels)
    yield "p6 segments", language.segments(sized)
    placed = packing.containers(t["documents"], t["pack_specs"])
    yield "p8", placed
    yield "p8 fill", packing.fill_report(placed, t["pack_specs"])
    order, need = mixing.schedule(t["documents"], t["mix_targets"])
    yield "p9", order
    yield "p9 shares", mixing.shares(order, need)
    yield "p10", quality.document_kinds(t["documents"], t["common_words"])


@pytest.mark.parametrize("full", [False, True])
def test_no_operator_fails(spark, full):
    counts = {name: df.count() for name, df in run_all(tables(spark, full))}
    if not full:
        empty = {k: v for k, v in counts.items() if k not in ("p9 shares",)}
        assert set(empty.values()) == {0}
    else:
        assert counts["p10"] == 5 and counts["p2"] >= 2 and counts["p5 text"] == 5 and counts["p8"] > 100


def test_repeated_delivery_counts_once(spark):
    t = tables(spark, True)
    got = web.article_blocks(web.parsed_pages(t["web_in"])).filter("page_id = 1").select("page_id", F.md5("t")).distinct()
    assert got.count() == 2
