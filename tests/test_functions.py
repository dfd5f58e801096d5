import pytest
from pyspark.sql import functions as F

from docweave.functions import equations as eq
from docweave.functions import markdown as md
from docweave.functions import text as tx
from docweave.functions import web as wb
from docweave.html import page as pg


def col(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_page_numbers(spark):
    assert col(spark, tx.is_page_number, ["12", "- 7 -", "Página 3 de 40", "Page 3/40", "| 5 |", "2024 fue un año clave", "Capitulo 3", "3.1 Metodologia", ""]) == [True] * 5 + [False] * 4


def test_slug(spark):
    assert col(spark, tx.slug, ["Informe Anual: Situación 2026's", "Ñandú & Co.", "¿¡!?", None, "x" * 100]) == ["informe-anual-situacion-2026s", "nandu-co", "document", "document", "x" * 80]


def test_dates(spark):
    assert col(spark, wb.pdf_date, ["D:20080210075913-05'00'", "D:2008", "D:20080210", "20080210075913Z", "ayer", None]) == ["2008-02-10T07:59:13-05:00", "2008-01-01", "2008-02-10", "2008-02-10T07:59:13Z", "ayer", ""]


def test_repetition_key(spark):
    a, b, c, d = col(spark, tx.repetition_key, ["Revista de Estudios Rurales 12", "REVISTA DE ESTUDIOS RURALES 13", "Capitulo 1", "Capitulo 2"])
    assert a == b and c != d


def test_normalise(spark):
    assert col(spark, tx.normalise, ["ﬁn de‑mo​", "cor­", "a b", "x\x07²"]) == ["fin de-mo", "cor-", "a b", "x²"]


def test_titles_and_headings(spark):
    df = spark.createDataFrame([("Untitled", "a.pdf"), ("Informe.docx", "a.pdf"), ("Informe", "Informe.pdf"), ("Informe anual", "a.pdf"), (None, None)], "t string, f string")
    assert [r[0] for r in df.select(tx.useful_title(F.col("t"), F.col("f"))).collect()] == [False, False, False, True, False]
    assert col(spark, lambda c: tx.heading_level(c, F.lit(11.0), F.lit(11.0), F.lit(True)), ["LA REGIÓN", "La región", "12", "STRASSE ß"]) == [2, 0, 0, 0]
    assert col(spark, tx.ends_cut, ["Y JOURNAL OF", "Historia,", "Historia de España", "12"]) == [True, True, False, True]


def test_language(spark):
    en, es = "the history of the city and of the people that was not in this book " * 4, "la historia de la ciudad y de los pueblos que no se conserva en el libro con las cartas " * 4
    assert col(spark, tx.language_vote, [en, es, "short text", None]) == ["en", "es", "", ""]


@pytest.mark.parametrize("text,out", [("E = mc²", "$$E = mc^{2}$$"), ("Ecuacion: α + β = γ", "Ecuacion: $\\alpha + \\beta = \\gamma$"), ("hay 25° en la sala", "hay 25° en la sala"), ("suma ∑ total", "suma $\\sum$ total")])
def test_equations(text, out):
    assert eq.line_with_math(text) == out


def test_math_column(spark):
    assert col(spark, eq.with_math, ["E = mc²", "sin nada", None]) == ["$$E = mc^{2}$$", "sin nada", None]


def test_markdown():
    assert md.merged_links("[The](u) [Dis](u) [x](v)") == "[The Dis](u) [x](v)"
    assert md.link("ver", "nota.md", True) == "[[nota|ver]]" and md.link("nota", "nota.md", True) == "[[nota]]"
    assert md.link("a b", "https://x.test/(1)") == "[a b](<https://x.test/(1)>)"
    assert md.callout(["Advertencia: cuidado", "más"]) == ["> [!WARNING]", "> cuidado", "> más"]
    assert md.reflowed(["- uno", "sigue", "- dos", "", "fin", "de línea"]) == "- uno sigue\n- dos\nfin de línea"
    assert md.table([["a", "b|c"], ["1"]]).split("\n") == ["| a    | b\\|c |", "| ---- | ---- |", "| 1    |      |"]
    assert md.span(md.Span("  x ", bold=True, italic=True)) == "  ***x*** "


def test_reflow_and_callouts_in_detail():
    assert md.reflowed(["-[x] hecho", "y más", "a) letra", "> cita", "sigue", "---", "1) uno", "![i](u)"]) == "-[x] hecho y más\na) letra\n> cita\nsigue\n---\n1) uno\n![i](u)"
    assert [md.opens_item(x) for x in ("- x", "  * x", "12. x", "a) x", "ab) x", "-x", "- [ ] x", "-[X] x", "-[y] x", "2024 fue", "")] == [True, True, True, True, False, False, True, True, False, False, False]
    assert md.merged_links("[a](u)[b](u)\n[c](u) y [d](u)\t[e](u).") == "[a b](u)\n[c](u) y [d e](u)." and md.merged_links("sin [nada] (u)") == "sin [nada] (u)"
    assert md.callout(["> Nota - ver", "> "]) == ["> [!NOTE]", "> - ver"] and md.callout(["> Tip: ver", "> "]) == ["> [!TIP]", "> ver"] and md.callout(["> [!tip] x", "y"]) == ["> [!tip] x", "> y"] and md.callout(["Notable cosa"]) == ["> [!NOTE]", "> Notable cosa"] and md.callout([]) == []


def test_titles_without_their_site():
    assert pg.short_title("Mango - Wikipedia", "Wikipedia", "es.wikipedia.org") == "Mango" and pg.short_title("Manual - segunda edición", "Editorial", "a.test") == "Manual - segunda edición"
    assert pg.short_title("A - B | El Diario Norte", "", "diarionorte.test") == "A - B | El Diario Norte" and pg.short_title(" - Norte", "Norte", "") == " - Norte" and pg.short_title("", "Norte", "") == ""


def test_web_functions(spark):
    assert col(spark, wb.domain, ["https://www.a.test:80/x?q", "ftp://b.test", "no", None]) == ["a.test:80", "b.test", "", None]
    assert col(spark, lambda c: wb.route(c, F.lit(None).cast("string"), F.lit("<html")), ["https://a/x.zip?1", "https://a/x.PDF", "https://a/x"]) == ["binary", "pdf", "page"]
    assert col(spark, lambda c: wb.thin_reason(c, c), ["Just a moment...", "Accept all cookies", 'x <div id="root">', "texto"]) == ["anti-bot", "cookies", "script", ""]
