from docweave.layout import document as dc

from .test_operators import sample, spans


def test_hyphens():
    for a, b in (("docu-", "mentation"), ("INFORMA-", "TION"), ("biblio-", "teca")):
        assert dc.divides(a, b)
    for a, b in (("long-", "term"), ("left-", "right"), ("well-", "known"), ("high-", "level"), ("Anglo-", "American"), ("x", "y")):
        assert not dc.divides(a, b)
    assert dc.rejoined(["la docu-", "mentation sigue a long-", "term plan"]) == ["la documentation", "sigue a long-term", "plan"]


def test_tables():
    assert dc.table_rows(["| a | b |", "|---|---|", "| 1 | 2 |"]) == [["a", "b"], ["1", "2"]]
    assert dc.table_rows(["Nombre    Edad", "Ana    12", "Luis    7"]) == [["Nombre", "Edad"], ["Ana", "12"], ["Luis", "7"]]
    assert dc.table_rows(["una línea de prosa", "otra línea"]) is None


def test_blocks():
    page = dc.page_markdown([[("TITULO", 1, False)], [("Un párrafo que se", 0, False), ("corta aquí y", 0, False)], [("sigue después.", 0, False)], [("• uno", 0, False), ("• dos", 0, False)], [("int main() {", 0, True), ("return 0;", 0, True)], [("E = mc²", 0, False)]])
    assert page == "# TITULO\n\nUn párrafo que se corta aquí y sigue después.\n\n- uno\n- dos\n\n```\nint main() {\nreturn 0;\n```\n\n$$E = mc^{2}$$"


def test_documents(spark):
    got = dc.documents_markdown(sample(spark)).first().markdown
    assert got.startswith("<!-- p.1 -->\n\n## Seccion 1") and "REVISTA" not in got and "<!-- p.4 -->" in got
    assert dc.documents_markdown(spans(spark, [])).count() == 0
