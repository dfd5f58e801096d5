import pytest
from pyspark.sql import functions as F

from docweave.layout import notes, structure as ls
from docweave.operators import corpus as cp
from docweave.sources import fetch, files, pdf
from docweave.streaming import ingest

SPAN = "doc_id bigint, page_num int, width double, height double, block_no int, line_no int, span_no int, text string, size double, bold boolean, italic boolean, mono boolean, x0 double, y0 double, x1 double, y1 double, link string"


def spans(spark, rows):
    return spark.createDataFrame([(1, p, 595.0, 842.0, b, 0, 0, t, s, False, False, False, x0, y, x1, y + s, None) for p, b, t, s, x0, y, x1 in rows], SPAN)


def sample(spark):
    rows = []
    for p in range(1, 5):
        rows += [(p, 0, "REVISTA DE PRUEBAS", 8.0, 72.0, 30.0, 300.0), (p, 1, f"Seccion {p}", 16.0, 72.0, 120.0, 300.0), (p, 2, "Texto normal de la página que sigue.¹", 11.0, 72.0, 160.0, 500.0), (p, 3, "1 Una nota", 8.0, 72.0, 720.0, 300.0), (p, 4, str(p), 8.0, 290.0, 810.0, 300.0)]
    return spans(spark, rows + [(1, 5, "1", 7.0, 400.0, 160.0, 405.0)])


def test_running_lines_and_headings(spark):
    s = sample(spark)
    x = ls.lines(s.union(s))
    assert x.count() == 21 and [r.key for r in ls.repeated_lines(x).collect()] == ["revistadepruebas"]
    kept = {r.text for r in ls.without_running(x).collect()}
    assert "REVISTA DE PRUEBAS" not in kept and "4" not in kept and "Seccion 1" in kept
    assert {(r.text, r.level) for r in ls.headings(ls.without_running(x), ls.body_sizes(s)).collect()} == {(f"Seccion {p}", 2) for p in range(1, 5)}


def test_footnotes(spark):
    s = sample(spark)
    got = notes.footnotes(ls.lines(s), s, ls.body_sizes(s)).orderBy("number").collect()
    assert [(r.number, r.text, r.anchored) for r in got] == [(1, "Una nota", True), (2, "Una nota", False), (3, "Una nota", False), (4, "Una nota", False)]


def test_columns(spark):
    b = spark.createDataFrame([(1, 1, 0, 50.0, 50.0, 550.0, 80.0, 600.0), (1, 1, 1, 350.0, 100.0, 550.0, 120.0, 600.0), (1, 1, 2, 50.0, 100.0, 250.0, 120.0, 600.0), (1, 1, 3, 350.0, 200.0, 550.0, 220.0, 600.0), (1, 1, 4, 50.0, 200.0, 250.0, 220.0, 600.0)], "doc_id int, page_num int, block_no int, x0 double, y0 double, x1 double, y1 double, width double")
    assert [r.block_no for r in ls.reading_order(b).orderBy("turn").collect()] == [0, 2, 4, 1, 3]


@pytest.mark.parametrize("chars,layer", [([3000, 3500], "native"), ([500, 520, 510], "scarce"), ([40, 60, 30], "absent"), ([2000, 0, 0, 0, 10], "absent")])
def test_layers(spark, chars, layer):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(chars)], "doc_id int, page_num int, char_count int")
    assert ls.text_layers(df.union(df)).first().layer == layer


def test_links(spark):
    s = spans(spark, [(1, 0, "ancla", 11.0, 10.0, 10.0, 50.0), (1, 1, "otro", 11.0, 10.0, 100.0, 50.0)])
    links = spark.createDataFrame([(1, 1, 0.0, 8.0, 60.0, 25.0, "https://a.test"), (1, 1, 0.0, 400.0, 60.0, 420.0, "https://b.test"), (1, 1, 0.0, 100.0, 60.0, 120.0, "#x")], "doc_id int, page_num int, x0 double, y0 double, x1 double, y1 double, target string")
    assert {r.text: r.target for r in notes.linked_spans(s, links).collect()} == {"ancla": "https://a.test", "otro": None}
    assert {r.target for r in notes.links_without_anchor(s, links).collect()} == {"https://b.test", "#x"}


def test_collection_and_names(spark):
    f = spark.createDataFrame([("A/d.pdf", "A", "d.pdf", 5, "x"), ("B/d.pdf", "B", "d.pdf", 5, "y"), ("C/c.pdf", "C", "c.pdf", 5, "x"), ("C/e.pdf", "C", "e.pdf", 0, "z"), ("C/n.pdf", "C", "n.pdf", 3, None)], "path string, folder string, name string, length int, digest string")
    none = spark.createDataFrame([], "target string, digest string")
    plan = cp.collection_plan(f, none)
    assert tuple(cp.collection_summary(plan).first()) == (3, 1, 0, 2, 2)
    done = plan.filter("state = 'pending'").join(f.select("path", "digest"), "path").select("target", "digest")
    assert cp.collection_summary(cp.collection_plan(f, done)).first().present == 2
    n = spark.createDataFrame([(1, "a"), (2, "A"), (3, "a_2"), (4, "b"), (5, "a")], "i int, base string")
    got = [r.name for r in cp.unique_names(n, "base", ["i"], ".md").orderBy("i").collect()]
    assert len({x.lower() for x in got}) == 5 and got[0] == "a.md" and got[2] == "a_2.md"


def test_resume_and_guard(spark):
    b = spark.createDataFrame([(1, "h1", "u1"), (2, None, "u2"), (3, "h3", None)], "i int, sha string, url string")
    d = spark.createDataFrame([("h1",), ("u2",), (None,)], "key string")
    assert [r.i for r in cp.still_to_do(b, d, ["sha", "url"]).collect()] == [3]
    new = spark.createDataFrame([("a", 10), ("b", 900), ("c", 0)], "k string, n_chars int")
    old = spark.createDataFrame([("a", 50), ("b", 5000)], "k string, n_chars int")
    assert {r.k: r.keep_old for r in cp.guarded(new, old, "k").collect()} == {"a": True, "b": False, "c": False}


def test_work_items(spark):
    lines = ["# titulo", "", "## RECETAS — dulces", "https://a.test/x  # nota", "c.html ; ", "a.html ; https://b.test/y", "## LIBROS", "https://c.test/(16)"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "list_id string, line_no int, value string")
    got = [tuple(r)[2:] for r in cp.work_items(df).orderBy("line_no").collect()]
    assert got == [("RECETAS", "url", "https://a.test/x", "", ""), ("RECETAS", "local", "c.html", "", ""), ("RECETAS", "local", "a.html", "https://b.test/y", ""), ("LIBROS", "url", "https://c.test/(16)", "", "")]


def test_rows_of_work_lists(spark):
    """Each form of row, title headings and column rows; expected items written by hand."""
    cases = [
        ("url ; doc_id", []), ("https://a.test/1 ; E1_x.y", [("url", "https://a.test/1", "", "E1_x.y")]), ("E2 | https://a.test/2).", [("url", "https://a.test/2", "", "E2")]), ("./p/../a.html\tE3", [("local", "/base/a.html", "", "E3")]),
        ("a.html ; https://b.test/(1) ; E4", [("local", "/base/a.html", "https://b.test/(1)", "E4")]), ("https://b.test/5 | 'b.htm' | E5", [("local", "/base/b.htm", "https://b.test/5", "E5")]), ("[CAPTURA LOCAL] `x/y.html`", [("local", "/base/x/y.html", "`x/y.html`", "")]),
        ("vea [uno](https://c.test/1), y https://c.test/2.).", [("url", "https://c.test/1", "", ""), ("url", "https://c.test/2", "", "")]), ("https://d.test/1 ; https://d.test/2", [("url", "https://d.test/1", "", ""), ("url", "https://d.test/2", "", "")]), ("solo palabras", []), ("/abs/z.HTML", [("local", "/abs/z.HTML", "", "")]),
    ]
    lines = ["# Título del todo", *[v for v, _ in cases[:2]], "# Sección", *[v for v, _ in cases[2:4]], "## Lista de enlaces", *[v for v, _ in cases[4:]], "##", "### Otra - parte 2", "https://e.test"]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(lines)], "list_id string, line_no int, value string")
    got = [(r.section, r.kind, r.origin, r.declared_url, r.out_name) for r in cp.work_items(df, base="/base").orderBy("line_no").collect()]
    want = [("" if k < 2 else "Sección", *x) for k, (_, xs) in enumerate(cases) for x in xs] + [("Otra", "url", "https://e.test", "", "")]
    assert sorted(got) == sorted(want)


def test_names_of_a_frequent_base(spark):
    """A base that most rows have is numbered over several ranges; null is a base of its own."""
    rows = [(i, "document" if i % 10 else f"t{i}") for i in range(500)] + [(900, "document_7"), (901, "Document_8")]
    got = cp.unique_names(spark.createDataFrame(rows, "i int, base string"), "base", ["i"], ".md").collect()
    by = {r.i: r.name for r in got}
    assert len(got) == 502 and len({r.name.lower() for r in got}) == 502 and by[1] == "document.md" and by[2] == "document_2.md" and by[900] == "document_7.md" and by[499] == "document_450.md"


def test_layers_of_stamps_and_recognised_pages(spark):
    def layer(pages):
        df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pages)], "doc_id int, page_num int, char_count int, has_images boolean, ocr_aplicado boolean")
        return ls.text_layers(df).first().layer

    assert layer([(103, True, False)] * 8) == "absent" and layer([(103, False, False)] * 8) == "scarce" and layer([(2000, True, True)] * 3 + [(0, True, None)]) == "ocr"
    assert layer([(900, False, None)] * 5 + [(0, True, None)] * 6) == "scarce" and layer([(900, False, False)] * 3 + [(0, True, False)] * 6) == "absent"


def test_columns_need_blocks_side_by_side(spark):
    def order(*boxes):
        b = spark.createDataFrame([(1, 1, i, *x, 600.0) for i, x in enumerate(boxes)], "doc_id int, page_num int, block_no int, x0 double, y0 double, x1 double, y1 double, width double")
        return [r.block_no for r in ls.reading_order(b).orderBy("turn").collect()]

    assert order((350.0, 100.0, 550.0, 120.0), (50.0, 200.0, 250.0, 220.0), (350.0, 300.0, 550.0, 320.0)) == [0, 1, 2]
    assert order((350.0, 100.0, 550.0, 200.0), (50.0, 100.0, 320.0, 200.0), (200.0, 300.0, 400.0, 320.0), (340.0, 350.0, 550.0, 400.0), (40.0, 360.0, 250.0, 400.0)) == [1, 0, 2, 4, 3]
    assert order((350.0, 100.0, 550.0, 200.0), (50.0, 100.0, 320.0, 200.0)) == [0, 1]


def test_cover_by_a_heading(spark):
    lines = [(1, 1, 0, 0, "EDITORIAL NORTE"), (1, 2, 0, 0, "corta"), (1, 3, 0, 0, "x" * 250), (1, 4, 0, 0, "y" * 450), (2, 1, 0, 0, "z" * 900)]
    df = spark.createDataFrame(lines, "doc_id int, page_num int, block_no int, line_no int, text string")
    heads = spark.createDataFrame([(1, 3)], "doc_id int, page_num int")
    assert [tuple(r) for r in ls.cover_ends(df, heads).collect()] == [(1, 3)] and [tuple(r) for r in ls.cover_ends(df, heads.limit(0)).collect()] == [(1, 4)]


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "backups").mkdir(parents=True)
    (tmp_path / "in" / "a.html").write_bytes("<meta charset=iso-8859-1><p>café".encode("latin-1"))
    (tmp_path / "in" / "x.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "in" / "y.PDF").write_bytes(b"no")
    (tmp_path / "in" / "backups" / "z.pdf").write_bytes(b"%PDF-1.4")
    r = files.html_files(spark, str(tmp_path / "in")).first()
    assert r.encoding == "iso-8859-1" and "café" in r.html
    assert sorted(x.is_pdf for x in files.pdf_files(spark, str(tmp_path / "in"), ("backups",)).collect()) == [False, True]
    assert files.decode(b"\x81\xff\xfe", None)[0]
    got = pdf.spans(files.pdf_files(spark, str(tmp_path / "in")), lambda raw, *_: [(1, 1.0, 1.0, 0, 0, 0, "t", 9.0, False, False, False, 0.0, 0.0, 1.0, 1.0, None)] if raw[:4] == b"%PDF" else 1 / 0).collect()
    assert sum(x.text == "t" for x in got) == 2 and sum("division" in (x.error or "") for x in got) == 1


def test_fetch(spark):
    def transport(url, timeout, limit):
        if "bad" in url:
            raise OSError("refused")
        return 200, url + "/", "text/html", b"<p>hola"

    urls = spark.createDataFrame([("http://a",), ("http://bad",), (None,)], "url string")
    got = {r.url: (r.status, r.html, r.error) for r in fetch.fetched(urls, transport, pause=0, wait=0).collect()}
    assert got["http://a"] == (200, "<p>hola", "") and got["http://bad"][2] == "refused" and got[None][2]


def test_front_matter(spark):
    df = spark.createDataFrame([("p", '---\ntitle: "a: b"\nsource_url: "https://x"\ntitle: "z"\n---\ntexto')], "path string, value string")
    assert files.front_matter(df).first().fields == {"title": "a: b", "source_url": "https://x"}
    assert [r.key for r in files.done_keys(df).collect()] == ["https://x"]


def test_incremental(spark, tmp_path):
    src, man, chk = (str(tmp_path / x) for x in ("src", "man", "chk"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string").coalesce(1).write.parquet(src)
    for rows in (None, [(2, "b"), (3, "c")]):
        if rows:
            spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(src)
        q = ingest.incremental(ingest.stream_rows(spark, src, "id int, v string"), "id", lambda d: d.select("id", F.upper("v").alias("v")), man, chk)
        q.awaitTermination(60)
    assert sorted((r.id, r.v) for r in spark.read.parquet(man).collect()) == [(1, "A"), (2, "B"), (3, "C")]


def test_alternatives_and_queue(spark):
    thin = spark.createDataFrame([("a.md", "/o/x"), ("b.md", "/o/x")], "name string, folder string")
    files_ = spark.createDataFrame([("/o/html/a.html",), ("/o/A.HTML",), ("/q/b.html",)], "path string")
    assert {r.name: r.alternative for r in cp.local_alternatives(thin, files_).collect()} == {"a.md": "/o/html/a.html", "b.md": None}
    u = spark.createDataFrame([("https://a/x_(16)",), ("https://a/x).",), ("https://a/x;",), (None,)], "u string")
    assert [r[0] for r in u.select(cp.clean_address(F.col("u"))).collect()] == ["https://a/x_(16)", "https://a/x", "https://a/x", None]
    q = spark.createDataFrame([("done", 5), ("done", None), (None, 1)], "state string, n_chars int")
    assert {r.state: (r.items, r.chars) for r in cp.queue_summary(q).collect()} == {"done": (2, 5), "waiting": (1, 1)}
    m = spark.createDataFrame([("a", "absent"), ("b", "native"), ("c", "absent")], "name string, layer string")
    assert [r.name for r in cp.to_repeat(m, m.filter("name <> 'c'")).collect()] == ["a"]
    s = sample(spark)
    assert ls.body_sizes_without_notes(s).first().body == 11.0
