"""Front matter, notices and manifests in one file."""

from pyspark.sql import functions as F

from docweave.functions import frontmatter as fm
from docweave.sinks import tables


def test_notice_before_thin_pages(spark):
    df = spark.createDataFrame([("texto", "complete", "", ""), ("poco", "scarce", "cookies", "a.html"), ("", "absent", "", "")], "m string, c string, r string, a string")
    full, thin, none = (x[0] for x in df.select(fm.with_notice(F.col("m"), F.col("c"), F.col("r"), F.col("a"))).collect())
    assert full == "texto" and none == fm.NOTICE
    assert thin == fm.NOTICE + "\n> **Motivo detectado:** cookies. **Alternativa local disponible:** `a.html`.\n\npoco"


def test_a_manifest_is_one_sorted_file(spark, tmp_path):
    df = spark.createDataFrame([(f"d{i:03}", (i * 37) % 101, "con\ttab" if i == 5 else None) for i in range(101)], "archivo string, chars int, avisos string").repartition(5)
    tables.one_file(df, f"file://{tmp_path}/m.tsv", ["chars"], mark=True)
    raw = (tmp_path / "m.tsv").read_bytes()
    lines = raw.decode("utf-8-sig").split("\n")
    assert raw.startswith(b"\xef\xbb\xbf") and lines[0] == "archivo\tchars\tavisos" and [int(x.split("\t")[1]) for x in lines[1:-1]] == list(range(101))
    assert lines.count(lines[0]) == 1 and "con tab" in raw.decode() and not (tmp_path / "m.tsv.parts").exists()
    tables.one_file(df.limit(0), f"file://{tmp_path}/e.tsv", ["chars"], ";")
    assert (tmp_path / "e.tsv").read_text() == "archivo;chars;avisos\n"


def test_command_line_writes_one_manifest(spark, tmp_path, monkeypatch):
    from docweave import cli

    monkeypatch.setattr(cli, "local_session", lambda *a: spark)
    (tmp_path / "in").mkdir()
    for i, text in enumerate(("corto", "largo " * 200)):
        (tmp_path / "in" / f"p{i}.html").write_text(f"<html><head><title>Página {i}</title></head><body><article><h1>Página {i}</h1><p>{text}</p></article></body></html>")
    assert cli.main(["web", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    rows = [x.split("\t") for x in (tmp_path / "out" / "manifest.tsv").read_text("utf-8-sig").splitlines()]
    assert tuple(rows[0]) == tables.PAGE_COLUMNS and [r[7] for r in rows[1:]] == ["escaso", "completo"] and sorted(x.name for x in (tmp_path / "out").glob("*.md")) == ["pagina-0.md", "pagina-1.md"]
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1.4 x")
    assert cli.main(["collect", str(tmp_path / "in"), str(tmp_path / "plan")]) == 0
    assert (tmp_path / "plan" / "plan.csv").read_text("utf-8-sig").splitlines()[0] == "origen;destino;bytes;estado;observaciones"
