"""Command line: ``web`` and ``collect`` over folders; exit 1 if a file failed."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions import text as tx
from .functions import web as wb
from .html import page as pg
from .operators import corpus as cp
from .session import local_session
from .sinks import tables as sk
from .sources import files as src


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave")
    sub = parser.add_subparsers(dest="command", required=True)
    web = sub.add_parser("web", help="pages of a folder as Markdown")
    web.add_argument("folder")
    web.add_argument("out")
    web.add_argument("--whole-page", action="store_true")
    for name in ("tables", "code", "links", "alt"):
        web.add_argument(f"--no-{name}", action="store_true")
    web.add_argument("--wikilinks", action="store_true")
    web.add_argument("--callouts", action="store_true")
    web.add_argument("--cores", type=int)
    collect = sub.add_parser("collect", help="plan a collection of the PDF files of a folder")
    collect.add_argument("folder")
    collect.add_argument("out")
    collect.add_argument("--exclude", action="append", default=[])
    collect.add_argument("--cores", type=int)
    a = parser.parse_args(args)
    spark = local_session(a.cores)
    if a.command == "web":
        options = pg.PageOptions(prune=not a.whole_page, body_only=not a.whole_page, tables=not a.no_tables, code=not a.no_code, links=not a.no_links, alt_text=not a.no_alt, wikilinks=a.wikilinks, callouts=a.callouts)
        pages = src.html_files(spark, a.folder).withColumn("page_id", F.xxhash64("path")).withColumn("url", F.lit(None).cast("string"))
        x = pg.converted(pages, options).withColumn("base", tx.slug(F.col("title"))).withColumn("content", wb.content_class(F.col("n_chars")))
        named = cp.unique_names(x, "base", ["page_id"], ".md", "-").cache()
        failed = sk.markdown_files(named, a.out).filter(F.col("error").isNotNull()).count()
        sk.one_file(sk.page_manifest(named), f"{a.out}/manifest.tsv", ["chars", "archivo"], mark=True)
        return int(failed > 0)
    f = src.pdf_files(spark, a.folder, tuple(a.exclude))
    files = f.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.when(F.col("is_pdf"), F.col("digest")).alias("digest"))
    plan = cp.collection_plan(files, spark.createDataFrame([], "target string, digest string"))
    report = plan.select(*[F.col(a).alias(b) for a, b in zip(("path", "target", "length", "state", "note"), sk.COLLECTION_COLUMNS)])
    sk.one_file(report, f"{a.out}/plan.csv", ["origen"], ";", mark=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
