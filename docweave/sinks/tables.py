"""Markdown files, manifests, indexes."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_files(df: DataFrame, folder: str) -> DataFrame:
    """Write ``markdown`` to ``name`` below a folder all executors share; (name, bytes, error) of each file.

    Lazy: the files are written when the result is used. A failure is in the row, nothing stops."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Path(folder)
        for b in batches:
            sizes, errors = [], []
            for name, text in zip(b.column("name").to_pylist(), b.column("markdown").to_pylist()):
                try:
                    raw = (text or "").encode()
                    target = base / name
                    target.parent.mkdir(parents=True, exist_ok=True)
                    target.write_bytes(raw)
                    sizes.append(len(raw))
                    errors.append(None)
                except OSError as e:
                    sizes.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["name", "bytes", "error"])

    return df.select("name", "markdown").mapInArrow(run, "name string, bytes bigint, error string")


def manifest(df: DataFrame, folder: str, order: list[str], separator: str = "\t") -> None:
    """A separated-value manifest, sorted, with a header in each part."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))], *[F.array_join(c, "; ").alias(c) for c, t in df.dtypes if t.startswith("array<string")])
    text.orderBy(*[F.col(c) if dict(df.dtypes)[c] == "string" else F.col(c).cast("double") for c in order]).write.mode("overwrite").option("sep", separator).option("header", "true").csv(folder)


# The columns of the manifests, in order.
DOCUMENT_COLUMNS = ("archivo", "entrada", "paginas", "chars", "chars_pag", "capa_texto", "enlaces", "avisos")
PAGE_COLUMNS = ("archivo", "seccion", "url", "chars", "bloques", "enlaces", "imagenes", "contenido", "criterio_cuerpo", "avisos")
COLLECTION_COLUMNS = ("origen", "destino", "bytes", "estado", "observaciones")
CONTENT_NAMES = {"complete": "completo", "scarce": "escaso", "absent": "ausente"}


def page_manifest(pages: DataFrame) -> DataFrame:
    """Rows of converted pages (name, url, n_chars, n_blocks, n_links, n_images, content, criterion, and section if known)
    with PAGE_COLUMNS; pages that are not complete bear a notice."""
    content = F.coalesce(*[F.when(F.col("content") == a, b) for a, b in CONTENT_NAMES.items()])
    section = F.col("section") if "section" in pages.columns else F.lit("")
    values = (F.col("name"), section, F.col("url"), F.col("n_chars"), F.col("n_blocks"), F.col("n_links"), F.col("n_images"), content, F.col("criterion"), F.when(F.col("content") == "complete", "").otherwise(F.concat(F.lit("contenido "), content)))
    return pages.select(*[v.alias(c) for v, c in zip(values, PAGE_COLUMNS)])


def one_file(df: DataFrame, target: str, order: list[str], separator: str = "\t", mark: bool = False) -> None:
    """A separated-value file with one header, sorted by ``order``; with ``mark`` it begins with a byte order mark.

    The rows are sorted and written in parts, which are then streamed behind the header one after another, so nothing of
    the table is held by the driver."""
    spark = df.sparkSession
    parts = f"{target}.parts"
    row = F.concat_ws(separator, *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in df.columns])
    df.orderBy(*order).select(row.alias("value")).write.mode("overwrite").text(parts)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, path = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(conf)
    out = fs.create(path, True)
    out.write(bytearray(("\ufeff" if mark else "").encode() + (separator.join(df.columns) + "\n").encode()))
    for name in sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")):
        part = fs.open(jvm.org.apache.hadoop.fs.Path(folder, name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
        part.close()
    out.close()
    fs.delete(folder, True)


def index_tables(rows: DataFrame) -> DataFrame:
    """(section, markdown): a table per section of rows (section, name, title, n_chars, content), least characters first.

    The rows of a section are gathered in its cell: an index of the size of a section's list."""
    entry = F.struct("n_chars", "name", F.concat_ws("", F.lit("| "), "title", F.lit(" | "), "name", F.lit(" | "), F.format_number("n_chars", 0), F.lit(" | "), "content", F.lit(" |")).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["row"]), "\n")
    g = rows.withColumn("section", F.coalesce("section", F.lit("General"))).groupBy("section").agg(F.count("*").alias("n"), body.alias("body"))
    return g.select("section", F.concat(F.lit("## "), "section", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n| title | file | chars | content |\n|---|---|---|---|\n"), "body").alias("markdown"))
