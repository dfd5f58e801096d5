"""Files as tables: pages, documents, work lists, earlier outputs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

#: Bytes in which a page's own charset mark is looked for.
CHARSET_HEAD = 4096


def binary_files(spark: SparkSession, folder: str, pattern: str, excluded: tuple[str, ...] = (), content: bool = True) -> DataFrame:
    """(path, length, modified, content) of the files below a folder, without those under an excluded folder name.

    Without ``content`` the bytes are not read: a first pass by size and name costs only the listing."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    for name in excluded:
        df = df.filter(~F.lower("path").rlike(rf"/{re.escape(name.lower())}/"))
    cols = [F.col("path"), F.col("length"), F.date_format("modificationTime", "yyyy-MM-dd").alias("modified")]
    return df.select(*cols, "content") if content else df.select(*cols)


def pdf_files(spark: SparkSession, folder: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """PDF files with ``is_pdf`` by their first bytes and their SHA-256."""
    return binary_files(spark, folder, "*.[pP][dD][fF]", excluded).withColumn("is_pdf", F.substring("content", 1, 5) == F.lit(b"%PDF-")).withColumn("digest", F.sha2("content", 256))


def decode(raw: bytes | None, content_type: str | None) -> tuple[str, str]:
    """(text, encoding): by the header's charset, the page's own mark, UTF-8, Windows-1252, else UTF-8 with replacements."""
    raw = raw or b""
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", content_type or "", re.I)
    own = re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w.:-]+)", raw[:CHARSET_HEAD], re.I)
    for enc in (named and named[1], own and own[1].decode("ascii", "ignore"), "utf-8", "cp1252"):
        if enc:
            try:
                return raw.decode(enc), enc.lower()
            except (LookupError, UnicodeDecodeError):
                pass
    return raw.decode("utf-8", "replace"), "utf-8"


def decoded(files: DataFrame) -> DataFrame:
    """(path, html, encoding, digest) of files (path, content) with an optional content_type."""
    src = files.select("path", "content", (F.col("content_type") if "content_type" in files.columns else F.lit(None).cast("string")).alias("content_type"), F.sha2("content", 256).alias("digest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decode(c, t) for c, t in zip(b.column("content").to_pylist(), b.column("content_type").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), b.column("digest")], names=["path", "html", "encoding", "digest"])

    return src.mapInArrow(run, "path string, html string, encoding string, digest string")


def html_files(spark: SparkSession, folder: str) -> DataFrame:
    return decoded(binary_files(spark, folder, "*.{html,htm,HTML,HTM}"))


def work_list(spark: SparkSession, path: str) -> DataFrame:
    """(list_id, line_no, value) of text files; line numbers count from 1 within each file."""
    t = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("list_id"), F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "value"))
    return t.withColumn("line_no", F.col("line_no") + 1)


def front_matter(markdown: DataFrame) -> DataFrame:
    """(path, fields): the leading --- block of Markdown files (path, value) as a map; repeated keys keep the first."""
    block = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    pairs = F.filter(F.split(block, r"\r?\n"), lambda x: x.rlike("^[a-z0-9_]+:"))
    entries = F.transform(pairs, lambda x: F.struct(F.regexp_extract(x, "^([a-z0-9_]+):", 1).alias("key"), tx.yaml_unquoted(F.regexp_replace(x, r"^[a-z0-9_]+:\s*", "")).alias("value")))
    # the first of equal keys: later ones are dropped by their place
    keys = F.transform(entries, lambda e: e["key"])
    once = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return markdown.select("path", F.map_from_entries(once).alias("fields"))


def done_keys(markdown: DataFrame) -> DataFrame:
    """(key): every address and path that earlier Markdown outputs came from."""
    f = front_matter(markdown)
    keys = F.array(*[F.try_element_at("fields", F.lit(k)) for k in ("source_url", "requested_url", "source_path", "sha256")])
    return f.select(F.explode(keys).alias("key")).filter(F.col("key").isNotNull() & (F.col("key") != "")).distinct()
