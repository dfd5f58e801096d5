"""Front matter of converted documents, the state of a conversion, and the notice before thin pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx

# The notice that stands before the text of a thin page.
NOTICE = (
    "> **AVISO DE CONVERSION:** de esta pagina se ha extraido muy poco texto. Suele\n> significar que el contenido se pinta con JavaScript, que hay un muro de pago\n"
    "> o que se ha servido un aviso de cookies en lugar del articulo. Verificar\n> contra el original antes de darla por convertida."
)


def block(rows: list[Column]) -> Column:
    """The rows that are not null between two marks, a line each."""
    return F.array_join(F.array_compact(F.array(F.lit("---"), *rows, F.lit("---"))), "\n")


def quoted(name: str, value: Column) -> Column:
    """A row of a quoted value; null for a null or empty one."""
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{name}: "), tx.yaml_quoted(value)))


def plain(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def document_rows(suppressed: bool = False) -> list[Column]:
    """Rows for a laid-out document with title, author, page_count, filename, url_origen, fecha_archivo, sha256_pdf,
    idioma, chars, chars_per_page, capa_texto, ocr_motor, links and, if wanted, lineas_suprimidas, in the order of the
    contract. A missing title is the file's name; an address that is not known is said to be none."""
    c = F.col
    known = c("url_origen").isNotNull() & (c("url_origen") != "")
    lines = F.when(F.size(F.coalesce("lineas_suprimidas", F.array().cast("array<string>"))) > 0, F.concat(F.lit("lineas_suprimidas: "), tx.yaml_list(c("lineas_suprimidas")))) if suppressed else F.lit(None).cast("string")
    stem = F.regexp_replace(F.coalesce("filename", F.lit("")), r"\.[^.]*$", "")
    return [
        F.concat(F.lit("title: "), tx.yaml_quoted(F.when(c("title").isNull() | (c("title") == ""), stem).otherwise(c("title")))), quoted("author", c("author")), F.when(c("page_count") > 0, plain("pages", c("page_count"))),
        F.concat(F.lit("source_file: "), tx.yaml_quoted(F.coalesce("filename", F.lit("")))), quoted("url_origen", c("url_origen")), quoted("fecha_archivo", c("fecha_archivo")), quoted("sha256_pdf", c("sha256_pdf")),
        F.when(~F.coalesce(known, F.lit(False)), F.lit("url_origen: null")), quoted("idioma", c("idioma")), plain("chars_extraidos", c("chars")), plain("chars_por_pagina", c("chars_per_page")),
        F.concat(F.lit("capa_texto: "), tx.yaml_quoted(F.coalesce(F.nullif(c("capa_texto"), F.lit("")), F.lit("nativa")))), F.coalesce(quoted("ocr_motor", c("ocr_motor")), F.lit("ocr_motor: null")), plain("enlaces", c("links")), lines,
    ]


def conversion_state(layer: Column) -> Column:
    """ok, escaso or fallo, by the text layer a document is said to have."""
    return F.when(layer == "escasa", "escaso").when(layer.isin("ausente", "error", "fallo"), "fallo").otherwise("ok")


def stamp(at: Column) -> Column:
    """A moment as ``2024-01-31 12:00:00``."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def with_notice(markdown: Column, content: Column, reason: Column, alternative: Column) -> Column:
    """Markdown of a page after the notice that it is thin, with the reason and a saved page where they are known."""
    known = F.concat_ws(" ", F.when(reason != "", F.concat(F.lit("**Motivo detectado:** "), reason, F.lit("."))), F.when(alternative != "", F.concat(F.lit("**Alternativa local disponible:** `"), alternative, F.lit("`."))))
    notice = F.concat(F.lit(NOTICE), F.when(known != "", F.concat(F.lit("\n> "), known)).otherwise(""))
    return F.when(content != "complete", tx.strip(F.concat(notice, F.lit("\n\n"), markdown))).otherwise(markdown)
