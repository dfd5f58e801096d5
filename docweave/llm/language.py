"""Problem 6: language of records and of their stretches, by compression with a dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import join_sized, stored

# The languages, and the ways labels write them.
LANGUAGES = ("de", "en", "es", "fr", "it", "pt")
ALIASES = {
    "spa": "es", "esp": "es", "español": "es", "espanol": "es", "castellano": "es", "spanish": "es", "cas": "es", "eng": "en", "english": "en", "inglés": "en", "ingles": "en", "fra": "fr", "fre": "fr", "français": "fr", "francais": "fr", "french": "fr", "francés": "fr",
    "por": "pt", "português": "pt", "portugues": "pt", "portuguese": "pt", "portugués": "pt", "deu": "de", "ger": "de", "deutsch": "de", "german": "de", "alemán": "de", "ita": "it", "italiano": "it", "italian": "it",
}
#: Paragraphs a language's dictionary is made of, at most, and its bytes: the bounded labelled sample of the classifier.
SAMPLE_PARAGRAPHS, DICTIONARY_BYTES = 400, 110_000
#: Compression level; characters from which a paragraph is judged alone; margin (share of the smallest size) to accept.
LEVEL, MIN_CHARS, MARGIN = 3, 60, 0.03


def label_of(idioma: Column) -> Column:
    """The language a label names, however written: ES, spa, es_MX and es-ES are es. Null for null, blank, und; other
    labels are kept in lower case."""
    s = F.regexp_replace(F.lower(F.trim(idioma)), r"[-_].*$", "")
    pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
    mapped = F.try_element_at(F.create_map(*pairs), s)
    return F.when((s == "") | s.isin("und", "unknown", "null", "none", "xx", "mul", "zxx"), F.lit(None).cast("string")).otherwise(F.coalesce(mapped, s))


def language_samples(paragraphs: DataFrame, labels: DataFrame, common_words: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content per language from a bounded sample: of each language at most SAMPLE_PARAGRAPHS
    paragraphs, least by hash of their text, whose record bears the label and whose frequent words agree with it."""
    words: dict[str, set[str]] = {x: set() for x in LANGUAGES}
    for r in common_words.select("lang", "word").collect():
        if r.lang in words and r.word:
            words[r.lang].add(r.word.lower())
    votes = [F.expr(f"regexp_count(lower(text), '{_own(words, x)}')").alias(x) for x in LANGUAGES]
    p = paragraphs.filter(F.length("text") >= MIN_CHARS).select("kind", "id", "text", F.xxhash64("text").alias("h"))
    # a first, wider choice by hash keeps the counting of words to the sample; up to 1000 rows a label the limit is
    # applied before the shuffle, so no task holds the paragraphs of a language
    p = join_sized(p, labels.filter(F.col("label").isin(*LANGUAGES)), ["kind", "id"])
    wide = p.withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy("h", "text"))).filter(F.col("rn") <= 2 * SAMPLE_PARAGRAPHS)
    counted = wide.select("label", "h", "text", *votes)
    best = F.greatest(*[F.col(x) for x in LANGUAGES])
    agree = F.coalesce(*[F.when(F.col("label") == x, F.col(x)) for x in LANGUAGES])
    rows = counted.filter((agree == best) & (best >= 3)).withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy("h", "text"))).filter(F.col("rn") <= SAMPLE_PARAGRAPHS).select("label", "text").collect()
    out = {x: " ".join(sorted(words[x])).encode() for x in LANGUAGES}
    for r in rows:
        if len(out[r.label]) < DICTIONARY_BYTES:
            out[r.label] += b"\n" + r.text.lower().encode("utf-8", "replace")
    return {x: d[:DICTIONARY_BYTES] for x, d in out.items()}


def _own(words: dict[str, set[str]], lang: str) -> str:
    """Pattern of the frequent words only this language has."""
    own = sorted(words[lang] - set().union(*(w for x, w in words.items() if x != lang)))
    return "\\\\b(" + "|".join(re.escape(w).replace("'", "''") for w in own or ["\x01"]) + ")\\\\b"


def compressed_sizes(paragraphs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """(kind, id, pos, n, sizes, lang, margin): bytes of each whole paragraph under each language's dictionary, the
    language with the smallest, and by what share the next one is larger. lang is null for narrow margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd

        coders = []
        for x in LANGUAGES:
            d = zstd.ZstdCompressionDict(samples[x], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        for b in batches:
            n, sizes, langs, margins = [], [], [], []
            for t in b.column("text").to_pylist():
                raw = t.lower().encode("utf-8", "replace")
                s = [len(c.compress(raw)) for c in coders]
                order = sorted(range(len(s)), key=s.__getitem__)
                margin = (s[order[1]] - s[order[0]]) / s[order[0]]
                n.append(len(t))
                sizes.append(s)
                langs.append(LANGUAGES[order[0]] if margin >= MARGIN else None)
                margins.append(margin)
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("id"), b.column("pos"), pa.array(n, pa.int32()), pa.array(sizes, pa.list_(pa.int32())), pa.array(langs, pa.string()), pa.array(margins, pa.float64())], names=["kind", "id", "pos", "n", "sizes", "lang", "margin"])

    return paragraphs.select("kind", "id", "pos", "text").mapInArrow(run, "kind string, id bigint, pos bigint, n int, sizes array<int>, lang string, margin double")


def record_languages(sized: DataFrame) -> DataFrame:
    """(kind, id, main, confidence, langs): main language by the summed sizes of all paragraphs of a record, and the
    languages of whole paragraphs that differ from it by a wide margin. langs holds main first if it is known."""
    sums = [F.sum(F.col("sizes")[i]).alias(x) for i, x in enumerate(LANGUAGES)]
    alone = sized.filter((F.col("n") >= MIN_CHARS) & F.col("lang").isNotNull())
    by = sized.groupBy("kind", "id").agg(*sums)
    least = F.least(*[F.col(x) for x in LANGUAGES])
    main = F.coalesce(*[F.when(F.col(x) == least, F.lit(x)) for x in LANGUAGES])
    order = F.array_sort(F.array(*[F.col(x) for x in LANGUAGES]))
    share = (order[1] - order[0]) / order[0]
    by = by.select("kind", "id", main.alias("main"), share.alias("margin"))
    own = alone.groupBy("kind", "id").agg(F.collect_set("lang").alias("alone"))
    x = by.join(own, ["kind", "id"], "left")
    # a narrow total (two languages in equal parts) takes the first language found alone
    main = F.when(F.col("margin") >= MARGIN / 2, F.col("main")).otherwise(F.coalesce(F.get(F.array_sort("alone"), 0), F.col("main")))
    x = x.withColumn("main", main)
    return x.select("kind", "id", "main", F.round(1 - F.exp(F.col("margin") * -20), 4).alias("confidence"), F.array_distinct(F.concat(F.array("main"), F.coalesce("alone", F.array().cast("array<string>")))).alias("langs"))


def segments(sized: DataFrame) -> DataFrame:
    """(kind, id, first, last, lang, confidence): stretches of neighbouring paragraphs in one language; paragraphs
    with a narrow margin or too short to tell go with the one before."""
    w = W.partitionBy("kind", "id").orderBy("pos")
    told = F.when((F.col("n") >= MIN_CHARS), F.col("lang"))
    x = sized.withColumn("told", F.coalesce(F.last(told, True).over(w), F.first(told, True).over(w.rowsBetween(0, W.unboundedFollowing))))
    x = x.filter(F.col("told").isNotNull()).withColumn("turn", F.when(F.lag("told").over(w) == F.col("told"), 0).otherwise(1))
    x = x.withColumn("seg", F.sum("turn").over(w))
    return x.groupBy("kind", "id", "seg", F.col("told").alias("lang")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.round(1 - F.exp(F.avg("margin") * -20), 4).alias("confidence")).drop("seg")


def bad_labels(sized: DataFrame, labels: DataFrame) -> DataFrame:
    """(record_kind, record_id, lang): records with a missing or wrong label or several languages, a row a language.

    ``labels`` (kind, id, label) has a row per record; records without text have no row."""
    x = record_languages(sized).join(labels, ["kind", "id"], "left")
    case = F.col("label").isNull() | (F.col("label") != F.col("main")) | (F.size("langs") > 1)
    return x.filter(case).select(F.col("kind").alias("record_kind"), F.col("id").alias("record_id"), F.explode("langs").alias("lang"))


def record_paragraphs(web_in: DataFrame, layout: DataFrame, page_text: DataFrame, pdf_meta: DataFrame, common_words: DataFrame) -> DataFrame:
    """Stored (kind, id, pos, text): running text of articles and of document bodies, each paragraph once; headings,
    list entries, cells and captions only where a record has nothing else."""
    from . import residue, scanned, web

    blocks = residue.real_articles(web.parsed_pages(web_in, common_words))
    w = blocks.select(F.lit("web").alias("kind"), F.col("page_id").alias("id"), F.col("pos").cast("long").alias("pos"), F.col("t").alias("text"), web.flag(web.PROSE).alias("prose")).dropDuplicates(["id", "pos"])
    linked = scanned.with_running(scanned.pages(layout, page_text, pdf_meta))
    p = scanned.paragraphs_of(linked)
    p = p.select(F.lit("pdf").alias("kind"), F.col("doc_id").alias("id"), (F.col("page_num") * F.lit(1_000_000).cast("long") + F.col("block_no")).alias("pos"), "text", ((F.length("text") >= MIN_CHARS) & ~F.col("text").rlike(r"^\s*[•◦–▪-]")).alias("prose"))
    both = stored(w.unionByName(p), "paragraphs")
    some = stored(both.filter("prose").select("kind", "id").distinct().withColumn("some", F.lit(True)), "prose")
    return join_sized(both, some, ["kind", "id"], "left").filter(F.col("prose") | F.col("some").isNull()).select("kind", "id", "pos", "text")


def record_labels(web_meta: DataFrame, pdf_meta: DataFrame) -> DataFrame:
    """Stored (kind, id, label), a row per record; of differing rows the first label in order counts."""
    w = web_meta.groupBy(F.lit("web").alias("kind"), F.col("page_id").alias("id")).agg(F.min(label_of(F.col("idioma"))).alias("label"))
    p = pdf_meta.groupBy(F.lit("pdf").alias("kind"), F.col("doc_id").alias("id")).agg(F.min(label_of(F.col("idioma"))).alias("label"))
    return stored(w.unionByName(p), "labels")


