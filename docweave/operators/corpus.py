"""Corpus operations: exact copies, names, resuming, guards, manifests, collection plans, work lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import web as wb
from ..storage import stored


def exact_copies(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """``rows`` with ``digest`` (null for null content), ``copy_no`` from 1 in ``order`` and ``first_id``, the first row
    of the same content. Only the digests are shuffled with the ids, by pre-aggregated first row, so a content that
    fills a third of the rows does not gather its rows in one task."""
    d = rows.withColumn("digest", F.sha2(key, 256))
    first = d.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("copies"))
    return d.join(first, "digest", "left")


def size_candidates(rows: DataFrame, size: str) -> DataFrame:
    """Rows whose size another row shares, worth hashing; nulls are not."""
    often = rows.filter(F.col(size).isNotNull()).groupBy(size).agg(F.count("*").alias("same")).filter("same > 1")
    return rows.join(often, size)


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``, the place of a row among those of its ``key`` in ``order``, from 1.

    Rows are put in ranges of key and order, so that a frequent key spans several; each range is numbered alone and
    moved up by what the ranges before it hold of the key."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = stored(rows.repartitionByRange(parts, key, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = x.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    before = W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    base = sums.select(F.col(key).alias("__key"), F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    x = x.withColumn("__turn", F.row_number().over(W.partitionBy(key, "__part").orderBy(*order)))
    x = x.join(base, x[key].eqNullSafe(base["__key"]) & (x["__part"] == base["__at"]))
    return x.withColumn(name, (F.col("__base") + F.col("__turn")).cast("int")).drop("__part", "__key", "__at", "__base", "__turn")


def unique_names(rows: DataFrame, base: str, order: list[str], suffix: str, separator: str = "_") -> DataFrame:
    """Adds ``name``: base and suffix, the n-th row of one base (compared in lower case) with separator and n.

    A made-up name that is another row's natural one is numbered on in a second pass, past all numbers in use."""
    d = numbered(rows.withColumn("__low", F.lower(F.col(base))), "__low", order, "__n")
    made = F.when(F.col("__n") > 1, F.concat(F.col(base), F.lit(separator), F.col("__n").cast("string"))).otherwise(F.col(base))
    d = d.withColumn("__made", made)
    totals = d.groupBy("__low").agg(F.max("__n").alias("__total"))
    # names that are made up and also natural ones of another row
    taken = totals.select(F.col("__low").alias("__taken"))
    again = d.filter("__n > 1").join(taken, F.lower("__made") == F.col("__taken"), "left_semi").join(totals, "__low")
    d = d.join(taken, (F.lower("__made") == F.col("__taken")) & (F.col("__n") > 1), "left").filter(F.col("__taken").isNull()).withColumn("name", F.concat("__made", F.lit(suffix)))
    # past every number the base has used, in order, so no third name arises
    again = numbered(again, "__low", order, "__k").withColumn("name", F.concat(F.col(base), F.lit(separator), (F.col("__total") + F.col("__k")).cast("string"), F.lit(separator), F.lit("b" + suffix)))
    names = d.drop("__low", "__n", "__made", "__taken")
    return names.unionByName(again.select(*names.columns))


def still_to_do(batch: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` none of whose keys stands among the ``key`` values of ``done``; null keys match nothing."""
    known = done.select(F.col("key").alias("__key")).filter(F.col("__key").isNotNull()).distinct()
    for k in keys:
        batch = batch.join(known, batch[k] == known["__key"], "left_anti")
    return batch


def guarded(new: DataFrame, old: DataFrame, on: str) -> DataFrame:
    """New results with ``keep_old``: thin ones where the older output holds more characters."""
    o = old.select(on, F.col("n_chars").alias("old_chars"))
    thin = wb.content_class(F.col("n_chars")) != "complete"
    return new.join(o, on, "left").withColumn("keep_old", F.coalesce(thin & (F.col("old_chars") > F.col("n_chars")), F.lit(False)))


def collection_plan(files: DataFrame, existing: DataFrame) -> DataFrame:
    """Files (path, folder, name, length, digest) with the state of each: empty, not_pdf, duplicate, present or pending.

    Of equal contents the first by path is taken, later ones name it; a file of the same content at the target
    (existing: target, digest) is present."""
    valid = (F.col("length") > 0) & F.lower("name").rlike(r"\.pdf$") & F.col("digest").isNotNull()
    first = files.filter(valid).groupBy("digest").agg(F.min("path").alias("first_path"))
    d = files.join(first, "digest", "left").withColumn("target", F.concat_ws("__", "folder", "name"))
    e = existing.select("target", F.col("digest").alias("there"))
    d = d.join(e, "target", "left")
    state = F.when(F.col("length") == 0, "empty").when(~valid, "not_pdf").when(F.col("path") != F.col("first_path"), "duplicate").when(F.col("there") == F.col("digest"), "present").otherwise("pending")
    note = F.when(state == "duplicate", F.concat(F.lit("same as "), F.col("first_path"))).otherwise("")
    return d.select("path", "target", "length", state.alias("state"), note.alias("note"))


def collection_summary(plan: DataFrame) -> DataFrame:
    def n(*states: str) -> Column:
        return F.count_if(F.col("state").isin(*states))

    return plan.agg(n("pending", "present", "duplicate").alias("found"), n("duplicate").alias("duplicates"), n("present").alias("present"), n("pending").alias("pending"), n("empty", "not_pdf").alias("incidents"))


# What a heading begins with that titles the list and no section, and rows that only name columns.
LIST_TITLES = ("urls de", "dossier", "indice", "índice", "lista de", "contenido", "fuentes de", "listado de")
COLUMN_ROWS = (
    "url doc_id", "url id", "url nombre", "url archivo", "ruta url", "archivo url", "origen url", "origen doc_id", "ruta doc_id", "ruta url doc_id",
)
CAPTURE = "[CAPTURA LOCAL]"


def normal_path(path: Column, base: str = "") -> Column:
    """A path under ``base`` without ``.``, double slashes and, where something is before it, ``..``; an absolute path
    stays one."""
    full = F.when(path.startswith("/") | F.lit(base == ""), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))

    def step(a: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != "..")
        return F.when(p.isin("", "."), a).when(up, F.slice(a, 1, F.size(a) - 1)).when((p == "..") & full.startswith("/"), a).otherwise(F.concat(a, F.array(p)))

    out = F.array_join(F.aggregate(F.split(full, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(full.startswith("/"), F.concat(F.lit("/"), out)).when(out == "", ".").otherwise(out)


def work_items(lines: DataFrame, list_id: str = "list_id", base: str = "") -> DataFrame:
    """Lines (list_id, line_no, value) of work lists as items (list_id, line_no, section, kind, origin, declared_url,
    out_name): addresses (url) and saved pages (local), a row each.

    A heading sets the section up to the next one, cut at a dash; the first heading of the first level before any item
    and headings like ``Lista de`` title the list and set none. Rows bear a page, an address and a name for the output in
    several orders, divided by ;, | or tab; rows of column names are none. A row marked as local capture is a page.
    Other lines give each address in them, without a comment after `` # ``, or else the page that they name."""
    v = tx.strip(F.col("value"))
    head = tx.strip(F.regexp_replace(tx.strip(F.regexp_replace(v, "^#+", "")), "(?s)[—–].*$| - .*$", ""))
    level = F.length(F.regexp_extract(v, "^(#+)", 1))
    title = reduce(lambda a, b: a | b, (F.lower(head).startswith(t) for t in LIST_TITLES))

    def bare(c: Column) -> Column:
        return F.regexp_replace(tx.strip(c), "^[`'\"]+|[`'\"]+$", "")

    cells = F.transform(F.filter(F.split(v, r"\s*[;|\t]\s*"), lambda c: tx.strip(c) != ""), bare)
    a, b, c = (F.get(cells, i) for i in range(3))

    def page(x: Column) -> Column:
        return F.coalesce(F.lower(x).rlike(r"\.html?$") & ~wb.is_url(x), F.lit(False))

    def url(x: Column) -> Column:
        return F.coalesce(wb.is_url(x), F.lit(False))

    def name(x: Column) -> Column:
        return F.coalesce(x.rlike(r"^[A-Za-z0-9_.-]+$") & ~url(x) & ~page(x), F.lit(False))

    def item(kind: str, origin: Column, declared: Column | None = None, out: Column | None = None) -> Column:
        none = F.lit("")
        return F.array(F.struct(F.lit(kind).alias("kind"), origin.alias("origin"), (none if declared is None else declared).alias("declared_url"), (none if out is None else out).alias("out_name")))

    two, three = F.size(cells) == 2, F.size(cells) == 3
    divided = v.rlike("[;|\t]")
    # the rest: without the empty cells at the end and a comment
    rest = tx.strip(F.regexp_replace(F.regexp_replace(v, "[ ;|\t]+$", ""), r"(?s)\s+#\s+.*$", ""))
    urls = F.filter(F.transform(F.regexp_extract_all(rest, F.lit("https?://[^\\s><\"';|]+"), F.lit(0)), clean_address), lambda u: u != "")
    own = bare(F.regexp_replace(rest, "(?s)#.*$", ""))
    captured = tx.strip(F.substring_index(v, CAPTURE, -1))
    nothing = F.array().cast("array<struct<kind:string,origin:string,declared_url:string,out_name:string>>")
    items = (
        F.when((v == "") | v.startswith("#"), nothing)
        .when(v.contains(CAPTURE), item("local", normal_path(F.regexp_replace(captured, "^[`'\"]+|[`'\"]+$", ""), base), captured))
        .when(F.lower(F.array_join(cells, " ")).isin(*COLUMN_ROWS), nothing)
        .when(divided & three & page(a) & url(b), item("local", normal_path(a, base), clean_address(b), c))
        .when(divided & three & url(a) & page(b), item("local", normal_path(b, base), clean_address(a), c))
        .when(divided & two & page(a) & url(b), item("local", normal_path(a, base), clean_address(b)))
        .when(divided & two & url(a) & page(b), item("local", normal_path(b, base), clean_address(a)))
        .when(divided & two & url(a) & name(b), item("url", clean_address(a), out=b))
        .when(divided & two & url(b) & name(a), item("url", clean_address(b), out=a))
        .when(divided & two & page(a) & F.coalesce(b.rlike(r"^[A-Za-z0-9_.-]+$"), F.lit(False)), item("local", normal_path(a, base), out=b))
        .when(rest.rlike("https?://[^\\s><\"';|]"), F.transform(urls, lambda u: F.struct(F.lit("url").alias("kind"), u.alias("origin"), F.lit("").alias("declared_url"), F.lit("").alias("out_name"))))
        .when(F.lower(rest).rlike(r"\.html?$") & (own != ""), item("local", normal_path(own, base)))
        .otherwise(nothing)
    )
    w = W.partitionBy(list_id).orderBy("line_no")
    x = lines.withColumn("__items", items)
    earlier = F.coalesce(F.sum(F.size("__items")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    section = F.when(v.startswith("#") & ~title & (head != "") & ~((level == 1) & (earlier == 0)), head)
    x = x.withColumn("__section", section)
    x = x.withColumn("section", F.coalesce(F.last("__section", True).over(w), F.lit("")))
    return x.select(list_id, "line_no", "section", F.explode("__items").alias("x")).select(list_id, "line_no", "section", "x.*")


def manifest_summary(rows: DataFrame, group: str) -> DataFrame:
    """(group, items, complete, scarce, absent, chars) of a web manifest with n_chars, a row per section."""
    c = wb.content_class(F.col("n_chars"))
    return rows.groupBy(F.coalesce(F.col(group), F.lit("General")).alias(group)).agg(F.count("*").alias("items"), F.count_if(c == "complete").alias("complete"), F.count_if(c == "scarce").alias("scarce"), F.count_if(c == "absent").alias("absent"), F.sum("n_chars").alias("chars"))


def local_alternatives(thin: DataFrame, files: DataFrame) -> DataFrame:
    """Thin outputs (name, folder) with ``alternative``: a saved page (path) of the same base name in the folder, the
    one above it or the html folder beside it, in this order; of several in one place the first by path."""
    f = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("__dir"), F.lower(F.regexp_extract("path", r"([^/]+)\.html?$", 1)).alias("__base")).filter(F.col("__base") != "")
    up = F.regexp_extract("folder", r"^(.*)/[^/]*$", 1)
    t = thin.withColumn("__base", F.lower(F.regexp_replace("name", r"\.[^.]+$", ""))).withColumn("__places", F.array(F.col("folder"), up, F.concat(up, F.lit("/html"))))
    best = t.join(f, "__base").withColumn("__rank", F.array_position("__places", F.col("__dir"))).filter("__rank > 0").groupBy("folder", "name").agg(F.min_by("path", F.struct("__rank", "path")).alias("alternative"))
    return thin.join(best, ["folder", "name"], "left")


def to_repeat(manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """Manifest rows (name, layer) whose output was made without a text layer and exists: to be made again with recognition."""
    return manifest.filter(F.col("layer") == "absent").join(outputs.select("name").distinct(), "name")


def clean_address(c: Column) -> Column:
    """An address without trailing punctuation and without closing parentheses that open nowhere in it."""

    def cut(x: Column) -> Column:
        return F.regexp_replace(x, r"[.,;:]+$", "")

    def count(x: Column, sign: str) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))

    s = cut(tx.strip(c))
    return F.aggregate(F.sequence(F.lit(1), count(s, ")") + 1), s, lambda x, _: F.when(x.endswith(")") & (count(x, ")") > count(x, "(")), cut(F.substring(x, F.lit(1), F.length(x) - 1))).otherwise(x))


def queue_summary(rows: DataFrame) -> DataFrame:
    """(state, items, chars) of a queue of rows (state, n_chars), null states as waiting."""
    return rows.groupBy(F.coalesce("state", F.lit("waiting")).alias("state")).agg(F.count("*").alias("items"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
