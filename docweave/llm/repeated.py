"""Problem 5: lines that recur excessively within one source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import join_sized, stored

#: Lines with fewer letters never count; the rule that makes a line excessive; the false-discovery level.
MIN_LETTERS, MIN_DOCS, MIN_SHARE, FDR = 8, 3, 0.10, 0.05
#: Bins per unit of the likelihood ratio over which the significance threshold is searched, and its largest value.
BINS, TOP = 20, 400


def site_key(sitio: Column) -> Column:
    """Lower-case site name without leading ``www.``; null where blank."""
    s = F.regexp_replace(F.lower(F.trim(sitio)), r"^www\.", "")
    return F.when(s != "", s)


def _keys(text: Column) -> Column:
    """One hash per line, null for lines of fewer than MIN_LETTERS letters. Lines equal in their letters are equal."""
    letters = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\n]+", ""), "\n", -1)
    return F.transform(letters, lambda x: F.when(F.length(x) >= MIN_LETTERS, F.xxhash64(x)))


def keyed_documents(documents: DataFrame) -> DataFrame:
    """Stored (doc_id, site, keys, extra): line hashes of text in order, and those of lines taken out before.

    Documents without site are left out; null text or lists count as empty; doc_id is unique."""
    d = documents.select("doc_id", site_key(F.col("sitio")).alias("site"), F.col("text"), "lineas_suprimidas").filter(F.col("site").isNotNull())
    joined = F.array_join(F.transform("lineas_suprimidas", lambda x: F.regexp_replace(x, "\n", " ")), "\n")
    return stored(d.select("doc_id", "site", _keys(F.coalesce("text", F.lit(""))).alias("keys"), _keys(F.coalesce(joined, F.lit(""))).alias("extra")), "lines")


def _likelihood_ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Signed G: twice the log-likelihood ratio of two rates against one common rate; negative below the outside rate."""

    def part(k: Column, n: Column, p: Column) -> Column:
        return F.when(k > 0, k * F.log(k / n / p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log((n - k) / n / (1 - p))).otherwise(0.0)

    p = (k1 + k2) / (n1 + n2)
    g = F.when(p >= 1, 0.0).otherwise(2 * (part(k1, n1, p) + F.when(n2 > 0, part(k2, n2, p)).otherwise(0.0)))
    return F.when(k1 * n2 >= k2 * n1, g).otherwise(-g)


def excess_threshold(tests: DataFrame, level: float = FDR) -> float:
    """Smallest likelihood ratio that the Benjamini-Hochberg rule accepts, from a histogram of bounded size."""
    bins = tests.groupBy(F.floor(F.least(F.greatest("g", F.lit(0.0)), F.lit(float(TOP))) * BINS).alias("bin")).agg(F.count("*").alias("n")).collect()
    total, above, best = sum(r.n for r in bins), 0, float("inf")
    for r in sorted(bins, key=lambda r: -r.bin):
        above += r.n
        g = r.bin / BINS
        if math.erfc(math.sqrt(g / 2)) / 2 <= level * above / total:
            best = g
    return best


def site_lines(keyed: DataFrame) -> DataFrame:
    """(site, key, k, n, others, outside, g): documents of the site with the line, documents of the site, the same
    outside, and the signed likelihood ratio, for lines of at least MIN_DOCS documents.

    Outside are the documents of the sites in which the line itself stays under MIN_SHARE: a notice that many
    sites print must not make the rate of each seem ordinary."""
    per_doc = keyed.select("site", F.explode(F.filter(F.array_distinct(F.concat("keys", "extra")), lambda x: x.isNotNull())).alias("key"))
    per_site = stored(per_doc.groupBy("site", "key").agg(F.count("*").alias("k")), "site-lines")
    sizes = stored(keyed.groupBy("site").agg(F.count("*").alias("n")), "sites")
    total = F.lit(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    tested = stored(per_site.filter(F.col("k") >= MIN_DOCS).select("key").distinct(), "tested")
    rates = join_sized(join_sized(per_site, tested, ["key"], "left_semi"), sizes, ["site"])
    heavy = F.col("k") >= MIN_SHARE * F.col("n")
    overall = rates.groupBy("key").agg(
        F.sum(F.when(~heavy, F.col("k")).otherwise(0)).alias("k_rest"), F.sum(F.when(heavy, F.col("n")).otherwise(0)).alias("n_heavy")
    )
    t = rates.filter(F.col("k") >= MIN_DOCS).join(overall, "key")
    k2 = F.col("k_rest") - F.when(~heavy, F.col("k")).otherwise(0)
    n2 = total - F.col("n_heavy") - F.when(~heavy, F.col("n")).otherwise(0)
    # prior: as many documents without the line as the site has, so a line frequent in every site is still told from none
    t = t.withColumn("others", k2).withColumn("outside", n2 + F.col("n"))
    return t.select("site", "key", "k", "n", "others", "outside", _likelihood_ratio(F.col("k"), F.col("n"), F.col("others"), F.col("outside")).alias("g"))


def excessive_lines(keyed: DataFrame, level: float = FDR) -> DataFrame:
    """(site, key) of lines with significant excess that also meet MIN_DOCS and MIN_SHARE exactly."""
    tests = stored(site_lines(keyed), "tests")
    return tests.filter((F.col("g") >= excess_threshold(tests, level)) & (F.col("k") >= MIN_SHARE * F.col("n"))).select("site", "key")


def repeated_lines(documents: DataFrame, level: float = FDR) -> DataFrame:
    """(doc_id, line_no): every occurrence in text of a line that recurs excessively in its site. Lines count from 1."""
    keyed = keyed_documents(documents)
    bad = stored(excessive_lines(keyed, level), "excess")
    lines = keyed.select("doc_id", "site", F.posexplode("keys").alias("pos", "key")).filter(F.col("key").isNotNull())
    return join_sized(lines, bad, ["site", "key"], "left_semi").select("doc_id", (F.col("pos") + 1).cast("int").alias("line_no"))


def without_repeated_lines(documents: DataFrame, level: float = FDR) -> DataFrame:
    """documents with ``text`` reassembled by position from the lines kept, and ``removed``, the number of the others.

    Lines stand apart by document and position; an anti-join drops those that recur excessively, and what is left comes
    together again in order. Only documents that lose a line are taken apart. Documents without site, or without such
    lines, keep their text; null text stays null; other columns pass through. doc_id is unique."""
    drop = stored(repeated_lines(documents, level), "excess-lines")
    hit = stored(drop.groupBy("doc_id").agg(F.count("*").cast("int").alias("removed")), "hit")
    touched = join_sized(documents.select("doc_id", "text"), hit.select("doc_id"), ["doc_id"], "left_semi")
    lines = touched.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    kept = lines.join(drop.select("doc_id", (F.col("line_no") - 1).alias("pos")), ["doc_id", "pos"], "left_anti")
    again = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("__lines"))
    x = documents.join(hit.withColumnRenamed("removed", "__removed"), "doc_id", "left").join(again, "doc_id", "left")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.coalesce(F.array_join(F.transform("__lines", lambda x: x["line"]), "\n"), F.lit("")))
    return x.withColumn("text", text).withColumn("removed", F.coalesce("__removed", F.lit(0))).drop("__removed", "__lines")
