"""Problem 7: pages whose main area holds template residue, filler or an error message instead of an article.

No list of messages decides. Each page is described by how its address, title and body agree, by how much is said in it
compared with the host's other pages, by blocks and titles that other addresses and hosts have too, by placeholders,
and by its status; two classes of pages are told apart by expectation-maximization over the counted patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import join_sized, stored
from .web import AGREE, FEW_IDS, HEAD, MARK, Rules, flag

#: A block of at most so many letters that stands under so many distinct titles is a repeated message.
SHORT_LETTERS, DUPLICATE_TITLES = 120, 3
#: A title that so many hosts have is a general one.
TITLE_HOSTS = 3
#: Pages a host has at least for its own typical size to count, and the least share of the typical size of all pages.
HOST_PAGES, HOST_SHARE = 5, 0.25
#: Share of a page's letters that makes it repeated or placeholder; shares of the host's typical size that bound the
#: levels of information.
MOST, INFORMATION = 0.5, (1 / 16, 1 / 10, 1 / 4)

#: Evidence of a page, with the shares of its levels that expectation-maximization starts at, among pages without an
#: article and among articles. information: letters of distinct blocks that are no placeholder and not repeated,
#: against the host's typical page; agreement: the title is its own, on many hosts, or only the host's name (by two), and
#: some term of title and address is in the body or none is (odd), in one as short titles do both; repeated,
#: placeholder: most of the body; status: 400 and more.
EVIDENCE = {
    "information": ((0.930, 0.068, 0.001, 0.001), (0.002, 0.010, 0.060, 0.928)),
    "agreement": ((0.06, 0.24, 0.08, 0.32, 0.06, 0.24), (0.800, 0.140, 0.035, 0.015, 0.007, 0.003)),
    "repeated": ((0.50, 0.50), (0.96, 0.04)),
    "placeholder": ((0.60, 0.40), (0.999, 0.001)),
    "status": ((0.60, 0.40), (0.97, 0.03)),
}
#: Evidence whose shares among pages without an article define that class and are not learned.
ANCHOR = "information"
#: Share of pages without an article at first; pages that the shares above weigh; rounds; posterior to be found.
START, PRIOR_PAGES, ROUNDS, LEAST = 0.05, 20.0, 20, 0.5


def page_evidence(blocks: DataFrame) -> DataFrame:
    """Stored (page_id and the columns of EVIDENCE), a row per page of article blocks (:meth:`web.Rules.blocks`, with or
    without text); pages delivered twice count once. A null status is none; a page without body text has no information
    and does not agree."""
    about = [F.max(c).alias(c) for c in ("host", "tk", "status")]
    b = blocks.select("page_id", "pos", "host", "tk", "status", "f", "k", "n").repartition("page_id")
    b = b.groupBy("page_id", "pos").agg(*about, *[F.max(c).alias(c) for c in ("f", "k", "n")])
    letters = F.when(flag(HEAD), 0).otherwise(F.greatest("n", F.lit(1)))
    key = b.groupBy("page_id", "k").agg(*about, F.sum(letters).alias("n"), F.max(letters).alias("one"), F.max(flag(MARK)).alias("mark"), F.max(flag(AGREE)).alias("agree"))
    key = stored(key, "weighed")
    said = F.when(~F.col("mark"), F.when(F.col("k").isNull(), F.col("n")).otherwise(F.col("one"))).otherwise(0)
    p = key.groupBy("page_id").agg(*about, F.sum("n").alias("all"), F.sum(F.when(F.col("mark"), F.col("n")).otherwise(0)).alias("marks"), F.sum(said).alias("once"), F.max("agree").alias("agree"))
    p = stored(p, "pages")
    blocks = key.filter(F.col("k").isNotNull() & (F.col("one") > 0) & (F.col("one") <= SHORT_LETTERS)).select("page_id", "tk", "k", "n", "one", "mark")
    often = stored(blocks.select("k", "tk").distinct().groupBy("k").agg(F.count("*").alias("titles")).filter(F.col("titles") >= DUPLICATE_TITLES).select("k"), "messages")
    again = join_sized(blocks, often, ["k"], "left_semi", limit=FEW_IDS).groupBy("page_id").agg(F.sum("n").alias("again"), F.sum(F.when(~F.col("mark"), F.col("one")).otherwise(0)).alias("again_unmarked"))
    shared = stored(p.filter("tk != 0").select("tk", "host").distinct().groupBy("tk").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= TITLE_HOSTS).select("tk", F.lit(True).alias("shared")), "titles")
    typical = p.groupBy("host").agg(F.percentile_approx("all", 0.5).alias("own"), F.count("*").alias("pages"))
    middle = p.agg(F.percentile_approx("all", 0.5)).first()[0] or 1
    own = F.when(F.col("pages") >= HOST_PAGES, F.greatest(F.col("own"), F.lit(HOST_SHARE * middle))).otherwise(F.lit(float(middle)))
    typical = stored(typical.select("host", F.greatest(own, F.lit(1.0)).alias("typical")), "typical")
    x = p.select("page_id", "host", "tk", "status", "all", "marks", "once", "agree")
    x = join_sized(x, stored(again, "again"), ["page_id"], "left", limit=FEW_IDS).na.fill(0, ["again", "again_unmarked"])
    x = join_sized(join_sized(x, shared, ["tk"], "left", limit=FEW_IDS), typical, ["host"])
    said = (F.col("once") - F.col("again_unmarked")) / F.col("typical")
    level = F.lit(len(INFORMATION))
    for i, bound in reversed(list(enumerate(INFORMATION))):
        level = F.when(said < bound, i).otherwise(level)
    most = F.greatest(MOST * F.col("all"), F.lit(1))
    columns = {
        "information": level, "agreement": F.when(F.col("tk") == 0, 4).when(F.col("shared"), 2).otherwise(0) + (~F.col("agree")).cast("int"), "repeated": (F.col("again") >= most).cast("int"),
        "placeholder": (F.col("marks") >= most).cast("int"), "status": F.coalesce((F.col("status") >= 400).cast("int"), F.lit(0)),
    }
    return stored(x.select("page_id", *[columns[e].alias(e) for e in EVIDENCE]), "evidence")


def learned_classes(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior of each pattern of evidence (a row of levels) to be of a page without an article, by
    expectation-maximization over the counted patterns; the start shares weigh as PRIOR_PAGES pages."""
    names = list(EVIDENCE)
    start = [tuple(np.array(s) for s in EVIDENCE[e]) for e in names]
    without, having, share = [w for w, _ in start], [h for _, h in start], START

    def posterior() -> np.ndarray:
        a = np.log(share) + sum(np.log(m[patterns[:, j]]) for j, m in enumerate(without))
        b = np.log(1 - share) + sum(np.log(m[patterns[:, j]]) for j, m in enumerate(having))
        return 1 / (1 + np.exp(np.clip(b - a, -50, 50)))

    for _ in range(rounds):
        r = posterior()
        share = ((r * counts).sum() + START * PRIOR_PAGES) / (counts.sum() + PRIOR_PAGES)
        for j, (w, h) in enumerate(start):
            for to, first, weight in ((without, w, r * counts), (having, h, (1 - r) * counts)):
                if to is without and names[j] == ANCHOR:
                    continue
                to[j] = (np.bincount(patterns[:, j], weight, len(first)) + PRIOR_PAGES * first) / (weight.sum() + PRIOR_PAGES)
    return posterior()


def residue_pages(blocks: DataFrame) -> DataFrame:
    """(page_id, posterior and the columns of EVIDENCE): pages of article blocks that hold no article."""
    evidence = page_evidence(blocks)
    rows = evidence.groupBy(*EVIDENCE).count().collect()  # at most 192 patterns
    if not rows:
        return evidence.withColumn("posterior", F.lit(0.0)).limit(0)
    p = learned_classes(np.array([[r[e] for e in EVIDENCE] for r in rows]), np.array([float(r["count"]) for r in rows]))
    code, size = F.lit(0), 1
    index = np.zeros(len(rows), int)
    for e, (first, _) in EVIDENCE.items():
        code = code + F.col(e) * size
        index += np.array([r[e] for r in rows]) * size
        size *= len(first)
    table = np.zeros(size)
    table[index] = p
    found = evidence.withColumn("posterior", F.element_at(F.array(*[F.lit(float(x)) for x in table]), code.cast("int") + 1))
    return found.filter(F.col("posterior") >= LEAST)


def real_articles(pages: DataFrame) -> DataFrame:
    """The article blocks, with text, of the parsed pages that have an article; text is read only in the last step."""
    rules = Rules(pages)
    found = stored(residue_pages(rules.blocks(pages, text=False)).select("page_id"), "residue")
    return rules.blocks(join_sized(pages, found, ["page_id"], "left_anti", limit=FEW_IDS))
