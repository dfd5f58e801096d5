"""Main body of web pages by consensus of the pages of a host (problem 2), used by the operators that need article text.

Containers, furniture and side boxes are voted on over light rows without text; their result per host is a set of small
tables that the blocks meet in place, so no text is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import join_sized, stored
from .markup import host_of, placed, slug_of, text_blocks, title_of

#: Letters from which a block that ends as a sentence counts as prose.
PROSE_CHARS = 40
#: A block is furniture if this share of a host's distinct titles carries it, and at least so many titles.
CRUFT_SHARE, CRUFT_TITLES = 0.04, 3
#: Of the blocks in a classed element inside the winning container, the share that must be prose for it to be kept.
SIDE_PROSE_SHARE = 0.5
#: Words from which a block is tested for filler, and the share of function words that real text has at least.
FILLER_WORDS, FUNCTION_SHARE = 8, 0.1
#: Share of a block that must be marks of templates for it to be a placeholder.
MARK_SHARE = 0.5
#: Ids (one bigint a row) up to this number are broadcast to drop or keep pages; more are joined by shuffle.
FEW_IDS = 500_000

# Marks of template languages, and the characters one of which each of them has.
TEMPLATE_MARKS = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|\$\{[^}]*\}|%%\w+%%|@@\w+@@|\[\[[\w.| ]+\]\]|__[A-Z_]+__|\{\d+\}|#\{\w+\}")
_MARKED = ("{", "%", "@@", "[[", "__")

#: Flags of a block: running text; heading; may be a notice; placeholder or filler; shares a term with title or address.
PROSE, HEAD, NOTICE, MARK, AGREE = 1, 2, 4, 8, 16
#: c: hash of its container's path; t: text; f: flags; k: hash of its letters, null without any; n: letters.
BLOCK = "struct<c:bigint,t:string,f:int,k:bigint,n:int>"
LIGHT = BLOCK.replace("t:string,", "")
#: paths: the containers of the page; h1: that of its first heading of the first level; light: the blocks without text.
PARSED = f"page_id bigint, lote int, status int, host string, title string, th bigint, tk bigint, vote string, h1 string, paths array<string>, blocks array<{BLOCK}>, light array<{LIGHT}>"

_SENTENCE_END = re.compile(r"[.!?…][\"'”»)\]]*$")
_SEPARATOR = re.compile(r"\s+[-|–—·»:]+\s+")
_TERM = re.compile(r"[^\W\d_]{4,}")
_LETTERS = frozenset(range(65, 91)) | frozenset(range(97, 123))
_NO_LETTERS = bytes(b for b in range(128) if b not in _LETTERS)
_APART = bytes.maketrans(_NO_LETTERS, b" " * len(_NO_LETTERS))


def letters_of(text: str) -> bytes:
    """Lower-case ASCII letters: the same for a line and for its copies with other numbers or a garbled encoding. Text
    mostly in other scripts keeps those letters too."""
    raw = text.lower().encode("utf-8", "replace").translate(None, _NO_LETTERS)
    plain = raw.decode("utf-8", "ignore").encode("ascii", "ignore") if not raw.isascii() else raw
    return plain if 2 * len(plain) >= len(raw) - len(plain) else raw


def hash64(raw: bytes) -> int:
    """A signed 64-bit hash, the same as ``xxhash64`` gives in SQL."""
    h = xxhash.xxh64_intdigest(raw, 42)
    return h - (1 << 64) if h >> 63 else h


def is_placeholder(text: str) -> bool:
    """Whether marks of template languages make up MARK_SHARE of a block, of whatever length."""
    return any(m in text for m in _MARKED) and sum(m.end() - m.start() for m in TEMPLATE_MARKS.finditer(text)) >= MARK_SHARE * len(text)


def is_filler(text: str, function_words: frozenset[bytes]) -> bool:
    """Whether FILLER_WORDS and more words hold next to no function words, over the whole block."""
    ws = text.lower().encode("utf-8", "replace").translate(_APART).split()
    return len(ws) >= FILLER_WORDS and sum(map(function_words.__contains__, ws)) < FUNCTION_SHARE * len(ws)


def title_key(title: str, host: str) -> int:
    """Hash of a title's letters without the parts that name the host; 0 if nothing else is there."""
    name = host.rpartition(".")[0].encode().translate(None, _NO_LETTERS)
    parts = [p for x in _SEPARATOR.split(title) if (p := letters_of(x)) and p != name]
    return hash64(b"".join(parts)) if parts else 0


def terms_of(title: str, slug: str, host: str) -> list[str]:
    """Words of four and more letters of title and address that are not part of the host's name."""
    return [w for w in dict.fromkeys(_TERM.findall(f"{title} {slug}".lower())) if w not in host]


def _parser(function_words: frozenset[bytes]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int | None, int, int]] = {}
        hashes: dict[str, int] = {}

        def features(text: str, low: str) -> tuple[int | None, int, int]:
            raw = letters_of(low)
            n = len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))
            mark = is_placeholder(text) or (len(text) > FILLER_WORDS and bool(function_words) and is_filler(low, function_words))
            return hash64(raw) if raw else None, n, MARK if mark else 0

        for b in batches:
            hosts, titles, ths, tks, votes, h1s, all_paths, ends, path_ends = [], [], [], [], [], [], [], [0], [0]
            cs: list[int] = []
            ts: list[str] = []
            fs: list[int] = []
            ks: list[int | None] = []
            ns: list[int] = []
            for src, url in zip(b.column("html").to_pylist(), b.column("address").to_pylist()):
                src = src or ""
                host, slug, title = host_of(url), slug_of(url), title_of(src)
                terms = terms_of(title, slug, host)
                score: dict[str, float] = {}
                paths: dict[str, None] = {}
                h1 = None
                for path, text, link in text_blocks(src):
                    c, r, head, notice = placed(path)
                    size = len(text)
                    low = text.lower()
                    f = (HEAD if head else 0) | (NOTICE if notice else 0)
                    if not link and size >= PROSE_CHARS and _SENTENCE_END.search(text[-8:]) is not None or size >= 3 * PROSE_CHARS and text.count(". ") > 0:
                        f |= PROSE
                        score[c] = score.get(c, 0) + size
                    if size < 60:  # menus and notices come again and again
                        got = known.get(text)
                        if got is None:
                            if len(known) > 100_000:
                                known.clear()
                            got = known[text] = features(text, low)
                    else:
                        got = features(text, low)
                    if not head:
                        for w in terms:
                            if w in low:
                                f |= AGREE
                                break
                    elif h1 is None and r == "h1":
                        h1 = c
                    paths[c] = None
                    h = hashes.get(c)
                    if h is None:
                        if len(hashes) > 100_000:
                            hashes.clear()
                        h = hashes[c] = hash64(c.encode("utf-8", "replace"))
                    cs.append(h)
                    ts.append(text)
                    fs.append(f | got[2])
                    ks.append(got[0])
                    ns.append(got[1])
                ends.append(len(cs))
                all_paths += paths
                path_ends.append(len(all_paths))
                hosts.append(host)
                titles.append(title)
                ths.append(hash64(title.encode("utf-8", "replace")))
                tks.append(title_key(title, host))
                votes.append(max(score, key=score.__getitem__) if score else None)
                h1s.append(h1)
            c, t, f, k, n = pa.array(cs, pa.int64()), pa.array(ts, pa.string()), pa.array(fs, pa.int32()), pa.array(ks, pa.int64()), pa.array(ns, pa.int32())
            at = pa.array(ends, pa.int32())
            blocks = [pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(x, y)) for x, y in (([c, t, f, k, n], ["c", "t", "f", "k", "n"]), ([c, f, k, n], ["c", "f", "k", "n"]))]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("lote"), b.column("status"), pa.array(hosts, pa.string()), pa.array(titles, pa.string()), pa.array(ths, pa.int64()), pa.array(tks, pa.int64()), pa.array(votes, pa.string()), pa.array(h1s, pa.string()), pa.ListArray.from_arrays(pa.array(path_ends, pa.int32()), pa.array(all_paths, pa.string())), *blocks],
                names=["page_id", "lote", "status", "host", "title", "th", "tk", "vote", "h1", "paths", "blocks", "light"],
            )

    return run


def parsed_pages(web_in: DataFrame, common_words: DataFrame | None = None) -> DataFrame:
    """One stored row per delivered record with markup, with its text blocks and the container it votes for.

    Records with null or empty html have no row; a record delivered twice has two equal rows, which the operators
    below count once. ``common_words`` (lang, word) is a fixed list of frequent words, by which filler is told from
    prose; without it, or with an empty one, no block counts as filler."""
    words = frozenset(r.word.lower().encode() for r in common_words.select("word").collect() if r.word) if common_words is not None else frozenset()
    src = web_in.filter(F.col("html").isNotNull() & (F.length("html") > 0)).select(
        "page_id", F.col("lote").cast("int").alias("lote"), F.col("status").cast("int").alias("status"), F.coalesce("url_final", "url").alias("address"), "html"
    )
    return stored(src.mapInArrow(_parser(words), PARSED), "parsed")


def host_containers(pages: DataFrame) -> DataFrame:
    """(host, winner): the container path most pages of the host vote for; ties go to the path last in order."""
    votes = pages.filter(F.col("vote").isNotNull()).select("host", "vote", "page_id").distinct().groupBy("host", "vote").agg(F.count("*").alias("n"))
    return votes.groupBy("host").agg(F.max_by(F.col("vote"), F.struct("n", "vote")).alias("winner"))


def located(pages: DataFrame, winners: DataFrame, text: bool = False) -> DataFrame:
    """Rows (page_id, lote, status, host, title, th, tk, pos, side, c, f, k, n, and t with ``text``) of the blocks inside
    each page's container: the host's winner; where the page has no such element, that of its h1; without one, the
    page's own vote. side: in a classed element inside it."""
    about = ["page_id", "lote", "status", "host", "title", "th", "tk"]
    column = "blocks" if text else "light"
    p = join_sized(pages.select(*about, "vote", "h1", "paths", column), winners, ["host"], "left")
    home = F.when(F.array_contains("paths", F.col("winner")), F.col("winner")).otherwise(F.coalesce("h1", "vote", F.lit("")))
    p = p.select(*about, "paths", column, home.alias("home"))
    inner = F.filter("paths", lambda c: (F.col("home") != "") & c.startswith(F.concat("home", F.lit(">"))))
    # made once a page, before its blocks stand apart
    p = p.select(*about, column, F.xxhash64("home").alias("own"), F.transform(inner, lambda c: F.xxhash64(c)).alias("inner"))
    b = p.select(*about, "own", "inner", F.posexplode(column).alias("pos", "b"))
    fields = [F.col(f"b.{c}").alias(c) for c in ("c", "f", "k", "n", *(["t"] if text else []))]
    b = b.select(*about, "own", "inner", "pos", *fields)
    side = F.col("c") != F.col("own")
    return b.filter(~side | F.array_contains("inner", F.col("c"))).withColumn("side", side).drop("own", "inner")


def flag(bit: int) -> Column:
    """Whether a block row has a flag."""
    return F.col("f").bitwiseAND(F.lit(bit)) != 0


def host_furniture(blocks: DataFrame) -> DataFrame:
    """(host, k): keys of running text that many distinct titles of a host carry. Copies of one article share the
    title, so a large group of copies does not make its paragraphs furniture."""
    lines = blocks.filter(flag(NOTICE) & F.col("k").isNotNull()).select("host", "th", "k")
    per_key = lines.distinct().groupBy("host", "k").agg(F.count("*").alias("n"))
    titles = blocks.select("host", "th").distinct().groupBy("host").agg(F.count("*").alias("titles"))
    return join_sized(per_key.filter(F.col("n") >= CRUFT_TITLES), stored(titles, "titles"), ["host"]).filter(F.col("n") >= CRUFT_SHARE * F.col("titles")).select("host", "k")


class Rules:
    """What the pages of a host are held to, as stored tables: winners (host, winner), furniture (host, k) and sides
    (host, c), the classed elements inside the winner most of whose blocks on the host are prose that does not recur."""

    def __init__(self, pages: DataFrame):
        self.winners = stored(host_containers(pages), "winners")
        blocks = stored(located(pages, self.winners).select("page_id", "host", "th", "side", "c", "f", "k"), "located")
        self.furniture = stored(host_furniture(blocks), "furniture")
        side = self._without_furniture(blocks.filter("side"))
        share = side.groupBy("host", "c").agg(F.avg(flag(PROSE).cast("double")).alias("share"), F.count("*").alias("n"))
        self.sides = stored(share.filter((F.col("share") >= SIDE_PROSE_SHARE) & (F.col("n") >= CRUFT_TITLES)).select("host", "c"), "sides")

    def _without_furniture(self, blocks: DataFrame) -> DataFrame:
        # what can be no notice has a key of its own, so that such rows join nothing and stay spread
        own = F.when(flag(NOTICE), F.col("k"))
        return join_sized(blocks.withColumn("key", F.coalesce(own, F.xxhash64("page_id", "c", "k"))), self.furniture.withColumnRenamed("k", "key"), ["host", "key"], "left_anti").drop("key")

    def blocks(self, pages: DataFrame, text: bool = True) -> DataFrame:
        """The blocks of the article on each page (rows of :func:`located`): those directly in the container, and
        those of its classed elements that the host's sides hold, without the host's furniture."""
        b = self._without_furniture(located(pages, self.winners, text))
        kept = self.sides.withColumn("kept", F.lit(True))
        return join_sized(b, kept, ["host", "c"], "left").filter(~F.col("side") | F.col("kept")).drop("kept", "side")


def article_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of the article on each page: (page_id, lote, status, host, title, th, tk, pos, c, f, k, n, t)."""
    return Rules(pages).blocks(pages)


def main_text(blocks: DataFrame) -> DataFrame:
    """(page_id, lote, title, text): the article of each page, its blocks in reading order, a line each; a page delivered
    twice has one row."""
    b = blocks.groupBy("page_id").agg(F.min("lote").alias("lote"), F.max("title").alias("title"), F.array_sort(F.collect_set(F.struct("pos", "t"))).alias("x"))
    return b.select("page_id", "lote", "title", F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("text"))


__all__ = ["Rules", "article_blocks", "host_containers", "host_furniture", "located", "main_text", "parsed_pages"]
