"""Problem 1: text of scanned pages made continuous again: running lines, divided words and misread characters."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import BROADCAST_ROWS, join_sized, stored

#: Lines smaller than this share of the document's body size, among the first or last EDGE lines of a page, are running.
SMALL, EDGE = 0.9, 3
#: Without small lines, a line is running if its key stands at the same edge of this share of pages, two at least.
REPEAT_SHARE, REPEAT_PAGES = 0.3, 2
#: Letters a repeated line has at least that is not the outermost of its page.
INNER_LETTERS = 4
# Characters that divide a word at a line end.
HYPHENS = "-\xad‐¬"
HYPHENS_OR_SPACE = HYPHENS + " "
# Fixed values: (read, true) pairs of characters that recognition confuses.
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("n", "a"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"), ("l", "1"), ("i", "1"), ("0", "o"), ("o", "0"), ("f", "t"), ("t", "f"), ("5", "s"), ("s", "5"), ("9", "g"), ("g", "9"),
    ("b", "h"), ("h", "b"), ("6", "b"), ("b", "6"), ("6", "ó"), ("6", "é"), ("8", "b"), ("b", "8"), ("5", "ã"), ("f", "í"), ("l", "í"), ("1", "í"), ("u", "n"), ("n", "u"), ("o", "a"), ("a", "o"), ("2", "z"), ("z", "2"), ("v", "y"), ("y", "v"), ("q", "g"), ("g", "q"),
    ("ri", "n"), ("ii", "u"), ("ii", "ü"), ("ii", "ä"), ("cl", "d"), ("rn", "m"), ("fi", "ñ"), ("li", "h"), ("vv", "w"), ("nn", "m"), ("lc", "k"), ("in", "m"), ("m", "rn"), ("d", "cl"), ("h", "li"), ("n", "ri"), ("u", "ii"), ("w", "vv"),
)
_CONFUSED = frozenset(CONFUSIONS)
_BY_READ: dict[str, list[str]] = {}
_BY_TRUE: dict[str, list[str]] = {}
for _r, _t in CONFUSIONS:
    _BY_READ.setdefault(_r, []).append(_t)
    _BY_TRUE.setdefault(_t, []).append(_r)
#: Cost of a listed confusion, of another single substitution, and of a second listed confusion in one word.
LISTED, OTHER, DOUBLE = 1.0, 3.0, 2.5
#: A reading is replaced if the true word is this many times more frequent; and weight of the edit cost against log counts.
RATIO, COST_WEIGHT = 4.0, 2.0
#: Bits of the filter by which tasks pass over words that are not doubtful, whatever their number; partial filters made.
FILTER_BITS, FILTER_PARTS = 1 << 25, 16
#: A form seen so often on scanned pages, and in this share of their words, counts as a word.
SEEN_LEAST, SEEN_SHARE = 20, 4e-6
#: Read words up to this length try the listed confusions one by one; longer ones use the index of deletes, which has no
#: keys of fewer characters than INDEX_KEY, so none is shared by all short words.
SHORT_WORD, INDEX_KEY = 4, 3
#: Up to this length a word tries all pairs of listed confusions; longer ones meet the lexicon half way.
PAIRS_LENGTH = 24
#: Key characters from which keys are rolling hashes, so that a long word costs its length and not its square.
ROLLING = 60
#: Pages of a document whose neighbours are found in one task.
CHUNK = 1_000
#: For words that are words themselves: least support of the other reading in neighbouring pairs of clean pages.
CONTEXT_SUPPORT = 2

_TOKEN = re.compile(r"[^\W_]+")
_COMPOUND = re.compile(r"([^\W_]+)-(?=([^\W_]+))")
_NUMBERLIKE = re.compile(r"(?=.*\d)(?=.*[lIOoSB|])[0-9lIOoSB|]{2,}")
_CODE = re.compile(r"[A-Z]\d+")
NUMBER_START = frozenset("0123456789liosb|")
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "e": "c", "9": "g", "6": "b", "t": "f"})

LINE = "struct<b:int,l:int,t:string,sz:double>"
PAGE = f"doc_id bigint, page_num int, lines array<{LINE}>, n int, edge array<struct<i:int,b:int,l:int,t:string,sz:double>>, hist array<struct<sz:double,n:int>>"


def scanned_pages(page_text: DataFrame, pdf_meta: DataFrame) -> DataFrame:
    """(doc_id, page_num, scanned): recognised by flag, or without one by the document's text layer."""
    meta = pdf_meta.groupBy("doc_id").agg(F.max(F.lower(F.trim("capa_texto")) == "ocr").alias("ocr"))
    p = page_text.groupBy("doc_id", "page_num").agg(F.max("ocr_aplicado").alias("applied"))
    return p.join(meta, "doc_id", "left").select("doc_id", "page_num", F.coalesce("applied", "ocr", F.lit(False)).alias("scanned"))


def pages(layout: DataFrame, page_text: DataFrame, pdf_meta: DataFrame) -> DataFrame:
    """Stored pages with their lines in order, each line its spans joined; rows repeated exactly count once. ``edge`` are
    the first and last EDGE + 1 lines with their index, ``hist`` the characters of each size.

    Null text counts as empty, lines without text are dropped, null numbers order as 0; pages unknown to
    ``page_text`` follow the document's text layer."""
    span = F.struct(F.coalesce("block_no", F.lit(0)).alias("b"), F.coalesce("line_no", F.lit(0)).alias("l"), F.coalesce("span_no", F.lit(0)).alias("s"), F.coalesce("text", F.lit("")).alias("t"), F.coalesce("size", F.lit(0.0)).alias("sz"))
    grouped = layout.filter(F.col("doc_id").isNotNull()).groupBy("doc_id", F.coalesce("page_num", F.lit(0)).cast("int").alias("page_num")).agg(F.collect_list(span).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bt in batches:
            spans = bt.column("spans")
            at = spans.offsets.to_pylist()
            cols = [_values(c) for c in spans.values.flatten()]
            rows: list[tuple[int, int, str, float]] = []
            edges: list[tuple[int, int, int, str, float]] = []
            hist: list[tuple[float, int]] = []
            ends, edge_ends, hist_ends, ns = [0], [0], [0], []
            for i, j in zip(at, at[1:]):
                page: list[tuple[int, int, str, float]] = []
                last = None
                for b, ln, _, t, z in sorted(set(zip(*(c[i:j] for c in cols)))):
                    if last == (b, ln):
                        page[-1] = (b, ln, page[-1][2] + t, max(page[-1][3], z))
                        continue
                    last = (b, ln)
                    page.append((b, ln, t, z))
                page = [x for x in page if x[2] and not x[2].isspace()]
                n = len(page)
                sizes: dict[float, int] = {}
                for x in page:
                    sizes[x[3]] = sizes.get(x[3], 0) + len(x[2])
                rows += page
                hist += sizes.items()
                near = range(n) if n <= 2 * EDGE + 2 else (*range(EDGE + 1), *range(n - EDGE - 1, n))
                edges += [(k, *page[k]) for k in near]
                ns.append(n)
                ends.append(len(rows))
                edge_ends.append(len(edges))
                hist_ends.append(len(hist))

            def nested(of: list[tuple], offsets: list[int], names: list[str], kinds: list[pa.DataType]) -> pa.Array:
                c = list(zip(*of)) if of else [()] * len(names)
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names))

            line = [pa.int32(), pa.int32(), pa.string(), pa.float64()]
            cols_out = [nested(rows, ends, ["b", "l", "t", "sz"], line), pa.array(ns, pa.int32()), nested(edges, edge_ends, ["i", "b", "l", "t", "sz"], [pa.int32(), *line]), nested(hist, hist_ends, ["sz", "n"], [pa.float64(), pa.int32()])]
            yield pa.RecordBatch.from_arrays([bt.column("doc_id"), bt.column("page_num"), *cols_out], names=["doc_id", "page_num", "lines", "n", "edge", "hist"])

    lines = grouped.mapInArrow(run, PAGE)
    flags = stored(scanned_pages(page_text, pdf_meta), "scanned")
    meta = stored(pdf_meta.groupBy("doc_id").agg(F.max(F.lower(F.trim("capa_texto")) == "ocr").alias("ocr")), "layers")
    x = join_sized(join_sized(lines, flags, ["doc_id", "page_num"], "left"), meta, ["doc_id"], "left")
    return stored(x.select("doc_id", "page_num", F.coalesce("scanned", "ocr", F.lit(False)).alias("scanned"), "lines", "n", "edge", "hist"), "pages")


def line_key(text: Column) -> Column:
    """Letters of a line with confusable characters folded, without numbers: equal for a running line and its misread copies."""
    s = F.lower(F.regexp_replace(text, r"\d+", " "))
    for read, true in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d")):
        s = F.replace(s, F.lit(read), F.lit(true))
    return F.regexp_replace(F.translate(s, "iet", "lcf"), r"[^\p{L}\p{N}_]", "")


def body_sizes(pg: DataFrame) -> DataFrame:
    """(doc_id, body, has_small): the size most characters have, to a tenth, and whether a line at an edge of a page is
    clearly smaller. Sizes are weighed by the histograms of the pages, not by their lines."""
    edge = F.array_min(F.transform(F.filter("edge", lambda z: (z["i"] < EDGE) | (z["i"] >= F.col("n") - EDGE)), lambda z: z["sz"]))
    per = pg.select("doc_id", edge.alias("e"), F.explode("hist").alias("x")).groupBy("doc_id", F.round("x.sz", 1).alias("sz")).agg(F.sum("x.n").alias("n"), F.min("e").alias("e"))
    body = per.groupBy("doc_id").agg(F.max_by("sz", F.struct("n", "sz")).alias("body"), F.min("e").alias("least"))
    return body.select("doc_id", "body", (F.col("least") < SMALL * F.col("body")).alias("has_small"))


def _is_small(z: Column, i: Column) -> Column:
    return ((i < EDGE) | (i >= F.col("n") - EDGE)) & (z["sz"] < SMALL * F.col("body"))


def with_running(pg: DataFrame) -> DataFrame:
    """Pages (doc_id, page_num, scanned, lines, run, nxt, prv) with ``run``, a flag per line: running header, footer or
    page number, also if misread; and with the neighbouring body lines where a word is divided between pages.

    Both come by joins with small tables as long as those are small; else the pages are stored once more."""
    sizes = stored(body_sizes(pg), "sizes")
    x = join_sized(pg, sizes, ["doc_id"])
    run, edge_run = F.transform("lines", _is_small), F.transform("edge", lambda z: _is_small(z, z["i"]))
    if sizes.filter(~F.col("has_small")).limit(1).count():
        reps = stored(_repeated_edges(x), "repeated")
        x = join_sized(x, reps, ["doc_id"], "left")
        run = F.when(F.col("reps").isNull(), run).otherwise(F.transform("lines", _is_repeated))
        edge_run = F.when(F.col("reps").isNull(), edge_run).otherwise(F.transform("edge", lambda z: _is_repeated(z, z["i"])))
    own = F.zip_with("edge", edge_run, lambda z, r: F.when(~r, z))
    ends = x.select("doc_id", "page_num", F.filter(own, lambda z: z.isNotNull()).alias("body")).filter(F.size("body") > 0)
    link = stored(_page_links(ends.select("doc_id", "page_num", F.get("body", 0).alias("f"), F.element_at("body", -1)["t"].alias("z"))), "links")
    y = join_sized(x.select("doc_id", "page_num", "scanned", "lines", run.alias("run")), link, ["doc_id", "page_num"], "left")
    few = all(t.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS for t in (sizes, link))
    return y if few else stored(y, "linked")


def _repeated_edges(x: DataFrame) -> DataFrame:
    """(doc_id, reps): for documents whose sizes tell nothing, the keys of lines at the same edge of several pages: the
    outermost line, and of the next ones those with some letters. Keys are led by t or b, and by 0 if outermost."""
    i, low = F.col("z.i"), F.col("n") - 1 - F.col("z.i")
    flat = x.filter(~F.col("has_small")).select("doc_id", "page_num", "n", F.explode("edge").alias("z")).filter((i < EDGE) | (low < EDGE))
    top = i <= low
    keyed = flat.select("doc_id", "page_num", _edge_key(F.col("z.t"), top, F.least(i, low)).alias("k"))
    total = x.filter(~F.col("has_small")).groupBy("doc_id").agg(F.count_distinct("page_num").alias("pages"))
    rep = keyed.distinct().groupBy("doc_id", "k").agg(F.count("*").alias("n")).join(total, "doc_id").filter((F.col("n") >= F.greatest(F.lit(REPEAT_PAGES), REPEAT_SHARE * F.col("pages"))) & (((F.length("k") != 3) & (F.substring("k", 2, 1) == "0")) | (F.length("k") >= 2 + INNER_LETTERS)))
    return rep.groupBy("doc_id").agg(F.collect_set("k").alias("reps"))


def _edge_key(text: Column, top: Column, depth: Column) -> Column:
    return F.concat(F.when(top, "t").otherwise("b"), F.when(depth == 0, "0").otherwise("1"), line_key(text))


def _is_repeated(z: Column, i: Column) -> Column:
    low = F.col("n") - 1 - i
    depth = F.least(i, low)
    return F.when(depth < EDGE, F.array_contains("reps", _edge_key(z["t"], i <= low, depth))).otherwise(False)


def _page_links(ends: DataFrame) -> DataFrame:
    """(doc_id, page_num, nxt, prv) of pages that end or begin within a word: the first body line of the next page with
    text, the last of the one before. Neighbours are found in chunks of pages, and those of chunks between them, so a
    document of any number of pages is no single task's."""
    head = F.struct(F.col("page_num").alias("p"), F.col("f.b").alias("b"), F.col("f.l").alias("l"), F.col("f.t").alias("t"))
    e = ends.select("doc_id", "page_num", F.floor(F.col("page_num") / CHUNK).alias("chunk"), head.alias("head"), "z")
    w = W.partitionBy("doc_id", "chunk").orderBy("page_num")
    near = e.select("doc_id", "page_num", "chunk", F.lead("head").over(w).alias("nxt"), F.lag("z").over(w).alias("prv"), "z")
    chunks = e.groupBy("doc_id", "chunk").agg(F.min_by("head", "page_num").alias("head"), F.max_by("z", "page_num").alias("z"))
    wc = W.partitionBy("doc_id").orderBy("chunk")
    beside = chunks.select("doc_id", "chunk", F.lead("head").over(wc).alias("nxt_chunk"), F.lag("z").over(wc).alias("prv_chunk")).filter(F.col("nxt_chunk").isNotNull() | F.col("prv_chunk").isNotNull())
    link = near.join(beside, ["doc_id", "chunk"], "left").select("doc_id", "page_num", F.coalesce("nxt", "nxt_chunk").alias("nxt"), F.coalesce("prv", "prv_chunk").alias("prv"), "z")
    tail = rf"[\p{{L}}\p{{N}}][{HYPHENS}] *$"
    return link.filter((F.col("nxt").isNotNull() & F.col("z").rlike(tail)) | F.col("prv").rlike(tail)).drop("z")


def _ends_divided(t: str) -> bool:
    t = t.rstrip(" ")
    return len(t) > 1 and t[-1] in HYPHENS and t[-2].isalnum()


def page_tokens(texts: list[str], nxt: dict | None, prv: str | None) -> tuple[list[list[str]], list[tuple[int, str, str, str, int | None]]]:
    """(tokens of each body line without the halves of divided words, divisions (line, left, right, hyphen, next line)).

    ``texts`` are the body lines of a page, ``prv`` the last body line of the page before, ``nxt`` the first of the
    next one; a next line of None is ``nxt``. Tokens keep their case."""
    toks = [_TOKEN.findall(t) for t in texts]
    n = len(texts)
    divided = []
    for k, t in enumerate(texts):
        if t[-1:] in HYPHENS_OR_SPACE and _ends_divided(t) and toks[k]:
            if k + 1 < n:
                first, following = (toks[k + 1][0] if toks[k + 1] else ""), texts[k + 1]
            elif nxt:
                following = nxt["t"]
                got = _TOKEN.search(following)
                first = got[0] if got else ""
            else:
                continue
            if first and following.lstrip(" ")[:1].isalnum():
                divided.append((k, toks[k][-1], first, t.rstrip(" ")[-1], k + 1 if k + 1 < n else None))
    if divided or prv:
        toks = [list(x) for x in toks]
    for d in divided:
        toks[d[0]].pop()
    for d in divided:
        if d[4] is not None and toks[d[4]]:
            toks[d[4]].pop(0)
        elif d[4] is not None:  # a line of one word that is divided itself
            pass
    if prv is not None and _ends_divided(prv) and toks and toks[0] and texts[0].lstrip(" ")[:1].isalnum():
        toks[0].pop(0)
    return toks, divided


def _values(a: pa.Array) -> list:
    """The values of an array without null numbers; several times faster than one by one."""
    return a.to_numpy(zero_copy_only=False).tolist()


def _flat_pages(bt: pa.RecordBatch) -> Iterator[tuple[int, list[int], list[int], list[str], dict | None, str | None]]:
    """(row, blocks, line numbers, texts) of the body lines of each page of a batch, with its neighbours."""
    lines = bt.column("lines")
    at = lines.offsets.to_pylist()
    b, ln, t = (_values(c) for c in lines.values.flatten()[:3])
    run = _values(bt.column("run").values)
    for row, (i, j, nxt, prv) in enumerate(zip(at, at[1:], bt.column("nxt").to_pylist(), bt.column("prv").to_pylist())):
        body = [k for k in range(i, j) if not run[k]]
        yield row, [b[k] for k in body], [ln[k] for k in body], [t[k] for k in body], nxt, prv


COUNTS = "kind string, a string, b string, clean bigint, scan bigint"


def _sequence(toks: list[list[str]], divided: list[tuple[int, str, str, str, int | None]], bs: list[int]) -> tuple[list[str], list[int]]:
    """(words, starts): the body words of a page in order over line ends, a divided word whole between the lines it is
    on, an empty one between blocks ``bs``, whose words are no neighbours; and where each line's own words begin."""
    cut = {d[0]: d[1] + d[2] for d in divided}
    seq: list[str] = []
    starts = []
    for k, ts in enumerate(toks):
        if k and bs[k] != bs[k - 1] and k - 1 not in cut:
            seq.append("")
        starts.append(len(seq))
        seq += ts
        if k in cut:
            seq.append(cut[k])
    return seq, starts


class _Numbered(dict):
    """Words by the number they got when first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def counts(linked: DataFrame) -> DataFrame:
    """Stored counts of words (kind w), joined divided words (j), hyphened compounds (c) and neighbouring pairs (p),
    on clean and on scanned pages, over all body lines; in folders by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = (Counter(), Counter()), []
        joined, compounds = (Counter(), Counter()), (Counter(), Counter())
        number = _Numbered({"": 0})

        def batch(kind: str, a: list[str], b: list[str], clean: list[int], scan: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(a)), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(clean, pa.int64()), pa.array(scan, pa.int64())], names=["kind", "a", "b", "clean", "scan"])

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, clean, scan in (("w", *words), ("j", *joined), ("c", *compounds)):
                keys = list(clean.keys() | scan.keys())
                if keys:
                    one = kind == "w"
                    yield batch(kind, keys if one else [k[0] for k in keys], [""] * len(keys) if one else [k[1] for k in keys], [clean[k] for k in keys], [scan[k] for k in keys])
            if pairs:
                k, n = merged()
                names = pa.array(list(number), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(["p"] * len(k)), names.take(pa.array(k >> 32)), names.take(pa.array(k & 0xFFFFFFFF)), pa.array(n), pa.array(np.zeros(len(k), np.int64))], names=["kind", "a", "b", "clean", "scan"])
            for c in (*words, *joined, *compounds, pairs):
                c.clear()
            number.clear()
            number[""] = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, at = np.unique(np.concatenate([x for x, _ in pairs]), return_inverse=True)
            n = np.bincount(at, np.concatenate([y for _, y in pairs])).astype(np.int64)
            pairs[:] = [(k, n)]
            return k, n

        def pair_up(seq: list[str]) -> None:
            i = np.fromiter(map(number.__getitem__, seq), np.int64, len(seq))
            ok = (i[:-1] > 0) & (i[1:] > 0)
            k, n = np.unique((i[:-1] << 32 | i[1:])[ok], return_counts=True)
            pairs.append((k, n.astype(np.int64)))

        for bt in batches:
            scanned = bt.column("scanned").to_pylist()
            flat: tuple[list[str], list[str]] = ([], [])
            seqs: list[str] = [""]
            for row, bs, _, texts, nxt, prv in _flat_pages(bt):
                texts = [t.lower() for t in texts]
                toks, divided = page_tokens(texts, nxt, prv.lower() if prv else None)
                s = 1 if scanned[row] else 0
                divided = [(k, left, right.lower(), hy, f) for k, left, right, hy, f in divided]
                if s:
                    for ts in toks:
                        flat[1].extend(ts)
                else:
                    seq, _ = _sequence(toks, divided, bs)
                    seqs += seq
                    seqs.append("")
                    words[0].subtract(d[1] + d[2] for d in divided)
                joined[s].update((d[1], d[2]) for d in divided)
                for t in texts:
                    if "-" in t:
                        compounds[s].update(_COMPOUND.findall(t))
            words[1].update(flat[1])
            words[0].update(seqs)
            del words[0][""]
            if len(seqs) > 2:
                pair_up(seqs)
            if len(pairs) > 16:
                merged()
            if sum(len(k) for k, _ in pairs) + len(words[0]) + len(words[1]) > 600_000:
                yield from flush()
        yield from flush()

    raw = linked.select("lines", "run", "nxt", "prv", "scanned").mapInArrow(run, COUNTS)
    return stored(raw.groupBy("kind", "a", "b").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan")).filter("clean + scan > 0"), "counts", by="kind")


def _hashed(key: str) -> int:
    """A signed 64-bit hash of a short key."""
    h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def delete_keys(w: str) -> list[tuple[int, int]]:
    """(key, characters out) of the symmetric deletes of a word: one character out or two neighbouring ones, as hashes;
    keys of ROLLING characters and more as rolling hashes, in time linear in the word."""
    n = len(w)
    out: set[tuple[int, int]] = set()
    if n <= ROLLING:
        for t in (1, 2):
            if n - t >= INDEX_KEY:
                out |= {(_hashed(w[:i] + w[i + t :]), t) for i in range(n - t + 1)}
        return list(out)
    before, power = [0] * (n + 1), [1] * (n + 1)
    for i, c in enumerate(w):
        before[i + 1] = (before[i] * _BASE + ord(c) + 1) % _PRIME
        power[i + 1] = power[i] * _BASE % _PRIME
    for t in (1, 2):
        for i in range(n - t + 1):
            if n - t < ROLLING:
                out.add((_hashed(w[:i] + w[i + t :]), t))
            else:
                rest = n - i - t
                out.add(((before[i] * power[rest] + before[n] - before[i + t] * power[rest]) % _PRIME, t))
    return list(out)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index rows (word number, key, characters out) of words."""
    for b in batches:
        ids, ks, ts = [], [], []
        for i, w in zip(b.column("id").to_pylist(), b.column("w").to_pylist()):
            for k, t in delete_keys(w):
                ids.append(i)
                ks.append(k)
                ts.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ks, pa.int64()), pa.array(ts, pa.int32())], names=["id", "k", "t"])


def edit_cost(read: str, true: str) -> tuple[float, int] | None:
    """(cost, position) of turning ``true`` into ``read`` at one site; null if it takes more or other changes."""
    n = min(len(read), len(true))
    i = 0
    while i < n and read[i] == true[i]:
        i += 1
    j = 0
    while j < n - i and read[-1 - j] == true[-1 - j]:
        j += 1
    for back in range(min(i, 1) + 1):  # the site may begin one earlier: ri for n after an r
        for fore in range(min(j, 1) + 1):
            a, b = read[i - back : len(read) - j + fore], true[i - back : len(true) - j + fore]
            if (a, b) in _CONFUSED:
                return LISTED, i - back
    if len(read) == len(true) and len(read) - i - j == 1 and len(read) > 3:
        return OTHER, i
    return None


def _double(word: str) -> dict[str, int]:
    """Words that two listed confusions apart could have been read as ``word``, with the first site."""
    first: dict[str, int] = {}
    for n in (1, 2):
        for i in range(len(word) - n + 1):
            for t in _BY_READ.get(word[i : i + n], ()):
                first.setdefault(word[:i] + t + word[i + n :], i)
    second: dict[str, int] = {}
    for w, i0 in first.items():
        for n in (1, 2):
            for i in range(i0 + 1, len(w) - n + 1):
                for t in _BY_READ.get(w[i : i + n], ()):
                    second.setdefault(w[:i] + t + w[i + n :], i0)
    return second


def _single(word: str) -> dict[str, int]:
    """Words that one listed confusion apart could have been read as ``word``, with the site."""
    out: dict[str, int] = {}
    for n in (1, 2):
        for i in range(len(word) - n + 1):
            for t in _BY_READ.get(word[i : i + n], ()):
                out.setdefault(word[:i] + t + word[i + n :], i)
    return out


def half_way(word: str, by: dict[str, list[str]]) -> set[int]:
    """Rolling hashes of ``word`` with one part replaced as ``by`` lists it, in time linear in the word."""
    n = len(word)
    before, power = [0] * (n + 1), [1] * (n + 2)
    for i, c in enumerate(word):
        before[i + 1] = (before[i] * _BASE + ord(c) + 1) % _PRIME
    for i in range(n + 1):
        power[i + 1] = power[i] * _BASE % _PRIME
    out = set()
    for size in (1, 2):
        for i in range(n - size + 1):
            for t in by.get(word[i : i + size], ()):
                h, rest = before[i], n - i - size
                for c in t:
                    h = (h * _BASE + ord(c) + 1) % _PRIME
                out.add((h * power[rest] + before[n] - before[i + size] * power[rest]) % _PRIME)
    return out


def two_sites(read: str, true: str) -> int | None:
    """The first site of two listed confusions that turn ``true`` into ``read``; null if it takes others."""
    i = 0
    while i < min(len(read), len(true)) and read[i] == true[i]:
        i += 1
    for at in (i, i - 1):
        for n in (1, 2):
            if at >= 0:
                for t in _BY_READ.get(read[at : at + n], ()):
                    got = edit_cost(read[:at] + t + read[at + n :], true)
                    if got and got[0] == LISTED:
                        return at
    return None


READ = "w string, c string, cost double, site int"


def _read_rows(rows: list[tuple[str, str, float, int]]) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int32())], names=["w", "c", "cost", "site"])


def vocabulary(cnt: DataFrame) -> DataFrame:
    """Stored (id, w, clean, scan, read, known): every word with its counts; read: on scanned pages, also as a divided
    word; known: in the frequency lexicon, of words of clean pages and of those of scanned pages that are no rare reading."""
    words = cnt.filter(F.col("kind") == "w").select(F.col("a").alias("w"), "clean", "scan")
    joined = cnt.filter((F.col("kind") == "j") & (F.col("scan") > 0)).select(F.concat("a", "b").alias("w"), F.lit(0).cast("long").alias("clean"), F.lit(0).cast("long").alias("scan"), F.lit(True).alias("read"))
    x = words.withColumn("read", F.col("scan") > 0).unionByName(joined).groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("scan").alias("scan"), F.max("read").alias("read"))
    seen = words.agg(F.sum("scan")).first()[0] or 0
    known = ~F.col("w").rlike(r"^\d+$") & ((F.col("clean") > 0) | (F.col("scan") >= max(SEEN_LEAST, SEEN_SHARE * seen)))
    return stored(x.select(F.xxhash64("w").alias("id"), "w", "clean", "scan", "read", known.alias("known")), "vocabulary")


def readings(vocab: DataFrame) -> DataFrame:
    """Stored (w, c, cost, site, f_w, clean_w, f_c): for words read on scanned pages, more frequent words they may be.

    Candidates come from an index of deletes shared by the word and the frequency lexicon, then the weighted edit
    distance keeps changes at one site; words left without any get those two listed confusions away. Words of any length
    take part: short ones try each confusion, long ones are hashed in time linear in them and meet the lexicon half
    way for two confusions; strings are compared in either case."""
    frequency = F.col("clean") + F.col("scan")
    length = F.length("w")
    lexicon = vocab.filter("known").select(F.col("w").alias("c"), frequency.alias("f_c"))
    seen = vocab.filter("read").select("w", frequency.alias("f_w"), F.col("clean").alias("clean_w"))
    index = stored(vocab.filter((F.col("read") | F.col("known")) & (length >= SHORT_WORD)).select("id", "w").mapInArrow(_keys, "id bigint, k bigint, t int").join(vocab.select("id", "read", "known"), "id"), "index")
    left = index.filter("read").select(F.col("id").alias("wid"), "k", "t")
    right = index.filter("known").select(F.col("id").alias("cid"), "k", F.col("t").alias("tc"))
    pairs = left.join(right, "k").filter((F.col("t") + F.col("tc") <= 3) & (F.col("wid") != F.col("cid"))).select("wid", "cid").distinct()
    both = pairs.join(vocab.select(F.col("id").alias("wid"), "w", frequency.alias("f_w")), "wid").join(vocab.select(F.col("id").alias("cid"), F.col("w").alias("c"), frequency.alias("f_c")), "cid").filter(F.col("f_c") >= RATIO * F.col("f_w"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ((w, c, *got) for w, c in zip(b.column("w").to_pylist(), b.column("c").to_pylist()) if (got := edit_cost(w, c)))
            yield _read_rows([x for x in found if len(x[0]) > SHORT_WORD or x[2] != LISTED])

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _read_rows([(w, c, LISTED, i) for w in b.column("w").to_pylist() for c, i in _single(w).items()])

    def counted(x: DataFrame) -> DataFrame:
        return x.join(lexicon, "c").join(seen, "w").filter((F.col("f_c") >= RATIO * F.col("f_w")) & (F.col("w") != F.col("c"))).select("w", "c", "cost", "site", "f_w", "clean_w", "f_c")

    short = vocab.filter(F.col("read") & (length <= SHORT_WORD)).select("w").mapInArrow(singles, READ)
    one = stored(counted(both.select("w", "c").mapInArrow(weigh, READ).unionByName(short)), "readings")

    def doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _read_rows([(w, c, DOUBLE, i) for w in b.column("w").to_pylist() for c, i in _double(w).items()])

    def hashes(by: dict[str, list[str]]):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(i, h) for i, w in zip(b.column("id").to_pylist(), b.column("w").to_pylist()) for h in half_way(w, by)]
                c = list(zip(*rows)) if rows else [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64())], names=["id", "h"])

        return run

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _read_rows([(w, c, DOUBLE, at) for w, c in zip(b.column("w").to_pylist(), b.column("c").to_pylist()) if (at := two_sites(w, c)) is not None])

    open_words = vocab.filter(F.col("read") & ~F.col("known") & (F.col("clean") == 0) & ~F.col("w").rlike(r"^\d+$") & (length >= SHORT_WORD)).join(one.filter(F.col("cost") <= LISTED).select("w").distinct(), "w", "left_anti").select("id", "w")
    two = open_words.filter(length <= PAIRS_LENGTH).select("w").mapInArrow(doubles, READ)
    long = open_words.filter(length > PAIRS_LENGTH).mapInArrow(hashes(_BY_READ), "id bigint, h bigint").withColumnRenamed("id", "wid")
    true = vocab.filter(F.col("known") & (length > PAIRS_LENGTH - 3)).select("id", "w").mapInArrow(hashes(_BY_TRUE), "id bigint, h bigint").withColumnRenamed("id", "cid")
    met = long.join(true, "h").select("wid", "cid").distinct().join(vocab.select(F.col("id").alias("wid"), "w"), "wid").join(vocab.select(F.col("id").alias("cid"), F.col("w").alias("c")), "cid")
    two = two.unionByName(met.select("w", "c").mapInArrow(check, READ))
    return stored(one.unionByName(counted(two)), "all-readings")


def word_filter(words: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS bits with a bit for each of ``words`` (w), whatever their number: what is not in it is none
    of them. Only FILTER_PARTS partial bitmaps reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            at = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) & (FILTER_BITS - 1) for w in b.column("w").to_pylist()), np.int64, b.num_rows)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])

    total = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in words.select("w").coalesce(FILTER_PARTS).mapInArrow(run, "bits binary").collect():
        total |= np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return total.tobytes()


class _Judged(dict):
    """Tokens as (lower case, 1 for one that may be doubtful, 2 for a number with letters in it, else 0)."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, tok: str) -> tuple[str, int]:
        w = tok.lower()
        at = zlib.crc32(w.encode("utf-8", "replace")) & (FILTER_BITS - 1)
        kind = self.bits[at >> 3] >> (at & 7) & 1
        if w[0] in NUMBER_START and _NUMBERLIKE.fullmatch(tok) is not None and not _CODE.fullmatch(tok) and 2 * sum(map(str.isdigit, w)) >= len(w):
            kind = 2
        if len(self) > 500_000:
            self.clear()
        got = self[tok] = (w, kind)
        return got


def repairs(linked: DataFrame, cnt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(misread, divided). misread: (doc_id, page_num, b, l, tok, c), a word or number on a line and what it should
    be. divided: (doc_id, page_num, b, l, left, right, broken, np, nb, nl), words divided at line ends; broken
    is false for a compound that ends the line at its own hyphen."""
    vocab = vocabulary(cnt)
    reads = readings(vocab)
    # words that cannot be, and words that are words but may be a misread other one
    choice = F.when((F.col("clean_w") == 0) | (F.col("cost") <= LISTED), F.struct("c", "cost", "f_c", (F.col("clean_w") > 0).alias("real")))
    fix = F.max_by(F.when(F.col("cost") <= DOUBLE, F.struct("c", "site", "cost")), F.when(F.col("cost") <= DOUBLE, F.log("f_c") - COST_WEIGHT * F.col("cost")))
    # a word has as many readings as it has sites of confusions and single letters
    doubt = stored(reads.groupBy("w").agg(fix.alias("fix"), F.collect_list(choice).alias("choices")), "doubtful")
    doubtful = doubt.filter(F.size("choices") > 0).select("w", "choices")
    near = linked.sparkSession.sparkContext.broadcast(word_filter(doubtful))
    scanned = linked.filter("scanned").select("doc_id", "page_num", "lines", "run", "nxt", "prv")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _Judged(near.value)
        for bt in batches:
            docs, pages_ = bt.column("doc_id").to_pylist(), bt.column("page_num").to_pylist()
            out: list[tuple] = []
            for row, bs, ls, texts, nxt, prv in _flat_pages(bt):
                doc, page = docs[row], pages_[row]
                toks, divided = page_tokens(texts, nxt, prv)
                for k, left, right, hy, f in divided:
                    where = (page, bs[f], ls[f]) if f is not None else (nxt["p"], nxt["b"], nxt["l"])
                    out.append((doc, page, bs[k], ls[k], left, right, hy, False, *where))
                seq: list[str] | None = None
                for k, ts in enumerate(toks):
                    for i, t in enumerate(ts):
                        w, kind = judged[t]
                        if kind:
                            if seq is None:
                                seq, starts = _sequence(toks, divided, bs)
                            j = starts[k] + i
                            out.append((doc, page, bs[k], ls[k], t, seq[j - 1].lower() if j else "", seq[j + 1].lower() if j + 1 < len(seq) else "", kind == 2, None, None, None))
            c = list(zip(*out)) if out else [()] * 11
            t = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(c, t)], names=["doc_id", "page_num", "b", "l", "tok", "prev", "next", "number", "np", "nb", "nl"])

    seen = stored(scanned.mapInArrow(look, "doc_id bigint, page_num int, b int, l int, tok string, prev string, next string, number boolean, np int, nb int, nl int"), "seen-words")
    d = seen.filter(F.col("np").isNotNull()).select("doc_id", "page_num", "b", "l", F.col("tok").alias("left"), F.col("prev").alias("right"), F.col("next").alias("hy"), "np", "nb", "nl")
    d = d.withColumn("w", F.lower(F.concat("left", "right"))).withColumn("lo", F.lower("left")).withColumn("hi", F.lower("right"))
    compound = cnt.filter(F.col("kind") == "c").select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.lit(True).alias("compound"))
    d = d.join(vocab.filter("clean + scan > 1").select("w", F.lit(True).alias("whole")), "w", "left").join(doubt.filter(F.col("fix").isNotNull()).select("w", "fix"), "w", "left")
    d = d.join(vocab.filter("clean > 0").select(F.col("w").alias("hi"), F.lit(True).alias("own_word")), "hi", "left").join(compound, ["hi", "lo"], "left")
    # written whole, or nearly: divided. Else a hyphen of its own if the compound is known or the second part is a word
    broken = F.when(F.col("hy") != "-", True).when(F.col("whole"), True).when(F.col("compound"), False).when(F.col("fix").isNotNull(), True).otherwise(~F.coalesce("own_word", F.lit(False)))
    divided = stored(d.select("doc_id", "page_num", "b", "l", "left", "right", broken.alias("broken"), "np", "nb", "nl", F.coalesce("whole", F.lit(False)).alias("whole"), "fix"), "divided")

    o = seen.filter(F.col("np").isNull()).select("doc_id", "page_num", "b", "l", "tok", F.lower("tok").alias("w"), "prev", "next", "number")
    # halves of compounds that end a line at their hyphen are words of their own
    comp = divided.filter(~F.col("broken"))
    halves = comp.select("doc_id", "page_num", "b", "l", F.col("left").alias("tok")).unionByName(comp.select("doc_id", F.col("np").alias("page_num"), F.col("nb").alias("b"), F.col("nl").alias("l"), F.col("right").alias("tok")))
    o = o.unionByName(halves.select("*", F.lower("tok").alias("w"), F.lit("").alias("prev"), F.lit("").alias("next"), F.lit(False).alias("number")))
    known_numbers = vocab.filter((F.col("clean") > 0) & F.col("w").rlike(r"\d")).select("w")
    numbers = o.filter("number").join(known_numbers, "w", "left_anti").select("doc_id", "page_num", "b", "l", "tok", F.translate("tok", "lIOoSB|", "1100581").alias("c"))
    # the words that only the filter took for doubtful go here
    oc = stored(join_sized(o.filter(~F.col("number")), doubtful, ["w"]), "occurrences")
    clear = (F.size("choices") == 1) & ~F.get("choices", 0)["real"]
    sure = oc.filter(clear).select("doc_id", "page_num", "b", "l", "tok", F.get("choices", 0)["c"].alias("c"))
    oid = F.xxhash64("doc_id", "page_num", "b", "l", "tok", "prev", "next")
    u = oc.filter(~clear).select(oid.alias("oid"), "doc_id", "page_num", "b", "l", "tok", "w", "prev", "next", F.explode("choices").alias("r")).distinct()
    # each reading asks for its four neighbouring pairs, which meet the counted pairs in one join
    c = F.col("r.c")
    asks = F.array(*[F.struct(F.lit(k).alias("k"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate(((F.col("prev"), c), (c, F.col("next")), (F.col("prev"), F.col("w")), (F.col("w"), F.col("next"))))])
    counted = cnt.filter(F.col("kind") == "p").select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("clean").alias("n"))
    u = u.withColumn("ask", F.explode(asks)).select("*", "ask.k", "ask.x", "ask.y").drop("ask").join(counted, ["x", "y"], "left")
    own = ["oid", "doc_id", "page_num", "b", "l", "tok", "w", "prev", "next", "r"]
    sums = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in enumerate(("pc", "cn", "pw", "wn"))]
    u = u.groupBy(*own).agg(*sums)
    score = F.log("r.f_c") + F.log(F.col("pc") + 0.1) + F.log(F.col("cn") + 0.1) - COST_WEIGHT * F.col("r.cost")
    # any number may follow any word: at the edge of a block one neighbour tells nothing of it
    plausible = ~F.col("r.real") | ((F.col("pw") + F.col("wn") == 0) & (F.col("pc") + F.col("cn") >= CONTEXT_SUPPORT) & (~F.col("w").rlike(r"^\d+$") | ((F.col("prev") != "") & (F.col("next") != ""))))
    best = u.filter(plausible).groupBy("oid", "doc_id", "page_num", "b", "l", "tok").agg(F.max_by("r.c", F.struct(score, F.col("r.c"))).alias("c")).drop("oid")
    mis = best.unionByName(sure).unionByName(numbers)
    # a misread half of a divided word stands on the line its site is in
    halves_mis = divided.filter(F.col("broken") & ~F.col("whole") & F.col("fix").isNotNull())
    here = F.col("fix.site") < F.length("left")
    broken_mis = halves_mis.select("doc_id", F.when(here, F.col("page_num")).otherwise(F.col("np")).alias("page_num"), F.when(here, F.col("b")).otherwise(F.col("nb")).alias("b"), F.when(here, F.col("l")).otherwise(F.col("nl")).alias("l"), F.concat("left", "right").alias("tok"), F.col("fix.c").alias("c"))
    return stored(mis.unionByName(broken_mis), "misread"), divided


def found_lines(layout: DataFrame, page_text: DataFrame, pdf_meta: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_no, line_no, kind): running, break and misread lines of scanned pages."""
    linked = with_running(pages(layout, page_text, pdf_meta))
    cnt = counts(linked)
    mis, divided = repairs(linked, cnt)
    running = linked.filter("scanned").select("doc_id", "page_num", F.explode(F.arrays_zip("lines", "run")).alias("z")).filter("z.run").select("doc_id", "page_num", F.col("z.lines.b").alias("b"), F.col("z.lines.l").alias("l"), F.lit("running").alias("kind"))
    breaks = divided.filter("broken").select("doc_id", "page_num", "b", "l", F.lit("break").alias("kind"))
    m = mis.select("doc_id", "page_num", "b", "l", F.lit("misread").alias("kind"))
    m = m.join(linked.filter("scanned").select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")
    out = running.unionByName(breaks).unionByName(m).distinct()
    return out.select("doc_id", "page_num", F.col("b").alias("block_no"), F.col("l").alias("line_no"), "kind")


def capital_like(model: str, word: str) -> str:
    """``word`` in the letter case of ``model``."""
    return word.upper() if len(model) > 1 and model.isupper() else word.capitalize() if model[:1].isupper() else word


def body_paragraphs(layout: DataFrame, page_text: DataFrame, pdf_meta: DataFrame, repair: bool = True) -> DataFrame:
    """(doc_id, page_num, block_no, text): body blocks without running lines, divided words joined, and on scanned
    pages misread words replaced. A block that a page break or another block cuts within a word carries the rest."""
    linked = with_running(pages(layout, page_text, pdf_meta))
    return paragraphs_of(linked, *(repairs(linked, counts(linked)) if repair else (None, None)))


def paragraphs_of(linked: DataFrame, mis: DataFrame | None = None, divided: DataFrame | None = None) -> DataFrame:
    x = linked.select("doc_id", "page_num", "lines", "run", "nxt", "prv", "scanned")
    if mis is not None:
        fixes = mis.groupBy("doc_id", "page_num").agg(F.collect_set(F.struct("b", "l", "tok", "c")).alias("fixes"))
        own = divided.filter(~F.col("broken")).groupBy("doc_id", "page_num").agg(F.collect_set(F.struct("b", "l")).alias("own"))
        x = x.join(fixes, ["doc_id", "page_num"], "left").join(own, ["doc_id", "page_num"], "left")
    else:
        x = x.withColumn("fixes", F.lit(None).cast("array<struct<b:int,l:int,tok:string,c:string>>")).withColumn("own", F.lit(None).cast("array<struct<b:int,l:int>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bt in batches:
            rows = []
            docs, numbers, all_fixes, all_own = (bt.column(c).to_pylist() for c in ("doc_id", "page_num", "fixes", "own"))
            for row, bs, ls, texts, nxt, prv in _flat_pages(bt):
                doc, page, fixes, own = docs[row], numbers[row], all_fixes[row], all_own[row]
                change: dict[tuple[int, int], list[tuple[str, str]]] = {}
                whole: dict[str, str] = {}
                for f in fixes or ():
                    change.setdefault((f["b"], f["l"]), []).append((f["tok"], f["c"]))
                    whole[f["tok"]] = f["c"]
                kept = {(o["b"], o["l"]) for o in own or ()}
                blocks: dict[int, str] = {}
                carry = prv is not None and _ends_divided(prv)
                for k, text in enumerate(texts):
                    t = text.strip(" ")
                    if carry:  # its first word went to the line before
                        t = _TOKEN.sub("", t, count=1).lstrip(" ") if _TOKEN.match(t) else t
                    carry = False
                    for a, c in change.get((bs[k], ls[k]), ()):
                        t = re.sub(rf"(?<!\w){re.escape(a)}(?!\w)", capital_like(a, c), t)
                    if _ends_divided(text):
                        nx = texts[k + 1] if k + 1 < len(texts) else nxt["t"] if nxt else ""
                        m = _TOKEN.match(nx.lstrip(" "))
                        if m:
                            carry = True
                            if (bs[k], ls[k]) in kept:
                                t += m[0]
                            else:
                                left = _TOKEN.findall(t)[-1] if _TOKEN.findall(t) else ""
                                joined = left + m[0]
                                t = t[: len(t) - 1 - len(left)] + (capital_like(joined, whole[joined]) if joined in whole else joined)
                            rest = nx.lstrip(" ")[m.end() :]
                            t += re.match(r"[^\s\w]*", rest)[0]
                    blocks[bs[k]] = f"{blocks[bs[k]]} {t}" if bs[k] in blocks else t
                rows += [(doc, page, b, " ".join(t.split())) for b, t in blocks.items()]
            c = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.string())], names=["doc_id", "page_num", "block_no", "text"])

    return x.mapInArrow(run, "doc_id bigint, page_num int, block_no int, text string").filter(F.col("text") != "")


__all__ = ["body_paragraphs", "counts", "edit_cost", "found_lines", "page_tokens", "pages", "paragraphs_of", "readings", "repairs", "with_running"]
