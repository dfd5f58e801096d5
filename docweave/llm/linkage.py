"""Problem 4: new batches against all history, by incremental record linkage.

A history is a folder that can be opened again: ``keys`` (blocking key and every record that has it, exact copies within a
batch only once), ``records`` (sketch, fields and text of each record) and ``roots`` (record, root), the union-find mapping
of the records that have links. All three only grow and are bucketed, keys by key, the others by id, so the history
is read in place and only what belongs to a batch is moved. Rows bear the number of their batch and count once its marker
in ``batches`` exists, so a batch is taken whole or not at all."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import join_sized, shared_dir, stored
from . import residue, scanned, web

#: Share of distinct three-word sequences that makes a repeat; words in a sequence.
SIMILAR, WORDS = 0.5, 3
#: Bands and rows of the minhash keys: of pairs at a similarity of 0.5, 0.6 and 0.65, 98, 99.98 and 99.999 % share a key.
BANDS, ROWS = 60, 4
#: Bytes of the sketch, and the share of equal ones under which a pair is not looked at further; 0.5 is 4 deviations above.
SKETCH, SKETCH_LEAST = 128, 0.33
#: Rounds of expectation-maximization over agreement patterns.
ROUNDS = 20
FIELDS = ("title", "author", "sha", "lang", "close")

RECORD = "pdf int, id bigint, lote int, title string, author string, sha string, lang string, words string, sketch binary, digest binary, keys array<bigint>"

# Characters recognition confuses, one for each group.
_FOLDED = (b"eai1o5fh69", b"cnll0stbbg")
_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")
_FOLD = bytes.maketrans(b"\t\n\r\x0b\x0c" + _FOLDED[0], b"     " + _FOLDED[1])
_OUT = bytes(b for b in range(128) if b not in _KEPT + b" \t\n\r\x0b\x0c")
# scripts written without spaces give a word a character
_WORD = re.compile("[\u3040-\u30ff\u3400-\u9fff]|[^\\W_\u3040-\u30ff\u3400-\u9fff]+")


def normal_words(text: str, damaged: bool) -> list[str]:
    """Words in lower case. Of text mostly in Latin letters only the ASCII letters and digits count, so that punctuation,
    hyphens and a garbled encoding make no difference (nor do accents); for scanned text the characters that recognition
    confuses are folded into one. Text mostly in other scripts keeps all letters and digits."""
    low = text.lower()
    raw = low.encode("ascii", "ignore")
    if len(raw) < len(low):
        other = len(low) - len(raw)
        if other > len(raw) // 2 or 2 * other > len(raw.translate(None, _OUT + b" \t\n\r\x0b\x0c0123456789")):
            return _WORD.findall(low)
    if damaged:
        return raw.translate(_FOLD, _OUT).replace(b"rl", b"n").replace(b"ll", b"u").replace(b"cl", b"d").replace(b"rn", b"m").decode().split()
    return raw.translate(_SPACES, _OUT).decode().split()


class _Hashes(dict):
    """Hashes of words, each made once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


_hashes = _Hashes()


def _word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))


def sequences(ws: list[str]) -> np.ndarray:
    """Distinct hashes of the three-word sequences; of a shorter text, of all its words as one."""
    if not ws:
        return np.empty(0, np.uint64)
    h = _word_hashes(ws)
    with np.errstate(over="ignore"):
        if len(h) < WORDS:
            x = np.array([np.bitwise_xor.reduce(h * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(h), dtype=np.uint64))])
        else:
            x = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)) ^ (h[2:] * np.uint64(0x27D4EB2F165667C5) + np.uint64(0x85EBCA77C2B2AE63))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return np.unique(x)


_SLOTS = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
#: For an empty slot, the slots tried one after another; the same for all texts.
_TRIES = _RNG.integers(0, _SLOTS, (64, _SLOTS))


def signature(seq: np.ndarray) -> np.ndarray:
    """Minhash by one permutation: the least hash in each slot of the hash range; an empty slot takes the value of the
    first filled one in a sequence of its own (optimal densification), so that equal slots estimate the similarity."""
    slot = ((seq >> np.uint64(32)) * np.uint64(_SLOTS) >> np.uint64(32)).astype(np.int64)
    low = (seq & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    # seq is sorted, and so are the slots: the least value of each run
    begin = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    out = np.zeros(_SLOTS, np.uint32)
    full = np.zeros(_SLOTS, bool)
    out[slot[begin]] = np.minimum.reduceat(low, begin)
    full[slot[begin]] = True
    left = np.flatnonzero(~full)
    for t in range(len(_TRIES)):
        if not len(left):
            break
        to = _TRIES[t, left]
        ok = full[to]
        out[left[ok]] = out[to[ok]] ^ np.uint32(0x9E3779B9 * (t + 1) & 0xFFFFFFFF)
        left = left[~ok]
    if len(left):  # hardly any slot is filled
        out[left] = out[slot[begin[0]]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    s = sig.reshape(BANDS, ROWS).astype(np.uint64)
    k = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            k = (k ^ s[:, j]) * np.uint64(0x100000001B3)
            k ^= k >> np.uint64(31)
    return k.view(np.int64)


def similarity(a: str, b: str) -> float:
    """Share of the distinct three-word sequences of either text that both have."""
    x, y = sequences(a.split(" ") if a else []), sequences(b.split(" ") if b else [])
    n = len(np.intersect1d(x, y, assume_unique=True))
    return n / max(1, len(x) + len(y) - n)


def as_records(texts: DataFrame) -> DataFrame:
    """Records (RECORD) of (kind, id, lote, title, author, sha, lang, text); kind is ``pdf`` for scanned documents, else
    ``web``. Null text and text without any letter or digit make no record; a null lote is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sketches, digests, keys = [], [], [], []
            for pdf, text in zip(b.column("pdf").to_pylist(), b.column("text").to_pylist()):
                ws = normal_words(text, pdf == 1)
                sig = signature(seq) if len(seq := sequences(ws)) else np.zeros(BANDS * ROWS, np.uint32)
                words.append(" ".join(ws))
                digests.append(hashlib.blake2b(words[-1].encode("utf-8", "replace"), digest_size=16).digest())
                sketches.append((sig[:SKETCH] & np.uint32(0xFF)).astype(np.uint8).tobytes())
                keys.append(band_keys(sig) ^ np.int64(0x5DEECE66D if pdf else 0) if ws else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            cols = [b.column(c) for c in ("pdf", "id", "lote", "title", "author", "sha", "lang")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.string()), pa.array(sketches, pa.binary()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["pdf", "id", "lote", "title", "author", "sha", "lang", "words", "sketch", "digest", "keys"])

    pdf = F.coalesce((F.col("kind") == "pdf").cast("int"), F.lit(0)).alias("pdf")
    t = texts.filter(F.col("text").isNotNull() & (F.col("text") != "") & F.col("id").isNotNull()).select(pdf, "id", F.coalesce("lote", F.lit(0)).cast("int").alias("lote"), "title", "author", "sha", "lang", "text")
    return t.mapInArrow(run, RECORD).filter(F.size("keys") > 0)


def _clean(c: str) -> Column:
    s = F.lower(F.trim(F.col(c)))
    return F.when(s != "", s)


def web_texts(web_in: DataFrame, web_meta: DataFrame, common_words: DataFrame) -> DataFrame:
    """Article text of the pages that have one, each page once, with the fields of its metadata."""
    text = web.main_text(residue.real_articles(web.parsed_pages(web_in, common_words))).withColumnRenamed("page_id", "id").drop("title")
    meta = web_meta.groupBy(F.col("page_id").alias("id")).agg(F.min(_clean("titulo")).alias("title"), F.min(_clean("autor")).alias("author"), F.min(_clean("sha256_html")).alias("sha"), F.min(F.substring(_clean("idioma"), 1, 2)).alias("lang"))
    return text.join(meta, "id", "left").select(F.lit("web").alias("kind"), "id", "lote", "title", "author", "sha", "lang", "text")


def pdf_texts(layout: DataFrame, page_text: DataFrame, pdf_meta: DataFrame) -> DataFrame:
    """Body text of the documents without running lines, divided words joined, each document once."""
    linked = scanned.with_running(scanned.pages(layout, page_text, pdf_meta))
    paras = scanned.paragraphs_of(linked)
    text = paras.groupBy(F.col("doc_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "block_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    meta = pdf_meta.groupBy(F.col("doc_id").alias("id")).agg(F.min("lote").alias("lote"), F.min(_clean("title")).alias("title"), F.min(_clean("author")).alias("author"), F.min(_clean("sha256_pdf")).alias("sha"), F.min(F.substring(_clean("idioma"), 1, 2)).alias("lang"))
    return text.join(meta, "id", "left").select(F.lit("pdf").alias("kind"), "id", "lote", "title", "author", "sha", "lang", "text")


def learned_weights(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior, m, u): share of matches, and per field the chance to agree among matches and others, by
    expectation-maximization over the counted agreement patterns (at most 3**len(FIELDS) of them; -1: a field is null)."""
    k = len(FIELDS)
    prior, m, u = 0.5, np.full(k, 0.9), np.full(k, 0.1)
    if not patterns:
        return prior, m, u
    x = np.array([p for p, _ in patterns], float)
    n = np.array([c for _, c in patterns], float)
    here = x >= 0
    for _ in range(rounds):
        r = _match_probability(x, prior, m, u)
        prior = float(np.clip((r * n).sum() / n.sum(), 0.001, 0.999))
        for j in range(k):
            a, w = here[:, j], x[:, j] > 0
            m[j] = np.clip(((r * n)[a & w].sum() + 0.9) / ((r * n)[a].sum() + 1), 0.01, 0.99)
            u[j] = np.clip((((1 - r) * n)[a & w].sum() + 0.1) / (((1 - r) * n)[a].sum() + 1), 0.001, 0.95)
    return prior, m, u


def _match_probability(x: np.ndarray, prior: float, m: np.ndarray, u: np.ndarray) -> np.ndarray:
    lm = np.where(x > 0, np.log(m), np.where(x == 0, np.log(1 - m), 0)).sum(1) + math.log(prior)
    lu = np.where(x > 0, np.log(u), np.where(x == 0, np.log(1 - u), 0)).sum(1) + math.log(1 - prior)
    return 1 / (1 + np.exp(np.clip(lu - lm, -50, 50)))


class History:
    """Accepted records of all batches so far, in a folder. One writer at a time."""

    TABLES = {
        "keys": ("key bigint, pdf int, lote int, id bigint, batch int", "key"),
        "records": (RECORD + ", batch int", "id"),
        "roots": ("pdf int, id bigint, root_lote int, root_id bigint, batch int", "id"),
    }

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """Opens the history in ``path``, or begins one there. The number of buckets is that of its beginning, by default
        the session's shuffle partitions: the keys of a batch in one bucket should stay within some millions."""
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/docweave/history-{uuid.uuid4().hex}"
        self.buckets = int(self._read("buckets") or buckets or spark.conf.get("spark.sql.shuffle.partitions"))
        if self._read("buckets") is None:
            self._write("buckets", str(self.buckets))
        name = hashlib.md5(self.path.encode()).hexdigest()
        for table, (columns, key) in self.TABLES.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table, name)} ({columns}) USING parquet OPTIONS (compression 'zstd') CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{table}'")
        self.id = name

    @staticmethod
    def _name(table: str, of: str) -> str:
        return f"docweave_{table}_{of}"

    # markers

    def _fs(self, name: str):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _read(self, name: str) -> str | None:
        fs, path = self._fs(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        """Create a small file at once: it is written aside and renamed."""
        fs, aside = self._fs(f"{name}-{uuid.uuid4().hex}.new")
        out = fs.create(aside)
        out.write(bytearray(text.encode()))
        out.close()
        _, path = self._fs(name)
        if not fs.rename(aside, path):
            raise OSError(f"cannot write {path}")

    def _numbers(self, folder: str) -> list[int]:
        fs, path = self._fs(folder)
        if not fs.exists(path):
            return []
        return sorted(int(n) for x in fs.listStatus(path) if (n := x.getPath().getName()).isdigit())

    def batches(self) -> list[dict]:
        """What each accepted batch recorded: number, name, links."""
        return [json.loads(self._read(f"batches/{n}")) for n in self._numbers("batches")]

    # tables

    def _table(self, table: str, also: int | None = None) -> DataFrame:
        """Rows of the accepted batches, and of batch ``also``."""
        accepted = self._numbers("batches") + ([also] if also is not None else [])
        begun = [n for n in self._numbers("begun") if n not in accepted]
        df = self.spark.table(self._name(table, self.id))
        return df.filter(F.col("batch") <= max(accepted, default=-1)).filter(~F.col("batch").isin(begun)) if begun else df.filter(F.col("batch") <= max(accepted, default=-1))

    def _insert(self, table: str, df: DataFrame) -> None:
        columns, key = self.TABLES[table]
        df.select(*[c.split()[0] for c in columns.split(", ")]).repartition(self.buckets, key).write.insertInto(self._name(table, self.id))
        self.spark.catalog.refreshTable(self._name(table, self.id))  # df may be of another session

    def _roots(self) -> DataFrame:
        """(pdf, id, root) of the accepted batches: the newest of each record."""
        root = F.struct(F.col("root_lote").alias("lote"), F.col("root_id").alias("id"))
        return self._table("roots").groupBy("pdf", "id").agg(F.max_by(root, "batch").alias("root"))

    # batches

    def add(self, records: DataFrame, name: str | None = None) -> DataFrame:
        """Link a batch of records; its links are returned, (kind, a, b, match, similarity), b in history or in the batch.

        A batch whose ``name`` was accepted before gives its links again and changes nothing; records whose kind and id
        are known already are left out. What a batch that was broken off left behind is never read."""
        return self.add_all(records, [(name, None)])[0]

    def add_all(self, records: DataFrame, parts: list[tuple[str | None, Column | None]]) -> list[DataFrame]:
        """:meth:`add` for several batches (name, condition) out of ``records``, which is evaluated once."""
        done = {b["name"]: b["number"] for b in self.batches() if b["name"] is not None}
        first = 1 + max(self._numbers("begun"), default=-1)
        todo = [(first + i, *p) for i, p in enumerate(p for p in parts if p[0] not in done)]
        if todo:
            number = F.lit(None).cast("int")
            for n, part, when in todo:
                number = F.coalesce(F.when(when, n), number) if when is not None else F.lit(n)
                self._write(f"begun/{n}", part or "")
            new = records.withColumn("batch", number).filter(F.col("batch").isNotNull())
            if self._numbers("batches"):
                known = self._table("records").select("pdf", "id")
                new = new.join(known, ["pdf", "id"], "left_anti")
            self._insert("records", new)
            for n, part, _ in todo:
                self._link(n, part)
        mine = iter([n for n, _, _ in todo])
        return [self._links_of(done[name] if name in done else next(mine)) for name, _ in parts]

    def _links_of(self, n: int) -> DataFrame:
        x = self.spark.read.schema("pdf int, a bigint, b bigint, match double, similarity double").parquet(f"{self.path}/links/{n}")
        return x.select(_kind().alias("kind"), "a", "b", "match", "similarity")

    def _link(self, n: int, name: str | None) -> None:
        new = self._table("records", n).filter(F.col("batch") == n)
        # a record delivered twice, and exact copies: they meet the first of them only, in whose place the others have no keys
        once = new.groupBy("pdf", "id").agg(F.min("lote").alias("lote"), F.min("digest").alias("digest"))
        first = new.groupBy("pdf", "digest").agg(F.min(F.struct("lote", "id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
        copies = stored(once.join(first, ["pdf", "digest"]).filter(F.col("id") != F.col("first.id")).select("pdf", F.col("id").alias("a"), F.col("lote").alias("lote_a"), F.col("first.id").alias("b"), F.col("first.lote").alias("lote_b")), "copies")
        distinct = join_sized(new.select("pdf", "lote", "id", "keys"), copies.select("pdf", F.col("a").alias("id")), ["pdf", "id"], "left_anti")
        self._insert("keys", distinct.select(F.explode("keys").alias("key"), "pdf", "lote", "id", F.lit(n).alias("batch")))
        holders = stored(self._holders(n), "holders")
        fresh = holders.filter("is_new")
        heads = F.explode(F.array_distinct(F.array("head", "first_new")))
        pairs = fresh.select("pdf", F.col("id").alias("a"), F.col("lote").alias("lote_a"), heads.alias("h")).filter(F.col("a") != F.col("h.id")).select("pdf", "a", "lote_a", F.col("h.id").alias("b"), F.col("h.lote").alias("lote_b")).distinct()
        pairs = stored(pairs, "pairs")
        links = self._compared(pairs, n)
        sure = copies.select("pdf", "a", "lote_a", "b", "lote_b", F.lit(1.0).alias("match"), F.lit(1.0).alias("similarity"))
        links = links.unionByName(sure)
        roots = self._roots()
        changed = self._merged(roots, links)
        rest = stored(self._other_holders(holders, self._over(roots, changed), pairs), "pairs")
        if rest.limit(1).count():
            more = self._compared(rest, n)
            changed = self._over(changed, self._merged(self._over(roots, changed), more))
            links = links.unionByName(more)
        links.select("pdf", "a", "b", "match", "similarity").write.mode("overwrite").parquet(f"{self.path}/links/{n}")
        self._insert("roots", changed.select("pdf", "id", F.col("root.lote").alias("root_lote"), F.col("root.id").alias("root_id"), F.lit(n).alias("batch")))
        self._write(f"batches/{n}", json.dumps({"number": n, "name": name}))

    @staticmethod
    def _over(roots: DataFrame, new: DataFrame) -> DataFrame:
        """``roots`` with the rows of ``new`` in place of theirs."""
        return roots.join(new.select("pdf", "id"), ["pdf", "id"], "left_anti").unionByName(new)

    def _holders(self, n: int) -> DataFrame:
        """(key, pdf, id, lote, is_new, holders, head, first_new) of the keys of batch ``n`` with several holders. The keys
        of history are probed in their buckets and do not move."""
        every = self._table("keys", n)
        if self._numbers("batches"):
            asked = every.filter(F.col("batch") == n).select("key").distinct()
            every = every.join(asked.hint("shuffle_hash"), "key", "left_semi")
        node = F.struct("lote", "id")
        new = F.col("batch") == n
        crowded = every.groupBy("key").agg(F.count("*").alias("holders"), F.min(F.when(~new, node)).alias("head"), F.min(F.when(new, node)).alias("first_new")).filter(F.col("holders") > 1)
        crowded = crowded.withColumn("head", F.coalesce("head", "first_new"))
        return self._table("keys", n).join(crowded.hint("shuffle_hash"), "key").select("key", "pdf", "id", "lote", new.alias("is_new"), "holders", "head", "first_new")

    def _other_holders(self, holders: DataFrame, roots: DataFrame, pairs: DataFrame) -> DataFrame:
        """Pairs of a key with a new record that were not compared yet and are not in one cluster already. So of all
        holders of a key each two are compared or known to repeat the same; a group that its first record holds together
        gives no pair, and only a key of different texts gives one for each two of them."""
        x = holders.filter("holders > 2").select("key", "pdf", "id", "lote", "is_new")
        x = x.join(roots, ["pdf", "id"], "left").withColumn("root", F.coalesce("root.id", "id"))
        x = stored(x, "held")
        mixed = stored(x.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key"), "mixed")
        x = join_sized(x, mixed, ["key"], "left_semi")
        y = x.select("key", "pdf", F.col("id").alias("b"), F.col("lote").alias("lote_b"), F.col("root").alias("root_b"), F.col("is_new").alias("b_new"))
        x = x.filter("is_new").select("key", "pdf", F.col("id").alias("a"), F.col("lote").alias("lote_a"), F.col("root").alias("root_a"))
        both = x.join(y, ["key", "pdf"]).filter((F.col("root_a") != F.col("root_b")) & (~F.col("b_new") | (F.col("a") > F.col("b")))).select("pdf", "a", "lote_a", "b", "lote_b").distinct()
        return both.join(pairs.select("pdf", "a", "b"), ["pdf", "a", "b"], "left_anti").join(pairs.select("pdf", F.col("b").alias("a"), F.col("a").alias("b")), ["pdf", "a", "b"], "left_anti")

    def _compared(self, pairs: DataFrame, n: int) -> DataFrame:
        """Stored links (pdf, a, lote_a, b, lote_b, match, similarity) among pairs of records. Of the records in history
        only those in a pair leave their bucket."""
        wanted = pairs.select("pdf", F.col("a").alias("id")).union(pairs.select("pdf", F.col("b").alias("id"))).distinct()
        fields = ["title", "author", "sha", "lang", "sketch"]
        some = self._table("records", n).select("pdf", "id", *fields, "words").join(wanted, ["pdf", "id"], "left_semi")
        some = stored(some.dropDuplicates(["pdf", "id"]), "wanted")
        slim = some.select("pdf", "id", *fields)
        x = join_sized(pairs, slim.withColumnRenamed("id", "a"), ["pdf", "a"])
        x = join_sized(x, slim.select("pdf", F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in fields]), ["pdf", "b"])
        near = stored(self._scored(x).filter(F.col("agree") >= SKETCH_LEAST), "near")
        pattern = F.array(*[F.col(f"f_{f}") for f in FIELDS])
        patterns = near.groupBy(pattern.alias("p")).count().collect()  # at most 3**len(FIELDS) rows
        near = self._weighed(near, *learned_weights([(tuple(r.p), r["count"]) for r in patterns]))
        texts = some.select("pdf", "id", "words")
        t = near.join(texts.select("pdf", F.col("id").alias("a"), F.col("words").alias("wa")), ["pdf", "a"]).join(texts.select("pdf", F.col("id").alias("b"), F.col("words").alias("wb")), ["pdf", "b"])
        return stored(self._exact(t), "links")

    @staticmethod
    def _scored(x: DataFrame) -> DataFrame:
        def agree(c: str) -> Column:
            return F.when(F.col(c).isNull() | F.col(f"{c}_b").isNull(), -1).otherwise((F.col(c) == F.col(f"{c}_b")).cast("int"))

        fields = ("title", "author", "sha", "lang")
        x = x.select("pdf", "a", "lote_a", "b", "lote_b", *[agree(c).alias(f"f_{c}") for c in fields], "sketch", "sketch_b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch", "sketch_b"))
                same = (p == q).mean(1)
                keep = [*b.schema.names[:-2]]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array((same >= SIMILAR).astype(np.int32)), pa.array(same)], names=[*keep, "f_close", "agree"])

        kept = ", ".join(f"{n} {t}" for n, t in x.dtypes[:-2])
        return x.mapInArrow(run, f"{kept}, f_close int, agree double")

    @staticmethod
    def _weighed(near: DataFrame, prior: float, m: np.ndarray, u: np.ndarray) -> DataFrame:
        """Pairs with the probability to match under the learned weights; it is reported, the exact check decides."""
        log_odds: Column = F.lit(math.log(prior / (1 - prior)))
        for j, f in enumerate(FIELDS):
            c = F.col(f"f_{f}")
            log_odds = log_odds + F.when(c > 0, float(np.log(m[j] / u[j]))).when(c == 0, float(np.log((1 - m[j]) / (1 - u[j])))).otherwise(0.0)
        p = 1 / (1 + F.exp(-log_odds))
        return near.withColumn("match", p).select("pdf", "a", "lote_a", "b", "lote_b", "match")

    @staticmethod
    def _exact(t: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                s = [similarity(x, y) for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist())]
                keep = b.schema.names[:-2]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s, pa.float64())], names=[*keep, "similarity"])

        return t.select("pdf", "a", "lote_a", "b", "lote_b", "match", "wa", "wb").mapInArrow(run, "pdf int, a bigint, lote_a int, b bigint, lote_b int, match double, similarity double").filter(F.col("similarity") >= SIMILAR)

    @staticmethod
    def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
        """Union-find: of ``roots`` (pdf, id, root) the clusters that a link touches get the least (lote, id) in them. What
        comes back, stored, are only the records that are new or have another root."""
        ends = [links.select("pdf", F.col(x).alias("id"), F.struct(F.col(f"lote_{x}").alias("lote"), F.col(x).alias("id")).alias("own")) for x in "ab"]
        at = ends[0].union(ends[1]).distinct().join(roots, ["pdf", "id"], "left").select("pdf", "id", F.coalesce("root", "own").alias("root"), F.col("root").isNotNull().alias("known"))
        at = stored(at, "at")
        # edges between roots; least labels spread along them, two steps a round
        e = links.select("pdf", "a", "b").join(at.select("pdf", F.col("id").alias("a"), F.col("root").alias("x")), ["pdf", "a"]).join(at.select("pdf", F.col("id").alias("b"), F.col("root").alias("y")), ["pdf", "b"]).filter(F.col("x") != F.col("y")).select("pdf", "x", "y").distinct()
        edges = stored(e.union(e.select("pdf", F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
        # in the first round a star, which most clusters are, has its least label
        label = stored(edges.groupBy("pdf", "x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
        moved = 1
        while moved:
            spread = edges.join(label.select("pdf", F.col("x").alias("y"), F.col("label").alias("l")), ["pdf", "y"]).groupBy("pdf", "x").agg(F.min("l").alias("l"))
            step = label.join(spread, ["pdf", "x"]).select("pdf", "x", F.col("label").alias("old"), F.least("label", "l").alias("label"))
            jump = label.select("pdf", F.col("x").alias("label"), F.col("label").alias("far"))
            step = step.join(jump, ["pdf", "label"], "left").select("pdf", "x", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
            seen = Observation("moved")
            label = stored(step.observe(seen, F.count_if(F.col("label") != F.col("old")).alias("n")), "labels").drop("old")
            moved = seen.get["n"]
        label = label.filter(F.col("label") != F.col("x")).withColumnRenamed("x", "root")
        # the ends of links, and the members of clusters whose root got another
        new = at.join(label, ["pdf", "root"], "left").filter(~F.col("known") | F.col("label").isNotNull()).select("pdf", "id", F.coalesce("label", "root").alias("root"))
        others = roots.join(label, ["pdf", "root"]).select("pdf", "id", F.col("label").alias("root"))
        return stored(new.unionByName(others).distinct(), "roots")

    def representatives(self) -> DataFrame:
        """(record_kind, id, representative) of the records that repeat another one."""
        return self._roots().filter(F.col("id") != F.col("root.id")).select(_kind().alias("record_kind"), "id", F.col("root.id").alias("representative"))


def _kind() -> Column:
    return F.when(F.col("pdf") == 1, "pdf").otherwise("web")


def link_batches(texts: DataFrame, path: str | None = None, waiting: bool = True) -> History:
    """Add the batches of ``texts`` to the history in ``path``, in order of ``lote``: the first, then those that wait in
    one step, or without ``waiting`` one after another; the clusters are the same."""
    history = History(texts.sparkSession, path)
    lotes = sorted(r.lote for r in texts.select(F.coalesce("lote", F.lit(0)).alias("lote")).distinct().collect()) if not waiting else []
    lote = F.col("lote")
    history.add_all(as_records(texts), [("0", lote <= 0), ("waiting", lote > 0)] if waiting else [(str(x), lote == x) for x in lotes])
    return history


def repeats(web_in: DataFrame, web_meta: DataFrame, layout: DataFrame, page_text: DataFrame, pdf_meta: DataFrame, common_words: DataFrame) -> DataFrame:
    """(record_kind, id_a, id_b): each repeat with the record it repeats, the smaller id first."""
    history = link_batches(web_texts(web_in, web_meta, common_words).unionByName(pdf_texts(layout, page_text, pdf_meta)))
    return history.representatives().select("record_kind", F.least("id", "representative").alias("id_a"), F.greatest("id", "representative").alias("id_b"))
