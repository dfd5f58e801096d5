"""Problem 3: text decoded with another encoding than its own; found and restored by expectation-maximization."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import join_sized, stored

# Encodings that text is wrongly read with, and its own encodings.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "iso8859_2", "cp1250", "cp1251", "iso8859_15", "cp1254")
OWN = ("utf-8", "cp1252", "mac_roman", "cp850")
IDENTITY, LOST = "none", "lost"
#: From which gain a token counts alone, where only a part of a record is garbled; the most one token may count (logs).
MIN_GAIN, MAX_GAIN, SYMBOL_GAIN = 1.2, 6.0, 2.0
#: Weight in records of the characters of a token beside its own frequency, and what is added to every frequency.
CHARACTERS, ADDED = 2.0, 0.05
#: Times the evidence is counted: at first over all records, then each with its posterior to be clean.
PASSES = 2
#: Rounds of expectation-maximization; weight in records of the prior; prior share of each wrong chain.
ROUNDS, PRIOR_RECORDS, CHAIN_SHARE = 3, 20.0, 0.002

_CODECS: dict[str, dict[str, int]] = {}


def _table(codec: str) -> dict[str, int]:
    """Character to byte; bytes the codec leaves undefined stand for themselves, as lenient readers have it."""
    if codec not in _CODECS:
        t = {}
        for b in range(256):
            try:
                t[bytes([b]).decode(codec)] = b
            except UnicodeDecodeError:
                t[chr(b)] = b
        _CODECS[codec] = t
    return _CODECS[codec]


def undo(text: str, read_as: str, own: str) -> str | None:
    """``text`` read again from its bytes with its own encoding; null where that cannot be."""
    t = _table(read_as)
    try:
        raw = bytes(t[c] for c in text)
    except KeyError:
        return None
    try:
        return raw.decode(own)
    except UnicodeDecodeError:
        return None


def chains() -> list[tuple[str, tuple[tuple[str, str], ...]]]:
    """(name, steps to undo): one wrong reading, or UTF-8 wrongly read twice."""
    one = [(f"{own}>{r}", ((r, own),)) for own in OWN for r in READ_AS if r != own and not (own == "cp1252" and r in ("latin-1", "iso8859_15", "cp1254"))]
    two = [(f"utf-8>{a}>utf-8>{b}", ((b, "utf-8"), (a, "utf-8"))) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")]
    return one + two


def repair(text: str, chain: str) -> str | None:
    """``text`` restored under a chain of :func:`chains`; parts with only ASCII stay; null where it cannot be undone."""
    steps = dict(chains()).get(chain)
    if steps is None:
        return text if chain == IDENTITY else None
    for read_as, own in steps:
        got = undo(text, read_as, own)
        if got is None:
            return None
        text = got
    return text


_EDGE = re.compile(r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$")
_NUMBER = re.compile(r"\d+")


_CAPITAL_NAME = re.compile(r"[A-Z][a-z]+")


def token_key(token: str) -> str:
    """What is counted: lower case, numbers as 0, plain capitalised names as x, without ASCII punctuation at the edges."""
    t = _CAPITAL_NAME.sub("x", token) if any(ord(c) > 127 and not c.isalpha() for c in token) else token
    return _NUMBER.sub("0", _EDGE.sub("", t)).lower()


def visible_tokens(web_in: DataFrame) -> DataFrame:
    """(page_id, source, token) for distinct tokens with a character beyond ASCII or a character reference.

    A source is the host with the declared encoding and the field, ``body`` (visible text) or ``title``."""
    body = F.regexp_replace(F.regexp_extract("html", r"(?is)<body\b[^>]*>(.*)$", 1), r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>", " ")
    body = F.when(body != "", body).otherwise(F.regexp_replace("html", r"<[^>]*>", " "))
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)

    def tokens(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]*(?:[^\x00-\x7f]|&#?\w+;)[^ \t\r\n]*"), F.lit(0)))

    host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce("url_final", "url"), r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")
    d = web_in.filter(F.col("html").isNotNull()).select(
        "page_id", F.concat_ws("|", host, F.lower("encoding")).alias("source"), F.explode(F.array(F.struct(F.lit("body").alias("field"), tokens(body).alias("ts")), F.struct(F.lit("title").alias("field"), tokens(title).alias("ts")))).alias("f")
    )
    return d.select("page_id", F.concat_ws("|", "source", "f.field").alias("source"), F.explode("f.ts").alias("token"))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = chains()
    for b in batches:
        ts, own, cs, ks, gains = [], [], [], [], []
        for token in b.column("token").to_pylist():
            plain = _html.unescape(token)
            odd = [c for c in plain if ord(c) > 127]
            if not odd:
                continue
            ts.append(token)
            own.append(token_key(plain))
            cs.append(IDENTITY)
            ks.append(token_key(plain))
            gains.append(MAX_GAIN)
            if "�" in plain:
                ts.append(token)
                own.append(token_key(plain))
                cs.append(LOST)
                ks.append(None)
                gains.append(MAX_GAIN)
                continue
            solid = MAX_GAIN if len(token_key(plain)) > 1 else SYMBOL_GAIN
            for name, steps in known:
                fixed: str | None = plain
                for read_as, of in steps:
                    fixed = undo(fixed, read_as, of) if fixed is not None else None
                if fixed is None or any(c < " " or "\x7f" <= c <= "\x9f" for c in fixed):
                    continue  # no row: the chain cannot have made this token
                ts.append(token)
                own.append(token_key(plain))
                cs.append(name)
                ks.append(token_key(fixed))
                gains.append(solid)
        yield pa.RecordBatch.from_arrays([pa.array(ts, pa.string()), pa.array(own, pa.string()), pa.array(cs, pa.string()), pa.array(ks, pa.string()), pa.array(gains, pa.float64())], names=["token", "own", "chain", "key", "cap"])


def token_evidence(cand: DataFrame, counted: DataFrame) -> DataFrame:
    """Stored (token, chain, gain): log ratio of the frequency of the repaired token to that of the token as it stands,
    positive or negative; 0 where the chain changes nothing. ``counted`` are the pages of each token.

    A token does not speak for itself, so one page is taken off its own frequency. Words that are rare or never seen
    are judged by their characters beyond ASCII too, as the rest of the word is the same before and after repair."""

    def characters(c: str) -> Column:
        return F.trim(F.regexp_replace(c, "[\\x00-\\x7f]+", " "))

    freq = stored(cand.filter(F.col("chain") == IDENTITY).join(counted, "token").groupBy("key").agg(F.sum("n").alias("n")), "frequency")
    total = freq.agg(F.sum("n")).first()[0] or 1.0
    odd = stored(freq.groupBy(characters("key").alias("odd")).agg((F.sum("n") * (CHARACTERS / total)).alias("w")), "characters")
    known = join_sized(freq.withColumn("odd", characters("key")), odd, ["odd"]).select(F.col("key").alias("own"), (F.greatest(F.col("n") - 1, F.lit(0.0)) + F.col("w") + ADDED).alias("n_own"))
    wrong = cand.filter(F.col("chain") != IDENTITY).withColumn("odd", characters("key"))
    both = join_sized(join_sized(join_sized(wrong, stored(known, "own"), ["own"]), freq, ["key"], "left"), odd, ["odd"], "left")
    ratio = F.log((F.coalesce("n", F.lit(0.0)) + F.coalesce("w", F.lit(0.0)) + ADDED) / F.col("n_own"))
    # C1 controls and lost characters belong to no text: they count even where no frequent word is behind them
    control = F.col("own").rlike("[\\x{80}-\\x{9f}]") & F.col("n").isNotNull()
    gain = F.when(F.col("chain") == LOST, F.col("cap")).when(F.col("key") == F.col("own"), 0.0).when(control, F.greatest(ratio, F.lit(3.0))).otherwise(ratio)
    return stored(both.select("token", "chain", F.greatest(F.least(gain, "cap"), F.lit(-MAX_GAIN)).alias("gain")), "evidence")


def _scores(tokens: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stored (page_id, source, chain, score): log ratio of each chain that speaks for a record by some token, over all
    tokens of the record, for and against: the best of all of it being garbled, half of it, and only what stands out."""
    group = ["page_id", "source", "chain"]

    def sums(gain: Column) -> list[Column]:
        return [F.sum(gain).alias("whole"), F.sum(F.log((F.exp(gain) + 1) / 2)).alias("half"), F.sum(F.when(gain >= MIN_GAIN, gain).otherwise(0.0)).alias("part")]

    plus = stored(join_sized(tokens, stored(evidence.filter("gain > 0"), "for"), ["token"]).groupBy(*group).agg(*sums(F.col("gain"))), "for")
    # negative evidence changes only what has some for it: other chains are below any prior
    asked = plus.filter(F.col("chain") != LOST).select(*group)
    pairs = tokens.join(asked, ["page_id", "source"])
    gain = F.coalesce("gain", F.lit(-MAX_GAIN))
    minus = pairs.join(evidence, ["token", "chain"], "left").filter(F.coalesce("gain", F.lit(-1.0)) < 0).groupBy(*group).agg(*sums(gain))
    parts = ("whole", "half", "part")
    both = plus.unionByName(minus).groupBy(*group).agg(*[F.sum(c).alias(c) for c in parts])
    return stored(both.select(*group, F.greatest(*parts).alias("score")), "scores")


def record_posteriors(web_in: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, source, chain, posterior, restorable): the chain of each record with weak or strong evidence, with
    the posterior that the text is garbled at all.

    The latent chain of a record has a prior per source that expectation-maximization learns over all of the source's
    records, so that weak evidence counts more where other records of the source show the same chain. Frequencies are
    counted again with each record's posterior to be clean, so that a form does not look ordinary because many garbled
    records have it."""
    tokens = stored(visible_tokens(web_in).distinct(), "visible")
    counted = stored(tokens.groupBy("token").agg(F.count("*").cast("double").alias("n")), "tokens")
    cand = stored(counted.select("token").mapInArrow(_candidates, "token string, own string, chain string, key string, cap double"), "candidates")
    records = stored(tokens.select("page_id", "source").distinct().groupBy("source").agg(F.count("*").alias("records")), "sources")
    clean = counted
    for k in range(PASSES):
        post = stored(_learned(_scores(tokens, token_evidence(cand, clean)), records, rounds), "posteriors")
        if k < PASSES - 1:
            garbled = tokens.join(post.groupBy("page_id", "source").agg(F.sum("p").alias("p")), ["page_id", "source"]).groupBy("token").agg(F.sum("p").alias("p"))
            clean = stored(counted.join(garbled, "token", "left").select("token", F.greatest(F.col("n") - F.coalesce("p", F.lit(0.0)), F.lit(0.0)).alias("n")), "clean")
    best = post.groupBy("page_id", "source").agg(F.max_by("chain", "p").alias("chain"), F.sum("p").alias("posterior"))
    return best.withColumn("restorable", F.col("chain") != LOST)


def _learned(score: DataFrame, records: DataFrame, rounds: int) -> DataFrame:
    """Posteriors of the scores under priors per source and chain, learned in ``rounds``."""
    prior: Column = F.log(F.lit(CHAIN_SHARE))
    post = _posterior(score.withColumn("prior", prior))
    for _ in range(rounds):
        shares = post.groupBy("source", "chain").agg(F.sum("p").alias("p"))
        learned = shares.join(records, "source").select("source", "chain", F.log((F.col("p") + CHAIN_SHARE * PRIOR_RECORDS) / (F.col("records") + PRIOR_RECORDS)).alias("learned"))
        post = _posterior(join_sized(score, stored(learned, "priors"), ["source", "chain"], "left").withColumn("prior", F.coalesce("learned", prior)).drop("learned"))
    return post


def _posterior(scored: DataFrame) -> DataFrame:
    """Adds p, the posterior of each wrong chain against the others and against none (score and log prior about 0). A
    record has at most as many rows as there are chains, so one window over it gives the sum."""
    x = scored.withColumn("x", F.col("score") + F.col("prior"))
    own = W.partitionBy("page_id", "source")
    x = x.withColumn("top", F.greatest(F.max("x").over(own), F.lit(0.0))).withColumn("e", F.exp(F.col("x") - F.col("top")))
    return x.withColumn("z", F.sum("e").over(own) + F.exp(-F.col("top"))).select("page_id", "source", "chain", "score", (F.col("e") / F.col("z")).alias("p"))


def garbled_records(web_in: DataFrame, least: float = 0.5) -> DataFrame:
    """(page_id, chain, posterior, restorable) of records whose text was read with a wrong encoding.

    Null html gives no row; records delivered twice give one row."""
    return record_posteriors(web_in).filter(F.col("posterior") >= least).groupBy("page_id").agg(F.max_by("chain", "posterior").alias("chain"), F.max("posterior").alias("posterior"), F.max("restorable").alias("restorable"))


def restore_text(text: str | None, chain: str | None) -> str | None:
    """Restore the garbled runs of a text under a chain; runs the chain cannot undo stay as they are."""
    if not text or chain in (None, IDENTITY, LOST):
        return text

    def one(m: re.Match) -> str:
        got = repair(m[0], chain)
        return m[0] if got is None or any(c < " " or "\x7f" <= c <= "\x9f" for c in got) else got

    return re.sub(r"[^\x00-\x7f]+(?:[ -~]?[^\x00-\x7f]+)*", one, _html.unescape(text) if "&" in text and re.search(r"&[A-Z#]", text) else text)


def restored_records(web_in: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(page_id, chain, posterior, restorable, html): the garbled records with their html restored where it can be.

    A run of characters is restored under the record's chain; a run that this chain cannot undo stays as it is, and so does
    all of a record whose characters are lost. ``records`` are those of :func:`garbled_records`, else they are looked for.
    A record delivered twice has one row."""
    found = stored(garbled_records(web_in), "garbled") if records is None else records
    src = join_sized(web_in.filter(F.col("html").isNotNull()).select("page_id", "html"), found, ["page_id"]).select("page_id", "chain", "posterior", "restorable", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = [restore_text(t, c) for t, c in zip(b.column("html").to_pylist(), b.column("chain").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names[:-1]], pa.array(html, pa.string())], names=b.schema.names)

    out = src.mapInArrow(run, "page_id bigint, chain string, posterior double, restorable boolean, html string")
    return out.groupBy("page_id").agg(*[F.max(c).alias(c) for c in ("chain", "posterior", "restorable", "html")])


__all__ = ["chains", "garbled_records", "repair", "restore_text", "restored_records", "token_key", "undo"]
