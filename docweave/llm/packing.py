"""Problem 8: texts into containers of fixed capacity, by vector bin packing with the dot-product heuristic."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .tokens import with_token_counts

#: Items packed together in one task; the last containers of each such block may stay part empty.
BLOCK_ITEMS = 20_000
#: Limits of a container where its spec names none: segments, one for so many tokens of capacity and at least MIN_SEGMENTS;
#: loss-bearing tokens, this share of the capacity. Loss-bearing are all tokens of a text but those of its first line.
TOKENS_PER_SEGMENT, MIN_SEGMENTS, LOSS_SHARE = 128, 2, 0.99
#: Loss-bearing tokens count in steps of this share of their limit, rounded up, so that items of about equal demand are one class.
LOSS_STEP = 1 / 256


def pack(tokens: np.ndarray, capacity: int, separator: int = 0, segments: int | None = None, loss: np.ndarray | None = None, loss_capacity: int | None = None) -> np.ndarray:
    """Container number of each item, none larger than the capacity.

    Containers are filled one after another. Each takes, of the items that fit in every limit, the one whose demand
    vector (tokens, segments, loss-bearing tokens, as shares of the limits and weighted by the total demand) has the
    largest dot product with what is left of the container. Items of equal demand are one class, so a step costs the
    number of classes that fit, not of items. An item whose loss-bearing tokens alone are over their limit, but which fits
    the capacity, has a container of its own. Without ``loss`` all tokens but the first bear loss."""
    n = len(tokens)
    loss = np.maximum(tokens - 1, 0) if loss is None else np.asarray(loss)
    segments = segments or max(MIN_SEGMENTS, capacity // TOKENS_PER_SEGMENT)
    loss_capacity = loss_capacity or capacity
    out = np.full(n, -1, np.int64)
    alone = np.flatnonzero(loss > loss_capacity)
    out[alone] = np.arange(len(alone))
    rest = np.flatnonzero(loss <= loss_capacity)
    if not len(rest):
        return out
    step = max(1, int(loss_capacity * LOSS_STEP))
    steps = np.minimum(-(-loss[rest] // step) * step, loss_capacity)
    limits = np.array([capacity, segments, loss_capacity], float)
    demand = np.column_stack([tokens[rest], np.ones(len(rest)), steps]).astype(float)
    # classes in order of tokens; members of a class follow one another
    classes, at, count = np.unique(demand, axis=0, return_inverse=True, return_counts=True)
    order = np.argsort(at.ravel(), kind="stable")
    begin = np.r_[0, np.cumsum(count)[:-1]]
    left = count.copy()
    shares = classes / limits
    weight = (shares * count[:, None]).sum(0)
    weight /= weight.sum()
    scaled = shares * weight
    live = np.arange(len(classes))
    live_tokens, live_loss, live_scaled = classes[:, 0], classes[:, 2], scaled
    container = len(alone) - 1
    while len(live):
        container += 1
        room, extra = limits.copy(), 0
        while room[1] >= 1:
            fit = int(np.searchsorted(live_tokens, room[0] - extra, "right"))
            if not fit:
                break
            score = live_scaled[:fit] @ (room / limits)
            score[live_loss[:fit] > room[2]] = -1.0
            i = int(score.argmax())
            if score[i] < 0:
                break
            k = live[i]
            left[k] -= 1
            out[rest[order[begin[k] + left[k]]]] = container
            room -= classes[k]
            room[0] -= extra
            extra = separator
            if not left[k]:
                live, live_tokens, live_loss, live_scaled = (np.delete(x, i, 0) for x in (live, live_tokens, live_loss, live_scaled))
                if not len(live):
                    break
    return out


def _limit(specs: DataFrame, name: str) -> F.Column:
    return (F.col(name).cast("int") if name in specs.columns else F.lit(None).cast("int")).alias(name)


def containers(documents: DataFrame, specs: DataFrame, path: str | None = None) -> DataFrame:
    """(spec_id, container, position, doc_id, part, first_token, n_tokens, n_loss): where each text goes, for every spec.

    A text larger than the capacity is cut: its full parts fill containers of their own, the rest is packed like the
    others; no other text is cut. Blank or null texts have no tokens and no place. Specs without a positive capacity
    are left out; they may name max_segments and max_loss_tokens. ``documents`` may bring the loss-bearing tokens of each
    text as n_loss, as instruction data does; those of a cut text are taken to be its last. Else they are the tokens
    after the first line. Equal texts under several ids are packed each."""
    given = "n_loss" in documents.columns and dict(documents.dtypes)["n_loss"] in ("int", "bigint", "smallint", "tinyint")
    sized = with_token_counts(documents, ("doc_id", "n_loss") if given else ("doc_id",), path, prompt=not given)
    n_loss = F.least(F.greatest(F.coalesce(F.col("n_loss"), F.col("n_tokens")), F.lit(0)), F.col("n_tokens")) if given else F.col("n_tokens") - F.col("n_prompt")
    sized = stored(sized.select("doc_id", "n_tokens", n_loss.cast("int").alias("n_loss")), "tokens")
    rows = specs.filter(F.col("capacity_tokens") > 0).select("spec_id", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator_tokens"), _limit(specs, "max_segments"), _limit(specs, "max_loss_tokens"))
    # the specs are a fixed small table: each text goes into containers of every capacity
    names = ("spec_id", "capacity_tokens", "separator_tokens", "max_segments", "max_loss_tokens")
    each = [F.struct(*[F.lit(r[c]).cast("int").alias(c) for c in names]) for r in rows.collect()]
    none = F.array().cast("array<struct<" + ",".join(f"{c}:int" for c in names) + ">>")
    x = sized.filter(F.col("n_tokens") > 0).withColumn("spec", F.explode(F.array(*each) if each else none)).select("doc_id", "n_tokens", "n_loss", "spec.*")
    whole = F.floor(F.col("n_tokens") / F.col("capacity_tokens")).cast("int")
    parts = F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).cast("int")
    x = x.withColumn("full", F.when(F.col("n_tokens") > F.col("capacity_tokens"), whole).otherwise(0)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    x = x.withColumn("first_token", F.col("part") * F.col("capacity_tokens")).withColumn("size", F.least(F.col("capacity_tokens"), F.col("n_tokens") - F.col("first_token")))
    before = F.greatest(F.col("n_tokens") - F.col("n_loss") - F.col("first_token"), F.lit(0))
    x = x.withColumn("loss", F.greatest(F.col("size") - before, F.lit(0)))
    closed = x.filter(F.col("part") < F.col("full")).select("spec_id", F.concat_ws("-", F.lit("x"), "doc_id", "part").alias("container"), F.lit(0).alias("position"), "doc_id", "part", "first_token", F.col("size").alias("n_tokens"), F.col("loss").alias("n_loss"))
    blocks = max(1, -(-sized.count() // BLOCK_ITEMS))
    items = x.filter(F.col("part") >= F.col("full")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).select(*names, "block", "doc_id", "part", "first_token", "size", "loss")

    def run(tables: pa.Table) -> pa.Table:
        size, loss, doc = (tables.column(c).to_numpy() for c in ("size", "loss", "doc_id"))
        by = np.argsort(doc, kind="stable")
        cap, sep, block, segments, most = (tables.column(c)[0].as_py() for c in ("capacity_tokens", "separator_tokens", "block", "max_segments", "max_loss_tokens"))
        got = np.empty(len(size), np.int64)
        got[by] = pack(size[by], cap, sep, segments, loss[by], most or max(1, int(LOSS_SHARE * cap)))
        turn = np.lexsort((doc, got))
        position = np.empty(len(size), np.int32)
        begin = np.r_[0, np.flatnonzero(np.diff(got[turn])) + 1]
        position[turn] = np.arange(len(size)) - np.repeat(begin, np.diff(np.r_[begin, len(size)]))
        return pa.table({"spec_id": tables.column("spec_id"), "container": pa.array([f"{block}-{g}" for g in got]), "position": pa.array(position), "doc_id": tables.column("doc_id"), "part": tables.column("part"), "first_token": tables.column("first_token"), "n_tokens": tables.column("size"), "n_loss": tables.column("loss")})

    schema = "spec_id int, container string, position int, doc_id bigint, part int, first_token int, n_tokens int, n_loss int"
    return items.groupBy("spec_id", "block").applyInArrow(run, schema).unionByName(closed)


def fill_report(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, containers, items, tokens, separators, most_items, most_loss, fill): share of the capacity
    in use, by spec, and the largest number of items and of loss-bearing tokens in a container."""
    per = placed.groupBy("spec_id", "container").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"), F.sum("n_loss").alias("loss"))
    x = per.join(F.broadcast(specs), "spec_id")  # a fixed small table
    sep = (F.col("items") - 1) * F.coalesce("separator_tokens", F.lit(0))
    return x.groupBy("spec_id", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum(sep).alias("separators"), F.max("items").alias("most_items"), F.max("loss").alias("most_loss"), F.round((F.sum("tokens") + F.sum(sep)) / (F.count("*") * F.first("capacity_tokens")), 6).alias("fill")
    )


__all__ = ["containers", "fill_report", "pack"]
