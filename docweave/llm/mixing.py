"""Problem 9: records of several sources mixed to target shares of tokens, on a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored
from .tokens import with_token_counts

#: How strongly weights change from begin to end: the source with the largest share falls by this, the smallest rises.
SLOPE = 0.5
#: Records of a part by hash into which the running total of a source is cut, so that no task holds a source.
SLICE_RECORDS = 20_000
#: Rounds of handing on what capped sources cannot give.
ROUNDS = 32


def demands(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, available, demand, slope): tokens each source has to give.

    ``sizes`` (source, available) and ``targets`` are small fixed tables. A mix has ``total_tokens`` tokens, by
    default as many as its named sources hold once. A source gives its share but never more than max_repeats times
    what it has; the rest is handed on to the others in proportion, as long as some can give. Missing sources give
    nothing; null or negative shares count as 0, repeats under 1 as 1."""
    t = targets.groupBy("mix_id", "source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats"))
    x = t.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("double")).withColumn("cap", F.col("available") * F.col("max_repeats"))
    mix = W.partitionBy("mix_id")  # a mix names a bounded number of sources
    goal = F.lit(float(total_tokens)) if total_tokens else F.sum("available").over(mix)
    x = x.withColumn("goal", goal)
    # water level: the scale at which the capped demands add up to the goal, found by bisection over the few sources
    pairs = F.collect_list(F.struct("target_share", "cap")).over(mix)
    x = x.withColumn("ps", pairs)
    top = F.aggregate("ps", F.lit(0.0), lambda a, p: F.greatest(a, F.when(p["target_share"] > 0, p["cap"] / p["target_share"]).otherwise(0.0)))
    x = x.withColumn("lo", F.lit(0.0)).withColumn("hi", F.greatest(top, "goal"))

    def given(level: Column) -> Column:
        return F.aggregate("ps", F.lit(0.0), lambda a, p: a + F.least(p["target_share"] * level, p["cap"]))

    both = F.aggregate(
        F.sequence(F.lit(1), F.lit(2 * ROUNDS)),
        F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi")),
        lambda s, _: F.struct(F.when(given((s["lo"] + s["hi"]) / 2) < F.col("goal"), (s["lo"] + s["hi"]) / 2).otherwise(s["lo"]).alias("lo"), F.when(given((s["lo"] + s["hi"]) / 2) < F.col("goal"), s["hi"]).otherwise((s["lo"] + s["hi"]) / 2).alias("hi")),
    )
    x = x.withColumn("demand", F.least(F.col("target_share") * both["hi"], "cap"))
    # slopes with a demand-weighted sum of 0, so that the weights add up to one at every moment
    rank = F.when(F.count("*").over(mix) > 1, (F.rank().over(mix.orderBy("demand", "source")) - 1) / (F.count("*").over(mix) - 1)).otherwise(0.5)
    x = x.withColumn("raw", SLOPE * (1 - 2 * rank))
    mean = F.sum(F.col("raw") * F.col("demand")).over(mix) / F.sum("demand").over(mix)
    slope = F.when(F.col("demand") > 0, (F.col("raw") - mean) / (1 + F.abs(mean))).otherwise(0.0)
    return x.select("mix_id", "source", "target_share", "max_repeats", "available", "demand", slope.alias("slope"))


def position(q: Column, slope: Column) -> Column:
    """The moment in [0, 1] when a source with weight 1 + slope * (2t - 1) has given the share q of its tokens.

    Inverts q = t + slope * (t * t - t)."""
    root = (-(1 - slope) + F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * q, F.lit(0.0)))) / (2 * slope)
    return F.least(F.greatest(F.when(F.abs(slope) < 1e-9, q).otherwise(root), F.lit(0.0)), F.lit(1.0))


def schedule(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(order, demands). order: (mix_id, position, source, epoch, doc_id, n_tokens), sorted by range of position.

    In each epoch a source gives its records in another order by hash; the last epoch ends with the record that
    reaches the demand. The running total of a source's tokens gives each record its moment. Records without tokens
    or source are left out; a record is used at most max_repeats times."""
    sized = stored(with_token_counts(documents, ("doc_id", "source"), path=path).filter((F.col("n_tokens") > 0) & F.col("source").isNotNull()), "sizes")
    need = stored(demands(sized.groupBy("source").agg(F.sum("n_tokens").alias("available")), targets, total_tokens), "demands")
    use = need.filter(F.col("demand") > 0).select("mix_id", "source", "available", "demand", "slope", "max_repeats")
    x = sized.join(F.broadcast(use), "source")  # at most a row per row of the fixed targets; a shuffle would gather a source
    epochs = F.least(F.ceil(F.col("demand") / F.col("available")), F.col("max_repeats")).cast("int")
    x = x.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    # as many ranges of the hash as the records fill, however many there are
    slices = max(1, -(-sized.count() // SLICE_RECORDS))
    x = x.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "epoch", F.lit(seed)), 1)).withColumn("slice", F.floor(F.col("h") / F.lit(2.0**63) * slices).cast("int"))
    sums = x.groupBy("mix_id", "source", "epoch", "slice").agg(F.sum("n_tokens").alias("n"))
    before = W.partitionBy("mix_id", "source", "epoch").orderBy("slice")  # a row for SLICE_RECORDS records
    base = stored(sums.withColumn("base", F.coalesce(F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.lit(0)).drop("n"), "bases")
    x = x.join(F.broadcast(base) if base.count() <= 200_000 else base, ["mix_id", "source", "epoch", "slice"])
    inside = W.partitionBy("mix_id", "source", "epoch", "slice").orderBy("h", "doc_id")
    x = x.withColumn("given", F.col("epoch") * F.col("available") + F.col("base") + F.coalesce(F.sum("n_tokens").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.filter(F.col("given") < F.col("demand"))
    x = x.withColumn("position", position(F.col("given") / F.col("demand"), F.col("slope")))
    # stored, as the range sort reads it twice: once to find the ranges
    order = stored(x.select("mix_id", "position", "source", "epoch", "doc_id", "n_tokens"), "positions").orderBy("mix_id", "position", "source", "doc_id", "epoch")
    return order, need


def shares(order: DataFrame, need: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, records, distinct_records, most_repeats): what was reached.

    Sources named in a mix but missing have 0; shares are of all tokens of the mix."""
    per_doc = order.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t"))
    got = per_doc.groupBy("mix_id", "source").agg(F.sum("t").alias("tokens"), F.sum("k").alias("records"), F.count("*").alias("distinct_records"), F.max("k").alias("most_repeats"))
    x = need.select("mix_id", "source", "target_share").join(got, ["mix_id", "source"], "left").na.fill(0)
    total = F.sum("tokens").over(W.partitionBy("mix_id"))
    return x.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0)).select("mix_id", "source", "target_share", "actual_share", "tokens", "records", "distinct_records", "most_repeats")
