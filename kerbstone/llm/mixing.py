"""Mixing sources to target weights by distributed prefix sums over a hash-random order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbstone.llm.tokens import VOCABULARY, count_tokens
from kerbstone.runtime import materialise, salted_join

#: Rows of an equal range of the hash key, about; a range is a task's unit of sorting.
RANGE_ROWS = 200_000
#: Listed sources up to which their targets are broadcast.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """``chosen`` (doc_id, source, n_tokens, repeats) and ``shares`` per source: the target, the actual share of the
    mix and of the total it should have had, which is less where a source was too small."""

    chosen: DataFrame
    shares: DataFrame


def hash_key(seed: int, group: Column) -> Column:
    """A uniform number of 60 bits that any engine can recompute."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), group.cast("string"))), 1, 15), 16, 10).cast("long")


def prefix_sums(rows: DataFrame, group: str, key: str, tie: str, value: str, key_bits: int = 60) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over rows of the group with a smaller (key, tie).

    ``key`` is a uniform hash of ``key_bits`` bits, so its leading bits cut every group, however large, into
    ranges of even size, as many as the number of rows asks for. Rows are summed within a range; the sums of whole ranges are added from
    a table of one row per range and group.
    """
    bits = max(0, (rows.count() // RANGE_ROWS).bit_length())
    ranged = rows.withColumn("_range", F.shiftright(F.col(key), key_bits - bits).cast("long"))
    sums = ranged.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(group, "_range").orderBy(key, tie).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(offsets, [group, "_range"]).withColumn("before", F.col("_offset") + F.col("_local")).drop("_range", "_offset", "_local")


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 42) -> Mix:
    """Documents with repeats so that each source has its share of as many tokens as all documents hold.

    A source gives whole rounds of all its documents, then those first in a hash-random order up
    to the exact remainder: the cut falls where the total is nearest to it (of two equally near,
    the longer). No document is used more than ``max_repeats`` times; a source too small for its
    share gives that much and its shortfall shows. Documents of no listed source count in the
    total only. A doc_id delivered again counts once. Null or negative shares count as 0, null
    repeats as 1; a source listed twice has the sum of its shares and the larger cap.
    """
    spark = documents.sparkSession
    counted = count_tokens(documents, vocabulary).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.source", "d.n_tokens")
    sized = materialise(counted.withColumn("key", hash_key(seed, F.col("doc_id"))), "sized")
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()["t"]
    have = sized.where("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    # one row per listed source
    plan = wanted.join(have, "source", "left").fillna(0, ["available"]).withColumn("budget", F.col("target_share") * F.lit(float(total)))
    rounds = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats").cast("long"))).otherwise(F.lit(0))
    plan = plan.withColumn("rounds", rounds).withColumn("rest", F.when(F.col("rounds") < F.col("max_repeats"), F.col("budget") - F.col("rounds") * F.col("available")).otherwise(F.lit(0.0)))
    plan = materialise(plan, "plan")
    use = plan.where("rest > 0 OR rounds > 0")
    few = plan.count() <= BROADCAST_SOURCES
    drawn = sized.join(F.broadcast(use), "source") if few else salted_join(sized, use, ["source"], "doc_id")
    drawn = prefix_sums(drawn, "source", "key", "doc_id", "n_tokens")
    extra = ((F.col("rest") > 0) & (F.col("before") + F.col("n_tokens") / 2 <= F.col("rest"))).cast("long")
    chosen = drawn.withColumn("repeats", F.col("rounds") + extra).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    shares = plan.join(used, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    grand = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # over the listed sources
    shares = shares.select("source", "target_share", F.when(grand > 0, F.col("tokens") / grand).otherwise(F.lit(0.0)).alias("actual_share"), (F.col("tokens") / F.lit(float(max(total, 1)))).alias("share_of_total"), F.col("budget").alias("target_tokens"), "tokens", "documents", "most_repeats")
    return Mix(chosen, shares)
