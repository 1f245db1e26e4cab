"""Sources mixed to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.scan import running_total
from lodestream.runtime import cut

#: Least shards in which a source's shuffled texts are added up, and least slices of virtual time.
SHUFFLE_SHARDS, TIME_SLICES = 256, 512
#: Documents beyond which there are more of both.
SHARD_ROWS = 200_000


def latest_finish(sources: list[tuple[float, int, int]], budget: int) -> float:
    """A virtual time by which fair queueing has surely spent the budget; infinite if supply ends before.

    sources: (share, tokens offered, longest item) of each. At time t a source has finished at least
    min(share * t, offered) less one item. Only the rows up to this time need an order.
    """
    served = lambda t: sum(offered if share * t >= offered else max(share * t - longest, 0) for share, offered, longest in sources)
    high = 1.0
    while served(high) < budget:
        if all(share * high >= offered for share, offered, _ in sources):
            return float("inf")
        high *= 1.1
    return high


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) of documents (doc_id, source, text_key, n_tokens) mixed to target shares.

    targets: source_name, target_share, max_repeats. The budget is the tokens of all documents that
    have a source. Every distinct text of a target source (of equal texts the smallest doc_id) is
    offered max_repeats times, each repetition in another shuffled order; it finishes at virtual
    time = the source's tokens up to it / target_share. In order of that time over all sources the
    mixture runs until the budget is spent.

    chosen: doc_id, source_name, repeat, n_tokens. report: for each target source its target and
    actual share, the tokens it offers and needs, and whether it can reach its share. A NULL or
    unknown source is never drawn, a share of 0 or below neither. Without documents all are 0.
    """
    sized = cut(docs.where("source IS NOT NULL").select("doc_id", "source", "text_key", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    budget, n = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    shards, slices = max(SHUFFLE_SHARDS, n // SHARD_ROWS), max(TIME_SLICES, n // SHARD_ROWS)
    goals = targets.where("source_name IS NOT NULL").groupBy("source_name").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    texts = (
        sized.join(goals, sized["source"] == goals["source_name"])
        .groupBy("text_key").agg(F.min(F.struct("doc_id", "source_name", "n_tokens", "target_share", "max_repeats")).alias("t"))
        .select("t.*")
    )
    offers = texts.where("target_share > 0 AND max_repeats > 0 AND n_tokens > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("max_repeats"))))
    draw = F.xxhash64(F.lit(seed), F.col("repeat"), F.col("doc_id"))
    offers = cut(offers.withColumn("draw", draw))
    at = F.shiftrightunsigned("draw", 1)  # the place in the shuffled order, in [0, 2^63)
    place = F.col("repeat") * shards + F.floor(at / 2.0**63 * shards)
    queue = running_total(offers, F.col("n_tokens"), [at, F.col("doc_id")], place, ["source_name"], "own_tokens")
    finish = F.col("own_tokens") / F.col("target_share")
    queue = cut(queue.withColumn("finish", finish))
    # one row for each source of the targets, a fixed table
    known = queue.groupBy("source_name").agg(F.max("target_share").alias("share"), F.sum("n_tokens").alias("offered"), F.max("n_tokens").alias("longest"), F.max("finish").alias("finish")).collect()
    end = min(latest_finish([(r["share"], r["offered"], r["longest"]) for r in known], budget), max((r["finish"] for r in known), default=1.0))
    queue = queue.where(F.col("finish") <= end)
    slice_no = F.floor(F.col("finish") / end * (slices - 1))
    spent = running_total(queue, F.col("n_tokens"), [F.col("finish"), F.col("source_name"), F.col("doc_id"), F.col("repeat")], slice_no, out="spent")
    chosen = cut(spent.where(F.col("spent") <= budget).select("doc_id", "source_name", "repeat", "n_tokens"))
    supply = offers.groupBy("source_name").agg(F.sum("n_tokens").alias("offered_tokens"))
    got = chosen.groupBy("source_name").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_items"))
    total = chosen.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("mixture_tokens"))
    report = (
        goals.join(supply, "source_name", "left").join(got, "source_name", "left").join(F.broadcast(total))
        .select(
            "source_name", "target_share", "max_repeats",
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.coalesce(F.try_divide("tokens", "mixture_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("offered_tokens", F.lit(0)).alias("offered_tokens"), (F.col("target_share") * budget).alias("needed_tokens"),
            (F.coalesce("offered_tokens", F.lit(0)) >= F.col("target_share") * budget).alias("reachable"),
        )
    )
    return chosen, report
