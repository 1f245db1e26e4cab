"""Bars: on clocks of time, ticks, volume, and the cleaning that comes before them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.scan import carry_last, running_total, with_previous


def keep_last(df: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Of rows with one key that with the largest seq: a map-side combined aggregate.

    One max_by per column: numbers stay in a hash aggregate, and columns that nobody reads are
    pruned. NULL keys are a key, rows without seq lose to all others and vanish if alone; of rows
    with one seq either is kept whole.
    """
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(*[F.max_by(F.col(f"`{c}`"), F.col(seq)).alias(c) for c in rest]).where(F.col(seq).isNotNull()).select(*df.columns)


def usable_ticks(ticks: DataFrame) -> DataFrame:
    """Kept ticks with a positive quote; NaN bid and ask as NULL."""
    no_nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    kept = keep_last(ticks.select("stream_id", "pair", "epoch", "tick_id", "quote", "bid", "ask"), ["stream_id", "epoch"], "tick_id")
    return kept.where(F.col("quote").isNotNull() & ~F.isnan("quote") & (F.col("quote") > 0)).select("stream_id", "pair", "epoch", "tick_id", "quote", no_nan("bid"), no_nan("ask"))


def time_bars(ticks: DataFrame, key: Sequence[str], seconds: int, price: str = "quote", closed: str = "left") -> DataFrame:
    """OHLC bars with the tick count n; empty bars are absent. t is the start (closed left) or the
    end of the bar (closed right, so that a tick on the border ends its bar)."""
    width = F.lit(seconds)
    t = F.floor(F.col("epoch") / width) * width if closed == "left" else F.ceil(F.col("epoch") / width) * width
    return ticks.groupBy(*key, t.alias("t")).agg(
        F.min_by(price, "epoch").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "epoch").alias("close"), F.count(price).alias("n")
    )


def slower_bars(bars: DataFrame, key: Sequence[str], seconds: int) -> DataFrame:
    """Bars of a slower clock from bars whose length divides it: the same as from the ticks."""
    t = F.floor(F.col("t") / seconds) * seconds
    return bars.groupBy(*key, t.alias("_t")).agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("n").alias("n")).withColumnRenamed("_t", "t")


def information_bars(ticks: DataFrame, key: Sequence[str], size: Column, threshold: float, price: str = "quote") -> DataFrame:
    """Bars that end when the cumulated size passes multiples of the threshold.

    The running total is taken over time shards with carried starts, so that a hot key is spread.
    """
    total = running_total(ticks, size, [F.col("epoch"), F.col("tick_id")], F.floor(F.col("epoch") / 3_600), key, "cum")
    bar = F.floor((F.col("cum") - size) / threshold)
    return total.groupBy(*key, bar.alias("bar")).agg(
        F.min("epoch").alias("t"), F.min_by(price, "epoch").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "epoch").alias("close"),
        F.sum(size).alias("size"), (F.sum(F.col(price) * size) / F.sum(size)).alias("vwap"), F.count("*").alias("n"), (F.max("epoch") - F.min("epoch")).alias("dur_s"),
    )


def change_counts(ticks: DataFrame, key: Sequence[str], seconds: int, price: str = "quote") -> DataFrame:
    """Ticks and price changes per bar; a change counts in the bar of its later tick."""
    changed = with_previous(ticks, key, "epoch", [F.col("epoch")], [price]).withColumn("_c", (F.col(price) != F.col(f"prev.{price}")).cast("int"))
    return changed.groupBy(*key, (F.floor(F.col("epoch") / seconds) * seconds).alias("t")).agg(F.count("*").alias("n_ticks"), F.coalesce(F.sum("_c"), F.lit(0)).alias("n_changes"))


def signed_flow(ticks: DataFrame, key: Sequence[str], seconds: int, price: str = "quote") -> DataFrame:
    """Tick-rule flow per bar: the sign of the last non-zero change carries on over equal prices."""
    order = [F.col("epoch")]
    signs = with_previous(ticks, key, "epoch", order, [price]).withColumn("_s", F.signum(F.col(price) - F.col(f"prev.{price}")))
    flow = carry_last(signs, key, "epoch", order, F.when(F.col("_s") != 0, F.col("_s")), "_sign").withColumn("_s", F.coalesce("_sign", F.lit(0.0)))
    return flow.groupBy(*key, (F.floor(F.col("epoch") / seconds) * seconds).alias("t")).agg(F.sum("_s").alias("flow"), F.sum(F.abs("_s")).alias("moves"))


def order_flow_imbalance(ticks: DataFrame, key: Sequence[str], seconds: int, bid_size: Column, ask_size: Column) -> DataFrame:
    """Event order-flow imbalance from quote and size changes of both sides, summed per bar."""
    q = ticks.withColumn("_bs", bid_size).withColumn("_as", ask_size)
    q = with_previous(q, key, "epoch", [F.col("epoch")], ["bid", "ask", "_bs", "_as"])
    was = lambda c: F.col(f"prev.{c}")
    buy = F.when(F.col("bid") >= was("bid"), F.col("_bs")).otherwise(0) - F.when(F.col("bid") <= was("bid"), was("_bs")).otherwise(0)
    sell = F.when(F.col("ask") <= was("ask"), F.col("_as")).otherwise(0) - F.when(F.col("ask") >= was("ask"), was("_as")).otherwise(0)
    e = q.withColumn("_e", F.when(was("bid").isNotNull() & was("ask").isNotNull(), buy - sell))
    return e.groupBy(*key, (F.floor(F.col("epoch") / seconds) * seconds).alias("t")).agg(F.coalesce(F.sum("_e"), F.lit(0)).cast("bigint").alias("ofi"), F.count("_e").alias("n_events"))
