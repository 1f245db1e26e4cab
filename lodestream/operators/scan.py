"""Prefix scans over shards: the state that crosses a shard's border is computed from one
summary row per shard, so that no group of rows has to pass through one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    value: Column,
    order: Sequence[Column],
    shard: Column,
    keys: Sequence[str] = (),
    out: str = "running_total",
) -> DataFrame:
    """Inclusive running total of `value` in the order (shard, *order), per `keys`.

    `shard` must not decrease along the order. Shard sums are added up first (one row per shard,
    a number the caller bounds), then every shard is totalled on its own. NULL values count as 0;
    ties in `order` are summed in an arbitrary but whole order. An empty input gives no rows.
    """
    rows = df.withColumn("_shard", shard).withColumn("_value", F.coalesce(value, F.lit(0)))
    sums = rows.groupBy(*keys, "_shard").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_shard").alias("_start_shard"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    match.append(F.col("_shard") == F.col("_start_shard"))
    within = Window.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumn("_within", F.sum("_value").over(within)).join(starts, match)
    return joined.withColumn(out, F.col("_start") + F.col("_within")).drop(
        "_shard", "_value", "_start_shard", "_start", "_within", *[f"_k{i}" for i in range(len(keys))]
    )


def numbered(df: DataFrame, order: Sequence[Column], shard: Column, keys: Sequence[str] = (), out: str = "nth") -> DataFrame:
    """df with the rank (from 1) of each row in the order (shard, *order), per `keys`."""
    return running_total(df, F.lit(1), order, shard, keys, out)


def _carried(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[Column], value: Column, out: str, chunk_s: int, end: int) -> DataFrame:
    """out: the last non-NULL value of the rows up to `end` rows from here, over chunks of time."""
    rows = df.withColumn("_chunk", F.floor(F.col(ts) / chunk_s)).withColumn("_value", value)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    last = rows.withColumn("_place", F.struct(*order)).groupBy(*keys, "_chunk").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_place"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    carry = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_for"), before.alias("_carry"))
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_chunk").eqNullSafe(F.col("_for"))]
    near = F.last("_value", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, end))
    return rows.withColumn("_near", near).join(carry, match).withColumn(out, F.coalesce("_near", "_carry")).drop(
        "_chunk", "_value", "_near", "_for", "_carry", *[f"_k{i}" for i in range(len(keys))]
    )


def carry_last(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[Column], value: Column, out: str, chunk_s: int = 3_600) -> DataFrame:
    """df with the last non-NULL `value` up to and with each row (forward fill).

    Works by chunks of time with carried ends, so that no key's rows pass through one task. order
    must begin with ts and settle ties; rows without ts come first.
    """
    return _carried(df, keys, ts, order, value, out, chunk_s, 0)


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[Column], columns: Sequence[str], out: str = "prev", chunk_s: int = 3_600) -> DataFrame:
    """df with a struct of the columns of the row before each row, NULL for a key's first row."""
    return _carried(df, keys, ts, order, F.struct(*columns), out, chunk_s, -1)


def clipped_levels(df: DataFrame, key: str, ts: str, order: Sequence[str], shift: Column, low: Column, high: Column, start: float | None, before: bool, out: str = "level", block_s: int = 86_400) -> DataFrame:
    """(key, *order, out): the level after each row, or before it, of level = min(high, max(low, level + shift)).

    The level is carried through a key's whole series. Such moves compose to one of their kind, so
    every block of time is summed up on its own, the starts are found from one row per block, and
    the blocks are replayed from there. order must begin with ts and settle ties. start None means
    the middle of the first row's bounds. Rows with NULL key or time are left out.
    """
    kind = {name: field.dataType.simpleString() for name, field in ((f.name, f) for f in df.schema)}
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        key, *order, shift.cast("double").alias("_shift"), low.cast("double").alias("_low"), high.cast("double").alias("_high"), F.floor(F.col(ts) / block_s).alias("_block")
    )

    def moves(block: pa.Table) -> tuple[pa.Table, list[tuple[float, float, float]]]:
        block = block.sort_by([(c, "ascending") for c in order])
        return block, list(zip(*(block[c].to_pylist() for c in ("_shift", "_low", "_high"))))

    def sum_up(block: pa.Table) -> pa.Table:
        block, steps = moves(block)
        total, least, most = 0.0, -math.inf, math.inf
        for s, a, b in steps:
            total, least, most = total + s, min(b, max(a, least + s)), min(b, max(a, most + s))
        first = (steps[0][1] + steps[0][2]) / 2
        return pa.table({key: block[key][:1], "_block": block["_block"][:1], "_total": [total], "_least": [least], "_most": [most], "_first": [first]})

    def starts(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("_block")
        level, found = blocks["_first"][0].as_py() if start is None else start, []
        for s, a, b in zip(*(blocks[c].to_pylist() for c in ("_total", "_least", "_most"))):
            found.append(level)
            level = min(b, max(a, level + s))
        return pa.table({key: blocks[key], "_block": blocks["_block"], "_start": pa.array(found, pa.float64())})

    def replay(block: pa.Table) -> pa.Table:
        block, steps = moves(block)
        level, levels = block["_start"][0].as_py(), []
        for s, a, b in steps:
            was, level = level, min(b, max(a, level + s))
            levels.append(was if before else level)
        return block.select([key, *order]).append_column(out, pa.array(levels, pa.float64()))

    sums = rows.groupBy(key, "_block").applyInArrow(sum_up, f"{key} {kind[key]}, _block bigint, _total double, _least double, _most double, _first double")
    begun = sums.groupBy(key).applyInArrow(starts, f"{key} {kind[key]}, _block bigint, _start double")
    return rows.join(begun, [key, "_block"]).groupBy(key, "_block").applyInArrow(replay, ", ".join(f"{c} {kind[c]}" for c in (key, *order)) + f", {out} double")
