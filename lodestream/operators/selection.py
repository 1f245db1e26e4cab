"""Selection and splits: non-overlapping picks, purged cross-validation, blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators.scan import running_total
from lodestream.runtime import cut, written


#: Distinct times of a key that one task looks at when picks are made.
PICK_ROWS = 50_000


def _exits(at: np.ndarray, gap: int) -> np.ndarray:
    """The time that is free again after the picks that begin with each time.

    Works backwards: the next pick after at[i] is the first time gap or more later.
    """
    following = np.searchsorted(at, at + gap, side="left")
    out = np.zeros(len(at), np.int64)
    for i in range(len(at) - 1, -1, -1):
        out[i] = out[following[i]] if following[i] < len(at) else at[i] + gap
    return out


def nonoverlap_chrono(df: DataFrame, key: list[str], ts: str, row_id: str, gap: int, pick_rows: int = PICK_ROWS) -> DataFrame:
    """(key, ts, row_id) of the greedy chronological picks: take a row, then none for `gap`.

    A row exactly `gap` later is taken; of rows at one time the smallest row_id. The only state is
    the time from which rows are free. The distinct times of a key are cut into blocks of at most
    pick_rows. Every block is summed up on its own by where its picks end for each time at which they
    can begin; picks from neighbouring beginnings soon fall together, so that the map has few steps.
    The maps are followed from block to block for the state at each block's start, and
    the blocks then pick on their own. However dense a feed is, no key's rows are in one task. NULL
    keys are a key, NULL times are never picked; gap must be positive.
    """
    times = df.where(F.col(ts).isNotNull()).groupBy(*key, ts).agg(F.min(row_id).alias(row_id))
    shard = F.floor(F.col(ts) / max(86_400, gap))
    rows = running_total(times, F.lit(1), [F.col(ts)], shard, key, "_nth").withColumn("_block", F.floor((F.col("_nth") - 1) / pick_rows))
    rows = cut(rows.select(*key, ts, row_id, "_block"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(key)] + [F.col(k).isNull().alias(f"_n{i}") for i, k in enumerate(key)]
    named = rows.select(*keys, *key, ts, row_id, "_block") if key else rows.withColumn("_k0", F.lit(""))
    group = [c for c in named.columns if c[:2] in ("_k", "_n")]
    group_kinds = ", ".join(f"{c} {'string' if c[1] == 'k' else 'boolean'}" for c in group)

    def sum_up(block: pa.Table) -> pa.Table:
        at = np.sort(block[ts].to_numpy())
        ends = _exits(at, gap)
        # free at t: the picks begin with the first time at or after t; free after all of them: the block changes nothing
        step = np.flatnonzero(np.append(ends[:-1] != ends[1:], True))
        return pa.table({c: block[c].slice(0, 1) for c in group} | {"_block": block["_block"].slice(0, 1), "_until": pa.array([at[step].tolist()], pa.list_(pa.int64())), "_end": pa.array([ends[step].tolist()], pa.list_(pa.int64()))})

    def follow(maps: pa.Table) -> pa.Table:
        from bisect import bisect_left

        maps = maps.sort_by("_block")
        free, starts = -(2**62), []
        for until, end in zip(maps["_until"].to_pylist(), maps["_end"].to_pylist()):
            starts.append(free)
            i = bisect_left(until, free)
            free = end[i] if i < len(until) else free
        return pa.table({c: maps[c] for c in group} | {"_block": maps["_block"], "_free": pa.array(starts, pa.int64())})

    def pick(block: pa.Table) -> pa.Table:
        block = block.sort_by(ts)
        at, free, taken = block[ts].to_numpy(), block["_free"][0].as_py(), []
        i = int(np.searchsorted(at, free, side="left"))
        while i < len(at):
            taken.append(i)
            i = int(np.searchsorted(at, at[i] + gap, side="left"))
        return block.select([*key, ts, row_id]).take(pa.array(taken, pa.int64()))

    maps = named.groupBy(*group, "_block").applyInArrow(sum_up, f"{group_kinds}, _block bigint, _until array<bigint>, _end array<bigint>")
    starts = maps.groupBy(*group).applyInArrow(follow, f"{group_kinds}, _block bigint, _free bigint")
    return named.join(starts, [*group, "_block"]).groupBy(*group, "_block").applyInArrow(pick, ", ".join(f"`{c}` {kind[c]}" for c in (*key, ts, row_id)))


def nonoverlap_by_confidence(df: DataFrame, key: list[str], ts: str, row_id: str, conf: str, gap: int) -> DataFrame:
    """(key, ts, row_id) of greedy picks by falling confidence, each at least `gap` from all picks before (ties: row_id).

    Of rows at one time only the best can be picked, so the others are dropped first. The rule has no
    order in time and so no state to sum up; it is settled in rounds: a row that is the best of all
    undecided rows less than gap away is a pick, and rows that near a pick are none. Every round is two
    windows over chunks of time that also read `gap` on both sides, so neither a dense feed nor a key is
    in one task. Rows fall about as fast as by matching random neighbours. NULL times are never
    picked, a NULL confidence is the lowest.
    """
    best = F.struct(F.coalesce(F.col(conf).cast("double"), F.lit(float("-inf"))).alias("c"), (-F.col(row_id)).alias("i"))
    left = df.where(F.col(ts).isNotNull()).groupBy(*key, ts).agg(F.max(best).alias("_best")).withColumn("_shard", F.xxhash64(*key) if key else F.lit(0))
    left = written(left, "undecided")
    picked = None
    chunk = max(3_600, gap)
    while not left.isEmpty():
        own = F.floor(F.col(ts) / chunk)
        wide = left.withColumn("_chunk", F.explode(F.sequence(F.floor((F.col(ts) - gap + 1) / chunk), F.floor((F.col(ts) + gap - 1) / chunk))))
        near = Window.partitionBy(*key, "_chunk").orderBy(ts).rangeBetween(-gap + 1, gap - 1)
        top = wide.withColumn("_top", F.max("_best").over(near) == F.col("_best"))
        # whether a row is a pick is only right in its own chunk, where all its neighbours are
        wins = written(top.where(own == F.col("_chunk")).withColumn("_pick", F.col("_top")).drop("_top", "_chunk"), "judged")
        again = wins.withColumn("_chunk", F.explode(F.sequence(F.floor((F.col(ts) - gap + 1) / chunk), F.floor((F.col(ts) + gap - 1) / chunk))))
        gone = again.withColumn("_gone", F.max("_pick").over(near)).where((own == F.col("_chunk")) & ~F.col("_gone"))
        found = wins.where("_pick").select(*key, ts, (-F.col("_best.i")).alias(row_id))
        picked = found if picked is None else picked.unionByName(found)
        left = written(gone.drop("_chunk", "_pick", "_gone"), "undecided")
    kinds = dict(df.dtypes)
    empty = df.select(*key, ts, row_id).limit(0)
    return empty if picked is None else picked.select(*key, ts, F.col(row_id).cast(kinds[row_id]).alias(row_id))


def contiguous_groups(df: DataFrame, ts: str, row_id: str, groups: int, out: str = "grp") -> DataFrame:
    """df with `out`: which of so many time-ordered groups of equal size (edges floor(k n / groups)).

    Edges are exact: rows are counted per time, a sum over distinct times; rows of one time are
    split in order of row_id.
    """
    numbered = running_total(df, F.lit(1), [F.col(ts), F.col(row_id)], F.floor(F.col(ts) / 86_400), out="_nth")
    n = df.count()
    grp = sum(((F.col("_nth") - 1 >= k * n // groups).cast("int") for k in range(1, groups)), F.lit(0))
    return numbered.withColumn(out, grp).drop("_nth")


def combinations_table(spark: SparkSession, groups: int, tests: int) -> DataFrame:
    """(path_id, grp): the test groups of all C(groups, tests) paths; a table of fixed size."""
    rows = [(i, g) for i, combo in enumerate(combinations(range(groups), tests)) for g in combo]
    return spark.createDataFrame(rows, "path_id int, grp int")


def purged_training(df: DataFrame, ts: str, groups: int, tests: int, purge_s: int, embargo_s: int, grp: str = "grp") -> DataFrame:
    """(path_id, role, n, lo, hi) of purged combinatorial cross-validation of rows with `grp`.

    A training row of a path is dropped if its time lies in [lo - purge, hi + embargo) of one of the
    path's test groups. Rows meet paths only through the table of groups and their bounds, which is
    groups * C(groups, tests) rows whatever the data, and counts are taken before the join: per
    group and per stretch of time between two bounds.
    """
    spark = df.sparkSession
    bounds = cut(df.groupBy(grp).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"), F.count("*").alias("n")))
    test = combinations_table(spark, groups, tests).join(bounds.withColumnRenamed(grp, "grp"), "grp")
    marks = sorted({x for r in bounds.collect() for x in (r["lo"] - purge_s, r["hi"] + embargo_s)})  # 2 * groups numbers
    stretch = sum(((F.col(ts) >= m).cast("int") for m in marks), F.lit(0))
    cells = df.groupBy(F.col(grp).alias("grp"), stretch.alias("stretch")).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    paths = combinations_table(spark, groups, tests).groupBy("path_id").agg(F.collect_set("grp").alias("test_groups"))
    zones = test.groupBy("path_id").agg(F.collect_list(F.struct((F.col("lo") - purge_s).alias("a"), (F.col("hi") + embargo_s).alias("b"))).alias("zones"))
    grid = cells.join(F.broadcast(paths.join(zones, "path_id")))  # cells and paths are both of fixed size
    inside = F.exists("zones", lambda z: (F.col("first") >= z["a"]) & (F.col("first") < z["b"]))
    role = F.when(F.array_contains("test_groups", F.col("grp")), "test").when(inside, "purged").otherwise("train")
    return grid.groupBy("path_id", role.alias("role")).agg(F.sum("n").alias("n"), F.min("first").alias("lo"), F.max("last").alias("hi"))


def poisson_weights(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """(rows, replicates) Poisson(1) numbers that depend on each row's hash, the replicate and the seed alone."""
    mixed = hashes.astype(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    uniform = ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
    return np.searchsorted(steps, uniform.ravel(), side="right").reshape(uniform.shape)


def bootstrap_means(clusters: DataFrame, value: str, weight: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, mean): cluster bootstrap of sum(value) / sum(weight) over cluster rows.

    Poisson bootstrap: a cluster counts in a replicate as often as its own seeded Poisson number
    says, so replicates are sums that are added up map-side and no cluster is gathered anywhere.
    """
    draws = clusters.select(F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"), F.xxhash64(*clusters.columns).alias("h"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, bottoms = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            for part in (batch.slice(i, 2_000) for i in range(0, batch.num_rows, 2_000)):
                v, w, h = (part.column(i).to_numpy() for i in range(3))
                k = poisson_weights(h.astype(np.int64).view(np.uint64), replicates, seed)
                tops += v @ k
                bottoms += w @ k
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates)), pa.array(tops), pa.array(bottoms)], names=["replicate", "top", "bottom"])

    parts = draws.mapInArrow(sums, "replicate bigint, top double, bottom double")
    return parts.groupBy("replicate").agg(F.try_divide(F.sum("top"), F.sum("bottom")).alias("mean"))


def pbo(blocks: pd.DataFrame) -> float:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    blocks: one row per block, one column per configuration, block performance as values (sums
    made in Spark; a table of fixed size). In each half split the best configuration in sample is
    ranked out of sample; the result is the share of splits in which it is below the median.
    """
    m = blocks.to_numpy(dtype=float)
    rows, below = range(len(m)), 0
    splits = list(combinations(rows, len(m) // 2))
    total = m.sum(axis=0)
    for half in splits:
        inside = m[list(half)].sum(axis=0)
        outside = total - inside
        best = int(np.argmax(inside))
        rank = (outside < outside[best]).sum() + ((outside == outside[best]).sum() + 1) / 2
        below += rank / (m.shape[1] + 1) <= 0.5
    return below / len(splits) if splits else float("nan")
