"""Stores: upsert, compaction, health, reconciliation, manifests, shard pruning, canonical JSON."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators.bars import keep_last
from lodestream.operators.scan import with_previous


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old with new's rows in place of those of the same key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep_last(both.withColumn("_seq", F.col("_new")), key, "_seq").drop("_new", "_seq")


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace only the partitions that df has; the committer makes each write whole or absent."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def compact(spark: SparkSession, shards: str, out: str, key: Sequence[str], seq: str, rows_per_file: int = 5_000_000) -> int:
    """Merge shard files into files of bounded size, of each key the row with the largest seq; the
    number of rows written."""
    merged = keep_last(spark.read.option("recursiveFileLookup", "true").parquet(shards), key, seq)
    merged.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def store_health(bars: DataFrame, key: str, ts: str, step: int, now: int, stale_after: int) -> DataFrame:
    """Per key: rows, staleness, duplicates, gaps, largest gap, and whether all is well.

    The open bar (ts + step > now) is left out of everything.
    """
    closed = bars.where(F.col(ts) + step <= now)
    times = with_previous(closed.groupBy(key, ts).agg(F.count("*").alias("copies")), [key], ts, [F.col(ts)], [ts])
    times = times.withColumn("gap", F.col(ts) - F.col(f"prev.{ts}"))
    stale = F.lit(now) - F.max(ts) - step
    h = times.groupBy(key).agg(
        F.sum("copies").alias("n_rows"), stale.alias("stale_s"), (F.sum("copies") - F.count("*")).alias("duplicates"),
        F.count(F.when(F.col("gap") > step, 1)).alias("gaps"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap"),
    )
    return h.withColumn("healthy", (F.col("stale_s") <= stale_after) & (F.col("duplicates") == 0))


def reconcile(a: DataFrame, b: DataFrame, key: str, ts: str, value: str, last: int) -> DataFrame:
    """Per key over the last so many common times: how many values differ."""
    j = a.select(key, ts, F.col(value).alias("_a")).join(b.select(key, ts, F.col(value).alias("_b")), [key, ts])
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))
    return j.withColumn("_k", k).where(F.col("_k") <= last).groupBy(key).agg(F.count("*").alias("n_common"), F.count(F.when(~F.col("_a").eqNullSafe(F.col("_b")), 1)).alias("n_differ"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, bytes, sha256) of the files of a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def prune_shards(index: DataFrame, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of a shard index (low, high) that meet any of the intervals (start, stop).

    Shards are put into day cells and joined with the intervals' days, so neither side is broadcast.
    """
    day = lambda c: F.floor(F.col(c) / 86_400)
    cells = index.withColumn("_day", F.explode(F.sequence(day(low), day(high))))
    wanted = intervals.select("start", "stop", F.explode(F.sequence(day("start"), day("stop"))).alias("_day"))
    return cells.join(wanted, (cells["_day"] == wanted["_day"]) & (F.col(low) <= F.col("stop")) & (F.col(high) >= F.col("start")), "left_semi").drop("_day").distinct()


def canonical_json(value: Any) -> str:
    """JSON with sorted names and no blanks; NaN, infinities and names that aren't strings fail."""

    def check(x: Any) -> None:
        if isinstance(x, dict):
            if not all(isinstance(k, str) for k in x):
                raise ValueError("names must be strings")
            for v in x.values():
                check(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                check(v)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(*parts: str) -> str:
    """SHA-256 over length-prefixed parts, so that ('ab', 'c') and ('a', 'bc') differ."""
    h = hashlib.sha256()
    for part in parts:
        raw = part.encode()
        h.update(len(raw).to_bytes(8, "big") + raw)
    return h.hexdigest()
