"""Pairs by nearest time as a stateful streaming join.

Both sides are buffered per entity and time bucket. A left row is emitted when the watermark has
passed its tolerance horizon, as then no nearer right row can come; expired candidates are evicted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.runtime import shared_path, written

#: Seconds of one entity's time in one state; an entity with most of the rows thus is many states.
BUCKET_S = 3_600
#: Rows of a replay that a core takes at once, which bounds the state.
CORE_ROWS = 2_000_000
#: Partitions of one slice when it is written.
SLICE_PARTS = 32
#: Event time, after all others, of the row that closes a replay.
END_EPOCH = 9_000_000_000

_TAGGED = ["entity", "bucket", "is_left", "epoch", "id", "tol_s", "usable", "event_time"]
_STATE = "lt binary, lid binary, ltol binary, rt binary, rid binary, ru binary"
_OUT = "left_id bigint, right_id bigint"
_DTYPES = (np.int64, np.int64, np.int64, np.int64, np.int64, np.bool_)


def match_nearest(lt: np.ndarray, ltol: np.ndarray, rt: np.ndarray, rid: np.ndarray, ru: np.ndarray) -> np.ndarray:
    """For each left time the id of the nearest usable right row within its tolerance, else -1.

    Of right rows of one time the largest id counts, and only if it is usable; of two equally near
    the earlier. Right ids must not be negative.
    """
    order = np.lexsort((rid, rt))
    rt, rid, ru = rt[order], rid[order], ru[order]
    if len(rt):
        keep = np.append(rt[1:] != rt[:-1], True) & ru
        rt, rid = rt[keep], rid[keep]
    if not len(rt):
        return np.full(len(lt), -1, np.int64)
    after = np.searchsorted(rt, lt, side="left")
    before = np.clip(after - 1, 0, len(rt) - 1)
    after = np.clip(after, 0, len(rt) - 1)
    to_before, to_after = np.abs(lt - rt[before]), np.abs(lt - rt[after])
    best = np.where(to_before <= to_after, before, after)
    near = np.minimum(to_before, to_after) <= ltol
    return np.where(near, rid[best], -1)


def _step(tolerance: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (b"",) * 6
        lt, lid, ltol, rt, rid, ru = (np.frombuffer(x, d) for x, d in zip(held, _DTYPES))
        for pdf in [] if state.hasTimedOut else frames:
            left = pdf["is_left"].to_numpy(dtype=bool)
            epoch, ids = pdf["epoch"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64)
            lt, lid = np.append(lt, epoch[left]), np.append(lid, ids[left])
            ltol = np.append(ltol, pdf["tol_s"].to_numpy(np.int64)[left])
            rt, rid = np.append(rt, epoch[~left]), np.append(rid, ids[~left])
            ru = np.append(ru, pdf["usable"].to_numpy(dtype=bool)[~left])
        mark = state.getCurrentWatermarkMs() // 1000
        due = lt + ltol < mark
        if due.any():
            found = match_nearest(lt[due], ltol[due], rt, rid, ru)
            hit = found >= 0
            if hit.any():
                yield pd.DataFrame({"left_id": lid[due][hit], "right_id": found[hit]})
        lt, lid, ltol = lt[~due], lid[~due], ltol[~due]
        needed = min([mark - tolerance, *(lt - ltol)])
        fresh = rt >= needed
        rt, rid, ru = rt[fresh], rid[fresh], ru[fresh]
        if not len(lt) and not len(rt):
            state.remove()
            return
        state.update(tuple(np.ascontiguousarray(x).astype(d).tobytes() for x, d in zip((lt, lid, ltol, rt, rid, ru), _DTYPES)))
        horizon = int((lt + ltol).min()) if len(lt) else int(rt.max()) + tolerance
        state.setTimeoutTimestamp(max(horizon + 1, mark + 1) * 1000)

    return step


def tag(df: DataFrame, *, is_left: bool, entity: str, epoch: str, row_id: str, tol: Column, usable: Column, tolerance: int) -> DataFrame:
    """One side in the common form. Right rows near a bucket's border go to both buckets.

    Rows without entity, time or id can pair with nothing and are left out.
    """
    bucket = lambda c: F.floor(c / BUCKET_S)
    at = F.col(epoch)
    buckets = F.array(bucket(at)) if is_left else F.array_distinct(F.array(bucket(at - tolerance), bucket(at), bucket(at + tolerance)))
    return df.where(F.col(entity).isNotNull() & at.isNotNull() & F.col(row_id).isNotNull()).select(
        F.col(entity).alias("entity"), F.explode(buckets).alias("bucket"), F.lit(is_left).alias("is_left"), at.alias("epoch"),
        F.col(row_id).alias("id"), tol.cast("bigint").alias("tol_s"), usable.alias("usable"), F.timestamp_seconds(at).alias("event_time"),
    )


def nearest_time_stream(left: DataFrame, right: DataFrame, tolerance: int, lateness: str = "0 seconds") -> DataFrame:
    """The streaming join of two tagged streams: (left_id, right_id).

    tolerance bounds all tol_s; lateness is how far behind the latest event time rows may come on
    either side. Rows later than that are dropped by the engine, as in every event-time operator.
    """
    both = left.withWatermark("event_time", lateness).select(_TAGGED).union(right.withWatermark("event_time", lateness).select(_TAGGED))
    return both.groupBy("entity", "bucket").applyInPandasWithState(_step(tolerance), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _time_slices(rows: DataFrame, slice_rows: int) -> DataFrame:
    """(bucket, slice): the buckets of time in order, cut into slices of at most so many rows, or of one bucket.

    One row per bucket of time that has rows, whatever the number of rows and entities.
    """
    at = F.floor(F.col("epoch") / BUCKET_S)
    counts = rows.groupBy(at.alias("hour")).agg(F.count("*").alias("n"))
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    raw = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / slice_rows)
    return counts.withColumn("raw", raw).select("hour", (F.dense_rank().over(Window.orderBy("raw")) - 1).alias("slice"))


def _move(spark: SparkSession, source: str, target: str, prefix: str) -> None:
    """Move the files of a folder, if there is one, into another of the shared file system, under new names."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target))
    for file in fs.listStatus(path(source)) if fs.exists(path(source)) else []:
        if not fs.rename(file.getPath(), path(f"{target}/{prefix}-{file.getPath().getName()}")):
            raise OSError(f"could not move {file.getPath()}")


def replay_nearest(spark: SparkSession, left: DataFrame, right: DataFrame, tolerance: int, slice_rows: int | None = None) -> DataFrame:
    """nearest_time_stream over two whole tables (tagged by tag()), however late their rows are.

    Both tables are written once to the shared folder, by slices of time; each slice is moved into
    the stream's input and run as one available-now trigger of the same checkpointed query. So
    every row is read once, within the stream no row is late, and the state holds one slice at
    most. A slice has CORE_ROWS rows for every core of the session unless slice_rows says
    otherwise; the result is the same for any size. A closing row then moves the watermark past all
    horizons. Left rows without partner give no row; empty tables give none.
    """
    base = shared_path(spark, "nearest")
    slice_rows = slice_rows or CORE_ROWS * spark.sparkContext.defaultParallelism
    slices = written(_time_slices(left.select("epoch").unionByName(right.select("epoch")), slice_rows), "slices")
    n = (slices.agg(F.max("slice")).first()[0] or 0) + 1
    closing = F.lit(END_EPOCH).cast("bigint")
    sides = {"left": left, "right": right}
    for name, side in sides.items():
        last = spark.range(1).select(
            F.lit("").alias("entity"), F.lit(-1).cast("bigint").alias("bucket"), F.lit(name == "left").alias("is_left"), closing.alias("epoch"), F.lit(0).cast("bigint").alias("id"),
            F.lit(0).cast("bigint").alias("tol_s"), F.lit(False).alias("usable"), F.timestamp_seconds(closing).alias("event_time"), F.lit(n - 1).cast("int").alias("slice"),
        )
        cut_up = side.join(slices, F.floor(F.col("epoch") / BUCKET_S) == F.col("hour")).drop("hour") if n > 1 else side.withColumn("slice", F.lit(0))
        if n > 1:  # few files a slice, however many tasks there are
            cut_up = cut_up.repartition("slice", F.pmod(F.xxhash64("entity", "bucket"), F.lit(SLICE_PARTS)))
        cut_up.unionByName(last).write.partitionBy("slice").parquet(f"{base}/cut/{name}")
    for i in range(n):
        for name in sides:
            _move(spark, f"{base}/cut/{name}/slice={i}", f"{base}/in/{name}", f"s{i}")
        streams = [spark.readStream.schema(left.schema).parquet(f"{base}/in/{name}") for name in sides]
        query = (
            nearest_time_stream(*streams, tolerance)
            .writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
            .outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{base}/out")
