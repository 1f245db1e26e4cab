"""Streaming operators on ticks: monotone filter, exact-count sliding windows, closed candles, latest state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestream.runtime import shared_path


def monotone_filter(stream: DataFrame, key: str, epoch: str, seq: str) -> DataFrame:
    """(key, epoch, seq, dropped): rows later than all before them in arrival order, and how many
    rows of the same micro-batch and key were dropped just before each.

    Arrival order is seq within a micro-batch and the order of batches beyond; one number per key is
    kept as state. Of a key's rows of one micro-batch only epoch and seq are held, 16 bytes a row, as
    the batch must be put in order; the source's maxFilesPerTrigger bounds them.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(rows[epoch].to_numpy(np.int64), rows[seq].to_numpy(np.int64)) for rows in frames]
        e, s = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(s, kind="stable")
        e, s = e[order], s[order]
        last = state.get[0] if state.exists else -(2**62)
        before = np.maximum.accumulate(np.append(last, e))[:-1]
        keep = e > before
        count = np.diff(np.append(0, np.cumsum(~keep)[keep]))
        if keep.any():
            state.update((int(e[keep][-1]),))
            yield pd.DataFrame({key: k[0], epoch: e[keep], seq: s[keep], "dropped": count})

    clean = stream.where(F.col(key).isNotNull() & F.col(epoch).isNotNull()).select(key, epoch, seq)
    return clean.groupBy(key).applyInPandasWithState(step, f"{key} string, {epoch} bigint, {seq} bigint, dropped bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)


def ring_buffer(stream: DataFrame, key: str, epoch: str, seq: str, value: str, seconds: int) -> DataFrame:
    """(key, newest, n, first, mean): after every micro-batch each key's buffer of the last `seconds` seconds.

    The buffer holds the distinct seconds (of repeated ones the largest seq) later than the newest less
    `seconds`, whatever the order of arrival; older ones are dropped. So its size is bounded by the time
    span, not by the feed. Rows without key or time, or without value, are left out. For update mode.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (b"", b"", b"")
        e, s, v = (np.frombuffer(x, d) for x, d in zip(held, (np.int64, np.int64, float)))
        for rows in frames:  # trimmed batch by batch: the buffer never holds more than the span and one batch
            e, s, v = np.append(e, rows[epoch].to_numpy(np.int64)), np.append(s, rows[seq].to_numpy(np.int64)), np.append(v, rows[value].to_numpy(float))
            order = np.lexsort((s, e))
            e, s, v = e[order], s[order], v[order]
            keep = np.append(e[1:] != e[:-1], True) & (e > e[-1] - seconds)
            e, s, v = e[keep], s[keep], v[keep]
        state.update((e.tobytes(), s.tobytes(), v.tobytes()))
        yield pd.DataFrame({key: [k[0]], "newest": [int(e[-1])], "n": [len(e)], "first": [int(e[0])], "mean": [float(v.mean())]})

    clean = stream.where(F.col(key).isNotNull() & F.col(epoch).isNotNull() & F.col(value).isNotNull()).select(key, epoch, seq, value)
    return clean.groupBy(key).applyInPandasWithState(step, f"{key} string, newest bigint, n bigint, first bigint, mean double", "e binary, s binary, v binary", "update", GroupStateTimeout.NoTimeout)


def gap_sessions(stream: DataFrame, key: str, epoch: str, gap: int, lateness: str) -> DataFrame:
    """Sessions of a key's rows that are at most `gap` seconds apart: first and last second, rows."""
    at = stream.withColumn("at", F.timestamp_seconds(epoch)).withWatermark("at", lateness)
    return at.groupBy(key, F.session_window("at", f"{gap} seconds").alias("w")).agg(F.min(epoch).alias("first"), F.max(epoch).alias("last"), F.count("*").alias("n")).select(key, "first", "last", "n")


def counted_sink(stream: DataFrame, name: str, count_by: str) -> DataFrame:
    """Run a stream into a sink that accounts for every row: (count_by, rows_in, rows_out, lost, batches).

    Each micro-batch is written under its own number, so a batch that is run again after a failure
    replaces itself and nothing is lost or written twice; the rows that came in are counted beside it,
    and both counts are read back from what was written.
    """
    spark, base = stream.sparkSession, shared_path(stream.sparkSession, name)

    def write(df: DataFrame, batch: int) -> None:
        df.persist()  # both writes see the same rows of the source
        df.write.mode("overwrite").parquet(f"{base}/rows/batch={batch}")
        df.groupBy(count_by).agg(F.count("*").alias("rows_in")).write.mode("overwrite").parquet(f"{base}/counts/batch={batch}")
        df.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    came = spark.read.parquet(f"{base}/counts").groupBy(count_by).agg(F.sum("rows_in").alias("rows_in"), F.countDistinct("batch").alias("batches"))
    went = spark.read.parquet(f"{base}/rows").groupBy(count_by).agg(F.count("*").alias("rows_out"))
    both = came.join(went, came[count_by].eqNullSafe(went[count_by]), "left").select(came[count_by], "rows_in", F.coalesce("rows_out", F.lit(0)).alias("rows_out"), "batches")
    return both.withColumn("lost", F.col("rows_in") - F.col("rows_out"))


def exact_windows(stream: DataFrame, key: str, epoch: str, price: str, seq: str, length: int, slide: int, seconds_needed: int, lateness: str) -> DataFrame:
    """Right-closed sliding windows (end - length, end] with at least so many distinct seconds.

    Seconds are deduplicated first (the largest seq wins), then windowed; on a stream both stages
    close by watermark, in append mode. Windows that miss seconds are never emitted, nor filled.
    """
    at = stream.withColumn("t1", F.timestamp_seconds(F.col(epoch) - 1)).withWatermark("t1", lateness)
    # a second's own one-second window keeps event time through the first aggregation
    second = at.groupBy(key, F.window("t1", "1 second").alias("w1")).agg(F.max_by(price, seq).alias(price))
    windows = second.groupBy(key, F.window(F.window_time("w1"), f"{length} seconds", f"{slide} seconds").alias("w")).agg(
        F.count("*").alias("n"), F.min_by(price, "w1.end").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "w1.end").alias("close")
    )
    return windows.where(F.col("n") >= seconds_needed).select(key, F.unix_seconds("w.end").alias("end_epoch"), "n", "open", "high", "low", "close")


def closed_candles(stream: DataFrame, key: str, epoch: str, price: str, seq: str, seconds: int, lateness: str) -> DataFrame:
    """Tumbling candles that the watermark has closed; the open one is never emitted."""
    at = stream.withColumn("at", F.timestamp_seconds(epoch)).withWatermark("at", lateness)
    order = F.struct(F.col(epoch), F.col(seq))
    return at.groupBy(key, F.window("at", f"{seconds} seconds").alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(price).alias("n")
    ).select(key, F.unix_seconds("w.start").alias("t"), "open", "high", "low", "close", "n")


def latest_state(stream: DataFrame, key: str, epoch: str, seq: str, columns: list[str]) -> DataFrame:
    """The last known row of each key (update or complete mode)."""
    return stream.groupBy(key).agg(F.max(F.struct(epoch, seq, *columns)).alias("s")).select(key, "s.*")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now, and read what it wrote."""
    spark, base = stream.sparkSession, shared_path(stream.sparkSession, name)
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
    else:
        writer = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).outputMode(mode)
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
