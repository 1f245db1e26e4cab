"""Queries on streaming operators (T): each replays the tick table as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.bars import keep_last
from lodestream.operators.scan import with_previous
from lodestream.plans.base import Registry
from lodestream.runtime import shared_path, table
from lodestream.streaming import market as M

query = Registry()
#: The row that moves the watermark past all others at the end of a replay.
_END = 9_000_000_000


def replay(spark: SparkSession, sf: str, closing: bool = True) -> DataFrame:
    """The ticks (stream_id, epoch, tick_id, quote) as a stream, with a closing row of stream ''."""
    rows = table(spark, sf, "ticks").select("stream_id", "epoch", "tick_id", F.when(~F.isnan("quote"), F.col("quote")).alias("quote"))
    if closing:
        rows = rows.unionByName(spark.createDataFrame([("", _END, -1, None)], rows.schema))
    path = shared_path(spark, "replay")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("""WITH m AS (SELECT *, max(epoch) OVER (PARTITION BY stream_id ORDER BY tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ticks), k AS (SELECT *, (before IS NULL OR epoch > before) AS keep FROM m),
g AS (SELECT *, sum(keep::INT) OVER (PARTITION BY stream_id ORDER BY tick_id ROWS UNBOUNDED PRECEDING) - keep::INT AS grp FROM k), d AS (SELECT stream_id, grp, count(*) FILTER (NOT keep) AS dropped, max(tick_id) FILTER (keep) AS tick_id, max(epoch) FILTER (keep) AS epoch FROM g GROUP BY ALL)
SELECT stream_id, epoch, tick_id, dropped FROM d WHERE tick_id IS NOT NULL""")
def ref_t02_monotone(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks that advance their stream's clock."""
    return M.run_to_table(M.monotone_filter(replay(spark, sf, closing=False), "stream_id", "epoch", "tick_id"), "monotone")


@query("""WITH u AS (SELECT * FROM ticks WHERE quote IS NOT NULL AND NOT isnan(quote) QUALIFY row_number() OVER (PARTITION BY stream_id, epoch ORDER BY tick_id DESC) = 1),
w AS (SELECT stream_id, epoch, quote, unnest(range((epoch + 19) // 20 * 20, (epoch + 19) // 20 * 20 + 60, 20)) AS end_epoch FROM u)
SELECT stream_id, end_epoch, count(*) AS n, arg_min(quote, epoch) AS open, max(quote) AS high, min(quote) AS low, arg_max(quote, epoch) AS close FROM w GROUP BY ALL HAVING count(*) >= 15""")
def ref_t04_exact_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Right-closed 60 s windows every 20 s with at least 15 distinct seconds, on the stream."""
    stream = replay(spark, sf).where("stream_id = '' OR quote IS NOT NULL")
    windows = M.exact_windows(stream, "stream_id", "epoch", "quote", "tick_id", 60, 20, 15, "0 seconds")
    return M.run_to_table(windows, "windows")


@query("""WITH u AS (SELECT * FROM ticks WHERE quote IS NOT NULL AND NOT isnan(quote) QUALIFY row_number() OVER (PARTITION BY stream_id, epoch ORDER BY tick_id DESC) = 1),
w AS (SELECT stream_id, epoch, quote, unnest(range((epoch + 4) // 5 * 5, (epoch + 4) // 5 * 5 + 60, 5)) AS end_epoch FROM u), c AS (SELECT stream_id, end_epoch, count(*) AS n FROM w GROUP BY ALL)
SELECT stream_id, count(*) FILTER (n = 60) AS whole, count(*) FILTER (n < 60) AS partial, max(n) AS fullest FROM c GROUP BY 1""")
def ref_t04_whole_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Right-closed 60 s windows every 5 s: how many have all sixty seconds, how many have fewer."""
    stream = replay(spark, sf).where("stream_id = '' OR quote IS NOT NULL")
    windows = M.run_to_table(M.exact_windows(stream, "stream_id", "epoch", "quote", "tick_id", 60, 5, 1, "0 seconds"), "minutes").where("stream_id <> ''")
    return windows.groupBy("stream_id").agg(F.count_if(F.col("n") == 60).alias("whole"), F.count_if(F.col("n") < 60).alias("partial"), F.max("n").alias("fullest"))


@query("""SELECT stream_id, epoch // 60 * 60 AS t, arg_min(quote, struct_pack(epoch, tick_id)) AS open, max(quote) AS high, min(quote) AS low, arg_max(quote, struct_pack(epoch, tick_id)) AS close, count(*) AS n FROM ticks WHERE NOT isnan(quote) GROUP BY ALL""")
def ref_t07_closed_candles(spark: SparkSession, sf: str) -> DataFrame:
    """One-minute candles closed by the watermark."""
    stream = replay(spark, sf).where("stream_id = '' OR quote IS NOT NULL")
    return M.run_to_table(M.closed_candles(stream, "stream_id", "epoch", "quote", "tick_id", 60, "0 seconds"), "candles")


@query("""WITH s AS (SELECT stream_id, max(struct_pack(epoch, tick_id, quote := CASE WHEN NOT isnan(quote) THEN quote END)) AS s FROM ticks GROUP BY 1) SELECT stream_id, s.epoch AS epoch, s.tick_id AS tick_id, s.quote AS quote FROM s""")
def ref_t10_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """Each stream's last known quote, from a running aggregate."""
    return M.run_to_table(M.latest_state(replay(spark, sf, closing=False), "stream_id", "epoch", "tick_id", ["quote"]), "latest", "complete")


@query("""WITH g AS (SELECT stream_id, epoch - lag(epoch) OVER (PARTITION BY stream_id ORDER BY epoch) AS gap, epoch FROM (SELECT DISTINCT stream_id, epoch FROM ticks)), l AS (SELECT stream_id, quantile_cont(epoch(received_at) - epoch, 0.95) AS p95, max(epoch(received_at) - epoch) AS worst FROM ticks GROUP BY 1)
SELECT g.stream_id, count(*) AS n_seconds, max(gap) AS max_gap, count(*) FILTER (gap > 30) AS n_gaps, round(any_value(p95), 3) AS lag_p95, round(any_value(worst), 3) AS lag_max FROM g JOIN l USING (stream_id) GROUP BY 1""")
def ref_t09_quality_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, gaps and arrival lag per stream."""
    t = table(spark, sf, "ticks")
    g = with_previous(t.select("stream_id", "epoch").distinct(), ["stream_id"], "epoch", [F.col("epoch")], ["epoch"])
    g = g.withColumn("gap", F.col("epoch") - F.col("prev.epoch"))
    seen = g.groupBy("stream_id").agg(F.count("*").alias("n_seconds"), F.max("gap").alias("max_gap"), F.count(F.when(F.col("gap") > 30, 1)).alias("n_gaps"))
    lag = F.unix_micros(F.col("received_at").cast("timestamp")) / 1e6 - F.col("epoch")
    late = t.groupBy("stream_id").agg(F.round(F.percentile(lag, 0.95), 3).alias("lag_p95"), F.round(F.max(lag), 3).alias("lag_max"))
    return seen.join(late, "stream_id")


@query("""WITH l AS (SELECT *, CASE WHEN feed = 'live' THEN 0 ELSE 1 END AS prio FROM ticks) SELECT stream_id, epoch, tick_id FROM l WHERE NOT isnan(quote) QUALIFY row_number() OVER (PARTITION BY stream_id, epoch ORDER BY prio, tick_id DESC) = 1""".replace("CASE WHEN feed = 'live' THEN 0 ELSE 1 END", "CASE WHEN coalesce(feed, '') = 'live' THEN 0 ELSE 1 END"))
def ref_t06_gap_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Live and recovered ticks merged; live wins, then the later arrival."""
    t = table(spark, sf, "ticks").where("quote IS NOT NULL AND NOT isnan(quote)")
    live = F.coalesce(F.col("feed"), F.lit("")) == "live"
    rank = t.select("stream_id", "epoch", F.struct(live.cast("int").alias("live"), "tick_id").alias("seq"), "tick_id")
    return keep_last(rank, ["stream_id", "epoch"], "seq").select("stream_id", "epoch", "tick_id")


@query("""WITH u AS (SELECT * FROM ticks WHERE stream_id IS NOT NULL AND NOT isnan(quote) QUALIFY row_number() OVER (PARTITION BY stream_id, epoch ORDER BY tick_id DESC) = 1), l AS (SELECT stream_id, max(epoch) AS newest FROM u GROUP BY 1)
SELECT stream_id, any_value(newest) AS newest, count(*) AS n, min(epoch) AS first, round(avg(quote), 7) AS mean FROM u JOIN l USING (stream_id) WHERE epoch > newest - 600 GROUP BY 1""")
def ref_t03_ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    """Every stream's buffer of the last ten minutes."""
    return M.run_to_table(M.ring_buffer(replay(spark, sf, closing=False), "stream_id", "epoch", "tick_id", "quote", 600), "ring", "update").withColumn("mean", F.round("mean", 7))


@query("""SELECT stream_id, count(*) AS rows_in, count(*) AS rows_out, 1 AS batches, 0 AS lost FROM ticks GROUP BY 1""")
def ref_t08_counted_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that came in and were written, per stream: none is lost."""
    return M.counted_sink(replay(spark, sf, closing=False), "sink", "stream_id")


@query("""WITH g AS (SELECT stream_id, epoch, coalesce(epoch - lag(epoch) OVER w > 30, true) AS new FROM ticks WINDOW w AS (PARTITION BY stream_id ORDER BY epoch)), i AS (SELECT *, sum(new::INT) OVER (PARTITION BY stream_id ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT stream_id, epoch, bool_or(new) AS new, count(*) AS c FROM g GROUP BY ALL))
SELECT stream_id, min(epoch) AS first, max(epoch) AS last, sum(c)::BIGINT AS n FROM i GROUP BY stream_id, k""")
def ref_t13_session_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Gap-based sessions of the ticks, closed by the watermark."""
    return M.run_to_table(M.gap_sessions(replay(spark, sf), "stream_id", "epoch", 30, "0 seconds"), "sessions").where("stream_id <> ''")
