"""Queries on bars and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import bars
from lodestream.operators.scan import numbered, with_previous
from lodestream.plans.base import BARS_SQL, SCORED_SQL, TICKS_SQL, TRAINED_SQL, Registry, minute_bars, scored, ticks, trained
from lodestream.runtime import table

query = Registry()


@query(BARS_SQL + " SELECT * FROM b")
def ref_a01_time_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Left-closed one-minute OHLC bars."""
    return minute_bars(spark, sf)


@query(TICKS_SQL + """ SELECT stream_id, (epoch + 59) // 60 * 60 AS t, arg_min(quote, epoch) AS open, max(quote) AS high, min(quote) AS low, arg_max(quote, epoch) AS close, count(*) AS n
FROM u GROUP BY ALL""")
def ref_a02_right_closed_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Right-closed, right-labelled bars."""
    return bars.time_bars(ticks(spark, sf), ["stream_id"], 60, closed="right")


@query(TICKS_SQL + """, c AS (SELECT *, (quote <> lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch))::INT AS c FROM u)
SELECT stream_id, epoch // 60 * 60 AS t, count(*) AS n_ticks, coalesce(sum(c), 0)::BIGINT AS n_changes FROM c GROUP BY ALL""")
def ref_a03_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks and price changes per minute."""
    return bars.change_counts(ticks(spark, sf), ["stream_id"], 60)


@query(TICKS_SQL + """ SELECT stream_id, epoch // 10 * 10 AS t, arg_max(quote, epoch) AS mid, round(avg((ask - bid) * 10000), 6) AS spread,
round(avg((quote - bid) / nullif(ask - bid, 0)), 6) AS imb, count(*) AS nt FROM u GROUP BY ALL""")
def ref_a04_micro_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-second microstructure bars; empty ones are absent."""
    gap = F.col("ask") - F.col("bid")
    return ticks(spark, sf).groupBy("stream_id", (F.floor(F.col("epoch") / 10) * 10).alias("t")).agg(
        F.max_by("quote", "epoch").alias("mid"), F.round(F.avg(gap * 10000), 6).alias("spread"),
        F.round(F.avg(F.try_divide(F.col("quote") - F.col("bid"), gap)), 6).alias("imb"), F.count("*").alias("nt"),
    )


@query(TICKS_SQL + """, d AS (SELECT *, sign(quote - lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch)) AS s FROM u),
c AS (SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS f FROM d)
SELECT stream_id, epoch // 60 * 60 AS t, sum(f)::DOUBLE AS flow, sum(abs(f))::DOUBLE AS moves FROM c GROUP BY ALL""")
def ref_a05_signed_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Tick-rule order flow per minute with carried signs."""
    return bars.signed_flow(ticks(spark, sf), ["stream_id"], 60)


@query(TICKS_SQL + """, q AS (SELECT *, tick_id % 97 + 1 AS bs, tick_id % 89 + 1 AS az FROM u),
l AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bs) OVER w AS pbs, lag(az) OVER w AS paz FROM q WINDOW w AS (PARTITION BY stream_id ORDER BY epoch)),
e AS (SELECT stream_id, epoch, CASE WHEN pb IS NOT NULL AND pa IS NOT NULL THEN (CASE WHEN bid >= pb THEN bs ELSE 0 END - CASE WHEN bid <= pb THEN pbs ELSE 0 END)
 - (CASE WHEN ask <= pa THEN az ELSE 0 END - CASE WHEN ask >= pa THEN paz ELSE 0 END) END AS e FROM l)
SELECT stream_id, epoch // 60 * 60 AS t, coalesce(sum(e), 0)::BIGINT AS ofi, count(e) AS n_events FROM e GROUP BY ALL""")
def ref_a06_order_flow_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    """Event order-flow imbalance per minute, with made-up sizes."""
    return bars.order_flow_imbalance(ticks(spark, sf), ["stream_id"], 60, F.col("tick_id") % 97 + 1, F.col("tick_id") % 89 + 1)


@query(TICKS_SQL + """, v AS (SELECT *, tick_id % 97 + 1 AS v, sum(tick_id % 97 + 1) OVER (PARTITION BY stream_id ORDER BY epoch, tick_id ROWS UNBOUNDED PRECEDING) AS cum FROM u)
SELECT stream_id, ((cum - v) // 2000)::BIGINT AS bar, min(epoch) AS t, arg_min(quote, epoch) AS open, max(quote) AS high, min(quote) AS low, arg_max(quote, epoch) AS close,
sum(v)::BIGINT AS size, round(sum(quote * v) / sum(v), 8) AS vwap, count(*) AS n, max(epoch) - min(epoch) AS dur_s FROM v GROUP BY ALL""")
def ref_a07_volume_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Volume bars of 2,000 units of a made-up size."""
    return bars.information_bars(ticks(spark, sf), ["stream_id"], F.col("tick_id") % 97 + 1, 2000).withColumn("vwap", F.round("vwap", 8))


@query(TICKS_SQL + """, l AS (SELECT stream_id, epoch, quote, lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch) AS p FROM u),
c AS (SELECT stream_id, epoch, quote, lag(epoch, 10) OVER (PARTITION BY stream_id ORDER BY epoch) AS e10, lag(quote, 10) OVER (PARTITION BY stream_id ORDER BY epoch) AS q10 FROM l WHERE quote <> p)
SELECT stream_id, epoch, epoch - e10 AS secs_10, round((quote / q10 - 1) * 10000, 6) AS ret_10 FROM c WHERE e10 IS NOT NULL""")
def ref_a08_tick_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Time and return over the last ten price changes."""
    order, hour = [F.col("epoch")], F.floor(F.col("epoch") / 3600)
    moved = with_previous(ticks(spark, sf), ["stream_id"], "epoch", order, ["quote"]).where("quote <> prev.quote")
    moves = numbered(moved, order, hour, ["stream_id"]).select("stream_id", "epoch", "quote", "nth")
    tenth = moves.select("stream_id", F.col("epoch").alias("e10"), F.col("quote").alias("q10"), (F.col("nth") + 10).alias("nth"))
    past = moves.join(tenth, ["stream_id", "nth"])
    return past.select("stream_id", "epoch", (F.col("epoch") - F.col("e10")).alias("secs_10"), F.round((F.col("quote") / F.col("q10") - 1) * 10000, 6).alias("ret_10"))


@query(TICKS_SQL + """, m AS (SELECT stream_id, epoch, abs(quote / lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch) - 1) * 10000 AS mv FROM u),
q AS (SELECT stream_id, quantile_cont(mv, 0.99) AS q99 FROM m GROUP BY 1)
SELECT stream_id, epoch // 300 * 300 AS t, count(*) FILTER (mv >= q99) AS n_large, round(coalesce(sum(mv) FILTER (mv >= q99), 0), 5) AS large_move, count(*) AS n FROM m JOIN q USING (stream_id) GROUP BY ALL""")
def ref_a09_large_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Moves of at least a stream's 99th percentile, per five minutes."""
    before = with_previous(ticks(spark, sf), ["stream_id"], "epoch", [F.col("epoch")], ["quote"])
    moves = before.select("stream_id", "epoch", (F.abs(F.col("quote") / F.col("prev.quote") - 1) * 10000).alias("mv"))
    limit = moves.groupBy("stream_id").agg(F.percentile("mv", 0.99).alias("q99"))
    large = F.col("mv") >= F.col("q99")
    return moves.join(limit, "stream_id").groupBy("stream_id", (F.floor(F.col("epoch") / 300) * 300).alias("t")).agg(
        F.count(F.when(large, 1)).alias("n_large"), F.round(F.coalesce(F.sum(F.when(large, F.col("mv"))), F.lit(0.0)), 5).alias("large_move"), F.count("*").alias("n")
    )


@query(TICKS_SQL + """ SELECT stream_id, strftime(timezone('America/New_York', to_timestamp(epoch)) - INTERVAL 17 HOUR, '%Y-%m-%d') AS trading_day, arg_min(quote, epoch) AS open,
max(quote) AS high, min(quote) AS low, arg_max(quote, epoch) AS close, count(*) AS n FROM u GROUP BY ALL""")
def ref_a10_trading_day_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of trading days that begin at 17:00 New York."""
    local = F.from_utc_timestamp(F.timestamp_seconds("epoch"), "America/New_York") - F.expr("INTERVAL 17 HOURS")
    return ticks(spark, sf).groupBy("stream_id", F.date_format(local, "yyyy-MM-dd").alias("trading_day")).agg(
        F.min_by("quote", "epoch").alias("open"), F.max("quote").alias("high"), F.min("quote").alias("low"), F.max_by("quote", "epoch").alias("close"), F.count("*").alias("n")
    )


@query(SCORED_SQL + """ SELECT isodow(to_timestamp(ts))::INT - 1 AS dow, hour(to_timestamp(ts)::TIMESTAMP)::INT AS hour, count(*) AS n, round(avg(abs(fwd_ret)) * 10000, 6) AS intensity FROM s GROUP BY ALL HAVING count(*) > 10""")
def ref_a11_event_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """Mean move by weekday and hour, where there is support."""
    at = F.timestamp_seconds("ts")
    cells = scored(spark, sf).groupBy(F.weekday(at).alias("dow"), F.hour(at).alias("hour"))
    return cells.agg(F.count("*").alias("n"), F.round(F.avg(F.abs("fwd_ret")) * 10000, 6).alias("intensity")).where("n > 10")


@query(TRAINED_SQL + """, train AS (SELECT * FROM s WHERE train), g AS (SELECT avg(abs(fwd_ret)) AS m FROM train),
prof AS (SELECT ts % 86400 // 60 AS minute, avg(abs(fwd_ret)) AS m FROM train GROUP BY 1), bins AS (SELECT unnest(range(1440)) AS minute)
SELECT bins.minute::BIGINT AS minute, round(coalesce(prof.m, g.m) * 10000, 6) AS profile FROM bins CROSS JOIN g LEFT JOIN prof ON prof.minute = bins.minute""")
def ref_a12_seasonal_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Mean move per minute of day of one half, empty minutes with the global mean."""
    train = trained(spark, sf).where("train")
    profile = train.groupBy(F.floor(F.col("ts") % 86400 / 60).alias("minute")).agg(F.avg(F.abs("fwd_ret")).alias("m"))
    whole = train.agg(F.avg(F.abs("fwd_ret")).alias("g"))
    bins = spark.range(1440).withColumnRenamed("id", "minute")
    return bins.join(profile, "minute", "left").join(F.broadcast(whole)).select("minute", F.round(F.coalesce("m", "g") * 10000, 6).alias("profile"))


@query(SCORED_SQL + """, q AS (SELECT *, ntile(5) OVER (PARTITION BY pair ORDER BY p, row_id) AS quintile FROM s)
SELECT pair, quintile::INT AS quintile, count(*) AS n, round(avg(y), 6) AS win_rate, round(1.96 * sqrt(avg(y) * (1 - avg(y)) / count(*)), 6) AS half_width FROM q GROUP BY ALL""")
def ref_a13_quintile_win_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Win rate by quintile of the score with its half width."""
    rows = scored(spark, sf)
    ranked = numbered(rows, [F.col("p"), F.col("row_id")], F.floor(F.col("p") * 200), ["pair"]).join(rows.groupBy("pair").agg(F.count("*").alias("m")), "pair")
    i, small, extra = F.col("nth") - 1, F.floor(F.col("m") / 5), F.col("m") % 5  # the first `extra` fifths have one row more
    place = F.when(i < extra * (small + 1), F.floor(i / (small + 1))).otherwise(extra + F.floor(F.try_divide(i - extra * (small + 1), small)))
    q = ranked.withColumn("quintile", (place + 1).cast("int"))
    rate = F.avg("y")
    return q.groupBy("pair", "quintile").agg(F.count("*").alias("n"), F.round(rate, 6).alias("win_rate"), F.round(1.96 * F.sqrt(rate * (1 - rate) / F.count("*")), 6).alias("half_width"))


@query(SCORED_SQL + """, c AS (SELECT pair, ts % 86400 // 3600 AS hour, avg(y) AS base FROM s GROUP BY ALL)
SELECT s.pair, count(*) AS n, round(avg(y), 6) AS win_rate, round(avg(y - base), 6) AS excess FROM s JOIN c ON c.pair = s.pair AND c.hour = s.ts % 86400 // 3600 WHERE p >= 0.8 GROUP BY s.pair""")
def ref_a14_cell_excess(spark: SparkSession, sf: str) -> DataFrame:
    """Win rate of selected rows over the baseline of their pair and hour."""
    rows = scored(spark, sf).withColumn("hour", F.floor(F.col("ts") % 86400 / 3600))
    base = rows.groupBy("pair", "hour").agg(F.avg("y").alias("base"))
    return rows.where("p >= 0.8").join(base, ["pair", "hour"]).groupBy("pair").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("win_rate"), F.round(F.avg(F.col("y") - F.col("base")), 6).alias("excess"))


@query(SCORED_SQL + """ SELECT strftime(timezone('America/New_York', to_timestamp(ts)), '%Y%m%d')::INT AS ny_date, sum(y)::BIGINT AS numerator, count(*) AS denominator, round(sum(y) / count(*), 6) AS ratio FROM s GROUP BY ALL""")
def ref_a15_date_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Numerator, denominator and ratio per New York date."""
    date = F.date_format(F.from_utc_timestamp(F.timestamp_seconds("ts"), "America/New_York"), "yyyyMMdd").cast("int")
    return scored(spark, sf).groupBy(date.alias("ny_date")).agg(F.sum("y").alias("numerator"), F.count("*").alias("denominator"), F.round(F.sum("y") / F.count("*"), 6).alias("ratio"))


@query(SCORED_SQL + """, m AS (SELECT pair, avg(y) AS m FROM s GROUP BY 1), c AS (SELECT s.pair, ts // 86400 AS day, sum(y - m) AS r FROM s JOIN m USING (pair) GROUP BY ALL),
v AS (SELECT pair, sum(r * r) AS cl FROM c GROUP BY 1), i AS (SELECT s.pair, sum((y - m) * (y - m)) AS iid, count(*) AS n FROM s JOIN m USING (pair) GROUP BY 1)
SELECT pair, n, round(cl / nullif(iid, 0), 6) AS vif FROM v JOIN i USING (pair)""")
def ref_a16_cluster_vif(spark: SparkSession, sf: str) -> DataFrame:
    """Variance inflation by day clusters."""
    rows = scored(spark, sf)
    dev = rows.join(rows.groupBy("pair").agg(F.avg("y").alias("m")), "pair").withColumn("r", F.col("y") - F.col("m"))
    days = dev.groupBy("pair", F.floor(F.col("ts") / 86400).alias("day")).agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count("*").alias("k"))
    return days.groupBy("pair").agg(F.sum("k").alias("n"), F.round(F.try_divide(F.sum(F.col("s") * F.col("s")), F.sum("q")), 6).alias("vif"))


@query(SCORED_SQL + """, c AS (SELECT pair, sum((p >= 0.9 AND y = 1)::INT) a, sum((p >= 0.9 AND y = 0)::INT) b, sum((p < 0.9 AND y = 1)::INT) c, sum((p < 0.9 AND y = 0)::INT) d FROM s GROUP BY 1)
SELECT pair, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round((a + b + c + d) * pow(a * d - b * c, 2) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0), 6) AS chi2 FROM c""")
def ref_a17_chi_square(spark: SparkSession, sf: str) -> DataFrame:
    """Chi square of a two-by-two table per pair."""
    flag = lambda cond: F.sum(F.expr(cond).cast("int"))
    c = scored(spark, sf).groupBy("pair").agg(flag("p >= 0.9 AND y = 1").alias("a"), flag("p >= 0.9 AND y = 0").alias("b"), flag("p < 0.9 AND y = 1").alias("c"), flag("p < 0.9 AND y = 0").alias("d"))
    a, b, c_, d = (F.col(x).cast("double") for x in "abcd")
    chi = F.try_divide((a + b + c_ + d) * F.pow(a * d - b * c_, F.lit(2)), (a + b) * (c_ + d) * (a + c_) * (b + d))
    return c.select("pair", "a", "b", "c", "d", F.round(chi, 6).alias("chi2"))


@query("""SELECT prereg_id, decision_close_epoch, count(*) AS n, count(DISTINCT stream_id) AS n_streams, max(recorded_epoch) AS last_recorded FROM decisions GROUP BY ALL HAVING count(*) > 1""")
def ref_a18_duplicate_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions that were recorded more than once."""
    groups = table(spark, sf, "decisions").groupBy("prereg_id", "decision_close_epoch")
    return groups.agg(F.count("*").alias("n"), F.count_distinct("stream_id").alias("n_streams"), F.max("recorded_epoch").alias("last_recorded")).where("n > 1")


@query(SCORED_SQL + """, d AS (SELECT ts // 86400 AS day, pair, avg(fwd_ret) AS r FROM s GROUP BY ALL)
SELECT day, pair, round((r - avg(r) OVER (PARTITION BY pair)) / nullif(stddev_samp(r) OVER (PARTITION BY pair), 0), 6) AS z FROM d""")
def ref_a19_group_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean return as a z-score within its pair."""
    d = scored(spark, sf).groupBy(F.floor(F.col("ts") / 86400).alias("day"), "pair").agg(F.avg("fwd_ret").alias("r"))
    w = Window.partitionBy("pair")
    return d.select("day", "pair", F.round(F.try_divide(F.col("r") - F.avg("r").over(w), F.stddev_samp("r").over(w)), 6).alias("z"))


@query("""WITH d AS (SELECT stream_id, decision_close_epoch - lag(decision_close_epoch) OVER (PARTITION BY stream_id ORDER BY decision_close_epoch, decision_id) AS gap FROM decisions)
SELECT stream_id, count(*) AS n, min(gap) AS min_gap, count(*) FILTER (gap < 60) AS n_close FROM d GROUP BY 1""")
def ref_a20_overlap_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest gap between decisions of a stream, and how many are closer than a minute."""
    at = "decision_close_epoch"
    d = with_previous(table(spark, sf, "decisions").select("stream_id", at, "decision_id"), ["stream_id"], at, [F.col(at), F.col("decision_id")], [at])
    d = d.withColumn("gap", F.col(at) - F.col(f"prev.{at}"))
    return d.groupBy("stream_id").agg(F.count("*").alias("n"), F.min("gap").alias("min_gap"), F.count(F.when(F.col("gap") < 60, 1)).alias("n_close"))


@query(TICKS_SQL + """ SELECT stream_id, round(quantile_cont(quote, 0.1), 8) AS q10, round(quantile_cont(quote, 0.5), 8) AS q50, round(quantile_cont(quote, 0.9), 8) AS q90, round(quantile_cont(quote, 0.9) FILTER (epoch % 2 = 0), 8) AS q90_even FROM u GROUP BY 1""")
def ref_a21_exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact linear-interpolated quantiles, also over a mask."""
    q = lambda c, at: F.round(F.percentile(c, at), 8)
    even = F.when(F.col("epoch") % 2 == 0, F.col("quote"))
    return ticks(spark, sf).groupBy("stream_id").agg(q("quote", 0.1).alias("q10"), q("quote", 0.5).alias("q50"), q("quote", 0.9).alias("q90"), q(even, 0.9).alias("q90_even"))


@query(BARS_SQL + """, r AS (SELECT stream_id, n, row_number() OVER (PARTITION BY stream_id ORDER BY n) AS k, count(*) OVER (PARTITION BY stream_id) AS m FROM b)
SELECT stream_id, max(n) FILTER (k = floor(0.95 * (m - 1))::INT + 1) AS p95 FROM r GROUP BY 1""")
def ref_a22_index_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """The element at position floor(q (n - 1)) of the sorted values."""
    w = Window.partitionBy("stream_id")
    r = minute_bars(spark, sf).select("stream_id", "n", F.row_number().over(w.orderBy("n")).alias("k"), F.count("*").over(w).alias("m"))
    return r.groupBy("stream_id").agg(F.max(F.when(F.col("k") == F.floor(0.95 * (F.col("m") - 1)) + 1, F.col("n"))).alias("p95"))


@query(BARS_SQL + """, r AS (SELECT stream_id, close, (close / lag(close) OVER (PARTITION BY stream_id ORDER BY t) - 1) * 10000 AS r FROM b), f AS (SELECT * FROM r WHERE r IS NOT NULL)
SELECT stream_id, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS sd, round(stddev_pop(r), 6) AS sd_pop, round(skewness(r), 4) AS skew, round(kurtosis(r), 4) AS kurt FROM f GROUP BY 1""")
def ref_a23_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Moments of bar returns with the bias-corrected skewness and kurtosis."""
    w = Window.partitionBy("stream_id").orderBy("t")
    r = minute_bars(spark, sf).select("stream_id", ((F.col("close") / F.lag("close").over(w) - 1) * 10000).alias("r")).where("r IS NOT NULL")
    n = F.count("r").cast("double")
    skew = F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.kurtosis("r") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return r.groupBy("stream_id").agg(
        F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_samp("r"), 6).alias("sd"), F.round(F.stddev_pop("r"), 6).alias("sd_pop"),
        F.round(skew, 4).alias("skew"), F.round(kurt, 4).alias("kurt"),
    )


@query(TICKS_SQL + """, g AS (SELECT epoch - lag(epoch) OVER (PARTITION BY stream_id ORDER BY epoch) AS gap FROM u), h AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1)
SELECT gap, n, (sum(n) OVER (ORDER BY gap DESC))::BIGINT AS at_risk, round(n / sum(n) OVER (ORDER BY gap DESC), 6) AS hazard FROM h""")
def ref_a24_gap_hazard(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of gaps with the hazard n / survivors; the window runs over distinct gaps only."""
    before = with_previous(ticks(spark, sf), ["stream_id"], "epoch", [F.col("epoch")], ["epoch"])
    h = before.select((F.col("epoch") - F.col("prev.epoch")).alias("gap")).where("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))
    risk = F.sum("n").over(Window.orderBy(F.desc("gap")).rowsBetween(Window.unboundedPreceding, 0))
    return h.select("gap", "n", risk.alias("at_risk"), F.round(F.col("n") / risk, 6).alias("hazard"))


@query("SELECT stream_id, count(DISTINCT pair) AS n_pairs, count(DISTINCT decision_close_epoch // 60) AS n_minutes, count(DISTINCT exclusion_reason) AS n_reasons FROM decisions GROUP BY 1")
def ref_a25_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct aggregates."""
    return table(spark, sf, "decisions").groupBy("stream_id").agg(
        F.count_distinct("pair").alias("n_pairs"), F.count_distinct(F.floor(F.col("decision_close_epoch") / 60)).alias("n_minutes"), F.count_distinct("exclusion_reason").alias("n_reasons")
    )
