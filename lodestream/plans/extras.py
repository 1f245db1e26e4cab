"""Further queries: more feature blocks, policies, price tables and placebo checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import asof as A
from lodestream.operators import policies as P
from lodestream.operators import rolling as R
from lodestream.operators.scan import numbered
from lodestream.plans.base import BARS_SQL, SCORED_SQL, TICKS_SQL, TRAINED_SQL, Registry, first_half, minute_bars, scored, ticks, trained
from lodestream.plans.evaluation import _WIN_SQL
from lodestream.plans.evaluation import win as won
from lodestream.plans.features import roll
from lodestream.plans.windows import KEY, RET_SQL, returns, rolled
from lodestream.runtime import table

query = Registry()


@query("SELECT row_id FROM label_rows WHERE row_id IS NOT NULL ORDER BY md5(row_id::VARCHAR || ':7'), row_id LIMIT 100")
def ref_proj06_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """100 rows without replacement by a seeded hash: the sample is the feature. Top-k per task, no global sort."""
    return table(spark, sf, "label_rows").where("row_id IS NOT NULL").orderBy(F.md5(F.concat(F.col("row_id").cast("string"), F.lit(":7"))), "row_id").limit(100).select("row_id")


@query(RET_SQL + ", p AS (SELECT * FROM r WHERE stream_id LIKE '%:alder'), q AS (SELECT DISTINCT t FROM r) SELECT p.stream_id AS peer, q.t, CASE WHEN q.t - p.t <= 180 THEN round(p.close, 8) END AS peer_close FROM (SELECT stream_id, q.t FROM q, (SELECT DISTINCT stream_id FROM p)) q ASOF JOIN p ON p.stream_id = q.stream_id AND q.t >= p.t")
def ref_f05_peer_block(spark: SparkSession, sf: str) -> DataFrame:
    """Peers' last closes on the common clock, three bars old at most."""
    r = returns(spark, sf).select("stream_id", "t", "close")
    peers = r.where("stream_id LIKE '%:alder'")
    clock = r.select("t").distinct().join(F.broadcast(table(spark, sf, "streams").where("stream_id LIKE '%:alder'").select("stream_id")).join(peers.select("stream_id").distinct(), "stream_id"))  # streams: a fixed table
    j = A.asof(clock.select("stream_id", "t"), peers.withColumn("seq", F.col("t")), KEY, "t", "seq", ["close"]).where("match IS NOT NULL")
    return j.select(F.col("stream_id").alias("peer"), "t", F.when(F.col("t") - F.col("match.on") <= 180, F.round("match.close", 8)).alias("peer_close"))


@query(RET_SQL + f""", f AS (SELECT t, sum(r) AS s, count(r) AS m FROM r GROUP BY t), j AS (SELECT stream_id, t, r - (s - r) / nullif(m - 1, 0) AS gap FROM r JOIN f USING (t) WHERE r IS NOT NULL)
SELECT stream_id, t, round(gap, 5) AS gap, round((gap - {rolled('avg(gap)', 'gap', 60)}) / ({rolled('stddev_samp(gap)', 'gap', 60)} + 1e-6), 4) AS gap_z FROM j""")
def ref_f08_exogenous_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Gap to the others' mean return and its z-score over 60 bars."""
    r = returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", "r")
    f = r.groupBy("t").agg(F.sum("r").alias("s"), F.count("r").alias("n"))
    j = r.join(f, "t").select("stream_id", "t", (F.col("r") - F.try_divide(F.col("s") - F.col("r"), F.col("n") - 1)).alias("gap"))
    z = (F.col("gap") - roll(F.avg("gap"), "gap", 60)) / (roll(F.stddev_samp("gap"), "gap", 60) + 1e-6)
    return j.select("stream_id", "t", F.round("gap", 5).alias("gap"), F.round(z, 4).alias("gap_z"))


@query(RET_SQL + """ SELECT a.stream_id, a.t, round((a.close / b.close - 1) * 10000, 5) AS ret_15m, a.t - b.t AS age FROM r a ASOF LEFT JOIN (SELECT stream_id, t + 900 AS due, t, close FROM r) b ON a.stream_id = b.stream_id AND a.t >= b.due""")
def ref_f15_wall_clock_return(spark: SparkSession, sf: str) -> DataFrame:
    """Return over fifteen minutes by the clock, not by bars, with the age of its start."""
    b = returns(spark, sf).select("stream_id", "t", "close")
    past = b.select("stream_id", (F.col("t") + 900).alias("t"), F.col("t").alias("seq"), F.col("close").alias("then"))
    j = A.asof(b, past, KEY, "t", "seq", ["then"])
    return j.select("stream_id", "t", F.round((F.col("close") / F.col("match.then") - 1) * 10000, 5).alias("ret_15m"), (F.col("t") - F.col("match.seq")).alias("age"))


@query(RET_SQL + f""", d AS (SELECT *, max(high) OVER (PARTITION BY stream_id, t // 7200) AS hi, min(low) OVER (PARTITION BY stream_id, t // 7200) AS lo FROM r), p AS (SELECT DISTINCT stream_id, t // 7200 AS blk, hi, lo FROM d), l AS (SELECT stream_id, blk, lag(hi) OVER (PARTITION BY stream_id ORDER BY blk) AS prev_hi, lag(lo) OVER (PARTITION BY stream_id ORDER BY blk) AS prev_lo FROM p)
SELECT r.stream_id, r.t, (r.close > prev_hi)::INT AS above, (r.close < prev_lo)::INT AS below FROM r JOIN l ON l.stream_id = r.stream_id AND l.blk = r.t // 7200""")
def ref_f23_previous_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Close against the previous two-hour block's high and low."""
    b = returns(spark, sf).withColumn("blk", F.floor(F.col("t") / 7200))
    p = b.groupBy("stream_id", "blk").agg(F.max("high").alias("hi"), F.min("low").alias("lo"))
    w = Window.partitionBy("stream_id").orderBy("blk")
    l = p.select("stream_id", "blk", F.lag("hi").over(w).alias("prev_hi"), F.lag("lo").over(w).alias("prev_lo"))  # noqa: E741
    return b.join(l, ["stream_id", "blk"]).select("stream_id", "t", (F.col("close") > F.col("prev_hi")).cast("int").alias("above"), (F.col("close") < F.col("prev_lo")).cast("int").alias("below"))


@query(TICKS_SQL + """, d AS (SELECT *, sign(quote - lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch)) AS s FROM u), c AS (SELECT stream_id, epoch // 60 * 60 AS t, count(*) FILTER (s > 0) AS up, count(*) FILTER (s < 0) AS dn FROM d GROUP BY ALL)
SELECT stream_id, t, round((up - dn) / (up + dn + 1), 6) AS imbalance FROM c""")
def ref_f36_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """Imbalance of up and down ticks per minute."""
    from lodestream.operators.scan import with_previous

    d = with_previous(ticks(spark, sf), KEY, "epoch", [F.col("epoch")], ["quote"]).withColumn("s", F.signum(F.col("quote") - F.col("prev.quote")))
    c = d.groupBy("stream_id", (F.floor(F.col("epoch") / 60) * 60).alias("t")).agg(F.count(F.when(F.col("s") > 0, 1)).alias("up"), F.count(F.when(F.col("s") < 0, 1)).alias("dn"))
    return c.select("stream_id", "t", F.round((F.col("up") - F.col("dn")) / (F.col("up") + F.col("dn") + 1), 6).alias("imbalance"))


@query()
def ref_f19_market_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals beyond the components above the random-matrix edge of each venue's dollar-signed returns.

    Refitted every 60 minutes of the venue's grid on the 2,880 strictly before, on which a missing
    or wild return is 0; NULL for the first 2,880.
    """
    sign = F.when(F.col("stream_id").startswith("USD"), -1).otherwise(1)
    r = returns(spark, sf).select("stream_id", "t", F.split_part("stream_id", F.lit(":"), F.lit(2)).alias("venue"), (sign * F.log1p(F.col("r") / 10_000)).alias("r"))
    return P.residuals_by_chunks(r, "venue", "stream_id", "t", "r").select("stream_id", "t", "resid")


@query(TRAINED_SQL + """, m AS (SELECT pair, median(fwd_ret) AS md, avg(fwd_ret) AS mu, stddev_samp(fwd_ret) AS sd FROM s WHERE train GROUP BY 1) SELECT row_id, round(greatest(least((fwd_ret - mu) / nullif(sd, 0), 5), -5), 5) AS z FROM s JOIN m USING (pair)""")
def ref_x05_standardize(spark: SparkSession, sf: str) -> DataFrame:
    """z-scores by training moments, clipped to five."""
    s = trained(spark, sf)
    m = s.where("train").groupBy("pair").agg(F.avg("fwd_ret").alias("mu"), F.stddev_samp("fwd_ret").alias("sd"))
    z = F.try_divide(F.col("fwd_ret") - F.col("mu"), F.col("sd"))
    return s.join(m, "pair").select("row_id", F.round(F.when(z.isNotNull(), F.greatest(F.least(z, F.lit(5.0)), F.lit(-5.0))), 5).alias("z"))


@query(SCORED_SQL + """ SELECT row_id, CASE WHEN ev_up >= ev_dn THEN 'UP' ELSE 'DOWN' END AS side, round(greatest(ev_up, ev_dn), 6) AS ev FROM (SELECT row_id, p * (1.6 + row_id % 7 * 0.05) - 1 AS ev_up, (1 - p) * (1.6 + row_id % 5 * 0.05) - 1 AS ev_dn FROM s)""")
def ref_x03_two_sided_value(spark: SparkSession, sf: str) -> DataFrame:
    """The side of the larger expected value at made-up payouts."""
    up, dn = F.col("p") * (1.6 + F.col("row_id") % 7 * 0.05) - 1, (1 - F.col("p")) * (1.6 + F.col("row_id") % 5 * 0.05) - 1
    return scored(spark, sf).select("row_id", F.when(up >= dn, "UP").otherwise("DOWN").alias("side"), F.round(F.greatest(up, dn), 6).alias("ev"))


@query(SCORED_SQL + f""", b AS (SELECT pair, a, (ts >= m)::INT AS half, avg(((a * p + (1 - a) * q > 0.5) = (fwd_ret > 0))::INT) AS wr FROM (SELECT s.*, row_id * 104729 % 1000 / 1000 AS q FROM s) s JOIN (SELECT pair, median(ts) AS m FROM s GROUP BY 1) USING (pair), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS a) GROUP BY ALL),
w AS (SELECT pair, a, min(wr) AS worst FROM b GROUP BY ALL) SELECT pair, a::DOUBLE AS weight, round(worst, 6) AS worst FROM w QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(worst, 6) DESC, a) = 1""")
def ref_x06_blend_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of two scores by the worse half's hit rate."""
    s = scored(spark, sf).withColumn("q", F.pmod(F.col("row_id") * 104729, F.lit(1000)) / 1000)
    halves = s.join(s.groupBy("pair").agg(F.median("ts").alias("m")), "pair").withColumn("half", (F.col("ts") >= F.col("m")).cast("int"))
    grid = halves.withColumn("weight", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    hit = ((F.col("weight") * F.col("p") + (1 - F.col("weight")) * F.col("q") > 0.5) == (F.col("fwd_ret") > 0)).cast("int")
    w = grid.groupBy("pair", "weight", "half").agg(F.avg(hit).alias("wr")).groupBy("pair", "weight").agg(F.round(F.min("wr"), 6).alias("worst"))
    return w.groupBy("pair").agg(F.max_by("weight", F.struct("worst", -F.col("weight"))).alias("weight"), F.max("worst").alias("worst"))


@query("""WITH t AS (SELECT DISTINCT pair, decision_close_epoch AS t FROM decisions UNION SELECT DISTINCT pair, epoch(datetime_utc)::BIGINT FROM label_rows WHERE datetime_utc IS NOT NULL),
o AS (SELECT DISTINCT pair, isodow(to_timestamp(decision_close_epoch)::TIMESTAMP) AS dow, decision_close_epoch % 86400 // 1800 AS bucket FROM decisions) SELECT t.pair, t.t, (o.pair IS NOT NULL)::INT AS offered FROM t LEFT JOIN o ON o.pair = t.pair AND o.dow = isodow(to_timestamp(t.t)::TIMESTAMP) AND o.bucket = t.t % 86400 // 1800""")
def ref_x08_price_table(spark: SparkSession, sf: str) -> DataFrame:
    """Union of decision times over tables, with a weekday and clock-bucket lookup."""
    d = table(spark, sf, "decisions").select("pair", F.col("decision_close_epoch").alias("t"))
    l = table(spark, sf, "label_rows").where("datetime_utc IS NOT NULL").select("pair", F.unix_seconds(F.col("datetime_utc").cast("timestamp")).alias("t"))  # noqa: E741
    cell = lambda df: df.withColumn("dow", F.weekday(F.timestamp_seconds("t"))).withColumn("bucket", F.floor(F.col("t") % 86400 / 1800))
    offered = cell(d).select("pair", "dow", "bucket").distinct().withColumn("hit", F.lit(1))
    return cell(d.unionByName(l).distinct()).join(offered, ["pair", "dow", "bucket"], "left").select("pair", "t", F.coalesce("hit", F.lit(0)).alias("offered"))


@query(RET_SQL + f""", f AS (SELECT stream_id, t, {rolled('stddev_samp(r)', 'r', 20)} AS sd FROM r), q AS (SELECT stream_id, quantile_cont(sd, 1/3) AS lo, quantile_cont(sd, 2/3) AS hi FROM f WHERE sd IS NOT NULL AND t <= (SELECT (min(t) + max(t)) // 2 FROM f WHERE sd IS NOT NULL) GROUP BY 1)
SELECT stream_id, t, CASE WHEN sd <= lo THEN 'compressed' WHEN sd >= hi THEN 'expanded' ELSE 'normal' END AS regime FROM f JOIN q USING (stream_id) WHERE sd IS NOT NULL""")
def ref_x09_regime_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Regimes by terciles of volatility in the first half of time."""
    f = returns(spark, sf).select("stream_id", "t", roll(F.stddev_samp("r"), "r", 20).alias("sd")).where("sd IS NOT NULL")
    q = first_half(f).groupBy("stream_id").agg(F.percentile("sd", 1 / 3).alias("lo"), F.percentile("sd", 2 / 3).alias("hi"))
    regime = F.when(F.col("sd") <= F.col("lo"), "compressed").when(F.col("sd") >= F.col("hi"), "expanded").otherwise("normal")
    return f.join(q, "stream_id").select("stream_id", "t", regime.alias("regime"))


@query(BARS_SQL + """, ev AS (SELECT DISTINCT stream_id, decision_close_epoch AS e FROM decisions WHERE candidate_direction = 'UP'), n AS (SELECT ev.stream_id, e, b.t, b.close FROM ev ASOF JOIN b ON b.stream_id = ev.stream_id AND b.t >= ev.e WHERE b.t - ev.e <= 120),
x AS (SELECT n.stream_id, n.e, n.close AS c0, b.close AS c1 FROM n JOIN b ON b.stream_id = n.stream_id AND b.t = n.t + 600) SELECT stream_id, count(*) AS n, round(avg((c1 > c0)::INT), 6) AS hit FROM x GROUP BY 1""")
def ref_x10_event_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rate of a rule: the first bar within 120 s of an event, held exactly ten minutes."""
    b = minute_bars(spark, sf).select("stream_id", "t", "close")
    ev = table(spark, sf, "decisions").where("candidate_direction = 'UP'").select("stream_id", F.col("decision_close_epoch").alias("t")).distinct()
    n = A.asof(ev, b.withColumn("seq", F.col("t")), KEY, "t", "seq", ["close"], forward=True, tolerance=120).where("match IS NOT NULL")
    later = b.select("stream_id", (F.col("t") - 600).alias("t0"), F.col("close").alias("c1"))
    x = n.select("stream_id", F.col("match.on").alias("t0"), F.col("match.close").alias("c0")).join(later, ["stream_id", "t0"])
    return x.groupBy("stream_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("c1") > F.col("c0")).cast("int")), 6).alias("hit"))


@query(BARS_SQL + """, a AS (SELECT stream_id, strftime(timezone('Europe/London', to_timestamp(t)), '%Y-%m-%d') AS day, arg_min(close, t) FILTER (hour(timezone('Europe/London', to_timestamp(t))) >= 8) AS anchor, min(t) FILTER (hour(timezone('Europe/London', to_timestamp(t))) >= 8) AS at FROM b GROUP BY ALL)
SELECT b.stream_id, b.t, round((close / anchor - 1) * 10000, 5) AS since FROM b JOIN a ON a.stream_id = b.stream_id AND a.day = strftime(timezone('Europe/London', to_timestamp(b.t)), '%Y-%m-%d') WHERE b.t >= a.at""")
def ref_x11_local_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """Return since the first bar at or after 08:00 London, for the rows from it on."""
    local = F.from_utc_timestamp(F.timestamp_seconds("t"), "Europe/London")
    b = minute_bars(spark, sf).withColumn("day", F.date_format(local, "yyyy-MM-dd")).withColumn("late", F.hour(local) >= 8)
    a = b.where("late").groupBy("stream_id", "day").agg(F.min_by("close", "t").alias("anchor"), F.min("t").alias("at"))
    return b.join(a, ["stream_id", "day"]).where("t >= at").select("stream_id", "t", F.round((F.col("close") / F.col("anchor") - 1) * 10000, 5).alias("since"))


@query("""WITH g AS (SELECT stream_id, decision_close_epoch // 60 * 60 AS t, count(*) AS n FROM decisions GROUP BY ALL), e AS (SELECT stream_id, unnest(range(min(t), max(t) + 60, 60)) AS t FROM g GROUP BY 1) SELECT stream_id, t, coalesce(n, 0) AS n FROM e LEFT JOIN g USING (stream_id, t)""")
def ref_x12_events_to_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular events counted on a dense minute grid, empty minutes 0."""
    g = table(spark, sf, "decisions").groupBy("stream_id", (F.floor(F.col("decision_close_epoch") / 60) * 60).alias("t")).agg(F.count("*").alias("n"))
    e = g.groupBy("stream_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("stream_id", F.explode(F.sequence("lo", "hi", F.lit(60).cast("bigint"))).alias("t"))
    return e.join(g, ["stream_id", "t"], "left").select("stream_id", "t", F.coalesce("n", F.lit(0)).alias("n"))


@query(SCORED_SQL + """, j AS (SELECT row_id, to_timestamp(ts)::TIMESTAMP + INTERVAL 9 HOUR AS jst FROM s) SELECT row_id, (day(jst) % 5 = 0)::INT AS gotobi, greatest(least(595 - (hour(jst) * 60 + minute(jst)), 120), -120)::INT AS to_fix, (abs(595 - (hour(jst) * 60 + minute(jst))) <= 30)::INT AS near_fix FROM j""")
def ref_x14_fix_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Fifth-days and minutes to the 09:55 fix, at a fixed offset of nine hours."""
    jst = F.timestamp_seconds(F.col("ts") + 32_400)
    left = F.lit(595) - (F.hour(jst) * 60 + F.minute(jst))
    return scored(spark, sf).select("row_id", (F.dayofmonth(jst) % 5 == 0).cast("int").alias("gotobi"), F.greatest(F.least(left, F.lit(120)), F.lit(-120)).alias("to_fix"), (F.abs(left) <= 30).cast("int").alias("near_fix"))


@query(BARS_SQL + """, v AS (SELECT split_part(stream_id, ':', 2) AS venue, t, max(ln(close)) FILTER (split_part(stream_id, ':', 1) = 'EURUSD') AS y, max(ln(close)) FILTER (split_part(stream_id, ':', 1) = 'GBPUSD') AS x FROM b GROUP BY ALL), k AS (SELECT * FROM v WHERE x IS NOT NULL AND y IS NOT NULL),
h AS (SELECT *, t <= (SELECT (min(t) + max(t)) // 2 FROM k) AS train FROM k), o AS (SELECT venue, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM h WHERE train GROUP BY 1), e AS (SELECT venue, t, train, (y - b0 - b1 * x) * 10000 AS e FROM h JOIN o USING (venue)),
q AS (SELECT venue, stddev_samp(e) AS sd FROM e WHERE train GROUP BY 1) SELECT venue, t, CASE WHEN e > sd THEN -1 WHEN e < -sd THEN 1 ELSE 0 END AS signal FROM e JOIN q USING (venue)""")
def ref_x16_cointegration(spark: SparkSession, sf: str) -> DataFrame:
    """Reversion signal of the residual of a line fitted on the first half of time, on every venue that has both legs."""
    of = lambda i: F.split_part("stream_id", F.lit(":"), F.lit(i))
    leg = lambda p, n: F.max(F.when(F.col("pair") == p, F.log("close"))).alias(n)
    b = minute_bars(spark, sf).withColumns({"pair": of(1), "venue": of(2)}).where(F.col("pair").isin("EURUSD", "GBPUSD"))
    v = b.groupBy("venue", "t").agg(leg("EURUSD", "y"), leg("GBPUSD", "x")).dropna()
    o = first_half(v).groupBy("venue").agg(F.regr_slope("y", "x").alias("b1"), F.regr_intercept("y", "x").alias("b0"))
    e = v.join(o, "venue").select("venue", "t", ((F.col("y") - F.col("b0") - F.col("b1") * F.col("x")) * 10000).alias("e"))
    sd = first_half(e).groupBy("venue").agg(F.stddev_samp("e").alias("sd"))
    return e.join(sd, "venue").select("venue", "t", F.when(F.col("e") > F.col("sd"), -1).when(F.col("e") < -F.col("sd"), 1).otherwise(0).alias("signal"))


_HALF = 1 - 0.5 ** (1 / 8)


@query(RET_SQL + f""", x AS (SELECT stream_id, t, r, row_number() OVER (PARTITION BY stream_id ORDER BY t) - 1 AS i FROM r WHERE r IS NOT NULL)
SELECT a.stream_id, a.t, round(sum(CASE WHEN b.i = 0 THEN pow({1 - _HALF}, a.i) ELSE {_HALF} * pow({1 - _HALF}, a.i - b.i) END * b.r) / {_HALF}, 5) AS kernel FROM x a JOIN x b ON a.stream_id = b.stream_id AND b.i <= a.i GROUP BY a.stream_id, a.t""")
def ref_x19_half_life_kernel(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential mean of half-life eight bars, scaled to a sum."""
    r = returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", "r")
    return R.ewm(r, KEY, "t", "r", _HALF, "y").select("stream_id", "t", F.round(F.col("y") / _HALF, 5).alias("kernel"))


@query("""SELECT row_id, CASE WHEN h * 60 + m >= 960 AND h * 60 + m < 995 THEN 'dropped' WHEN h < 12 THEN 'morning' ELSE 'afternoon' END AS part FROM (SELECT row_id, hour(timezone('America/New_York', to_timestamp(ts))) AS h, minute(timezone('America/New_York', to_timestamp(ts))) AS m FROM (""" + SCORED_SQL + """ SELECT * FROM s))""")
def ref_x22_local_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Named New York windows with the dropped one from 16:00 to 16:35."""
    local = F.from_utc_timestamp(F.timestamp_seconds("ts"), "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    return scored(spark, sf).select("row_id", F.when(minute.between(960, 994), "dropped").when(F.hour(local) < 12, "morning").otherwise("afternoon").alias("part"))


@query("""WITH old AS (SELECT prereg_id, decision_close_epoch, min(decision_id) AS id FROM decisions WHERE decision_id % 3 <> 0 GROUP BY ALL), new AS (SELECT prereg_id, decision_close_epoch, min(decision_id) AS id FROM decisions WHERE decision_id % 3 = 0 GROUP BY ALL)
SELECT id, 'kept' AS outcome FROM old UNION ALL SELECT id, 'inserted' FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.prereg_id = new.prereg_id AND old.decision_close_epoch = new.decision_close_epoch)""")
def ref_x24_insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Insert that does nothing on a conflict of the natural key."""
    key = ["prereg_id", "decision_close_epoch"]
    d = table(spark, sf, "decisions")
    old, new = (d.where(c).groupBy(*key).agg(F.min("decision_id").alias("id")) for c in ("decision_id % 3 <> 0", "decision_id % 3 = 0"))
    return old.select("id", F.lit("kept").alias("outcome")).unionByName(new.join(old, key, "left_anti").select("id", F.lit("inserted").alias("outcome")))


@query(SCORED_SQL + """, e AS (SELECT pair, min(ts) + (max(ts) - min(ts)) * 85 // 100 AS edge FROM s GROUP BY 1) SELECT pair, CASE WHEN ts >= edge THEN 'valid' WHEN ts >= edge - 1800 THEN 'purged' ELSE 'train' END AS part, count(*) AS n FROM s JOIN e USING (pair) GROUP BY ALL""")
def ref_x25_late_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The last 15 % of time as validation, purged by one horizon."""
    s = scored(spark, sf)
    e = s.groupBy("pair").agg((F.min("ts") + F.floor((F.max("ts") - F.min("ts")) * 85 / 100)).alias("edge"))
    part = F.when(F.col("ts") >= F.col("edge"), "valid").when(F.col("ts") >= F.col("edge") - 1800, "purged").otherwise("train")
    return s.join(e, "pair").groupBy("pair", part.alias("part")).agg(F.count("*").alias("n"))


@query(SCORED_SQL + """, r AS (SELECT row_id, row_number() OVER (ORDER BY ts, row_id) - 1 AS i, count(*) OVER () AS n FROM s), k AS (SELECT DISTINCT CASE WHEN n <= 200 THEN k ELSE k * (n - 1) // 199 END AS i FROM (SELECT DISTINCT n FROM r), range(200) t(k) WHERE k < n) SELECT row_id FROM r JOIN k USING (i)""")
def ref_x27_capped_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """A fit cap: ranks floor(linspace(0, n - 1, 200)); the cap is the feature."""
    s = scored(spark, sf)
    r = numbered(s, [F.col("ts"), F.col("row_id")], F.floor(F.col("ts") / 86_400)).withColumn("i", F.col("nth") - 1).join(F.broadcast(s.agg(F.count("*").alias("n"))))
    k = F.ceil(F.col("i") * 199 / (F.col("n") - 1))
    return r.where((F.col("n") <= 200) | (F.floor(k * (F.col("n") - 1) / 199) == F.col("i"))).select("row_id")


@query(SCORED_SQL + f""", n AS (SELECT pair, {_WIN_SQL} AS won, row_number() OVER (PARTITION BY pair ORDER BY ts, row_id) AS nth FROM s), w AS (SELECT pair, coalesce(sum(won) FILTER (nth <= 60), 0)::BIGINT AS first, coalesce(sum(won) FILTER (nth <= 120), 0)::BIGINT AS total FROM n GROUP BY 1)
SELECT pair, first, first >= 40 AS stop_first, total, total >= 70 AS reject FROM w""")
def ref_x29_sequential_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two-look exact binomial bounds against what the pairs reached."""
    a, b = P.two_look_bounds(60, 60, 0.5, 0.05, 0.01, 2.0, 1.645)
    s = numbered(scored(spark, sf), [F.col("ts"), F.col("row_id")], F.floor(F.col("ts") / 86_400), ["pair"])
    wins = lambda n: F.sum(F.when(F.col("nth") <= n, won().cast("int")).otherwise(0))
    return s.groupBy("pair").agg(wins(60).alias("first"), wins(120).alias("total")).select("pair", "first", (F.col("first") >= a).alias("stop_first"), "total", (F.col("total") >= b).alias("reject"))


@query()
def ref_e18_surrogate_null(spark: SparkSession, sf: str) -> DataFrame:
    """Sign persistence of each stream's hour against 50 phase-randomised surrogates."""
    r = returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", "r", F.floor(F.col("t") / 14_400).alias("block"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        v = rows["r"].to_numpy()[np.argsort(rows["t"].to_numpy())]
        real = float(np.mean(np.sign(v[1:]) * np.sign(v[:-1]))) if len(v) > 1 else 0.0
        null = P.surrogate_means(v, 50, 7) if len(v) > 8 else np.array([real])
        return pa.table({"stream_id": [key[0].as_py()], "block": [key[1].as_py()], "observed": [real], "p_value": [float((1 + (null >= real).sum()) / (1 + len(null)))]})

    return r.groupBy("stream_id", "block").applyInArrow(run, "stream_id string, block bigint, observed double, p_value double")


@query(SCORED_SQL.replace("WITH", "WITH RECURSIVE") + f""", o AS (SELECT pair, row_id, 1 - {_WIN_SQL} AS error, row_number() OVER (PARTITION BY pair ORDER BY ts, row_id) AS k FROM s),
g AS (SELECT pair, k, row_id, error, 0.1::DOUBLE AS level FROM o WHERE k = 1
  UNION ALL SELECT o.pair, o.k, o.row_id, o.error, least(1.0, greatest(0.0, g.level + 0.05 * (0.1 - g.error)))::DOUBLE FROM g JOIN o ON o.pair = g.pair AND o.k = g.k + 1)
SELECT row_id, round(level, 9) AS level FROM g""")
def ref_e20_adaptive_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Adaptive conformal level of each pair, carried through the whole series."""
    s = scored(spark, sf).withColumn("error", 1 - won().cast("int"))
    return P.gate(s, "pair", "ts", "row_id", "error").select("row_id", F.round("level", 9).alias("level"))


@query(SCORED_SQL + """, x AS (SELECT *, row_id * 104729 % 1000 / 1000 AS q, 1 - p AS o FROM s), l AS (SELECT *, coalesce(sum((p - y) ** 2) OVER w, 0) AS lp, coalesce(sum((q - y) ** 2) OVER w, 0) AS lq, coalesce(sum((o - y) ** 2) OVER w, 0) AS lo FROM x WINDOW w AS (PARTITION BY pair ORDER BY ts, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, exp(-0.5 * (lp - least(lp, lq, lo))) AS wp, exp(-0.5 * (lq - least(lp, lq, lo))) AS wq, exp(-0.5 * (lo - least(lp, lq, lo))) AS wo FROM l) SELECT row_id, round((wp * p + wq * q + wo * o) / (wp + wq + wo), 6) AS blend FROM m""")
def ref_e20_hedge_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Exponentially weighted average of three made-up scores by their losses so far, eta 0.5."""
    s = scored(spark, sf).withColumn("q", F.pmod(F.col("row_id") * 104729, F.lit(1000)) / 1000).withColumn("o", 1 - F.col("p"))
    return P.hedge(s, "pair", "ts", "row_id", "y", ["p", "q", "o"], 0.5).select("row_id", F.round("blend", 6).alias("blend"))


@query("""WITH RECURSIVE d AS (SELECT decision_id AS row_id, decision_close_epoch AS t, pair, CASE WHEN candidate_direction = 'UP' THEN 1 ELSE -1 END AS sign, TRY_CAST(json_extract_string(row_json, '$.p_up') AS DOUBLE) AS edge FROM decisions WHERE candidate_direction IS NOT NULL AND decision_close_epoch IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY t, edge DESC NULLS LAST, row_id) AS k FROM d),
g AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS row_id, NULL::VARCHAR AS reason, []::STRUCT(u BIGINT, p VARCHAR, s INT)[] AS held
  UNION ALL SELECT k, row_id, reason, CASE WHEN reason = 'taken' THEN list_append(live, {'u': t + 900, 'p': pair, 's': sign}) ELSE live END FROM (
    SELECT *, CASE WHEN len(list_filter(live, lambda h: h.p = pair)) > 0 THEN 'same_pair' WHEN len(list_filter(live, lambda h: h.s = sign)) >= 3 THEN 'sign_cap' ELSE 'taken' END AS reason FROM (
      SELECT o.k, o.row_id, o.t, o.pair, o.sign, list_filter(g.held, lambda h: h.u > o.t) AS live FROM g JOIN o ON o.k = g.k + 1)))
SELECT row_id, reason = 'taken' AS taken, reason FROM g WHERE k > 0""")
def ref_e24_policy_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions replayed under exposure rules."""
    d = table(spark, sf, "decisions").where("candidate_direction IS NOT NULL").withColumn("edge", F.get_json_object("row_json", "$.p_up").cast("double"))
    d = d.withColumn("book", F.lit("all")).withColumn("sign", F.when(F.col("candidate_direction") == "UP", 1).otherwise(-1))
    return P.policy_replay(d, "book", "decision_close_epoch", "edge", "decision_id", "pair", "sign", 900, 3)


@query("""WITH l AS (SELECT decision_id AS signal, 0 AS seq, 'new' AS status FROM decisions UNION ALL SELECT decision_id, 1, CASE WHEN decision_id % 11 = 0 THEN 'sent' ELSE 'claimed' END FROM decisions UNION ALL SELECT decision_id, 2, CASE WHEN decision_id % 13 = 0 THEN 'settled' ELSE 'sent' END FROM decisions),
p AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY signal ORDER BY seq), '') AS was FROM l)
SELECT signal, seq::BIGINT AS seq, was, status FROM p WHERE NOT ((was = '' AND status = 'new') OR (was = 'new' AND status IN ('claimed', 'expired')) OR (was = 'claimed' AND status IN ('sent', 'released', 'expired')) OR (was = 'released' AND status IN ('claimed', 'expired')) OR (was = 'sent' AND status IN ('settled', 'failed')))""")
def ref_t11_legal_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Illegal moves in a made-up log of a durable queue's states."""
    d = table(spark, sf, "decisions").select(F.col("decision_id").alias("signal"))
    states = F.array(F.lit("new"), F.when(F.col("signal") % 11 == 0, "sent").otherwise("claimed"), F.when(F.col("signal") % 13 == 0, "settled").otherwise("sent"))
    log = d.select("signal", F.posexplode(states).alias("seq", "status")).withColumn("seq", F.col("seq").cast("bigint"))
    return P.illegal_moves(log, "signal", "seq", "status")


@query(SCORED_SQL + f""", g AS (SELECT pair, avg({_WIN_SQL}) AS wr, count(*) AS n FROM s GROUP BY 1), m AS (SELECT avg(wr) AS mu, stddev_samp(wr) AS sd, count(*) AS k FROM g) SELECT pair, round((wr - mu - sd * sqrt(2 * ln(k))) / nullif(sd, 0), 5) AS deflated FROM g, m""")
def ref_e17_deflated_metric(spark: SparkSession, sf: str) -> DataFrame:
    """Win rate less the expected best of as many tries, in deviations over tries."""
    g = scored(spark, sf).groupBy("pair").agg(F.avg(won().cast("int")).alias("wr"))
    m = g.agg(F.avg("wr").alias("mu"), F.stddev_samp("wr").alias("sd"), F.count("*").alias("k"))
    return g.join(F.broadcast(m)).select("pair", F.round(F.try_divide(F.col("wr") - F.col("mu") - F.col("sd") * F.sqrt(2 * F.log("k")), F.col("sd")), 5).alias("deflated"))

