"""Queries on remaining feature blocks, cooldowns, family inference, models and stream parity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import asof as A
from lodestream.operators import selection as X
from lodestream.operators.bars import order_flow_imbalance
from lodestream.operators.scan import with_previous
from lodestream.plans.base import BARS_SQL, SCORED_SQL, TICKS_SQL, Registry, minute_bars, scored, ticks, trained
from lodestream.plans.evaluation import _WIN_SQL
from lodestream.plans.evaluation import win as won
from lodestream.plans.features import roll
from lodestream.plans.streams import replay
from lodestream.plans.windows import KEY, RET_SQL, returns, rolled, win
from lodestream.runtime import table
from lodestream.streaming import market as M

query = Registry()


@query(TICKS_SQL + f""", q AS (SELECT *, tick_id % 97 + 1 AS bs, tick_id % 89 + 1 AS az FROM u),
l AS (SELECT *, lag(bid) OVER w AS pb, lag(ask) OVER w AS pa, lag(bs) OVER w AS pbs, lag(az) OVER w AS paz FROM q WINDOW w AS (PARTITION BY stream_id ORDER BY epoch)),
e AS (SELECT stream_id, epoch, CASE WHEN pb IS NOT NULL AND pa IS NOT NULL THEN (CASE WHEN bid >= pb THEN bs ELSE 0 END - CASE WHEN bid <= pb THEN pbs ELSE 0 END) - (CASE WHEN ask <= pa THEN az ELSE 0 END - CASE WHEN ask >= pa THEN paz ELSE 0 END) END AS e FROM l),
o AS (SELECT stream_id, epoch // 60 * 60 AS t, coalesce(sum(e), 0)::DOUBLE AS ofi FROM e GROUP BY ALL) SELECT stream_id, t, round({rolled('avg(ofi)', 'ofi', 5)}, 5) AS ofi5, round(ofi / ({rolled('stddev_samp(ofi)', 'ofi', 30)} + 1e-6), 5) AS ofi_z FROM o""")
def ref_f11_ofi_block(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling and scaled order-flow imbalance."""
    o = order_flow_imbalance(ticks(spark, sf), KEY, 60, F.col("tick_id") % 97 + 1, F.col("tick_id") % 89 + 1).withColumn("ofi", F.col("ofi").cast("double"))
    return o.select("stream_id", "t", F.round(roll(F.avg("ofi"), "ofi", 5), 5).alias("ofi5"), F.round(F.col("ofi") / (roll(F.stddev_samp("ofi"), "ofi", 30) + 1e-6), 5).alias("ofi_z"))


@query(TICKS_SQL + """, m AS (SELECT stream_id, epoch, quote, epoch - lag(epoch) OVER w AS dt, (ask - bid) / quote * 10000 AS sp, sign(quote - lag(quote) OVER w) AS s FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY epoch))
SELECT stream_id, epoch // 30 * 30 AS t, count(*) AS n, round(avg(dt), 5) AS mean_gap, max(dt) AS max_gap, round(avg(sp), 5) AS spread, round(coalesce(avg(s), 0), 5) AS drift, round(avg((s = 0)::INT), 5) AS still FROM m GROUP BY ALL""")
def ref_f12_tick_microstructure(spark: SparkSession, sf: str) -> DataFrame:
    """Half-minute microstructure: gaps, spread, drift and still share."""
    m = with_previous(ticks(spark, sf), KEY, "epoch", [F.col("epoch")], ["epoch", "quote"])
    m = m.select("stream_id", "epoch", (F.col("epoch") - F.col("prev.epoch")).alias("dt"), ((F.col("ask") - F.col("bid")) / F.col("quote") * 10000).alias("sp"), F.signum(F.col("quote") - F.col("prev.quote")).alias("s"))
    return m.groupBy("stream_id", (F.floor(F.col("epoch") / 30) * 30).alias("t")).agg(
        F.count("*").alias("n"), F.round(F.avg("dt"), 5).alias("mean_gap"), F.max("dt").alias("max_gap"), F.round(F.avg("sp"), 5).alias("spread"),
        F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 5).alias("drift"), F.round(F.avg((F.col("s") == 0).cast("int")), 5).alias("still"),
    )


@query(RET_SQL + """, l AS (SELECT *, hour(timezone('Europe/London', to_timestamp(t))) * 60 + minute(timezone('Europe/London', to_timestamp(t))) AS m FROM r) SELECT stream_id, t, (m BETWEEN 455 AND 485)::INT AS in_fix, round(sum(CASE WHEN m BETWEEN 455 AND 485 THEN r END) OVER (PARTITION BY stream_id, t // 86400 ORDER BY t ROWS UNBOUNDED PRECEDING), 5) AS fix_move FROM l""")
def ref_f24_fixing_window(spark: SparkSession, sf: str) -> DataFrame:
    """Move so far inside a half-hour London window of the day."""
    local = F.from_utc_timestamp(F.timestamp_seconds("t"), "Europe/London")
    inside = (F.hour(local) * 60 + F.minute(local)).between(455, 485)
    w = Window.partitionBy("stream_id", F.floor(F.col("t") / 86400)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return returns(spark, sf).select("stream_id", "t", inside.cast("int").alias("in_fix"), F.round(F.sum(F.when(inside, F.col("r"))).over(w), 5).alias("fix_move"))


@query(TICKS_SQL + """, d AS (SELECT pair, stream_id, epoch, quote, lag(quote) OVER w AS p FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY epoch)), c AS (SELECT pair, epoch // 10 AS slot, stream_id, min(epoch) AS e FROM d WHERE quote <> p GROUP BY ALL),
f AS (SELECT pair, slot, arg_min(stream_id, struct_pack(e, stream_id)) AS leader, count(*) AS n FROM c GROUP BY ALL) SELECT pair, leader, count(*) AS n_first, round(avg(n), 5) AS followers FROM f GROUP BY ALL""")
def ref_f28_update_order(spark: SparkSession, sf: str) -> DataFrame:
    """Which venue moves first in each ten-second slot of a pair."""
    d = with_previous(ticks(spark, sf), KEY, "epoch", [F.col("epoch")], ["quote"]).where("quote <> prev.quote")
    c = d.groupBy("pair", F.floor(F.col("epoch") / 10).alias("slot"), "stream_id").agg(F.min("epoch").alias("e"))
    f = c.groupBy("pair", "slot").agg(F.min_by("stream_id", F.struct("e", "stream_id")).alias("leader"), F.count("*").alias("n"))
    return f.groupBy("pair", "leader").agg(F.count("*").alias("n_first"), F.round(F.avg("n"), 5).alias("followers"))


@query(RET_SQL + f""", v AS (SELECT stream_id, t, abs(r) AS y, {rolled('avg(abs(r))', 'r', 5, -1)} AS a, {rolled('avg(abs(r))', 'r', 30, -1)} AS b2 FROM r), m AS (SELECT * FROM v WHERE y IS NOT NULL AND a IS NOT NULL AND b2 IS NOT NULL),
c AS (SELECT stream_id, covar_pop(y, a) AS ya, covar_pop(y, b2) AS yb, covar_pop(a, b2) AS ab, var_pop(a) AS aa, var_pop(b2) AS bb, avg(y) AS my, avg(a) AS ma, avg(b2) AS mb FROM m GROUP BY 1)
SELECT stream_id, round((ya * bb - yb * ab) / nullif(aa * bb - ab * ab, 0), 5) AS b_short, round((yb * aa - ya * ab) / nullif(aa * bb - ab * ab, 0), 5) AS b_long FROM c""")
def ref_f30_har_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Heterogeneous autoregression of absolute returns by normal equations."""
    y = F.abs("r")
    v = returns(spark, sf).select("stream_id", "t", y.alias("y"), roll(F.avg(y), "r", 5, -1).alias("a"), roll(F.avg(y), "r", 30, -1).alias("b2")).dropna()
    cov = lambda x, z: F.covar_pop(x, z)
    c = v.groupBy("stream_id").agg(cov("y", "a").alias("ya"), cov("y", "b2").alias("yb"), cov("a", "b2").alias("ab"), F.var_pop("a").alias("aa"), F.var_pop("b2").alias("bb"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    part = lambda top: F.round(F.try_divide(top, det), 5)
    return c.select("stream_id", part(F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab")).alias("b_short"), part(F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab")).alias("b_long"))


def cross_map(x: np.ndarray, y: np.ndarray, depth: int = 3) -> float:
    """Convergent cross mapping skill: correlation of x with its forecast from neighbours on y's delay shadow."""
    n = min(len(x), len(y)) - depth + 1
    if n < 4 * depth:
        return float("nan")
    shadow = np.lib.stride_tricks.sliding_window_view(y, depth)[:n]
    target = x[depth - 1 : depth - 1 + n]
    dist = np.sqrt(((shadow[:, None, :] - shadow[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(dist, np.inf)
    near = np.argpartition(dist, depth + 1, axis=1)[:, : depth + 1]
    d = np.take_along_axis(dist, near, axis=1)
    w = np.exp(-d / np.maximum(d.min(axis=1, keepdims=True), 1e-12))
    guess = (w * target[near]).sum(axis=1) / w.sum(axis=1)
    return float(np.corrcoef(guess, target)[0, 1]) if guess.std() > 0 and target.std() > 0 else float("nan")


@query()
def ref_f31_cross_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-mapping skill from each stream to the basket, per block of four hours (240 bars at most)."""
    r = returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", "r")
    j = r.join(r.groupBy("t").agg(F.avg("r").alias("f")), "t").withColumn("block", F.floor(F.col("t") / 14_400))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["t"].to_numpy())
        skill = cross_map(rows["f"].to_numpy()[order], rows["r"].to_numpy()[order])
        return pa.table({"stream_id": [key[0].as_py()], "block": [key[1].as_py()], "skill": pa.array([skill], pa.float64(), from_pandas=True)})

    return j.groupBy("stream_id", "block").applyInArrow(run, "stream_id string, block bigint, skill double")


@query(TICKS_SQL + """, p AS (SELECT stream_id, epoch, quote, tick_id FROM u), a AS (SELECT p.stream_id, p.epoch, p.tick_id, p.quote, q.quote AS q60 FROM p ASOF LEFT JOIN (SELECT stream_id, epoch + 60 AS due, quote FROM u) q ON p.stream_id = q.stream_id AND p.epoch >= q.due) SELECT tick_id, round((quote / q60 - 1) * 10000, 5) AS ret_60 FROM a""")
def ref_f40_quote_path(spark: SparkSession, sf: str) -> DataFrame:
    """Return of a quote over the last minute of the clock."""
    u = ticks(spark, sf).select("stream_id", "epoch", "tick_id", "quote")
    past = u.select("stream_id", (F.col("epoch") + 60).alias("epoch"), "tick_id", F.col("quote").alias("q60"))
    j = A.asof(u, past, KEY, "epoch", "tick_id", ["q60"])
    return j.select("tick_id", F.round((F.col("quote") / F.col("match.q60") - 1) * 10000, 5).alias("ret_60"))


@query()
def ref_f41_random_features(spark: SparkSession, sf: str) -> DataFrame:
    """Eight random Fourier features of (return, lagged return); the seed fixes the projection."""
    rng = np.random.default_rng(5)
    weight, phase = rng.normal(0, 0.3, (8, 2)), rng.uniform(0, 2 * math.pi, 8)
    r = returns(spark, sf).select("stream_id", "t", "r", F.lag("r").over(win()).alias("l")).dropna()
    feature: list[Column] = [F.round(math.sqrt(2 / 8) * F.cos(float(w[0]) * F.col("r") + float(w[1]) * F.col("l") + float(b)), 6).alias(f"z{i}") for i, (w, b) in enumerate(zip(weight, phase))]
    return r.select("stream_id", "t", *feature)


@query(SCORED_SQL + """, c AS (SELECT * FROM s WHERE hour(timezone('America/New_York', to_timestamp(ts))) BETWEEN 8 AND 16 AND abs(p - 0.5) >= 0.2 AND hour(to_timestamp(ts)::TIMESTAMP) < 21), f AS (SELECT DISTINCT ts FROM c), i AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM f)
SELECT count(*) AS n_candidates, min(ts) AS first_ts, max(ts) AS last_ts FROM c""")
def ref_e05_lane_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates across lanes inside the session and before the cutoff (the input of the cooldown)."""
    return lane_candidates(spark, sf).agg(F.count("*").alias("n_candidates"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def lane_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Confident rows in the New York session before 21:00 UTC."""
    at = F.timestamp_seconds("ts")
    inside = F.hour(F.from_utc_timestamp(at, "America/New_York")).between(8, 16) & (F.hour(at) < 21) & (F.abs(F.col("p") - 0.5) >= 0.2)
    return scored(spark, sf).where(inside)


@query(SCORED_SQL.replace("WITH", "WITH RECURSIVE") + """, c AS (SELECT * FROM s WHERE hour(timezone('America/New_York', to_timestamp(ts))) BETWEEN 8 AND 16 AND abs(p - 0.5) >= 0.2 AND hour(to_timestamp(ts)::TIMESTAMP) < 21),
pick AS (SELECT min(ts) AS ts FROM c UNION ALL SELECT (SELECT min(ts) FROM c WHERE c.ts >= pick.ts + 900) FROM pick WHERE pick.ts IS NOT NULL)
SELECT 'all' AS lane, ts, min(row_id) AS row_id FROM pick JOIN c USING (ts) GROUP BY ts""")
def ref_e05_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    """First come, first served over all lanes with a cooldown of 15 minutes."""
    return X.nonoverlap_chrono(lane_candidates(spark, sf).withColumn("lane", F.lit("all")), ["lane"], "ts", "row_id", 900)


@query()
def ref_e13_family_max(spark: SparkSession, sf: str) -> DataFrame:
    """Synchronised bootstrap of the family's maximum: date totals per pair in Spark, one seeded Poisson weight per date and replicate."""
    days = scored(spark, sf).groupBy(F.floor(F.col("ts") / 86400).alias("day")).pivot("pair", ["AUDUSD", "EURUSD", "GBPUSD", "NZDUSD", "USDCAD", "USDCHF", "USDJPY"]).agg(F.sum(won().cast("int") - 0.5)).fillna(0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((500, 7))
        for batch in batches:
            day, m = batch.column(0).to_numpy(), np.column_stack([batch.column(i + 1).to_numpy() for i in range(7)])
            for d, row in zip(day, m):
                total += (np.random.default_rng((int(d), 3)).poisson(1.0, 500) - 1)[:, None] * row
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(500), 7)), pa.array(np.tile(np.arange(7), 500)), pa.array(total.ravel())], names=["replicate", "member", "dev"])

    parts = days.mapInArrow(run, "replicate bigint, member bigint, dev double").groupBy("replicate", "member").agg(F.sum("dev").alias("dev"))
    spread = parts.groupBy("member").agg(F.stddev_samp("dev").alias("sd"))
    t = parts.join(F.broadcast(spread), "member").groupBy("replicate").agg(F.max(F.try_divide("dev", "sd")).alias("max_t"))
    return t.agg(F.count("*").alias("replicates"), F.percentile("max_t", 0.95).alias("critical"))


@query()
def ref_e27_logistic(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic regression on the first half of time, scored on the second; fitted distributed over all training rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    s = trained(spark, sf).withColumns({"hour": (F.col("ts") % 86400 / 86400).cast("double"), "label": F.col("y").cast("double")})
    v = VectorAssembler(inputCols=["p", "hour"], outputCol="features").transform(s)
    model = LogisticRegression(maxIter=20, regParam=0.01).fit(v.where("train"))
    scores = model.transform(v.where("NOT train")).select("y", F.col("prediction").cast("int").alias("guess"))
    return scores.groupBy("guess").agg(F.count("*").alias("n"), F.avg("y").alias("up_rate"))


@query("""WITH u AS (SELECT * FROM ticks WHERE quote IS NOT NULL AND NOT isnan(quote) QUALIFY row_number() OVER (PARTITION BY stream_id, epoch ORDER BY tick_id DESC) = 1), w AS (SELECT stream_id, unnest(range((epoch + 19) // 20 * 20, (epoch + 19) // 20 * 20 + 60, 20)) AS end_epoch FROM u),
c AS (SELECT stream_id, end_epoch, count(*) AS n FROM w GROUP BY ALL) SELECT stream_id, n, count(*) AS windows FROM c WHERE n < 15 GROUP BY ALL""")
def ref_t05_incomplete_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that were not emitted, counted by how many seconds they had."""
    stream = replay(spark, sf).where("stream_id = '' OR quote IS NOT NULL")
    windows = M.run_to_table(M.exact_windows(stream, "stream_id", "epoch", "quote", "tick_id", 60, 20, 1, "0 seconds"), "incomplete")
    return windows.where("n < 15 AND stream_id <> ''").groupBy("stream_id", "n").agg(F.count("*").alias("windows"))


@query("SELECT 0::BIGINT AS only_stream, 0::BIGINT AS only_batch")
def ref_t12_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Candles of the stream that the batch lacks, and the other way round."""
    stream = replay(spark, sf).where("stream_id = '' OR quote IS NOT NULL")
    mine = M.run_to_table(M.closed_candles(stream, "stream_id", "epoch", "quote", "tick_id", 60, "0 seconds"), "parity").where("stream_id <> ''")
    rows = table(spark, sf, "ticks").where("quote IS NOT NULL AND NOT isnan(quote)")
    order = F.struct("epoch", "tick_id")
    batch = rows.groupBy("stream_id", (F.floor(F.col("epoch") / 60) * 60).alias("t")).agg(F.min_by("quote", order).alias("open"), F.max("quote").alias("high"), F.min("quote").alias("low"), F.max_by("quote", order).alias("close"), F.count("quote").alias("n"))
    a = mine.exceptAll(batch.select(mine.columns)).agg(F.count("*").alias("only_stream"))
    b = batch.select(mine.columns).exceptAll(mine).agg(F.count("*").alias("only_batch"))
    return a.join(F.broadcast(b))


@query("""WITH w AS (SELECT pair, date_trunc('week', datetime_utc)::DATE AS wk, round(avg(close_mid), 8) AS level FROM label_rows WHERE datetime_utc IS NOT NULL AND NOT isnan(close_mid) GROUP BY ALL), d AS (SELECT DISTINCT pair, datetime_utc::DATE AS day FROM label_rows WHERE datetime_utc IS NOT NULL)
SELECT d.pair, strftime(d.day, '%Y-%m-%d') AS day, w.level FROM d ASOF LEFT JOIN (SELECT pair, (wk + INTERVAL 10 DAY)::DATE AS known, level FROM w) w ON d.pair = w.pair AND d.day >= w.known""")
def ref_s09_weekly_series(spark: SparkSession, sf: str) -> DataFrame:
    """A weekly series, known ten days after its week began, filled forward to days."""
    rows = table(spark, sf, "label_rows").where("datetime_utc IS NOT NULL").withColumn("day", F.col("datetime_utc").cast("date"))
    w = rows.where("NOT isnan(close_mid)").groupBy("pair", F.trunc("day", "week").alias("wk")).agg(F.round(F.avg("close_mid"), 8).alias("level"))
    number = lambda c: F.unix_date(c).cast("bigint")
    known = w.select("pair", (number(F.col("wk")) + 10).alias("d"), number(F.col("wk")).alias("seq"), "level")
    days = rows.select("pair", "day").distinct().withColumn("d", number(F.col("day")))
    j = A.asof(days, known, ["pair"], "d", "seq", ["level"], bucket_s=30)
    return j.select("pair", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("match.level").alias("level"))


@query(SCORED_SQL + f""", m AS (SELECT pair, median(ts) AS m FROM s GROUP BY 1), g AS (SELECT unnest([1.6, 1.7, 1.8]) AS lvl), c AS (SELECT pair, lvl, (ts >= m)::INT AS half, count(*) AS n, avg(CASE WHEN {_WIN_SQL} = 1 THEN pay - 1 ELSE -1 END) AS ev FROM (SELECT *, 1.5 + row_id % 5 * 0.1 AS pay FROM s) s JOIN m USING (pair), g WHERE pay >= lvl - 1e-9 GROUP BY ALL),
w AS (SELECT pair, lvl, min(ev) AS worst FROM c GROUP BY ALL HAVING count(*) = 2 AND min(n) >= 25) SELECT pair, lvl::DOUBLE AS pay_floor, round(worst, 6) AS worst FROM w QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(worst, 6) DESC, lvl) = 1""")
def ref_x04_payout_floor(spark: SparkSession, sf: str) -> DataFrame:
    """The payout floor with the best worse half; ties keep the lower."""
    s = scored(spark, sf).withColumn("pay", 1.5 + F.col("row_id") % 5 * 0.1)
    halves = s.join(s.groupBy("pair").agg(F.median("ts").alias("m")), "pair").withColumn("half", (F.col("ts") >= F.col("m")).cast("int"))
    grid = halves.withColumn("pay_floor", F.explode(F.filter(F.array(*[F.lit(x) for x in (1.6, 1.7, 1.8)]), lambda x: F.col("pay") >= x - 1e-9)))
    c = grid.groupBy("pair", "pay_floor", "half").agg(F.count("*").alias("n"), F.avg(F.when(won(), F.col("pay") - 1).otherwise(-1.0)).alias("ev"))
    w = c.groupBy("pair", "pay_floor").agg(F.round(F.min("ev"), 6).alias("worst"), F.min("n").alias("least"), F.count("*").alias("k")).where("k = 2 AND least >= 25")
    return w.groupBy("pair").agg(F.max_by("pay_floor", F.struct("worst", -F.col("pay_floor"))).alias("pay_floor"), F.max("worst").alias("worst"))


@query(BARS_SQL + """, v AS (SELECT t, max(close) FILTER (stream_id = 'EURUSD:alder') AS a, max(close) FILTER (stream_id = 'AUDUSD:alder') AS c FROM b GROUP BY t), x AS (SELECT 'EURAUD' AS stream_id, t, (a / c - lag(a / c) OVER (ORDER BY t)) * 10000 AS d FROM v WHERE a IS NOT NULL AND c IS NOT NULL), y AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM x WHERE d IS NOT NULL) """
       + f"SELECT stream_id, t, round(100 * {rolled('avg(up)', 'up', 14)} / ({rolled('avg(up)', 'up', 14)} + {rolled('avg(dn)', 'dn', 14)} + 1e-6), 4) AS rsi FROM y")
def ref_x15_ratio_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Simple-mean RSI of a synthetic ratio."""
    leg = lambda s: F.max(F.when(F.col("stream_id") == s, F.col("close")))
    v = minute_bars(spark, sf).where(F.col("stream_id").isin("EURUSD:alder", "AUDUSD:alder")).groupBy("t").agg(leg("EURUSD:alder").alias("a"), leg("AUDUSD:alder").alias("c")).dropna()
    x = v.select(F.lit("EURAUD").alias("stream_id"), "t", (F.col("a") / F.col("c")).alias("q"))
    y = x.withColumn("d", (F.col("q") - F.lag("q").over(win())) * 10000).where("d IS NOT NULL")
    y = y.withColumns({"up": F.greatest("d", F.lit(0.0)), "dn": F.greatest(-F.col("d"), F.lit(0.0))})
    up, dn = roll(F.avg("up"), "up", 14), roll(F.avg("dn"), "dn", 14)
    return y.select("stream_id", "t", F.round(100 * up / (up + dn + 1e-6), 4).alias("rsi"))
