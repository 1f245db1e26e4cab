"""Queries on windows over bars (W), missing data and projection (P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from lodestream.operators import rolling as R
from lodestream.operators.bars import keep_last
from lodestream.operators.scan import carry_last, numbered, running_total
from lodestream.plans.base import BARS_SQL, SCORED_SQL, TICKS_SQL, Registry, minute_bars, scored, ticks
from lodestream.runtime import table

query = Registry()
KEY = ["stream_id"]



def win() -> WindowSpec:
    """The bars of a stream in order."""
    return Window.partitionBy("stream_id").orderBy("t")


def by_time(rows: DataFrame) -> DataFrame:
    """Scored rows with nth, their rank by time within the pair, counted over days."""
    return numbered(rows, [F.col("ts"), F.col("row_id")], F.floor(F.col("ts") / 86400), ["pair"])


#: Bars with the return in basis points.
RET_SQL = BARS_SQL + """,
r AS (SELECT stream_id, t, open, high, low, close, n, (close / lag(close) OVER (PARTITION BY stream_id ORDER BY t) - 1) * 10000 AS r FROM b)"""


def returns(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with r, the return in basis points."""
    return minute_bars(spark, sf).withColumn("r", (F.col("close") / F.lag("close").over(win()) - 1) * 10000)


def frame(rows: int, end: int = 0) -> str:
    """A SQL frame of so many rows that ends `-end` rows back."""
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"(PARTITION BY stream_id ORDER BY t ROWS BETWEEN {rows - 1 - end} PRECEDING AND {last})"


def rolled(fn: str, col: str, rows: int, end: int = 0, least: int | None = None) -> str:
    """A rolling aggregate in SQL that is NULL below `least` values."""
    return f"CASE WHEN count({col}) OVER {frame(rows, end)} >= {least or rows} THEN {fn} OVER {frame(rows, end)} END"


@query(BARS_SQL + """ SELECT stream_id, t, round((close - lag(close) OVER w) * 100, 8) AS diff, round((close / lag(close, 3) OVER w - 1) * 10000, 5) AS pct3, round(ln(close / lag(close, 5) OVER w) * 10000, 5) AS log5
FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY t)""")
def ref_w01_lags(spark: SparkSession, sf: str) -> DataFrame:
    """Difference, percent change over 3 bars, log return over 5."""
    c, lag = F.col("close"), lambda k: F.lag("close", k).over(win())
    return minute_bars(spark, sf).select("stream_id", "t", F.round((c - lag(1)) * 100, 8).alias("diff"), F.round((c / lag(3) - 1) * 10000, 5).alias("pct3"), F.round(F.log(c / lag(5)) * 10000, 5).alias("log5"))


@query(BARS_SQL + """ SELECT stream_id, t, CASE WHEN lead(t, 15) OVER w - t = 900 THEN round((lead(close, 15) OVER w / close - 1) * 10000, 5) END AS fwd FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY t)""")
def ref_w02_forward_return(spark: SparkSession, sf: str) -> DataFrame:
    """Return over the next 15 bars if they are contiguous."""
    fwd = F.when(F.lead("t", 15).over(win()) - F.col("t") == 900, F.round((F.lead("close", 15).over(win()) / F.col("close") - 1) * 10000, 5))
    return minute_bars(spark, sf).select("stream_id", "t", fwd.alias("fwd"))


@query(BARS_SQL + """, g AS (SELECT stream_id, t, t - lag(t) OVER (PARTITION BY stream_id ORDER BY t) AS gap_prev FROM b)
SELECT stream_id, t, gap_prev, min((gap_prev = 60)::INT) OVER (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS next_ok FROM g""")
def ref_w03_gap_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Gap to the previous bar, and whether the next five have none."""
    g = minute_bars(spark, sf).select("stream_id", "t", (F.col("t") - F.lag("t").over(win())).alias("gap_prev"))
    return g.withColumn("next_ok", F.min((F.col("gap_prev") == 60).cast("int")).over(win().rowsBetween(1, 5)))


@query(RET_SQL + f""" SELECT stream_id, t, round({rolled('avg(r)', 'r', 12)}, 6) AS mean12, round({rolled('sum(r)', 'r', 12, least=6)}, 6) AS sum12, round({rolled('stddev_samp(r)', 'r', 24)}, 6) AS sd24,
{rolled('min(low)', 'low', 24)} AS min24, {rolled('max(high)', 'high', 24)} AS max24 FROM r""")
def ref_w04_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling mean, sum, deviation, minimum and maximum."""
    s12, s24 = R.span(KEY, "t", 12), R.span(KEY, "t", 24)
    roll = lambda agg, c, w, n: R.rolling(agg, F.col(c), w, n)
    return returns(spark, sf).select(
        "stream_id", "t", F.round(roll(F.avg("r"), "r", s12, 12), 6).alias("mean12"), F.round(roll(F.sum("r"), "r", s12, 6), 6).alias("sum12"),
        F.round(roll(F.stddev_samp("r"), "r", s24, 24), 6).alias("sd24"), roll(F.min("low"), "low", s24, 24).alias("min24"), roll(F.max("high"), "high", s24, 24).alias("max24"),
    )


@query(TICKS_SQL + """ SELECT stream_id, epoch, count(*) OVER w AS n, max(quote) OVER w AS high, min(quote) OVER w AS low FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY epoch RANGE BETWEEN 899 PRECEDING AND CURRENT ROW)""")
def ref_w05_time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Left-open wall-clock windows of 900 s."""
    own = F.floor(F.col("epoch") / 3600)
    # a chunk also reads the 899 s before it, so a hot stream is many groups
    chunks = ticks(spark, sf).withColumn("chunk", F.explode(F.sequence(own, F.floor((F.col("epoch") + 899) / 3600))))
    w = Window.partitionBy("stream_id", "chunk").orderBy("epoch").rangeBetween(-899, 0)
    seen = chunks.select("stream_id", "epoch", "chunk", F.count("*").over(w).alias("n"), F.max("quote").over(w).alias("high"), F.min("quote").over(w).alias("low"))
    return seen.where(F.col("chunk") == own).drop("chunk")


@query(BARS_SQL + """ SELECT stream_id, t, max(n) OVER (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS top FROM b""")
def ref_w06_centred_max(spark: SparkSession, sf: str) -> DataFrame:
    """Centred maximum over 31 bars."""
    return minute_bars(spark, sf).select("stream_id", "t", F.max("n").over(win().rowsBetween(-15, 15)).alias("top"))


@query(RET_SQL + f""", l AS (SELECT *, lag(r) OVER (PARTITION BY stream_id ORDER BY t) AS p FROM r), q AS (SELECT *, CASE WHEN p IS NOT NULL THEN r END AS r2, CASE WHEN r IS NOT NULL THEN p END AS p2 FROM l)
SELECT stream_id, t, CASE WHEN var_pop(r2) OVER {frame(20)} > 1e-12 AND var_pop(p2) OVER {frame(20)} > 1e-12 THEN round({rolled('covar_pop(r2, p2)', 'r2', 20)} / sqrt(var_pop(r2) OVER {frame(20)} * var_pop(p2) OVER {frame(20)}), 5) END AS autocorr, round({rolled('covar_samp(r2, p2)', 'r2', 20)}, 5) AS cov, round({rolled('covar_samp(r2, p2)', 'r2', 20)} / nullif({rolled('var_samp(p2)', 'p2', 20)}, 0), 5) AS beta FROM q""")
def ref_w07_rolling_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling autocorrelation, covariance and OLS beta."""
    q = returns(spark, sf).withColumn("p", F.lag("r").over(win()))
    q = q.withColumn("r2", F.when(F.col("p").isNotNull(), F.col("r"))).withColumn("p2", F.when(F.col("r").isNotNull(), F.col("p")))
    s = R.span(KEY, "t", 20)
    roll = lambda agg, c: R.rolling(agg, F.col(c), s, 20)
    cov, var = roll(F.covar_samp("r2", "p2"), "r2"), roll(F.var_samp("p2"), "p2")
    return q.select("stream_id", "t", F.round(F.when(F.count("r2").over(s) >= 20, R.correlation(F.col("r2"), F.col("p2"), s)), 5).alias("autocorr"), F.round(cov, 5).alias("cov"), F.round(F.try_divide(cov, var), 5).alias("beta"))


@query(BARS_SQL + """, i AS (SELECT stream_id, t, close, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i FROM b),
c AS (SELECT *, first_value(close) OVER (PARTITION BY stream_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c0 FROM i)
SELECT stream_id, t, CASE WHEN i >= 20 THEN round(regr_slope((close / c0 - 1) * 10000, i) OVER (PARTITION BY stream_id ORDER BY t ROWS 19 PRECEDING), 4) END AS slope FROM c""")
def ref_w08_rolling_slope(spark: SparkSession, sf: str) -> DataFrame:
    """Slope of the relative price over the row number in 20 bars."""
    i = minute_bars(spark, sf).withColumn("i", F.row_number().over(win())).withColumn("c0", F.first("close").over(win().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    slope = F.regr_slope((F.col("close") / F.col("c0") - 1) * 10000, F.col("i")).over(R.span(KEY, "t", 20))
    return i.select("stream_id", "t", F.when(F.col("i") >= 20, F.round(slope, 4)).alias("slope"))


@query(RET_SQL + f""" SELECT stream_id, t, CASE WHEN {rolled('var_pop(r)', 'r', 30)} > 0 THEN round({rolled('skewness(r)', 'r', 30)}, 4) END AS skew, CASE WHEN {rolled('var_pop(r)', 'r', 30)} > 0 THEN round({rolled('kurtosis(r)', 'r', 30)}, 3) END AS kurt FROM r""")
def ref_w09_rolling_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Bias-corrected rolling skewness and kurtosis."""
    s, r = R.span(KEY, "t", 30), F.col("r")
    return returns(spark, sf).select("stream_id", "t", F.round(R.skew_corrected(r, s, 30), 4).alias("skew"), F.round(R.kurtosis_corrected(r, s, 30), 3).alias("kurt"))


@query(RET_SQL + f""" SELECT stream_id, t, round({rolled('quantile_cont(r, 0.25)', 'r', 60, -1)}, 6) AS q25, round({rolled('quantile_cont(r, 0.75)', 'r', 60, -1)}, 6) AS q75 FROM r""")
def ref_w10_rolling_quantile(spark: SparkSession, sf: str) -> DataFrame:
    """Lagged rolling quartiles of 60 bars."""
    s = R.span(KEY, "t", 60, -1)
    q = lambda at: F.round(R.rolling(F.percentile("r", at), F.col("r"), s, 60), 6)
    return returns(spark, sf).select("stream_id", "t", q(0.25).alias("q25"), q(0.75).alias("q75"))


@query(BARS_SQL + """, l AS (SELECT stream_id, t, close, list(close) OVER (PARTITION BY stream_id ORDER BY t ROWS 59 PRECEDING) AS v FROM b)
SELECT stream_id, t, round((len(list_filter(v, lambda x: x < close)) + (len(list_filter(v, lambda x: x = close)) + 1) / 2) / len(v), 6) AS pct_rank FROM l""")
def ref_w11_percent_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Percent rank of the last value among 60 bars."""
    return minute_bars(spark, sf).select("stream_id", "t", F.round(R.percent_rank_of_last(F.col("close"), R.span(KEY, "t", 60)), 6).alias("pct_rank"))


_EWM_SQL = RET_SQL + """, x AS (SELECT stream_id, t, r, row_number() OVER (PARTITION BY stream_id ORDER BY t) - 1 AS i FROM r WHERE r IS NOT NULL)
SELECT a.stream_id, a.t, round({}, 6) AS ewm FROM x a JOIN x b ON a.stream_id = b.stream_id AND b.i <= a.i GROUP BY a.stream_id, a.t"""
_ALPHA = 2 / 11


@query(_EWM_SQL.format(f"sum(CASE WHEN b.i = 0 THEN pow({1 - _ALPHA}, a.i) ELSE {_ALPHA} * pow({1 - _ALPHA}, a.i - b.i) END * b.r)"))
def ref_w12_ewm(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential mean of span 10 by block scan."""
    r = returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", "r")
    return R.ewm(r, KEY, "t", "r", _ALPHA, "ewm").select("stream_id", "t", F.round("ewm", 6).alias("ewm"))


@query(_EWM_SQL.format(f"sum(pow({1 - _ALPHA}, a.i - b.i) * b.r) / sum(pow({1 - _ALPHA}, a.i - b.i))"))
def ref_w13_ewm_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential mean with weights that sum to one."""
    r = returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", "r")
    return R.ewm_adjusted(r, KEY, "t", "r", _ALPHA, "ewm").select("stream_id", "t", F.round("ewm", 6).alias("ewm"))


@query(BARS_SQL + """ SELECT stream_id, t, sum(n) OVER w::BIGINT AS cum_n, max(high) OVER w AS day_high, min(low) OVER w AS day_low, first_value(open) OVER w AS day_open
FROM b WINDOW w AS (PARTITION BY stream_id, t // 86400 ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def ref_w14_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    """Running sum, maximum, minimum and first value of the day."""
    w = Window.partitionBy("stream_id", F.floor(F.col("t") / 86400)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return minute_bars(spark, sf).select("stream_id", "t", F.sum("n").over(w).alias("cum_n"), F.max("high").over(w).alias("day_high"), F.min("low").over(w).alias("day_low"), F.first("open").over(w).alias("day_open"))


@query(RET_SQL + """, s AS (SELECT stream_id, t, coalesce(sign(r), 0)::INT AS s FROM r), g AS (SELECT *, sum((s IS DISTINCT FROM p)::INT) OVER (PARTITION BY stream_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island
FROM (SELECT *, lag(s) OVER (PARTITION BY stream_id ORDER BY t) AS p FROM s))
SELECT stream_id, t, (least(row_number() OVER (PARTITION BY stream_id, island ORDER BY t), 50) * s)::INT AS run FROM g""")
def ref_w15_run_length(spark: SparkSession, sf: str) -> DataFrame:
    """Signed run length of equal return signs."""
    return R.run_lengths(returns(spark, sf).select("stream_id", "t", "r"), KEY, "t", F.signum("r").cast("int"), "run").select("stream_id", "t", "run")


@query("""WITH d AS (SELECT DISTINCT datetime_utc::DATE AS day FROM label_rows WHERE datetime_utc IS NOT NULL)
SELECT strftime(day, '%Y-%m-%d') AS day, dense_rank() OVER (PARTITION BY date_trunc('month', day) ORDER BY day DESC) AS from_month_end, dense_rank() OVER (PARTITION BY date_trunc('quarter', day) ORDER BY day DESC) AS from_quarter_end FROM d""")
def ref_w16_rank_from_end(spark: SparkSession, sf: str) -> DataFrame:
    """Dense rank of days from the end of their month and quarter."""
    d = table(spark, sf, "label_rows").where("datetime_utc IS NOT NULL").select(F.col("datetime_utc").cast("date").alias("day")).distinct()
    rank = lambda unit: F.dense_rank().over(Window.partitionBy(F.trunc("day", unit)).orderBy(F.desc("day"))).cast("bigint")
    return d.select(F.date_format("day", "yyyy-MM-dd").alias("day"), rank("month").alias("from_month_end"), rank("quarter").alias("from_quarter_end"))


@query(SCORED_SQL + """, c AS (SELECT pair, ts // 86400 AS day, ts % 86400 // 3600 AS slot, avg(fwd_ret) * 10000 AS r FROM s GROUP BY ALL), days AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM c)),
x AS (SELECT c.*, k FROM c JOIN days USING (day))
SELECT pair, day, slot, round(avg(r) OVER w, 6) AS slot_mean5, count(r) OVER w AS slot_n FROM x WINDOW w AS (PARTITION BY pair, slot ORDER BY k RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def ref_w17_same_slot_history(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the same hour over the five trading days before, over a dense index of days."""
    c = scored(spark, sf).groupBy("pair", F.floor(F.col("ts") / 86400).alias("day"), F.floor(F.col("ts") % 86400 / 3600).alias("slot")).agg((F.avg("fwd_ret") * 10000).alias("r"))
    days = c.select("day").distinct().withColumn("k", F.row_number().over(Window.orderBy("day")))  # one row per calendar day
    w = Window.partitionBy("pair", "slot").orderBy("k").rangeBetween(-5, -1)
    return c.join(days, "day").select("pair", "day", "slot", F.round(F.avg("r").over(w), 6).alias("slot_mean5"), F.count("r").over(w).alias("slot_n"))


@query(RET_SQL + """ SELECT t, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS dispersion, round(median(r), 6) AS med, round(avg(sign(r)), 6) AS agreement FROM r WHERE r IS NOT NULL GROUP BY t""")
def ref_w18_cross_section(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, dispersion, median and sign agreement across streams."""
    return returns(spark, sf).where("r IS NOT NULL").groupBy("t").agg(
        F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_pop("r"), 6).alias("dispersion"), F.round(F.median("r"), 6).alias("med"), F.round(F.avg(F.signum("r")), 6).alias("agreement")
    )


@query(BARS_SQL + """ SELECT stream_id, t, round((coalesce((close > lag(close, 1) OVER w)::INT, 0) + coalesce((close > lag(close, 5) OVER w)::INT, 0) + coalesce((close > lag(close, 15) OVER w)::INT, 0)) / 3, 6) AS votes FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY t)""")
def ref_w19_alignment_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Share of three horizons on which the price has risen."""
    vote = lambda k: F.coalesce((F.col("close") > F.lag("close", k).over(win())).cast("int"), F.lit(0))
    return minute_bars(spark, sf).select("stream_id", "t", F.round((vote(1) + vote(5) + vote(15)) / 3, 6).alias("votes"))


@query(SCORED_SQL + """, r AS (SELECT pair, row_number() OVER w AS k, avg((y = (p > 0.5)::INT)::INT) OVER (PARTITION BY pair ORDER BY abs(p - 0.5) DESC, row_id ROWS UNBOUNDED PRECEDING) AS acc FROM s WINDOW w AS (PARTITION BY pair ORDER BY abs(p - 0.5) DESC, row_id))
SELECT pair, max(k) FILTER (k >= 10 AND acc >= 0.52) AS largest_k, round(max(acc) FILTER (k = 10), 6) AS acc_at_10 FROM r GROUP BY pair""")
def ref_w20_top_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Largest k of the most confident rows whose accuracy meets a target."""
    conf = F.abs(F.col("p") - 0.5)
    hit = (F.col("y") == (F.col("p") > 0.5).cast("int")).cast("int")
    order, shard = [F.desc("conf"), F.col("row_id")], F.floor((0.5 - F.col("conf")) * 200)
    ranked = numbered(scored(spark, sf).withColumn("conf", conf).withColumn("hit", hit), order, shard, ["pair"], "k")
    r = running_total(ranked, F.col("hit"), order, shard, ["pair"], "hits").select("pair", "k", (F.col("hits") / F.col("k")).alias("acc"))
    return r.groupBy("pair").agg(F.max(F.when((F.col("k") >= 10) & (F.col("acc") >= 0.52), F.col("k"))).cast("bigint").alias("largest_k"), F.round(F.max(F.when(F.col("k") == 10, F.col("acc"))), 6).alias("acc_at_10"))


@query(SCORED_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts, row_id) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM s)
SELECT pair, g AS grp, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM (SELECT *, (SELECT max(k) FROM range(8) t(k) WHERE floor(k * n / 8) <= i)::INT AS g FROM r) GROUP BY ALL""")
def ref_w22_contiguous_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Eight contiguous groups with edges floor(k n / 8)."""
    s = scored(spark, sf)
    r = by_time(s).withColumn("i", F.col("nth") - 1).join(s.groupBy("pair").agg(F.count("*").alias("n")), "pair")
    grp = sum(((F.floor(F.col("n") * k / 8) <= F.col("i")).cast("int") for k in range(1, 8)), F.lit(0))
    return r.groupBy("pair", grp.alias("grp")).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


@query(BARS_SQL + """ SELECT stream_id, t, len(v) AS n, round(v[1] * 100, 6) AS oldest, round(list_sum(list_transform(v, lambda x: x / v[1] - 1)) * 10000, 4) AS path FROM (SELECT stream_id, t, list(close) OVER (PARTITION BY stream_id ORDER BY t ROWS 9 PRECEDING) AS v FROM b) WHERE len(v) = 10""")
def ref_w23_delay_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of ten values as arrays, full ones only."""
    v = minute_bars(spark, sf).select("stream_id", "t", F.collect_list("close").over(R.span(KEY, "t", 10)).alias("v")).where(F.size("v") == 10)
    path = F.aggregate("v", F.lit(0.0), lambda a, x: a + x / F.col("v")[0] - 1)
    return v.select("stream_id", "t", F.size("v").cast("bigint").alias("n"), F.round(F.col("v")[0] * 100, 6).alias("oldest"), F.round(path * 10000, 4).alias("path"))


@query(SCORED_SQL + """ SELECT row_id, CASE WHEN count(*) OVER w >= 20 THEN round(avg(y) OVER w, 6) ELSE 0.5 END AS base FROM s WINDOW w AS (PARTITION BY pair ORDER BY ts RANGE BETWEEN 432000 PRECEDING AND 3600 PRECEDING)""")
def ref_w24_trailing_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Up rate of five days up to an hour ago, 0.5 without support."""
    own = F.floor(F.col("ts") / 1_728_000)
    # chunks of twenty days that also read the five days before them
    chunks = scored(spark, sf).withColumn("chunk", F.explode(F.sequence(own, F.floor((F.col("ts") + 432_000) / 1_728_000))))
    w = Window.partitionBy("pair", "chunk").orderBy("ts").rangeBetween(-432000, -3600)
    base = F.when(F.count("*").over(w) >= 20, F.round(F.avg("y").over(w), 6)).otherwise(0.5)
    return chunks.withColumn("base", base).where(F.col("chunk") == own).select("row_id", "base")


@query(RET_SQL + f""" SELECT stream_id, t, round((r - {rolled('avg(r)', 'r', 20, -1)}) / ({rolled('stddev_samp(r)', 'r', 20, -1)} + 1e-6), 4) AS z FROM r""")
def ref_w25_lagged_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Return against mean and deviation of the 20 bars before."""
    s, r = R.span(KEY, "t", 20, -1), F.col("r")
    z = (r - R.rolling(F.avg("r"), r, s, 20)) / (R.rolling(F.stddev_samp("r"), r, s, 20) + 1e-6)
    return returns(spark, sf).select("stream_id", "t", F.round(z, 4).alias("z"))


@query(RET_SQL + f""", f AS (SELECT stream_id, t, r, {rolled('avg(r)', 'r', 12)} AS a, {rolled('avg(r)', 'r', 60)} AS b2, {rolled('stddev_samp(r)', 'r', 30)} AS c FROM r)
SELECT stream_id, t FROM f WHERE ((r IS NULL)::INT + (a IS NULL)::INT + (b2 IS NULL)::INT + (c IS NULL)::INT) / 4 < 0.5""")
def ref_proj03_row_keep(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of which fewer than half the features are missing."""
    r, roll = F.col("r"), lambda agg, n: R.rolling(agg, F.col("r"), R.span(KEY, "t", n), n)
    f = returns(spark, sf).select("stream_id", "t", r, roll(F.avg("r"), 12).alias("a"), roll(F.avg("r"), 60).alias("b2"), roll(F.stddev_samp("r"), 30).alias("c"))
    missing = sum((F.col(c).isNull().cast("int") for c in ("r", "a", "b2", "c")), F.lit(0)) / 4
    return f.where(missing < 0.5).select("stream_id", "t")


@query(SCORED_SQL + """ SELECT row_id FROM s QUALIFY (row_number() OVER (PARTITION BY pair ORDER BY ts, row_id) - 1) % 5 = 0""")
def ref_proj04_stride(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth valid row per pair: systematic sampling."""
    return by_time(scored(spark, sf)).where("(nth - 1) % 5 = 0").select("row_id")


@query(SCORED_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts, row_id) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM s),
pick AS (SELECT DISTINCT pair, CASE WHEN n <= 50 THEN k ELSE k * (n - 1) // 49 END AS i FROM (SELECT DISTINCT pair, n FROM r), range(50) t(k) WHERE k < n)
SELECT row_id FROM r JOIN pick USING (pair, i)""")
def ref_proj05_linspace_cap(spark: SparkSession, sf: str) -> DataFrame:
    """At most 50 rows per pair at evenly spaced positions, both ends included."""
    s = scored(spark, sf)
    r = by_time(s).withColumn("i", F.col("nth") - 1).join(s.groupBy("pair").agg(F.count("*").alias("n")), "pair")
    # position i is picked if some k has floor(k (n-1) / 49) = i
    k = F.ceil(F.col("i") * 49 / (F.col("n") - 1))
    return r.where((F.col("n") <= 50) | (F.floor(k * (F.col("n") - 1) / 49) == F.col("i"))).select("row_id")


@query(TICKS_SQL + """, l AS (SELECT stream_id, epoch, bid, last_value(bid IGNORE NULLS) OVER w AS filled, epoch - last_value(CASE WHEN bid IS NOT NULL THEN epoch END IGNORE NULLS) OVER w AS age FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY epoch ROWS UNBOUNDED PRECEDING))
SELECT stream_id, epoch, filled, age, coalesce(age <= 2, false)::INT AS fresh FROM l""")
def ref_proj08_ffill_age(spark: SparkSession, sf: str) -> DataFrame:
    """Forward fill with the age of the value and a freshness flag."""
    seen = carry_last(ticks(spark, sf), ["stream_id"], "epoch", [F.col("epoch")], F.when(F.col("bid").isNotNull(), F.struct("epoch", "bid")), "seen")
    l = seen.select("stream_id", "epoch", F.col("seen.bid").alias("filled"), (F.col("epoch") - F.col("seen.epoch")).alias("age"))  # noqa: E741
    return l.withColumn("fresh", F.coalesce(F.col("age") <= 2, F.lit(False)).cast("int"))


@query(BARS_SQL + """, e AS (SELECT stream_id, unnest(range(min(t), max(t) + 60, 60)) AS t FROM b GROUP BY stream_id) SELECT stream_id, t, close, coalesce(n, 0) AS n FROM e LEFT JOIN b USING (stream_id, t)""")
def ref_proj10_grid_completion(spark: SparkSession, sf: str) -> DataFrame:
    """A dense minute grid: missing bars have NULL prices and zero ticks."""
    b = minute_bars(spark, sf)
    e = b.groupBy("stream_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).select("stream_id", F.explode(F.sequence("lo", "hi", F.lit(60).cast("bigint"))).alias("t"))
    return e.join(b, ["stream_id", "t"], "left").select("stream_id", "t", "close", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT pair, count(*) AS n, count(*) FILTER (datetime_utc IS NULL) AS no_time, count(*) FILTER (fwd_ret IS NULL OR isnan(fwd_ret)) AS no_ret, count(*) FILTER (y IS NULL) AS no_y FROM label_rows GROUP BY 1""")
def ref_proj11_finite_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Missing and non-finite values of the required columns."""
    bad = lambda cond: F.count(F.when(F.expr(cond), 1))
    return table(spark, sf, "label_rows").groupBy("pair").agg(F.count("*").alias("n"), bad("datetime_utc IS NULL").alias("no_time"), bad("fwd_ret IS NULL OR isnan(fwd_ret)").alias("no_ret"), bad("y IS NULL").alias("no_y"))


@query(TICKS_SQL + """ SELECT decision_id FROM decisions d WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.stream_id = d.stream_id AND u.epoch // 60 = d.decision_close_epoch // 60)""")
def ref_proj12_clock_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions in a minute without any tick of their stream."""
    minutes = ticks(spark, sf).select("stream_id", F.floor(F.col("epoch") / 60).alias("m")).distinct()
    return table(spark, sf, "decisions").withColumn("m", F.floor(F.col("decision_close_epoch") / 60)).join(minutes, ["stream_id", "m"], "left_anti").select("decision_id")


@query(BARS_SQL + """ SELECT stream_id, t, close FROM b QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY t DESC) <= 5""")
def ref_proj13_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last five bars of each stream."""
    k = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("t")))
    return minute_bars(spark, sf).withColumn("k", k).where("k <= 5").select("stream_id", "t", "close")


@query("""WITH k AS (SELECT * FROM observation_series QUALIFY row_number() OVER (PARTITION BY series_id, timestamps_s ORDER BY obs_id DESC) = 1),
v AS (SELECT series_id, timestamps_s, CASE WHEN NOT isnan(closes) THEN closes END AS c FROM k), m AS (SELECT series_id, median(c) AS m, quantile_cont(c, 0.01) AS lo, quantile_cont(c, 0.99) AS hi FROM v GROUP BY 1)
SELECT series_id, timestamps_s, greatest(least(coalesce(c, m), hi), lo) AS clean FROM v JOIN m USING (series_id)""")
def ref_proj07_impute_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Median imputation, then clipping to the 1st and 99th percentile of the series."""
    v = keep_last(table(spark, sf, "observation_series"), ["series_id", "timestamps_s"], "obs_id").select("series_id", "timestamps_s", F.when(~F.isnan("closes"), F.col("closes")).alias("c"))
    m = v.groupBy("series_id").agg(F.median("c").alias("m"), F.percentile("c", 0.01).alias("lo"), F.percentile("c", 0.99).alias("hi"))
    return v.join(m, "series_id").select("series_id", "timestamps_s", F.greatest(F.least(F.coalesce("c", "m"), "hi"), "lo").alias("clean"))


@query("""SELECT stream_id, epoch, count(*) AS n, count(DISTINCT coalesce(bid::VARCHAR, 'x') || '|' || coalesce(ask::VARCHAR, 'x')) > 1 AS conflict, min(bid) > 0 AND min(ask - bid) >= 0 AS sane
FROM (SELECT stream_id, epoch, CASE WHEN NOT isnan(bid) THEN bid END AS bid, CASE WHEN NOT isnan(ask) THEN ask END AS ask FROM ticks) GROUP BY ALL HAVING count(*) > 1""")
def ref_x01_tick_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated times: whether their quotes differ and meet the invariants."""
    no_nan = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    t = table(spark, sf, "ticks").select("stream_id", "epoch", no_nan("bid"), no_nan("ask"))
    text = F.concat(F.coalesce(F.col("bid").cast("string"), F.lit("x")), F.lit("|"), F.coalesce(F.col("ask").cast("string"), F.lit("x")))
    sane = (F.min("bid") > 0) & (F.min(F.col("ask") - F.col("bid")) >= 0)
    return t.groupBy("stream_id", "epoch").agg(F.count("*").alias("n"), (F.count_distinct(text) > 1).alias("conflict"), sane.alias("sane")).where("n > 1")
