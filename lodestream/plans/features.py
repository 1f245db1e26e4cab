"""Queries on feature blocks (F)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import rolling as R
from lodestream.operators import stateful as S
from lodestream.plans.base import BARS_SQL, SCORED_SQL, TICKS_SQL, Registry, first_half, minute_bars, scored, ticks
from lodestream.plans.windows import KEY, RET_SQL, frame, returns, rolled, win
from lodestream.runtime import table

query = Registry()


def roll(agg: Column, col: str, rows: int, end: int = 0, least: int | None = None) -> Column:
    """A rolling aggregate of bars."""
    return R.rolling(agg, F.col(col), R.span(KEY, "t", rows, end), least or rows)


def out(**columns: Column) -> list[Column]:
    """Rounded result columns."""
    return ["stream_id", "t", *[F.round(c, 5).alias(k) for k, c in columns.items()]]


def sql_out(**columns: str) -> str:
    """The same in SQL."""
    return "SELECT stream_id, t, " + ", ".join(f"round({c}, 5) AS {k}" for k, c in columns.items())


def _ema_sql(x: str, src: str, span: int, name: str) -> str:
    q = 1 - 2 / (span + 1)
    return f"""{name} AS (SELECT a.stream_id, a.t, sum(CASE WHEN b.i = 0 THEN pow({q}, a.i) ELSE {1 - q} * pow({q}, a.i - b.i) END * b.{x}) AS {name} FROM {src} a JOIN {src} b ON a.stream_id = b.stream_id AND b.i <= a.i GROUP BY ALL)"""


_IDX_SQL = BARS_SQL + """, x AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) - 1 AS i, (close / first_value(close) OVER (PARTITION BY stream_id ORDER BY t) - 1) * 10000 AS p FROM b)"""


def indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with p, the price relative to the stream's first in basis points."""
    return minute_bars(spark, sf).withColumn("p", (F.col("close") / F.first("close").over(win()) - 1) * 10000)


@query(_IDX_SQL + ", " + _ema_sql("p", "x", 12, "fast") + ", " + _ema_sql("p", "x", 26, "slow") + """, m AS (SELECT x.stream_id, x.t, x.i, x.p, fast - slow AS macd FROM x JOIN fast USING (stream_id, t) JOIN slow USING (stream_id, t)), """
       + _ema_sql("macd", "m", 9, "signal") + " SELECT m.stream_id, m.t, round(macd, 5) AS macd, round(macd - signal, 5) AS hist, (macd > signal)::INT AS above FROM m JOIN signal USING (stream_id, t)")
def ref_f01_macd(spark: SparkSession, sf: str) -> DataFrame:
    """MACD from block-scan exponential means."""
    x = indexed(spark, sf).select("stream_id", "t", "p")
    macd = F.col("fast") - F.col("slow")
    s = R.ewm_set(x, KEY, "t", [(F.col("p"), 2 / 13, "fast"), (F.col("p"), 2 / 27, "slow"), (macd, 0.2, "signal")]).withColumn("macd", macd)
    return s.select("stream_id", "t", F.round("macd", 5).alias("macd"), F.round(F.col("macd") - F.col("signal"), 5).alias("hist"), (F.col("macd") > F.col("signal")).cast("int").alias("above"))


_RSI_SQL = _IDX_SQL + """, d AS (SELECT stream_id, t, row_number() OVER (PARTITION BY stream_id ORDER BY t) - 1 AS i, greatest(p - q, 0) AS g, greatest(q - p, 0) AS l FROM (SELECT *, lag(p) OVER (PARTITION BY stream_id ORDER BY t) AS q FROM x) WHERE q IS NOT NULL), """


@query(_RSI_SQL + _ema_sql("g", "d", 27, "up") + ", " + _ema_sql("l", "d", 27, "down") + " SELECT stream_id, t, round(CASE WHEN down > 1e-12 THEN 100 - 100 / (1 + up / down) ELSE 50 END, 4) AS rsi FROM up JOIN down USING (stream_id, t)")
def ref_f01_rsi(spark: SparkSession, sf: str) -> DataFrame:
    """RSI of 14 bars; 50 where there is no loss."""
    d = indexed(spark, sf).withColumn("c", F.col("p") - F.lag("p").over(win())).where("c IS NOT NULL")
    d = d.select("stream_id", "t", F.greatest("c", F.lit(0.0)).alias("g"), F.greatest(-F.col("c"), F.lit(0.0)).alias("l"))
    e = R.ewm_set(d, KEY, "t", [(F.col("g"), 1 / 14, "up"), (F.col("l"), 1 / 14, "down")])
    rsi = F.when(F.col("down") > 1e-12, 100 - 100 / (1 + F.col("up") / F.col("down"))).otherwise(50.0)
    return e.select("stream_id", "t", F.round(rsi, 4).alias("rsi"))


@query(RET_SQL + ", p AS (SELECT *, lag(close) OVER (PARTITION BY stream_id ORDER BY t) AS pc FROM r), a AS (SELECT *, (greatest(high, coalesce(pc, high)) - least(low, coalesce(pc, low))) / close * 10000 AS tr FROM p) " + sql_out(
    bb=f"(close - {rolled('avg(close)', 'close', 20)}) / (2 * {rolled('stddev_samp(close)', 'close', 20)} + 1e-6)",
    bw=f"4 * {rolled('stddev_samp(close)', 'close', 20)} / {rolled('avg(close)', 'close', 20)} * 100", atr=rolled("avg(tr)", "tr", 14),
    pos=f"(close - {rolled('min(low)', 'low', 24)}) / ({rolled('max(high)', 'high', 24)} - {rolled('min(low)', 'low', 24)} + 1e-9)", up=rolled("avg((r > 0)::INT)", "r", 12)) + " FROM a")
def ref_f01_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Bollinger position and width, ATR in basis points, range position, up fraction."""
    r = returns(spark, sf).withColumn("pc", F.lag("close").over(win()))
    a = r.withColumn("tr", (F.greatest("high", F.coalesce("pc", "high")) - F.least("low", F.coalesce("pc", "low"))) / F.col("close") * 10000)
    c = F.col("close")
    mean, sd, lo, hi = roll(F.avg("close"), "close", 20), roll(F.stddev_samp("close"), "close", 20), roll(F.min("low"), "low", 24), roll(F.max("high"), "high", 24)
    return a.select(out(bb=(c - mean) / (2 * sd + 1e-6), bw=4 * sd / mean * 100, atr=roll(F.avg("tr"), "tr", 14), pos=(c - lo) / (hi - lo + 1e-9), up=roll(F.avg((F.col("r") > 0).cast("int")), "r", 12)))


@query(SCORED_SQL + """ SELECT row_id, round(sin(2 * pi() * (ts % 86400) / 86400), 6) AS hour_sin, round(cos(2 * pi() * (ts % 86400) / 86400), 6) AS hour_cos, isodow(to_timestamp(ts)::TIMESTAMP)::INT - 1 AS dow,
(hour(timezone('America/New_York', to_timestamp(ts))) BETWEEN 8 AND 16)::INT AS ny, (hour(timezone('Europe/London', to_timestamp(ts))) BETWEEN 8 AND 15)::INT AS ldn, (hour(timezone('Asia/Tokyo', to_timestamp(ts))) BETWEEN 9 AND 17)::INT AS asia FROM s""")
def ref_f03_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Clock features and exchange-local sessions, correct over daylight saving."""
    at, angle = F.timestamp_seconds("ts"), 2 * math.pi * (F.col("ts") % 86400) / 86400
    inside = lambda zone, a, b: F.hour(F.from_utc_timestamp(at, zone)).between(a, b).cast("int")
    return scored(spark, sf).select(
        "row_id", F.round(F.sin(angle), 6).alias("hour_sin"), F.round(F.cos(angle), 6).alias("hour_cos"), F.weekday(at).alias("dow"),
        inside("America/New_York", 8, 16).alias("ny"), inside("Europe/London", 8, 15).alias("ldn"), inside("Asia/Tokyo", 9, 17).alias("asia"),
    )


@query(RET_SQL + """, f AS (SELECT *, avg(r * CASE WHEN stream_id LIKE 'USD%' THEN -1 ELSE 1 END) OVER (PARTITION BY t) AS fac FROM r WHERE r IS NOT NULL)
SELECT stream_id, t, round(fac, 5) AS fac, round(r - fac * CASE WHEN stream_id LIKE 'USD%' THEN -1 ELSE 1 END, 5) AS e FROM f""")
def ref_f06_factor_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Common dollar factor with the streams' signs, and residuals."""
    sign = F.when(F.col("stream_id").startswith("USD"), -1).otherwise(1)
    f = returns(spark, sf).where("r IS NOT NULL").withColumn("fac", F.avg(F.col("r") * sign).over(Window.partitionBy("t")))
    return f.select("stream_id", "t", F.round("fac", 5).alias("fac"), F.round(F.col("r") - F.col("fac") * sign, 5).alias("e"))


@query(RET_SQL + """, k AS (SELECT stream_id, t, CASE WHEN count(r) OVER w = 5 THEN sum(r) OVER w END AS r5 FROM r WINDOW w AS (PARTITION BY stream_id ORDER BY t ROWS 4 PRECEDING)),
c AS (SELECT *, sum(r5) OVER x - r5 AS others, count(r5) OVER x - 1 AS m, stddev_pop(r5) OVER x AS disp, avg(sign(r5)) OVER x AS agree FROM k WHERE r5 IS NOT NULL WINDOW x AS (PARTITION BY t))
SELECT stream_id, t, round(r5, 5) AS r5, round(others / nullif(m, 0), 5) AS basket, round(others / nullif(m, 0) - r5, 5) AS catch_up, round(disp, 5) AS disp, round(agree, 5) AS agree FROM c""")
def ref_f07_cross_block(spark: SparkSession, sf: str) -> DataFrame:
    """Own return, basket of the others, catch-up, dispersion and agreement over five bars."""
    k = returns(spark, sf).select("stream_id", "t", roll(F.sum("r"), "r", 5).alias("r5")).where("r5 IS NOT NULL")
    x = Window.partitionBy("t")
    basket = F.try_divide(F.sum("r5").over(x) - F.col("r5"), F.count("r5").over(x) - 1)
    return k.select(out(r5=F.col("r5"), basket=basket, catch_up=basket - F.col("r5"), disp=F.stddev_pop("r5").over(x), agree=F.avg(F.signum("r5")).over(x)))


@query(RET_SQL + """, f AS (SELECT t, avg(r) AS f FROM r WHERE r IS NOT NULL GROUP BY t), j AS (SELECT stream_id, t, r, f FROM r JOIN f USING (t) WHERE r IS NOT NULL), o AS (SELECT stream_id, regr_slope(r, f) AS b1, regr_intercept(r, f) AS b0 FROM j WHERE t <= (SELECT (min(t) + max(t)) // 2 FROM j) GROUP BY 1)
SELECT stream_id, t, round(r - b0 - b1 * f, 5) AS resid FROM j JOIN o USING (stream_id)""")
def ref_f09_train_residual(spark: SparkSession, sf: str) -> DataFrame:
    """Residual of a line that was fitted on the first half of time only."""
    r = returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", "r")
    j = r.join(r.groupBy("t").agg(F.avg("r").alias("f")), "t")
    fit = first_half(j).groupBy("stream_id").agg(F.regr_slope("r", "f").alias("b1"), F.regr_intercept("r", "f").alias("b0"))
    return j.join(fit, "stream_id").select("stream_id", "t", F.round(F.col("r") - F.col("b0") - F.col("b1") * F.col("f"), 5).alias("resid"))


@query(TICKS_SQL + """, d AS (SELECT *, sign(quote - lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch)) AS s FROM u), c AS (SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS f FROM d),
fl AS (SELECT stream_id, epoch // 60 * 60 AS t, sum(f)::DOUBLE AS flow, sum(abs(f))::DOUBLE AS moves FROM c GROUP BY ALL) """ + sql_out(
    norm="flow / (moves + 1e-9)", sum5=rolled("sum(flow)", "flow", 5), accel=f"{rolled('avg(flow)', 'flow', 3)} - {rolled('avg(flow)', 'flow', 12)}", persist=rolled("avg((flow > 0)::INT)", "flow", 10)) + " FROM fl")
def ref_f10_flow_features(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised, summed, accelerating and persistent order flow."""
    from lodestream.operators.bars import signed_flow

    f = signed_flow(ticks(spark, sf), ["stream_id"], 60)
    return f.select(out(norm=F.col("flow") / (F.col("moves") + 1e-9), sum5=roll(F.sum("flow"), "flow", 5), accel=roll(F.avg("flow"), "flow", 3) - roll(F.avg("flow"), "flow", 12), persist=roll(F.avg((F.col("flow") > 0).cast("int")), "flow", 10)))


@query(SCORED_SQL + """, d AS (SELECT pair, ts // 86400 AS day, sum(fwd_ret) * 10000 AS r, avg(abs(fwd_ret)) * 10000 AS rng FROM s GROUP BY ALL)
SELECT pair, day, round(lag(r) OVER w, 9) AS prev_r, round(lag(rng) OVER w, 9) AS prev_rng, round(avg(r) OVER (PARTITION BY pair ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 9) AS mean5 FROM d WINDOW w AS (PARTITION BY pair ORDER BY day)""")
def ref_f13_daily_context(spark: SparkSession, sf: str) -> DataFrame:
    """Context of prior days only."""
    d = scored(spark, sf).groupBy("pair", F.floor(F.col("ts") / 86400).alias("day")).agg((F.sum("fwd_ret") * 10000).alias("r"), (F.avg(F.abs("fwd_ret")) * 10000).alias("rng"))
    w = Window.partitionBy("pair").orderBy("day")
    return d.select("pair", "day", F.round(F.lag("r").over(w), 9).alias("prev_r"), F.round(F.lag("rng").over(w), 9).alias("prev_rng"), F.round(F.avg("r").over(w.rowsBetween(-5, -1)), 9).alias("mean5"))


@query(BARS_SQL + """, x AS (SELECT *, (close / first_value(close) OVER w - 1) * 10000 AS p, row_number() OVER w AS i FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY t)),
a AS (SELECT *, lag(p) OVER (PARTITION BY stream_id ORDER BY t) AS q, lag(n) OVER (PARTITION BY stream_id ORDER BY t) AS m FROM x), s AS (SELECT *, q * n - p * m AS area FROM a)
SELECT stream_id, t, CASE WHEN i > 10 THEN round(0.5 * sum(area) OVER (PARTITION BY stream_id ORDER BY t ROWS 9 PRECEDING), 4) END AS levy FROM s""")
def ref_f17_levy_area(spark: SparkSession, sf: str) -> DataFrame:
    """Lévy area between price and tick count over ten bars, as a sum of cross products."""
    x = indexed(spark, sf).withColumn("i", F.row_number().over(win()))
    area = F.lag("p").over(win()) * F.col("n") - F.col("p") * F.lag("n").over(win())
    s = x.withColumn("area", area)
    return s.select("stream_id", "t", F.when(F.col("i") > 10, F.round(0.5 * F.sum("area").over(R.span(KEY, "t", 10)), 4)).alias("levy"))


_CODES = " ".join(f"WHEN {cond} THEN {i}" for i, cond in enumerate(["a <= b2 AND b2 <= c", "a <= c AND c < b2", "b2 < a AND a <= c", "c < a AND a <= b2", "b2 <= c AND c < a"]))


@query(RET_SQL + f""", o AS (SELECT stream_id, t, lag(close, 2) OVER w AS a, lag(close) OVER w AS b2, close AS c FROM r WINDOW w AS (PARTITION BY stream_id ORDER BY t)), k AS (SELECT stream_id, t, CASE WHEN a IS NULL THEN NULL {_CODES} ELSE 5 END AS k FROM o),
h AS (SELECT stream_id, t, count(k) OVER w AS n, {", ".join(f"count(*) FILTER (k = {i}) OVER w AS n{i}" for i in range(6))} FROM k WINDOW w AS (PARTITION BY stream_id ORDER BY t ROWS 29 PRECEDING))
SELECT stream_id, t, CASE WHEN n = 30 THEN round(-({" + ".join(f"CASE WHEN n{i} > 0 THEN n{i} / n * ln(n{i} / n) ELSE 0 END" for i in range(6))}) / ln(6), 5) END AS perm_entropy FROM h""")
def ref_f21_permutation_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of ordinal patterns of three closes over 30 bars."""
    o = minute_bars(spark, sf).select("stream_id", "t", F.lag("close", 2).over(win()).alias("a"), F.lag("close").over(win()).alias("b2"), F.col("close").alias("c"))
    code = F.expr(f"CASE WHEN a IS NULL THEN NULL {_CODES} ELSE 5 END")
    k, s = o.withColumn("k", code), R.span(KEY, "t", 30)
    n = F.count("k").over(s)
    share = lambda i: F.count(F.when(F.col("k") == i, 1)).over(s) / n
    entropy = -sum((F.when(share(i) > 0, share(i) * F.log(share(i))).otherwise(0.0) for i in range(6)), F.lit(0.0)) / math.log(6)
    return k.select("stream_id", "t", F.when(n == 30, F.round(entropy, 5)).alias("perm_entropy"))


@query(RET_SQL + ", v AS (SELECT *, CASE WHEN r IS NOT NULL AND lag(r) OVER (PARTITION BY stream_id ORDER BY t) IS NOT NULL THEN r + lag(r) OVER (PARTITION BY stream_id ORDER BY t) END AS r2 FROM r) " + sql_out(vr=f"{rolled('var_samp(r2)', 'r2', 30)} / (2 * {rolled('var_samp(r)', 'r', 30)} + 1e-6)") + " FROM v")
def ref_f22_variance_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Variance of two-bar returns over twice that of one-bar returns."""
    v = returns(spark, sf).withColumn("r2", F.col("r") + F.lag("r").over(win()))
    return v.select(out(vr=roll(F.var_samp("r2"), "r2", 30) / (2 * roll(F.var_samp("r"), "r", 30) + 1e-6)))


@query(BARS_SQL + """ SELECT stream_id, t, round(close * 1000 - floor(close * 1000), 5) AS frac_grid, (floor(close * 1000) <> floor(lag(close) OVER w * 1000))::INT AS crossed FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY t)""")
def ref_f25_round_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Place within the price grid and whether a grid line was crossed."""
    cell = lambda c: F.floor(c * 1000)
    return minute_bars(spark, sf).select("stream_id", "t", F.round(F.col("close") * 1000 - cell(F.col("close")), 5).alias("frac_grid"), (cell(F.col("close")) != cell(F.lag("close").over(win()))).cast("int").alias("crossed"))


@query(RET_SQL + ", v AS (SELECT *, abs(r) * abs(lag(r) OVER (PARTITION BY stream_id ORDER BY t)) AS bp, CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN r * r ELSE 0 END END AS up, r * r AS sq, r * r * r * r AS qu FROM r) " + sql_out(
    rv=rolled("sum(sq)", "sq", 30), bv=f"pi() / 2 * {rolled('sum(bp)', 'bp', 30)}", rs_up=rolled("sum(up)", "up", 30), rq=f"10 * {rolled('sum(qu)', 'qu', 30)}", jump=f"greatest({rolled('sum(sq)', 'sq', 30)} - pi() / 2 * {rolled('sum(bp)', 'bp', 30)}, 0)") + " FROM v")
def ref_f26_realized(spark: SparkSession, sf: str) -> DataFrame:
    """Realised variance, bipower variation, upside semivariance, quarticity, jump part."""
    r = F.col("r")
    v = returns(spark, sf).withColumns({"bp": F.abs(r) * F.abs(F.lag("r").over(win())), "up": F.when(r.isNotNull(), F.when(r > 0, r * r).otherwise(0.0)), "sq": r * r, "qu": r * r * r * r})
    rv, bv = roll(F.sum("sq"), "sq", 30), math.pi / 2 * roll(F.sum("bp"), "bp", 30)
    jump = F.when(rv.isNotNull() & bv.isNotNull(), F.greatest(rv - bv, F.lit(0.0))).when(rv.isNotNull() | bv.isNotNull() | F.lit(True), F.lit(0.0))
    return v.select(out(rv=rv, bv=bv, rs_up=roll(F.sum("up"), "up", 30), rq=10 * roll(F.sum("qu"), "qu", 30), jump=jump))


_RULES = [("calibration", "calib"), ("payout", "cost"), ("drift test|falsifier", "audit"), ("gap|queue", "plumbing"), ("win rate|breakeven", "score")]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{c}'" for p, c in _RULES) + " ELSE 'other' END AS topic, CASE WHEN regexp_matches(lower(text), 'rejected|failed|lost|slipped') THEN -1 WHEN regexp_matches(lower(text), 'stable|survived|beat') THEN 1 ELSE 0 END::INT AS tone FROM documents")
def ref_f29_text_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered regular-expression rules, the first match wins, with a signed tone."""
    low = F.lower("text")
    topic = F.coalesce(*[F.when(low.rlike(p), F.lit(c)) for p, c in _RULES], F.lit("other"))
    tone = F.when(low.rlike("rejected|failed|lost|slipped"), -1).when(low.rlike("stable|survived|beat"), 1).otherwise(0)
    return table(spark, sf, "documents").select("doc_id", topic.alias("topic"), tone.alias("tone"))


_CELLS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def _te(count) -> str:
    n = lambda cond: f"({count(cond)})"
    terms = []
    for a, b, c in _CELLS:
        abc, bc, ab, only = n(f"y1 = {a} AND y0 = {b} AND x0 = {c}"), n(f"y0 = {b} AND x0 = {c}"), n(f"y1 = {a} AND y0 = {b}"), n(f"y0 = {b}")
        terms.append(f"CASE WHEN {abc} > 0 THEN {abc} / 60e0 * ln({abc} * 1e0 * {only} / ({bc} * 1e0 * {ab})) ELSE 0 END")
    return " + ".join(terms)


@query(RET_SQL + """, f AS (SELECT t, (avg(r) > 0)::INT AS x FROM r WHERE r IS NOT NULL GROUP BY t), j AS (SELECT stream_id, t, (r > 0)::INT AS y1, lag((r > 0)::INT) OVER (PARTITION BY stream_id ORDER BY t) AS y0, lag(x) OVER (PARTITION BY stream_id ORDER BY t) AS x0 FROM r JOIN f USING (t) WHERE r IS NOT NULL),
v AS (SELECT * FROM j WHERE y0 IS NOT NULL) SELECT stream_id, t, CASE WHEN count(*) OVER """ + frame(60) + " = 60 THEN round(" + _te(lambda c: f"count(*) FILTER ({c}) OVER {frame(60)}") + ", 5) END AS te FROM v")
def ref_f32_transfer_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Binary transfer entropy from the basket to a stream over 60 bars."""
    r = returns(spark, sf).where("r IS NOT NULL")
    f = r.groupBy("t").agg((F.avg("r") > 0).cast("int").alias("x"))
    j = r.join(f, "t").select("stream_id", "t", (F.col("r") > 0).cast("int").alias("y1"), "x")
    v = j.withColumns({"y0": F.lag("y1").over(win()), "x0": F.lag("x").over(win())}).where("y0 IS NOT NULL")
    names: dict[str, str] = {}

    def count(cond: str) -> str:
        return names.setdefault(cond, f"c{len(names)}")

    te = _te(count)
    s = R.span(KEY, "t", 60)
    counted = v.withColumns({name: F.count(F.expr(f"CASE WHEN {cond} THEN 1 END")).over(s) for cond, name in names.items()} | {"m": F.count("*").over(s)})
    return counted.select("stream_id", "t", F.when(F.col("m") == 60, F.round(F.expr(te).cast("double"), 5)).alias("te"))


@query(RET_SQL + """, l AS (SELECT t, max(ln(close)) FILTER (stream_id = 'EURUSD:alder') AS a, max(ln(close)) FILTER (stream_id = 'GBPUSD:alder') AS b2 FROM b GROUP BY t), e AS (SELECT 'EURGBP' AS stream_id, t, (a - b2) * 10000 AS x FROM l WHERE a IS NOT NULL AND b2 IS NOT NULL) """ + sql_out(band=f"(x - {rolled('avg(x)', 'x', 30)}) / ({rolled('stddev_samp(x)', 'x', 30)} + 1e-6)") + " FROM e")
def ref_f35_synthetic_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Error-correction band of a synthetic cross of two legs."""
    leg = lambda s: F.max(F.when(F.col("stream_id") == s, F.log("close")))
    l = minute_bars(spark, sf).where(F.col("stream_id").isin("EURUSD:alder", "GBPUSD:alder")).groupBy("t").agg(leg("EURUSD:alder").alias("a"), leg("GBPUSD:alder").alias("b2")).dropna()  # noqa: E741
    e = l.select(F.lit("EURGBP").alias("stream_id"), "t", ((F.col("a") - F.col("b2")) * 10000).alias("x"))
    return e.select(out(band=(F.col("x") - roll(F.avg("x"), "x", 30)) / (roll(F.stddev_samp("x"), "x", 30) + 1e-6)))


@query(BARS_SQL + """, d AS (SELECT *, first_value(open) OVER (PARTITION BY stream_id, t // 14400 ORDER BY t) AS o, lag(close, 30) OVER (PARTITION BY stream_id ORDER BY t) AS c30 FROM b) SELECT stream_id, t, round((close / o - 1) * 10000, 5) AS since_open, round((close / c30 - 1) * 10000, 5) AS last30 FROM d""")
def ref_f37_intraday_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Return since the open of the four-hour block and over the last 30 bars."""
    o = F.first("open").over(Window.partitionBy("stream_id", F.floor(F.col("t") / 14400)).orderBy("t"))
    return minute_bars(spark, sf).select("stream_id", "t", F.round((F.col("close") / o - 1) * 10000, 5).alias("since_open"), F.round((F.col("close") / F.lag("close", 30).over(win()) - 1) * 10000, 5).alias("last30"))


@query(_IDX_SQL + """, d AS (SELECT *, p - lag(p) OVER (PARTITION BY stream_id ORDER BY t) AS d, abs(p - lag(p, 10) OVER (PARTITION BY stream_id ORDER BY t)) AS net FROM x), z AS (SELECT *, greatest(d, 0) AS g, CASE WHEN d IS NOT NULL THEN abs(d) END AS ad FROM d WHERE d IS NOT NULL) """ + sql_out(
    disparity=f"p - {rolled('avg(p)', 'p', 20)}", cmo=f"100 * (2 * {rolled('sum(g)', 'g', 14)} - {rolled('sum(ad)', 'ad', 14)}) / ({rolled('sum(ad)', 'ad', 14)} + 1e-6)", kaer=f"net / ({rolled('sum(ad)', 'ad', 10)} + 1e-6)",
    chop=f"100 * ln({rolled('sum(ad)', 'ad', 14)} / (({rolled('max(p)', 'p', 14)} - {rolled('min(p)', 'p', 14)}) + 1e-3) + 1e-3) / ln(14)") + " FROM z")
def ref_f38_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Disparity, Chande momentum, efficiency ratio and choppiness."""
    z = indexed(spark, sf).withColumns({"d": F.col("p") - F.lag("p").over(win()), "net": F.abs(F.col("p") - F.lag("p", 10).over(win()))}).where("d IS NOT NULL")
    z = z.withColumns({"g": F.greatest("d", F.lit(0.0)), "ad": F.abs("d")})
    ups, path = roll(F.sum("g"), "g", 14), roll(F.sum("ad"), "ad", 14)
    width = roll(F.max("p"), "p", 14) - roll(F.min("p"), "p", 14)
    return z.select(out(disparity=F.col("p") - roll(F.avg("p"), "p", 20), cmo=100 * (2 * ups - path) / (path + 1e-6), kaer=F.col("net") / (roll(F.sum("ad"), "ad", 10) + 1e-6), chop=100 * F.log(path / (width + 1e-3) + 1e-3) / math.log(14)))


@query(BARS_SQL + """, h AS (SELECT *, high - low AS rng, lag(close, 1) OVER w AS c1, lag(close, 2) OVER w AS c2, lag(close, 3) OVER w AS c3, lag(high) OVER w AS h1 FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY t)), n AS (SELECT *, min(rng) OVER (PARTITION BY stream_id ORDER BY t ROWS 6 PRECEDING) AS m7, count(*) OVER (PARTITION BY stream_id ORDER BY t ROWS 6 PRECEDING) AS k FROM h)
SELECT stream_id, t, (k = 7 AND rng = m7)::INT AS nr7, coalesce((c3 > c2 AND c2 > c1 AND close > h1)::INT, 0) AS reversal FROM n""")
def ref_f39_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Narrowest range of seven bars, and a reversal after three falls."""
    n = minute_bars(spark, sf).withColumn("rng", F.col("high") - F.col("low"))
    s, c = R.span(KEY, "t", 7), lambda k: F.lag("close", k).over(win())
    nr7 = (F.count("*").over(s) == 7) & (F.col("rng") == F.min("rng").over(s))
    rev = (c(3) > c(2)) & (c(2) > c(1)) & (F.col("close") > F.lag("high").over(win()))
    return n.select("stream_id", "t", nr7.cast("int").alias("nr7"), F.coalesce(rev.cast("int"), F.lit(0)).alias("reversal"))


def _blocks(spark: SparkSession, sf: str, function, columns: list[str], source: str = "p", warmup: int = 1_024) -> DataFrame:
    """A function of at most warmup + 1 rows, or one that forgets what lies further back, in blocks of rows."""
    rows = indexed(spark, sf) if source == "p" else returns(spark, sf)
    return S.by_rows(rows.select("stream_id", "t", source), "stream_id", "t", source, 4_096, warmup, function, columns)


@query(_IDX_SQL.replace("WITH", "WITH RECURSIVE") + """, k AS (SELECT stream_id, t, i, p AS level, 0.0::DOUBLE AS slope, 0.0::DOUBLE AS innovation FROM x WHERE i = 0
  UNION ALL SELECT x.stream_id, x.t, x.i, k.level + k.slope + 0.2 * (x.p - k.level - k.slope), k.slope + 0.02 * (x.p - k.level - k.slope), x.p - k.level - k.slope FROM k JOIN x ON x.stream_id = k.stream_id AND x.i = k.i + 1)
SELECT stream_id, t, round(slope, 6) AS slope, round(innovation, 6) AS innovation FROM k""")
def ref_f18_kalman(spark: SparkSession, sf: str) -> DataFrame:
    """Local linear trend by a steady-gain filter."""
    return _blocks(spark, sf, S.local_trend, ["slope", "innovation"]).select("stream_id", "t", F.round("slope", 6).alias("slope"), F.round("innovation", 6).alias("innovation"))


@query(_IDX_SQL.replace("WITH", "WITH RECURSIVE") + """, w AS (SELECT 0 AS k, 1.0::DOUBLE AS w UNION ALL SELECT k + 1, -w * (0.4 - (k + 1) + 1) / (k + 1) FROM w WHERE abs(w * (0.4 - (k + 1) + 1) / (k + 1)) >= 1e-5), n AS (SELECT max(k) AS last FROM w),
s AS (SELECT a.stream_id, a.t, sum(w.w * b.p) AS ffd FROM x a JOIN n ON a.i >= n.last JOIN x b ON b.stream_id = a.stream_id AND b.i <= a.i AND b.i >= a.i - n.last JOIN w ON w.k = a.i - b.i GROUP BY ALL)
SELECT x.stream_id, x.t, round(ffd, 5) AS ffd FROM x LEFT JOIN s USING (stream_id, t)""")
def ref_f20_fractional_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-width fractional difference over all weights of at least 1e-5."""
    rows = indexed(spark, sf).select("stream_id", "t", "p")
    return S.by_rows(rows, "stream_id", "t", "p", 4_096, len(S.fractional_weights()) - 1, S.fractional_difference, ["ffd"]).select("stream_id", "t", F.round("ffd", 5).alias("ffd"))


#: Rows after which the two-state filter has forgotten where it started.
_FORGOTTEN = 1_024


@query(RET_SQL.replace("WITH", "WITH RECURSIVE") + """, q AS (SELECT stream_id, t, r, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i, count(r) OVER w AS n, quantile_cont(abs(r), 0.25) OVER w * sqrt(pi() / 2) AS lo, quantile_cont(abs(r), 0.75) OVER w * sqrt(pi() / 2) AS hi FROM r WHERE r IS NOT NULL
  WINDOW w AS (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 480 PRECEDING AND 1 PRECEDING)),
k AS (SELECT stream_id, 0::BIGINT AS i, 0.5::DOUBLE AS p, false AS has, NULL::BIGINT AS t FROM (SELECT DISTINCT stream_id FROM q)
  UNION ALL SELECT stream_id, i, CASE WHEN has AND wild + calm > 0 THEN wild / (wild + calm) WHEN has THEN prior ELSE was END, has, t FROM (
    SELECT stream_id, i, t, has, was, prior, CASE WHEN has THEN prior * exp(-0.5 * (r / hi) * (r / hi)) / hi ELSE 0 END AS wild, CASE WHEN has THEN (1 - prior) * exp(-0.5 * (r / lo) * (r / lo)) / lo ELSE 0 END AS calm FROM (
      SELECT q.*, k.p AS was, k.p * 0.98 + (1 - k.p) * (1 - 0.98) AS prior, q.n >= 60 AND q.lo > 0 AND q.hi > q.lo AS has FROM k JOIN q ON q.stream_id = k.stream_id AND q.i = k.i + 1)))
SELECT stream_id, t, CASE WHEN has THEN round(p, 6) END AS wild FROM k WHERE i > 0""")
def ref_f22_two_state_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Forward probability of the wild state; scales of 480 rows before, 60 at least, as the streams are short."""
    rows = returns(spark, sf).select("stream_id", "t", "r")
    return S.by_rows(rows, "stream_id", "t", "r", 4_096, 480 + _FORGOTTEN, lambda v: S.two_state_filter(v, rows=480, least=60), ["wild"]).select("stream_id", "t", F.round("wild", 6).alias("wild"))


@query(_IDX_SQL.replace("WITH", "WITH RECURSIVE") + """, k AS (SELECT stream_id, t, i, p AS play FROM x WHERE i = 0
  UNION ALL SELECT x.stream_id, x.t, x.i, least(x.p + 2, greatest(x.p - 2, k.play)) FROM k JOIN x ON x.stream_id = k.stream_id AND x.i = k.i + 1)
SELECT stream_id, t, round(play, 6) AS play FROM k""")
def ref_f27_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    """Play operator, carried through the whole stream."""
    return S.hysteresis(indexed(spark, sf).select("stream_id", "t", "p"), "stream_id", "t", "p").select("stream_id", "t", F.round("play", 6).alias("play"))


@query(RET_SQL + """, q AS (SELECT stream_id, t, r, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS i FROM r WHERE r IS NOT NULL),
j AS (SELECT a.stream_id, a.t, b.i, b.r, avg(b.r) OVER w AS m, stddev_pop(b.r) OVER w AS sd FROM q a JOIN q b ON b.stream_id = a.stream_id AND b.i BETWEEN a.i - 63 AND a.i WHERE a.i >= 64 WINDOW w AS (PARTITION BY a.stream_id, a.t)),
p AS (SELECT stream_id, t, sd, sum(r - m) OVER (PARTITION BY stream_id, t ORDER BY i) AS path FROM j), h AS (SELECT stream_id, t, CASE WHEN any_value(sd) > 1e-9 THEN ln((max(path) - min(path)) / any_value(sd)) / ln(32) END AS hurst FROM p GROUP BY ALL)
SELECT q.stream_id, q.t, round(hurst, 5) AS hurst FROM q LEFT JOIN h USING (stream_id, t)""")
def ref_f33_hurst(spark: SparkSession, sf: str) -> DataFrame:
    """Rescaled range of trailing windows."""
    return _blocks(spark, sf, S.rescaled_range, ["hurst"], "r").select("stream_id", "t", F.round("hurst", 5).alias("hurst"))


@query()
def ref_f34_singular_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the first singular component."""
    return _blocks(spark, sf, S.singular_spectrum, ["first_share"])
