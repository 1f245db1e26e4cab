"""Queries on whole feature blocks (F): the technical set on six clocks, indicators on five, all lookbacks across pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import technical as T
from lodestream.operators.bars import slower_bars, time_bars, usable_ticks
from lodestream.operators.stateful import frames_by_rows
from lodestream.plans.base import BARS_SQL, TICKS_SQL, Registry, minute_bars, ticks
from lodestream.plans.features import roll
from lodestream.plans.windows import KEY, win
from lodestream.runtime import table, written

query = Registry()
#: The clocks of the technical set in seconds.
CLOCKS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1_800, "1h": 3_600, "4h": 14_400}
#: Rows of a frame.
BLOCK = 4_096
_W = "OVER (PARTITION BY stream_id ORDER BY t)"


def _over(fn: str, n: int, col: str = "c") -> str:
    w = f"OVER (PARTITION BY stream_id ORDER BY t ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({col}) {w} = {n} THEN {fn} {w} END"


def _ema(x: str, source: str, alpha: float, name: str) -> str:
    """A table (stream_id, t, name): the exponential mean as a sum over all earlier rows; i counts rows from 0."""
    return f"{name} AS (SELECT a.stream_id, a.t, sum(CASE WHEN b.i = 0 THEN pow({1 - alpha}, a.i) ELSE {alpha} * pow({1 - alpha}, a.i - b.i) END * b.{x}) AS {name} FROM {source} a JOIN {source} b ON a.stream_id = b.stream_id AND b.i <= a.i GROUP BY ALL)"


def technical_sql(seconds: int, s: str) -> str:
    """Tables that end in f_<s>: (stream_id, t) and the technical set, by windows and sums alone."""
    tables = [
        f"b_{s} AS (SELECT stream_id, epoch // {seconds} * {seconds} AS t, max(quote) AS h, min(quote) AS l, arg_max(quote, epoch) AS c FROM u GROUP BY ALL)",
        f"x_{s} AS (SELECT *, row_number() {_W} - 1 AS i, c - lag(c) {_W} AS d, c / lag(c) {_W} - 1 AS r, lag(c) {_W} AS pc FROM b_{s})",
        f"d_{s} AS (SELECT stream_id, t, i - 1 AS i, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM x_{s} WHERE d IS NOT NULL)",
        f"tr_{s} AS (SELECT stream_id, t, i, greatest(h - l, coalesce(abs(h - pc), 0), coalesce(abs(l - pc), 0)) AS tr FROM x_{s})",
        *[_ema("c", f"x_{s}", 2 / (n + 1), f"e{n}_{s}") for n in (*T.SPANS, 12, 26)],
        _ema("up", f"d_{s}", 1 / 14, f"up_{s}"), _ema("dn", f"d_{s}", 1 / 14, f"dn_{s}"), _ema("tr", f"tr_{s}", 1 / 14, f"atr_{s}"),
        f"m_{s} AS (SELECT x.stream_id, x.t, x.i, e12_{s} - e26_{s} AS macd FROM x_{s} x JOIN e12_{s} USING (stream_id, t) JOIN e26_{s} USING (stream_id, t))",
        _ema("macd", f"m_{s}", 0.2, f"sig_{s}"),
        f"""j_{s} AS (SELECT x.*, {", ".join(f"e{n}_{s} AS e{n}" for n in T.SPANS)}, macd, sig_{s} AS sig, atr_{s} AS atr, CASE WHEN dn_{s} > 1e-15 THEN 100 - 100 / (1 + up_{s} / dn_{s}) ELSE 50 END AS rsi, lag(x.r) OVER (PARTITION BY x.stream_id ORDER BY x.t) * 1e4 AS r0, x.r * 1e4 AS r1
        FROM x_{s} x {" ".join(f"JOIN e{n}_{s} USING (stream_id, t)" for n in T.SPANS)} JOIN m_{s} USING (stream_id, t) JOIN sig_{s} USING (stream_id, t) JOIN atr_{s} USING (stream_id, t) LEFT JOIN up_{s} USING (stream_id, t) LEFT JOIN dn_{s} USING (stream_id, t))""",
        f"k_{s} AS (SELECT *, CASE WHEN r0 IS NOT NULL THEN r1 END AS ra, CASE WHEN r0 IS NOT NULL THEN r0 END AS rb FROM j_{s})",
    ]
    f = {f"ret_{k}": f"c / lag(c, {k}) {_W} - 1" for k in T.RETURNS}
    for n in T.SPANS:
        f |= {f"dist_ema{n}": f"c / e{n} - 1", f"above_ema{n}": f"(c / e{n} - 1 > 1e-12)::INT"}
    f |= {
        "ema20_slope": f"(e20 - lag(e20) {_W}) / c", "ema_fast_slow": "e10 / e50 - 1", "rsi": "(rsi - 50) / 50", "rsi_rising": f"coalesce(rsi - lag(rsi) {_W} > 1e-9, false)::INT", "rsi_ob": "(rsi > 70)::INT", "rsi_os": "(rsi < 30)::INT",
        "macd_hist": "(macd - sig) / c", "macd_pos": "(macd - sig > 1e-13)::INT", "bb_pctb": f"(c - {_over('avg(c)', 20)}) / (2 * {_over('stddev_samp(c)', 20)} + 1e-6)", "bb_width": f"4 * {_over('stddev_samp(c)', 20)} / {_over('avg(c)', 20)}",
        "rv_12": _over("stddev_samp(r)", 12, "r"), "rv_24": _over("stddev_samp(r)", 24, "r"), "atr_pct": "atr / c",
    }
    for n in T.RANGES:
        hi, lo = _over("max(h)", n), _over("min(l)", n)
        f |= {f"rangepos_{n}": f"(c - {lo}) / ({hi} - {lo} + 1e-9)", f"dist_hi_{n}": f"c / {hi} - 1", f"dist_lo_{n}": f"c / {lo} - 1"}
    w20 = "OVER (PARTITION BY stream_id ORDER BY t ROWS 19 PRECEDING)"
    f |= {
        "slope_20": f"CASE WHEN count(c) {w20} = 20 THEN regr_slope(c, i) {w20} / c END",
        "autocorr_10": f"CASE WHEN count(ra) {w20} = 20 AND var_pop(ra) {w20} > 1e-16 AND var_pop(rb) {w20} > 1e-16 THEN covar_pop(ra, rb) {w20} / sqrt(var_pop(ra) {w20} * var_pop(rb) {w20}) END",
        "upfrac_10": f"CASE WHEN i >= 9 THEN avg(coalesce(r > 0, false)::INT) OVER (PARTITION BY stream_id ORDER BY t ROWS 9 PRECEDING) END",
    }
    return ", ".join(tables) + f", f_{s} AS (SELECT stream_id, t, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in f.items()) + f" FROM k_{s})"


def technical(bars: DataFrame, seconds: int = 60) -> DataFrame:
    """The technical set of minute bars on one clock."""
    return frames_by_rows(bars if seconds == 60 else slower_bars(bars, KEY, seconds), "stream_id", "t", ["high", "low", "close"], BLOCK, T.WARMUP, T.technical_set, T.TECHNICAL)


@query(TICKS_SQL + ", " + technical_sql(60, "1m") + " SELECT stream_id, t, " + ", ".join(f"round({c}, 7) AS {c}" for c in T.TECHNICAL) + " FROM f_1m")
def ref_f01_technical(spark: SparkSession, sf: str) -> DataFrame:
    """The whole technical set on minute bars."""
    return technical(minute_bars(spark, sf)).select("stream_id", "t", *[F.round(c, 7).alias(c) for c in T.TECHNICAL])


@query(TICKS_SQL + ", " + technical_sql(60, "1m") + " SELECT stream_id, t, " + ", ".join(f"round({c}, 7) AS {c}" for c in T.TECHNICAL) + " FROM f_1m QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY t DESC) = 1")
def ref_f01_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The technical set of each stream's latest minute, from the ticks of the last 14 days alone: what a minute's scoring waits for.

    A stream with fewer bars than the warm-up in that time keeps a trace of where its means began.
    """
    rows = table(spark, sf, "ticks")
    since = (rows.agg(F.max("epoch")).first()[0] or 0) - 14 * 86_400
    bars = time_bars(usable_ticks(rows.where(F.col("epoch") >= since)), KEY, 60)  # the filter reaches the scan
    made = frames_by_rows(bars, "stream_id", "t", ["high", "low", "close"], 2 * T.WARMUP, T.WARMUP, T.technical_set, T.TECHNICAL)
    last = made.groupBy("stream_id").agg(*[F.max_by(c, "t").alias(c) for c in T.TECHNICAL], F.max("t").alias("t"))
    return last.select("stream_id", "t", *[F.round(c, 7).alias(c) for c in T.TECHNICAL])


_HIGHER = [c for c in CLOCKS if c != "1m"]


@query(TICKS_SQL + ", " + ", ".join(technical_sql(s, c) for c, s in CLOCKS.items())
       + "".join(f", l_{c} AS (SELECT stream_id, t, {', '.join(f'lag({x}) {_W} AS {x}' for x in T.TECHNICAL)} FROM f_{c})" for c in _HIGHER)
       + " SELECT f_1m.stream_id, f_1m.t, " + ", ".join(f"round({'f' if c == '1m' else 'l'}_{c}.{x}, 7) AS f{c}_{x}" for c in CLOCKS for x in T.TECHNICAL)
       + ", round(list_avg([" + ", ".join(f"{'f' if c == '1m' else 'l'}_{c}.above_ema50" for c in CLOCKS) + "]), 7) AS mtf_trend_align, round(list_avg([" + ", ".join(f"{'f' if c == '1m' else 'l'}_{c}.rsi" for c in CLOCKS) + "]), 7) AS mtf_rsi_mean FROM f_1m "
       + " ".join(f"JOIN l_{c} ON f_1m.stream_id = l_{c}.stream_id AND l_{c}.t = f_1m.t // {CLOCKS[c]} * {CLOCKS[c]}" for c in _HIGHER))
def ref_f02_all_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """The technical set on six clocks, of the slower ones that of the last completed bar, and how far the clocks agree."""
    bars = written(minute_bars(spark, sf), "bars")  # six clocks read them
    wide = technical(bars).select("stream_id", "t", *[F.col(x).alias(f"f1m_{x}") for x in T.TECHNICAL])
    for c in _HIGHER:
        # every minute bar lies in a slower bar: the one before that is the last completed
        done = technical(bars, CLOCKS[c]).select("stream_id", F.col("t").alias("slow"), *[F.lag(x).over(win()).alias(f"f{c}_{x}") for x in T.TECHNICAL])
        wide = wide.withColumn("slow", F.floor(F.col("t") / CLOCKS[c]) * CLOCKS[c]).join(done, ["stream_id", "slow"]).drop("slow")
    over = lambda x: [F.col(f"f{c}_{x}") for c in CLOCKS]
    mean = lambda cols: sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0)) / F.nullif(sum((c.isNotNull().cast("int") for c in cols), F.lit(0)), F.lit(0))
    features = [F.round(f"f{c}_{x}", 7).alias(f"f{c}_{x}") for c in CLOCKS for x in T.TECHNICAL]
    return wide.select("stream_id", "t", *features, F.round(mean(over("above_ema50")), 7).alias("mtf_trend_align"), F.round(mean(over("rsi")), 7).alias("mtf_rsi_mean"))


def indicators_sql(seconds: int, s: str) -> str:
    """Tables that end in g_<s>: (stream_id, t) and the indicator set."""
    still = lambda n: f"CASE WHEN {_over('stddev_samp(c)', n)} < 1e-7 THEN 0 ELSE {_over('stddev_samp(c)', n)} END"
    far = lambda n: f"c / {_over('avg(c)', n)} - 1"
    return f"""b_{s} AS (SELECT stream_id, epoch // {seconds} * {seconds} AS t, arg_max(quote, epoch) AS c FROM u GROUP BY ALL),
x_{s} AS (SELECT *, abs(c - lag(c) {_W}) AS path, greatest(c - lag(c) {_W}, 0) AS rise, greatest(lag(c) {_W} - c, 0) AS fall, lag(c) {_W} IS NOT NULL AS ok, ({still(10)}) * 1e4 AS dev, {far(14)} AS far14, {far(20)} AS far20, c - {_over('avg(c)', 30)} AS over30 FROM b_{s}),
v_{s} AS (SELECT stream_id, t, dev - lag(dev) {_W} AS ch FROM x_{s}), w_{s} AS (SELECT stream_id, t, row_number() {_W} - 1 AS i, greatest(ch, 0) AS vu, greatest(-ch, 0) AS vd FROM v_{s} WHERE ch IS NOT NULL),
{_ema('vu', f'w_{s}', 0.1, f'vu_{s}')}, {_ema('vd', f'w_{s}', 0.1, f'vd_{s}')},
y_{s} AS (SELECT *, CASE WHEN ok THEN rise END AS up, CASE WHEN ok THEN fall END AS dn, (over30 > 1e-9)::INT AS above, (over30 < -1e-9)::INT AS below FROM x_{s}),
g_{s} AS (SELECT y.stream_id, y.t, far14 * 100 AS disp, far20 / (2 * {_over('stddev_samp(far20)', 20, 'far20')} + 1e-7) AS madz, 100 - 100 / (1 + vu_{s} / (vd_{s} + 1e-7)) AS rvivol,
({_over('sum(up)', 14, 'up')} - {_over('sum(dn)', 14, 'up')}) / ({_over('sum(up)', 14, 'up')} + {_over('sum(dn)', 14, 'up')} + 1e-7) * 100 AS cmo, {_over('sum(above)', 30, 'above')} / ({_over('sum(above)', 30, 'above')} + {_over('sum(below)', 30, 'above')} + 1e-12) * 100 AS tii,
abs(c - lag(c, 10) {_W}) / ({_over('sum(path)', 10, 'path')} + 1e-7) AS kamaer, ({still(5)}) / (({still(20)}) + 1e-7) AS volr,
100 * log10({_over('sum(path)', 14, 'path')} / ({_over('max(c)', 14)} - {_over('min(c)', 14)} + 1e-7) + 1e-7) / log10(14) AS chop FROM y_{s} y LEFT JOIN vu_{s} USING (stream_id, t) LEFT JOIN vd_{s} USING (stream_id, t))"""


def _digits(indicator: str) -> int:
    """Decimals of an indicator; ratios of deviations are exact to fewer."""
    return 2 if indicator in ("volr", "rvivol") else 3


#: The clocks of the indicators.
_SLOW = {"1m": 60, "5m": 300, "15m": 900, "30m": 1_800, "60m": 3_600}


@query(TICKS_SQL + ", " + ", ".join(indicators_sql(s, c) for c, s in _SLOW.items())
       + "".join(f", l_{c} AS (SELECT stream_id, t, {', '.join(f'lag({x}) {_W} AS {x}' for x in T.INDICATORS)} FROM g_{c})" for c in _SLOW if c != "1m")
       + " SELECT g_1m.stream_id, g_1m.t, " + ", ".join(f"round({'g' if c == '1m' else 'l'}_{c}.{x}, {_digits(x)}) AS k{c}_{x}" for c in _SLOW for x in T.INDICATORS) + " FROM g_1m "
       + " ".join(f"JOIN l_{c} ON g_1m.stream_id = l_{c}.stream_id AND l_{c}.t = g_1m.t // {_SLOW[c]} * {_SLOW[c]}" for c in _SLOW if c != "1m"))
def ref_f38_all_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """The indicator set on five clocks, of the slower ones that of the last completed bar."""
    wide, bars = None, written(minute_bars(spark, sf), "bars")  # five clocks read them
    for c, s in _SLOW.items():
        made = frames_by_rows(slower_bars(bars, KEY, s), "stream_id", "t", ["close"], BLOCK, 480, T.indicator_set, T.INDICATORS)
        if wide is None:
            wide = made.select("stream_id", "t", *[F.col(x).alias(f"k{c}_{x}") for x in T.INDICATORS])
        else:
            done = made.select("stream_id", F.col("t").alias("slow"), *[F.lag(x).over(win()).alias(f"k{c}_{x}") for x in T.INDICATORS])
            wide = wide.withColumn("slow", F.floor(F.col("t") / s) * s).join(done, ["stream_id", "slow"]).drop("slow")
    return wide.select("stream_id", "t", *[F.round(f"k{c}_{x}", _digits(x)).alias(f"k{c}_{x}") for c in _SLOW for x in T.INDICATORS])


#: Lookbacks of the block across pairs.
LOOKBACKS = (1, 3, 5, 10, 15, 30)
_SIGN = "CASE WHEN stream_id LIKE 'USD%' THEN -1 ELSE 1 END"
_ACROSS_SQL = BARS_SQL + f""", k AS (SELECT stream_id, split_part(stream_id, ':', 2) AS venue, t, unnest([{", ".join(f"struct_pack(k := {k}, x := ln(close / lag(close, {k}) {_W}) * 1e4 * {_SIGN})" for k in LOOKBACKS)}], recursive := true) FROM b),
v AS (SELECT * FROM k WHERE x IS NOT NULL)"""


def across(spark: SparkSession, sf: str) -> DataFrame:
    """(stream_id, venue, t, k, x): log returns over every lookback in basis points, signed as the dollar's weakness."""
    sign = F.when(F.col("stream_id").startswith("USD"), -1).otherwise(1)
    made = [F.struct(F.lit(k).alias("k"), (F.log(F.col("close") / F.lag("close", k).over(win())) * 1e4 * sign).alias("x")) for k in LOOKBACKS]
    rows = minute_bars(spark, sf).withColumn("made", F.array(*made))
    return rows.select("stream_id", F.split_part("stream_id", F.lit(":"), F.lit(2)).alias("venue"), "t", F.inline("made")).where("x IS NOT NULL")


@query(_ACROSS_SQL + """, o AS (SELECT a.stream_id, a.t, a.k, any_value(a.x) AS own, avg(b.x) AS basket, stddev_pop(b.x) AS disp, count(*) FILTER (b.x > 1e-9) AS ups, count(*) FILTER (b.x < -1e-9) AS downs, count(*) AS m
  FROM v a JOIN v b ON a.venue = b.venue AND a.t = b.t AND a.k = b.k AND a.stream_id <> b.stream_id GROUP BY ALL)
SELECT stream_id, t, k, round(own, 4) AS own, round(basket, 4) AS basket, round(basket - own, 4) AS catch_up, round(disp, 3) AS disp, round(CASE WHEN basket > 1e-9 THEN ups WHEN basket < -1e-9 THEN downs ELSE m - ups - downs END / m, 5) AS agree FROM o""")
def ref_f07_all_lookbacks(spark: SparkSession, sf: str) -> DataFrame:
    """Own return, basket of the venue's other pairs, catch-up, dispersion and agreement over six lookbacks: one window, no join."""
    x, w = F.col("x"), Window.partitionBy("venue", "t", "k")
    up, down = (x > 1e-9).cast("int"), (x < -1e-9).cast("int")
    rows = across(spark, sf).withColumns({"m": F.count("*").over(w) - 1, "s": F.sum("x").over(w) - x, "q": F.sum(x * x).over(w) - x * x, "ups": F.sum(up).over(w) - up, "downs": F.sum(down).over(w) - down}).where("m > 0")
    rows = rows.withColumn("basket", F.col("s") / F.col("m"))
    disp = F.sqrt(F.greatest(F.col("q") / F.col("m") - F.col("basket") ** 2, F.lit(0.0)))
    agree = F.when(F.col("basket") > 1e-9, F.col("ups")).when(F.col("basket") < -1e-9, F.col("downs")).otherwise(F.col("m") - F.col("ups") - F.col("downs")) / F.col("m")
    return rows.select("stream_id", "t", "k", F.round("x", 4).alias("own"), F.round("basket", 4).alias("basket"), F.round(F.col("basket") - x, 4).alias("catch_up"), F.round(disp, 3).alias("disp"), F.round(agree, 5).alias("agree"))


@query(_ACROSS_SQL + " SELECT a.stream_id, b.stream_id AS peer, a.t, a.k, round(b.x - a.x, 4) AS lead_lag FROM v a JOIN v b ON a.venue = b.venue AND a.t = b.t AND a.k = b.k AND a.stream_id <> b.stream_id")
def ref_f07_lead_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Every peer's return less the own over six lookbacks. A venue has a pair once, so a time has at most seven rows a side."""
    rows = across(spark, sf)
    peers = rows.select(F.col("stream_id").alias("peer"), "venue", "t", "k", F.col("x").alias("y"))
    return rows.join(peers, ["venue", "t", "k"]).where("stream_id <> peer").select("stream_id", "peer", "t", "k", F.round(F.col("y") - F.col("x"), 4).alias("lead_lag"))


@query(BARS_SQL + """, r AS (SELECT stream_id, t, ln(close / lag(close) OVER (PARTITION BY stream_id ORDER BY t)) * 1e4 AS r FROM b)
SELECT stream_id, t, CASE WHEN count(r) OVER w >= 20 THEN round(stddev_samp(r) OVER w, 4) END AS comp60 FROM r WINDOW w AS (PARTITION BY stream_id ORDER BY t ROWS 59 PRECEDING)""")
def ref_f07_compression(spark: SparkSession, sf: str) -> DataFrame:
    """Deviation of the last 60 returns, of 20 at least."""
    r = minute_bars(spark, sf).withColumn("r", F.log(F.col("close") / F.lag("close").over(win())) * 1e4)
    return r.select("stream_id", "t", F.round(roll(F.stddev_samp("r"), "r", 60, least=20), 4).alias("comp60"))


_MICRO_WINDOWS = {w: f"(PARTITION BY stream_id ORDER BY t ROWS {w - 1} PRECEDING)" for w in {*T.MICRO_VOLS, *T.STRETCHES, *T.PLACES}}


def _places(feature: str) -> int:
    """Decimals of a feature; a stretch divides by a deviation, which is exact to fewer."""
    return 3 if feature.startswith("stretch") else 5


def _micro_sql() -> str:
    full = lambda fn, w, c: f"CASE WHEN count({c}) OVER {_MICRO_WINDOWS[w]} = {w} THEN {fn} OVER {_MICRO_WINDOWS[w]} END"
    decay = lambda span: f"pow({1 - 2 / (span + 1)}, a.i - b.i)"
    means = {f"imb_ema{w}": ("imb", w) for w in T.IMB_SPANS} | {f"micro_dev_ema{w}": ("dev", w) for w in T.DEV_SPANS} | {f"{c}_ema30": (c, 30) for c in ("spread", "nt", "tsz")}
    means |= {f"mid_ema{w}": ("mid", w) for w in sorted({*T.MEAN_SPANS, *T.STRETCHES})}
    f = {"imb": "imb"} | {k: k for k in means if not k.startswith("mid_")} | {"micro_dev": "dev", "spread": "spread", "nt": "nt", "tsz": "tsz"}
    f |= {"imb_acc": "imb_ema5 - imb_ema40", "imb_chg": f"imb - lag(imb, 3) {_W}", "imb_sgn_ac30": "CASE WHEN i >= 30 THEN avg(s * s0) OVER (PARTITION BY stream_id ORDER BY t ROWS 29 PRECEDING) END", "imb_sameside30": "CASE WHEN i >= 29 THEN avg(coalesce(s = s0, false)::INT) OVER (PARTITION BY stream_id ORDER BY t ROWS 29 PRECEDING) END"}
    f |= {"imb_runlen": "least(50, row_number() OVER (PARTITION BY stream_id, isl ORDER BY t)) * s"} | {f"micro_mom{w}": f"micro / lag(micro, {w}) {_W} - 1" for w in (15, 60)}
    f |= {f"ret{w}": f"mid / lag(mid, {w}) {_W} - 1" for w in T.MICRO_RETURNS} | {f"rv{w}": full("stddev_samp(r)", w, "r") for w in T.MICRO_VOLS} | {f"emadist{w}": f"mid / mid_ema{w} - 1" for w in T.MEAN_SPANS}
    f |= {f"stretch{w}": f"(mid / mid_ema{w} - 1) / ({full('stddev_samp(r)', w, 'r')} * sqrt({w}) + 1e-6)" for w in T.STRETCHES}
    for w in T.PLACES:
        f |= {f"rangepos{w}": f"(mid - {full('min(mid)', w, 'mid')}) / ({full('max(mid)', w, 'mid')} - {full('min(mid)', w, 'mid')} + 1e-9)", f"bbw{w}": f"{full('stddev_samp(r)', w, 'r')} * sqrt({w})"}
    f |= {"rel_ratio": f"{f['bbw300']} / ({f['bbw1800']} + 1e-9)", "rel_ratio2": f"{f['bbw900']} / ({f['bbw3600']} + 1e-9)", "hsin": "sin(2 * pi() * (t // 3600 % 24) / 24)", "hcos": "cos(2 * pi() * (t // 3600 % 24) / 24)", "dow": "(t // 86400 + 3) % 7"}
    return TICKS_SQL + f""", q AS (SELECT stream_id, epoch, bid, ask, tick_id % 97 + 1 AS bs, tick_id % 89 + 1 AS az FROM u WHERE bid IS NOT NULL AND ask IS NOT NULL),
b AS (SELECT stream_id, epoch // 10 * 10 AS t, arg_max((bid + ask) / 2, epoch) AS mid, arg_max((bid * az + ask * bs) / (bs + az), epoch) AS micro, avg((bs - az) / (bs + az)) AS imb, avg(ask - bid) AS spread, count(*)::DOUBLE AS nt, avg(bs + az) AS tsz FROM q GROUP BY ALL),
x AS (SELECT *, row_number() {_W} - 1 AS i, mid / lag(mid) {_W} - 1 AS r, (micro - mid) / mid * 1e4 AS dev, sign(round(imb, 9)) AS s, lag(sign(round(imb, 9))) {_W} AS s0 FROM b),
e AS (SELECT a.stream_id, a.t, {", ".join(f"sum({decay(w)} * b.{c}) / sum({decay(w)}) AS {k}" for k, (c, w) in means.items())} FROM x a JOIN x b ON a.stream_id = b.stream_id AND b.i <= a.i GROUP BY ALL),
y AS (SELECT x.*, e.* EXCLUDE (stream_id, t), sum(coalesce(s <> s0, true)::INT) OVER (PARTITION BY x.stream_id ORDER BY x.t ROWS UNBOUNDED PRECEDING) AS isl FROM x JOIN e USING (stream_id, t))
SELECT stream_id, t, """ + ", ".join(f"round(({f[c]})::DOUBLE, {_places(c)}) AS {c}" for c in T.MICROSTRUCTURE) + " FROM y"


@query(_micro_sql())
def ref_f12_all_microstructure(spark: SparkSession, sf: str) -> DataFrame:
    """The whole tick microstructure set on ten-second quote bars with made-up sizes."""
    bs, az = F.col("tick_id") % 97 + 1, F.col("tick_id") % 89 + 1
    q = ticks(spark, sf).where("bid IS NOT NULL AND ask IS NOT NULL").withColumns({"bs": bs, "az": az})
    b = q.groupBy("stream_id", (F.floor(F.col("epoch") / 10) * 10).alias("t")).agg(
        F.max_by((F.col("bid") + F.col("ask")) / 2, "epoch").alias("mid"), F.max_by((F.col("bid") * F.col("az") + F.col("ask") * F.col("bs")) / (F.col("bs") + F.col("az")), "epoch").alias("micro"),
        F.avg((F.col("bs") - F.col("az")) / (F.col("bs") + F.col("az"))).alias("imb"), F.avg(F.col("ask") - F.col("bid")).alias("spread"), F.count("*").alias("nt"), F.avg(F.col("bs") + F.col("az")).alias("tsz"),
    )
    b = b.withColumn("at", F.col("t"))
    made = frames_by_rows(b, "stream_id", "t", ["at", "mid", "micro", "imb", "spread", "nt", "tsz"], T.MICRO_WARMUP, T.MICRO_WARMUP, lambda c: T.microstructure_set(c | {"t": c["at"]}), T.MICROSTRUCTURE)
    return made.select("stream_id", "t", *[F.round(c, _places(c)).alias(c) for c in T.MICROSTRUCTURE])
