"""Queries on blocks in full width: peers, factors, order flow, days, patterns, quote paths, equity, randomness, calibration."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import asof as A
from lodestream.operators import policies as P
from lodestream.operators import rolling as R
from lodestream.operators import selection as X
from lodestream.operators.bars import signed_flow
from lodestream.operators.scan import carry_last, numbered, running_total, with_previous
from lodestream.plans.base import BARS_SQL, SCORED_SQL, TICKS_SQL, Registry, minute_bars, scored, ticks
from lodestream.plans.blocks import _ACROSS_SQL, CLOCKS, _ema, across, technical, technical_sql
from lodestream.plans.evaluation import _WIN_SQL
from lodestream.plans.evaluation import win as won
from lodestream.plans.features import roll
from lodestream.plans.joins import decisions
from lodestream.plans.windows import KEY, returns, rolled, win
from lodestream.runtime import written

query = Registry()
_W = "OVER (PARTITION BY stream_id ORDER BY t)"
#: The columns of a peer, by clock.
PEER_COLUMNS = {"1m": ["ret_1", "ret_3", "bb_pctb", "dist_ema20", "autocorr_10"], "5m": ["ret_1", "ret_3", "bb_pctb", "rv_24"], "15m": ["ret_1"]}
_PEER = [f"f{c}_{x}" for c, names in PEER_COLUMNS.items() for x in names]


@query(TICKS_SQL + ", " + ", ".join(technical_sql(CLOCKS[c], c) for c in PEER_COLUMNS)
       + "".join(f", l_{c} AS (SELECT stream_id, t, {', '.join(f'lag({x}) {_W} AS {x}' for x in PEER_COLUMNS[c])} FROM f_{c})" for c in ("5m", "15m"))
       + ", base AS (SELECT f_1m.stream_id, split_part(f_1m.stream_id, ':', 2) AS venue, f_1m.t, " + ", ".join(f"{'f' if c == '1m' else 'l'}_{c}.{x} AS f{c}_{x}" for c, names in PEER_COLUMNS.items() for x in names) + " FROM f_1m "
       + " ".join(f"JOIN l_{c} ON f_1m.stream_id = l_{c}.stream_id AND l_{c}.t = f_1m.t // {CLOCKS[c]} * {CLOCKS[c]}" for c in ("5m", "15m")) + ")"
       + """, ids AS (SELECT DISTINCT stream_id, venue FROM base), asked AS (SELECT a.stream_id, i.stream_id AS peer, a.t FROM base a JOIN ids i ON a.venue = i.venue AND a.stream_id <> i.stream_id),
m AS (SELECT q.stream_id, q.peer, q.t, b.t AS on_, """ + ", ".join(_PEER) + """ FROM asked q ASOF JOIN base b ON b.stream_id = q.peer AND q.t >= b.t),
k AS (SELECT *, row_number() OVER (PARTITION BY stream_id, peer, on_, t <> on_ ORDER BY t) AS k FROM m) SELECT stream_id, peer, t, """ + ", ".join(f"round({c}, 7) AS {c}" for c in _PEER) + " FROM k WHERE t = on_ OR k <= 3")  # fmt: skip
def ref_f05_all_peers(spark: SparkSession, sf: str) -> DataFrame:
    """Ten columns of each peer of the venue on the own clock, each row of a peer serving three further rows at most."""
    bars = written(minute_bars(spark, sf), "bars")  # three clocks read them
    wide = technical(bars).select("stream_id", "t", *[F.col(x).alias(f"f1m_{x}") for x in PEER_COLUMNS["1m"]])
    for c in ("5m", "15m"):
        done = technical(bars, CLOCKS[c]).select("stream_id", F.col("t").alias("slow"), *[F.lag(x).over(win()).alias(f"f{c}_{x}") for x in PEER_COLUMNS[c]])
        wide = wide.withColumn("slow", F.floor(F.col("t") / CLOCKS[c]) * CLOCKS[c]).join(done, ["stream_id", "slow"]).drop("slow")
    base = written(wide.withColumn("venue", F.split_part("stream_id", F.lit(":"), F.lit(2))), "base")
    ids = base.select(F.col("stream_id").alias("peer"), "venue").distinct()  # one row a stream, a venue has a pair once
    asked = base.select("stream_id", "venue", "t").join(ids, "venue").where("stream_id <> peer").select("stream_id", "peer", "t")
    given = base.select(F.col("stream_id").alias("peer"), "t", F.col("t").alias("seq"), *_PEER)
    j = A.fill_limited(A.asof(asked, given, ["peer"], "t", "seq", _PEER), ["stream_id", "peer"], "t", 3).where("match IS NOT NULL")
    return j.select("stream_id", "peer", "t", *[F.round(f"match.{c}", 7).alias(c) for c in _PEER])


_FACTOR_SQL = _ACROSS_SQL + """, p AS (SELECT stream_id, venue, t, x FROM v WHERE k = 1), c AS (SELECT stream_id, t, x, avg(x) OVER y AS basket, CASE WHEN count(*) OVER y > 1 THEN stddev_samp(x) OVER y ELSE 0 END AS disp FROM p WINDOW y AS (PARTITION BY venue, t)),
r AS (SELECT *, x - basket AS resid FROM c), s AS (SELECT *, """ + ", ".join(f"{rolled('sum(resid)', 'resid', w)} AS resid_{w}" for w in (5, 15, 30, 60)) + " FROM r)"  # fmt: skip


@query(_FACTOR_SQL + " SELECT stream_id, t, " + ", ".join(f"round({rolled('sum(basket)', 'basket', w)}, 4) AS basket_{w}, round(resid_{w}, 4) AS resid_{w}, round((resid_{w} - {rolled(f'avg(resid_{w})', f'resid_{w}', 60)}) / ({rolled(f'stddev_samp(resid_{w})', f'resid_{w}', 60)} + 1e-3), 3) AS resid_z_{w}" for w in (5, 15, 30, 60))
       + ", " + ", ".join(f"round({rolled('avg(disp)', 'disp', w)}, 4) AS disp_{w}, round({rolled('sum(basket)', 'basket', w)} - {rolled('sum(x)', 'x', w)}, 4) AS gap_{w}" for w in (15, 30)) + " FROM s")
def ref_f08_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Venue basket, residual sums and their z-scores, dispersion and gap over several lengths; z over 60 rows, as the streams are short."""
    y = Window.partitionBy("venue", "t")  # seven rows at most
    c = across(spark, sf).where("k = 1").withColumns({"basket": F.avg("x").over(y), "disp": F.when(F.count("*").over(y) > 1, F.stddev_samp("x").over(y)).otherwise(0.0)})
    s = c.withColumn("resid", F.col("x") - F.col("basket"))
    s = s.withColumns({f"resid_{w}": roll(F.sum("resid"), "resid", w) for w in (5, 15, 30, 60)})
    out: dict[str, Column] = {}
    for w in (5, 15, 30, 60):
        r = f"resid_{w}"
        z = (F.col(r) - roll(F.avg(r), r, 60)) / (roll(F.stddev_samp(r), r, 60) + 1e-3)
        out |= {f"basket_{w}": F.round(roll(F.sum("basket"), "basket", w), 4), r: F.round(r, 4), f"resid_z_{w}": F.round(z, 3)}
    for w in (15, 30):
        out |= {f"disp_{w}": F.round(roll(F.avg("disp"), "disp", w), 4), f"gap_{w}": F.round(roll(F.sum("basket"), "basket", w) - roll(F.sum("x"), "x", w), 4)}
    return s.select("stream_id", "t", *[v.alias(k) for k, v in out.items()])


_OF = (1, 3, 5, 10, 15, 30)


@query(TICKS_SQL + """, d AS (SELECT *, sign(quote - lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch)) AS s FROM u), c AS (SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS f FROM d),
m AS (SELECT stream_id, epoch // 60 * 60 AS t, sum(f)::DOUBLE AS ofi, sum(abs(f))::DOUBLE AS vol, avg((f > 0)::INT) AS uptick, arg_max(quote, epoch) AS close FROM c GROUP BY ALL),
n AS (SELECT *, ofi / (vol + 1e-9) AS norm, abs(close / lag(close) OVER (PARTITION BY stream_id ORDER BY t) - 1) * 1e4 AS absret FROM m) SELECT stream_id, t, """
       + ", ".join(f"round({rolled('avg(norm)', 'norm', k)}, 6) AS norm_{k}, round({rolled('sum(ofi)', 'ofi', k)} / ({rolled('sum(vol)', 'vol', k)} + 1e-9), 6) AS sum_{k}" for k in _OF)
       + ", " + ", ".join(f"round({rolled('avg(uptick)', 'uptick', k)} - 0.5, 6) AS uptick_{k}, round({rolled('sum(absret)', 'absret', k)} / ({rolled('sum(vol)', 'vol', k)} + 1e-9), 5) AS kyle_{k}" for k in (5, 15))
       + f", round({rolled('avg(norm)', 'norm', 3)} - {rolled('avg(norm)', 'norm', 15)}, 6) AS accel, (sign(round({rolled('avg(norm)', 'norm', 5)}, 9)) * sign(round({rolled('avg(norm)', 'norm', 15)}, 9)))::INT AS persist FROM n")
def ref_f10_order_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised and summed flow over six lengths, upticks, price impact, acceleration and persistence."""
    m = signed_flow(ticks(spark, sf), KEY, 60).join(minute_bars(spark, sf).select("stream_id", "t", "close", "n"), ["stream_id", "t"])
    n = m.withColumns({"norm": F.col("flow") / (F.col("moves") + 1e-9), "uptick": (F.col("flow") + F.col("moves")) / 2 / F.col("n"), "absret": F.abs(F.col("close") / F.lag("close").over(win()) - 1) * 1e4})
    mean = lambda c, k: roll(F.avg(c), c, k)
    total = lambda c, k: roll(F.sum(c), c, k)
    out: dict[str, Column] = {}
    for k in _OF:
        out |= {f"norm_{k}": F.round(mean("norm", k), 6), f"sum_{k}": F.round(total("flow", k) / (total("moves", k) + 1e-9), 6)}
    for k in (5, 15):
        out |= {f"uptick_{k}": F.round(mean("uptick", k) - 0.5, 6), f"kyle_{k}": F.round(total("absret", k) / (total("moves", k) + 1e-9), 5)}
    persist = F.signum(F.round(mean("norm", 5), 9)) * F.signum(F.round(mean("norm", 15), 9))
    return n.select("stream_id", "t", *[v.alias(k) for k, v in out.items()], F.round(mean("norm", 3) - mean("norm", 15), 6).alias("accel"), persist.cast("int").alias("persist"))


_DAILY = [*[f"dret_{k}" for k in (1, 2, 3, 5, 10)], *[f"dist_dema{n}" for n in (5, 10, 20)], *[f"rangepos_{n}" for n in (10, 20)], "rv_10", "gap"]


@query(BARS_SQL + """, d AS (SELECT stream_id, t // 86400 * 86400 AS t, arg_min(close, t) AS o, max(close) AS h, min(close) AS l, arg_max(close, t) AS c FROM b GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) - 1 AS i, c / lag(c) OVER (PARTITION BY stream_id ORDER BY t) - 1 AS r FROM d), """
       + ", ".join(_ema("c", "x", 2 / (n + 1), f"e{n}") for n in (5, 10, 20)) + ", f AS (SELECT x.stream_id, x.t, " + ", ".join(f"c / lag(c, {k}) OVER w - 1 AS dret_{k}" for k in (1, 2, 3, 5, 10)) + ", " + ", ".join(f"c / e{n} - 1 AS dist_dema{n}" for n in (5, 10, 20)) + ", "
       + ", ".join(f"CASE WHEN i >= {n - 1} THEN (c - min(l) OVER (PARTITION BY x.stream_id ORDER BY x.t ROWS {n - 1} PRECEDING)) / (max(h) OVER (PARTITION BY x.stream_id ORDER BY x.t ROWS {n - 1} PRECEDING) - min(l) OVER (PARTITION BY x.stream_id ORDER BY x.t ROWS {n - 1} PRECEDING) + 1e-9) END AS rangepos_{n}" for n in (10, 20))
       + """, CASE WHEN i >= 10 THEN stddev_samp(r) OVER (PARTITION BY x.stream_id ORDER BY x.t ROWS 9 PRECEDING) END AS rv_10, o / lag(c) OVER w - 1 AS gap FROM x JOIN e5 USING (stream_id, t) JOIN e10 USING (stream_id, t) JOIN e20 USING (stream_id, t) WINDOW w AS (PARTITION BY x.stream_id ORDER BY x.t)),
s AS (SELECT stream_id, t, """ + ", ".join(f"lag({c}) OVER (PARTITION BY stream_id ORDER BY t) AS {c}" for c in _DAILY) + """ FROM f),
g AS (SELECT stream_id, t, close, max(close) OVER w AS hi, min(close) OVER w AS lo, first_value(close) OVER w AS o FROM b WINDOW w AS (PARTITION BY stream_id, t // 86400 ORDER BY t))
SELECT g.stream_id, g.t, round((close - lo) / (hi - lo + 1e-9), 6) AS intraday_pos, round(close / o - 1, 7) AS intraday_ret, (g.t % 86400 // 60)::INT AS min_of_day, isodow(to_timestamp(g.t)::TIMESTAMP)::INT - 1 AS dow, """
       + ", ".join(f"round({c}, 6) AS {c}" for c in _DAILY) + " FROM g JOIN s ON s.stream_id = g.stream_id AND s.t = g.t // 86400 * 86400")
def ref_f13_day_context(spark: SparkSession, sf: str) -> DataFrame:
    """Features of completed days, and of the running day so far."""
    b = minute_bars(spark, sf).select("stream_id", "t", "close")
    day = F.floor(F.col("t") / 86_400) * 86_400
    d = b.groupBy("stream_id", day.alias("day")).agg(F.min_by("close", "t").alias("o"), F.max("close").alias("h"), F.min("close").alias("l"), F.max_by("close", "t").alias("c")).withColumnRenamed("day", "t")
    d = R.ewm_set(d, KEY, "t", [(F.col("c"), 2 / (n + 1), f"e{n}") for n in (5, 10, 20)]).withColumn("r", F.col("c") / F.lag("c").over(win()) - 1)
    c = F.col("c")
    f = {f"dret_{k}": c / F.lag("c", k).over(win()) - 1 for k in (1, 2, 3, 5, 10)} | {f"dist_dema{n}": c / F.col(f"e{n}") - 1 for n in (5, 10, 20)}
    f |= {f"rangepos_{n}": (c - roll(F.min("l"), "l", n)) / (roll(F.max("h"), "h", n) - roll(F.min("l"), "l", n) + 1e-9) for n in (10, 20)}
    f |= {"rv_10": roll(F.stddev_samp("r"), "r", 10), "gap": F.col("o") / F.lag("c").over(win()) - 1}
    past = d.withColumns(f).select("stream_id", F.col("t").alias("day"), *[F.lag(x).over(win()).alias(x) for x in _DAILY])
    w = Window.partitionBy("stream_id", "day").orderBy("t")
    g = b.withColumn("day", day).withColumns({"hi": F.max("close").over(w), "lo": F.min("close").over(w), "o": F.first("close").over(w)}).join(past, ["stream_id", "day"])
    return g.select(
        "stream_id", "t", F.round((F.col("close") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-9), 6).alias("intraday_pos"), F.round(F.col("close") / F.col("o") - 1, 7).alias("intraday_ret"),
        F.floor(F.col("t") % 86_400 / 60).cast("int").alias("min_of_day"), F.weekday(F.timestamp_seconds("t")).alias("dow"), *[F.round(x, 6).alias(x) for x in _DAILY],
    )


@query(TICKS_SQL + """, d AS (SELECT *, sign(quote - lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch)) AS s FROM u), c AS (SELECT stream_id, epoch // 60 * 60 AS t, count(*) FILTER (s > 0) AS up, count(*) FILTER (s < 0) AS dn FROM d GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) - 1 AS i FROM c), """
       + _ema("up", "x", 0.1, "eu") + ", " + _ema("dn", "x", 0.1, "ed") + " SELECT stream_id, t, round((eu - ed) / (eu + ed + 1e-6), 6) AS imbalance FROM eu JOIN ed USING (stream_id, t)")
def ref_f36_ewm_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """Imbalance of exponential means of up and down ticks per minute."""
    d = with_previous(ticks(spark, sf), KEY, "epoch", [F.col("epoch")], ["quote"]).withColumn("s", F.signum(F.col("quote") - F.col("prev.quote")))
    c = d.groupBy("stream_id", (F.floor(F.col("epoch") / 60) * 60).alias("t")).agg(F.count_if(F.col("s") > 0).alias("up"), F.count_if(F.col("s") < 0).alias("dn"))
    e = R.ewm_set(c, KEY, "t", [(F.col("up").cast("double"), 0.1, "eu"), (F.col("dn").cast("double"), 0.1, "ed")])
    return e.select("stream_id", "t", F.round((F.col("eu") - F.col("ed")) / (F.col("eu") + F.col("ed") + 1e-6), 6).alias("imbalance"))


_PATTERN_SQL = TICKS_SQL + ", " + technical_sql(60, "1m") + """, b AS (SELECT stream_id, epoch // 60 * 60 AS t, arg_min(quote, epoch) AS open, max(quote) AS high, min(quote) AS low, arg_max(quote, epoch) AS close FROM u GROUP BY ALL),
a AS (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, high - low AS rng, floor(close / 0.005 + 0.5) * 0.005 AS level, row_number() OVER w - 1 AS i, lag(close, 1) OVER w AS c1, lag(close, 2) OVER w AS c2, lag(close, 3) OVER w AS c3 FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY t)),
k AS (SELECT *, CASE WHEN ph IS NULL THEN 0 WHEN high > ph AND low < pl THEN 3 WHEN high <= ph AND low >= pl THEN 1 ELSE 2 END AS kind, i >= 6 AND rng = min(rng) OVER (PARTITION BY stream_id ORDER BY t ROWS 6 PRECEDING) AS nr7, CASE WHEN i >= 49 THEN avg(close) OVER (PARTITION BY stream_id ORDER BY t ROWS 49 PRECEDING) END AS sma FROM a),
p AS (SELECT *, lag(kind) OVER w AS k1, lag(kind, 2) OVER w AS k2, coalesce(lag(nr7) OVER w, false) AS was7, lag(open) OVER w AS o1, abs(close - level) < 0.00005 AS round FROM k WINDOW w AS (PARTITION BY stream_id ORDER BY t))"""


@query(_PATTERN_SQL + """ SELECT p.stream_id, p.t, CASE WHEN k2 = 3 AND k1 = 2 AND c1 > o1 AND low < pl THEN -1 WHEN k2 = 3 AND k1 = 2 AND c1 < o1 AND high > ph THEN 1 ELSE 0 END::INT AS strat_322,
CASE WHEN k2 = 3 AND k1 = 1 AND low < pl THEN -1 WHEN k2 = 3 AND k1 = 1 AND high > ph THEN 1 ELSE 0 END::INT AS strat_312,
CASE WHEN round AND least(c1, c2, c3) > level AND i >= 3 THEN 1 WHEN round AND greatest(c1, c2, c3) < level AND i >= 3 THEN -1 ELSE 0 END::INT AS round_rev,
CASE WHEN round AND rsi < -1e-9 AND close < open THEN 1 WHEN round AND rsi > 1e-9 AND close > open THEN -1 ELSE 0 END::INT AS round_mom,
CASE WHEN was7 AND low < pl AND close < sma - 1e-9 THEN -1 WHEN was7 AND high > ph AND close > sma + 1e-9 THEN 1 ELSE 0 END::INT AS nr7_break FROM p JOIN f_1m USING (stream_id, t)""")
def ref_f39_all_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Bar patterns 3-2-2 and 3-1-2, reversal and momentum at round numbers, and the break after the narrowest of seven bars."""
    bars = minute_bars(spark, sf).select("stream_id", "t", "open", "high", "low", "close")
    rsi = technical(minute_bars(spark, sf)).select("stream_id", "t", "rsi")
    lag = lambda c, k=1: F.lag(c, k).over(win())
    a = bars.withColumns({"ph": lag("high"), "pl": lag("low"), "rng": F.col("high") - F.col("low"), "level": F.floor(F.col("close") / 0.005 + 0.5) * 0.005, "c1": lag("close"), "c2": lag("close", 2), "c3": lag("close", 3), "o1": lag("open")})
    h, l, c = F.col("high"), F.col("low"), F.col("close")  # noqa: E741
    kind = F.when(F.col("ph").isNull(), 0).when((h > F.col("ph")) & (l < F.col("pl")), 3).when((h <= F.col("ph")) & (l >= F.col("pl")), 1).otherwise(2)
    k = a.withColumns({"kind": kind, "nr7": F.coalesce(F.col("rng") == roll(F.min("rng"), "rng", 7), F.lit(False)), "sma": roll(F.avg("close"), "close", 50), "round": F.abs(c - F.col("level")) < 0.00005})
    p = k.withColumns({"k1": lag("kind"), "k2": lag("kind", 2), "was7": F.coalesce(lag("nr7"), F.lit(False))}).join(rsi, ["stream_id", "t"])
    either = lambda down, up: F.when(down, -1).when(up, 1).otherwise(0)
    after = lambda k1: (F.col("k2") == 3) & (F.col("k1") == k1)
    breaks = (l < F.col("pl"), h > F.col("ph"))
    three = [F.col("c1"), F.col("c2"), F.col("c3")]
    known = F.col("c3").isNotNull()
    return p.select(
        "stream_id", "t", either(after(2) & (F.col("c1") > F.col("o1")) & breaks[0], after(2) & (F.col("c1") < F.col("o1")) & breaks[1]).alias("strat_322"),
        either(after(1) & breaks[0], after(1) & breaks[1]).alias("strat_312"),
        either(F.col("round") & known & (F.greatest(*three) < F.col("level")), F.col("round") & known & (F.least(*three) > F.col("level"))).alias("round_rev"),
        either(F.col("round") & (F.col("rsi") > 1e-9) & (c > F.col("open")), F.col("round") & (F.col("rsi") < -1e-9) & (c < F.col("open"))).alias("round_mom"),
        either(F.col("was7") & breaks[0] & (c < F.col("sma") - 1e-9), F.col("was7") & breaks[1] & (c > F.col("sma") + 1e-9)).alias("nr7_break"),
    )


#: Seconds of the returns and of the volatilities of a quote's path.
_BACK, _VOL = (30, 60, 300, 900), (60, 300, 900)


@query(TICKS_SQL + """, g AS (SELECT stream_id, epoch, ln(quote) AS lp, epoch - lag(epoch) OVER w AS gap, ln(quote) - lag(ln(quote)) OVER w AS d FROM u WINDOW w AS (PARTITION BY stream_id ORDER BY epoch)), r AS (SELECT *, CASE WHEN gap > 60 OR d IS NULL THEN 0 ELSE d END AS r1 FROM g),
c AS (SELECT stream_id, epoch, lp, sum(r1 * r1) OVER w AS csq, sum((r1 <> 0)::INT) OVER w AS chg, row_number() OVER w AS i, """ + ", ".join(f"max(lp) OVER (PARTITION BY stream_id ORDER BY epoch RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS hi{w}, min(lp) OVER (PARTITION BY stream_id ORDER BY epoch RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS lo{w}" for w in (900, 3600))
       + """ FROM r WINDOW w AS (PARTITION BY stream_id ORDER BY epoch ROWS UNBOUNDED PRECEDING)), n AS (SELECT * FROM c WHERE i = 1), q0 AS (SELECT d.decision_id, d.stream_id, d.decision_close_epoch AS t, c.* EXCLUDE (stream_id) FROM decisions d ASOF JOIN c ON d.stream_id = c.stream_id AND d.decision_close_epoch >= c.epoch), """
       + ", ".join(f"q{w} AS (SELECT q0.decision_id, coalesce(c.lp, n.lp) AS lp{w}, coalesce(c.csq, n.csq) AS csq{w}, coalesce(c.chg, n.chg) AS chg{w}, coalesce(c.i, n.i) AS i{w} FROM q0 JOIN n ON n.stream_id = q0.stream_id ASOF LEFT JOIN c ON q0.stream_id = c.stream_id AND q0.t - {w} >= c.epoch)" for w in _BACK)
       + " SELECT decision_id, t - epoch AS tick_age, " + ", ".join(f"round((lp - lp{w}) * 1e4, 4) AS ret_{w}" for w in _BACK) + ", " + ", ".join(f"round(sqrt(greatest(csq - csq{w}, 0)) * 1e4, 3) AS rv_{w}, (chg - chg{w})::BIGINT AS nchg_{w}, (i - i{w})::BIGINT AS n_{w}" for w in _VOL)
       + ", " + ", ".join(f"round((lp - lo{w}) / (hi{w} - lo{w} + 1e-9), 5) AS pos_{w}" for w in (900, 3600)) + " FROM q0 " + " ".join(f"JOIN q{w} USING (decision_id)" for w in _BACK))
def ref_f40_all_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Before each decision: age, returns, volatilities, changes and ticks over several spans, and the place in the range. Sums since the first tick are looked up at both ends."""
    u = ticks(spark, sf).select("stream_id", "epoch", "tick_id", F.log("quote").alias("lp"))
    p = with_previous(u, KEY, "epoch", [F.col("epoch")], ["epoch", "lp"])
    r1 = F.when((F.col("epoch") - F.col("prev.epoch") > 60) | F.col("prev").isNull(), 0.0).otherwise(F.col("lp") - F.col("prev.lp"))
    r = p.withColumn("r1", r1).drop("prev")
    hour = F.floor(F.col("epoch") / 3600)
    for value, out in ((F.col("r1") * F.col("r1"), "csq"), ((F.col("r1") != 0).cast("bigint"), "chg"), (F.lit(1), "i")):
        r = running_total(r, value, [F.col("epoch")], hour, KEY, out)
    # a chunk also reads the hour before it
    chunks = r.withColumn("chunk", F.explode(F.sequence(hour, F.floor((F.col("epoch") + 3599) / 3600))))
    span = lambda w: Window.partitionBy("stream_id", "chunk").orderBy("epoch").rangeBetween(1 - w, 0)
    made = {f"{n}{w}": f("lp").over(span(w)) for w in (900, 3600) for n, f in (("hi", F.max), ("lo", F.min))}
    c = written(chunks.withColumns(made).where(F.col("chunk") == hour).drop("chunk", "r1"), "paths")
    sums = ["lp", "csq", "chg", "i"]
    first = c.where("i = 1").select("stream_id", F.struct(*sums).alias("begin"))  # one row a stream
    q = A.asof(decisions(spark, sf), c, KEY, "epoch", "tick_id", [*sums, *made], match="now").where("now IS NOT NULL").join(first, "stream_id")
    q = q.withColumnRenamed("epoch", "at")
    for w in _BACK:
        q = A.asof(q.withColumn("epoch", F.col("at") - w), c, KEY, "epoch", "tick_id", sums, match=f"b{w}").drop("epoch")
    now = lambda x: F.col(f"now.{x}")
    then = lambda x, w: F.coalesce(F.col(f"b{w}.{x}"), F.col(f"begin.{x}"))
    out = {"tick_age": F.col("at") - F.col("now.on")} | {f"ret_{w}": F.round((now("lp") - then("lp", w)) * 1e4, 4) for w in _BACK}
    for w in _VOL:
        out |= {f"rv_{w}": F.round(F.sqrt(F.greatest(now("csq") - then("csq", w), F.lit(0.0))) * 1e4, 3), f"nchg_{w}": now("chg") - then("chg", w), f"n_{w}": now("i") - then("i", w)}
    out |= {f"pos_{w}": F.round((now("lp") - now(f"lo{w}")) / (now(f"hi{w}") - now(f"lo{w}") + 1e-9), 5) for w in (900, 3600)}
    return q.select("decision_id", *[v.alias(k) for k, v in out.items()])


#: Made-up payout and fixed values of staking: trailing rows, levels at which trading stops and starts, stake.
_PAY, _KILL_ROWS, _STOP, _START, _STAKE = 0.85, 50, 0.46, 0.5, 0.01
_STAKED_SQL = SCORED_SQL + f""", o AS (SELECT pair, ts, row_id, {_WIN_SQL} AS w, row_number() OVER x AS k, avg({_WIN_SQL}) OVER (PARTITION BY pair ORDER BY ts, row_id ROWS BETWEEN {_KILL_ROWS} PRECEDING AND 1 PRECEDING) AS m FROM s WINDOW x AS (PARTITION BY pair ORDER BY ts, row_id)),
e AS (SELECT *, CASE WHEN k <= {_KILL_ROWS} THEN NULL WHEN round(m, 9) < {_STOP} THEN 0 WHEN round(m, 9) >= {_START} THEN 1 END AS ev FROM o), a AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY pair ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS active FROM e),
g AS (SELECT *, active = 0 AND coalesce(lag(active) OVER (PARTITION BY pair ORDER BY k), 1) = 1 AS killed, CASE WHEN active = 1 THEN ln(CASE WHEN w = 1 THEN {1 + _STAKE * _PAY} ELSE {1 - _STAKE} END) ELSE 0 END AS g, sum(w) OVER (PARTITION BY pair ORDER BY k) AS isl FROM a),
h AS (SELECT *, sum(g) OVER (PARTITION BY pair ORDER BY k) AS le FROM g), d AS (SELECT *, greatest(max(le) OVER (PARTITION BY pair ORDER BY k), 0) - le AS dd FROM h), st AS (SELECT pair, max(n) AS streak FROM (SELECT pair, isl, count(*) FILTER (w = 0) AS n FROM g GROUP BY ALL) GROUP BY 1)"""


@query(_STAKED_SQL + f""" SELECT pair, round(greatest(0, (avg(w) * {1 + _PAY} - 1) / {_PAY}), 6) AS kelly, round(exp(arg_max(le, k)), 6) AS equity, round(1 - exp(-max(dd)), 6) AS max_drawdown, any_value(streak) AS loss_streak, count(*) FILTER (killed) AS kills, count(*) FILTER (active = 0) AS flat FROM d JOIN st USING (pair) GROUP BY pair""")
def ref_e21_staking(spark: SparkSession, sf: str) -> DataFrame:
    """Kelly fraction, equity and drawdown of a fixed stake under a kill switch on the trailing win rate, and the longest run of losses."""
    day, order, key = F.floor(F.col("ts") / 86_400), [F.col("ts"), F.col("row_id")], ["pair"]
    o = numbered(scored(spark, sf).withColumn("w", won().cast("int")), order, day, key, "k")
    o = running_total(o, F.col("w"), order, day, key, "wins")
    # the wins up to a row's trailing start are those at the row so many places before: an equi-join, no window over a key
    back = o.select("pair", (F.col("k") + _KILL_ROWS + 1).alias("k"), F.col("wins").alias("then"))
    m = F.round((F.col("wins") - F.col("w") - F.coalesce("then", F.lit(0))) / _KILL_ROWS, 9)
    e = o.join(back, ["pair", "k"], "left").withColumn("ev", F.when(F.col("k") <= _KILL_ROWS, None).when(m < _STOP, 0).when(m >= _START, 1))
    a = carry_last(e, key, "ts", order, F.col("ev"), "active", 86_400).withColumn("active", F.coalesce("active", F.lit(1)))
    a = with_previous(a, key, "ts", order, ["active"], chunk_s=86_400)
    g = a.withColumns({"killed": (F.col("active") == 0) & (F.coalesce("prev.active", F.lit(1)) == 1), "g": F.when(F.col("active") == 1, F.when(F.col("w") == 1, math.log(1 + _STAKE * _PAY)).otherwise(math.log(1 - _STAKE))).otherwise(0.0)}).drop("prev")
    h = written(running_total(g, F.col("g"), order, day, key, "le"), "equity")
    # running maximum: of the days before from one row a day, of the own day by a window
    tops = h.groupBy("pair", day.alias("day")).agg(F.max("le").alias("top"))
    before = tops.select("pair", "day", F.max("top").over(Window.partitionBy("pair").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.max("le").over(Window.partitionBy("pair", "day").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    d = h.withColumn("day", day).withColumn("own", own).join(before, ["pair", "day"])
    drawdown = F.greatest(F.col("own"), F.coalesce("before", F.lit(0.0)), F.lit(0.0)) - F.col("le")
    streak = h.groupBy("pair", "wins").agg(F.count_if(F.col("w") == 0).alias("n")).groupBy("pair").agg(F.max("n").alias("loss_streak"))
    out = d.groupBy("pair").agg(
        F.round(F.greatest(F.lit(0.0), (F.avg("w") * (1 + _PAY) - 1) / _PAY), 6).alias("kelly"), F.round(F.exp(F.max_by("le", "k")), 6).alias("equity"), F.round(1 - F.exp(-F.max(drawdown)), 6).alias("max_drawdown"),
        F.count_if("killed").alias("kills"), F.count_if(F.col("active") == 0).alias("flat"),
    )
    return out.join(streak, "pair")


_BITS_SQL = TICKS_SQL + """, q AS (SELECT stream_id, epoch, (quote > lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch))::INT AS b FROM u), c AS (SELECT stream_id, b, row_number() OVER (PARTITION BY stream_id ORDER BY epoch) - 1 AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM q WHERE b IS NOT NULL),
w AS (SELECT c.*, coalesce(lag(b, 1) OVER x, l1.b) AS b1, coalesce(lag(b, 2) OVER x, CASE WHEN i = 1 THEN l1.b ELSE l2.b END) AS b2, sum(2 * b - 1) OVER x AS walk FROM c LEFT JOIN (SELECT stream_id, b FROM c WHERE i = n - 1) l1 USING (stream_id) LEFT JOIN (SELECT stream_id, b FROM c WHERE i = n - 2) l2 USING (stream_id) WINDOW x AS (PARTITION BY stream_id ORDER BY i)),
p2 AS (SELECT stream_id, sum(m / n * ln(m / n)) AS phi2 FROM (SELECT stream_id, b1, b, n, count(*) AS m FROM w GROUP BY ALL) GROUP BY 1), p3 AS (SELECT stream_id, sum(m / n * ln(m / n)) AS phi3 FROM (SELECT stream_id, b2, b1, b, n, count(*) AS m FROM w GROUP BY ALL) GROUP BY 1)"""


@query(_BITS_SQL.replace("lag(b, 1) OVER x, l1.b", "lag(c.b, 1) OVER x, l1.b").replace("lag(b, 2) OVER x", "lag(c.b, 2) OVER x").replace("sum(2 * b - 1) OVER x", "sum(2 * c.b - 1) OVER x")
       + """ SELECT stream_id, any_value(n) AS n, round((sum((i > 0 AND b <> b1)::INT) + 1 - 2 * any_value(n) * avg(b) * (1 - avg(b))) / (2 * sqrt(2 * any_value(n)) * avg(b) * (1 - avg(b)) + 1e-9), 5) AS runs_z, round(max(abs(walk)) / sqrt(any_value(n)), 6) AS cusum, round(2 * any_value(n) * (ln(2) - (any_value(phi2) - any_value(phi3))), 3) AS apen_chi2 FROM w JOIN p2 USING (stream_id) JOIN p3 USING (stream_id) GROUP BY stream_id""")
def ref_e22_bit_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, cumulative sums and approximate entropy (patterns of two and three, around the end) of the up-move bits."""
    order, hour = [F.col("epoch")], F.floor(F.col("epoch") / 3600)
    b = with_previous(ticks(spark, sf), KEY, "epoch", order, ["quote"]).select("stream_id", "epoch", (F.col("quote") > F.col("prev.quote")).cast("int").alias("b")).where("b IS NOT NULL")
    c = numbered(b, order, hour, KEY, "i")
    c = with_previous(c, KEY, "epoch", order, ["b"], out="p1").withColumn("b1", F.col("p1.b"))
    c = with_previous(c, KEY, "epoch", order, ["b1"], out="p2").withColumn("b2", F.col("p2.b1"))
    c = written(running_total(c, 2 * F.col("b") - 1, order, hour, KEY, "walk").drop("p1", "p2"), "bits")
    ends = c.groupBy("stream_id").agg(F.count("*").alias("n"), F.max_by("b", "i").alias("l1"), F.max_by("b1", "i").alias("l2"))  # one row a stream
    w = c.join(ends, "stream_id").withColumns({"b1": F.coalesce("b1", "l1"), "b2": F.coalesce("b2", F.when(F.col("i") == 2, F.col("l1")).otherwise(F.col("l2")))})
    share = F.col("m") / F.col("n")

    def phi(columns: list[str], name: str) -> DataFrame:
        counts = w.groupBy("stream_id", *columns, "n").agg(F.count("*").alias("m"))
        return counts.groupBy("stream_id").agg(F.sum(share * F.log(share)).alias(name))

    n, mean = F.max("n"), F.avg("b")
    spread = mean * (1 - mean)
    made = w.groupBy("stream_id").agg(
        n.alias("n"), F.round((F.count_if((F.col("i") > 1) & (F.col("b") != F.col("b1"))) + 1 - 2 * n * spread) / (2 * F.sqrt(2 * n) * spread + 1e-9), 5).alias("runs_z"), F.round(F.max(F.abs("walk")) / F.sqrt(n), 6).alias("cusum"),
    )
    both = made.join(phi(["b1", "b"], "phi2"), "stream_id").join(phi(["b2", "b1", "b"], "phi3"), "stream_id")
    return both.select("stream_id", "n", "runs_z", "cusum", F.round(2 * F.col("n") * (math.log(2) - (F.col("phi2") - F.col("phi3"))), 3).alias("apen_chi2"))


_LAGS = range(1, 6)


@query(BARS_SQL + ", r AS (SELECT stream_id, t, (close / lag(close) OVER (PARTITION BY stream_id ORDER BY t) - 1) * 1e4 AS r FROM b), c AS (SELECT stream_id, t, r - avg(r) OVER (PARTITION BY stream_id) AS x, count(r) OVER (PARTITION BY stream_id) AS n FROM r WHERE r IS NOT NULL), l AS (SELECT *, " + ", ".join(f"lag(x, {k}) OVER (PARTITION BY stream_id ORDER BY t) AS x{k}" for k in _LAGS)
       + " FROM c), a AS (SELECT stream_id, any_value(n) AS n, " + ", ".join(f"sum(x * x{k}) / sum(x * x) AS rho{k}" for k in _LAGS) + " FROM l GROUP BY 1) SELECT stream_id, " + ", ".join(f"round(rho{k}, 5) AS rho{k}" for k in _LAGS) + ", round(n * (n + 2) * (" + " + ".join(f"rho{k} * rho{k} / (n - {k})" for k in _LAGS) + "), 3) AS ljung_box FROM a")
def ref_e22_ljung_box(spark: SparkSession, sf: str) -> DataFrame:
    """Autocorrelations of bar returns and their Ljung-Box statistic."""
    whole = Window.partitionBy("stream_id")
    c = returns(spark, sf).where("r IS NOT NULL").withColumns({"x": F.col("r") - F.avg("r").over(whole), "n": F.count("r").over(whole)})
    l = c.withColumns({f"x{k}": F.lag("x", k).over(win()) for k in _LAGS})  # noqa: E741
    a = l.groupBy("stream_id").agg(F.max("n").alias("n"), *[(F.sum(F.col("x") * F.col(f"x{k}")) / F.sum(F.col("x") * F.col("x"))).alias(f"rho{k}") for k in _LAGS])
    box = F.col("n") * (F.col("n") + 2) * sum((F.col(f"rho{k}") * F.col(f"rho{k}") / (F.col("n") - k) for k in _LAGS), F.lit(0.0))
    return a.select("stream_id", *[F.round(f"rho{k}", 5).alias(f"rho{k}") for k in _LAGS], F.round(box, 3).alias("ljung_box"))


#: The temperatures that are tried.
_TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)
_CALIBRATED_SQL = SCORED_SQL + """, h AS (SELECT pair, (min(ts) + max(ts)) // 2 AS mid FROM s GROUP BY 1), z AS (SELECT s.pair, y, ts < mid AS train, ln(least(greatest(p, 0.001), 0.999) / (1 - least(greatest(p, 0.001), 0.999))) AS z FROM s JOIN h USING (pair)),
t AS (SELECT z.*, tt, 1 / (1 + exp(-z / tt)) AS q FROM z, (SELECT unnest([""" + ", ".join(map(str, _TEMPERATURES)) + """]) AS tt)), c AS (SELECT pair, tt, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)) FILTER (train), 9) AS loss, avg((q - y) * (q - y)) FILTER (NOT train) AS brier FROM t GROUP BY ALL)"""


@query(_CALIBRATED_SQL + " SELECT pair, arg_min(tt, struct_pack(loss, tt))::DOUBLE AS temperature, round(min(loss), 6) AS train_loss, round(arg_min(brier, struct_pack(loss, tt)), 6) AS brier, round(max(brier) FILTER (tt = 1), 6) AS brier_before FROM c GROUP BY 1")
def ref_e10_temperature(spark: SparkSession, sf: str) -> DataFrame:
    """The temperature that fits the first half of each pair's time best, and the Brier score of the second half with and without it."""
    s = scored(spark, sf)
    h = s.groupBy("pair").agg(F.floor((F.min("ts") + F.max("ts")) / 2).alias("mid"))
    p, y = F.least(F.greatest("p", F.lit(0.001)), F.lit(0.999)), F.col("y")
    z = s.join(F.broadcast(h), "pair").select("pair", "y", (F.col("ts") < F.col("mid")).alias("train"), F.log(p / (1 - p)).alias("z"))  # seven pairs
    t = z.withColumn("tt", F.explode(F.array(*map(F.lit, _TEMPERATURES)))).withColumn("q", 1 / (1 + F.exp(-F.col("z") / F.col("tt"))))
    q = F.col("q")
    c = t.groupBy("pair", "tt").agg(F.round(-F.avg(F.when(F.col("train"), y * F.log(q) + (1 - y) * F.log(1 - q))), 9).alias("loss"), F.avg(F.when(~F.col("train"), (q - y) * (q - y))).alias("brier"))
    best = F.struct("loss", "tt")
    return c.groupBy("pair").agg(F.min_by("tt", best).alias("temperature"), F.round(F.min("loss"), 6).alias("train_loss"), F.round(F.min_by("brier", best), 6).alias("brier"), F.round(F.max(F.when(F.col("tt") == 1, F.col("brier"))), 6).alias("brier_before"))


@query()
def ref_e10_isotonic(spark: SparkSession, sf: str) -> DataFrame:
    """Isotonic calibration of the first half of all time, and the Brier score of the second half with and without it."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    s = VectorAssembler(inputCols=["p"], outputCol="features").transform(scored(spark, sf).withColumn("label", F.col("y").cast("double")))
    low, high = s.agg(F.min("ts"), F.max("ts")).first()
    mid = ((low or 0) + (high or 0)) / 2
    model = IsotonicRegression().fit(s.where(F.col("ts") < mid))
    y, q, p = F.col("label"), F.col("prediction"), F.col("p")
    return model.transform(s.where(F.col("ts") >= mid)).groupBy("pair").agg(F.round(F.avg((q - y) * (q - y)), 6).alias("brier"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier_before"))


@query()
def ref_e18_all_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    """Sign persistence of each stream's block against surrogates of four kinds."""
    r = returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", "r", F.floor(F.col("t") / 14_400).alias("block"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        v = rows.sort_by("t")["r"].to_numpy()
        stat = lambda x: float(np.mean(np.sign(x[1:]) * np.sign(x[:-1]))) if len(x) > 1 else 0.0
        out = []
        for kind in P.SURROGATES:
            null = np.array([stat(x) for x in P.surrogates(v, kind, 50, 7)]) if len(v) > 8 else np.array([stat(v)])
            out.append((key[0].as_py(), key[1].as_py(), kind, stat(v), float((1 + (null >= stat(v)).sum()) / (1 + len(null)))))
        return pa.table(dict(zip(("stream_id", "block", "kind", "observed", "p_value"), map(list, zip(*out)))))

    return r.groupBy("stream_id", "block").applyInArrow(run, "stream_id string, block bigint, kind string, observed double, p_value double")


def _legs(spark: SparkSession, sf: str, first: str, second: str) -> DataFrame:
    """(venue, t, a, b): closes of two pairs at the times at which a venue has both."""
    b = minute_bars(spark, sf).withColumns({"pair": F.split_part("stream_id", F.lit(":"), F.lit(1)), "venue": F.split_part("stream_id", F.lit(":"), F.lit(2))})
    leg = lambda p: F.max(F.when(F.col("pair") == p, F.col("close")))
    return b.where(F.col("pair").isin(first, second)).groupBy("venue", "t").agg(leg(first).alias("a"), leg(second).alias("b")).dropna()


_LEGS_SQL = BARS_SQL + """, g AS (SELECT split_part(stream_id, ':', 2) AS venue, t, max(close) FILTER (split_part(stream_id, ':', 1) = 'EURUSD') AS a, max(close) FILTER (split_part(stream_id, ':', 1) = 'GBPUSD') AS c FROM b GROUP BY ALL), e AS (SELECT 'EURGBP:' || venue AS stream_id, t, (ln(a) - ln(c)) * 10000 AS x FROM g WHERE a IS NOT NULL AND c IS NOT NULL)"""


@query(_LEGS_SQL + f" SELECT stream_id, t, round((x - {rolled('avg(x)', 'x', 30)}) / ({rolled('stddev_samp(x)', 'x', 30)} + 1e-3), 4) AS band FROM e")
def ref_f35_all_venues(spark: SparkSession, sf: str) -> DataFrame:
    """Error-correction band of the synthetic cross on every venue that has both legs."""
    e = _legs(spark, sf, "EURUSD", "GBPUSD").select(F.concat(F.lit("EURGBP:"), F.col("venue")).alias("stream_id"), "t", ((F.log("a") - F.log("b")) * 10000).alias("x"))
    return e.select("stream_id", "t", F.round((F.col("x") - roll(F.avg("x"), "x", 30)) / (roll(F.stddev_samp("x"), "x", 30) + 1e-3), 4).alias("band"))


@query(BARS_SQL + """, r AS (SELECT stream_id, split_part(stream_id, ':', 1) AS pair, t, (close / lag(close) OVER (PARTITION BY stream_id ORDER BY t) - 1) * 1e4 AS r FROM b), k AS (SELECT * FROM r WHERE r IS NOT NULL), l AS (SELECT unnest([0, 60, 120, 180]) AS lag),
j AS (SELECT a.stream_id AS leader, b.stream_id AS follower, lag, a.r AS x, b.r AS y FROM k a JOIN l ON true JOIN k b ON b.pair = a.pair AND b.t = a.t + lag AND a.stream_id <> b.stream_id)
SELECT leader, follower, (lag // 60)::INT AS lag, count(*) AS n, CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN round(covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)), 4) END AS corr FROM j GROUP BY ALL""")
def ref_e23_all_venues(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of every two venues of a pair at leads of zero to three minutes."""
    k = returns(spark, sf).where("r IS NOT NULL").select("stream_id", F.split_part("stream_id", F.lit(":"), F.lit(1)).alias("pair"), "t", "r")
    a = k.select(F.col("stream_id").alias("leader"), "pair", F.col("r").alias("x"), F.explode(F.array(*map(F.lit, range(4)))).alias("lag"), F.col("t")).withColumn("t", F.col("t") + 60 * F.col("lag"))
    j = a.join(k.select(F.col("stream_id").alias("follower"), "pair", "t", F.col("r").alias("y")), ["pair", "t"]).where("leader <> follower")  # a pair has a few venues
    return j.groupBy("leader", "follower", "lag").agg(F.count("*").alias("n"), F.round(R.correlation(F.col("x"), F.col("y")), 4).alias("corr"))


def _interval(clusters: DataFrame) -> DataFrame:
    """The middle 95 % of 400 bootstrap means of clusters (won, n)."""
    reps = X.bootstrap_means(clusters, "won", "n", 400, 11)
    return reps.agg(F.count("*").alias("replicates"), F.avg("mean").alias("mean"), F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"))


@query()
def ref_e12_row_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile interval of the win rate, every row drawn on its own."""
    return _interval(scored(spark, sf).select("row_id", won().cast("int").alias("won"), F.lit(1).alias("n")))


@query()
def ref_e12_block_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile intervals of the win rate over blocks of one, five and twenty days."""
    s, parts = scored(spark, sf), []
    for days in (1, 5, 20):
        blocks = s.groupBy(F.floor(F.col("ts") / (86_400 * days)).alias("block")).agg(F.sum(won().cast("int")).alias("won"), F.count("*").alias("n"))
        parts.append(_interval(blocks).withColumn("days", F.lit(days)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PAST_SQL = BARS_SQL + """, r AS (SELECT stream_id, t, (close / lag(close) OVER (PARTITION BY stream_id ORDER BY t) - 1) * 1e4 AS r FROM b), k AS (SELECT * FROM r WHERE r IS NOT NULL), l AS (SELECT *, """ + ", ".join(f"lag(r, {k}) OVER (PARTITION BY stream_id ORDER BY t) AS r{k}" for k in (1, 2, 3)) + " FROM k)"


def _with_past(spark: SparkSession, sf: str) -> DataFrame:
    return returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", "r", *[F.lag("r", k).over(win()).alias(f"r{k}") for k in (1, 2, 3)])


@query(_PAST_SQL + f""", m AS (SELECT stream_id, t, {rolled("avg((r > 0)::INT)", "r", 60)} AS up, {rolled("avg(r * r * r1 - r * r1 * r1)", "r1", 60)} AS skewed, {rolled("avg(r * r)", "r", 60)} AS power FROM l)
SELECT stream_id, t, round(-(CASE WHEN up > 0 THEN up * ln(up) ELSE 0 END + CASE WHEN up < 1 THEN (1 - up) * ln(1 - up) ELSE 0 END) / ln(2) + 0 * up, 5) AS sign_entropy, round(skewed / (pow(power, 1.5) + 1e-6), 4) AS irreversibility FROM m""")
def ref_f33_irreversibility(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of the signs and the cubic moment that tells time's direction, over 60 bars."""
    r, r1, up = F.col("r"), F.col("r1"), F.col("up")
    m = _with_past(spark, sf).select("stream_id", "t", roll(F.avg((r > 0).cast("int")), "r", 60).alias("up"), roll(F.avg(r * r * r1 - r * r1 * r1), "r1", 60).alias("skewed"), roll(F.avg(r * r), "r", 60).alias("power"))
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    return m.select("stream_id", "t", F.round(-(part(up) + part(1 - up)) / math.log(2) + 0 * up, 5).alias("sign_entropy"), F.round(F.col("skewed") / (F.pow("power", F.lit(1.5)) + 1e-6), 4).alias("irreversibility"))


@query(_PAST_SQL + f""", d AS (SELECT stream_id, t, (r - r1) * (r - r1) / 2 AS d1, (r + r1 - r2 - r3) * (r + r1 - r2 - r3) / 4 AS d2, (r + r1 + r2 + r3) * (r + r1 + r2 + r3) / 4 AS a2 FROM l WHERE r3 IS NOT NULL), e AS (SELECT stream_id, t, {rolled("avg(d1)", "d1", 32)} AS e1, {rolled("avg(d2)", "d2", 32)} AS e2, {rolled("avg(a2)", "a2", 32)} AS e3 FROM d)
SELECT stream_id, t, round(e1 / (e1 + e2 + e3 + 1e-9), 5) AS fine, round(e2 / (e1 + e2 + e3 + 1e-9), 5) AS middle, round(e3 / (e1 + e2 + e3 + 1e-9), 5) AS coarse FROM e""")
def ref_f34_wavelet_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of a return's energy at two Haar scales and beyond, over 32 bars."""
    r, r1, r2, r3 = (F.col(c) for c in ("r", "r1", "r2", "r3"))
    d = _with_past(spark, sf).where("r3 IS NOT NULL").select("stream_id", "t", ((r - r1) * (r - r1) / 2).alias("d1"), ((r + r1 - r2 - r3) * (r + r1 - r2 - r3) / 4).alias("d2"), ((r + r1 + r2 + r3) * (r + r1 + r2 + r3) / 4).alias("a2"))
    e = {n: roll(F.avg(c), c, 32) for n, c in (("fine", "d1"), ("middle", "d2"), ("coarse", "a2"))}
    whole = sum(e.values(), F.lit(0.0)) + 1e-9
    return d.select("stream_id", "t", *[F.round(v / whole, 5).alias(k) for k, v in e.items()])
