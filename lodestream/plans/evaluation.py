"""Queries on selection, splits, evaluation and statistics (E)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import selection as X
from lodestream.operators.rolling import correlation
from lodestream.operators.scan import numbered, with_previous
from lodestream.plans.base import SCORED_SQL, TICKS_SQL, TRAINED_SQL, Registry, scored, ticks, trained
from lodestream.plans.windows import RET_SQL, returns
from lodestream.runtime import cut, table

query = Registry()
_WIN_SQL = "((p > 0.5 AND fwd_ret > 0) OR (p <= 0.5 AND fwd_ret < 0))::INT"


def conf() -> Column:
    """Distance of the score from one half."""
    return F.abs(F.col("p") - 0.5)


def side() -> Column:
    """1 for UP."""
    return (F.col("p") > 0.5).cast("int")


def win() -> Column:
    """Whether the side is right; a tie loses."""
    return ((F.col("p") > 0.5) & (F.col("fwd_ret") > 0)) | ((F.col("p") <= 0.5) & (F.col("fwd_ret") < 0))


@query(SCORED_SQL + """ SELECT CASE WHEN ts < lo + (hi - lo) * 6 // 10 THEN 'train' WHEN ts < lo + (hi - lo) * 8 // 10 THEN 'valid' ELSE 'test' END AS split, count(*) AS n, min(ts) AS first, max(ts) AS last, round(avg(y), 6) AS up_rate
FROM s, (SELECT min(ts) AS lo, max(ts) AS hi FROM s) GROUP BY 1""")
def ref_e01_time_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Named splits by time."""
    s = scored(spark, sf)
    j = s.join(F.broadcast(s.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))))
    edge = lambda k: F.col("lo") + F.floor((F.col("hi") - F.col("lo")) * k / 10)
    split = F.when(F.col("ts") < edge(6), "train").when(F.col("ts") < edge(8), "valid").otherwise("test")
    return j.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.round(F.avg("y"), 6).alias("up_rate"))


@query(SCORED_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY ts, row_id) - 1 AS i, count(*) OVER () AS n FROM s), g AS (SELECT *, (SELECT count(*) FROM range(1, 6) t(k) WHERE i >= k * n // 6)::INT AS grp FROM r),
b AS (SELECT grp, min(ts) AS lo, max(ts) AS hi FROM g GROUP BY 1), combos AS (SELECT a.grp AS g1, c.grp AS g2, row_number() OVER (ORDER BY a.grp, c.grp) - 1 AS path_id FROM b a JOIN b c ON a.grp < c.grp),
z AS (SELECT path_id, ts, CASE WHEN g.grp IN (g1, g2) THEN 'test' WHEN EXISTS (SELECT 1 FROM b WHERE b.grp IN (g1, g2) AND g.ts >= b.lo - 1800 AND g.ts < b.hi + 3600) THEN 'purged' ELSE 'train' END AS role FROM g CROSS JOIN combos)
SELECT path_id::INT AS path_id, role, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM z GROUP BY ALL""")
def ref_e02_cpcv(spark: SparkSession, sf: str) -> DataFrame:
    """Purged combinatorial cross-validation: rows of each path by role."""
    g = cut(X.contiguous_groups(scored(spark, sf), "ts", "row_id", 6))
    return X.purged_training(g, "ts", 6, 2, 1800, 3600)


@query("""WITH RECURSIVE s AS (SELECT pair, epoch(datetime_utc)::BIGINT AS ts, row_id FROM label_rows WHERE datetime_utc IS NOT NULL),
pick AS (SELECT pair, min(ts) AS ts FROM s GROUP BY pair UNION ALL SELECT pick.pair, (SELECT min(ts) FROM s WHERE s.pair = pick.pair AND s.ts >= pick.ts + 3600) FROM pick WHERE pick.ts IS NOT NULL)
SELECT pick.pair, pick.ts, min(row_id) AS row_id FROM pick JOIN s ON s.pair = pick.pair AND s.ts = pick.ts GROUP BY ALL""")
def ref_e03_nonoverlap(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy chronological picks an hour apart."""
    s = table(spark, sf, "label_rows").where("datetime_utc IS NOT NULL").select("pair", F.unix_seconds(F.col("datetime_utc").cast("timestamp")).alias("ts"), "row_id")
    return X.nonoverlap_chrono(s, ["pair"], "ts", "row_id", 3600)


@query(SCORED_SQL.replace("WITH", "WITH RECURSIVE") + """, o AS (SELECT pair, ts, row_id, row_number() OVER (PARTITION BY pair ORDER BY abs(p - 0.5) DESC, row_id) AS k FROM s),
g AS (SELECT pair, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS ts, NULL::BIGINT AS row_id, false AS ok FROM (SELECT DISTINCT pair FROM o)
  UNION ALL SELECT o.pair, o.k, CASE WHEN len(list_filter(g.taken, lambda x: abs(x - o.ts) < 3600)) = 0 THEN list_append(g.taken, o.ts) ELSE g.taken END, o.ts, o.row_id, len(list_filter(g.taken, lambda x: abs(x - o.ts) < 3600)) = 0 FROM g JOIN o ON o.pair = g.pair AND o.k = g.k + 1)
SELECT pair, ts, row_id FROM g WHERE ok""")
def ref_e04_nonoverlap_by_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy picks by confidence an hour apart."""
    return X.nonoverlap_by_confidence(scored(spark, sf).withColumn("conf", conf()), ["pair"], "ts", "row_id", "conf", 3600)


@query(TRAINED_SQL + """, t AS (SELECT pair, quantile_cont(abs(p - 0.5), 0.9) AS thr FROM s WHERE train GROUP BY 1) SELECT pair, round(thr, 6) AS thr, count(*) AS n, round(avg((y = (p > 0.5)::INT)::INT), 6) AS acc FROM s JOIN t USING (pair) WHERE NOT train AND abs(p - 0.5) >= thr GROUP BY ALL""")
def ref_e06_accuracy_at_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of the most confident tenth, by a threshold of other rows."""
    s = trained(spark, sf)
    thr = s.where("train").groupBy("pair").agg(F.percentile(conf(), 0.9).alias("thr"))
    rows = s.where("NOT train").join(thr, "pair").where(conf() >= F.col("thr"))
    return rows.groupBy("pair", F.round("thr", 6).alias("thr")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("y") == side()).cast("int")), 6).alias("acc"))


@query(SCORED_SQL + f""" SELECT pair, CASE WHEN p > 0.5 THEN 'UP' ELSE 'DOWN' END AS side, count(*) AS n, round(avg({_WIN_SQL}), 6) AS win_rate, round(avg((fwd_ret > 0)::INT), 6) AS always_up FROM s GROUP BY ALL""")
def ref_e07_side_win_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Win rate by side; ties lose."""
    return scored(spark, sf).groupBy("pair", F.when(F.col("p") > 0.5, "UP").otherwise("DOWN").alias("side")).agg(
        F.count("*").alias("n"), F.round(F.avg(win().cast("int")), 6).alias("win_rate"), F.round(F.avg((F.col("fwd_ret") > 0).cast("int")), 6).alias("always_up")
    )


@query(SCORED_SQL + f""", w AS (SELECT pair, ts // 86400 AS path, avg({_WIN_SQL}) AS wr FROM s GROUP BY ALL) SELECT pair, count(*) AS n_paths, round(avg(wr), 6) AS mean, round(quantile_cont(wr, 0.1), 6) AS p10, round(median(wr), 6) AS p50, round(min(wr), 6) AS worst, round(avg((wr >= 0.541)::INT), 6) AS frac_ok FROM w GROUP BY 1""")
def ref_e08_path_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, tenth percentile, median, worst and share above break-even of paths."""
    w = scored(spark, sf).groupBy("pair", F.floor(F.col("ts") / 86400).alias("path")).agg(F.avg(win().cast("int")).alias("wr"))
    r = lambda c: F.round(c, 6)
    return w.groupBy("pair").agg(F.count("*").alias("n_paths"), r(F.avg("wr")).alias("mean"), r(F.percentile("wr", 0.1)).alias("p10"), r(F.median("wr")).alias("p50"), r(F.min("wr")).alias("worst"), r(F.avg((F.col("wr") >= 0.541).cast("int"))).alias("frac_ok"))


@query(SCORED_SQL + """, r AS (SELECT pair, y, rank() OVER (PARTITION BY pair ORDER BY p) + (count(*) OVER (PARTITION BY pair, p) - 1) / 2 AS rk FROM s)
SELECT pair, round((sum(rk) FILTER (y = 1) - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 6) AS auc FROM r JOIN (SELECT pair, sum(y) AS n1, sum(1 - y) AS n0 FROM s GROUP BY 1) USING (pair) GROUP BY pair, n1, n0""")
def ref_e09_auc(spark: SparkSession, sf: str) -> DataFrame:
    """AUC by average ranks, from counts per score: no sort of all rows of a pair."""
    c = scored(spark, sf).groupBy("pair", "p").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    below = F.coalesce(F.sum("n0").over(Window.partitionBy("pair").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = c.withColumn("u", F.col("n1") * (below + F.col("n0") / 2))
    return won.groupBy("pair").agg(F.round(F.try_divide(F.sum("u"), F.sum("n1") * F.sum("n0")), 6).alias("auc"))


@query(SCORED_SQL + """ SELECT pair, round(avg((p - y) * (p - y)), 6) AS brier, round(avg((0.5 - y) * (0.5 - y)) - avg((p - y) * (p - y)), 6) AS advantage, round(-avg(y * ln(greatest(p, 0.001)) + (1 - y) * ln(greatest(1 - p, 0.001))), 6) AS logloss FROM s GROUP BY 1""")
def ref_e10_brier(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score, its advantage over a flat forecast, and log loss."""
    p, y = F.col("p"), F.col("y")
    b = F.avg((p - y) * (p - y))
    loss = -F.avg(y * F.log(F.greatest(p, F.lit(0.001))) + (1 - y) * F.log(F.greatest(1 - p, F.lit(0.001))))
    return scored(spark, sf).groupBy("pair").agg(F.round(b, 6).alias("brier"), F.round(F.avg((0.5 - y) * (0.5 - y)) - b, 6).alias("advantage"), F.round(loss, 6).alias("logloss"))


@query(SCORED_SQL + """, q AS (SELECT pair, quantile_cont(p, 0.1) AS lo, quantile_cont(p, 0.9) AS hi FROM s GROUP BY 1) SELECT pair, round(avg(y) FILTER (p >= hi) - avg(y) FILTER (p <= lo), 6) AS lift FROM s JOIN q USING (pair) GROUP BY pair""")
def ref_e11_decile_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Up rate of the top tenth less that of the bottom tenth."""
    s = scored(spark, sf)
    q = s.groupBy("pair").agg(F.percentile("p", 0.1).alias("lo"), F.percentile("p", 0.9).alias("hi"))
    top, low = F.avg(F.when(F.col("p") >= F.col("hi"), F.col("y"))), F.avg(F.when(F.col("p") <= F.col("lo"), F.col("y")))
    return s.join(q, "pair").groupBy("pair").agg(F.round(top - low, 6).alias("lift"))


@query()
def ref_e12_cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile interval of the win rate over day clusters."""
    days = scored(spark, sf).groupBy(F.floor(F.col("ts") / 86400).alias("day")).agg(F.sum(win().cast("int")).alias("won"), F.count("*").alias("n"))
    reps = X.bootstrap_means(days, "won", "n", 400, 11)
    return reps.agg(F.count("*").alias("replicates"), F.avg("mean").alias("mean"), F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"))


@query(SCORED_SQL + f""", c AS (SELECT pair, count(*) AS n, avg({_WIN_SQL}) AS w FROM s GROUP BY 1) SELECT pair, n, round((w + 1.9208 / n - 1.96 * sqrt(w * (1 - w) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) AS lo, round((w + 1.9208 / n + 1.96 * sqrt(w * (1 - w) / n + 0.9604 / n / n)) / (1 + 3.8416 / n), 6) AS hi FROM c""")
def ref_e14_wilson(spark: SparkSession, sf: str) -> DataFrame:
    """Wilson interval of the win rate."""
    c = scored(spark, sf).groupBy("pair").agg(F.count("*").alias("n"), F.avg(win().cast("int")).alias("w"))
    w, n = F.col("w"), F.col("n")
    half = 1.96 * F.sqrt(w * (1 - w) / n + 0.9604 / n / n)
    return c.select("pair", "n", F.round((w + 1.9208 / n - half) / (1 + 3.8416 / n), 6).alias("lo"), F.round((w + 1.9208 / n + half) / (1 + 3.8416 / n), 6).alias("hi"))


@query(SCORED_SQL + """, h AS (SELECT pair, ts % 86400 // 3600 AS hour, count(*) AS n, avg(y) AS m FROM s GROUP BY ALL), z AS (SELECT pair || ':' || hour AS test, least(1, 2 * exp(-2 * n * (m - 0.5) * (m - 0.5))) AS pv FROM h), r AS (SELECT *, row_number() OVER (ORDER BY pv, test) AS k, count(*) OVER () AS m FROM z)
SELECT test, round(pv, 6) AS pv, round(least(1, max((m - k + 1) * pv) OVER (ORDER BY k)), 6) AS holm, round(least(1, min(m * pv / k) OVER (ORDER BY k DESC)), 6) AS bh FROM r""")
def ref_e15_multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    """Holm and Benjamini-Hochberg adjusted bounds of cell tests; one row per cell."""
    h = scored(spark, sf).groupBy("pair", F.floor(F.col("ts") % 86400 / 3600).alias("hour")).agg(F.count("*").alias("n"), F.avg("y").alias("m"))
    pv = F.least(F.lit(1.0), 2 * F.exp(-2 * F.col("n") * (F.col("m") - 0.5) * (F.col("m") - 0.5)))
    z = h.select(F.concat("pair", F.lit(":"), F.col("hour").cast("string")).alias("test"), pv.alias("pv"))
    r = z.withColumn("k", F.row_number().over(Window.orderBy("pv", "test"))).join(F.broadcast(z.agg(F.count("*").alias("m"))))
    holm = F.max((F.col("m") - F.col("k") + 1) * F.col("pv")).over(Window.orderBy("k"))
    bh = F.min(F.col("m") * F.col("pv") / F.col("k")).over(Window.orderBy(F.desc("k")))
    return r.select("test", F.round("pv", 6).alias("pv"), F.round(F.least(F.lit(1.0), holm), 6).alias("holm"), F.round(F.least(F.lit(1.0), bh), 6).alias("bh"))


@query()
def ref_e16_overfitting(spark: SparkSession, sf: str) -> DataFrame:
    """Probability of overfitting of seven configurations over eight blocks."""
    g = X.contiguous_groups(scored(spark, sf), "ts", "row_id", 8)
    sums = g.groupBy("grp").pivot("pair").agg(F.sum(F.when(win(), 1).otherwise(-1))).fillna(0).orderBy("grp").toPandas()  # 8 rows
    return spark.createDataFrame([(float(X.pbo(sums.drop(columns="grp"))), len(sums), sums.shape[1] - 1)], "pbo double, n_blocks int, n_configs int")


@query(SCORED_SQL + f""", m AS (SELECT pair, median(ts) AS m FROM s GROUP BY 1), g AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4]) AS thr), c AS (SELECT pair, thr, (ts >= m)::INT AS half, count(*) AS n, avg({_WIN_SQL}) AS wr FROM s JOIN m USING (pair), g WHERE abs(p - 0.5) >= thr GROUP BY ALL),
w AS (SELECT pair, thr, min(wr) AS worst, min(n) AS least FROM c GROUP BY ALL HAVING count(*) = 2 AND min(n) >= 25) SELECT pair, thr::DOUBLE AS thr, round(worst, 6) AS worst FROM w QUALIFY row_number() OVER (PARTITION BY pair ORDER BY round(worst, 6) DESC, thr) = 1""")
def ref_e19_worst_half(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold with the best worse half, 25 rows each at least; ties keep the lower."""
    s = scored(spark, sf)
    halves = s.join(s.groupBy("pair").agg(F.median("ts").alias("m")), "pair").withColumn("half", (F.col("ts") >= F.col("m")).cast("int"))
    levels = [0.0, 0.1, 0.2, 0.3, 0.4]
    grid = halves.withColumn("thr", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: conf() >= x)))
    c = grid.groupBy("pair", "thr", "half").agg(F.count("*").alias("n"), F.avg(win().cast("int")).alias("wr"))
    w = c.groupBy("pair", "thr").agg(F.round(F.min("wr"), 6).alias("worst"), F.min("n").alias("least"), F.count("*").alias("k")).where("k = 2 AND least >= 25")
    return w.groupBy("pair").agg(F.max_by("thr", F.struct("worst", -F.col("thr"))).alias("thr"), F.max("worst").alias("worst"))


@query(SCORED_SQL + f""", d AS (SELECT ts // 86400 AS day, sum(CASE WHEN {_WIN_SQL} = 1 THEN 0.85 ELSE -1 END) / count(*) AS g FROM s GROUP BY 1), e AS (SELECT day, g, sum(ln(1 + 0.1 * g)) OVER (ORDER BY day) AS le FROM d), m AS (SELECT *, max(le) OVER (ORDER BY day) AS top FROM e)
SELECT day, round(exp(le), 6) AS equity, round(1 - exp(le - greatest(top, 0)), 6) AS drawdown FROM m""")
def ref_e21_equity(spark: SparkSession, sf: str) -> DataFrame:
    """Equity curve and drawdown of a fixed fraction; one row per day."""
    d = scored(spark, sf).groupBy(F.floor(F.col("ts") / 86400).alias("day")).agg((F.sum(F.when(win(), 0.85).otherwise(-1.0)) / F.count("*")).alias("g"))
    w = Window.orderBy("day")
    e = d.withColumn("le", F.sum(F.log(1 + 0.1 * F.col("g"))).over(w)).withColumn("top", F.max("le").over(w))
    return e.select("day", F.round(F.exp("le"), 6).alias("equity"), F.round(1 - F.exp(F.col("le") - F.greatest("top", F.lit(0.0))), 6).alias("drawdown"))


@query(TICKS_SQL + """, b AS (SELECT stream_id, epoch, (quote > lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch))::INT AS b FROM u), c AS (SELECT stream_id, b, lag(b) OVER (PARTITION BY stream_id ORDER BY epoch) AS p, row_number() OVER (PARTITION BY stream_id ORDER BY epoch) - 1 AS i FROM b WHERE b IS NOT NULL),
k AS (SELECT stream_id, (i // 128) AS blk, avg(b) AS f, count(*) AS n FROM c GROUP BY ALL), f AS (SELECT stream_id, sum(128 * 4 * (f - 0.5) * (f - 0.5)) FILTER (n = 128) AS block FROM k GROUP BY 1)
SELECT stream_id, count(*) AS n, round(abs(sum(2 * b - 1)) / sqrt(count(*)), 6) AS monobit, (1 + sum((b <> p)::INT))::BIGINT AS runs, round(block, 4) AS block_chi2 FROM c JOIN f USING (stream_id) GROUP BY stream_id, block""")
def ref_e22_randomness(spark: SparkSession, sf: str) -> DataFrame:
    """Monobit, runs and block-frequency statistics of the up-move bits."""
    key, order = ["stream_id"], [F.col("epoch")]
    b = with_previous(ticks(spark, sf), key, "epoch", order, ["quote"]).select("stream_id", "epoch", (F.col("quote") > F.col("prev.quote")).cast("int").alias("b")).where("b IS NOT NULL")
    c = with_previous(numbered(b, order, F.floor(F.col("epoch") / 3600), key), key, "epoch", order, ["b"]).withColumns({"p": F.col("prev.b"), "i": F.col("nth") - 1})
    k = c.groupBy("stream_id", F.floor(F.col("i") / 128).alias("blk")).agg(F.sum("b").alias("ones"), F.count("*").alias("n"), F.sum((F.col("b") != F.col("p")).cast("int")).alias("flips"))
    dev = F.when(F.col("n") == 128, 128 * 4 * (F.col("ones") / F.col("n") - 0.5) * (F.col("ones") / F.col("n") - 0.5))
    n = F.sum("n")
    return k.groupBy("stream_id").agg(n.alias("n"), F.round(F.abs(2 * F.sum("ones") - n) / F.sqrt(n), 6).alias("monobit"), (1 + F.sum("flips")).alias("runs"), F.round(F.sum(dev), 4).alias("block_chi2"))


@query(RET_SQL + """, v AS (SELECT t, max(r) FILTER (stream_id = 'EURUSD:alder') AS x, max(r) FILTER (stream_id = 'EURUSD:cedar') AS y FROM r GROUP BY t), g AS (SELECT unnest(range(min(t), max(t) + 60, 60)) AS t FROM v), d AS (SELECT g.t, x, y FROM g LEFT JOIN v USING (t)),
l AS (SELECT unnest([0, 1, 2, 3]) AS lag), j AS (SELECT l.lag, a.x, b.y FROM l JOIN d a ON true JOIN d b ON b.t = a.t + 60 * l.lag WHERE a.x IS NOT NULL AND b.y IS NOT NULL) SELECT lag::INT AS lag, count(*) AS n, CASE WHEN var_pop(x) > 1e-12 AND var_pop(y) > 1e-12 THEN round(corr(x, y), 5) END AS corr FROM j GROUP BY lag""")
def ref_e23_lead_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of two venues at leads of zero to three minutes."""
    r = returns(spark, sf).where("r IS NOT NULL")
    x = r.where("stream_id = 'EURUSD:alder'").select("t", F.col("r").alias("x"), F.explode(F.array(*map(F.lit, range(4)))).alias("lag"))
    y = r.where("stream_id = 'EURUSD:cedar'").select(F.col("t").alias("ty"), F.col("r").alias("y"))
    j = x.withColumn("ty", F.col("t") + 60 * F.col("lag")).join(y, "ty")
    return j.groupBy("lag").agg(F.count("*").alias("n"), F.round(correlation(F.col("x"), F.col("y")), 5).alias("corr"))


@query(SCORED_SQL + f""" SELECT pair, count(*) AS n, round(avg(CASE WHEN {_WIN_SQL} = 1 THEN 1 / (0.52 + row_id % 5 * 0.01) - 1 ELSE -1 END), 6) AS ev, round(avg(0.52 + row_id % 5 * 0.01), 6) AS breakeven, round(avg((row_id % 5 < 2)::INT), 6) AS favoured FROM s GROUP BY 1""")
def ref_e25_payout_value(spark: SparkSession, sf: str) -> DataFrame:
    """Expected value at made-up prices, break-even and favoured share."""
    price = 0.52 + F.col("row_id") % 5 * 0.01
    return scored(spark, sf).groupBy("pair").agg(F.count("*").alias("n"), F.round(F.avg(F.when(win(), 1 / price - 1).otherwise(-1.0)), 6).alias("ev"), F.round(F.avg(price), 6).alias("breakeven"), F.round(F.avg((F.col("row_id") % 5 < 2).cast("int")), 6).alias("favoured"))


@query(SCORED_SQL + f""", d AS (SELECT *, row_id * 31 % 97 AS delay FROM s), r AS (SELECT *, floor((row_number() OVER (PARTITION BY pair ORDER BY delay, row_id) - 1) * 3 / count(*) OVER (PARTITION BY pair))::INT AS tercile FROM d)
SELECT pair, tercile, count(*) AS n, max(delay) AS max_delay, round(avg({_WIN_SQL}), 6) AS win_rate FROM r GROUP BY ALL""")
def ref_e26_delay_terciles(spark: SparkSession, sf: str) -> DataFrame:
    """Win rate by tercile of a made-up delay."""
    d = scored(spark, sf).withColumn("delay", F.col("row_id") * 31 % 97)
    ranked = numbered(d, [F.col("delay"), F.col("row_id")], F.col("delay"), ["pair"]).join(d.groupBy("pair").agg(F.count("*").alias("m")), "pair")
    r = ranked.withColumn("tercile", F.floor((F.col("nth") - 1) * 3 / F.col("m")).cast("int"))
    return r.groupBy("pair", "tercile").agg(F.count("*").alias("n"), F.max("delay").alias("max_delay"), F.round(F.avg(win().cast("int")), 6).alias("win_rate"))


@query("SELECT pair, count(*) AS n, sum((p >= 0.7 AND NOT coalesce(width > 0.5, false))::INT)::BIGINT AS passed FROM (SELECT pair, (row_id * 7919 % 1000) / 1000 AS p, CASE WHEN NOT isnan(fwd_ret) THEN abs(fwd_ret) * 1000 END AS width FROM label_rows) GROUP BY 1")
def ref_e28_gates(spark: SparkSession, sf: str) -> DataFrame:
    """A confidence gate that a missing width passes."""
    rows = table(spark, sf, "label_rows").select("pair", (F.pmod(F.col("row_id") * 7919, F.lit(1000)) / 1000).alias("p"), F.when(~F.isnan("fwd_ret"), F.abs("fwd_ret") * 1000).alias("width"))
    ok = (F.col("p") >= 0.7) & ~F.coalesce(F.col("width") > 0.5, F.lit(False))
    return rows.groupBy("pair").agg(F.count("*").alias("n"), F.sum(ok.cast("int")).alias("passed"))


@query(SCORED_SQL + """ SELECT a.pair, count(*) AS n, CASE WHEN var_pop(a.p) > 1e-12 AND var_pop(b.y) > 1e-12 THEN round(corr(a.p, b.y), 6) END AS shifted_corr FROM s a JOIN s b ON a.pair = b.pair AND b.ts = a.ts + 604800 GROUP BY 1""")
def ref_x23_shifted_placebo(spark: SparkSession, sf: str) -> DataFrame:
    """Scores against the labels of exactly a week later."""
    s = scored(spark, sf)
    later = s.select("pair", (F.col("ts") - 604800).alias("ts"), "y")
    return s.select("pair", "ts", "p").join(later, ["pair", "ts"]).groupBy("pair").agg(F.count("*").alias("n"), F.round(correlation(F.col("p"), F.col("y")), 6).alias("shifted_corr"))


@query(SCORED_SQL + """, w AS (SELECT (ts + 259200) // 604800 AS week, sum((p > 0.5)::INT) AS up, sum((p <= 0.5)::INT) AS dn FROM s GROUP BY 1), c AS (SELECT week, sum(up) OVER (ORDER BY week) AS up, sum(dn) OVER (ORDER BY week) AS dn FROM w)
SELECT min(week) FILTER (up >= 100 AND dn >= 100) AS first_week, max(week) AS cap_week FROM c""")
def ref_x28_fixed_look(spark: SparkSession, sf: str) -> DataFrame:
    """First week in which both sides reach their minimum count."""
    w = scored(spark, sf).groupBy(F.floor((F.col("ts") + 259200) / 604800).alias("week")).agg(F.sum(side()).alias("up"), F.sum(1 - side()).alias("dn"))
    o = Window.orderBy("week")
    c = w.select("week", F.sum("up").over(o).alias("up"), F.sum("dn").over(o).alias("dn"))
    return c.agg(F.min(F.when((F.col("up") >= 100) & (F.col("dn") >= 100), F.col("week"))).alias("first_week"), F.max("week").alias("cap_week"))


@query(SCORED_SQL + """ SELECT year(to_timestamp(ts)::TIMESTAMP)::INT AS year, pair, round(avg((fwd_ret > 0)::INT) FILTER (fwd_ret <> 0), 6) AS moved_up, (avg((fwd_ret > 0)::INT) FILTER (fwd_ret <> 0) BETWEEN 0.47 AND 0.53)::INT AS ok FROM s GROUP BY ALL""")
def ref_x17_tripwire(spark: SparkSession, sf: str) -> DataFrame:
    """Share of up moves per year and whether it is near one half."""
    up = F.avg(F.when(F.col("fwd_ret") != 0, (F.col("fwd_ret") > 0).cast("int")))
    return scored(spark, sf).groupBy(F.year(F.timestamp_seconds("ts")).alias("year"), "pair").agg(F.round(up, 6).alias("moved_up"), up.between(0.47, 0.53).cast("int").alias("ok"))


def replicate_count(share: float, width: float) -> int:
    """Replicates after which a bootstrap share is known to a half width at 95 %."""
    return math.ceil(share * (1 - share) * (1.96 / width) ** 2)
