"""Queries on joins (J), labels and settlement (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import asof as A
from lodestream.operators import rolling as R
from lodestream.operators.bars import keep_last
from lodestream.plans.base import BARS_SQL, SCORED_SQL, TICKS_SQL, TRAINED_SQL, Registry, minute_bars, scored, ticks, trained
from lodestream.plans.windows import KEY, RET_SQL, returns, rolled, win
from lodestream.runtime import table

query = Registry()

_DEC_SQL = TICKS_SQL + """, d AS (SELECT stream_id, decision_close_epoch AS epoch, decision_id FROM decisions)"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision instants as queries against ticks."""
    return table(spark, sf, "decisions").select("stream_id", F.col("decision_close_epoch").alias("epoch"), "decision_id")


@query(BARS_SQL + """, v AS (SELECT t, max(close) FILTER (stream_id = 'EURUSD:alder') AS eur, max(close) FILTER (stream_id = 'GBPUSD:alder') AS gbp, max(close) FILTER (stream_id = 'USDJPY:alder') AS jpy FROM b GROUP BY t)
SELECT * FROM v WHERE eur IS NOT NULL AND gbp IS NOT NULL AND jpy IS NOT NULL""")
def ref_j01_aligned_closes(spark: SparkSession, sf: str) -> DataFrame:
    """Closes of three streams at the times that all of them have: one pivot, no join."""
    names = {"EURUSD:alder": "eur", "GBPUSD:alder": "gbp", "USDJPY:alder": "jpy"}
    b = minute_bars(spark, sf).where(F.col("stream_id").isin(list(names)))
    pivot = b.groupBy("t").pivot("stream_id", list(names)).agg(F.max("close"))
    return pivot.select("t", *[F.col(f"`{k}`").alias(v) for k, v in names.items()]).dropna()


_PAIRS = ["EURUSD", "GBPUSD", "AUDUSD", "NZDUSD", "USDJPY", "USDCHF", "USDCAD"]


@query(BARS_SQL + ", v AS (SELECT t, " + ", ".join(f"max(close) FILTER (stream_id = '{p}:alder') AS {p.lower()}" for p in _PAIRS) + " FROM b GROUP BY t) SELECT * FROM v WHERE " + " AND ".join(f"{p.lower()} IS NOT NULL" for p in _PAIRS))
def ref_j01_seven_closes(spark: SparkSession, sf: str) -> DataFrame:
    """Closes of all seven pairs at the times that all of them have: one pivot, no join."""
    names = {f"{p}:alder": p.lower() for p in _PAIRS}
    b = minute_bars(spark, sf).where(F.col("stream_id").isin(list(names)))
    pivot = b.groupBy("t").pivot("stream_id", list(names)).agg(F.max("close"))
    return pivot.select("t", *[F.col(f"`{k}`").alias(v) for k, v in names.items()]).dropna()


@query(RET_SQL + """, x AS (SELECT t, avg(r) AS factor, count(r) AS n_streams FROM r GROUP BY t) SELECT stream_id, r.t, round(r, 6) AS r, round(factor, 6) AS factor, n_streams FROM r LEFT JOIN x USING (t)""")
def ref_j02_feature_block(spark: SparkSession, sf: str) -> DataFrame:
    """A feature block joined on time, overlapping columns left out."""
    r = returns(spark, sf)
    block = r.groupBy("t").agg(F.avg("r").alias("factor"), F.count("r").alias("n_streams"), F.max("close").alias("close"))
    extra = [c for c in block.columns if c == "t" or c not in r.columns]
    return r.join(block.select(extra), "t", "left").select("stream_id", "t", F.round("r", 6).alias("r"), F.round("factor", 6).alias("factor"), "n_streams")


@query(_DEC_SQL + """ SELECT decision_id, u.tick_id, u.quote, d.epoch - u.epoch AS age FROM d ASOF LEFT JOIN u ON d.stream_id = u.stream_id AND d.epoch >= u.epoch""")
def ref_j03_asof_backward(spark: SparkSession, sf: str) -> DataFrame:
    """The last tick at or before each decision, with its age."""
    j = A.asof(decisions(spark, sf), ticks(spark, sf), ["stream_id"], "epoch", "tick_id", ["quote"])
    return j.select("decision_id", F.col("match.seq").alias("tick_id"), F.col("match.quote").alias("quote"), (F.col("epoch") - F.col("match.on")).alias("age"))


@query(TICKS_SQL + """, g AS (SELECT stream_id, unnest(range(min(epoch), max(epoch), 2)) AS epoch FROM u GROUP BY 1), m AS (SELECT g.stream_id, g.epoch, u.epoch AS on_, u.tick_id FROM g ASOF LEFT JOIN u ON g.stream_id = u.stream_id AND g.epoch >= u.epoch),
n AS (SELECT *, row_number() OVER (PARTITION BY stream_id, on_, epoch <> on_ ORDER BY epoch) AS k FROM m)
SELECT stream_id, epoch, CASE WHEN epoch = on_ OR k <= 3 THEN tick_id END AS tick_id FROM n""")
def ref_j04_asof_limit(spark: SparkSession, sf: str) -> DataFrame:
    """As-of onto a two-second grid in which a tick serves at most three further slots."""
    u = ticks(spark, sf)
    grid = u.groupBy("stream_id").agg(F.min("epoch").alias("lo"), F.max("epoch").alias("hi")).where("hi > lo").select("stream_id", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(2).cast("bigint"))).alias("epoch"))
    j = A.fill_limited(A.asof(grid, u, ["stream_id"], "epoch", "tick_id", []), ["stream_id"], "epoch", 3)
    return j.select("stream_id", "epoch", F.col("match.seq").alias("tick_id"))


@query(_DEC_SQL + """, a AS (SELECT decision_id, d.epoch, u.epoch AS e, u.tick_id FROM d ASOF LEFT JOIN u ON d.stream_id = u.stream_id AND d.epoch >= u.epoch
UNION ALL SELECT decision_id, d.epoch, u.epoch, u.tick_id FROM d ASOF LEFT JOIN u ON d.stream_id = u.stream_id AND d.epoch <= u.epoch)
SELECT decision_id, max(tick_id) FILTER (k = 1 AND abs(epoch - e) <= 5) AS tick_id FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY abs(epoch - e) NULLS LAST, e) AS k FROM a) GROUP BY decision_id""")
def ref_j05_asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest tick within five seconds, else none."""
    j = A.nearest(decisions(spark, sf), ticks(spark, sf), ["stream_id"], "epoch", "tick_id", [], 5)
    return j.select("decision_id", F.col("match.seq").alias("tick_id"))


@query(_DEC_SQL + """ SELECT decision_id, CASE WHEN u.epoch - d.epoch <= 30 THEN u.tick_id END AS tick_id FROM d ASOF LEFT JOIN u ON d.stream_id = u.stream_id AND d.epoch <= u.epoch""")
def ref_j06_asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The first tick at or after each decision within 30 seconds."""
    j = A.asof(decisions(spark, sf), ticks(spark, sf), ["stream_id"], "epoch", "tick_id", [], forward=True, tolerance=30)
    return j.select("decision_id", F.col("match.seq").alias("tick_id"))


@query(_DEC_SQL + """ SELECT decision_id, u.tick_id FROM d ASOF LEFT JOIN u ON d.stream_id = u.stream_id AND d.epoch > u.epoch""")
def ref_j07_asof_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The last tick strictly before each decision."""
    j = A.asof(decisions(spark, sf), ticks(spark, sf), ["stream_id"], "epoch", "tick_id", [], exact=False)
    return j.select("decision_id", F.col("match.seq").alias("tick_id"))


@query(TICKS_SQL + """, a AS (SELECT pair, epoch, quote AS aq FROM u WHERE stream_id LIKE '%:alder'), b AS (SELECT pair, epoch, quote AS bq FROM u WHERE stream_id LIKE '%:birch')
SELECT pair, count(*) AS n, count(*) FILTER (aq <> bq) AS n_differ, round(max(abs(aq - bq)), 8) AS max_diff FROM a JOIN b USING (pair, epoch) GROUP BY pair""")
def ref_j08_one_to_one(spark: SparkSession, sf: str) -> DataFrame:
    """Two venues joined one to one on pair and second, with their disagreement."""
    u = ticks(spark, sf)
    side = lambda venue, name: u.where(F.col("stream_id").endswith(f":{venue}")).select("pair", "epoch", F.col("quote").alias(name))
    j = side("alder", "aq").join(side("birch", "bq"), ["pair", "epoch"])
    return j.groupBy("pair").agg(F.count("*").alias("n"), F.count(F.when(F.col("aq") != F.col("bq"), 1)).alias("n_differ"), F.round(F.max(F.abs(F.col("aq") - F.col("bq"))), 8).alias("max_diff"))


@query(_DEC_SQL + """, a AS (SELECT decision_id, d.epoch, u.tick_id FROM d ASOF JOIN u ON d.stream_id = u.stream_id AND d.epoch >= u.epoch WHERE d.epoch - u.epoch <= 20)
SELECT decision_id, tick_id FROM a QUALIFY row_number() OVER (PARTITION BY tick_id ORDER BY epoch, decision_id) = 1""")
def ref_j09_unique_match(spark: SparkSession, sf: str) -> DataFrame:
    """As-of matches in which every tick serves only its first decision."""
    j = A.asof(decisions(spark, sf), ticks(spark, sf), ["stream_id"], "epoch", "tick_id", [], tolerance=20).where("match IS NOT NULL").withColumn("tick_id", F.col("match.seq"))
    first = F.min_by("decision_id", F.struct("epoch", "decision_id")).alias("decision_id")
    return j.groupBy("tick_id").agg(first).select("decision_id", "tick_id")


@query(SCORED_SQL + """, c AS (SELECT pair, ts // 86400 AS day, ts % 86400 // 900 AS slot, avg(fwd_ret) * 10000 AS r FROM s GROUP BY ALL), k AS (SELECT *, dense_rank() OVER (ORDER BY day) AS dr FROM c)
SELECT a.pair, a.day, a.slot, round(a.r, 6) AS r, round(b.r, 6) AS r_before FROM k a JOIN k b ON a.pair = b.pair AND a.slot = b.slot AND a.dr = b.dr + 1""")
def ref_j10_same_slot_day_before(spark: SparkSession, sf: str) -> DataFrame:
    """The same quarter hour one trading day earlier, by dense rank of days."""
    c = scored(spark, sf).groupBy("pair", F.floor(F.col("ts") / 86400).alias("day"), F.floor(F.col("ts") % 86400 / 900).alias("slot")).agg((F.avg("fwd_ret") * 10000).alias("r"))
    days = c.select("day").distinct().withColumn("dr", F.dense_rank().over(Window.orderBy("day")))  # one row per day
    k = c.join(days, "day")
    before = k.select("pair", "slot", (F.col("dr") + 1).alias("dr"), F.round("r", 6).alias("r_before"))
    return k.join(before, ["pair", "slot", "dr"]).select("pair", "day", "slot", F.round("r", 6).alias("r"), "r_before")


@query(SCORED_SQL + """ SELECT s.row_id FROM s WHERE row_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM s z WHERE z.row_id % 10 = 0 AND z.pair = s.pair AND s.ts >= z.ts - 900 AND s.ts < z.ts + 1800)""")
def ref_j11_purge(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows that lie in no test row's purge and embargo zone, by two as-of joins."""
    s = scored(spark, sf)
    test = s.where("row_id % 10 = 0").select("pair", "ts", "row_id")
    train = s.where("row_id % 10 <> 0").select("pair", "ts", "row_id")
    near = A.asof(train, test, ["pair"], "ts", "row_id", [], bucket_s=86_400, match="before")
    near = A.asof(near, test, ["pair"], "ts", "row_id", [], forward=True, bucket_s=86_400, match="after")
    hit = (F.col("ts") < F.col("before.on") + 1800) | (F.col("ts") >= F.col("after.on") - 900)
    return near.where(~F.coalesce(hit, F.lit(False)) & ~F.coalesce(F.col("ts") < F.col("before.on") + 1800, F.lit(False)) & ~F.coalesce(F.col("ts") >= F.col("after.on") - 900, F.lit(False))).select("row_id")


@query(BARS_SQL + """ SELECT stream_id, t, close FROM b WHERE t IN (SELECT t FROM b WHERE stream_id = 'EURUSD:birch') AND stream_id LIKE 'GBP%'""")
def ref_j12_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Bars at times that another stream has."""
    b = minute_bars(spark, sf)
    return b.where("stream_id LIKE 'GBP%'").join(b.where("stream_id = 'EURUSD:birch'").select("t"), "t", "left_semi").select("stream_id", "t", "close")


@query(SCORED_SQL + """, d AS (SELECT DISTINCT to_timestamp(ts)::TIMESTAMP::DATE AS day FROM s), f AS (SELECT day, (day = max(day) OVER (PARTITION BY date_trunc('month', day)))::INT AS month_end FROM d)
SELECT month_end, count(*) AS n, round(avg(y), 6) AS up_rate FROM s JOIN f ON f.day = to_timestamp(ts)::TIMESTAMP::DATE GROUP BY 1""")
def ref_j13_calendar_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows joined with a calendar of month ends."""
    s = scored(spark, sf).withColumn("day", F.timestamp_seconds("ts").cast("date"))
    d = s.select("day").distinct()
    flags = d.withColumn("month_end", (F.col("day") == F.max("day").over(Window.partitionBy(F.trunc("day", "month")))).cast("int"))
    return s.join(flags, "day").groupBy("month_end").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("up_rate"))


@query(RET_SQL + """, ev AS (SELECT stream_id, decision_close_epoch AS e, decision_id FROM decisions WHERE candidate_gate_passed = 1)
SELECT r.stream_id, r.t, CASE WHEN r.t - e <= 1800 THEN decision_id END AS decision_id FROM r ASOF LEFT JOIN (SELECT stream_id, e, max(decision_id) AS decision_id FROM ev GROUP BY ALL) x ON r.stream_id = x.stream_id AND r.t >= x.e""")
def ref_j14_active_window(spark: SparkSession, sf: str) -> DataFrame:
    """The latest passed decision of the last 30 minutes for every bar."""
    ev = table(spark, sf, "decisions").where("candidate_gate_passed = 1").select("stream_id", F.col("decision_close_epoch").alias("t"), "decision_id")
    j = A.asof(returns(spark, sf).select("stream_id", "t"), ev, KEY, "t", "decision_id", [], tolerance=1800)
    return j.select("stream_id", "t", F.col("match.seq").alias("decision_id"))


@query(TRAINED_SQL + """, c AS (SELECT pair, ts % 86400 // 3600 AS hour, avg(abs(fwd_ret)) * 10000 AS m FROM s WHERE train GROUP BY ALL), g AS (SELECT median(m) AS g FROM c)
SELECT s.row_id, round(coalesce(m, g), 6) AS intensity FROM s CROSS JOIN g LEFT JOIN c ON c.pair = s.pair AND c.hour = s.ts % 86400 // 3600""")
def ref_j15_lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    """Lookup in a table of cells; a missing cell gets the median cell."""
    s = trained(spark, sf).withColumn("hour", F.floor(F.col("ts") % 86400 / 3600))
    cells = s.where("train").groupBy("pair", "hour").agg((F.avg(F.abs("fwd_ret")) * 10000).alias("m"))
    default = cells.agg(F.median("m").alias("g"))
    return s.join(cells, ["pair", "hour"], "left").join(F.broadcast(default)).select("row_id", F.round(F.coalesce("m", "g"), 6).alias("intensity"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - v.e[i]) * (q.e[i] - v.e[i]))) AS dist FROM q JOIN v ON q.vec_id <> v.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d)
SELECT query_id, vec_id, rank::INT AS rank, round(dist, 5) AS dist FROM k WHERE rank <= 10""")
def ref_j16_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every query (ids divisible by 100) among all rows, exactly.

    Queries go through the table in blocks: a task holds its rows and one block of queries, keeps
    the ten best per query, and only those are shuffled.
    """
    from lodestream.operators.neighbours import nearest_vectors

    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("dist", F.round("dist", 5))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL), x AS (SELECT unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), m AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM x GROUP BY 1),
top AS (SELECT * FROM m WHERE sd > 0 ORDER BY round(sd, 9) DESC, i LIMIT 20), z AS (SELECT vec_id, list((e[i] - mu) / sd ORDER BY i) AS z FROM v, top GROUP BY 1), q AS (SELECT * FROM z WHERE vec_id % 100 = 0),
d AS (SELECT q.vec_id AS query_id, z.vec_id, list_sum(list_transform(range(1, len(q.z) + 1), lambda i: (q.z[i] - z.z[i]) * (q.z[i] - z.z[i]))) AS dist FROM q JOIN z ON q.vec_id <> z.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM d) SELECT query_id, vec_id, rank::INT AS rank, round(dist, 4) AS dist FROM k WHERE rank <= 100""")
def ref_j16_standardized_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred nearest rows of every query (ids divisible by 100) on the twenty most variable elements, standardized."""
    from lodestream.operators.neighbours import nearest_vectors

    v = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    m = v.select(F.posexplode("e").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd")).where("sd > 0")  # one row an element
    top = m.orderBy(F.round("sd", 9).desc(), "i").limit(20).agg(F.sort_array(F.collect_list(F.struct("i", "mu", "sd"))).alias("top"))
    z = v.join(F.broadcast(top)).select("vec_id", F.transform("top", lambda c: (F.get("e", c["i"]) - c["mu"]) / c["sd"]).alias("z"))
    return nearest_vectors(z, z.where("vec_id % 100 = 0"), "vec_id", "z", 100).withColumn("dist", F.round("dist", 4))


@query("""SELECT d.stream_id, s.venue, count(*) AS n, count(s.stream_id) AS matched, sum((d.candidate_gate_passed = 1 AND d.candidate_direction = 'UP')::INT)::BIGINT AS up FROM decisions d LEFT JOIN streams s ON s.stream_id = d.stream_id AND s.digits = 5 GROUP BY ALL""")
def ref_j17_left_join_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """A left join with a predicate on the right side, which keeps unmatched rows."""
    d, s = table(spark, sf, "decisions"), table(spark, sf, "streams").where("digits = 5").select("stream_id", "venue", F.lit(1).alias("hit"))
    up = F.expr("candidate_gate_passed = 1 AND candidate_direction = 'UP'").cast("int")
    return d.join(s, "stream_id", "left").groupBy("stream_id", "venue").agg(F.count("*").alias("n"), F.count("hit").alias("matched"), F.sum(up).alias("up"))


@query("""SELECT count(*) AS n, count(DISTINCT row_sha256) AS n_hashes, count(*) FILTER (sha256(row_json) = row_sha256) AS n_equal FROM decisions""")
def ref_j18_hash_linkage(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose stored hash is that of their content."""
    same = F.sha2(F.col("row_json"), 256) == F.col("row_sha256")
    return table(spark, sf, "decisions").agg(F.count("*").alias("n"), F.count_distinct("row_sha256").alias("n_hashes"), F.count(F.when(same, 1)).alias("n_equal"))


def _settle_sql(lag: int, horizon: int, tol: int, exit_from: str = "target") -> str:
    start = f"q.epoch + {lag}" if exit_from == "target" else "coalesce(e.epoch, q.epoch + %d)" % lag
    return _DEC_SQL + f""", q AS (SELECT *, epoch + {lag} AS due FROM d),
e AS (SELECT q.decision_id, q.epoch AS qe, q.stream_id, q.due, u.epoch AS e_on, u.quote AS e_q FROM q ASOF LEFT JOIN u ON q.stream_id = u.stream_id AND q.due <= u.epoch),
a AS (SELECT *, {"due" if exit_from == "target" else "coalesce(e_on, due)"} + {horizon} AS aim FROM e),
x AS (SELECT a.*, u.epoch AS x_on, u.quote AS x_q FROM a ASOF LEFT JOIN u ON a.stream_id = u.stream_id AND a.aim >= u.epoch),
z AS (SELECT *, CASE WHEN e_on IS NULL AND x_on IS NULL THEN 'no_ticks' WHEN e_on IS NULL THEN 'entry_missing' WHEN e_on - due > {tol} THEN 'entry_late' WHEN x_on IS NULL THEN 'exit_missing'
  WHEN aim - x_on > {tol} THEN 'exit_early' WHEN x_on <= e_on THEN 'not_distinct' ELSE 'ok' END AS reason FROM x)"""


def settled(spark: SparkSession, sf: str, lag: int, exit_from: str = "target") -> DataFrame:
    """Decisions settled over 300 s."""
    return A.settle(decisions(spark, sf), ticks(spark, sf), KEY, "epoch", "tick_id", "quote", lag_s=lag, horizon_s=300, tol_s=30, exit_from=exit_from)


@query(_settle_sql(1, 300, 30) + " SELECT decision_id, reason, CASE WHEN reason = 'ok' THEN round((x_q / e_q - 1) * 10000, 5) END AS fwd FROM z")
def ref_l01_settlement(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed-expiry settlement with reason codes (X2, X18, X31)."""
    return settled(spark, sf, 1).select("decision_id", "reason", F.round(F.col("fwd_ret") * 10000, 5).alias("fwd"))


@query(_settle_sql(1, 300, 30, "entry") + " SELECT reason, count(*) AS n, round(avg(CASE WHEN reason = 'ok' THEN (x_q > e_q)::INT END), 6) AS up_rate FROM z GROUP BY 1")
def ref_l01_settlement_from_entry(spark: SparkSession, sf: str) -> DataFrame:
    """The variant whose horizon starts at the actual entry."""
    return settled(spark, sf, 1, "entry").groupBy("reason").agg(F.count("*").alias("n"), F.round(F.avg((F.when(F.col("valid"), F.col("fwd_ret")) > 0).cast("int")), 6).alias("up_rate"))


_AGREE = ", ".join(f"s{k} AS ({_settle_sql(k, 300, 30)} SELECT decision_id, CASE WHEN reason = 'ok' THEN sign(x_q - e_q) END AS s FROM z)" for k in (1, 5, 15))


@query(f"WITH {_AGREE} SELECT decision_id, CASE WHEN s1.s = 1 AND s5.s = 1 AND s15.s = 1 THEN 1 WHEN s1.s = -1 AND s5.s = -1 AND s15.s = -1 THEN 0 END::INT AS agree FROM s1 JOIN s5 USING (decision_id) JOIN s15 USING (decision_id)")
def ref_l02_delay_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Label only if the settlements after 1, 5 and 15 s agree."""
    sides = [settled(spark, sf, k).select("decision_id", F.signum("fwd_ret").alias(f"s{k}")) for k in (1, 5, 15)]
    j = sides[0].join(sides[1], "decision_id").join(sides[2], "decision_id")
    every = lambda v: (F.col("s1") == v) & (F.col("s5") == v) & (F.col("s15") == v)
    return j.select("decision_id", F.when(every(1), 1).when(every(-1), 0).alias("agree"))


@query(RET_SQL + f""", v AS (SELECT stream_id, t, close, {rolled('stddev_samp(r)', 'r', 20)} * 2 / 10000 AS k, list(close) OVER w AS path, lead(t, 15) OVER (PARTITION BY stream_id ORDER BY t) - t AS span
FROM r WINDOW w AS (PARTITION BY stream_id ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)),
h AS (SELECT *, list_position(list_transform(path, lambda x: x / close - 1 >= k), true) AS up, list_position(list_transform(path, lambda x: x / close - 1 <= -k), true) AS dn FROM v WHERE span = 900 AND k > 0)
SELECT stream_id, t, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up < dn) THEN 1 WHEN dn IS NOT NULL THEN 0 ELSE (path[15] > close)::INT END AS touched, coalesce(least(up, dn), 0)::INT AS at FROM h""")
def ref_l03_triple_barrier(spark: SparkSession, sf: str) -> DataFrame:
    """First touch of two deviations up or down within 15 contiguous bars, else the end's sign."""
    r = F.col("r")
    v = returns(spark, sf).select(
        "stream_id", "t", "close", (R.rolling(F.stddev_samp("r"), r, R.span(KEY, "t", 20), 20) * 2 / 10000).alias("k"),
        F.collect_list("close").over(win().rowsBetween(1, 15)).alias("path"), (F.lead("t", 15).over(win()) - F.col("t")).alias("span"),
    ).where("span = 900 AND k > 0")
    place = lambda test: F.array_position(F.transform("path", test), True)
    h = v.withColumn("up", place(lambda x: x / F.col("close") - 1 >= F.col("k"))).withColumn("dn", place(lambda x: x / F.col("close") - 1 <= -F.col("k")))
    first_up = (F.col("up") > 0) & ((F.col("dn") == 0) | (F.col("up") < F.col("dn")))
    touched = F.when(first_up, 1).when(F.col("dn") > 0, 0).otherwise((F.col("path")[14] > F.col("close")).cast("int"))
    at = F.coalesce(F.least(F.when(F.col("up") > 0, F.col("up")), F.when(F.col("dn") > 0, F.col("dn"))), F.lit(0))
    return h.select("stream_id", "t", touched.alias("touched"), at.cast("int").alias("at"))


@query(RET_SQL + """, f AS (SELECT stream_id, t, [(lead(close, k) OVER w / close - 1) * 10000 for k in [0, 1, 2, 3, 4, 5]] AS y FROM r WINDOW w AS (PARTITION BY stream_id ORDER BY t)) SELECT 1 AS x""".replace("[(lead(close, k) OVER w / close - 1) * 10000 for k in [0, 1, 2, 3, 4, 5]]", "[0.0, " + ", ".join(f"(lead(close, {k}) OVER w / close - 1) * 10000" for k in range(1, 6)) + "]").replace("SELECT 1 AS x", "SELECT stream_id, t, round((-2.5 * y[1] - 1.5 * y[2] - 0.5 * y[3] + 0.5 * y[4] + 1.5 * y[5] + 2.5 * y[6]) / 17.5, 5) AS slope FROM f WHERE y[6] IS NOT NULL"))
def ref_l04_trend_scan(spark: SparkSession, sf: str) -> DataFrame:
    """OLS slope of the next five bars' path in closed form."""
    lead = lambda k: (F.lead("close", k).over(win()) / F.col("close") - 1) * 10000
    slope = sum((lead(k) * ((k - 2.5) / 17.5) for k in range(1, 6)), F.lit(0.0))
    return returns(spark, sf).select("stream_id", "t", F.round(slope, 5).alias("slope")).where("slope IS NOT NULL")


@query(RET_SQL + f""", v AS (SELECT stream_id, t, r, {rolled('stddev_samp(r)', 'r', 20, -1)} AS sd, lead(r) OVER (PARTITION BY stream_id ORDER BY t) AS nxt FROM r)
SELECT stream_id, t, CASE WHEN nxt > 0.5 * sd THEN 1 WHEN nxt < -0.5 * sd THEN -1 ELSE 0 END AS klass, (abs(r) > 4 * sd)::INT AS jump FROM v WHERE sd > 0 AND nxt IS NOT NULL AND r IS NOT NULL""")
def ref_l05_deadband(spark: SparkSession, sf: str) -> DataFrame:
    """Three classes with a band that follows volatility, and a jump flag."""
    v = returns(spark, sf).select("stream_id", "t", "r", R.rolling(F.stddev_samp("r"), F.col("r"), R.span(KEY, "t", 20, -1), 20).alias("sd"), F.lead("r").over(win()).alias("nxt"))
    v = v.where("sd > 0 AND nxt IS NOT NULL AND r IS NOT NULL")
    klass = F.when(F.col("nxt") > 0.5 * F.col("sd"), 1).when(F.col("nxt") < -0.5 * F.col("sd"), -1).otherwise(0)
    return v.select("stream_id", "t", klass.alias("klass"), (F.abs("r") > 4 * F.col("sd")).cast("int").alias("jump"))


@query(RET_SQL + f""", f AS (SELECT t, avg(r) AS f FROM r GROUP BY t), j AS (SELECT stream_id, t, CASE WHEN f IS NOT NULL THEN r END AS r, CASE WHEN r IS NOT NULL THEN f END AS f FROM r JOIN f USING (t))
SELECT stream_id, t, round(r - {rolled('covar_samp(r, f)', 'r', 30, -1)} / nullif({rolled('var_samp(f)', 'f', 30, -1)}, 0) * f, 5) AS resid FROM j""")
def ref_l06_residual_target(spark: SparkSession, sf: str) -> DataFrame:
    """Return less rolling beta times the basket's return."""
    r = returns(spark, sf)
    basket = r.groupBy("t").agg(F.avg("r").alias("f"))
    j = r.select("stream_id", "t", "r").join(basket, "t").withColumn("f", F.when(F.col("r").isNotNull(), F.col("f")))
    s = R.span(KEY, "t", 30, -1)
    beta = F.try_divide(R.rolling(F.covar_samp("r", "f"), F.col("r"), s, 30), R.rolling(F.var_samp("f"), F.col("f"), s, 30))
    return j.select("stream_id", "t", F.round(F.col("r") - beta * F.col("f"), 5).alias("resid"))


@query(TRAINED_SQL + """, q AS (SELECT pair, quantile_cont(abs(fwd_ret), 0.75) AS q FROM s WHERE train GROUP BY 1) SELECT row_id, (abs(fwd_ret) >= q)::INT AS large, round(pow(abs(fwd_ret) * 10000, 0.5), 6) AS weight FROM s JOIN q USING (pair)""")
def ref_l07_large_move(spark: SparkSession, sf: str) -> DataFrame:
    """Large-move label by a training quantile, and the magnitude weight (L9)."""
    s = trained(spark, sf)
    q = s.where("train").groupBy("pair").agg(F.percentile(F.abs("fwd_ret"), 0.75).alias("q"))
    return s.join(q, "pair").select("row_id", (F.abs("fwd_ret") >= F.col("q")).cast("int").alias("large"), F.round(F.pow(F.abs("fwd_ret") * 10000, F.lit(0.5)), 6).alias("weight"))


@query(RET_SQL + """ SELECT stream_id, t, round(r - avg(r) OVER (PARTITION BY t), 6) AS neutral, row_number() OVER (PARTITION BY t ORDER BY r, stream_id) AS rank FROM r WHERE r IS NOT NULL""")
def ref_l08_cross_sectional_target(spark: SparkSession, sf: str) -> DataFrame:
    """Return less the mean of its time, and its rank there."""
    w = Window.partitionBy("t")
    return returns(spark, sf).where("r IS NOT NULL").select("stream_id", "t", F.round(F.col("r") - F.avg("r").over(w), 6).alias("neutral"), F.row_number().over(w.orderBy("r", "stream_id")).cast("bigint").alias("rank"))


@query("""WITH k AS (SELECT series_id, timestamps_s // 86400 AS day, max(timestamps_s) AS at FROM observation_series GROUP BY ALL),
n AS (SELECT *, day - CASE WHEN isodow(to_timestamp(day * 86400)::TIMESTAMP) = 1 THEN 4 WHEN isodow(to_timestamp(day * 86400)::TIMESTAMP) IN (2, 7) THEN CASE WHEN isodow(to_timestamp(day * 86400)::TIMESTAMP) = 2 THEN 4 ELSE 3 END ELSE 2 END AS known FROM k)
SELECT n.series_id, n.day, n.known, k.at AS known_at FROM n LEFT JOIN k ON k.series_id = n.series_id AND k.day = n.known""")
def ref_x20_publication_lag(spark: SparkSession, sf: str) -> DataFrame:
    """The value of the second preceding weekday."""
    k = table(spark, sf, "observation_series").groupBy("series_id", F.floor(F.col("timestamps_s") / 86400).alias("day")).agg(F.max("timestamps_s").alias("at"))
    dow = F.weekday(F.timestamp_seconds(F.col("day") * 86400))  # Monday 0
    back = F.when(dow.isin(0, 1), 4).when(dow == 6, 3).otherwise(2)
    n = k.withColumn("known", F.col("day") - back)
    past = k.select("series_id", F.col("day").alias("known"), F.col("at").alias("known_at"))
    return n.join(past, ["series_id", "known"], "left").select("series_id", "day", "known", "known_at")


@query("""WITH n AS (SELECT * FROM result_files QUALIFY row_number() OVER (PARTITION BY series_id, written_at ORDER BY delivered_at DESC, file_id DESC) = 1) SELECT series_id, count(*) AS n, max(file_id) AS last_id FROM n GROUP BY 1""")
def ref_k02_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Old and new deliveries merged, the last delivery of a key kept."""
    f = table(spark, sf, "result_files").select("series_id", "written_at", "file_id", F.struct("delivered_at", "file_id").alias("seq"))
    old, new = f.where("file_id % 2 = 0"), f.where("file_id % 2 = 1")
    kept = keep_last(old.unionByName(new), ["series_id", "written_at"], "seq")
    return kept.groupBy("series_id").agg(F.count("*").alias("n"), F.max("file_id").alias("last_id"))


@query(RET_SQL + """, h AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY t) AS k FROM r), e AS (SELECT stream_id, t // 300 * 300 AS t5, arg_max(close, t) AS c5 FROM r GROUP BY ALL), l AS (SELECT stream_id, t5, lag(c5) OVER (PARTITION BY stream_id ORDER BY t5) AS done5 FROM e)
SELECT r.stream_id, r.t, l.done5 FROM r JOIN l ON l.stream_id = r.stream_id AND l.t5 = r.t // 300 * 300""")
def ref_f02_last_completed_bar(spark: SparkSession, sf: str) -> DataFrame:
    """The last completed five-minute close for every minute: a lag and an equi-join, no as-of."""
    r = returns(spark, sf)
    five = F.floor(F.col("t") / 300) * 300
    higher = r.groupBy("stream_id", five.alias("t5")).agg(F.max_by("close", "t").alias("c5"))
    done = higher.select("stream_id", "t5", F.lag("c5").over(Window.partitionBy("stream_id").orderBy("t5")).alias("done5"))
    return r.withColumn("t5", five).join(done, ["stream_id", "t5"]).select("stream_id", "t", "done5")
