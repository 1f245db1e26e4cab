"""The flagship: ticks to bars, features, labels, a session mask, selection, non-overlap and win rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import rolling as R
from lodestream.operators import selection as X
from lodestream.plans.base import Registry
from lodestream.plans.windows import KEY, RET_SQL, returns, rolled, win

query = Registry()


@query(RET_SQL.replace("WITH kept", "WITH RECURSIVE kept", 1) + f""", f AS (SELECT stream_id, t, (r - {rolled('avg(r)', 'r', 5, -1)}) / ({rolled('stddev_samp(r)', 'r', 5, -1)} + 1e-6) AS z,
  CASE WHEN lead(t, 2) OVER w - t = 120 THEN lead(close, 2) OVER w / close - 1 END AS fwd FROM r WINDOW w AS (PARTITION BY stream_id ORDER BY t)),
m AS (SELECT * FROM f WHERE z IS NOT NULL AND fwd IS NOT NULL AND hour(timezone('Europe/London', to_timestamp(t))) BETWEEN 7 AND 16),
h AS (SELECT stream_id, quantile_cont(abs(z), 0.8) AS thr FROM m GROUP BY 1), c AS (SELECT m.* FROM m JOIN h USING (stream_id) WHERE abs(z) >= thr),
pick AS (SELECT stream_id, min(t) AS t FROM c GROUP BY 1 UNION ALL SELECT pick.stream_id, (SELECT min(t) FROM c WHERE c.stream_id = pick.stream_id AND c.t >= pick.t + 120) FROM pick WHERE pick.t IS NOT NULL)
SELECT stream_id, count(*) AS n, round(avg((z * fwd < 0)::INT), 6) AS win_rate FROM pick JOIN c USING (stream_id, t) GROUP BY 1""")
def ref_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Win rate per stream of fading the most unusual bars, at most one at a time."""
    r = F.col("r")
    before = R.span(KEY, "t", 5, -1)
    z = (r - R.rolling(F.avg("r"), r, before, 5)) / (R.rolling(F.stddev_samp("r"), r, before, 5) + 1e-6)
    ahead = F.when(F.lead("t", 2).over(win()) - F.col("t") == 120, F.lead("close", 2).over(win()) / F.col("close") - 1)
    local = F.hour(F.from_utc_timestamp(F.timestamp_seconds("t"), "Europe/London"))
    m = returns(spark, sf).select("stream_id", "t", z.alias("z"), ahead.alias("fwd")).where(F.col("z").isNotNull() & F.col("fwd").isNotNull() & local.between(7, 16))
    thr = m.groupBy("stream_id").agg(F.percentile(F.abs("z"), 0.8).alias("thr"))
    c = m.join(thr, "stream_id").where(F.abs("z") >= F.col("thr")).select("stream_id", "t", "z", "fwd")
    picks = X.nonoverlap_chrono(c.withColumn("id", F.col("t")), ["stream_id"], "t", "id", 120)
    kept = picks.select("stream_id", "t").join(c, ["stream_id", "t"])
    return kept.groupBy("stream_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("z") * F.col("fwd") < 0).cast("int")), 6).alias("win_rate"))
