"""Queries on sources and stores (S, K, X30)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.bars import keep_last
from lodestream.plans.base import BARS_SQL, Registry, minute_bars
from lodestream.runtime import shared_path, table
from lodestream.sources import readers, stores

query = Registry()


@query("""SELECT series_id, timestamps_s, closes FROM observation_series WHERE closes IS NOT NULL AND NOT isnan(closes) QUALIFY row_number() OVER (PARTITION BY series_id, timestamps_s ORDER BY obs_id DESC) = 1""")
def ref_s01_dedup_read(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a value, of each series and time the last."""
    rows = table(spark, sf, "observation_series").where("closes IS NOT NULL AND NOT isnan(closes)")
    return keep_last(rows.select("series_id", "timestamps_s", "obs_id", "closes"), ["series_id", "timestamps_s"], "obs_id").drop("obs_id")


@query("""SELECT series_id, written_at AS at, file_id FROM result_files WHERE written_at >= TIMESTAMP '2014-01-10' AND written_at < TIMESTAMP '2014-01-20'""")
def ref_s02_pruned_read(spark: SparkSession, sf: str) -> DataFrame:
    """A projection and a time filter that reach the scan."""
    f = table(spark, sf, "result_files").where("written_at >= TIMESTAMP_NTZ '2014-01-10' AND written_at < TIMESTAMP_NTZ '2014-01-20'")
    return f.select("series_id", F.col("written_at").alias("at"), "file_id")


@query("""SELECT source_table, source_id, open_epoch, bool_or(coalesce(complete, false)) AS admitted FROM sessions GROUP BY ALL""")
def ref_s03_complete_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions admitted by their completeness mark, and the skipped ones."""
    s = table(spark, sf, "sessions")
    key = ["source_table", "source_id", "open_epoch"]
    days = s.select(*key).distinct()
    yes, no = readers.complete_days(days, s, key)
    return yes.withColumn("admitted", F.lit(True)).unionByName(no.withColumn("admitted", F.lit(False)))


@query("""WITH j AS (SELECT TRY_CAST(json_extract_string(row_json, '$.p_up') AS DOUBLE) AS p, TRY_CAST(json_extract_string(row_json, '$.thr') AS DOUBLE) AS thr FROM decisions WHERE contains(row_json, 'p_up'))
SELECT CASE WHEN p IS NULL THEN 'no_score' WHEN abs(p - 0.5) < thr THEN 'below_threshold' ELSE 'accepted' END AS outcome, count(*) AS n FROM j GROUP BY 1""")
def ref_s07_json_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """JSON records with the reasons why they were rejected."""
    p, thr = F.col("record.p_up"), F.col("record.thr")
    good, bad = readers.json_records(table(spark, sf, "decisions"), "row_json", "p_up double, thr double", {"no_score": p.isNull(), "below_threshold": F.abs(p - 0.5) < thr}, "p_up")
    return bad.withColumnRenamed("reason", "outcome").unionByName(good.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("outcome"), "n").where("n > 0"))


@query("""WITH k AS (SELECT * FROM observation_series QUALIFY row_number() OVER (PARTITION BY series_id, timestamps_s ORDER BY obs_id DESC) = 1) SELECT series_id, count(*) AS n, max(obs_id) AS last_id FROM k GROUP BY 1""")
def ref_k03_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """Shards written, compacted and read again."""
    rows = table(spark, sf, "observation_series").select("series_id", "timestamps_s", "obs_id", "closes")
    base = shared_path(spark, "compact")
    for i in range(3):
        rows.where(F.col("obs_id") % 3 == i).write.parquet(f"{base}/shards/{i}")
    stores.compact(spark, f"{base}/shards", f"{base}/out", ["series_id", "timestamps_s"], "obs_id")
    return spark.read.parquet(f"{base}/out").groupBy("series_id").agg(F.count("*").alias("n"), F.max("obs_id").alias("last_id"))


@query("""WITH c AS (SELECT series_id, timestamps_s AS t, count(*) AS copies FROM observation_series WHERE timestamps_s + 10 <= 1388999000 GROUP BY ALL), g AS (SELECT *, t - lag(t) OVER (PARTITION BY series_id ORDER BY t) AS gap FROM c)
SELECT series_id, sum(copies)::BIGINT AS n_rows, 1388999000 - max(t) - 10 AS stale_s, (sum(copies) - count(*))::BIGINT AS duplicates, count(*) FILTER (gap > 10) AS gaps, coalesce(max(gap), 0) AS max_gap, 1388999000 - max(t) - 10 <= 120 AND sum(copies) = count(*) AS healthy FROM g GROUP BY 1""")
def ref_k05_store_health(spark: SparkSession, sf: str) -> DataFrame:
    """Health of the observation store as of a given second."""
    return stores.store_health(table(spark, sf, "observation_series"), "series_id", "timestamps_s", 10, 1_388_999_000, 120)


@query(BARS_SQL + """, o AS (SELECT stream_id, t, close FROM b), x AS (SELECT a.stream_id, a.t, a.close AS ca, round(a.close, 4) AS cb, row_number() OVER (PARTITION BY a.stream_id ORDER BY a.t DESC) AS k FROM o a) SELECT stream_id, count(*) AS n_common, count(*) FILTER (ca <> cb) AS n_differ FROM x WHERE k <= 50 GROUP BY 1""")
def ref_k06_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """The last 50 common bars of a store and a rounded copy of it."""
    b = minute_bars(spark, sf)
    return stores.reconcile(b, b.withColumn("close", F.round("close", 4)), "stream_id", "t", "close", 50)


@query()
def ref_k07_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Size and SHA-256 of the fixed tables' files."""
    return stores.manifest(spark, f"{sf}/streams.parquet").unionByName(stores.manifest(spark, f"{sf}/split_targets.parquet"))


#: Tables of a build and the columns that no row may lack.
_BUILD = {"ticks": "tick_id", "observation_series": "obs_id", "decisions": "decision_id", "sessions": "session_id", "label_rows": "row_id", "result_files": "file_id", "run_records": "record_id", "documents": "doc_id", "streams": "stream_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_ids, count(*) - count({c}) AS n_without_id FROM {t}" for t, c in _BUILD.items()))
def ref_k07_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, distinct ids and missing ids of every table of a build."""
    parts = [table(spark, sf, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows"), F.countDistinct(c).alias("n_ids"), F.count_if(F.col(c).isNull()).alias("n_without_id")) for t, c in _BUILD.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("""SELECT pair, count(*) AS n_rows, count(*) FILTER (y IS NULL) AS no_label, count(*) FILTER (y NOT IN (0, 1)) AS odd_label, round(avg(y) FILTER (y IN (0, 1)), 6) AS up_rate, count(*) FILTER (valid AND y IS NOT NULL AND fwd_ret IS NOT NULL AND NOT isnan(fwd_ret) AND fwd_ret <> 0 AND (y = 1) <> (fwd_ret > 0)) AS contrary FROM label_rows GROUP BY 1""")
def ref_k07_label_sanity(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of a build: missing, odd, their rate, and those that contradict their return."""
    y, f = F.col("y"), F.col("fwd_ret")
    moved = F.col("valid") & y.isNotNull() & f.isNotNull() & ~F.isnan(f) & (f != 0)
    return table(spark, sf, "label_rows").groupBy("pair").agg(
        F.count("*").alias("n_rows"), F.count_if(y.isNull()).alias("no_label"), F.count_if(~y.isin(0, 1)).alias("odd_label"), F.round(F.avg(F.when(y.isin(0, 1), y)), 6).alias("up_rate"), F.count_if(moved & ((y == 1) != (f > 0))).alias("contrary"),
    )


@query("""SELECT source_table, source_id, open_epoch, close_epoch FROM sessions s WHERE EXISTS (SELECT 1 FROM decisions d WHERE d.decision_close_epoch - 300 <= s.close_epoch AND d.decision_close_epoch >= s.open_epoch) GROUP BY ALL""")
def ref_x30_all_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as shards: those that overlap the interval before any decision."""
    wanted = table(spark, sf, "decisions").select((F.col("decision_close_epoch") - 300).alias("start"), F.col("decision_close_epoch").alias("stop"))
    index = table(spark, sf, "sessions").select("source_table", "source_id", "open_epoch", "close_epoch")
    return stores.prune_shards(index, wanted, "open_epoch", "close_epoch")
