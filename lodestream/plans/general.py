"""Queries p2, p4, p5 and p6: drifting schemas, nested records, regular grids, faulty readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import drift, grid, shred, spikes
from lodestream.runtime import table


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = grid.readings(table(spark, sf_dir, "ticks"), "ticks", "stream_id", "tick_id", "epoch", "quote")
    closes = grid.readings(table(spark, sf_dir, "observation_series"), "observation_series", "series_id", "obs_id", "timestamps_s", "closes")
    return grid.regular_series(grid.kept_readings(ticks.unionByName(closes)), grid.session_slots(table(spark, sf_dir, "sessions")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty slots of the complete sessions' series."""
    return _grid(spark, sf_dir).where("fill_kind <> 'observed'").select("source_table", "source_id", "slot_epoch")


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole filled series."""
    return _grid(spark, sf_dir)


_P5_STATE = """
WITH readings AS (
  SELECT 'ticks' source_table, stream_id source_id, epoch, CASE WHEN isnan(quote) THEN NULL ELSE quote END AS value,
         row_number() OVER (PARTITION BY stream_id, epoch ORDER BY tick_id DESC) rn FROM ticks
  UNION ALL
  SELECT 'observation_series', series_id, timestamps_s, CASE WHEN isnan(closes) THEN NULL ELSE closes END,
         row_number() OVER (PARTITION BY series_id, timestamps_s ORDER BY obs_id DESC) FROM observation_series),
usable AS (SELECT * FROM readings WHERE rn = 1 AND value IS NOT NULL),
s AS (SELECT DISTINCT source_table, source_id, open_epoch, close_epoch, grid_s FROM sessions WHERE complete),
slots AS (SELECT *, unnest(range(open_epoch, close_epoch, grid_s::BIGINT)) AS slot_epoch FROM s),
last AS (SELECT s.source_table, s.source_id, s.open_epoch, s.open_epoch + (epoch - s.open_epoch) // grid_s * grid_s AS slot_epoch,
                arg_max(value, epoch) AS value, max(epoch) AS epoch
         FROM usable u JOIN s ON u.source_table = s.source_table AND u.source_id = s.source_id AND epoch >= open_epoch AND epoch < close_epoch
         GROUP BY ALL),
state AS (SELECT x.source_table, x.source_id, x.open_epoch, x.slot_epoch, l.value, l.epoch,
                 last_value(l.epoch IGNORE NULLS) OVER w AS past_epoch, last_value(l.value IGNORE NULLS) OVER w AS past,
                 first_value(l.value IGNORE NULLS) OVER (PARTITION BY x.source_table, x.source_id, x.open_epoch ORDER BY x.slot_epoch
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS opening
          FROM slots x LEFT JOIN last l USING (source_table, source_id, open_epoch, slot_epoch)
          WINDOW w AS (PARTITION BY x.source_table, x.source_id, x.open_epoch ORDER BY x.slot_epoch ROWS UNBOUNDED PRECEDING))
"""

P5_FOUND_SQL = _P5_STATE + "SELECT source_table, source_id, slot_epoch FROM state WHERE value IS NULL"
P5_GRID_SQL = _P5_STATE + """
SELECT source_table, source_id, open_epoch, slot_epoch, coalesce(past, opening) AS value,
       CASE WHEN value IS NOT NULL THEN 'observed' WHEN past IS NOT NULL THEN 'carried'
            WHEN opening IS NOT NULL THEN 'leading' ELSE 'missing' END AS fill_kind,
       CASE WHEN value IS NULL THEN slot_epoch - past_epoch END AS age_s FROM state"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = spikes.shard_readings(table(spark, sf_dir, "ticks"), "ticks", "stream_id", "tick_id", "epoch", ["bid", "ask"])
    closes = spikes.shard_readings(table(spark, sf_dir, "observation_series"), "observation_series", "series_id", "obs_id", "timestamps_s", ["closes"])
    return ticks.unionByName(closes)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.flag_readings(_readings(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The implausible readings, one row each."""
    return _flags(spark, sf_dir).select("source_table", "row_id", "field_name").distinct()


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings of each table and field were flagged, by reason."""
    return _flags(spark, sf_dir).groupBy("source_table", "field_name", "reason").agg(F.count("*").alias("n_flagged"))


def p6_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings that are no possible price of their source."""
    return _flags(spark, sf_dir).where("reason = 'range'").drop("reason")


def p6_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings that repeat the one before them in a run that is too long for their source."""
    return _flags(spark, sf_dir).where("reason = 'stuck'").drop("reason")


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every source is judged by: usual step, ESD limit in steps, longest normal run, and how many remainders are candidates."""
    candidates, limits, _ = spikes.decompose(_readings(spark, sf_dir))
    n = candidates.groupBy(*spikes.BY).agg(F.count("*").alias("n_candidates"), F.count_if(F.col("dev") > spikes.STRAY_STEPS * F.col("usual_step")).alias("n_strays"))
    return limits.join(n, spikes.BY, "left").select(*spikes.BY, "usual_step", "esd_steps", "run_limit", "n_remainders", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_strays", F.lit(0)).alias("n_strays"))


_P6_KEPT = """
WITH long AS (
  SELECT 'ticks' source_table, stream_id source_id, tick_id row_id, epoch, unnest([{'f': 'bid', 'v': bid}, {'f': 'ask', 'v': ask}]) AS x FROM ticks
  UNION ALL SELECT 'observation_series', series_id, obs_id, timestamps_s, {'f': 'closes', 'v': closes} FROM observation_series),
k AS (SELECT source_table, source_id, x.f AS field_name, row_id, epoch, x.v AS v FROM long WHERE source_id IS NOT NULL AND epoch IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source_table, source_id, x.f, epoch ORDER BY row_id DESC) = 1),
u AS (SELECT *, epoch // 14400 AS shard FROM k WHERE v IS NOT NULL AND NOT isnan(v))
"""
P6_RANGES_SQL = _P6_KEPT + """, m AS (SELECT source_table, source_id, field_name, median(v) AS middle FROM u GROUP BY ALL)
SELECT source_table, row_id, field_name FROM u JOIN m USING (source_table, source_id, field_name) WHERE v <= 0 OR v > middle * 1.5 OR v < middle / 1.5"""
P6_STUCK_SQL = _P6_KEPT + """, p AS (SELECT *, lag(v) OVER w AS v0, lag(epoch) OVER w AS e0, lag(shard) OVER w AS s0 FROM u WINDOW w AS (PARTITION BY source_table, source_id, field_name ORDER BY epoch)),
i AS (SELECT *, sum((v0 IS NULL OR v <> v0 OR s0 <> shard)::INT) OVER w AS part, sum((v0 IS NULL OR v <> v0)::INT) OVER w AS island FROM p WINDOW w AS (PARTITION BY source_table, source_id, field_name ORDER BY epoch)),
starts AS (SELECT source_table, source_id, field_name, count(*) FILTER (v0 IS NULL OR v <> v0 OR e0 < shard * 14400 - 900) AS runs FROM p GROUP BY ALL),
parts AS (SELECT source_table, source_id, field_name, part, count(*) AS n FROM i GROUP BY ALL),
shape AS (SELECT source_table, source_id, field_name, count(*) FILTER (n >= 3) AS r3, count(*) FILTER (n >= 4) AS r4 FROM parts GROUP BY ALL),
lim AS (SELECT *, greatest(ceil(1 + ln(greatest(runs, 1) / 0.01) / -ln((r4 + 1) / (r3 + 2))), 7) AS run_limit FROM starts JOIN shape USING (source_table, source_id, field_name)),
whole AS (SELECT *, count(*) OVER (PARTITION BY source_table, source_id, field_name, island) AS total, row_number() OVER (PARTITION BY source_table, source_id, field_name, island ORDER BY epoch) AS nth FROM i)
SELECT source_table, row_id, field_name FROM whole JOIN lim USING (source_table, source_id, field_name) WHERE total > run_limit AND nth > 1"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a field between the files of a series."""
    return drift.changes(table(spark, sf_dir, "result_files")).select("file_id", "change_kind", "field_path", "old_path")


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One typed row per counting file with every field there is, the casts that failed and what they lost."""
    return drift.consistent_table(table(spark, sf_dir, "result_files"))


def p2_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many files a field's value was no value of its column's type or had no place in it."""
    return p2_table(spark, sf_dir).select(F.explode("failed_casts").alias("field")).groupBy("field").agg(F.count("*").alias("n_files"))


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many counting files every path has a value of every JSON type."""
    return drift.path_statistics(table(spark, sf_dir, "result_files"))


#: JSON has no NaN: here it is read as 0, a number as well.
_P2_FILES = r"""
WITH RECURSIVE text AS (SELECT file_id, series_id, written_at, regexp_replace(payload, '([:\[,]\s*)(NaN|-?Infinity)', '\1 0', 'g') AS t FROM result_files),
readable AS (SELECT file_id, series_id, written_at, t::JSON AS top FROM text WHERE json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT'),
counting AS (SELECT series_id, written_at, min(file_id) AS file_id FROM readable WHERE series_id IS NOT NULL AND written_at IS NOT NULL GROUP BY ALL),
walk AS (
  SELECT file_id, '' AS path, top AS val FROM readable SEMI JOIN counting USING (file_id)
  UNION ALL
  SELECT file_id, CASE WHEN path = '' THEN k ELSE path || '/' || k END, json_extract(val, '$."' || k || '"')
  FROM (SELECT file_id, path, val, unnest(json_keys(val)) AS k FROM walk WHERE json_type(val) = 'OBJECT')),
leaf AS (SELECT file_id, path, CASE json_type(val) WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind
         FROM walk WHERE path <> '' AND json_type(val) <> 'OBJECT')
"""
P2_STATISTICS_SQL = _P2_FILES + "SELECT path, kind, count(*) AS n_files FROM leaf GROUP BY ALL"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "run_records")
    return shred.occurrences(shred.latest_readable(runs, "run_key", "exported_at", "record_id", "payload"), "record_id", "payload")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object inside a counting payload with the object that holds it."""
    return shred.bridge_table(_nodes(spark, sf_dir)).where("parent_path IS NOT NULL").select("record_id", "node_path", "parent_path")


def p4_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct objects with their number of occurrences."""
    return shred.object_table(_nodes(spark, sf_dir))


def p4_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of an object with its identity, its parent's and its ordinal there."""
    return shred.bridge_table(_nodes(spark, sf_dir))


def p4_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain fields of the distinct objects."""
    return shred.leaf_table(shred.object_table(_nodes(spark, sf_dir)))


def p4_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many payloads can be read, and why the others can't."""
    return shred.readable_counts(table(spark, sf_dir, "run_records"), "payload")


def p4_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, and bridge rows whose object or parent's object isn't in the object table, or whose parent's occurrence is missing."""
    nodes = _nodes(spark, sf_dir)
    ids = shred.object_table(nodes).select(F.col("object_id").alias("known"))
    bridge = shred.bridge_table(nodes)
    lost = lambda c: bridge.where(F.col(c).isNotNull()).join(ids, F.col(c) == F.col("known"), "left_anti").agg(F.count("*").alias(f"{c}_lost"))
    places = bridge.select(F.col("record_id").alias("r"), F.col("node_path").alias("p"), F.col("object_id").alias("is"))
    held = bridge.where("parent_path IS NOT NULL").join(places, (F.col("record_id") == F.col("r")) & (F.col("parent_path") == F.col("p")), "left")
    wrong = held.agg(F.count_if(~F.col("is").eqNullSafe(F.col("parent_id"))).alias("parents_wrong"))
    return bridge.agg(F.count_if(F.col("parent_path").isNotNull()).alias("n_inner")).join(F.broadcast(lost("object_id"))).join(F.broadcast(lost("parent_id"))).join(F.broadcast(wrong))


_P4_WALK = r"""
WITH RECURSIVE text AS (SELECT record_id, run_key, exported_at, regexp_replace(payload, '([:\[,]\s*)(NaN|-?Infinity)', '\1 0', 'g') AS t FROM run_records),
readable AS (SELECT * FROM text WHERE json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT'),
chosen AS (SELECT * FROM readable QUALIFY row_number() OVER (PARTITION BY run_key ORDER BY exported_at DESC NULLS LAST, record_id DESC) = 1),
walk AS (
  SELECT record_id, '' AS path, NULL::VARCHAR AS parent, t::JSON AS val FROM chosen
  UNION ALL
  SELECT record_id, CASE WHEN path = '' THEN k ELSE path || '/' || k END, CASE WHEN json_type(val) = 'OBJECT' THEN path ELSE parent END,
         CASE WHEN json_type(c) = 'VARCHAR' AND regexp_matches(c->>'$', '^\s*[{\[]') AND json_valid(c->>'$') THEN (c->>'$')::JSON ELSE c END
  FROM (SELECT *, CASE WHEN json_type(val) = 'OBJECT' THEN json_extract(val, '$."' || k || '"') ELSE json_extract(val, '$[' || k || ']') END AS c
        FROM (SELECT *, unnest(CASE WHEN json_type(val) = 'OBJECT' THEN json_keys(val) ELSE list_transform(range(json_array_length(val)::BIGINT), lambda x: x::VARCHAR) END) AS k
              FROM walk WHERE json_type(val) IN ('OBJECT', 'ARRAY'))))
"""
P4_FOUND_SQL = _P4_WALK + "SELECT record_id, path AS node_path, parent AS parent_path FROM walk WHERE json_type(val) = 'OBJECT' AND path <> ''"
P4_INVARIANTS_SQL = _P4_WALK + "SELECT count(*) AS n_inner, 0 AS object_id_lost, 0 AS parent_id_lost, 0 AS parents_wrong FROM walk WHERE json_type(val) = 'OBJECT' AND path <> ''"

P4_READABLE_SQL = _P4_WALK.split("readable AS")[0].rstrip().rstrip(",") + """ SELECT CASE WHEN t IS NULL THEN 'missing' WHEN NOT json_valid(t) THEN 'broken' WHEN json_type(CASE WHEN json_valid(t) THEN t END) = 'OBJECT' THEN 'object' ELSE 'other' END AS readable, count(*) AS n FROM text GROUP BY 1"""

QUERIES = {"p2_found": p2_found, "p2_table": p2_table, "p2_casts": p2_casts, "p2_statistics": p2_statistics, "p4_found": p4_found, "p4_objects": p4_objects, "p4_bridge": p4_bridge, "p4_leaves": p4_leaves, "p4_readable": p4_readable, "p4_invariants": p4_invariants, "p5_found": p5_found, "p5_grid": p5_grid, "p6_found": p6_found, "p6_reasons": p6_reasons, "p6_ranges": p6_ranges, "p6_stuck": p6_stuck, "p6_limits": p6_limits}
SQL = {"p2_statistics": P2_STATISTICS_SQL, "p4_found": P4_FOUND_SQL, "p4_invariants": P4_INVARIANTS_SQL, "p4_readable": P4_READABLE_SQL, "p5_found": P5_FOUND_SQL, "p5_grid": P5_GRID_SQL, "p6_ranges": P6_RANGES_SQL, "p6_stuck": P6_STUCK_SQL}
