"""Queries on staged sources (S), sinks (K), column selection and filters (P), audits (E29), weights and paid sides (L9, X7)."""

from __future__ import annotations

import lzma
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import asof as A
from lodestream.operators import policies as P
from lodestream.operators import selection as X
from lodestream.operators import technical as T
from lodestream.operators.bars import signed_flow, time_bars
from lodestream.operators.scan import carry_last, numbered, with_previous
from lodestream.operators.stateful import frames_by_rows
from lodestream.plans.base import BARS_SQL, SCORED_SQL, TICKS_SQL, Registry, minute_bars, scored, ticks
from lodestream.plans.features import roll
from lodestream.plans.joins import _settle_sql, decisions
from lodestream.plans.windows import KEY, win
from lodestream.runtime import shared_path, table
from lodestream.sources import readers, stores

query = Registry()


@query("SELECT tick_id, epoch * 1000000000 // 1000000000 AS epoch, quote AS price FROM ticks WHERE quote IS NOT NULL")
def ref_s04_tick_load(spark: SparkSession, sf: str) -> DataFrame:
    """Nanosecond ticks staged as Parquet, read with their seconds and place in file order."""
    path = shared_path(spark, "ticks")
    table(spark, sf, "ticks").where("quote IS NOT NULL").select("tick_id", (F.col("epoch") * 1_000_000_000 + F.coalesce(F.pmod("tick_id", F.lit(1_000_000_000)), F.lit(0))).alias("ns"), "quote").write.parquet(path)
    return readers.read_ticks(spark, path, "ns", "quote", ["tick_id"]).select("tick_id", "epoch", "price")


@query(BARS_SQL + ", n AS (SELECT max(t) AS now FROM b) SELECT t AS epoch, max(open) AS open, max(high) AS high, max(low) AS low, max(close) AS close FROM b, n WHERE stream_id = 'EURUSD:alder' AND t + 60 <= now GROUP BY t")
def ref_s05_candle_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A venue's candle history staged as API pages, one a day, without the open candle."""
    bars = minute_bars(spark, sf)
    path = shared_path(spark, "pages")
    now = bars.agg(F.max("t").alias("now"))
    one = bars.where("stream_id = 'EURUSD:alder'")
    candle = F.struct(F.col("t").alias("epoch"), "open", "high", "low", "close")
    one.groupBy(F.floor(F.col("t") / 86_400).alias("day")).agg(F.collect_list(candle).alias("candles")).join(F.broadcast(now)).select("now", "candles").write.json(path)
    return readers.candle_pages(spark, path)


@query("""WITH c AS (SELECT decision_id AS id, CASE decision_id % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'JPY' END AS ccy, CASE decision_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS vol, CASE WHEN decision_id % 7 > 0 THEN decision_id % 50 / 10 END AS actual, CASE WHEN decision_id % 5 > 0 THEN decision_id % 40 / 10 END AS consensus FROM decisions)
SELECT id, ccy AS currency, round(actual - consensus, 6) AS surprise, sign(actual - consensus)::INT * CASE ccy WHEN 'EUR' THEN 1 ELSE -1 END AS signal FROM c WHERE ccy IN ('USD', 'EUR') AND vol IN ('HIGH', 'MEDIUM') AND actual IS NOT NULL AND consensus IS NOT NULL""")
def ref_s06_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up calendar staged as JSON lines: filtered, with surprise and the signal for EURUSD."""
    i = F.col("decision_id")
    made = table(spark, sf, "decisions").select(
        i.alias("id"), F.timestamp_seconds("decision_close_epoch").cast("string").alias("dateUtc"), F.when(i % 4 == 0, "USD").when(i % 4 == 1, "EUR").when(i % 4 == 2, "JPY").alias("currencyCode"), F.lit("release").alias("name"),
        F.when(i % 3 == 0, "HIGH").when(i % 3 == 1, "MEDIUM").otherwise("LOW").alias("volatility"), F.when(i % 7 > 0, i % 50 / 10).alias("actual"), F.when(i % 5 > 0, i % 40 / 10).alias("consensus"), F.lit(None).cast("double").alias("previous"),
    )
    path = shared_path(spark, "calendar")
    made.write.json(path)
    rows = readers.calendar_events(spark, path, ["USD", "EUR"], ["HIGH", "MEDIUM"])
    return rows.select("id", F.col("currencyCode").alias("currency"), F.round("surprise", 6).alias("surprise"), (F.signum("surprise").cast("int") * F.when(F.col("currencyCode") == "EUR", 1).otherwise(-1)).alias("signal"))


@query("SELECT stream_id, venue, tol_s FROM streams")
def ref_s08_strict_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The streams staged as CSV and read with a schema that every row must match."""
    path = shared_path(spark, "csv")
    table(spark, sf, "streams").select("stream_id", "venue", "tol_s").write.option("header", True).csv(path)
    return readers.read_strict_csv(spark, path, "stream_id string, venue string, tol_s int")


@query("""SELECT stream_id, epoch // 3600 AS hour, count(*) AS n, max(round(ask * 100000)::BIGINT) AS top, min(round(bid * 100000)::BIGINT) AS bottom FROM ticks WHERE bid > 0 AND ask > 0 AND NOT isnan(bid) AND NOT isnan(ask) AND bid < 20000 AND ask < 20000 GROUP BY ALL""")
def ref_s08_bi5(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of ticks packed as compressed binary files and read again: counts and extremes in points."""
    path = shared_path(spark, "bi5")
    rows = table(spark, sf, "ticks").where("bid > 0 AND ask > 0 AND NOT isnan(bid) AND NOT isnan(ask) AND bid < 20000 AND ask < 20000")
    hours = rows.groupBy("stream_id", F.floor(F.col("epoch") / 3600).alias("hour")).agg(F.collect_list(F.struct((F.col("epoch") % 3600 * 1000).alias("ms"), F.round(F.col("ask") * 1e5).cast("int").alias("a"), F.round(F.col("bid") * 1e5).cast("int").alias("b"))).alias("x"))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            out = [lzma.compress(b"".join(struct.pack(">3i2f", int(r["ms"]), r["a"], r["b"], 1.0, 1.0) for r in x)) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["stream_id", "hour", "content"])

    packed = hours.mapInArrow(pack, "stream_id string, hour bigint, content binary")
    packed.write.parquet(path)  # a store of binary files: one a row
    read = readers.unpack_bi5(spark.read.parquet(path), ["stream_id", "hour"], "content", 1.0)
    return read.groupBy("stream_id", "hour").agg(F.count("*").alias("n"), F.max("ask").cast("bigint").alias("top"), F.min("bid").cast("bigint").alias("bottom"))


@query("SELECT stream_id, pair, venue, digits FROM streams WHERE digits IS NOT NULL")
def ref_s10_sqlite(spark: SparkSession, sf: str) -> DataFrame:
    """A SQLite file staged in the shared folder and read without writing to it, in spans of rows."""
    import sqlite3

    path = (shared_path(spark, "sqlite") + ".db").removeprefix("file://").removeprefix("file:")
    rows = [tuple(r) for r in table(spark, sf, "streams").select("stream_id", "pair", "venue", "digits").collect()]  # a fixed table
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE streams (stream_id TEXT, pair TEXT, venue TEXT, digits INTEGER)")
        con.executemany("INSERT INTO streams VALUES (?, ?, ?, ?)", rows)
    spark.dataSource.register(readers.SqliteTable)
    read = spark.read.format("sqlite_table").schema("stream_id string, pair string, venue string, digits int").option("path", path).option("table", "streams").load()
    return read.where("digits IS NOT NULL")


@query("WITH n AS (SELECT (written_at::DATE)::VARCHAR AS day, count(*) AS n FROM result_files WHERE written_at IS NOT NULL GROUP BY 1) SELECT day, n FROM n")
def ref_k01_partition_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A store by day whose partitions are replaced whole: written twice, every day is there once."""
    path = shared_path(spark, "store")
    rows = table(spark, sf, "result_files").where("written_at IS NOT NULL").select("file_id", F.date_format("written_at", "yyyy-MM-dd").alias("day"))
    stores.write_partitions(rows, path, ["day"])
    stores.write_partitions(rows.where("day < '2014-01-20'"), path, ["day"])
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("""SELECT decision_id, sha256('{"close":' || decision_close_epoch || ',"id":' || decision_id || ',"stream":"' || stream_id || '"}') AS sha FROM decisions WHERE stream_id IS NOT NULL AND decision_close_epoch IS NOT NULL""")
def ref_k08_canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of each decision's canonical JSON: names in order, no blanks."""
    d = table(spark, sf, "decisions").where("stream_id IS NOT NULL AND decision_close_epoch IS NOT NULL")
    doc = F.to_json(F.struct(F.col("decision_close_epoch").alias("close"), F.col("decision_id").alias("id"), F.col("stream_id").alias("stream")))
    return d.select("decision_id", F.sha2(doc, 256).alias("sha"))


def select_columns(columns: list[str], prefixes: tuple[str, ...] = (), regex: str | None = None, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns that begin with a prefix or match the regex (all, if neither is given), less the excluded, in order.

    An excluded name that isn't there is an error, so that a renamed column is not let in.
    """
    import re

    if missing := sorted(set(exclude) - set(columns)):
        raise ValueError(f"no such columns: {missing}")
    free = not prefixes and regex is None
    return [c for c in columns if c not in exclude and (free or c.startswith(prefixes or ("\0",)) or (regex is not None and re.search(regex, c)))]


@query("SELECT COLUMNS(lambda c: c <> 'valid' AND (starts_with(c, 'row') OR starts_with(c, 'book') OR regexp_matches(c, '^(fwd_|horizon|y$|valid)'))) FROM label_rows")
def ref_proj01_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns by prefix and regular expression, less an excluded one."""
    rows = table(spark, sf, "label_rows")
    return rows.select(*select_columns(rows.columns, ("row", "book"), "^(fwd_|horizon|y$|valid)", ("valid",)))


@query("""SELECT row_id FROM label_rows WHERE valid AND fwd_ret IS NOT NULL AND isfinite(fwd_ret) AND fwd_ret <> 0 AND datetime_utc IS NOT NULL AND hour(datetime_utc) BETWEEN 7 AND 20""")
def ref_proj02_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Valid, finite, moved rows inside a session."""
    f = F.col("fwd_ret")
    finite = f.isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf"))
    return table(spark, sf, "label_rows").where(F.col("valid") & finite & (f != 0) & F.hour("datetime_utc").between(7, 20)).select("row_id")


@query(TICKS_SQL + " SELECT d.decision_id, d.decision_close_epoch - u.epoch AS age, coalesce(d.decision_close_epoch - u.epoch <= 2, false) AS fresh FROM decisions d ASOF LEFT JOIN u ON d.stream_id = u.stream_id AND d.decision_close_epoch >= u.epoch")
def ref_proj09_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds since a stream's last usable tick, and whether it is at most two."""
    j = A.asof(decisions(spark, sf), ticks(spark, sf), KEY, "epoch", "tick_id", [])
    age = F.col("epoch") - F.col("match.on")
    return j.select("decision_id", age.alias("age"), F.coalesce(age <= 2, F.lit(False)).alias("fresh"))


@query(SCORED_SQL + """, k AS (SELECT row_id, row_number() OVER (PARTITION BY pair ORDER BY p, row_id) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM s) SELECT row_id, (i * 5 // n)::INT AS quintile FROM k""")
def ref_w21_quintile(spark: SparkSession, sf: str) -> DataFrame:
    """Quintile of the score by rank, ties in order of row."""
    s = scored(spark, sf)
    k = numbered(s, [F.col("p"), F.col("row_id")], F.floor(F.col("p") * 64), ["pair"], "i").join(F.broadcast(s.groupBy("pair").agg(F.count("*").alias("n"))), "pair")  # seven pairs
    return k.select("row_id", F.floor((F.col("i") - 1) * 5 / F.col("n")).cast("int").alias("quintile"))


@query(BARS_SQL + """, f AS (SELECT stream_id, t, lead(close, 5) OVER w / close - 1 AS fwd, lead(t, 5) OVER w - t = 300 AS contiguous FROM b WINDOW w AS (PARTITION BY stream_id ORDER BY t))
SELECT stream_id, t, CASE WHEN contiguous AND fwd <> 0 THEN (fwd > 0)::INT END AS label, coalesce(contiguous AND fwd <> 0, false) AS valid FROM f""")
def ref_f04_label_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Label of the next five bars; valid if they are contiguous and the price moved."""
    fwd = F.lead("close", 5).over(win()) / F.col("close") - 1
    f = minute_bars(spark, sf).select("stream_id", "t", fwd.alias("fwd"), (F.lead("t", 5).over(win()) - F.col("t") == 300).alias("near"))
    ok = F.coalesce(F.col("near") & (F.col("fwd") != 0), F.lit(False))
    return f.select("stream_id", "t", F.when(ok, (F.col("fwd") > 0).cast("int")).alias("label"), ok.alias("valid"))


@query("""WITH e AS (SELECT pair, hour(datetime_utc) AS h, minute(datetime_utc) // 15 AS q, abs(fwd_ret) AS m FROM label_rows WHERE datetime_utc IS NOT NULL AND fwd_ret IS NOT NULL AND isfinite(fwd_ret)),
c AS (SELECT pair, h, q, avg(m) AS m, count(*) AS n FROM e GROUP BY ALL), g AS (SELECT pair, avg(m) AS base FROM e GROUP BY 1)
SELECT pair, h::INT AS hour, q::INT AS quarter, n, round(CASE WHEN n >= 5 THEN m / base ELSE 1 END, 6) AS intensity FROM c JOIN g USING (pair)""")
def ref_f14_event_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """Mean move by quarter of an hour over the pair's mean; 1 where fewer than five rows tell."""
    f = F.col("fwd_ret")
    e = table(spark, sf, "label_rows").where(F.col("datetime_utc").isNotNull() & f.isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf")))
    cell = e.groupBy("pair", F.hour("datetime_utc").alias("hour"), F.floor(F.minute("datetime_utc") / 15).cast("int").alias("quarter")).agg(F.sum(F.abs(f)).alias("s"), F.count("*").alias("n"))
    w = Window.partitionBy("pair")  # 96 cells a pair
    base = F.sum("s").over(w) / F.sum("n").over(w)
    return cell.select("pair", "hour", "quarter", "n", F.round(F.when(F.col("n") >= 5, F.col("s") / F.col("n") / base).otherwise(1.0), 6).alias("intensity"))


_FLOW_SQL = TICKS_SQL + """, d AS (SELECT *, sign(quote - lag(quote) OVER (PARTITION BY stream_id ORDER BY epoch)) AS s FROM u), c AS (SELECT *, coalesce(last_value(nullif(s, 0) IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS f FROM d)"""


@query(_FLOW_SQL + ", m AS (SELECT stream_id, epoch // 60 * 60 AS t, sum(f)::DOUBLE AS flow, sum(abs(f))::DOUBLE AS moves FROM c GROUP BY ALL) SELECT stream_id, t, " + ", ".join(
    f"CASE WHEN count(*) OVER w{n} = {n} THEN round(sum(flow) OVER w{n} / (sum(moves) OVER w{n} + 1e-9), 6) END AS imb{n}" for n in (5, 15, 60, 240)) + " FROM m WINDOW " + ", ".join(f"w{n} AS (PARTITION BY stream_id ORDER BY t ROWS {n - 1} PRECEDING)" for n in (5, 15, 60, 240)))
def ref_f16_flow_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    """Tick-rule imbalance over 5, 15, 60 and 240 bars."""
    m = signed_flow(ticks(spark, sf), KEY, 60)
    return m.select("stream_id", "t", *[F.round(roll(F.sum("flow"), "flow", n) / (roll(F.sum("moves"), "moves", n) + 1e-9), 6).alias(f"imb{n}") for n in (5, 15, 60, 240)])


@query(_FLOW_SQL + " SELECT stream_id, epoch, tick_id, f::INT AS sign FROM c")
def ref_x13_carried_sign(spark: SparkSession, sf: str) -> DataFrame:
    """Sign of a tick's price change; over equal prices that of the last change."""
    order = [F.col("epoch")]
    s = with_previous(ticks(spark, sf), KEY, "epoch", order, ["quote"]).withColumn("s", F.signum(F.col("quote") - F.col("prev.quote")))
    return carry_last(s, KEY, "epoch", order, F.when(F.col("s") != 0, F.col("s")), "sign").select("stream_id", "epoch", "tick_id", F.coalesce(F.col("sign"), F.lit(0.0)).cast("int").alias("sign"))


@query("SELECT written_at::DATE AS day, count(*)::DOUBLE AS rate FROM result_files WHERE written_at IS NOT NULL GROUP BY 1")
def ref_x21_daily_series(spark: SparkSession, sf: str) -> DataFrame:
    """A daily series staged as CSV and parsed with a strict schema."""
    path = shared_path(spark, "daily")
    days = table(spark, sf, "result_files").where("written_at IS NOT NULL").groupBy(F.to_date("written_at").alias("day")).agg(F.count("*").cast("double").alias("rate"))
    days.write.option("header", True).csv(path)
    return readers.read_strict_csv(spark, path, "day date, rate double")


@query("""WITH l AS (SELECT row_id, pair, abs(fwd_ret) AS a FROM label_rows WHERE fwd_ret IS NOT NULL AND isfinite(fwd_ret)), m AS (SELECT pair, median(a) AS med FROM l WHERE a > 0 GROUP BY 1)
SELECT row_id, round(least(10, greatest(0.1, sqrt(a / med))), 6) AS weight FROM l JOIN m USING (pair)""")
def ref_l09_magnitude_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Sample weights: root of the move over the pair's median move, between 0.1 and 10."""
    f = F.col("fwd_ret")
    l = table(spark, sf, "label_rows").where(f.isNotNull() & ~F.isnan(f) & (F.abs(f) != float("inf"))).select("row_id", "pair", F.abs(f).alias("a"))  # noqa: E741
    # an exact median from counts per value, not from gathered rows
    med = l.where("a > 0").groupBy("pair").agg(F.percentile("a", 0.5).alias("med"))
    return l.join(F.broadcast(med), "pair").select("row_id", F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.1), F.sqrt(F.col("a") / F.col("med")))), 6).alias("weight"))


_PAID_SQL = SCORED_SQL + """, q AS (SELECT *, 1.6 + row_id * 31 % 40 / 100 AS up_pay, 1.6 + row_id * 17 % 40 / 100 AS down_pay FROM s), c AS (SELECT *, round(up_pay * 100)::BIGINT AS u, round(down_pay * 100)::BIGINT AS d FROM q)"""


def paid(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows with made-up payouts of both sides, in cents."""
    pay = lambda k: F.round((1.6 + F.pmod(F.col("row_id") * k, F.lit(40)) / 100) * 100).cast("bigint")
    return scored(spark, sf).withColumns({"u": pay(31), "d": pay(17)})


@query(_PAID_SQL + " SELECT row_id, abs(u - d) >= 5 AS eligible, sign(u - d)::INT AS side, (sign(u - d) * fwd_ret > 0)::INT AS target, round((u - d) / 100, 6) AS price_diff FROM c")
def ref_x07_better_paid_side(spark: SparkSession, sf: str) -> DataFrame:
    """The better paid side, whether it is paid clearly better, and whether it won; ties lose."""
    side = F.signum((F.col("u") - F.col("d")).cast("double"))
    return paid(spark, sf).select("row_id", (F.abs(F.col("u") - F.col("d")) >= 5).alias("eligible"), side.cast("int").alias("side"), (side * F.col("fwd_ret") > 0).cast("int").alias("target"), F.round((F.col("u") - F.col("d")) / 100, 6).alias("price_diff"))


@query(_PAID_SQL + ", w AS (SELECT row_id, pair, CASE WHEN fwd_ret > 0 THEN u ELSE d END AS w FROM c WHERE fwd_ret <> 0) SELECT row_id, round(w * 1.0 * count(*) OVER x / sum(w) OVER x, 6) AS weight FROM w WINDOW x AS (PARTITION BY pair)")
def ref_x07_profit_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of moved rows by what the winning side was paid, of mean one."""
    w = paid(spark, sf).where("fwd_ret <> 0").select("row_id", "pair", F.when(F.col("fwd_ret") > 0, F.col("u")).otherwise(F.col("d")).alias("w"))
    sums = w.groupBy("pair").agg(F.sum("w").alias("s"), F.count("*").alias("n"))
    return w.join(F.broadcast(sums), "pair").select("row_id", F.round(F.col("w") * F.col("n") / F.col("s"), 6).alias("weight"))  # seven pairs


def leaks(features, before: DataFrame, after: DataFrame, key: list[str], upto: Column) -> DataFrame:
    """(feature, n_rows, n_changed) of a feature function on an input and on one whose later rows differ.

    Only rows where `upto` holds are compared, with eqNullSafe: bit by bit, NULL as NULL.
    """
    a, b = (features(x).where(upto) for x in (before, after))
    names = [c for c in a.columns if c not in key]
    both = a.join(b.select(*key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    counts = both.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(c) for c in names])
    return counts.select("n_rows", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("feature", "n_changed"))


@query(BARS_SQL + ", m AS (SELECT (min(epoch) + max(epoch)) // 2 AS cut FROM u), n AS (SELECT count(*) AS n_rows FROM b, m WHERE t + 60 <= cut), f AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in T.TECHNICAL) + "]) AS feature) SELECT feature, n_rows, 0 AS n_changed FROM f, n")
def ref_e29_leakage_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the head of all streams, before and after all later prices are changed: none may differ."""
    whole = ticks(spark, sf)
    low, high = whole.agg(F.min("epoch"), F.max("epoch")).first()
    cut = ((low or 0) + (high or 0)) // 2
    spoiled = whole.withColumn("quote", F.when(F.col("epoch") >= cut, F.col("quote") * 1.05).otherwise(F.col("quote")))
    made = lambda u: frames_by_rows(time_bars(u, KEY, 60), "stream_id", "t", ["high", "low", "close"], 4_096, T.WARMUP, T.technical_set, T.TECHNICAL)
    return leaks(made, whole, spoiled, ["stream_id", "t"], F.col("t") + 60 <= cut)


@query("SELECT pair, 0 AS n_too_near, 0 AS n_in_both FROM label_rows WHERE datetime_utc IS NOT NULL GROUP BY 1")
def ref_e29_spacing_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Picks nearer than the horizon, and times that lie in both of two splits in order of time."""
    s = table(spark, sf, "label_rows").where("datetime_utc IS NOT NULL").select("pair", F.unix_seconds(F.col("datetime_utc").cast("timestamp")).alias("ts"), "row_id")
    picks = X.nonoverlap_chrono(s, ["pair"], "ts", "row_id", 900)
    gaps = with_previous(picks, ["pair"], "ts", [F.col("ts")], ["ts"]).groupBy("pair").agg(F.count_if(F.col("ts") - F.col("prev.ts") < 900).alias("n_too_near"))
    middle = s.groupBy("pair").agg(((F.min("ts") + F.max("ts")) / 2).alias("middle"))
    split = s.join(F.broadcast(middle), "pair").groupBy("pair", "ts").agg(F.min(F.col("ts") < F.col("middle")).alias("a"), F.max(F.col("ts") < F.col("middle")).alias("b"))
    return gaps.join(split.groupBy("pair").agg(F.count_if(F.col("a") != F.col("b")).alias("n_in_both")), "pair")


@query(_settle_sql(5, 300, 30) + " SELECT reason, count(*) AS n FROM z GROUP BY 1")
def ref_x02_settlement_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Why decisions settle or don't, five seconds after them (X2, X31)."""
    s = A.settle(decisions(spark, sf), ticks(spark, sf), KEY, "epoch", "tick_id", "quote", lag_s=5, horizon_s=300, tol_s=30)
    return s.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT stream_id, count(*) AS n, 0 AS n_added_again FROM decisions WHERE prereg_id IS NOT NULL AND decision_close_epoch IS NOT NULL AND decision_id IN (SELECT min(decision_id) FROM decisions GROUP BY prereg_id, decision_close_epoch) GROUP BY 1")
def ref_t11_enqueue(spark: SparkSession, sf: str) -> DataFrame:
    """An idempotent queue: of one natural key the first row is kept, whatever is sent again; the second run adds none."""
    d = table(spark, sf, "decisions").where("prereg_id IS NOT NULL AND decision_close_epoch IS NOT NULL").select("prereg_id", "decision_close_epoch", "decision_id", "stream_id")
    first = lambda df: df.groupBy("prereg_id", "decision_close_epoch").agg(F.min_by("stream_id", "decision_id").alias("stream_id"), F.min("decision_id").alias("decision_id"))
    queue = first(d)
    again = first(queue.unionByName(d.select(*queue.columns)))
    added = again.join(queue, ["prereg_id", "decision_close_epoch"], "left_anti").groupBy("stream_id").agg(F.count("*").alias("added"))
    return again.groupBy("stream_id").agg(F.count("*").alias("n")).join(added, "stream_id", "left").select("stream_id", "n", F.coalesce("added", F.lit(0)).alias("n_added_again"))


_LEASE = 900


@query(SCORED_SQL.replace("WITH", "WITH RECURSIVE") + f""", o AS (SELECT pair, row_id, ts, row_number() OVER (PARTITION BY pair ORDER BY ts, row_id) AS k FROM s),
g AS (SELECT pair, 0::BIGINT AS k, NULL::BIGINT AS row_id, []::BIGINT[] AS held, false AS ok FROM (SELECT DISTINCT pair FROM o)
  UNION ALL SELECT pair, k, row_id, CASE WHEN len(live) < 2 THEN list_append(live, ts + {_LEASE}) ELSE live END, len(live) < 2 FROM (SELECT o.*, list_filter(g.held, lambda u: u > o.ts) AS live FROM g JOIN o ON o.pair = g.pair AND o.k = g.k + 1))
SELECT pair, count(*) FILTER (ok) AS claimed, count(*) FILTER (NOT ok) AS refused FROM g WHERE k > 0 GROUP BY 1""")
def ref_t11_leases(spark: SparkSession, sf: str) -> DataFrame:
    """Claims under leases of fifteen minutes, two open ones a pair at most; what is expired frees its place."""
    s = scored(spark, sf).select("pair", "ts", F.lit(0.0).alias("edge"), "row_id", F.col("row_id").alias("claim"), F.lit(1).alias("sign"))
    r = P.policy_replay(s, "pair", "ts", "edge", "row_id", "claim", "sign", _LEASE, 2).join(s.select("pair", "row_id"), "row_id")
    return r.groupBy("pair").agg(F.count_if("taken").alias("claimed"), F.count_if(~F.col("taken")).alias("refused"))
