"""What the queries share: a registry, the usual inputs, and the same inputs as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import bars
from lodestream.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def no_negative_zero(sql: str) -> str:
    """sql with 0 added to every round(...): DuckDB keeps the sign of a zero, Spark does not."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, end = 0, start + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out.append(f"{sql[at:start]}(round({no_negative_zero(sql[start + 6 : end - 1])}) + 0)")
        at = end
    return "".join(out) + sql[at:]


class Registry:
    """Queries of a module by name, and the SQL of those that have one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = no_negative_zero(sql)
            return function

        return add


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable ticks."""
    return bars.usable_ticks(table(spark, sf_dir, "ticks"))


def minute_bars(spark: SparkSession, sf_dir: str, seconds: int = 60) -> DataFrame:
    """Bars per stream."""
    return bars.time_bars(ticks(spark, sf_dir), ["stream_id"], seconds)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid labels with a made-up score p: row_id, pair, ts, p, y, fwd_ret."""
    rows = table(spark, sf_dir, "label_rows")
    return rows.where("valid AND y IS NOT NULL AND fwd_ret IS NOT NULL AND NOT isnan(fwd_ret) AND datetime_utc IS NOT NULL").select(
        "row_id", "pair", F.unix_seconds(F.col("datetime_utc").cast("timestamp")).alias("ts"), (F.pmod(F.col("row_id") * 7919, F.lit(1000)) / 1000).alias("p"), "y", "fwd_ret"
    )


def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scored() with train: whether a row lies in the first half of all time."""
    rows = scored(spark, sf_dir)
    middle = rows.agg(F.floor((F.min("ts") + F.max("ts")) / 2).alias("middle"))
    return rows.join(F.broadcast(middle)).withColumn("train", F.col("ts") <= F.col("middle")).drop("middle")


def first_half(rows: DataFrame, t: str = "t") -> DataFrame:
    """The rows of the first half of all time."""
    middle = rows.agg(F.floor((F.min(t) + F.max(t)) / 2).alias("_middle"))
    return rows.join(F.broadcast(middle)).where(F.col(t) <= F.col("_middle")).drop("_middle")


#: The same as SQL, as the start of a WITH clause.
TICKS_SQL = """WITH kept AS (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY stream_id, epoch ORDER BY tick_id DESC) = 1),
u AS (SELECT stream_id, pair, epoch, tick_id, quote, CASE WHEN NOT isnan(bid) THEN bid END AS bid, CASE WHEN NOT isnan(ask) THEN ask END AS ask
      FROM kept WHERE quote IS NOT NULL AND NOT isnan(quote) AND quote > 0)"""
BARS_SQL = TICKS_SQL + """,
b AS (SELECT stream_id, epoch // 60 * 60 AS t, arg_min(quote, epoch) AS open, max(quote) AS high, min(quote) AS low, arg_max(quote, epoch) AS close, count(*) AS n FROM u GROUP BY ALL)"""
SCORED_SQL = """WITH s AS (SELECT row_id, pair, epoch(datetime_utc)::BIGINT AS ts, (row_id * 7919 % 1000) / 1000 AS p, y, fwd_ret FROM label_rows
WHERE valid AND y IS NOT NULL AND fwd_ret IS NOT NULL AND NOT isnan(fwd_ret) AND datetime_utc IS NOT NULL)"""
TRAINED_SQL = SCORED_SQL.replace("WITH s AS", "WITH s0 AS") + ", s AS (SELECT s0.*, ts <= (SELECT (min(ts) + max(ts)) // 2 FROM s0) AS train FROM s0)"
