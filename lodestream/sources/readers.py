"""Readers: bars, ticks, paged JSON, JSON lines with reject reasons, strict CSV, compressed tick files."""

from __future__ import annotations

import json
import lzma
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestream.operators.bars import keep_last


def read_bars(spark: SparkSession, path: str, ts: str, numbers: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Parquet bars of a path or glob: numbers coerced (what is none becomes NULL), rows without a
    close left out, of rows of one key and time that of the last file and row kept."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    rows = rows.select(*key, ts, *[F.col(c).try_cast("double").alias(c) for c in numbers], F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("i")).alias("_seq"))
    close = F.col("close")
    return keep_last(rows.where(close.isNotNull() & ~F.isnan(close)), [*key, ts], "_seq").drop("_seq")


def complete_days(files: DataFrame, sidecars: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(admitted, skipped) rows of files: those whose sidecar says complete, and all others."""
    done = sidecars.where(F.coalesce("complete", F.lit(False))).select(*key).distinct()
    return files.join(done, list(key), "left_semi"), files.join(done, list(key), "left_anti")


def read_ticks(spark: SparkSession, path: str, ns: str, price: str, also: Sequence[str] = ()) -> DataFrame:
    """(epoch, price, seq, *also): nanoseconds floored to seconds; seq is the place in file order, so that
    ordering by (epoch, seq) is a stable sort."""
    rows = spark.read.parquet(path)
    n, second = F.col(ns).cast("bigint"), F.lit(1_000_000_000)  # whole numbers: a double is off by up to 128 ns
    epoch = F.call_function("div", n, second) - (n % second < 0).cast("bigint")
    return rows.select(epoch.alias("epoch"), F.col(price).cast("double").alias("price"), F.monotonically_increasing_id().alias("seq"), *also)


def json_records(df: DataFrame, text: str, schema: str, rules: dict[str, Column], must_contain: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects) of JSON texts: rejects counts reasons, unreadable text being 'unreadable'.

    rules: reason -> condition that rejects a parsed record, tried in order. A text without the
    must_contain substring is not parsed and counts nowhere.
    """
    rows = df if must_contain is None else df.where(F.col(text).contains(must_contain))
    parsed = rows.withColumn("record", F.from_json(text, schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    reason = F.when(F.col(text).isNull() | F.col("record").isNull() | F.col("record._bad").isNotNull(), "unreadable")
    for name, rejects in rules.items():
        reason = reason.when(F.coalesce(rejects, F.lit(False)), name)
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def read_strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV that must match the schema: any other row fails the read."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", enforceSchema=False)


def unpack_bi5(files: DataFrame, keys: Sequence[str], content: str, point: float) -> DataFrame:
    """(*keys, ms, ask, bid, ask_vol, bid_vol) of compressed files of big-endian records (ms, ask, bid, ask size, bid size).

    An empty or unreadable file gives no rows, an incomplete last record none either.
    """
    kinds = dict(files.dtypes)
    numbers = ["ms bigint", *[f"{c} double" for c in ("ask", "bid", "ask_vol", "bid_vol")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    raw = lzma.decompress(packed) if packed else b""
                except (lzma.LZMAError, EOFError):
                    continue
                rows = np.frombuffer(raw[: len(raw) // 20 * 20], np.dtype([("ms", ">i4"), ("ask", ">i4"), ("bid", ">i4"), ("av", ">f4"), ("bv", ">f4")]))
                if len(rows):
                    own = [pa.array(batch.column(k).slice(i, 1).to_pylist() * len(rows), batch.schema.field(k).type) for k in range(len(keys))]
                    made = [rows["ms"].astype(np.int64), rows["ask"] * point, rows["bid"] * point, rows["av"].astype(float), rows["bv"].astype(float)]
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, made)], names=[*keys, "ms", "ask", "bid", "ask_vol", "bid_vol"])

    return files.select(*keys, content).mapInArrow(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + numbers))


def read_bi5(spark: SparkSession, path: str, point: float) -> DataFrame:
    """unpack_bi5 of the *.bi5 files of a folder, by path."""
    return unpack_bi5(spark.read.format("binaryFile").option("pathGlobFilter", "*.bi5").load(path), ["path"], "content", point)


def candle_pages(spark: SparkSession, path: str, granularity: int = 60) -> DataFrame:
    """Closed candles of staged API pages {now, candles: [{epoch, open, high, low, close}]} in any file system.

    The open candle of a page is left out; of one epoch the candle of the latest page counts. A page
    that isn't of this form fails the read; a candle without a field or with a text in it too.
    """
    fields = ["open", "high", "low", "close"]
    schema = "now bigint not null, candles array<struct<epoch: bigint, " + ", ".join(f"{f}: double" for f in fields) + ">>"
    pages = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = pages.select("now", F.inline("candles")).where(F.col("epoch") + granularity <= F.col("now"))
    whole = F.assert_true(F.array_contains(F.array(*[F.col(f).isNull() for f in ["epoch", *fields]]), True) == False, "a candle lacks a field")  # noqa: E712
    return keep_last(rows.withColumn("_ok", whole).where("_ok IS NULL").drop("_ok"), ["epoch"], "now").drop("now")


def calendar_events(spark: SparkSession, path: str, currencies: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Releases of a staged calendar (JSON lines) with actual and consensus, of some currencies and impacts, and their surprise.

    Rows without one of both, or of another currency or impact, are left out, as are unreadable lines.
    """
    schema = "id bigint, dateUtc string, currencyCode string, name string, volatility string, actual double, consensus double, previous double"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    kept = rows.where(F.col("currencyCode").isin(*currencies) & F.col("volatility").isin(*levels) & F.col("actual").isNotNull() & F.col("consensus").isNotNull())
    return kept.withColumn("surprise", F.col("actual") - F.col("consensus"))


class _Span(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.path, self.table, self.parts = options["path"].removeprefix("file://"), options["table"], int(options.get("parts", "4"))
        self.columns = [f.name for f in schema.fields]

    def _open(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Span(0, 0)]  # no rows
        width = -(-(high - low + 1) // self.parts)
        return [_Span(a, a + width) for a in range(low, high + 1, width)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join(f'"{c}"' for c in self.columns)
        with self._open() as con:
            yield from con.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (partition.low, partition.high))


class SqliteTable(DataSource):
    """Data source `sqlite_table`: a table of a SQLite file (options path, table, parts) opened read-only, in spans of rowid.

    The file must lie where all workers can read it, such as the shared folder. An empty table gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options), schema)


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Pages(DataSourceReader):
    def __init__(self, path: str, granularity: int) -> None:
        self.path, self.granularity = path, granularity

    def partitions(self) -> list[InputPartition]:
        return [_Page(str(p)) for p in sorted(Path(self.path).glob("*.json"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = json.loads(Path(partition.path).read_text())
        for candle in page.get("candles", []):
            epoch = int(candle["epoch"])
            if epoch + self.granularity <= int(page["now"]):  # the open candle is left out
                yield (epoch, *(float(candle[c]) for c in ("open", "high", "low", "close")))


class CandlePages(DataSource):
    """Data source `candle_pages`: a folder of staged API pages {now, candles: [{epoch, open, ...}]}.

    One partition per page; candles must have all fields as numbers, else the read fails.
    """

    @classmethod
    def name(cls) -> str:
        return "candle_pages"

    def schema(self) -> str:
        return "epoch bigint, open double, high double, low double, close double"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options["path"], int(self.options.get("granularity", "60")))
