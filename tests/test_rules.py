"""Sequential rules, filters and blocks against hand-made and plain cases; nothing may look ahead."""

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import asof, policies, rolling, selection, stateful, technical
from lodestream.plans.supply import leaks, select_columns
from lodestream.sources import readers
from lodestream.streaming import market


def test_two_look_bounds_by_hand():
    """Four and four tosses of a fair coin: P(4 of 4) = 1/16; then P(crossing at all) by counting all 256 outcomes."""
    first, second = policies.two_look_bounds(4, 4, 0.5, 0.1, 0.0625)
    assert first == 4
    ways = [(bin(i & 15).count("1"), bin(i).count("1")) for i in range(256)]
    level = lambda k: sum(a >= first or b >= k for a, b in ways) / 256
    assert level(second) <= 0.1 < level(second - 1)
    assert policies.two_look_bounds(100, 100, 0.5, 0.5, 0.5, 2.0, 3.0) == (60, 122)  # the normal floors hold


def test_replay_over_midnight(spark):
    rows = [("b", 86_390, 0.5, 1, "EUR", 1), ("b", 86_410, 0.5, 2, "EUR", 1), ("b", 86_400 + 900, 0.5, 3, "EUR", 1), ("b", 3 * 86_400, 0.5, 4, "EUR", 1)]
    df = spark.createDataFrame(rows, "book string, t long, edge double, id long, pair string, sign int")
    got = {r["row_id"]: r["reason"] for r in policies.policy_replay(df, "book", "t", "edge", "id", "pair", "sign", 900, 2).collect()}
    assert got == {1: "taken", 2: "same_pair", 3: "taken", 4: "taken"}


@pytest.mark.parametrize("function", [
    lambda v: stateful.two_state_filter(v, rows=50, least=10), stateful.local_trend, stateful.fractional_difference, stateful.singular_spectrum, stateful.rescaled_range,
    lambda v: technical.technical_set({"high": v + 1, "low": v - 1, "close": v + 100}), lambda v: technical.indicator_set({"close": v + 100}),
])
def test_nothing_looks_ahead(function):
    """Other later values leave every earlier output as it is."""
    v = np.cumsum(np.random.default_rng(1).normal(size=200))
    other = v.copy()
    other[150:] *= 9
    for a, b in zip(function(v).values(), function(other).values()):
        assert np.array_equal(a[:150], b[:150], equal_nan=True)


def test_two_state_filter_by_hand():
    """Quartiles of 1..4 as scales, one step from the even state."""
    out = stateful.two_state_filter(np.array([1.0, 2.0, 3.0, 4.0, 2.0]), stay=0.9, rows=4, least=4)["wild"]
    lo, hi = 1.75 * math.sqrt(math.pi / 2), 3.25 * math.sqrt(math.pi / 2)
    wild, calm = (0.5 * math.exp(-0.5 * (2 / s) ** 2) / s for s in (hi, lo))
    assert np.isnan(out[:4]).all() and math.isclose(out[4], wild / (wild + calm))


def plain_picks(times, gap):
    taken, free = [], None
    for t in sorted(set(times)):
        if free is None or t >= free:
            taken.append(t)
            free = t + gap
    return taken


@pytest.mark.parametrize("dense", [True, False])
def test_picks_of_a_dense_feed(spark, dense):
    """One key without a gap, cut into small blocks: the state crosses every border."""
    rnd = random.Random(5)
    rows = [("k" if i % 3 else None, 1_000_000 + (i if dense else rnd.randrange(40_000)), i) for i in range(3_000)]
    df = spark.createDataFrame(rows, "key string, t long, id long")
    got = selection.nonoverlap_chrono(df, ["key"], "t", "id", 37, 100).collect()
    for key in ("k", None):
        assert sorted(r["t"] for r in got if r["key"] == key) == plain_picks([t for k, t, _ in rows if k == key], 37)


def test_poisson_weights():
    w = selection.poisson_weights(np.arange(4_000, dtype=np.uint64), 50, 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
    assert (selection.poisson_weights(np.arange(3, dtype=np.uint64), 50, 3) == w[:3]).all()


def test_nearest_in_one_pass(spark):
    rnd = random.Random(9)
    left = [(rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randrange(20_000)]), i) for i in range(400)]
    right = [(rnd.choice(["a", "b", None]), rnd.choice([None] + [rnd.randrange(20_000)] * 9), i) for i in range(1_500)]
    l = spark.createDataFrame(left, "k string, t long, id long")  # noqa: E741
    r = spark.createDataFrame(right, "k string, t long, seq long")
    for tol in (0, 7, 5_000):
        got = {x["id"]: x["match"]["seq"] if x["match"] else None for x in asof.nearest(l, r, ["k"], "t", "seq", [], tol).collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            near = [(abs(u - t), u > t, s) for q, u, s in right if None not in (k, t, q, u) and q == k and abs(u - t) <= tol]
            best = min(near, key=lambda x: x[:2])[:2] if near else None
            want = None if best is None else (min if best[1] else max)(s for *x, s in near if tuple(x) == best)
            assert got[i] == want, (k, t, tol)


def test_runs_and_means_over_days(spark):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(1, 9_000, 300))
    v = np.round(rng.normal(size=300), 2)
    df = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(t, v)], "key string, t long, v double")
    runs = [r["run"] for r in rolling.run_lengths(df, ["key"], "t", F.signum("v").cast("int"), "run", 3).orderBy("t").collect()]
    want, n, was = [], 0, None
    for s in np.sign(v):
        n, was = (n + 1 if s == was else 1), s
        want.append(int(min(n, 3) * s))
    assert runs == want
    got = [r["y"] for r in rolling.ewm(df, ["key"], "t", "v", 0.3, "y").orderBy("t").collect()]
    y, plain = None, []
    for x in v:
        y = x if y is None else 0.3 * x + 0.7 * y
        plain.append(y)
    assert np.allclose(got, plain)


def test_columns_are_chosen_fail_closed():
    assert select_columns(["a", "b1", "b2", "c"], ("b",), "^c$", ("b2",)) == ["b1", "c"]
    assert select_columns(["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError, match="no such"):
        select_columns(["a"], exclude=("z",))


def test_leaks_are_seen(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "t long, v double")
    later = df.withColumn("v", F.when(F.col("t") >= 5, 100.0).otherwise(F.col("v")))
    good, bad = (lambda x: x.selectExpr("t", "sum(v) OVER (ORDER BY t) AS f")), (lambda x: x.selectExpr("t", "max(v) OVER () AS f"))
    assert leaks(good, df, later, ["t"], F.col("t") < 5).first()["n_changed"] == 0
    assert leaks(bad, df, later, ["t"], F.col("t") < 5).first()["n_changed"] == 5


def test_staged_sources(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (a INTEGER, b TEXT)")
        con.execute("CREATE TABLE none (a INTEGER)")
        con.executemany("INSERT INTO t VALUES (?, ?)", [(i, None if i % 5 == 0 else str(i)) for i in range(23)])
    spark.dataSource.register(readers.SqliteTable)
    read = lambda name, schema: spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", name).load()
    assert sorted(tuple(r) for r in read("t", "a int, b string").collect())[:2] == [(0, None), (1, "1")] and read("t", "a int").count() == 23
    assert read("none", "a int").count() == 0
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text('{"now": 200, "candles": [{"epoch": 0, "open": 1, "high": 1, "low": 1, "close": 1}, {"epoch": 180, "open": 1, "high": 1, "low": 1, "close": 1}]}')
    (pages / "2.json").write_text('{"now": 300, "candles": [{"epoch": 0, "open": 2, "high": 2, "low": 2, "close": 2}]}')
    assert [tuple(r) for r in readers.candle_pages(spark, str(pages)).collect()] == [(0, 2.0, 2.0, 2.0, 2.0)]
    (pages / "3.json").write_text('{"now": 400, "candles": [{"epoch": 60, "open": 2, "high": 2, "low": 2}]}')
    with pytest.raises(Exception, match="lacks a field"):
        readers.candle_pages(spark, str(pages)).collect()


def stream_of(spark, path, parts, schema):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_ring_sink_and_sessions_over_batches(spark, tmp_path):
    schema = "k string, epoch long, seq long, v double"
    parts = [[("a", 10, 1, 1.0), ("a", 20, 2, 2.0), ("b", 5, 3, 9.0)], [("a", 20, 4, 3.0), ("a", 26, 5, 4.0), (None, 1, 6, 1.0), ("a", 27, 7, None)]]
    ring = market.run_to_table(market.ring_buffer(stream_of(spark, tmp_path / "r", parts, schema), "k", "epoch", "seq", "v", 10), "ring", "update")
    assert [tuple(r) for r in ring.where("k = 'a'").collect()] == [("a", 26, 2, 20, 3.5)]
    sunk = {r["k"]: tuple(r)[1:] for r in market.counted_sink(stream_of(spark, tmp_path / "s", parts, schema), "sink", "k").collect()}
    assert sunk == {"a": (5, 5, 2, 0), "b": (1, 1, 1, 0), None: (1, 1, 1, 0)}
    closing = [*parts, [("", 9_000, 8, 0.0)]]
    found = market.run_to_table(market.gap_sessions(stream_of(spark, tmp_path / "g", [sum(closing, [])], schema), "k", "epoch", 6, "0 seconds"), "sessions")
    assert sorted(tuple(r) for r in found.where("k = 'a'").collect()) == [("a", 10, 10, 1), ("a", 20, 27, 4)]
