"""As-of joins, rolling windows, grids, spikes and selection against plain implementations."""

import json
import lzma
import math
import random
import struct

import numpy as np
import pandas as pd
import pytest

from lodestream.operators import asof, bars, grid, rolling, scan, selection, spikes, stateful
from lodestream.sources import readers, stores


def test_asof_edges(spark):
    left = spark.createDataFrame([("k", 100, 1), ("k", 99, 2), ("k", 7300, 3), ("z", 5, 4), ("k", None, 5), (None, 100, 6), ("k", 10**6, 7)], "key string, ts long, id int")
    right = spark.createDataFrame([("k", 100, 1, None), ("k", 100, 2, 5.0), ("k", 50, 3, 1.0), ("k", 20_000, 4, 2.0), (None, 90, 5, 3.0), ("k", None, 6, 9.0)], "key string, ts long, seq long, v double")
    run = lambda **k: {r["id"]: r["match"] and r["match"]["seq"] for r in asof.asof(left, right, ["key"], "ts", "seq", ["v"], **k).collect()}
    assert run() == {1: 2, 2: 3, 3: 2, 4: None, 5: None, 6: None, 7: 4}
    assert run(exact=False) == {1: 3, 2: 3, 3: 2, 4: None, 5: None, 6: None, 7: 4}
    assert run(forward=True) == {1: 1, 2: 1, 3: 4, 4: None, 5: None, 6: None, 7: None}
    assert run(tolerance=49) == {1: 2, 2: 3, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert asof.asof(left.limit(0), right, ["key"], "ts", "seq", []).count() == 0
    assert asof.asof(left, right.limit(0), ["key"], "ts", "seq", []).where("match IS NULL").count() == 7


def test_settlement_ties_and_guard(spark):
    ticks = spark.createDataFrame([("k", 1, 1, 1.0), ("k", 301, 2, 1.0), ("k", 302, 3, 9.0), ("k", 1000, 4, 1.0)], "key string, ts long, seq long, price double")
    asks = spark.createDataFrame([("k", 0), ("k", 500), ("k", 990), ("q", 0)], "key string, ts long")
    got = {(r["key"], r["ts"]): (r["reason"], r["fwd_ret"]) for r in asof.settle(asks, ticks, ["key"], "ts", "seq", "price", lag_s=1, horizon_s=300, tol_s=10).collect()}
    assert got[("k", 0)] == ("ok", 0.0)  # the tie is valid, the price a second later is not seen
    assert got[("k", 500)][0] == "entry_late" and got[("q", 0)][0] == "no_ticks" and got[("k", 990)][0] == "exit_early"


@pytest.mark.parametrize("alpha", [0.05, 2 / 11, 0.6, 0.999])
def test_ewm_against_pandas(spark, alpha):
    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    df = spark.createDataFrame([("a" if i % 3 else "b", i, float(v)) for i, v in enumerate(x)], "key string, ts long, x double")
    got = rolling.ewm_adjusted(rolling.ewm(df, ["key"], "ts", "x", alpha, "y"), ["key"], "ts", "x", alpha, "z").toPandas().sort_values("ts")
    for key, g in got.groupby("key"):
        assert np.allclose(g["y"], g["x"].ewm(alpha=alpha, adjust=False).mean(), atol=1e-10)
        assert np.allclose(g["z"], g["x"].ewm(alpha=alpha, adjust=True).mean(), atol=1e-8)


def test_rolling_shape_against_pandas(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(rng.normal(size=80))], "key string, ts long, x double")
    from pyspark.sql import functions as F

    s = rolling.span(["key"], "ts", 20)
    got = df.withColumn("s", rolling.skew_corrected(F.col("x"), s, 20)).withColumn("k", rolling.kurtosis_corrected(F.col("x"), s, 20)).toPandas().sort_values("ts")
    assert np.allclose(got["s"], got["x"].rolling(20).skew(), equal_nan=True) and np.allclose(got["k"], got["x"].rolling(20).kurt(), equal_nan=True)


def test_running_total(spark):
    from pyspark.sql import functions as F

    rows = [(k, i, v) for k in ("a", None) for i, v in enumerate([3, None, 4, 4, -1])]
    df = spark.createDataFrame(rows, "key string, i int, v int")
    got = scan.running_total(df, F.col("v"), [F.col("i")], F.floor(F.col("i") / 2), ["key"]).collect()
    assert sorted((r["i"], r["running_total"]) for r in got if r["key"] is None) == [(0, 3), (1, 3), (2, 7), (3, 11), (4, 10)] and len(got) == 10
    assert scan.running_total(df.limit(0), F.col("v"), [F.col("i")], F.col("i")).count() == 0


@pytest.mark.parametrize("gap", [1, 5, 60])
def test_nonoverlap(spark, gap):
    rnd = random.Random(gap)
    rows = [(k, rnd.randrange(400), i, rnd.random()) for k in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts long, id long, conf double")
    taken, by_conf = [], []
    for k in ("a", "b", None):
        free = -1
        for _, ts, i, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            if ts >= free:
                taken.append((k, ts, i))
                free = ts + gap
        chosen = []
        for _, ts, i, _ in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[3], r[2])):
            if all(abs(ts - t) >= gap for t in chosen):
                chosen.append(ts)
                by_conf.append((k, ts, i))
    key = lambda r: (r[0] or "", r[1], r[2])
    assert sorted(map(tuple, selection.nonoverlap_chrono(df, ["key"], "ts", "id", gap).collect()), key=key) == sorted(taken, key=key)
    assert sorted(map(tuple, selection.nonoverlap_by_confidence(df, ["key"], "ts", "id", "conf", gap).collect()), key=key) == sorted(by_conf, key=key)
    assert selection.nonoverlap_chrono(df.limit(0), ["key"], "ts", "id", gap).count() == 0


def test_bootstrap_is_seeded_and_centred(spark):
    df = spark.createDataFrame([(float(i % 7), 7.0) for i in range(300)], "v double, w double").withColumnRenamed("v", "v")
    from pyspark.sql import functions as F

    df = df.withColumn("id", F.monotonically_increasing_id())
    a = selection.bootstrap_means(df, "v", "w", 200, 5).toPandas().sort_values("replicate")["mean"]
    b = selection.bootstrap_means(df.repartition(3), "v", "w", 200, 5).toPandas().sort_values("replicate")["mean"]
    assert np.allclose(a, b) and abs(a.mean() - df.toPandas()["v"].sum() / 2100) < 0.01 and a.std() > 0


def test_overfitting_extremes():
    good = pd.DataFrame(np.tile([3.0, 1.0, 0.0], (8, 1)))
    assert selection.pbo(good) == 0.0
    flip = pd.DataFrame([[1.0, -1.0], [-1.0, 1.0]] * 2)
    assert selection.pbo(flip) > 0.5


def test_grid_awkward(spark):
    ticks = spark.createDataFrame([(1, "s", 100, 1.0), (2, "s", 100, None), (3, "s", 115, 2.0), (3, "s", 115, 2.0), (4, "s", 131, float("nan")), (5, None, 120, 1.0), (6, "s", None, 1.0), (7, "u", 100, 1.0)], "id long, src string, t long, v double")
    kept = grid.kept_readings(grid.readings(ticks, "x", "src", "id", "t", "v"))

    s = spark.createDataFrame([("x", "s", 100, 150, 10, True), ("x", "s", 100, 150, 10, True), ("x", "s", 200, 210, 10, None), ("x", "none", 0, 20, 10, True), ("x", "bad", 20, 0, 10, True)], "source_table string, source_id string, open_epoch long, close_epoch long, grid_s int, complete boolean")
    got = grid.regular_series(kept, grid.session_slots(s)).orderBy("source_id", "slot_epoch").collect()
    assert [(r["source_id"], r["slot_epoch"], r["value"], r["fill_kind"], r["age_s"]) for r in got] == [
        ("none", 0, None, "missing", None), ("none", 10, None, "missing", None),
        ("s", 100, 2.0, "leading", None), ("s", 110, 2.0, "observed", None), ("s", 120, 2.0, "carried", 5), ("s", 130, 2.0, "carried", 15), ("s", 140, 2.0, "carried", 25),
    ]
    assert grid.regular_series(kept.limit(0), grid.session_slots(s.limit(0))).count() == 0


def walk(n, seed, step=1e-4):
    rng = np.random.default_rng(seed)
    return np.round(1.2 + np.cumsum(rng.normal(0, step, n)), 5)


def test_planted_spikes(spark):
    v = walk(12_000, 1)
    want = set()
    for at, size, n in ((500, 0.02, 1), (3000, -0.03, 2), (7000, 0.05, 3)):
        v[at : at + n] += size
        want |= {("stray", i) for i in range(at, at + n)}
    v[9000:] += 0.03  # a lasting move
    v[9500:9506] += 0.02  # too long for a stray
    v[2000:2040] = v[2000]
    want |= {("stuck", i) for i in range(2001, 2040)}
    v[4700:4900] = v[4700]  # runs over a shard's border
    want |= {("stuck", i) for i in range(4701, 4900)}
    for i, bad in ((6000, -1.0), (6100, 0.0), (6200, 99.0)):
        v[i] = bad
        want |= {("range", i), ("stray", i)}
    rows = [(i, "a", 1_000_000 + 3 * i, float(x), 0, "x") for i, x in enumerate(v)]
    rows += [(20_000 + i, "a", 1_000_000 + 3 * i + 1, None if i % 2 else float("nan"), 0, "x") for i in range(50)]
    rows += [(-5, "a", 1_000_000, 7.0, 0, "x"), (30_000, None, 5, 1.0, 0, "x"), (30_001, "a", None, 1.0, 0, "x"), (30_002, "one", 5, 1.0, 0, "x")] + rows[:20]
    df = spark.createDataFrame(rows, "row_id long, src string, t long, v double, bin int, kind string")
    got = spikes.flag_readings(spikes.shard_readings(df, "tab", "src", "row_id", "t", ["v"])).collect()
    assert {(r["reason"], r["row_id"]) for r in got} == want and len(got) == len(want)
    assert spikes.flag_readings(spikes.shard_readings(df.limit(0), "tab", "src", "row_id", "t", ["v"])).count() == 0


def test_range_in_a_shard_of_faults(spark):
    """Most of a whole shard is a hundred times off: judged by the source's median, not the shard's."""
    v = walk(4_000, 4)
    bad = set(range(1_500, 1_900)) - set(range(1_500, 1_900, 5))
    v[list(bad)] *= 100
    df = spark.createDataFrame([(i, "a", 14_400 * (100 + i // 500) + 28 * (i % 500), float(x)) for i, x in enumerate(v)], "row_id long, src string, t long, v double")
    got = spikes.flag_readings(spikes.shard_readings(df, "tab", "src", "row_id", "t", ["v"])).where("reason = 'range'").collect()
    assert {r["row_id"] for r in got} == bad and len(got) == len(bad)


def test_strays_in_sparse_shards(spark):
    """Departures of 28 usual steps, in shards of six to twelve readings as in a full one."""
    rows, want, at = [], set(), 0
    for shard in range(60):
        n = (600, 6, 8, 12)[shard % 4]
        for i in range(n):
            spike = n < 600 and i == n // 2
            rows.append((at, "a", 14_400 * (1_000 + shard) + 1_200 + 12_000 // n * i, 1.2 + 1e-4 * (i % 2) + (2.8e-3 if spike else 0.0)))
            want |= {at} if spike else set()
            at += 1
    df = spark.createDataFrame(rows, "row_id long, src string, t long, v double")
    got = spikes.flag_readings(spikes.shard_readings(df, "tab", "src", "row_id", "t", ["v"])).where("reason = 'stray'").collect()
    assert {r["row_id"] for r in got} == want and len(got) == len(want)


def test_block_recursions_do_not_see_the_block(spark):
    v = walk(3_000, 2, 0.5)
    df = spark.createDataFrame([("a", 60 * i, float(x)) for i, x in enumerate(v)], "key string, t long, v double")
    one = stateful.by_blocks(df, "key", "t", "v", 10**9, 0, stateful.local_trend, ["slope", "innovation"]).toPandas().sort_values("t")
    many = stateful.by_blocks(df, "key", "t", "v", 36_000, 36_000, stateful.local_trend, ["slope", "innovation"]).toPandas().sort_values("t")
    assert len(many) == 3000 and np.allclose(one["innovation"], many["innovation"], atol=1e-6)
    w = stateful.fractional_difference(v, 1.0, 1e-4)["ffd"]
    assert np.allclose(w[1:], np.diff(v))


def test_fractional_difference_has_all_weights(spark):
    w = [1.0]
    while abs(nxt := -w[-1] * (0.4 - len(w) + 1) / len(w)) >= 1e-5:
        w.append(nxt)
    assert len(w) == len(stateful.fractional_weights()) == 1458
    v = walk(2_000, 3, 0.5)
    df = spark.createDataFrame([("a", 180 * i, float(x)) for i, x in enumerate(v)], "key string, t long, v double")  # 480 rows a day
    got = stateful.by_rows(df, "key", "t", "v", 256, 1457, stateful.fractional_difference, ["ffd"]).toPandas().sort_values("t")["ffd"].to_numpy()
    want = [math.nan if i < 1457 else float(np.dot(w, v[i - 1457 : i + 1][::-1])) for i in range(2_000)]
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)


def test_play_is_carried_over_days(spark):
    """A move of more than the width on the first day stays in the state for weeks of small moves."""
    v = [0.0, 9.0] + [5.5 + 0.5 * (i % 3) for i in range(400)]
    df = spark.createDataFrame([("a", 7_200 * i, x) for i, x in enumerate(v)], "key string, t long, v double")
    centre, want = v[0], []
    for x in v:
        centre = min(max(centre, x - 2), x + 2)
        want.append(centre)
    assert np.allclose(stateful.hysteresis(df, "key", "t", "v").toPandas().sort_values("t")["play"], want)


def test_causality(spark):
    """Changing the tail leaves the head's features as they were."""
    v = walk(400, 5)
    frame = lambda x: spark.createDataFrame([("a", i, float(p)) for i, p in enumerate(x)], "key string, ts long, x double")
    changed = v.copy()
    changed[300:] *= 3
    a, b = (rolling.ewm(frame(x), ["key"], "ts", "x", 0.1, "y").where("ts < 300").toPandas().sort_values("ts")["y"].to_numpy() for x in (v, changed))
    assert (a == b).all()


def test_information_bars(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    rows = [("s", i * 700, i, 1.0 + rnd.random(), rnd.randrange(1, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "stream_id string, epoch long, tick_id long, quote double, v long")
    got = {r["bar"]: (r["n"], r["size"]) for r in bars.information_bars(df, ["stream_id"], F.col("v"), 500).collect()}
    want, cum = {}, 0
    for r in rows:
        n, s = want.get(cum // 500, (0, 0))
        want[cum // 500] = (n + 1, s + r[4])
        cum += r[4]
    assert got == want


def test_sources(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    candle = lambda e: {"epoch": e, "open": 1, "high": 2, "low": 0.5, "close": 1.5}
    (pages / "1.json").write_text(json.dumps({"now": 200, "candles": [candle(0), candle(60), candle(180)]}))
    spark.dataSource.register(readers.CandlePages)
    assert sorted(r["epoch"] for r in spark.read.format("candle_pages").option("path", str(pages)).load().collect()) == [0, 60]
    raw = struct.pack(">3i2f", 250, 120010, 120000, 1.5, 2.5)
    (tmp_path / "h.bi5").write_bytes(lzma.compress(raw))
    (tmp_path / "e.bi5").write_bytes(b"")
    row = readers.read_bi5(spark, str(tmp_path), 1e-5).first()
    assert row["ms"] == 250 and math.isclose(row["ask"], 1.2001) and row["bid_vol"] == 2.5
    (tmp_path / "x.csv").write_text("day,rate\n2020-01-01,1.5\n")
    assert readers.read_strict_csv(spark, str(tmp_path / "x.csv"), "day date, rate double").first()["rate"] == 1.5
    (tmp_path / "y.csv").write_text("day,rate\n2020-01-01,oops\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|convert"):
        readers.read_strict_csv(spark, str(tmp_path / "y.csv"), "day date, rate double").collect()
    spark.createDataFrame([(1, "1.5"), (1, "2.5"), (2, "bad")], "ts long, close string").coalesce(1).write.parquet(str(tmp_path / "bars"))
    assert [tuple(r) for r in readers.read_bars(spark, str(tmp_path / "bars"), "ts", ["close"]).collect()] == [(1, 2.5)]
    spark.createDataFrame([(1_999_999_999, 1.0)], "ns long, p double").write.parquet(str(tmp_path / "ticks"))
    assert readers.read_ticks(spark, str(tmp_path / "ticks"), "ns", "p").first()["epoch"] == 1


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "k string, t int, v double")
    new = spark.createDataFrame([("a", 2, 9.0), ("b", 1, 3.0)], "k string, t int, v double")
    assert sorted(map(tuple, stores.upsert(old, new, ["k", "t"]).collect())) == [("a", 1, 1.0), ("a", 2, 9.0), ("b", 1, 3.0)]
    stores.write_partitions(old, str(tmp_path / "p"), ["k"])
    stores.write_partitions(new.where("k = 'b'"), str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert stores.canonical_json({"b": 1, "a": [True, None]}) == '{"a":[true,null],"b":1}'
    with pytest.raises(ValueError, match="JSON"):
        stores.canonical_json({"a": float("nan")})
    assert stores.digest("ab", "c") != stores.digest("a", "bc")
