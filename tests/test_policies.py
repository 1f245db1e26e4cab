"""Sequential rules, neighbours and streams over several micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import bars, neighbours, policies, scan
from lodestream.streaming import market


def test_neighbours_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(700, 4)), 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])], "id long, vec array<double>")
    got = neighbours.nearest_vectors(df, df.where("id < 300"), "id", "vec", 5).collect()
    for q in range(300):
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        want = np.lexsort((np.arange(700), np.round(d, 9)))[:5].tolist()
        mine = [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert np.allclose(d[mine], d[want])
    assert neighbours.nearest_vectors(df.limit(0), df.limit(0), "id", "vec", 5).count() == 0


def test_policy_replay(spark):
    rows = [("b", 0, 0.1, 1, "EUR", 1), ("b", 10, 0.9, 2, "EUR", 1), ("b", 10, 0.8, 3, "GBP", 1), ("b", 10, None, 4, "JPY", -1), ("b", 20, 0.5, 5, "CHF", 1), ("b", 900, 0.5, 6, "EUR", 1), ("b", None, 0.5, 7, "EUR", 1)]
    df = spark.createDataFrame(rows, "book string, t long, edge double, id long, pair string, sign int")
    got = {r["row_id"]: r["reason"] for r in policies.policy_replay(df, "book", "t", "edge", "id", "pair", "sign", 900, 2).collect()}
    assert got == {1: "taken", 2: "same_pair", 3: "taken", 4: "taken", 5: "sign_cap", 6: "taken"}


def test_two_looks_hold_their_level():
    a, b = policies.two_look_bounds(40, 40, 0.5, 0.05)
    rng = np.random.default_rng(2)
    x, y = rng.binomial(40, 0.5, 200_000), rng.binomial(40, 0.5, 200_000)
    assert ((x >= a) | (x + y >= b)).mean() <= 0.05


def test_residuals_and_surrogates():
    rng = np.random.default_rng(3)
    common = rng.normal(size=(400, 1))
    wide = common + 0.3 * rng.normal(size=(400, 6))
    res = policies.market_residuals(wide)
    assert abs(np.corrcoef(res[:, 0], common[:, 0])[0, 1]) < 0.2
    x = np.cumsum(rng.normal(size=256))
    assert policies.surrogate_means(x, 20, 1).shape == (20,) and (policies.surrogate_means(x, 20, 1) == policies.surrogate_means(x, 20, 1)).all()
    assert policies.adaptive_gate([1, 0]).tolist() == pytest.approx([0.1, 0.055])


def test_trailing_residuals_by_chunks(spark):
    """Against the plain walk: fits look at earlier minutes only, a missing return is 0, every minute and group counts."""
    rng = np.random.default_rng(4)
    n, k, train, step = 700, 5, 120, 10
    times = np.cumsum(rng.integers(1, 900, n)) * 60
    wide = rng.normal(size=(n, 1)) + 0.5 * rng.normal(size=(n, k))
    there = rng.random((n, k)) < 0.8
    there[:, 0] = True
    rows = [(g, f"{g}{j}", int(times[i]), float(wide[i, j])) for g in "ab" for i in range(n) for j in range(k) if there[i, j]]
    df = spark.createDataFrame(rows, "venue string, id string, t long, r double")
    got = {(r["id"], r["t"]): r["resid"] for r in policies.residuals_by_chunks(df, "venue", "id", "t", "r", train, step).collect()}
    x = np.where(there, wide, 0.0)
    assert len(got) == 2 * n * k
    for a in range(0, n, step):
        if a >= train:
            past = x[a - train : a]
            values, vectors = np.linalg.eigh(np.corrcoef(past, rowvar=False))
            keep = vectors[:, values > (1 + np.sqrt(k / train)) ** 2]
            z = x[a : a + step] / past.std(axis=0)
            want = z - z @ keep @ keep.T
        for i in range(a, min(a + step, n)):
            for j in range(k):
                mine = [got[f"{g}{j}", int(times[i])] for g in "ab"]
                assert mine == [None, None] if a < train else np.allclose(mine, want[i - a, j], atol=1e-8)


def test_gate_is_carried_over_days(spark):
    rng = np.random.default_rng(5)
    errors = {k: rng.random(900) < share for k, share in (("a", 0.05), ("b", 0.5))}
    rows = [(k, i // 2 * 3_000, i + 1_000 * (k == "b"), int(e)) for k, x in errors.items() for i, e in enumerate(x)]  # 57 rows a day, ties
    df = spark.createDataFrame(rows, "pair string, t long, id long, error int")
    got = {r["id"]: r["level"] for r in policies.gate(df, "pair", "t", "id", "error").collect()}
    for k, x in errors.items():
        assert np.allclose([got[i + 1_000 * (k == "b")] for i in range(900)], policies.adaptive_gate(x.astype(int).tolist()), atol=1e-12)


def test_hedge_weighs_by_earlier_losses(spark):
    rng = np.random.default_rng(6)
    y, p = rng.integers(0, 2, 200), rng.random((200, 2))
    df = spark.createDataFrame([("a", 2_000 * i, i, int(y[i]), float(p[i, 0]), float(p[i, 1])) for i in range(200)], "pair string, t long, id long, y int, u double, v double")
    got = {r["id"]: r["blend"] for r in policies.hedge(df, "pair", "t", "id", "y", ["u", "v"], 0.5).collect()}
    w = np.ones(2) / 2
    for i in range(200):
        w = w / w.sum()
        assert np.isclose(got[i], w @ p[i])
        w = w * np.exp(-0.5 * (p[i] - y[i]) ** 2)


def test_illegal_moves(spark):
    log = spark.createDataFrame([(1, 0, "new"), (1, 1, "claimed"), (1, 2, "sent"), (1, 3, "settled"), (2, 0, "claimed"), (3, 0, "new"), (3, 1, "sent"), (4, 0, None)], "s long, n long, st string")
    assert sorted((r["s"], r["n"]) for r in policies.illegal_moves(log, "s", "n", "st").collect()) == [(2, 0), (3, 1), (4, 0)]


def test_previous_and_carry_over_chunks(spark):
    rows = [(k, t, i, v) for k in ("a", None) for i, (t, v) in enumerate([(0, 1.0), (1, None), (7200, None), (7200, 3.0), (90_000, None)])]
    df = spark.createDataFrame(rows, "k string, t long, i long, v double")
    order = [F.col("t"), F.col("i")]
    prev = scan.with_previous(df, ["k"], "t", order, ["i", "v"]).where("k IS NULL").orderBy("i").collect()
    assert [r["prev"] and r["prev"]["i"] for r in prev] == [None, 0, 1, 2, 3]
    carried = scan.carry_last(df, ["k"], "t", order, F.col("v"), "c").where("k = 'a'").orderBy("i").collect()
    assert [r["c"] for r in carried] == [1.0, 1.0, 1.0, 3.0, 3.0]


def test_keep_last_awkward(spark):
    rows = [("a", 1, 1, "x"), ("a", 1, 2, None), ("a", 1, 2, None), (None, 1, 5, "n"), (None, 1, None, "lost"), ("b", 1, None, "gone")]
    df = spark.createDataFrame(rows, "k string, t int, seq int, extra string")
    assert {(r["k"], r["extra"]) for r in bars.keep_last(df, ["k", "t"], "seq").collect()} == {("a", None), (None, "n")}


def stream_of(spark, path, batches, schema):
    import time

    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


SCHEMA = "k string, epoch long, seq long, price double"


def test_monotone_over_batches(spark, tmp_path):
    batches = [[("a", 5, 1, 1.0), ("a", 4, 2, 1.0), ("a", 6, 3, 1.0)], [("a", 6, 4, 1.0), ("a", 9, 5, 1.0), (None, 1, 6, 1.0)], [("a", 8, 7, 1.0), ("b", 1, 8, 1.0)]]
    stream = stream_of(spark, tmp_path / "in", batches, SCHEMA)
    got = market.run_to_table(market.monotone_filter(stream, "k", "epoch", "seq"), "mono").collect()
    assert sorted((r["k"], r["epoch"]) for r in got) == [("a", 5), ("a", 6), ("a", 9), ("b", 1)]


def test_windows_close_by_watermark_and_drop_late_rows(spark, tmp_path):
    base = 1_000_000
    first = [("a", base + i, i, float(i)) for i in range(1, 61)]
    late = [("a", base + 200, 100, 1.0), ("a", base + 5, 101, 99.0)]
    end = [("", 9_000_000_000, 102, 0.0)]
    stream = stream_of(spark, tmp_path / "in", [first, late, end], SCHEMA)
    got = market.run_to_table(market.exact_windows(stream, "k", "epoch", "price", "seq", 60, 60, 40, "0 seconds"), "late").collect()
    full = {r["end_epoch"]: r for r in got if r["k"] == "a"}
    assert len(full) == 1 and next(iter(full.values()))["high"] < 99
