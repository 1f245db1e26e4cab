"""The decomposition and its ESD limits decide which readings are strays."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from lodestream.operators import spikes


def planted(n=4_000, seed=3):
    """A random walk with a daily season and strays of 60 steps; (rows, ids of the strays)."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) * 60
    v = 100 + np.cumsum(rng.uniform(-0.003, 0.003, n)) + 0.05 * np.sin(2 * np.pi * t / 86_400)
    strays = set(range(150, n - 100, 333))
    rows = [("s", i + 1, int(t[i]), float(v[i] + (0.1 if i in strays else 0))) for i in range(n)]
    return rows, {i + 1 for i in strays}


def strays(spark, rows):
    df = spark.createDataFrame(rows, "src string, row_id bigint, t bigint, v double")
    long = spikes.shard_readings(df, "tab", "src", "row_id", "t", ["v"])
    return {r["row_id"] for r in spikes.flag_readings(long).where("reason = 'stray'").collect()}, spikes.decompose(long)


def test_limits_by_plain_esd(spark):
    """The candidates are those that the textbook test finds among all remainders, their sizes rounded to bins."""
    rows, want = planted(2_800)  # too few days for a season
    got, (candidates, limits, _) = strays(spark, rows)
    assert got == want
    x, t = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    sizes = []
    for s in np.unique(t // spikes.SHARD_S):
        near = (t >= s * spikes.SHARD_S - spikes.MARGIN_S) & (t < (s + 1) * spikes.SHARD_S + spikes.MARGIN_S)
        step = spikes._usual(np.abs(np.diff(x[near]))).mean()
        sizes += list(np.abs(spikes.remainders(x[near], step) / step)[t[near] // spikes.SHARD_S == s])
    bins = np.clip(np.floor((np.log(np.maximum(sizes, 1e-9)) - spikes.BIN_LOW) / spikes.BIN_WIDTH), 0, spikes.BINS - 1)
    left, limit = sorted(np.exp(spikes.BIN_LOW + spikes.BIN_WIDTH * (bins + 0.5))), math.inf
    while len(left) > 3 and left[-1] >= 2:
        n = len(left)
        t = NormalDist().inv_cdf(1 - spikes.ALPHA / (2 * n))
        t += (t**3 + t) / (4 * (n - 2))
        if left[-1] / math.sqrt(sum(y * y for y in left) / n) > (n - 1) * t / math.sqrt((n - 2 + t * t) * n):
            limit = left[-1]
        left.pop()
    own = limits.first()
    assert abs(math.log(own["esd_steps"] / limit)) < spikes.BIN_WIDTH
    assert own["n_remainders"] == len(rows)
    assert {r["row_id"] for r in candidates.collect()} >= want


@pytest.mark.parametrize("limit", [0.0, math.inf])
def test_esd_limit_decides(spark, monkeypatch, limit):
    """Without the limit other readings are candidates; where it rejects nothing there are no strays."""
    rows, want = planted()
    _, (right, _, _) = strays(spark, rows)
    n = right.count()
    plain = spikes._esd_limit

    def forced(key, pdf):
        out = plain(key, pdf)
        out["esd_steps"] = limit
        return out

    monkeypatch.setattr(spikes, "_esd_limit", forced)
    got, (candidates, _, _) = strays(spark, rows)
    if limit:
        assert got == set() and candidates.count() == 0
    else:
        assert candidates.count() > n >= len(want)


def test_season_is_taken_off():
    """A daily season is learned from several days and bridged where a time of day was never seen."""
    season = [None] * 48
    season[10], season[12] = 1.0, 3.0
    assert spikes.season_at(np.array([10.5 * 1800, 11.5 * 1800]), season).tolist() == [1.0, 2.0]
    assert spikes.season_at(np.array([0, 5]), [None] * 48).tolist() == [0.0, 0.0]


def test_daily_season(spark):
    rows, _ = planted(10 * 1_440)
    df = spark.createDataFrame(rows, "src string, row_id bigint, t bigint, v double")
    long = spikes.shard_readings(df, "tab", "src", "row_id", "t", ["v"]).where("shard = floor(epoch / 14400)")
    season = spikes.sources(long).first()["season"]
    mid = np.array([0.05 * math.sin(2 * math.pi * (i + 0.5) / 48) for i in range(48)])
    got = np.array(season) - np.mean(season)
    assert np.abs(got - mid).max() < 0.06 and np.corrcoef(got, mid)[0, 1] > 0.6
