"""Implausible readings: a robust seasonal-trend decomposition per source, remainders beyond
generalised ESD limits as candidates, and separate range and constant-run checks, all relative to
the source itself.

1. JVM: the source's median, and its level in every half hour; from these the season, the median
   over days of the level at a time of day less the level around it (a trend of one day's width).
2. One pass over the readings: every (source, time shard) takes the season off and decomposes what
   remains in NumPy into a robust trend that may break - the nearer of the medians of the readings
   before and after - and a remainder. It gives a summary of fixed size (histograms of remainders,
   sums of steps, runs at the borders) and the readings with large remainders.
3. Limits come from the summed summaries: generalised ESD over the histogram of all remainders of
   the source. Readings beyond it are the candidates; the exact rule for strays then confirms them.

Runs that cross shard borders are joined from one row per border. Only shards with too few readings
for a step of their own are read again, with their source's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.runtime import cut, written

#: Seconds of one source in one shard, and of context read on both sides of it.
SHARD_S, MARGIN_S = 14_400, 900
#: Readings that make up a level, and the longest stray.
LEVEL, MAX_STRAY = 5, 3
#: Times the usual step beyond which a reading strays.
STRAY_STEPS = 25.0
#: Times the mean of the lower nine tenths beyond which a step is no normal movement.
WILD = 14.0
#: Seconds of a seasonal bucket, days that a season needs, and rounds of the robust trend.
SEASON_S, SEASON_DAYS, ROUNDS = 1_800, 3, 3
#: Remainders of more local steps are marked; those the limits of ESD leave are candidates.
MARKED = 4.0
#: Residuals are counted in bins by the logarithm of their size over the shard's usual step.
BINS, BIN_LOW, BIN_WIDTH = 192, -6.0, 0.125
#: Bins of a reading's size in a factor of e, by which sources are summed up.
CELLS = 20
#: A value is possible if it is positive and within this factor of the source's median.
RANGE_FACTOR = 1.5
#: Readings below which a shard is decomposed with the source's step: a few strays make up too much of its own.
SPARSE = 64
#: Significance of the ESD test, and the expected number of runs by chance beyond the limit.
ALPHA, CHANCE_RUNS = 0.05, 0.01
#: Runs below this length are never stuck values.
MIN_RUN = 8

_OUT = (
    "source_table string, source_id string, shard bigint, field_name string, "
    "kind string, row_id bigint, pos bigint, value double, dev double, resid double, step double, "
    "run_len bigint, touches_start boolean, touches_end boolean, run_ids array<bigint>, "
    "n bigint, sum_step double, n_step bigint, runs_3 bigint, runs_4 bigint, runs bigint, bins array<bigint>"
)
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64())}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (part.split() for part in _OUT.split(", "))])
_SEASONS = 86_400 // SEASON_S


def season_at(epoch: np.ndarray, season: list[float | None]) -> np.ndarray:
    """The season between the middles of its buckets; buckets never seen are bridged, without any it is 0."""
    known = [i for i, x in enumerate(season) if x is not None]
    if not known:
        return np.zeros(len(epoch))
    return np.interp(epoch % 86_400, [(i + 0.5) * SEASON_S for i in known], [season[i] for i in known], period=86_400)


def _side_levels(x: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The medians of the LEVEL kept readings before and after each reading; NaN where there are none."""
    at = np.flatnonzero(keep)
    padded = np.concatenate([np.full(LEVEL, np.nan), x[at], np.full(LEVEL, np.nan)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, LEVEL)
    whole = np.median(windows, axis=1)
    for k in [*range(1, LEVEL), *range(len(whole) - LEVEL, len(whole) - 1)]:  # frames that reach over an end
        some = windows[k][~np.isnan(windows[k])] if 0 <= k < len(whole) else ()
        if len(some):
            whole[k] = np.median(some)
    place = np.arange(len(x))
    return whole[np.searchsorted(at, place, "left")], whole[np.searchsorted(at, place, "right") + LEVEL]


def remainders(x: np.ndarray, step: float, odd: np.ndarray | None = None) -> np.ndarray:
    """x less its robust trend: the nearer of the levels before and after, so that lasting moves leave nothing.

    As in robust decomposition by loess, readings with a large remainder get no weight in the next
    round; impossible ones (odd) have none from the start. A reading without neighbours has the remainder 0.
    """
    odd = np.zeros(len(x), bool) if odd is None else odd
    resid = np.zeros(len(x))
    for _ in range(ROUNDS):
        before, after = (x - level for level in _side_levels(x, (np.abs(resid) <= MARKED * step) & ~odd))
        nearer = (np.abs(before) <= np.abs(after)) | np.isnan(after)
        resid = np.nan_to_num(np.where(nearer, before, after), nan=0.0, posinf=np.inf, neginf=-np.inf)
    return resid


def _usual(steps: np.ndarray, sparse: bool = False) -> np.ndarray:
    """The steps of normal movement: all up to WILD times the mean of the lower nine tenths.

    Of few steps more than a tenth may be wild: there it is the lower half, unless that doesn't move.
    """
    if not len(steps):
        return steps
    if sparse and (half := steps[steps <= np.quantile(steps, 0.5)].mean()) > 0:
        return steps[steps <= WILD * half]
    base = steps[steps <= np.quantile(steps, 0.9)].mean()
    return steps[steps <= (WILD * base if base > 0 else np.quantile(steps, 0.97))]


def _strays(v: np.ndarray, step: float, resid: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, length, deviation) of the excursions of at most MAX_STRAY readings, all of them marked.

    Readings far off go first, so that a slightly raised neighbour is not taken for a part of theirs.

    The deviation is the least distance of the readings from the level before and after them; the
    reading that follows must be nearer to the later level than half of that. Without readings
    before (after), the level after (before) alone counts, if one step makes most of the deviation.
    """
    n, found, flagged = len(v), [], np.zeros(len(v), bool)
    passes = [np.abs(resid) > bound * step for bound in (0.8 * STRAY_STEPS, MARKED)]
    for i, marked in ((i, marked) for marked in passes for i in np.flatnonzero(marked)):
        if flagged[i]:
            continue
        earlier = [v[k] for k in range(i - 1, max(-1, i - 1 - LEVEL - MAX_STRAY), -1) if not flagged[k]][:LEVEL]
        before = float(np.median(earlier)) if earlier else None
        for length in range(1, MAX_STRAY + 1):
            if i + length > n or not marked[i + length - 1] or flagged[i + length - 1]:
                break
            later = v[i + length : i + length + LEVEL]
            if len(later) == 0 and before is None:
                break
            after = float(np.median(later)) if len(later) else None
            seg = v[i : i + length]
            dev = min(float(np.min(np.abs(seg - x))) for x in (before, after) if x is not None)
            sudden = abs(v[i] - v[i - 1]) if after is None else abs(v[i + length] - v[i + length - 1])
            if before is not None and after is not None:
                sudden = dev
            if dev > 4 * step and sudden >= 0.75 * dev and (after is None or abs(v[i + length] - after) < 0.5 * dev):
                found.append((int(i), length, dev))
                flagged[i : i + length] = True
                break
    return found


def _shard(key: tuple, readings: pa.Table, known: pa.Table) -> pa.Table:
    """Summary, marked and impossible readings and runs of one field of one source in one shard.

    known: the source's median and season, and its usual step where the shard is read again for
    having too few readings; without a row in it the shard has no readings of its own.
    """
    own = dict(zip(("source_table", "source_id", "shard", "field_name"), (k.as_py() for k in key)))
    rows = _shard_rows(own["shard"], readings, known.to_pylist()[0]) if known.num_rows and readings.num_rows else []
    return pa.Table.from_pylist([row | own for row in rows], schema=_ARROW)


def _clean(readings: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(epoch, row_id, value) in order of time, of repeated times the last, without missing values."""
    epoch, ids = readings["epoch"].to_numpy(), readings["row_id"].to_numpy()
    v = readings["value"].to_numpy(zero_copy_only=False).astype(float)
    order = np.lexsort((ids, epoch))
    epoch, ids, v = epoch[order], ids[order], v[order]
    keep = np.append(epoch[1:] != epoch[:-1], True) & ~np.isnan(v)
    return epoch[keep], ids[keep], v[keep]


def _core(epoch: np.ndarray, shard: int) -> np.ndarray:
    return (epoch >= shard * SHARD_S) & (epoch < (shard + 1) * SHARD_S)


def _decomposed(epoch: np.ndarray, ids: np.ndarray, v: np.ndarray, core: np.ndarray, odd: np.ndarray, step: float, season: list[float | None]) -> tuple[dict, list[dict]]:
    """Histogram of the remainders in steps, and the marked readings, with the deviation of those that are an excursion."""
    x = v - season_at(epoch, season)
    resid = remainders(x, step, odd)
    size = np.clip((np.log(np.maximum(np.abs(resid) / step, 1e-9)) - BIN_LOW) / BIN_WIDTH, 0, BINS - 1).astype(int)
    marked = np.abs(resid) > MARKED * step
    dev = np.zeros(len(v))
    for i, n, far in _strays(v, step, resid):
        dev[i : i + n] = far
    rows = [dict(kind="marked", row_id=int(ids[k]), value=float(v[k]), dev=float(dev[k]), resid=float(resid[k]), step=step) for k in np.flatnonzero(marked & core)]
    return dict(bins=np.bincount(size[core], minlength=BINS).tolist()), rows


def _shard_rows(shard: int, readings: pa.Table, known: dict) -> list[dict]:
    epoch, ids, v = _clean(readings)
    core = _core(epoch, shard)
    if not core.any():
        return []
    middle, season = known["middle"], known["season"] or []
    odd = v <= 0 if middle is None else (v <= 0) | (v > middle * RANGE_FACTOR) | (v < middle / RANGE_FACTOR)
    least = float(max(abs(middle or 0.0) * 1e-9, 1e-300))
    if known["usual_step"] is not None:  # a sparse shard, read again
        sums, marked = _decomposed(epoch, ids, v, core, odd, known["usual_step"] or least, season)
        return [dict(kind="sums") | sums, *marked]
    sparse = len(v) < SPARSE
    usual = _usual(np.abs(np.diff(v)), sparse)
    step = float(usual.mean()) if len(usual) and usual.mean() > 0 else least
    cv, cids, cepoch = v[core], ids[core], epoch[core]
    starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]) & core)
    begin = np.flatnonzero(np.append(True, cv[1:] != cv[:-1]))
    length = np.diff(np.append(begin, len(cv)))
    sums, marked = ({}, []) if sparse else _decomposed(epoch, ids, v, core, odd, step, season)
    rows = [dict(kind="summary", n=len(v), step=step, sum_step=float(usual.sum()), n_step=len(usual), runs=len(starts), runs_3=int((length >= 3).sum()), runs_4=int((length >= 4).sum())) | sums]
    rows += marked
    rows += [dict(kind="range", row_id=int(i), value=float(x)) for i, x in zip(ids[core & odd], v[core & odd])]
    last = len(begin) - 1
    for k in np.flatnonzero((length >= MIN_RUN) | (np.arange(len(begin)) == 0) | (np.arange(len(begin)) == last)):
        at = slice(begin[k], begin[k] + length[k])
        rows.append(dict(kind="run", pos=int(cepoch[begin[k]]), value=float(cv[begin[k]]), run_len=int(length[k]), touches_start=bool(k == 0), touches_end=bool(k == last), run_ids=cids[at].tolist()))
    return rows


def _esd_limit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The size of residual, in usual steps, beyond which generalised ESD rejects.

    Works down the size-ordered bins: R_i, the bin's size over the deviation of what remains, is
    held against lambda_i; the limit is the lower edge of the lowest rejected bin above which all
    are tested. Without a rejection it is infinite.
    """
    counts = pdf.set_index("bin")["n"].reindex(range(BINS), fill_value=0).to_numpy(dtype=float)
    size = np.exp(BIN_LOW + BIN_WIDTH * (np.arange(BINS) + 0.5))
    total, limit = counts.sum(), math.inf
    left, square = total, float((counts * size**2).sum())
    for b in range(BINS - 1, -1, -1):
        if not counts[b]:
            continue
        if left < 3 or size[b] < 2:
            break
        deviation = math.sqrt(square / left)
        t = NormalDist().inv_cdf(1 - ALPHA / (2 * left))
        t += (t**3 + t) / (4 * max(left - 2, 1))  # Student's t from the normal quantile
        bound = (left - 1) * t / math.sqrt((left - 2 + t * t) * left)
        if deviation and size[b] / deviation > bound:
            limit = math.exp(BIN_LOW + BIN_WIDTH * b)
        left -= counts[b]
        square = max(square - counts[b] * size[b] ** 2, 0.0)
    return pd.DataFrame([[*key, limit, int(total)]], columns=["source_table", "source_id", "field_name", "esd_steps", "n_remainders"])


def shard_readings(df: DataFrame, source_table: str, source: str, row_id: str, epoch: str, fields: Sequence[str]) -> DataFrame:
    """Readings in long form with the shards that need them: their own, and as context a neighbour's."""
    value = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]))
    shard = lambda offset: F.floor((F.col(epoch) + offset) / SHARD_S)
    return (
        df.where(F.col(source).isNotNull() & F.col(epoch).isNotNull())
        .select(
            F.lit(source_table).alias("source_table"), F.col(source).alias("source_id"), F.col(row_id).alias("row_id"),
            F.col(epoch).alias("epoch"), value.alias("f"),
            F.array_distinct(F.array(shard(0), shard(-MARGIN_S), shard(MARGIN_S))).alias("shards"),
        )
        .select("source_table", "source_id", "row_id", "epoch", "f.field_name", "f.value", F.explode("shards").alias("shard"))
    )


BY = ["source_table", "source_id", "field_name"]
_SHARDS = ["source_table", "source_id", "shard", "field_name"]


def sources(own: DataFrame) -> DataFrame:
    """(source_table, source_id, field_name, shard, middle, season): what a shard must know of its source.

    own: readings with a value, each in its own shard. One pass counts and sums them by half hour and
    bin of size (CELLS bins for a factor of e); the rest comes from these cells. middle is the
    source's median, as the mean of the bin that holds it, NULL without a positive reading; season an
    array over times of day: the median over days of the possible readings' mean in half an hour,
    less the median of those means over a day around it. A time of day seen on fewer than
    SEASON_DAYS days has no season. One row per shard with readings.
    """
    value = F.col("value").cast("double")
    cell = F.when((value > 0) & (value < float("inf")), F.floor(F.log(value) * CELLS))
    bucket = F.floor(F.col("epoch") / SEASON_S)
    cells = written(own.groupBy(*BY, bucket.alias("bucket"), cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(value).alias("total")), "cells")
    bins = cells.where("cell IS NOT NULL").groupBy(*BY, "cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by_size = Window.partitionBy(*BY).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # bins of size, however many readings they hold
    reached = bins.withColumns({"upto": F.sum("n").over(by_size), "all": F.sum("n").over(Window.partitionBy(*BY))}).where(F.col("upto") * 2 >= F.col("all"))
    middles = written(reached.groupBy(*BY).agg(F.min_by(F.col("total") / F.col("n"), "cell").alias("middle")), "middles")
    mean = F.col("total") / F.col("n")
    possible = (mean <= F.col("middle") * RANGE_FACTOR) & (mean >= F.col("middle") / RANGE_FACTOR)
    levels = cells.join(middles, BY).where(possible).groupBy(*BY, "bucket").agg((F.sum("total") / F.sum("n")).alias("level"))
    day = Window.partitionBy(*BY).orderBy("bucket").rangeBetween(-_SEASONS // 2, _SEASONS // 2)  # buckets of time, however many readings they hold
    apart = levels.withColumn("apart", F.col("level") - F.percentile_approx("level", 0.5).over(day)).withColumn("tod", F.pmod("bucket", F.lit(_SEASONS)).cast("int"))
    season = apart.groupBy(*BY, "tod").agg(F.when(F.count("apart") >= SEASON_DAYS, F.median("apart")).alias("seasonal"))
    by_tod = season.groupBy(*BY).agg(F.map_from_entries(F.collect_list(F.struct("tod", "seasonal"))).alias("m"))
    seasons = by_tod.select(*BY, F.array(*[F.try_element_at("m", F.lit(i)) for i in range(_SEASONS)]).alias("season"))
    shards = cells.select(*BY, F.floor(F.col("bucket") * SEASON_S / SHARD_S).alias("shard")).distinct()
    return shards.join(middles.join(seasons, BY, "left"), BY, "left")


def decompose(readings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, limits, found) of shard_readings(): the seasonal-trend decomposition and its ESD limits.

    candidates: readings whose remainder is beyond the ESD limit of their source, with value, resid,
    step (the shard's usual one) and dev, the distance from both levels if they are an excursion of
    at most MAX_STRAY readings, else 0. limits: usual_step, esd_steps, run statistics per source.
    found: the shards' rows, also ranges and runs.
    """
    own = readings.where((F.col("shard") == F.floor(F.col("epoch") / SHARD_S)) & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    known = written(sources(own).withColumn("usual_step", F.lit(None).cast("double")), "sources")
    found = cut(readings.groupBy(*_SHARDS).cogroup(known.groupBy(*_SHARDS)).applyInArrow(_shard, schema=_OUT))
    summaries = found.where("kind = 'summary'")
    dense = lambda c: F.sum(F.when(F.col("n") >= SPARSE, F.col(c)))
    limits = summaries.groupBy(*BY).agg(
        # shards of few readings count only where a source has no others
        F.coalesce(dense("sum_step") / F.greatest(dense("n_step"), F.lit(1)), F.sum("sum_step") / F.greatest(F.sum("n_step"), F.lit(1))).alias("usual_step"),
        F.sum("runs").alias("runs"), F.sum("runs_3").alias("runs_3"), F.sum("runs_4").alias("runs_4"),
    )
    sparse = summaries.where(F.col("n") < SPARSE).select(*_SHARDS).join(known.drop("usual_step"), _SHARDS).join(limits.select(*BY, "usual_step"), BY)
    sparse = written(sparse, "sparse")  # few as a rule: a table knows its size
    again = cut(readings.join(sparse.select(*_SHARDS), _SHARDS).groupBy(*_SHARDS).cogroup(sparse.groupBy(*_SHARDS)).applyInArrow(_shard, schema=_OUT))
    sums = summaries.unionByName(again.where("kind = 'sums'"))
    repeat = (F.col("runs_4") + 1) / (F.col("runs_3") + 2)
    run_limit = F.ceil(1 + F.log(F.greatest(F.col("runs"), F.lit(1)) / CHANCE_RUNS) / -F.log(repeat))
    esd = (
        sums.select(*BY, F.posexplode("bins").alias("bin", "n"))
        .groupBy(*BY, "bin").agg(F.sum("n").alias("n"))
        .groupBy(*BY).applyInPandas(_esd_limit, "source_table string, source_id string, field_name string, esd_steps double, n_remainders bigint")
    )
    limits = cut(limits.withColumn("run_limit", F.greatest(run_limit, F.lit(MIN_RUN - 1))).join(esd, BY, "left"))
    marked = found.unionByName(again).where("kind = 'marked'").select(*BY, "row_id", "value", "dev", "resid", "step")
    candidates = marked.join(limits.select(*BY, "esd_steps", "usual_step"), BY).where(F.abs("resid") > F.col("esd_steps") * F.col("step"))
    return candidates, limits, found


def flag_readings(readings: DataFrame) -> DataFrame:
    """(source_table, row_id, field_name, reason) of the implausible readings of shard_readings().

    Of rows of one source and epoch only that with the largest row_id is judged; NULL and NaN are
    passed over. Reasons: `range` (not positive, or far off the source's median), `stray` (a
    candidate of decompose() that is an excursion of at most MAX_STRAY readings by more than
    STRAY_STEPS usual steps of the source), `stuck`; a reading has one row for each that holds. A
    source with a single reading has no usual movement: only the range check (value <= 0) can flag
    it. Repeated rows count once, an empty table gives no rows.
    """
    by = BY
    candidates, limits, found = decompose(readings)
    strays = candidates.where(F.col("dev") > STRAY_STEPS * F.col("usual_step")).select("source_table", "row_id", "field_name", F.lit("stray").alias("reason"))
    ranges = found.where("kind = 'range'").select("source_table", "row_id", "field_name", F.lit("range").alias("reason"))
    along = Window.partitionBy(*by).orderBy("shard", "pos")
    runs = found.where("kind = 'run'").select(*by, "shard", "pos", "value", "run_len", "touches_start", "touches_end", "run_ids")
    joins = F.col("touches_start") & F.lag("touches_end").over(along) & (F.col("value") == F.lag("value").over(along))
    island = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(along)
    whole = Window.partitionBy(*by, "island")
    stuck = (
        runs.withColumn("island", island)
        .withColumn("total", F.sum("run_len").over(whole))
        .withColumn("nth", F.row_number().over(whole.orderBy("shard", "pos")))
        .join(limits.select(*by, "run_limit"), by)
        .where(F.col("total") > F.col("run_limit"))
        .select("source_table", "field_name", "nth", F.posexplode("run_ids").alias("at", "row_id"))
        .where((F.col("nth") > 1) | (F.col("at") > 0))
        .select("source_table", "row_id", "field_name", F.lit("stuck").alias("reason"))
    )
    return strays.unionByName(ranges).unionByName(stuck)
