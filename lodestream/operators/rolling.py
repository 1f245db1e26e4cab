"""Row and time windows with the rules of rolling statistics: NULL until a frame holds enough values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestream.operators.scan import numbered, running_total, with_previous
from lodestream.runtime import cut


def span(key: list[str], ts: str, rows: int, end: int = 0) -> WindowSpec:
    """The frame of `rows` rows that ends `-end` rows back."""
    return Window.partitionBy(*key).orderBy(ts).rowsBetween(end - rows + 1, end)


def rolling(agg: Column, counted: Column, w: WindowSpec, at_least: int) -> Column:
    """agg over w where at least so many rows of the frame have a value, else NULL."""
    return F.when(F.count(counted).over(w) >= at_least, agg.over(w))


def correlation(x: Column, y: Column, w: WindowSpec | None = None) -> Column:
    """Correlation of x and y, which must be NULL together; NULL where either hardly varies.

    The built-in one fails on a constant side in ANSI mode.
    """
    over = lambda a: a.over(w) if w is not None else a
    vx, vy = over(F.var_pop(x)), over(F.var_pop(y))
    return F.when((vx > 1e-12) & (vy > 1e-12), over(F.covar_pop(x, y)) / F.sqrt(vx * vy))


def skew_corrected(x: Column, w: WindowSpec, n: int) -> Column:
    """Bias-corrected skewness of a full frame of n >= 3 values; NULL without variation."""
    return F.when((F.count(x).over(w) >= n) & (F.var_pop(x).over(w) > 0), F.skewness(x).over(w) * (math.sqrt(n * (n - 1)) / (n - 2)))


def kurtosis_corrected(x: Column, w: WindowSpec, n: int) -> Column:
    """Bias-corrected excess kurtosis of a full frame of n >= 4 values; NULL without variation."""
    scale = (n - 1) / ((n - 2) * (n - 3))
    return F.when((F.count(x).over(w) >= n) & (F.var_pop(x).over(w) > 0), ((n + 1) * F.kurtosis(x).over(w) + 6) * scale)


def percent_rank_of_last(x: Column, w: WindowSpec) -> Column:
    """Average percent rank of a frame's last value among the frame."""
    values = F.collect_list(x).over(w)
    less = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return (less + (equal + 1) / 2) / F.size(values)


def run_lengths(df: DataFrame, key: list[str], ts: str, sign: Column, out: str, clip: int = 50) -> DataFrame:
    """Signed length so far of the run of one sign (gaps and islands), clipped; 0 where sign is 0 or NULL.

    ts are seconds, without repetition in a key. Runs are found and counted over chunks of a day.
    """
    day = F.floor(F.col(ts) / 86_400)
    df = with_previous(df.withColumn("_s", F.coalesce(sign, F.lit(0))), key, ts, [F.col(ts)], ["_s"], out="_p", chunk_s=86_400)
    df = df.withColumn("_new", F.when(F.col("_s") == F.col("_p._s"), 0).otherwise(1)).drop("_p")
    df = running_total(df, F.col("_new"), [F.col(ts)], day, key, "_island")
    df = numbered(df, [F.col(ts)], day, [*key, "_island"], "_run")
    return df.withColumn(out, (F.least(F.col("_run"), F.lit(clip)) * F.col("_s")).cast("int")).drop("_s", "_new", "_island", "_run")


def ewm(df: DataFrame, key: list[str], ts: str, x: str, alpha: float, out: str) -> DataFrame:
    """Exponentially weighted mean y = alpha x + (1 - alpha) y_before, started at the first value.

    Block scan: rows are numbered over chunks of a day, blocks of B rows (decay over a block at most 1e-6) are summed on
    their own, and a block's start is the sum of the last four blocks' ends, beyond which weights
    are below 1e-24. No row-by-row recursion, no key in one task. ts are seconds, without repetition
    in a key. x must not be NULL; NULL rows give NULL after the rows before them are carried (drop
    them first where that is not wanted).
    """
    return ewm_set(df, key, ts, [(F.col(x), alpha, out)])


def ewm_set(df: DataFrame, key: list[str], ts: str, means: list[tuple[Column, float, str]]) -> DataFrame:
    """Several means (value, alpha, out) of rows that are numbered once; a value may be made of earlier means."""
    rows = numbered(df, [F.col(ts)], F.floor(F.col(ts) / 86_400), key, "_i").withColumn("_i", F.col("_i") - 1)
    for x, alpha, out in means:
        rows = _ewm(cut(rows), key, x, alpha, out)  # a mean reads its rows twice
    return rows.drop("_i")


def _ewm(rows: DataFrame, key: list[str], x: Column, alpha: float, out: str) -> DataFrame:
    """ewm of rows numbered by _i from 0."""
    q = 1 - alpha
    block = max(1, math.ceil(math.log(1e6) / -math.log(q))) if q > 0 else 1
    rows = rows.withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_p", F.col("_i") - F.col("_b") * block)
    weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    local = Window.partitionBy(*key, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    part = F.sum(x * weight * F.pow(F.lit(q), -F.col("_p"))).over(local) * F.pow(F.lit(q), F.col("_p"))
    rows = rows.withColumn("_u", part)
    ends = rows.groupBy(*key, "_b").agg(F.max_by("_u", "_p").alias("_end"))
    along = Window.partitionBy(*key).orderBy("_b")  # one row per block
    start = sum((F.coalesce(F.lag("_end", k).over(along), F.lit(0.0)) * F.lit(q ** (block * (k - 1))) for k in range(1, 5)), F.lit(0.0))
    starts = ends.select(*key, "_b", start.alias("_start"))
    return rows.join(starts, [*key, "_b"]).withColumn(out, F.col("_u") + F.pow(F.lit(q), F.col("_p") + 1) * F.col("_start")).drop("_b", "_p", "_u", "_start")


def ewm_adjusted(df: DataFrame, key: list[str], ts: str, x: str, alpha: float, out: str) -> DataFrame:
    """Exponentially weighted mean with weights (1 - alpha)^k that sum to one."""
    q = 1 - alpha
    rows = numbered(df, [F.col(ts)], F.floor(F.col(ts) / 86_400), key, "_i").withColumn("_i", F.col("_i") - 1)
    first = rows.where("_i = 0").select(*key, F.col(x).alias("_first"))
    plain = _ewm(rows, key, F.col(x), alpha, "_y").join(first, key)
    # y counts the first value with weight q^(n-1) instead of alpha q^(n-1)
    zero_started = F.col("_y") - F.col("_first") * F.pow(F.lit(q), F.col("_i")) * (1 - alpha)
    return plain.withColumn(out, zero_started / (1 - F.pow(F.lit(q), F.col("_i") + 1))).drop("_y", "_i", "_first")
