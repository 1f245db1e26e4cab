"""As-of joins and settlement: union both sides, take the last (first) right row by window, and
carry it over time buckets from one summary row per bucket.

Rows are grouped by key and bucket, so a key that holds most rows is many groups, and only the
bucket summaries of a key pass through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_S = 3_600


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    on: str,
    seq: str,
    payload: Sequence[str],
    *,
    forward: bool = False,
    exact: bool = True,
    tolerance: int | None = None,
    bucket_s: int = BUCKET_S,
    match: str = "match",
) -> DataFrame:
    """left with a struct `match` (on, seq, *payload) of the as-of right row, NULL if there is none.

    Backward: the last right row at or before left's `on` (before it, if not exact); forward: the
    first at or after it. Of right rows of one time the largest seq counts backward, the smallest
    forward. A right row with NULL payload still matches. Rows of the right side with NULL keys or
    time match nothing, rows of the left side keep their place. tolerance bounds the distance.
    """
    bucket = F.floor(F.col(on) / bucket_s)
    found = F.struct(F.col(on).alias("on"), F.col(seq).alias("seq"), *payload)
    keyed = F.lit(True)
    for c in [*by, on]:
        keyed = keyed & F.col(c).isNotNull()
    r = right.where(keyed).select(*by, F.col(on).alias("_on"), bucket.alias("_bucket"), found.alias("_r"))
    kind = r.schema["_r"].dataType
    left = left.withColumn("_left", F.struct(*[F.col(f"`{c}`") for c in left.columns]))
    rows = left.select(*by, F.col(on).alias("_on"), bucket.alias("_bucket"), "_left").unionByName(r, allowMissingColumns=True)
    # right rows first, so that an equal time matches, unless it must not; forward from the end: frames that shrink are costly
    side, seqs = F.col("_left").isNotNull().cast("int"), F.coalesce(F.col("_r.seq"), F.lit(0))
    place = [F.desc("_on"), side, seqs.desc()] if forward else [F.col("_on"), side, seqs]
    within = Window.partitionBy(*by, "_bucket").orderBy(place[0], side if exact else -side, place[2])
    summary = r.groupBy(*by, "_bucket").agg((F.min("_r") if forward else F.max("_r")).alias("_edge"))
    buckets = rows.where("_left IS NOT NULL").select(*by, "_bucket").distinct().unionByName(summary.select(*by, "_bucket")).distinct()
    along = Window.partitionBy(*by).orderBy(F.desc("_bucket") if forward else F.col("_bucket"))
    edge = F.last("_edge", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in [*by, "_bucket"]]
    summaries = buckets.join(summary, same(buckets, summary), "left").select(*[buckets[c] for c in [*by, "_bucket"]], "_edge")
    carry = summaries.select(*[F.col(c).alias(f"_c_{c}") for c in [*by, "_bucket"]], edge.alias("_carry"))
    near = F.last("_r", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    hit = rows.withColumn("_near", near).where("_left IS NOT NULL")
    joined = hit.join(carry, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in [*by, "_bucket"]], "left")
    got = F.when(F.col("_on").isNotNull(), F.coalesce("_near", "_carry"))
    if tolerance is not None:
        got = F.when(F.abs(got["on"] - F.col("_on")) <= tolerance, got)
    return joined.withColumn("_got", got.cast(kind)).select("_left.*", F.col("_got").alias(match))


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, seq: str, payload: Sequence[str], tolerance: int, match: str = "match") -> DataFrame:
    """left with the nearest right row within the tolerance; of two equally near the earlier.

    One union and one shuffle: the tolerance bounds how far a partner can be, so right rows go to
    every bucket of time that it reaches, and a bucket knows all its left rows' partners. Of right rows
    of one time the largest seq counts before, the smallest after. Rows with NULL keys or time match nothing.
    """
    width = max(BUCKET_S, tolerance + 1)
    at = F.col(on)
    bucket = lambda c: F.floor(c / width)
    keyed = at.isNotNull()
    for c in by:
        keyed = keyed & F.col(c).isNotNull()
    found = F.struct(at.alias("on"), F.col(seq).alias("seq"), *payload)
    r = right.where(keyed).select(*by, at.alias("_on"), F.explode(F.array_distinct(F.array(bucket(at - tolerance), bucket(at), bucket(at + tolerance)))).alias("_bucket"), found.alias("_r"))
    kind = r.schema["_r"].dataType
    marked = left.withColumn("_left", F.struct(*[F.col(f"`{c}`") for c in left.columns]))
    rows = marked.select(*by, at.alias("_on"), bucket(at).alias("_bucket"), "_left").unionByName(r, allowMissingColumns=True)
    side, seqs = F.col("_left").isNotNull().cast("int"), F.coalesce(F.col("_r.seq"), F.lit(0))
    group = Window.partitionBy(*by, "_bucket")
    last = lambda w: F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("_before", last(group.orderBy("_on", side, seqs))).withColumn("_after", last(group.orderBy(F.desc("_on"), side, seqs.desc()))).where("_left IS NOT NULL")
    back, ahead = F.col("_on") - F.col("_before.on"), F.col("_after.on") - F.col("_on")
    got = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    near = F.least(F.coalesce(back, ahead), F.coalesce(ahead, back)) <= tolerance
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    return both.withColumn("_got", F.when(near & known, got).cast(kind)).select("_left.*", F.col("_got").alias(match))


def fill_limited(joined: DataFrame, by: Sequence[str], on: str, limit: int, match: str = "match") -> DataFrame:
    """An as-of result in which each right row serves its exact time and `limit` further left rows."""
    inexact = F.col(f"{match}.on") != F.col(on)
    along = Window.partitionBy(*by, F.col(f"{match}.on"), F.col(f"{match}.seq"), inexact).orderBy(on)
    nth = F.row_number().over(along)
    return joined.withColumn("_nth", nth).withColumn(match, F.when(~inexact | (F.col("_nth") <= limit), F.col(match))).drop("_nth")


def settle(
    queries: DataFrame,
    ticks: DataFrame,
    by: Sequence[str],
    on: str,
    seq: str,
    price: str,
    *,
    lag_s: int,
    horizon_s: int,
    tol_s: int,
    exit_from: str = "target",
) -> DataFrame:
    """Fixed-expiry settlement of query instants: entry, exit, fwd_ret, valid and a reason.

    Entry is the first tick at or after on + lag_s, exit the last at or before the entry's target
    (exit_from 'target') or actual time ('entry') + horizon_s, each within tol_s and apart. Ties
    are valid. reason is the first of no_ticks, entry_missing, entry_late, exit_missing,
    exit_early, not_distinct, and 'ok'.
    """
    asked = queries.withColumn("_query", F.col(on)).withColumn(on, F.col(on) + lag_s)
    entered = asof(asked, ticks, by, on, seq, [price], forward=True, match="entry")
    start = F.col(on) if exit_from == "target" else F.coalesce(F.col("entry.on"), F.col(on))
    aimed = entered.withColumn("_entry_due", F.col(on)).withColumn(on, start + horizon_s)
    left = asof(aimed, ticks, by, on, seq, [price], match="exit")
    reason = (
        F.when(F.col("entry").isNull() & F.col("exit").isNull(), "no_ticks")
        .when(F.col("entry").isNull(), "entry_missing")
        .when(F.col("entry.on") - F.col("_entry_due") > tol_s, "entry_late")
        .when(F.col("exit").isNull(), "exit_missing")
        .when(F.col(on) - F.col("exit.on") > tol_s, "exit_early")
        .when(F.col("exit.on") <= F.col("entry.on"), "not_distinct")
        .otherwise("ok")
    )
    gain = F.try_divide(F.col(f"exit.{price}"), F.col(f"entry.{price}")) - 1
    return (
        left.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")
        .withColumn("fwd_ret", F.when(F.col("valid"), gain)).withColumn(on, F.col("_query")).drop("_query", "_entry_due")
    )


