"""Irregular readings onto a regular grid: time shards, border summaries, a prefix scan, and
shards filled independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.runtime import written

#: Seconds of a source's time that are joined with its sessions in one group.
JOIN_SHARD_S = 3600
#: Slots of a session that are filled in one group.
SLOTS_PER_SHARD = 512


def readings(df: DataFrame, source_table: str, source: str, row_id: str, epoch: str, value: str) -> DataFrame:
    """(source_table, source_id, shard, epoch, id, value) of a table of readings, NaN as NULL.

    Rows without source or epoch belong to no series and give no row.
    """
    return df.select(
        F.lit(source_table).alias("source_table"),
        F.col(source).alias("source_id"),
        F.floor(F.col(epoch) / JOIN_SHARD_S).alias("shard"),
        F.col(epoch).alias("epoch"),
        F.col(row_id).alias("id"),
        F.when(~F.isnan(value), F.col(value)).alias("value"),
    ).where(F.col("source_id").isNotNull() & F.col("epoch").isNotNull())


def kept_readings(rows: DataFrame) -> DataFrame:
    """Of each source and epoch of readings() the value of the row with the largest id.

    A row without value displaces an earlier one and leaves NULL. Repeated rows give one. The rows
    are placed by (source, shard) once, where the join with sessions needs them too.
    """
    placed = rows.repartition("source_table", "source_id", "shard")
    # numbers only: a hash aggregate, where a struct's maximum would be sorted
    return placed.groupBy("source_table", "source_id", "shard", "epoch").agg(F.max_by("value", "id").alias("value"))


def session_slots(sessions: DataFrame) -> DataFrame:
    """The distinct complete sessions with a grid: one row per session.

    Sessions that come twice count once; `complete` NULL or false, a grid below 1 s or an end not
    after the start give none.
    """
    return (
        sessions.where(F.col("complete") & (F.col("grid_s") > 0) & (F.col("close_epoch") > F.col("open_epoch")))
        .select("source_table", "source_id", "open_epoch", "close_epoch", F.col("grid_s").cast("bigint").alias("grid_s"))
        .dropDuplicates(["source_table", "source_id", "open_epoch"])
    )


def regular_series(kept: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per slot of every complete session: value, and whether it was observed.

    kept: source_table, source_id, shard, epoch, value (see kept_readings); sessions: see
    session_slots. Result: source_table, source_id, open_epoch, slot_epoch, value, fill_kind,
    age_s. A slot's value is that of its last usable reading (`observed`); an empty slot takes the
    last reading before it in its session (`carried`, age_s tells from when), or, before the
    session's first reading, that first one (`leading`); in a session without readings it is NULL
    (`missing`). Sources without sessions give no rows, sessions without readings give all slots.
    """
    pieces = sessions.withColumn(
        "shard",
        F.explode(
            F.sequence(F.floor(F.col("open_epoch") / JOIN_SHARD_S), F.floor((F.col("close_epoch") - 1) / JOIN_SHARD_S))
        ),
    )
    usable = kept.where(F.col("value").isNotNull())
    inside = usable.join(pieces, ["source_table", "source_id", "shard"]).where(
        (F.col("epoch") >= F.col("open_epoch")) & (F.col("epoch") < F.col("close_epoch"))
    )
    slot = F.floor((F.col("epoch") - F.col("open_epoch")) / F.col("grid_s"))
    session = ["source_table", "source_id", "open_epoch"]
    filled = (
        inside.withColumn("slot", slot)
        .withColumn("part", F.floor(F.col("slot") / SLOTS_PER_SHARD))
        .groupBy(*session, "part", "slot")
        .agg(F.max("epoch").alias("epoch"), F.max_by("value", "epoch").alias("value"))
    )
    # both the summaries and the fill read it: written once, a slot a row
    filled = written(filled, "slots").withColumn("last", F.struct("epoch", "value")).drop("epoch", "value")
    slots = F.ceil((F.col("close_epoch") - F.col("open_epoch")) / F.col("grid_s"))
    parts = sessions.withColumn("slots", slots).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("slots") - 1) / SLOTS_PER_SHARD)))
    )
    summaries = filled.groupBy(*session, "part").agg(
        F.struct(F.min_by("last", "slot").alias("last")).alias("first"), F.struct(F.max_by("last", "slot").alias("last")).alias("final")
    )
    along = Window.partitionBy(*session).orderBy("part")
    carried = (
        parts.join(summaries, [*session, "part"], "left")
        .withColumn("carry", F.last("final.last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("opening", F.first("first.last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .drop("first", "final")
    )
    grid = carried.withColumn(
        "slot",
        F.explode(
            F.sequence(
                F.col("part") * SLOTS_PER_SHARD,
                F.least(F.col("slots"), (F.col("part") + 1) * SLOTS_PER_SHARD) - 1,
            )
        ),
    )
    within = Window.partitionBy(*session, "part").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    state = grid.join(filled, [*session, "part", "slot"], "left").withColumn(
        "past", F.coalesce(F.last("last", ignorenulls=True).over(within), F.col("carry"))
    )
    slot_epoch = F.col("open_epoch") + F.col("slot") * F.col("grid_s")
    return state.select(
        *session,
        slot_epoch.alias("slot_epoch"),
        F.coalesce("past.value", "opening.value").alias("value"),
        F.when(F.col("last").isNotNull(), "observed")
        .when(F.col("past").isNotNull(), "carried")
        .when(F.col("opening").isNotNull(), "leading")
        .otherwise("missing")
        .alias("fill_kind"),
        F.when(F.col("last").isNull(), slot_epoch - F.col("past.epoch")).alias("age_s"),
    )
