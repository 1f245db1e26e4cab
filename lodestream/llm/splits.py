"""Splits that keep related records together: connected groups by random-mate contraction, and
an assignment of whole groups to splits by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.scan import numbered
from lodestream.runtime import cut, written

#: Share of all rows beyond which a key's rows are spread in the last join: there are at most 1 / share of such keys.
HOT_SHARE = 0.001
#: Groups of one size in one shard of the cumulative weight.
SHARD_GROUPS = 200_000


def clean_key(col: str) -> Column:
    """A key in lower case without blanks at the ends; a blank one relates nothing and is NULL."""
    key = F.lower(F.regexp_replace(F.col(col), r"^[\s ]+|[\s ]+$", ""))
    return F.when(F.length(key) > 0, key)


def contract(edges: DataFrame) -> DataFrame:
    """(vertex, label) of every vertex of the edges (u, v): equal labels in a connected component.

    Random-mate contraction. In each round every vertex tosses a coin; tails hook onto their
    smallest neighbour with heads. A vertex with a single neighbour needs no luck: it hooks onto
    that neighbour, unless that one hooks onto it. The edges are rewritten to the remaining
    vertices, loops and repetitions dropped, until none is left. Then the hooks are unwound from
    the last round to the first. No component, link or label is gathered anywhere; a hub of any
    degree is one row of a hook table, as minimum and degree are pre-aggregated. Self-loops and
    NULL ends must be left out; without edges there are no rows.
    """
    links = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        heads = lambda c, r=len(rounds): F.pmod(F.xxhash64(F.lit(r), F.col(c)), F.lit(2)) == 0
        ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("vertex"), F.col("v").alias("other")), F.struct(F.col("v").alias("vertex"), F.col("u").alias("other")))).alias("e")).select("e.*")
        seen = ends.groupBy("vertex").agg(F.count("*").alias("degree"), F.min("other").alias("other"), F.min(F.when(heads("other"), F.col("other"))).alias("mate"))
        single = (F.col("degree") == 1) & ~(heads("vertex") & ~heads("other"))
        hooks = seen.select("vertex", F.when(~heads("vertex") & F.col("mate").isNotNull(), F.col("mate")).when(single, F.col("other")).alias("mate")).where("mate IS NOT NULL")
        hooks = written(hooks, "aims")
        # an aim may itself hook, once; of two that aim at each other the smaller stays
        beyond = hooks.select(F.col("vertex").alias("mate"), F.col("mate").alias("end"))
        hooks = hooks.join(beyond.hint("merge"), "mate", "left").where("end IS NULL OR end <> vertex OR vertex > mate")
        back = F.col("end") == F.col("vertex")
        hooks = written(hooks.select("vertex", F.when(back | F.col("end").isNull(), F.col("mate")).otherwise(F.col("end")).alias("mate")), "hooks")
        rounds.append(hooks)
        for end in ("u", "v"):
            # merged, not broadcast: the driver would keep every round's relation
            links = links.join(hooks.select(F.col("vertex").alias(end), "mate").hint("merge"), end, "left").withColumn(end, F.coalesce("mate", end)).drop("mate")
        links = written(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "links")
    labels: DataFrame | None = None
    for at, hooks in enumerate(reversed(rounds)):
        if labels is None:
            labels = hooks.select("vertex", F.col("mate").alias("label"))
        else:
            above = labels.select(F.col("vertex").alias("mate"), "label")
            own = hooks.join(above.hint("merge"), "mate", "left").select("vertex", F.coalesce("label", "mate").alias("label"))
            labels = own.unionByName(labels)
        if at % 4 == 3:
            labels = written(labels, "labels")
    if labels is None:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("label")).where("false")
    return labels.unionByName(labels.select(F.col("label").alias("vertex"), "label").distinct())


def related_groups(df: DataFrame, row_id: str, entity: str, author: str, event: Column) -> DataFrame:
    """(row_id, group_id, group_key) of every row of df.

    Rows are related by the same entity, author or event key, and through chains of such rows. NULL
    relates nothing: a row without any key is a group of its own. group_key is the smallest entity
    of the group, NULL if it has none. Repeated rows stay; an empty table gives no rows.

    Keys are the vertices, not rows: a row hangs on its entity, else its author, else its event.
    Links are distinct (entity, author) pairs and, for an event, from each of its vertices to the
    smallest, so a key that holds a third of all rows adds no more links than it has neighbours.
    """
    key = lambda tag, c: F.concat(F.lit(tag), c)
    rows = df.select(F.col(row_id).alias("row_id"), key("e:", clean_key(entity)).alias("e"), key("a:", clean_key(author)).alias("a"), key("s:", event).alias("s"))
    rows = rows.withColumn("vertex", F.coalesce("e", "a", "s"))
    pairs = rows.where("e IS NOT NULL AND a IS NOT NULL").select(F.col("e").alias("u"), F.col("a").alias("v")).distinct()
    shared = cut(rows.where("s IS NOT NULL AND vertex <> s").select("s", "vertex").distinct())
    smallest = shared.groupBy("s").agg(F.min("vertex").alias("u"), F.max("vertex").alias("most")).where("u <> most").select("s", "u")
    events = shared.join(smallest, "s").select("u", F.col("vertex").alias("v")).where("u <> v").distinct()
    # a row without entity and author hangs on its event, which must then be tied to the event's others
    alone = rows.where("vertex = s").select("s").distinct().join(shared.groupBy("s").agg(F.min("vertex").alias("u")), "s").select("u", F.col("s").alias("v"))
    labels = cut(contract(pairs.unionByName(events).unionByName(alone)))
    counted = cut(rows.where("vertex IS NOT NULL").groupBy("vertex").agg(F.count("*").alias("n")))
    entity_of = F.when(F.col("vertex").startswith("e:"), F.substring("vertex", 3, 2**31 - 1))
    vertices = cut(counted.select("vertex").join(labels, "vertex", "left").select("vertex", F.coalesce("label", "vertex").alias("label")))
    names = vertices.groupBy("label").agg(F.min(entity_of).alias("group_key"))
    piece = F.greatest(F.lit(1), F.lit((counted.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE))
    hot = counted.where(F.col("n") > piece).select("vertex", F.ceil(F.col("n") / piece).cast("int").alias("pieces"))
    hot = F.broadcast(written(hot, "hot"))  # at most 1 / HOT_SHARE rows
    pieces = F.coalesce("pieces", F.lit(1))
    known = vertices.join(names, "label").join(hot, "vertex", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    salted = rows.where("vertex IS NOT NULL").join(hot, "vertex", "left").select("row_id", "vertex", F.pmod(F.xxhash64("row_id"), pieces).cast("int").alias("salt"))
    found = salted.join(known, ["vertex", "salt"]).select("row_id", F.col("label").alias("group_id"), "group_key")
    free = rows.where("vertex IS NULL").select("row_id", F.concat(F.lit("r:"), F.col("row_id").cast("string")).alias("group_id"), F.lit(None).cast("string").alias("group_key"))
    return found.unionByName(free)


def assign_splits(groups: DataFrame, targets: DataFrame) -> DataFrame:
    """(group_id, split_name): whole groups assigned so that row counts come near the target shares.

    groups: one row per record with group_id; targets: split_name, target_share (a fixed small
    table). The groups are laid end to end from the largest to the smallest, the splits likewise,
    each as long as its share of all rows; a group belongs to the split in which its middle falls. So a
    split's size is wrong by less than the groups at its two edges, and the smallest groups lie at the
    last edge. Groups of one size are interchangeable: their places are counted in shards, and only
    the sizes, of which n rows have fewer than 2 sqrt(n), are added up in order. Without targets no
    group is assigned; shares need not add up to 1.
    """
    sizes = cut(groups.groupBy("group_id").agg(F.count("*").alias("size")))
    goals = {r["split_name"]: r["target_share"] for r in targets.select("split_name", "target_share").collect()}
    by_size = written(sizes.groupBy("size").agg(F.count("*").alias("n")), "sizes")
    total, n = by_size.agg(F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    larger = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    starts = by_size.select("size", F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0)).alias("start"))
    shards = max(16, n // SHARD_GROUPS)
    laid = numbered(sizes, [F.col("group_id")], F.pmod(F.xxhash64("group_id"), F.lit(shards)), ["size"], "nth").join(starts, "size")
    middle = F.col("start") + (F.col("nth") - 0.5) * F.col("size")
    place, edge, scale = F.lit(None).cast("string"), 0.0, sum(goals.values()) or 1.0
    order = sorted(goals, key=lambda k: (-goals[k], k))
    for name in order[:-1]:
        edge += goals[name] / scale * total
        place = F.coalesce(place, F.when(middle <= edge, F.lit(name)))
    return laid.select("group_id", F.coalesce(place, F.lit(order[-1] if order else None).cast("string")).alias("split_name"))
