"""Queries p1, p3, p7, p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import lookalike, mixing, nearest, packing, splits, tokens
from lodestream.runtime import cut, table


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "label_rows")
    settlement = F.concat(splits.clean_key("pair"), F.lit("|"), F.col("horizon_min").cast("string"), F.lit("|"), F.col("datetime_utc").cast("string"))
    return splits.related_groups(rows, "row_id", "book_id", "analyst", settlement)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with the smallest book of its group of related rows."""
    return _groups(spark, sf_dir).select("row_id", "group_key")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's split; related rows share one."""
    groups = cut(_groups(spark, sf_dir))
    return groups.join(splits.assign_splits(groups, table(spark, sf_dir, "split_targets")), "group_id").select("row_id", "split_name")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every split."""
    rows = p1_splits(spark, sf_dir).groupBy("split_name").agg(F.count("*").alias("n_rows"))
    total = rows.agg(F.sum("n_rows").alias("n_total"))
    targets = table(spark, sf_dir, "split_targets").join(rows, "split_name", "left").join(F.broadcast(total))
    return targets.select("split_name", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.coalesce("n_rows", F.lit(0)) / F.col("n_total")).alias("actual_share"))


def p1_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a split, and books, analysts and settlements whose rows are in several splits."""
    rows = table(spark, sf_dir, "label_rows")
    split = rows.join(p1_splits(spark, sf_dir).withColumnRenamed("row_id", "_row"), F.col("row_id") == F.col("_row"), "left")
    keys = {"books": splits.clean_key("book_id"), "analysts": splits.clean_key("analyst"), "settlements": F.concat(splits.clean_key("pair"), F.lit("|"), F.col("horizon_min").cast("string"), F.lit("|"), F.col("datetime_utc").cast("string"))}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in keys.items()])).alias("k")
    apart = split.select("split_name", kinds).where("k.key IS NOT NULL").groupBy("k.kind", "k.key").agg((F.min("split_name") != F.max("split_name")).alias("apart"))
    counts = apart.agg(*[F.count_if((F.col("kind") == k) & F.col("apart")).alias(f"{k}_apart") for k in keys])
    return counts.join(F.broadcast(split.agg(F.count("*").alias("n_rows"), F.count_if(F.col("split_name").isNull()).alias("rows_without"))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each counting decision with its nearest usable tick."""
    tolerances = table(spark, sf_dir, "streams").select("stream_id", F.col("tol_s").cast("bigint").alias("tol_s"))  # a fixed table
    most = tolerances.agg(F.coalesce(F.max("tol_s"), F.lit(0))).first()[0]
    latest = F.max(F.struct("recorded_epoch", "decision_id", "stream_id")).alias("r")
    decisions = (
        table(spark, sf_dir, "decisions").groupBy("prereg_id", "decision_close_epoch").agg(latest)
        .select(F.col("r.decision_id").alias("decision_id"), F.col("r.stream_id").alias("stream_id"), "decision_close_epoch")
        .join(tolerances, "stream_id")
    )
    ticks = table(spark, sf_dir, "ticks")
    usable = F.col("quote").isNotNull() & ~F.isnan("quote")
    left = nearest.tag(decisions, is_left=True, entity="stream_id", epoch="decision_close_epoch", row_id="decision_id", tol=F.col("tol_s"), usable=F.lit(True), tolerance=most)
    right = nearest.tag(ticks, is_left=False, entity="stream_id", epoch="epoch", row_id="tick_id", tol=F.lit(0), usable=usable, tolerance=most)
    return nearest.replay_nearest(spark, left, right, most).select(F.col("left_id").alias("decision_id"), F.col("right_id").alias("tick_id"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "pack_limits").agg(F.min("capacity_tokens")).first()[0]
    sized = tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(sized, capacity)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the packing had to split."""
    return _packed(spark, sf_dir).where("n_parts > 1").select("doc_id").distinct()


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part of every document with its window."""
    return _packed(spark, sf_dir)


def p7_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the windows are."""
    capacity = table(spark, sf_dir, "pack_limits").agg(F.min("capacity_tokens")).first()[0]
    windows = _packed(spark, sf_dir).groupBy("window_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return windows.agg(
        F.count("*").alias("n_windows"), F.sum("items").alias("n_items"), F.sum("n").alias("n_tokens"), F.max("n").alias("most_in_a_window"),
        F.ceil(F.sum("n") / capacity).alias("least_windows"), F.try_divide(F.sum("n"), F.count("*") * capacity).alias("fill"),
    )


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed, and how many are not whole, split without need, or in a window that overflows; whether few windows are more than the least."""
    capacity = table(spark, sf_dir, "pack_limits").agg(F.min("capacity_tokens")).first()[0]
    parts = cut(_packed(spark, sf_dir))
    docs = parts.groupBy("doc_id").agg(F.count("*").alias("parts"), F.countDistinct("part").alias("several"), F.max("n_parts").alias("n_parts"), F.sum("n_tokens").alias("n"))
    windows = parts.groupBy("window_id").agg(F.sum("n_tokens").alias("n"))
    most = windows.agg(F.count_if(F.col("n") > capacity).alias("windows_over"), (F.count("*") <= F.ceil(F.sum("n") / capacity * 1.03) + 1).alias("few_windows"))
    return docs.agg(
        F.count("*").alias("n_documents"), F.count_if((F.col("parts") != F.col("n_parts")) | (F.col("several") != F.col("parts"))).alias("not_whole"),
        F.count_if((F.col("n_parts") > 1) & (F.col("n") <= capacity)).alias("split_without_need"),
    ).join(F.broadcast(most))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.md5(F.encode(F.col("text"), "utf-8")).alias("text_key")).join(tokens.count_tokens(docs, "doc_id", "text"), "doc_id")
    return mixing.mixture(sized, table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that cannot reach their share."""
    return _mixture(spark, sf_dir)[1].where("NOT reachable").select("source_name")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mixture."""
    return _mixture(spark, sf_dir)[1]


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture itself: the documents drawn, with repetitions."""
    return _mixture(spark, sf_dir)[0]


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, texts used too often, items of sources without target, and whether the mixture keeps to its budget and reports its shares right."""
    chosen, report = _mixture(spark, sf_dir)
    chosen = cut(chosen)
    targets = table(spark, sf_dir, "mix_targets")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(F.col("text"), "utf-8")).alias("text_key"), "source")
    uses = chosen.join(docs, "doc_id").groupBy("text_key").agg(F.count("*").alias("uses"), F.min("source_name").alias("source_name"), F.count_if(F.col("source") != F.col("source_name")).alias("strange"))
    wrong = uses.join(targets, "source_name", "left").agg(F.count_if(F.coalesce(F.col("uses") > F.col("max_repeats"), F.lit(True))).alias("used_too_often"), F.coalesce(F.sum("strange"), F.lit(0)).alias("of_other_sources"))
    again = chosen.groupBy("source_name").agg(F.sum("n_tokens").alias("again"))
    total = chosen.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("whole"))
    sums = report.join(again, "source_name", "left").join(F.broadcast(total))
    shares = sums.agg(
        F.count("*").alias("n_sources"), F.count_if((F.coalesce("again", F.lit(0)) != F.col("tokens")) | (F.abs(F.col("actual_share") * F.col("whole") - F.col("tokens")) > 0.5)).alias("misreported"),
        (F.max("whole") <= F.max(F.col("needed_tokens") / F.col("target_share")) + 0.5).alias("within_budget"),
    )
    return shares.join(F.broadcast(wrong))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same but are not."""
    pairs = lookalike.alike_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of equal look, and how many documents of its class are of other characters."""
    return lookalike.look_links(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in the consistent form."""
    return lookalike.consistent(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "form")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_splits, p1_shares, p1_invariants, p3_found, p7_found, p7_packing, p7_use, p7_invariants, p8_found, p8_shares, p8_mixture, p8_invariants, p9_found, p9_classes, p9_forms)
}
