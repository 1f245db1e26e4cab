"""Items into containers of fixed capacity: repeat counts of length patterns by non-negative least
squares against the length histogram, and first-fit packing of what rounding leaves over."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.scan import running_total
from lodestream.runtime import cut

#: Length classes in which the histogram is held; an item counts as the upper end of its class.
CLASSES = 512
#: Most items of one pattern, and most patterns that are fitted.
MAX_ITEMS, MAX_PATTERNS = 48, 640
#: Share of the capacity that a pattern must fill to be used.
LEAST_FILL = 0.99
#: Relative misfit of the histogram at which fitting ends.
MISFIT = 1e-3
#: Least shards in which the items of a class are numbered, and the items of one residual packing.
RANK_SHARDS, RESIDUAL_ITEMS = 64, 20_000
#: Items beyond which a shard of the numbering is split further.
SHARD_ROWS = 500_000


def best_pattern(gain: np.ndarray, capacity: int, max_items: int) -> np.ndarray:
    """Of all patterns of classes (class c takes c + 1 units) that fit, that of the greatest gain.

    Dynamic programming over fill levels looks through every pattern of any few items at once.
    """
    value = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    items = np.zeros(capacity + 1, int)
    useful = np.flatnonzero(gain > 0)
    for fill in range(1, capacity + 1):
        fits = useful[useful < fill]
        value[fill], take[fill], items[fill] = value[fill - 1], -1, items[fill - 1]
        if len(fits):
            score = np.where(items[fill - fits - 1] < max_items, value[fill - fits - 1] + gain[fits], -np.inf)
            k = int(np.argmax(score))
            if score[k] > value[fill] + 1e-12:
                value[fill], take[fill], items[fill] = score[k], fits[k], items[fill - fits[k] - 1] + 1
    pattern, fill = np.zeros(len(gain)), capacity
    while fill > 0:
        if take[fill] < 0:
            fill -= 1
        else:
            pattern[take[fill]] += 1
            fill -= take[fill] + 1
    return pattern


def fit_patterns(histogram: np.ndarray, capacity: int = CLASSES, max_items: int = MAX_ITEMS, max_patterns: int = MAX_PATTERNS) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, repeats): whole repeat counts whose items don't exceed the histogram.

    Active-set non-negative least squares of A x = histogram, the columns of A being patterns; the
    next column is always the pattern whose gradient is greatest. Counts are rounded down.
    """
    rows = np.flatnonzero(histogram)
    target = histogram.astype(float)
    columns: list[np.ndarray] = []
    x = np.zeros(0)
    norm = np.linalg.norm(target) or 1.0
    seen: set[bytes] = set()
    for _ in range(max_patterns):
        rest = target - (np.stack(columns, 1) @ x if columns else 0)
        if np.linalg.norm(rest) <= MISFIT * norm:
            break
        pattern = best_pattern(rest, capacity, max_items)
        if not pattern.any() or pattern @ rest <= 1e-9 * norm or pattern.tobytes() in seen:
            break
        seen.add(pattern.tobytes())
        columns.append(pattern)
        x = np.append(x, 0.0)
        while columns:
            a = np.stack(columns, 1)[rows]
            solved = np.linalg.lstsq(a, target[rows], rcond=None)[0]
            if (solved > 1e-9).all():
                x = solved
                break
            falling = solved <= 1e-9
            room = x[falling] / np.maximum(x[falling] - solved[falling], 1e-300)
            x = x + min(1.0, float(room.min())) * (solved - x)
            keep = x > 1e-9
            if keep.all():
                keep[int(np.argmin(np.where(falling, x, np.inf)))] = False
            seen -= {c.tobytes() for c, k in zip(columns, keep) if not k}
            columns, x = [c for c, k in zip(columns, keep) if k], x[keep]
            if not keep[-1:].any():
                seen.add(pattern.tobytes())
    repeats = np.floor(x + 1e-6).astype(np.int64) if columns else np.zeros(0, np.int64)
    patterns = np.stack(columns, 1).astype(np.int64) if columns else np.zeros((len(histogram), 0), np.int64)
    over = patterns @ repeats - histogram
    for c in np.flatnonzero(over > 0):  # least squares may overshoot a class: take back whole repeats
        for p in np.flatnonzero(patterns[c]):
            back = min(int(repeats[p]), max(0, -(-int((patterns @ repeats - histogram)[c]) // int(patterns[c, p]))))
            repeats[p] -= back
    full = (patterns * np.arange(1, len(histogram) + 1)[:, None]).sum(axis=0) >= LEAST_FILL * capacity
    used = (repeats > 0) & full  # the items of poor patterns are packed better one by one
    return patterns[:, used], repeats[used]


def split_items(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, n_parts, n_tokens): only documents longer than the capacity have several parts.

    A document without tokens is an item of size 0.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("bigint")
    return docs.withColumn("n_parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_parts") - 1))).select(
        "doc_id", "part", "n_parts", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("bigint").alias("n_tokens")
    )


_PACKED = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("n_parts", pa.int64()), ("n_tokens", pa.int64()), ("window_id", pa.string())])


def _residual(capacity: int):
    def pack(key: tuple, items: pa.Table) -> pa.Table:
        """Best fit, longest first: bins by free room, found by bisection."""
        import bisect

        size, doc, part = (items[c].to_numpy() for c in ("n_tokens", "doc_id", "part"))
        order = np.lexsort((part, doc, -size))
        rooms: list[tuple[int, int]] = []
        opened, place = 0, np.zeros(len(size), np.int64)
        for i in order:
            at = bisect.bisect_left(rooms, (int(size[i]), -1))
            if at < len(rooms):
                room, bin_no = rooms.pop(at)
            else:
                room, bin_no, opened = capacity, opened, opened + 1
            place[i] = bin_no
            bisect.insort(rooms, (room - int(size[i]), bin_no))
        names = [f"r{key[0].as_py()}.{b}" for b in place]
        return items.select(["doc_id", "part", "n_parts", "n_tokens"]).append_column("window_id", pa.array(names, pa.string())).cast(_PACKED)

    return pack


def pack(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, part, n_parts, n_tokens, window_id) of every document (doc_id, n_tokens).

    Items fill windows of `capacity` tokens; none is split unless it is longer than a window. The
    class histogram (CLASSES numbers) is all that reaches the driver. The items of a class are
    numbered shard by shard; a pattern's repeats own ranges of those numbers, so that a window
    follows by arithmetic. What is beyond all ranges is packed by best fit in shards of bounded
    size. Repeated documents are separate items; no documents give no windows.
    """
    unit = -(-capacity // CLASSES)
    classes = -(-capacity // unit)
    klass = F.greatest(F.ceil(F.col("n_tokens") / unit), F.lit(1)).cast("int") - 1
    items = cut(split_items(docs, capacity).withColumn("class", klass))
    histogram = np.zeros(classes, np.int64)
    for row in items.groupBy("class").count().collect():
        histogram[row["class"]] = row["count"]
    # a class's upper end may exceed the capacity by less than a unit only if unit doesn't divide it
    fill = capacity // unit
    usable = histogram.copy()
    usable[fill:] = 0
    patterns, repeats = fit_patterns(usable, fill)
    ranges, upto = [], np.zeros(classes, np.int64)
    for p in range(patterns.shape[1]):
        for c in np.flatnonzero(patterns[:, p]):
            n = int(patterns[c, p] * repeats[p])
            ranges.append((int(c), int(upto[c]), int(upto[c]) + n, int(patterns[c, p]), p))
            upto[c] += n
    spark = docs.sparkSession
    owned = F.broadcast(spark.createDataFrame(ranges, "class int, low bigint, high bigint, each bigint, pattern int"))  # <= CLASSES * MAX_ITEMS rows
    ranks = max(RANK_SHARDS, int(histogram.sum()) // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("doc_id", "part"), F.lit(ranks))
    numbered = running_total(items, F.lit(1), [F.col("doc_id"), F.col("part")], shard, ["class"], "nth").withColumn("nth", F.col("nth") - 1)
    placed = cut(
        numbered.join(owned, (numbered["class"] == owned["class"]) & (F.col("nth") >= F.col("low")) & (F.col("nth") < F.col("high")), "left")
        .select("doc_id", "part", "n_parts", "n_tokens", F.concat(F.lit("p"), F.col("pattern").cast("string"), F.lit("."), F.floor((F.col("nth") - F.col("low")) / F.col("each")).cast("string")).alias("window_id"))
    )
    left = placed.where("window_id IS NULL")
    shards = max(1, -(-left.count() // RESIDUAL_ITEMS))
    packed = (
        left.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)))
        .groupBy("shard")
        .applyInArrow(_residual(capacity), "doc_id bigint, part bigint, n_parts bigint, n_tokens bigint, window_id string")
    )
    return placed.where("window_id IS NOT NULL").unionByName(packed)
