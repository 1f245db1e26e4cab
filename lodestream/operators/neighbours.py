"""Exact nearest vectors of a stated query set among all rows, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries and rows that meet in one task.
QUERY_BLOCK, ROW_BLOCK = 1_024, 16_384


def _matrix(part: pa.Table, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the rows whose vector has `size` elements."""
    column = part["_vector"].combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    keep = lengths == size
    kept = column.filter(pa.array(keep))
    return part["_id"].to_numpy()[keep], kept.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size or 1)


def nearest_vectors(rows: DataFrame, queries: DataFrame, row_id: str, vector: str, k: int) -> DataFrame:
    """(query_id, row_id, rank, dist): the k nearest rows of each query by squared distance.

    A query is not its own neighbour; ties go to the smaller id. Blocks of queries meet blocks of
    rows, both of bounded size, as Arrow tables: a row is sent once to every block of queries, a query
    once to every block of rows. A task keeps k candidates per query, and only those are shuffled.
    Vectors of NULL or of another length than the most frequent one of the queries are left out, as is
    what lies at no finite distance.
    """
    pick = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(row_id).cast("bigint").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"))
    asked, given = pick(queries), pick(rows)
    usual = asked.groupBy(F.size("_vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = usual["size"] if usual else 0
    blocks, shards = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-given.count() // ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).withColumn("_shard", every(shards))
    r = given.withColumn("_shard", F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(shards)).cast("int")).withColumn("_block", every(blocks))

    def best(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        ids, a = _matrix(queries, size)
        row_ids, b = _matrix(rows, size)
        order = np.argsort(row_ids, kind="stable")
        row_ids, b = row_ids[order], b[order]
        out: list[np.ndarray] = []
        for x, vec in zip(ids, a):
            dist = ((b - vec) ** 2).sum(axis=1)
            dist[row_ids == x] = np.inf
            dist[np.isnan(dist)] = np.inf
            some = np.argpartition(dist, k - 1)[:k] if len(dist) > k else np.arange(len(dist))
            # all that are as near as the k-th, so that ties go by id
            some = np.flatnonzero(dist <= dist[some].max()) if len(some) else some
            top = some[np.argsort(dist[some], kind="stable")][:k]
            top = top[np.isfinite(dist[top])]
            out.append(np.column_stack([np.full(len(top), x, float), top, dist[top]]))
        every = np.concatenate(out) if out else np.zeros((0, 3))
        counts = [len(o) for o in out]
        return pa.table({"query_id": pa.array(np.repeat(ids[: len(out)], counts), pa.int64()), row_id: pa.array(row_ids[every[:, 1].astype(int)], pa.int64()), "dist": pa.array(every[:, 2], pa.float64())})

    found = q.groupBy("_block", "_shard").cogroup(r.groupBy("_block", "_shard")).applyInArrow(best, f"query_id bigint, {row_id} bigint, dist double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", row_id))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", row_id, "rank", "dist")
