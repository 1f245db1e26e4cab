"""Schemas that drift between files: payloads as path-value maps with raw types, statistics by
path and type, a report of changes, and one typed table with the casts that failed."""

from __future__ import annotations

import functools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.shred import _by_batch, read_object
from lodestream.runtime import cut, written

#: Days of a series' files in one shard.
SHARD_DAYS = 7
_MAPS = "file_id bigint, paths array<string>, kinds array<string>, raws array<string>"
_MAPS_ARROW = pa.schema([("file_id", pa.int64())] + [(c, pa.list_(pa.string())) for c in ("paths", "kinds", "raws")])


def kind_of(value: Any) -> str:
    """The JSON type of a leaf; NaN is a number."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array"


def leaves(top: dict) -> Iterator[tuple[str, Any]]:
    """(path, value) of everything that is no object; arrays are not entered."""
    stack = [("", top)]
    while stack:
        at, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{at}/{k}" if at else k, v) for k, v in value.items())
        elif at or value is not top:
            yield at, value


def path_maps(files: DataFrame) -> DataFrame:
    """file_id with its payload's paths, types and raw values; unreadable payloads give no row."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            top = read_object(text)
            if top is not None:
                found = list(leaves(top))
                raws = [None if v is None else v if isinstance(v, str) else json.dumps(v) for _, v in found]
                yield i, [p for p, _ in found], [kind_of(v) for _, v in found], raws

    return files.select("file_id", "payload").mapInArrow(_by_batch(_MAPS_ARROW, rows, 2_000), _MAPS)


def counting_files(files: DataFrame, readable: DataFrame) -> DataFrame:
    """(series_id, at, file_id): of one series and written_at the readable file with the smallest id.

    Files without series or time belong to no order and give no row.
    """
    known = files.where(F.col("series_id").isNotNull() & F.col("written_at").isNotNull()).select(
        "series_id", F.unix_micros(F.col("written_at").cast("timestamp")).alias("at"), "file_id"
    )
    return known.join(readable.select("file_id"), "file_id", "left_semi").groupBy("series_id", "at").agg(F.min("file_id").alias("file_id"))


def _shard(at: str) -> Column:
    return F.floor(F.col(at) / (SHARD_DAYS * 86_400_000_000))


def with_next(counting: DataFrame) -> DataFrame:
    """counting with next_at and next_id, the series' following file, found shard by shard."""
    shards = counting.withColumn("shard", _shard("at"))
    first = shards.groupBy("series_id", "shard").agg(F.min(F.struct("at", "file_id")).alias("first"))
    later = first.select("series_id", "shard", F.lead("first").over(Window.partitionBy("series_id").orderBy("shard")).alias("later"))
    here = F.lead(F.struct("at", "file_id")).over(Window.partitionBy("series_id", "shard").orderBy("at"))
    return (
        shards.withColumn("following", here).join(later, ["series_id", "shard"])
        .withColumn("following", F.coalesce("following", "later"))
        .select("series_id", "at", "file_id", F.col("following.at").alias("next_at"), F.col("following.file_id").alias("next_id"))
    )


def words(level: str) -> list[str]:
    """The words of one level of a path in lower case: split at case, digits and signs."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+", level)]


def _made_of(x: str, parts: tuple[str, ...], left: tuple[int, ...], exact: bool) -> set[tuple[int, ...]]:
    """What can be left of the parts (of which `left` says how many there are) if x is made of the others.

    x is cut into pieces, one for each part used, in any order. exact: the pieces are the parts.
    Else a piece and its part agree if one is the first part of the other.
    """
    found, seen, stack = set(), {(0, left)}, [(0, left)]
    while stack:
        at, rest = stack.pop()
        if at == len(x):
            found.add(rest)
            continue
        for i, part in enumerate(parts):
            if not rest[i]:
                continue
            if exact:
                ends = [at + len(part)] if x.startswith(part, at) else []
            else:
                same = len(os.path.commonprefix([x[at:], part]))
                ends = range(at + 1, (len(x) if same == len(part) else at + same) + 1)
            fewer = rest[:i] + (rest[i] - 1,) + rest[i + 1 :]
            for end in ends:
                if (state := (end, fewer)) not in seen:
                    seen.add(state)
                    stack.append(state)
    return found


def _agree(a: list[str], b: list[str], exact: bool) -> bool:
    """Whether all words of a and b fall into groups in which one word of a side is made of the other side's.

    Works through the words of a; how many of each word are left on both sides is a state that is
    tried once, so that repeated words cost little.
    """
    (wa, na), (wb, nb) = ((tuple(c), tuple(c.values())) for c in (Counter(a), Counter(b)))
    seen, stack = set(), [(na, nb)]
    while stack:
        state = stack.pop()
        if state in seen:
            continue
        seen.add(state)
        of_a, of_b = state
        i = next((k for k, n in enumerate(of_a) if n), None)
        if i is None:
            if not any(of_b):
                return True
            continue
        rest = of_a[:i] + (of_a[i] - 1,) + of_a[i + 1 :]
        stack += [(rest, left) for left in _made_of(wa[i], wb, of_b, exact)]
        for j, n in enumerate(of_b):
            if n:
                fewer = of_b[:j] + (n - 1,) + of_b[j + 1 :]
                stack += [(left, fewer) for left in _made_of(wb[j], wa, of_a, exact) if left[i] < of_a[i]]
    return False


def _same_words(a: list[str], b: list[str]) -> int:
    """0 if two lists differ, else how well they agree: 3 equal, 2 joined, 1 shortened (and perhaps joined)."""
    if sorted(a) == sorted(b):
        return 3
    if not a or not b:
        return 0
    return 2 if _agree(a, b, True) else int(_agree(a, b, False))


def same_field(old: str, new: str) -> int:
    """How well two paths agree level by level in their words; 0 if they don't."""
    x, y = old.split("/"), new.split("/")
    if len(x) != len(y):
        return 0
    score = [4 if p == q else _same_words(words(p), words(q)) for p, q in zip(x, y)]
    return sum(score) if all(score) else 0


def _letters(path: str) -> list[str]:
    """Depth and first letters of a word of the first and one of the last level; paths that agree have such in common."""
    levels = path.split("/")
    of = lambda level: sorted({w[0] for w in words(level)}) or [""]
    return [f"{len(levels)}{x}/{y}" for x in of(levels[0]) for y in of(levels[-1])]


def _with_letters(df: DataFrame, path: str) -> DataFrame:
    keys = F.pandas_udf(lambda x: pd.Series([_letters(p) for p in x]), "array<string>")
    return df.withColumn("letters", keys(path)).withColumn("letter", F.explode("letters"))


def _agreement(old: str, new: str) -> Column:
    """same_field of two columns; each pair of paths is compared once per worker."""
    return F.pandas_udf(lambda x, y: pd.Series([_cached(a, b) for a, b in zip(x, y)], dtype="int32"), "int")(old, new)


@functools.lru_cache(100_000)
def _cached(old: str, new: str) -> int:
    return same_field(old, new)


def _pairs(candidates: pd.DataFrame) -> pd.DataFrame:
    """Of one file's candidates the renames: best agreement first, then by path, each field once.

    A field whose only candidate has no rival is a rename whatever the others are.
    """
    rows, used = [], set()
    for _, old, new in sorted(zip(-candidates["score"], candidates["old_path"], candidates["new_path"])):
        if ("o", old) not in used and ("n", new) not in used:
            used |= {("o", old), ("n", new)}
            rows.append((candidates["series_id"].iloc[0], int(candidates["file_id"].iloc[0]), old, new))
    return pd.DataFrame(rows, columns=["series_id", "file_id", "old_path", "new_path"])


def changes(files: DataFrame) -> DataFrame:
    """(series_id, file_id, change_kind, field_path, old_path): each change between files of a series.

    files: file_id, series_id, written_at, payload. A series' first file is no change. `added`: in
    no earlier file; `removed`: in the previous, in this and all later files not; `renamed`: one of
    each in one file, of one type, with the same words level by level; `retyped`: another type than
    the field's last value (nulls have none). Empty tables give no rows.
    """
    maps = written(path_maps(files).select("file_id", "paths", "kinds"), "maps")
    counting = cut(counting_files(files, maps))
    fields = (
        counting.join(maps, "file_id").select("series_id", "at", "file_id", F.arrays_zip("paths", "kinds").alias("z"))
        .select("series_id", "at", "file_id", F.explode("z").alias("z"))
        .select("series_id", F.col("z.paths").alias("path"), "at", "file_id", F.when(F.col("z.kinds") != "null", F.col("z.kinds")).alias("kind"))
    )
    # by path and shard: first and last place with the types there, and the changes of type inside
    typed = F.when(F.col("kind").isNotNull(), F.struct("at", "kind", "file_id"))
    inside = Window.partitionBy("series_id", "path", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    stats = cut(
        fields.withColumn("shard", _shard("at")).withColumn("previous", F.last("kind", ignorenulls=True).over(inside))
        .groupBy("series_id", "path", "shard").agg(
            F.min(F.struct("at", "file_id")).alias("first"), F.max(F.struct("at", "file_id")).alias("last"),
            F.min(typed).alias("first_typed"), F.max(typed).alias("last_typed"),
            F.collect_list(F.when(F.col("kind") != F.col("previous"), F.col("file_id"))).alias("retyped"),
        )
    )
    whole = stats.groupBy("series_id", "path").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.min("first_typed").alias("first_typed"), F.max("last_typed").alias("last_typed"),
    )
    span = counting.groupBy("series_id").agg(F.min("at").alias("series_first"), F.max("at").alias("series_last"))
    bounds = whole.join(span, "series_id")
    added = bounds.where(F.col("first.at") > F.col("series_first")).select(
        "series_id", F.col("first.file_id").alias("file_id"), F.col("path").alias("new_path"), F.col("first_typed.kind").alias("kind")
    )
    gone = bounds.where(F.col("last.at") < F.col("series_last")).select("series_id", F.col("last.at").alias("at"), F.col("path").alias("old_path"), F.col("last_typed.kind").alias("kind"))
    removed = gone.join(with_next(counting).select("series_id", "at", "next_id"), ["series_id", "at"]).select("series_id", F.col("next_id").alias("file_id"), "old_path", "kind")
    added, removed = cut(added), cut(removed)
    # only fields of one file that share letters meet, each pair once, by its smallest letters in common
    old, new = _with_letters(removed, "old_path"), _with_letters(added.withColumnRenamed("kind", "new_kind"), "new_path").withColumnRenamed("letters", "new_letters")
    once = F.col("letter") == F.array_min(F.array_intersect("letters", "new_letters"))
    same = old.join(new, ["series_id", "file_id", "letter"]).where(once & F.coalesce(F.col("kind") == F.col("new_kind"), F.lit(True)))
    alike = cut(same.select("series_id", "file_id", "old_path", "new_path", _agreement("old_path", "new_path").alias("score")).where("score > 0"))
    rivals = lambda side: F.count("*").over(Window.partitionBy("series_id", "file_id", side))
    alike = alike.withColumn("rivals", F.greatest(rivals("old_path"), rivals("new_path")))
    pairs = ["series_id", "file_id", "old_path", "new_path"]
    contested = alike.where("rivals > 1").groupBy("series_id", "file_id").applyInPandas(_pairs, "series_id string, file_id bigint, old_path string, new_path string")
    renamed = cut(alike.where("rivals = 1").select(pairs).unionByName(contested))
    # changes of type over the borders of shards, from their summaries
    order = Window.partitionBy("series_id", "path").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = stats.withColumn("before", F.last(F.col("last_typed.kind"), ignorenulls=True).over(order))
    across = carried.where("before <> first_typed.kind").select("series_id", "path", F.col("first_typed.file_id").alias("file_id"))
    retyped = across.unionByName(stats.select("series_id", "path", F.explode("retyped").alias("file_id")))
    report = lambda df, kind, path, old: df.select("series_id", "file_id", F.lit(kind).alias("change_kind"), F.col(path).alias("field_path"), old.alias("old_path"))
    key = ["series_id", "file_id"]
    return (
        report(added.join(renamed, [*key, "new_path"], "left_anti"), "added", "new_path", F.lit(""))
        .unionByName(report(removed.join(renamed, [*key, "old_path"], "left_anti"), "removed", "old_path", F.lit("")))
        .unionByName(report(renamed, "renamed", "new_path", F.col("old_path")))
        .unionByName(report(retyped, "retyped", "path", F.lit("")))
    )


def typed_table(files: DataFrame, fields: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per readable file with every field (column, path, type) and the casts that failed.

    A path matches whatever its case; of several spellings in one file the first in byte order
    counts. failed_casts lists the columns with a value that is no value of their type; it is empty
    if none. Fields that a file lacks are NULL.
    """
    maps = path_maps(files)
    by_path = F.map_from_entries(F.array_sort(F.transform(F.arrays_zip("paths", "raws"), lambda z: F.struct(F.concat(F.lower(z["paths"]), F.lit("\u0000"), z["paths"]), z["raws"]))))
    values = maps.withColumn("m", by_path)

    def raw(path: str) -> Column:
        spelled = F.map_values(F.map_filter("m", lambda k, v: k.startswith(path.lower() + "\u0000") & v.isNotNull()))
        return F.get(spelled, F.lit(0))

    values = values.select("file_id", *[raw(p).alias(f"_{c}") for c, p, _ in fields])
    failed = F.array_compact(F.array(*[F.when(F.col(f"_{c}").isNotNull() & F.col(f"_{c}").try_cast(t).isNull(), F.lit(c)) for c, _, t in fields]))
    return values.select("file_id", *[F.col(f"_{c}").try_cast(t).alias(c) for c, _, t in fields], failed.alias("failed_casts"))


#: The column type of a JSON type. Arrays stay JSON text.
COLUMN_TYPES = {"number": "double", "boolean": "boolean", "string": "string", "array": "string", "null": "string"}


def path_statistics(files: DataFrame) -> DataFrame:
    """(path, kind, n_files): in how many counting files a path has a value of a JSON type, `null` included."""
    maps = path_maps(files)
    counted = counting_files(files, maps).select("file_id")
    entries = maps.join(counted, "file_id", "left_semi").select(F.explode(F.arrays_zip("paths", "kinds")).alias("z"))
    return entries.groupBy(F.col("z.paths").alias("path"), F.col("z.kinds").alias("kind")).agg(F.count("*").alias("n_files"))


def fields_of(statistics: list[tuple[str, str, int]], renames: list[tuple[str, str]]) -> list[tuple[str, str, list[str]]]:
    """(field, JSON type, its paths) of a schema: paths of the same words, or joined by renames, are one field.

    The field bears the name of its most frequent path (ties: byte order), its type is the most
    frequent one of its values; a field with nulls only has the type `null`.
    """
    root: dict[str, str] = {}

    def find(p: str) -> str:
        while root.setdefault(p, p) != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    alike: dict[tuple, str] = {}
    for path, *_ in sorted(statistics):
        same = alike.setdefault(tuple(tuple(sorted(words(level))) or level for level in path.split("/")), path)
        root[find(path)] = find(same)
    for old, new in renames:
        root[find(old)] = find(new)
    seen: dict[str, dict[str, int]] = {}
    kinds: dict[str, dict[str, int]] = {}
    for path, kind, n in statistics:
        of = find(path)
        seen.setdefault(of, {}).setdefault(path, 0)
        seen[of][path] += n
        if kind != "null":
            kinds.setdefault(of, {}).setdefault(kind, 0)
            kinds[of][kind] += n
    first = lambda counts: min(counts, key=lambda k: (-counts[k], k))
    found = [(first(paths), first(kinds[of]) if of in kinds else "null", sorted(paths, key=lambda p: (-paths[p], p))) for of, paths in seen.items()]
    return sorted(found)


def consistent_table(files: DataFrame) -> DataFrame:
    """One row per counting file with every field of all files as a typed column.

    Columns: file_id, series_id, then one per field (fields_of) in order of name, failed_casts and
    unplaced. A field is found under all its names. failed_casts lists the fields whose value is no
    value of the column's type; the column is NULL then, and the raw value is in unplaced, a map of
    path to raw value, which also takes the second value where a file holds a field under two names.
    So no value is lost. Fields that a file lacks or that are null are NULL. A repeated delivery or
    an unreadable payload gives no row (see counting_files); an empty table gives no rows.

    The schema, that is the distinct paths and renames, is read by the driver, as the columns of a
    table must be; its size does not grow with the number of files.
    """
    renames = changes(files).where("change_kind = 'renamed'").select("old_path", "field_path").distinct()
    fields = fields_of([tuple(r) for r in path_statistics(files).collect()], [tuple(r) for r in renames.collect()])
    place = {path: i for i, (_, _, paths) in enumerate(fields) for path in paths}
    rank = {path: k for _, _, paths in fields for k, path in enumerate(paths)}
    kinds = [kind for _, kind, _ in fields]
    schema = "file_id bigint, raws array<string>, unplaced map<string,string>"
    arrow = pa.schema([("file_id", pa.int64()), ("raws", pa.list_(pa.string())), ("unplaced", pa.map_(pa.string(), pa.string()))])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, paths, types, raws in zip(*(batch.column(c).to_pylist() for c in range(4))):
            line, left = [None] * len(fields), []
            known = [e for e in zip(paths, types, raws) if e[0] in place]  # files that don't count may have other paths
            for path, kind, raw in sorted(known, key=lambda e: (place[e[0]], rank[e[0]])):
                at = place[path]
                if raw is None:
                    continue
                fits = kind == kinds[at] or kinds[at] == "string" or (kind == "string" and kinds[at] != "array")
                if line[at] is None and fits:
                    line[at] = raw
                else:
                    left.append((path, raw))
            yield i, line, left

    maps = path_maps(files)
    placed = maps.mapInArrow(_by_batch(arrow, rows, 1_000), schema)
    counting = counting_files(files, maps).select("file_id", "series_id")
    raw = lambda i: F.get("raws", F.lit(i))
    typed = [raw(i).try_cast(COLUMN_TYPES[kind]) for i, kind in enumerate(kinds)]
    lost = F.array_compact(F.array(*[F.when(raw(i).isNotNull() & t.isNull(), F.lit(f[0])) for i, (t, f) in enumerate(zip(typed, fields))]).cast("array<string>"))
    field_of = F.create_map(*[F.lit(x) for path, i in place.items() for x in (path, fields[i][0])]) if place else F.create_map().cast("map<string,string>")
    failed = F.array_sort(F.array_distinct(F.concat(lost, F.transform(F.map_keys("unplaced"), lambda p: field_of[p]))))
    raw_lost = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f[0]).alias("k"), F.when(t.isNull(), raw(i)).alias("v")) for i, (t, f) in enumerate(zip(typed, fields))]), lambda e: e["v"].isNotNull())) if fields else F.col("unplaced")
    return placed.join(counting, "file_id").select("file_id", "series_id", *[t.alias(f[0]) for t, f in zip(typed, fields)], failed.alias("failed_casts"), F.map_concat("unplaced", raw_lost).alias("unplaced"))
