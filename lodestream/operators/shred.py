"""Nested records into related flat tables: objects are identified bottom-up by the hash of their
canonical content, stored once, and every occurrence kept by a bridge row."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "record_id bigint, node_path string, parent_path string, name string, ordinal int, object_id string, content string, parent_id string"
_NODES = pa.schema([("record_id", pa.int64()), ("node_path", pa.string()), ("parent_path", pa.string()), ("name", pa.string()), ("ordinal", pa.int32()), ("object_id", pa.string()), ("content", pa.string()), ("parent_id", pa.string())])


def readability(text: str | None) -> str:
    """Whether a payload can be read: `object`, `missing`, `other` (JSON, but no object), `too_deep` or `broken`."""
    if text is None:
        return "missing"
    try:
        value = json.loads(text)
        while isinstance(value, str):
            value = json.loads(value)
    except RecursionError:
        return "too_deep"
    except ValueError:
        return "broken"
    return "object" if isinstance(value, dict) else "other"


def read_object(text: str | None) -> dict | None:
    """The JSON object that a payload holds, or None if it can't be read.

    NaN and infinities are numbers; of a repeated name the last value counts. A payload that is a
    string holding an object counts as that object.
    """
    try:
        value = json.loads(text) if text is not None else None
        while isinstance(value, str):
            value = json.loads(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def unwrap(value: Any) -> Any:
    """A string that is itself a JSON object or array as what it holds; anything else as it is."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            held = json.loads(value)
        except (ValueError, RecursionError):
            break
        value = held
    return value


def shred(record_id: int, top: dict) -> list[tuple]:
    """NODES rows of every object of a record; the top one has node_path '' and no parent.

    Works with a stack, not by recursion. parent_id is the identity of the parent. An object's canonical content is its fields in order of
    name, with objects inside (also those in arrays) replaced by their ids; equal content gives
    the equal SHA-256 id, whatever the order of fields.
    """
    rows: list[tuple] = []
    parts: dict[int, str] = {}
    stack: list[tuple] = [(top, "", None, "", 0, False)]
    while stack:
        value, path, parent, name, ordinal, done = stack.pop()
        is_object = isinstance(value, dict)
        if not done:
            stack.append((value, path, parent, name, ordinal, True))
            inner = path if is_object else parent
            items = value.items() if is_object else enumerate(value)
            for at, (key, child) in enumerate(list(items)):
                held = unwrap(child)
                if held is not child:
                    value[key] = held
                if isinstance(held, (dict, list)):
                    below = f"{path}/{key}" if path else str(key)
                    stack.append((held, below, inner, str(key), at, False))
        elif is_object:
            content = "{" + ",".join(f"{json.dumps(k)}:{_part(value[k], parts)}" for k in sorted(value)) + "}"
            identity = hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()
            parts[id(value)] = json.dumps({"$ref": identity})
            rows.append((record_id, path, parent, name, ordinal, identity, content.encode("utf-8", "replace").decode()))
        else:
            parts[id(value)] = "[" + ",".join(_part(x, parts) for x in value) + "]"
    identities = {row[1]: row[5] for row in rows}
    return [(*row, identities.get(row[2])) for row in rows]


def _part(value: Any, parts: dict[int, str]) -> str:
    return parts[id(value)] if isinstance(value, (dict, list)) else json.dumps(value)


def _by_batch(schema: pa.Schema, rows_of: Callable[[pa.RecordBatch], Iterator[tuple]], at_once: int = 20_000) -> Callable:
    """mapInArrow function of a row generator; batches are kept small whatever a record holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in rows_of(batch):
                rows.append(row)
                if len(rows) >= at_once:
                    yield _batch(rows, schema)
                    rows = []
        if rows:
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def latest_readable(df: DataFrame, key: str, order: str, row_id: str, payload: str) -> DataFrame:
    """Of each key the readable row with the largest `order` (then row_id); NULL is a key too.

    A row without `order` is older than all others. Only ids are gathered by key, never payloads.
    """

    def readable(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if read_object(text) is not None:
                yield (i,)

    ids = df.select(row_id, payload).mapInArrow(_by_batch(pa.schema([("__chosen_id", pa.int64())]), readable), "__chosen_id bigint")
    # a readable row's key and order come from the table again: cheaper than to move them through Python
    known = df.select(row_id, key, order).join(ids, F.col(row_id) == F.col("__chosen_id"), "left_semi")
    chosen = known.groupBy(key).agg(F.max(F.struct(F.col(order), F.col(row_id))).alias("top")).select(F.col(f"top.{row_id}").alias("__chosen_id"))
    return df.join(chosen, F.col(row_id) == F.col("__chosen_id"), "left_semi")


def readable_counts(df: DataFrame, payload: str) -> DataFrame:
    """(readable, n): how many payloads can be read, and why the others can't."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        counts: dict[str, int] = {}
        for text in batch.column(0).to_pylist():
            kind = readability(text)
            counts[kind] = counts.get(kind, 0) + 1
        yield from counts.items()

    schema = pa.schema([("readable", pa.string()), ("n", pa.int64())])
    return df.select(payload).mapInArrow(_by_batch(schema, rows), "readable string, n bigint").groupBy("readable").agg(F.sum("n").alias("n"))


def occurrences(df: DataFrame, row_id: str, payload: str) -> DataFrame:
    """One row (NODES) for each object of each readable payload, the top one included."""

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            top = read_object(text)
            if top is not None:
                yield from shred(i, top)

    return df.select(row_id, payload).mapInArrow(_by_batch(_NODES, rows), NODES)


def object_table(nodes: DataFrame) -> DataFrame:
    """Every distinct object once: object_id, content, and how often it occurs."""
    return nodes.groupBy("object_id").agg(F.max("content").alias("content"), F.count("*").alias("n_occurrences"))


def bridge_table(nodes: DataFrame) -> DataFrame:
    """Parent-child bridge: every occurrence with its object, its parent's object and its ordinal."""
    return nodes.select("record_id", "node_path", "parent_path", "name", "ordinal", "object_id", "parent_id")


def leaf_table(objects: DataFrame) -> DataFrame:
    """object_id, field, raw value of the fields of distinct objects that are no objects."""
    fields = F.from_json("content", "map<string,string>", {"allowNonNumericNumbers": "true"})
    return objects.select("object_id", F.explode(fields).alias("field", "raw")).where(~F.coalesce(F.col("raw").startswith('{"$ref"'), F.lit(False)))


