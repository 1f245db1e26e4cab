"""Nested records and drifting schemas against plain implementations and by hand."""

import hashlib
import json

import pytest

from lodestream.operators import drift, shred
from lodestream.plans import general

def objects(value, path="", parent=None):
    """All objects by plain recursion: (path, parent)."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            value = json.loads(value)
        except ValueError:
            return
        yield from objects(value, path, parent)
    elif isinstance(value, dict):
        if parent is not None:
            yield path, parent
        for k, v in value.items():
            yield from objects(v, f"{path}/{k}" if path else k, path)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from objects(v, f"{path}/{i}" if path else str(i), parent)

def test_found_against_recursion(spark, small):
    rows = spark.read.parquet(f"{small}/run_records.parquet").collect()
    best = {}
    for r in rows:
        top = shred.read_object(r["payload"])
        if top is not None:
            mark = (r["exported_at"] is not None, r["exported_at"], r["record_id"])
            if r["run_key"] not in best or mark > best[r["run_key"]][0]:
                best[r["run_key"]] = (mark, r["record_id"], top)
    want = sorted((i, p, q) for _, i, top in best.values() for p, q in objects(top))
    assert sorted(map(tuple, general.p4_found(spark, small).collect())) == want

def test_shred_by_hand():
    text = '{"a": {"x": 1, "y": {}}, "b": [{"y": {}, "x": 1}, "{\\"x\\": 1, \\"y\\": {}}", null, "{broken"], "c": null, "e": NaN}'
    rows = shred.shred(7, shred.read_object(text))
    at = {r[1]: (r[2], r[5]) for r in rows}
    assert set(at) == {"", "a", "a/y", "b/0", "b/0/y", "b/1", "b/1/y"}
    assert at["b/1/y"][0] == "b/1" and at["b/1"][0] == "" and at[""][0] is None
    assert at["a"][1] == at["b/0"][1] == at["b/1"][1]  # one identity whatever the order of fields
    assert at["a/y"][1] == hashlib.sha256(b"{}").hexdigest()

def test_records_round_trip():
    """Bridge and object table give the record back."""
    top = {"a": {"n": 1, "m": [1, {"k": "v"}, [{"k": "v"}]]}, "b": {"k": "v"}}
    rows = shred.shred(1, json.loads(json.dumps(top)))
    content = {r[5]: json.loads(r[6]) for r in rows}

    def build(x):
        if isinstance(x, dict):
            return build(content[x["$ref"]]) if set(x) == {"$ref"} else {k: build(v) for k, v in x.items()}
        return [build(v) for v in x] if isinstance(x, list) else x

    assert build(content[next(r[5] for r in rows if r[1] == "")]) == top

def test_awkward_records(spark):
    long = json.dumps({"t": "x" * 300_000, "o": {"t": "y" * 300_000}})
    deep = '{"a":' * 300 + "1" + "}" * 300
    rows = [(1, None, None, "{}", 0), (2, None, None, long, 0), (3, "k", None, None, 0), (4, "k", None, "[1]", 0), (5, "d", None, deep, 0), (5, "d", None, deep, 0), (6, "e", None, "", 0)]
    df = spark.createDataFrame(rows, "record_id long, run_key string, exported_at timestamp, payload string, _id long")
    kept = shred.latest_readable(df, "run_key", "exported_at", "record_id", "payload")
    assert sorted(r["record_id"] for r in kept.collect()) == [2, 5, 5]
    nodes = shred.occurrences(kept, "record_id", "payload")
    assert nodes.where("record_id = 2").count() == 2 and nodes.where("record_id = 5").count() == 600
    assert shred.object_table(nodes).count() == 302
    assert shred.leaf_table(shred.object_table(nodes)).where("field = 't'").count() == 2
    empty = df.limit(0)
    assert shred.occurrences(shred.latest_readable(empty, "run_key", "exported_at", "record_id", "payload"), "record_id", "payload").count() == 0

def plain_changes(files):
    """Changes by a plain walk over each series."""
    series = {}
    for f in files:
        top = shred.read_object(f["payload"])
        if top is None or f["series_id"] is None or f["written_at"] is None:
            continue
        slot = series.setdefault(f["series_id"], {})
        if f["written_at"] not in slot or f["file_id"] < slot[f["written_at"]][0]:
            slot[f["written_at"]] = (f["file_id"], {p: drift.kind_of(v) for p, v in drift.leaves(top)})
    out = []
    for slot in series.values():
        walk = [slot[at] for at in sorted(slot)]
        kinds = {}
        for n, (file_id, fields) in enumerate(walk):
            if n:
                was = walk[n - 1][1]
                new = [p for p in fields if all(p not in w for _, w in walk[:n])]
                gone = [p for p in was if all(p not in w for _, w in walk[n:])]

                pairs = sorted(((drift.same_field(o, p), o, p) for o in gone for p in new if None in (kinds.get(o), first_kind(walk, n, p)) or last_kind(walk, o) == first_kind(walk, n, p)), key=lambda x: (-x[0], x[1], x[2]))
                used = set()
                for score, o, p in pairs:
                    if score and ("o", o) not in used and ("p", p) not in used:
                        used |= {("o", o), ("p", p)}
                        out.append((file_id, "renamed", p, o))
                out += [(file_id, "added", p, "") for p in new if ("p", p) not in used]
                out += [(file_id, "removed", o, "") for o in gone if ("o", o) not in used]
            for p, kind in fields.items():
                if kind != "null":
                    if kinds.get(p, kind) != kind:
                        out.append((file_id, "retyped", p, ""))
                    kinds[p] = kind
    return sorted(out)

def first_kind(walk, n, p):
    return min(((i, w[p]) for i, (_, w) in enumerate(walk) if w.get(p, "null") != "null"), default=(0, None))[1]

def last_kind(walk, p):
    return max(((i, w[p]) for i, (_, w) in enumerate(walk) if w.get(p, "null") != "null"), default=(0, None))[1]

@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_changes_against_a_plain_walk(spark, folder):
    files = spark.read.parquet(f"{folder}/result_files.parquet")
    assert sorted(map(tuple, general.p2_found(spark, folder).collect())) == plain_changes(files.collect())

@pytest.mark.parametrize(
    ("old", "new", "same"),
    [
        ("a/frac_clear", "a/fracClear", True), ("a/frac_clear", "a/ClearFrac", True), ("a/frac_clear", "a/fracclear", True), ("pooled_n", "NumberPooled", True),
        ("verdict/any_calibration_certified", "VERDICT/calib_cert_any", True), ("x/DOWN_certified", "x/certDown", True), ("x/DOWN_certified", "x/DOWNCertified", True),
        ("iso/abs/thr", "iso/abs/threshold", True), ("a/win", "a/sharpe", False), ("a/b", "b/a", False), ("a/b", "a/b/c", False), ("ci_lo", "ci_hi", False), ("year_2024/n", "year_2025/n", False),
        ("dir_baseline", "DirectionBase", True), ("a_b", "a_b_c", False),
    ],
)
def test_same_field(old, new, same):
    assert bool(drift.same_field(old, new)) is same and bool(drift.same_field(new, old)) is same

def test_awkward_files(spark):
    from datetime import datetime

    day = lambda n: datetime(2020, 1, 1 + n)
    rows = [
        (1, "s", day(0), '{"a": 1, "b": null}', 9), (2, "s", day(0), '{"zz": 1}', 9), (3, "s", day(1), '{"a": "1", "b": null', 9), (4, "s", day(2), '{"a": NaN, "b": true, "c": {}}', 9),
        (5, "s", day(20), '{"a": [1], "B": true}', 9), (6, None, day(3), '{"q": 1}', 9), (7, "s", None, '{"q": 1}', 9), (8, "t", day(0), None, 9), (9, "t", day(1), "", 9), (5, "s", day(20), '{"a": [1], "B": true}', 9),
    ]
    df = spark.createDataFrame(rows, "file_id long, series_id string, written_at timestamp, payload string, shard int").withColumnRenamed("shard", "paths")
    found = drift.changes(df).select("file_id", "change_kind", "field_path", "old_path")
    assert sorted(map(tuple, found.collect())) == [(5, "renamed", "B", "b"), (5, "retyped", "a", "")]
    assert drift.changes(df.limit(0)).count() == 0
    typed = {r["file_id"]: r for r in drift.typed_table(df, [("a", "A", "double"), ("b", "b", "boolean")]).collect()}
    assert typed[1]["a"] == 1.0 and typed[5]["failed_casts"] == ["a"] and typed[5]["b"] is True and typed[2]["a"] is None


def test_long_and_mixed_renames():
    """Any number of words may be joined, also together with shortening."""
    from lodestream.operators.drift import same_field

    assert same_field("a_b_c_d_e_f_g", "gfedcba") == 2
    assert same_field("alphabetagammadeltaepszetaeta", "alpha_beta_gamma_delta_eps_zeta_eta") == 2
    assert same_field("alpha_beta_gamma_delta_eps_zeta_eta_theta_iota_kappa", "al_be_ga_de_ep_ze_et_th_io_ka") == 1
    assert same_field("path_mean_calibration", "pathmean_calib") == 1
    assert same_field("verdict/down_certified", "VERDICT/downcert") == 4
    assert same_field("mean_of_path", "mean_path") == 0
    assert same_field("a/b", "a_b") == 0


def test_agreement_against_all_ways():
    """Joined and shortened words against a search through all partitions of short lists."""
    from itertools import permutations, product

    from lodestream.operators.drift import _agree

    def pieces(x, parts):
        if not parts:
            return not x
        return any(x[:k] and (x[:k].startswith(parts[0]) or parts[0].startswith(x[:k])) and pieces(x[k:], parts[1:]) for k in range(1, len(x) + 1))

    def groups(a, b):
        if not a:
            return not b
        for n in range(1, len(b) + 1):
            for part in permutations(range(len(b)), n):
                if pieces(a[0], [b[i] for i in part]) and groups(a[1:], [w for i, w in enumerate(b) if i not in part]):
                    return True
        for j, w in enumerate(b):
            for n in range(1, len(a)):
                for others in permutations(range(1, len(a)), n):
                    for at in range(n + 1):
                        order = [a[i] for i in others]
                        order.insert(at, a[0])
                        if pieces(w, order) and groups([x for i, x in enumerate(a) if i and i not in others], b[:j] + b[j + 1 :]):
                            return True
        return False

    some = ["a", "ab", "ba", "abb", "c", "cab"]
    lists = [list(p) for n in (1, 2) for p in product(some, repeat=n)] + [["a", "b", "c"], ["ab", "c", "a"], ["cab", "b", "a"]]
    for a in lists:
        for b in lists:
            assert _agree(a, b, False) == groups(a, b), (a, b)


def test_consistent_table(spark):
    """All fields, under all names; nothing is lost."""
    import datetime as dt
    import json

    from lodestream.operators.drift import consistent_table

    at = [dt.datetime(2020, 1, d) for d in range(1, 6)]
    rows = [
        (1, "s", at[0], json.dumps({"a": {"max_n": 1, "ok": True}, "t": "x", "list": [1]})),
        (2, "s", at[1], '{"a": {"MaxN": NaN, "ok": "maybe"}, "t": null, "list": "none"}'),
        (3, "s", at[1], json.dumps({"a": {"max_n": 9}})),  # a repeated delivery
        (4, "s", at[2], json.dumps({"a": {"max_n": 3, "MaxN": 4}, "t": 5, "only_null": None})),
        (5, "s", at[3], "no json"),
        (6, None, at[4], json.dumps({"z": 1})),
        (7, "s", at[4], json.dumps({"a": {"ok": True}, "t": "y", "list": [2, 3]})),
    ]
    df = spark.createDataFrame(rows, "file_id long, series_id string, written_at timestamp, payload string")
    table = consistent_table(df)
    assert table.columns == ["file_id", "series_id", "a/MaxN", "a/ok", "list", "only_null", "t", "failed_casts", "unplaced"]  # equally frequent names: byte order
    got = {r["file_id"]: tuple(r)[2:] for r in table.collect()}
    assert sorted(got) == [1, 2, 4, 7]
    assert got[1] == (1.0, True, "[1]", None, "x", [], {})
    assert got[2][0] != got[2][0] and got[2][1:] == (None, None, None, None, ["a/ok", "list"], {"a/ok": "maybe", "list": "none"})
    assert got[4] == (4.0, None, None, None, "5", ["a/MaxN"], {"a/max_n": "3"})
    assert got[7] == (None, True, "[2, 3]", None, "y", [], {})
    empty = consistent_table(df.limit(0))
    assert empty.columns == ["file_id", "series_id", "failed_casts", "unplaced"] and empty.count() == 0
