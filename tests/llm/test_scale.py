"""Contraction, cumulative splits, slices, queue cut and looks on shapes that stress them."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.llm import lookalike, mixing, nearest, splits


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    groups = {}
    for x in root:
        groups.setdefault(find(x), set()).add(x)
    return sorted(sorted(g) for g in groups.values())


def shapes():
    rnd = random.Random(4)
    star = [("hub", f"s{i:03}") for i in range(300)]
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)]
    pairs = [(f"p{i}", f"q{i}") for i in range(60)]
    tree = [(f"t{i:03}", f"t{rnd.randrange(i):03}") for i in range(1, 200)]
    dense = [(f"d{rnd.randrange(40)}", f"d{rnd.randrange(40)}") for _ in range(400)]
    return {"star": star, "chain": chain, "pairs": pairs, "tree": tree, "dense": [e for e in dense if e[0] != e[1]], "all": star + chain + pairs + tree}


@pytest.mark.parametrize("name", list(shapes()))
def test_contraction(spark, name):
    edges = shapes()[name]
    got = {}
    for r in splits.contract(spark.createDataFrame(edges, "u string, v string")).collect():
        got.setdefault(r["label"], []).append(r["vertex"])
    assert sorted(sorted(g) for g in got.values()) == components(edges)  # every vertex once


def test_one_group_with_a_third(spark):
    """A key with a third of all rows is spread in the last join and stays in one split."""
    rows = [(i, "hot" if i % 3 == 0 else f"b{i}", None, None) for i in range(3_000)]
    df = spark.createDataFrame(rows, "row_id long, book string, analyst string, s string")
    groups = splits.related_groups(df, "row_id", "book", "analyst", F.col("s")).cache()
    assert groups.count() == 3_000 and groups.where("group_key = 'hot'").count() == 1_000
    targets = spark.createDataFrame([("train", 0.5), ("validation", 0.3), ("test", 0.2)], "split_name string, target_share double")
    assigned = groups.join(splits.assign_splits(groups, targets), "group_id")
    counts = {r["split_name"]: r["count"] for r in assigned.groupBy("split_name").count().collect()}
    assert counts == {"train": 1_500, "validation": 900, "test": 600}
    assert assigned.where("group_key = 'hot'").select("split_name").distinct().count() == 1


def test_splits_without_targets_and_with_one(spark):
    groups = spark.createDataFrame([("g1",), ("g1",), ("g2",)], "group_id string")
    none = splits.assign_splits(groups, spark.createDataFrame([], "split_name string, target_share double"))
    assert {r["split_name"] for r in none.collect()} == {None}
    one = splits.assign_splits(groups, spark.createDataFrame([("all", 1.0)], "split_name string, target_share double"))
    assert {r["split_name"] for r in one.collect()} == {"all"} and one.count() == 2


def test_slices_read_every_row_once(spark):
    """Slices are buckets of time in order; the result does not depend on how many there are."""
    rows = spark.createDataFrame([(i * 60,) for i in range(600)], "epoch long")
    slices = {r["hour"]: r["slice"] for r in nearest._time_slices(rows, 130).collect()}
    assert sorted(slices) == list(range(10)) and list(slices[h] for h in range(10)) == sorted(slices.values()) and max(slices.values()) >= 3


def test_latest_finish_is_late_enough():
    rnd = random.Random(1)
    for _ in range(50):
        items = {k: [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 60))] for k in "abc"}
        shares = dict(zip("abc", (0.6, 0.39, 0.01)))
        budget = rnd.randrange(1, 900)
        end = mixing.latest_finish([(shares[k], sum(v), max(v)) for k, v in items.items()], budget)
        finished = 0
        for k, v in items.items():
            done = 0
            for n in v:
                done += n
                if done / shares[k] <= end:
                    finished += n
        assert finished >= min(budget, sum(map(sum, items.values()))) or end == float("inf")


LOOKS = [("ꓮꓐꓚ", "ABC"), ("ᎬᎢᎷᏚ", "ETMS"), ("ⲞⲢⲥ", "OPc"), ("раураl", "paypal"), ("ｆｕｌｌ", "full"), ("ﬁne", "fine"), ("été", "été"), ("a​b c", "ab c")]


@pytest.mark.parametrize("one, other", LOOKS)
def test_same_look(spark, one, other):
    df = spark.createDataFrame([(1, one), (2, other)], "id long, text string")
    assert [tuple(r) for r in lookalike.alike_pairs(df, "id", "text").collect()] == [(1, 2)]


@pytest.mark.parametrize("one, other", [("x2", "x²"), ("résumé", "resume"), ("A", "a"), ("1", "2"), ("؁2", "2"), ("٣", "3"), ("O", "0"), ("l", "1")])
def test_other_look(spark, one, other):
    df = spark.createDataFrame([(1, one), (2, other)], "id long, text string")
    assert lookalike.alike_pairs(df, "id", "text").count() == 0


def test_classes_count_links(spark):
    """Copies don't link; a text with many copies and one variant makes only pairs that are results."""
    rows = [(i, "pay") for i in range(50)] + [(100, "раy"), (101, "pаy"), (102, None), (103, "other"), (104, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in lookalike.look_links(df, "id", "text").collect()}
    assert got[0] == (0, 2) and got[49] == (0, 2) and got[100] == (0, 51) and got[103] == (103, 0) and got[104] == (104, 0) and 102 not in got
    pairs = lookalike.alike_pairs(df, "id", "text").collect()
    assert len(pairs) == len(set(pairs)) == 101 and all(a < b for a, b in pairs)
    assert lookalike.look_links(df.limit(0), "id", "text").count() == 0
