"""The subpackage's operators: awkward input, invariants, brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import lookalike, mixing, nearest, packing, splits, tokens


def plain_groups(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    clean = lambda k: k.strip().lower() if k and k.strip() else None
    for i, e, a, s in rows:
        for key in (("e", clean(e)), ("a", clean(a)), ("s", s)):
            if key[1] is not None:
                parent[find(("r", i))] = find(key)
    groups = {}
    for i, e, _, _ in rows:
        groups.setdefault(find(("r", i)), []).append(clean(e))
    return {i: min((k for k in groups[find(("r", i))] if k is not None), default=None) for i, *_ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_groups(spark, seed):
    rnd = random.Random(seed)
    pick = lambda tag, n: rnd.choice([None, " ", *[f"{tag}{k}" for k in range(n)], f" {tag.upper()}{rnd.randrange(n)} "])
    rows = [(i, pick("b", 60), pick("an", 60), rnd.choice([None, *[f"s{k}" for k in range(150)]])) for i in range(200)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "row_id long, book string, analyst string, s string, label string, vertex int")
    got = splits.related_groups(df, "row_id", "book", "analyst", F.col("s"))
    assert {r["row_id"]: r["group_key"] for r in got.collect()} == plain_groups(rows) and got.count() == 200


def test_groups_hot_key_chain_and_empty(spark):
    chain = [(i, f"b{i:04d}", f"a{i}", None) for i in range(120)] + [(1000 + i, f"b{i + 1:04d}", f"a{i}", None) for i in range(119)]
    hot = [(5000 + i, "hot", None, f"t{i}") for i in range(500)]
    df = spark.createDataFrame(chain + hot, "row_id long, book string, analyst string, s string")
    keys = {r["group_key"] for r in splits.related_groups(df, "row_id", "book", "analyst", F.col("s")).collect()}
    assert keys == {"b0000", "hot"}
    empty = splits.related_groups(df.limit(0), "row_id", "book", "analyst", F.col("s"))
    assert empty.count() == 0
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, target_share double")
    assert splits.assign_splits(empty, targets).count() == 0
    lone = df.withColumn("group_id", F.col("row_id").cast("string"))
    shares = lone.join(splits.assign_splits(lone, targets), "group_id").groupBy("split_name").count().collect()
    assert {r["split_name"]: r["count"] / 739 for r in shares}["train"] == pytest.approx(0.8, abs=0.01)


def plain_nearest(left, right, tol):
    last = {}
    for key, t, i, ok in right:
        if key is not None and t is not None and (key, t) not in last or (key, t) in last and last[(key, t)][0] < i:
            last[(key, t)] = (i, ok)
    out = []
    for key, t, i in left:
        near = [(abs(t - u), u, j) for (k, u), (j, ok) in last.items() if k == key and ok and abs(t - u) <= tol] if key is not None and t is not None else []
        if near:
            out.append((i, min(near)[2]))
    return sorted(out)


@pytest.mark.parametrize("slice_rows", [10**6, 120])
def test_nearest_replay(spark, slice_rows):
    rnd = random.Random(slice_rows)
    key = lambda: rnd.choice(["a", "a", "b", None])
    left = [(key(), rnd.choice([None, *range(0, 9000, 3)]), i) for i in range(150)]
    right = [(key(), rnd.choice([None, *range(0, 9000)]), i, rnd.random() < 0.8) for i in range(600)]
    right += right[:30]
    side = lambda rows, schema: spark.createDataFrame(rows, schema)
    l = nearest.tag(side(left, "k string, t long, i long"), is_left=True, entity="k", epoch="t", row_id="i", tol=F.lit(9), usable=F.lit(True), tolerance=9)  # noqa: E741
    r = nearest.tag(side(right, "k string, t long, i long, ok boolean"), is_left=False, entity="k", epoch="t", row_id="i", tol=F.lit(0), usable=F.col("ok"), tolerance=9)
    assert sorted(map(tuple, nearest.replay_nearest(spark, l, r, 9, slice_rows).collect())) == plain_nearest(left, right, 9)


def test_nearest_empty(spark):
    none = spark.createDataFrame([], "k string, t long, i long")
    l = nearest.tag(none, is_left=True, entity="k", epoch="t", row_id="i", tol=F.lit(9), usable=F.lit(True), tolerance=9)  # noqa: E741
    r = nearest.tag(none, is_left=False, entity="k", epoch="t", row_id="i", tol=F.lit(0), usable=F.lit(True), tolerance=9)
    assert nearest.replay_nearest(spark, l, r, 9).count() == 0


def test_match_ties():
    a = lambda *x: np.array(x)
    assert nearest.match_nearest(a(10, 20), a(5, 5), a(5, 15, 15, 25), a(1, 2, 3, 4), a(True, True, False, True)).tolist() == [1, 4]
    assert nearest.match_nearest(a(10), a(5), a(), a(), a()).tolist() == [-1]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=64, max_size=64))
def test_patterns_respect_the_histogram(counts):
    histogram = np.array(counts)
    patterns, repeats = packing.fit_patterns(histogram, 64)
    if len(repeats):
        assert (patterns @ repeats <= histogram).all() and (repeats > 0).all()
        assert ((patterns * np.arange(1, 65)[:, None]).sum(axis=0) <= 64).all()


@pytest.mark.parametrize("sizes", ["mixed", "one", "tiny", "empty", "long"])
def test_packing(spark, sizes):
    rnd = random.Random(1)
    rows = {
        "mixed": [(i, rnd.choice([rnd.randrange(5, 400), rnd.randrange(30, 3000), 0])) for i in range(3000)],
        "one": [(i, 700) for i in range(1000)], "tiny": [(i, 1) for i in range(900)], "empty": [], "long": [(1, 4096), (2, 4097), (3, 100_000), (4, 4095)],
    }[sizes]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, n_tokens long, class int, part int")
    out = packing.pack(df.select("doc_id", "n_tokens"), 4096).collect()
    got, windows = {}, {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r)
        windows[r["window_id"]] = windows.get(r["window_id"], 0) + r["n_tokens"]
    assert {i: sum(r["n_tokens"] for r in parts) for i, parts in got.items()} == dict(rows)
    assert all(len(parts) == 1 for i, parts in got.items() if dict(rows)[i] <= 4096)
    assert all(n <= 4096 for n in windows.values())
    if sizes == "mixed":
        assert sum(windows.values()) / len(windows) / 4096 > 0.97
    if sizes == "one":
        assert len(windows) <= 205


def test_mixture(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["a", "a", "a", "b", "c", None, "zz"]), f"t{i % 4000}", rnd.randrange(20, 300)) for i in range(5000)]
    sized = {}
    docs = [(i, s, t, sized.setdefault(t, n)) for i, s, t, n in docs]
    df = spark.createDataFrame(docs, "doc_id long, source string, text_key string, n_tokens long")
    goals = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source_name string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(df, goals)
    rows = chosen.collect()
    uses = {}
    text = {i: t for i, _, t, _ in docs}
    for r in rows:
        uses[text[r["doc_id"]]] = uses.get(text[r["doc_id"]], 0) + 1
    most = {"a": 1, "b": 2, "c": 3}
    assert all(uses[text[r["doc_id"]]] <= most[r["source_name"]] for r in rows)
    budget = sum(n for _, s, _, n in docs if s is not None)
    assert sum(r["n_tokens"] for r in rows) <= budget
    again = mixing.mixture(df.repartition(5), goals)[0]
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again.collect()))
    empty = mixing.mixture(df.limit(0), goals)
    assert empty[0].count() == 0 and empty[1].count() == 4


def test_mixture_reaches_feasible_targets(spark):
    docs = [(i, "abc"[i % 3], f"t{i}", 100) for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text_key string, n_tokens long")
    goals = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.2, 2)], "source_name string, target_share double, max_repeats int")
    shares = {r["source_name"]: r["actual_share"] for r in mixing.mixture(df, goals)[1].collect()}
    assert shares["a"] == pytest.approx(0.5, abs=0.002) and shares["c"] == pytest.approx(0.2, abs=0.002)


def test_tokens(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "Hello world <|endoftext|>", 1), (4, "wörd " * 100_000, 1), (3, "Hello world <|endoftext|>", 1)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tokens.count_tokens(df, "doc_id", "text").collect()))
    count = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    assert got == sorted([(1, 0), (2, 0), (3, len(count("Hello world <|endoftext|>"))), (4, len(count("wörd " * 100_000))), (3, len(count("Hello world <|endoftext|>")))])


SAME = [
    ("ｆｕｌｌ １２", "full 12"), ("café", "café"), ("a b", "a b"), ("a​b", "ab"), ("ﬁne ﬂow", "fine flow"), ("рaypal", "paypal"), ("co­op", "coop"), ("Τhe", "The"), ("ⅾo", "do"), ("нё", "нё"), ("ｶﾞｽ", "ガス"),
    ("non‑stop", "non-stop"), ("о́", "ó"), ("K", "K"), ("a  b", "a b"), (" a　", "a"), ("x\r\ny", "x\ny"), ("µ", "μ"), ("ё", "ë"), ("﻿text", "text"),
]
APART = [("x²", "x2"), ("A", "a"), ("é", "e"), ("1", "l"), ("O", "0"), ("5", "6"), ("ü", "u"), ("H₂O", "H2O"), ("a b", "ab"), ("a\nb", "a b"), ("ß", "ss"), ("1ª", "1a")]


def test_looks(spark):
    texts = [t for pair in SAME + APART for t in pair]
    df = spark.createDataFrame([*[(i, t, 1) for i, t in enumerate(texts)], (900, None, 1), (901, "", 1), (902, "​", 1), (903, "long " * 200_000, 1)], "doc_id long, text string, form int")
    form = {r["doc_id"]: r["form"] for r in lookalike.consistent(df, "doc_id", "text").collect()}
    for i, (a, b) in enumerate(SAME):
        assert form[2 * i] == form[2 * i + 1], (a, b, form[2 * i], form[2 * i + 1])
    for i, (a, b) in enumerate(APART, len(SAME)):
        assert form[2 * i] != form[2 * i + 1], (a, b)
    assert 900 not in form and form[901] == form[902] == "" and len(form[903]) == 999_999
    again = lookalike.consistent(spark.createDataFrame([(i, f) for i, f in form.items()], "doc_id long, text string"), "doc_id", "text")
    assert {r["doc_id"]: r["form"] for r in again.collect()} == form  # a form is its own form


def test_pairs_and_classes(spark):
    rows = [(1, "abc", "x"), (2, "аbc", "x"), (3, "abc", "x"), (4, "other", "x"), (5, "other", "x"), (6, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form_key string")
    assert sorted(map(tuple, lookalike.alike_pairs(df, "doc_id", "text").collect())) == [(1, 2), (2, 3)]
    assert sorted(map(tuple, lookalike.look_classes(df, "doc_id", "text").collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    assert lookalike.alike_pairs(df.limit(0), "doc_id", "text").count() == 0
