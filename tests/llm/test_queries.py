"""The subpackage's queries against SQL, and those without SQL against plain implementations."""

import unicodedata
from collections import defaultdict

import pytest

from lodestream.llm import queries, sql, tokens
from tests.compare import check, duck


@pytest.mark.parametrize("name", sorted(sql.SQL))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_against_sql(spark, folder, name):
    check(spark, folder, queries.QUERIES[name], sql.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(sql.SQL)))
def test_without_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    df.collect()
    assert all(kind != "void" for _, kind in df.dtypes)


def documents(folder):
    return duck(folder).sql("SELECT doc_id, text, source FROM documents").fetchall()


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_long_documents(spark, folder):
    count = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    want = sorted(i for i, text, _ in documents(folder) if len(count(text or "")) > 4096)
    assert sorted(r["doc_id"] for r in queries.p7_found(spark, folder).collect()) == want


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_unreachable_sources(spark, folder):
    count = tokens.encoding(tokens.TOKENIZER).encode_ordinary
    rows = [(t, s, len(count(t))) for _, t, s in documents(folder) if s is not None]
    total = sum(n for *_, n in rows)
    supply = defaultdict(int)
    seen = set()
    for t, s, n in rows:
        if t not in seen:
            seen.add(t)
            supply[s] += n
    goals = duck(folder).sql("SELECT * FROM mix_targets").fetchall()
    want = sorted(s for s, share, most in goals if supply[s] * most < share * total)
    assert sorted(r["source_name"] for r in queries.p8_found(spark, folder).collect()) == want


def plain_look(text):
    """A look by Unicode's own compatibility forms, for the characters that the test data uses."""
    raised = {c: f"<{ord(c)}>" for c in "²³¹ªº"}
    same = dict(zip("АВЕКМНОРСТХУЅІЈаеорсухѕіјһԁԛԝɡΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο‐‑", "ABEKMHOPCTXYSIJaeopcyxsijhdqwgABEZHIKMNOPTYXvo--"))
    text = "".join(raised.get(c, c) for c in text)
    text = unicodedata.normalize("NFD", "".join(same.get(c, c) for c in unicodedata.normalize("NFKD", text)))
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cf",) and c not in "͏᠎")
    return " ".join(text.replace("µ", "μ").split())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_alike_documents(spark, folder):
    looks = defaultdict(list)
    for i, t, _ in documents(folder):
        looks[plain_look(t)].append((i, t))
    want = sorted((min(i, j), max(i, j)) for g in looks.values() for i, t in g for j, u in g if i < j and t != u)
    assert sorted(map(tuple, queries.p9_found(spark, folder).collect())) == want


def test_split_shares(spark):
    shares = {r["split_name"]: r for r in queries.p1_shares(spark, "/root/testdata/sf0.01").collect()}
    assert sum(r["n_rows"] for r in shares.values()) == 4000
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.03 for r in shares.values())
