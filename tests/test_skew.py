"""Joins with hot keys give the same rows as plain joins."""

import random

import pytest
from pyspark.sql import functions as F

from hebbspark.operators import activate as A
from hebbspark.operators import lexical as L
from hebbspark.operators import lifecycle as M
from hebbspark.operators import ranking as K
from hebbspark.operators import skew


@pytest.mark.parametrize("limit", [1, 4, 1 << 14])
def test_lookup_join(spark, limit):
    rng = random.Random(1)
    left = [(i, rng.choice(["hot", "hot", "hot", f"k{i % 9}", None, "x" * 300])) for i in range(200)]
    count = {k: sum(r[1] == k for r in left) for k in {r[1] for r in left if r[1]}}
    right = [(k, n, len(k)) for k, n in count.items() if k != "k3"]
    got = skew.lookup_join(spark.createDataFrame(left, "id long, key string"), spark.createDataFrame(right, "key string, n long, size int"), "key", "n", limit)
    assert sorted((r.id, r.key, r.size) for r in got.collect()) == sorted((i, k, len(k)) for i, k in left if k and k != "k3")


def test_empty_sides(spark):
    left, right = spark.createDataFrame([], "id long, key long"), spark.createDataFrame([], "key long, n long")
    assert skew.lookup_join(left, right, "key", "n").count() == 0


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    rng = random.Random(2)
    big = [(i, rng.choice([7, 7, 7, rng.randint(0, 20), None])) for i in range(300)]
    small = [(k, f"v{k}") for k in [*range(0, 15), 7]]
    b, s = spark.createDataFrame(big, "id long, key long"), spark.createDataFrame(small, "key long, v string")
    hot = skew.hot_keys(b.where("key IS NOT NULL").groupBy("key").count(), ["key"], "count", share=4, least=50)
    assert len(hot) == 1
    rows = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
    got = skew.salted_join(b, s, ["key"], hot, how, salts=5)
    assert rows(got) == rows(b.join(s, ["key"], how)) and set(got.columns) == set(b.join(s, ["key"], how).columns)
    assert skew.hot_keys(b.limit(0).groupBy("key").count(), ["key"], "count") == []


def test_hubs_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST", 10)
    rows = [(1, x, 1.0 / 60) for x in range(2, 62)] + [(x, 1, 1.0) for x in range(2, 62)]
    trans = spark.createDataFrame(rows, "src long, dst long, share double")
    seeds = spark.createDataFrame([(1, 1, 0.5), (1, 5, 0.5), (2, 9, 1.0)], "query_id long, node long, weight double")
    assert len(A.hubs(trans)) == 1
    rows = lambda a: {(r.query_id, r.node): r.score for r in a.scores.collect()}
    plain = rows(A.activate(seeds, trans, 2, 1e-3, None, hot=[]))
    assert rows(A.activate(seeds, trans, 2, 1e-3, None)) == plain == rows(A.activate(seeds, trans, 2, 1e-3, None, mass=1.0)) and len(plain) == 122
    assert rows(A.activate(seeds, trans, 2, 0.02, None, mass=1.0)) == rows(A.activate(seeds, trans, 2, 0.02, None, hot=[]))


def test_hot_ends_and_terms(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST", 10)
    e = spark.createDataFrame([(i, 1 if i % 3 == 0 else i + 1, i + 2, 0) for i in range(90)], "seq long, a long, b long, tick long")
    ids = spark.createDataFrame([(i,) for i in range(1, 50)], "id long")
    assert {r.seq for r in M.with_live_ends(e, ids).collect()} == {i for i in range(90) if (i % 3 == 0 or i + 1 < 50) and i + 2 < 50}
    _, left = M.forget(ids, e, ids.where("id = 1"))
    assert {r.seq for r in left.collect()} == {i for i in range(90) if i % 3 and i + 1 != 1}
    docs = L.documents(spark.createDataFrame([(i, f"common w{i % 7}") for i in range(1, 61)], "id long, content string"))
    q = spark.createDataFrame([(1, "common w3"), (2, "common")], "query_id long, query string")
    hot = sorted((r.query_id, r.id, r.lexical) for r in L.bm25(q, docs).collect())
    monkeypatch.setattr(skew, "HOT_LEAST", 10**9)
    assert hot == sorted((r.query_id, r.id, r.lexical) for r in L.bm25(q, docs).collect()) and len(hot) == 120


def test_numbered_and_ordered_get(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, id long").repartition(7)
    got = {r.id: r.n for r in K.numbered(df, ["k", F.col("id").desc()]).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0], -r[1])), 1)}
    assert K.numbered(df.limit(0), ["id"]).count() == 0
    asked = spark.createDataFrame([(1, [3, 900, 1, 3]), (2, [])], "request long, ids array<long>")
    out = K.ordered_get(asked, df, ["request"]).orderBy("request", "place").collect()
    assert [(r.request, r.id) for r in out] == [(1, 3), (1, 1), (1, 3)]
