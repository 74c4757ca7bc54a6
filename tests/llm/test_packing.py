"""Packets: nothing lost, doubled, split without need or over a capacity."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hebbspark.llm import packing as K


def check(rows, out, p):
    cap, docs, attention = p.limits
    load, count, cost = Counter(), Counter(), Counter()
    parts = defaultdict(list)
    for r in out:
        load[r.packet] += r.tokens
        count[r.packet] += 1
        cost[r.packet] += r.tokens**2
        parts[r.doc_id].append((r.part, r.start, r.tokens))
    assert max(load.values(), default=0) <= cap and max(count.values(), default=0) <= docs
    assert all(cost[k] <= attention for k in count if count[k] > 1)
    assert set(parts) == {i for i, _ in rows}
    for i, n in rows:
        n, got = n or 0, sorted(parts[i])
        assert sum(t for _, _, t in got) == n and len(got) == max(1, math.ceil(n / cap))
        assert [s for _, s, _ in got] == [k * cap for k in range(len(got))]
    assert sorted(load | count) == list(range(len(count)))
    return load


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_whole_documents(spark, choose):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, None, 3, 40, 100, 2048, 2049, 9000, rng.randint(1, 2500)])) for i in range(3000)]
    p = K.PackParams(choose=choose, shard_rows=200)
    df = spark.createDataFrame(rows, "doc_id long, n long").withColumn("tokens", F.lit(1)).repartition(5)
    out = K.packed(df, p).collect()
    load = check(rows, out, p)
    need = math.ceil(sum(n or 0 for _, n in rows) / 2048)
    if choose == "norm":
        assert len(load) <= 1.02 * need + 2
    again = K.packed(df.repartition(3), p).collect()
    assert {(r.doc_id, r.part): r.packet for r in again} == {(r.doc_id, r.part): r.packet for r in out}


def test_all_capacities_bind(spark):
    rows = [(i, 10) for i in range(500)]
    for p in (K.PackParams(documents=7), K.PackParams(attention_share=0.2, capacity=40), K.PackParams(capacity=25)):
        out = K.packed(spark.createDataFrame(rows, "doc_id long, n long"), p).collect()
        load = check(rows, out, p)
        most = min(p.limits[0] // 10, p.limits[1], p.limits[2] // 100)
        assert len(load) == math.ceil(500 / most)


def test_one_size_holds_everything(spark):
    rows = [(i, 1000) for i in range(2001)]
    out = K.packed(spark.createDataFrame(rows, "doc_id long, n long"), K.PackParams(shard_rows=100)).collect()
    assert len(check(rows, out, K.PackParams())) == 1001


def test_empty(spark):
    assert K.packed(spark.createDataFrame([], "doc_id long, n long")).count() == 0


def test_plan_against_item_by_item_best_fit():
    rng = random.Random(7)
    p = K.PackParams(capacity=100, documents=6)
    for _ in range(20):
        sizes = [rng.randint(0, 100) for _ in range(rng.randint(1, 120))]
        plan = K.plan_packing(Counter(sizes), p)
        bins = []
        for s in sorted(sizes, reverse=True):
            item = (s, 1, s * s)
            if item[2] > p.limits[2]:
                bins.append([0, 0, 0])
                continue
            best = None
            for b in bins:
                if all(b[k] >= item[k] for k in range(3)):
                    v = sum(w * ((b[k] - item[k]) / lim) ** 2 for k, (w, lim) in enumerate(zip(p.weights, p.limits)))
                    if best is None or v < best[0] - 1e-15:
                        best = (v, b)
            if best is None:
                best = (0, list(p.limits))
                bins.append(best[1])
            for k in range(3):
                best[1][k] -= item[k]
        assert abs(plan.bins - len(bins)) <= 1


def test_a_costly_document_is_alone(spark):
    rows = [(1, 97), (2, 96), (3, 3), (4, 2), (5, 94), (6, 6), (7, 100), (8, 250)]
    p = K.PackParams(capacity=100, attention_share=0.9)
    out = K.packed(spark.createDataFrame(rows, "doc_id long, n long"), p).collect()
    load = check(rows, out, p)
    of = {(r.doc_id, r.part): r.packet for r in out}
    assert load[of[1, 0]] == 97 and load[of[2, 0]] == 96 and of[5, 0] == of[6, 0]


def test_violations_are_counted(spark):
    docs = spark.createDataFrame([(i, "") for i in range(1, 7)], "doc_id long, text string")
    p = K.PackParams(capacity=10, documents=2, attention_share=0.5)
    rows = [(1, 0, 0, 0, 8), (2, 0, 0, 0, 4), (3, 0, 1, 0, 1), (3, 0, 1, 0, 1), (4, 0, 1, 0, 3), (4, 1, 1, 3, 2), (5, 0, 3, 0, 9)]
    got = K.violations(spark.createDataFrame(rows, "doc_id long, part int, packet long, start long, tokens long"), docs, p).first().asDict()
    assert got == {"documents": 6, "lost": 1, "doubled": 1, "cut_without_need": 1, "over_tokens": 1, "over_documents": 1, "over_attention": 1, "unused_numbers": 1}


def test_an_item_over_a_capacity_is_an_error():
    with pytest.raises(ValueError):
        K.plan_packing({11: 1}, K.PackParams(capacity=10))
