"""Co-occurring pairs against plain counting."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from hebbspark.llm import cooccur as C


def plain(rows, ids, min_count, min_lift):
    ticks = defaultdict(set)
    for a, b, t in rows:
        if a and b and a > 0 and b > 0 and a != b and a in ids and b in ids and t is not None:
            ticks[t] |= {a, b}
    n = Counter(x for s in ticks.values() for x in s)
    both = Counter(p for s in ticks.values() for p in itertools.combinations(sorted(s), 2))
    return {p: c for p, c in both.items() if c >= min_count and c * len(ticks) >= min_lift * n[p[0]] * n[p[1]]}


def events(seed, big=0):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 30)) for _ in range(400)]
    rows += [(1, rng.randint(2, 40), t) for t in range(1, 31)]
    for t in range(40, 40 + big):
        rows += [(i, i + 1, t) for i in range(1, 60)]
    return rows + [(None, 2, 3), (2, None, 3), (2, 3, None), rows[0]]


@pytest.mark.parametrize("block", [256, 8])
@pytest.mark.parametrize("lift", [1, 2.0])
def test_counts(spark, block, lift):
    rows, ids = events(2, 6), set(range(1, 36)) | set(range(45, 60))
    e = spark.createDataFrame(rows, "a long, b long, tick long")
    i = spark.createDataFrame([(x,) for x in [*ids, 5, None]], "id long")
    got = {(r.a, r.b): r.n_ab for r in C.cooccurring(e, i, 3, lift, block=block).collect()}
    assert got == plain(rows, ids, 3, lift) and got


def test_scores(spark):
    rows = [(1, 2, t) for t in range(4)] + [(3, 4, t) for t in range(4, 8)] + [(1, 3, 9)]
    e, i = spark.createDataFrame(rows, "a long, b long, tick long"), spark.createDataFrame([(x,) for x in range(1, 5)], "id long")
    got = {(r.a, r.b): r for r in C.cooccurring(e, i, 2, 1).collect()}
    r = got[1, 2]
    assert (r.n_ab, r.n_a, r.n_b, r.baskets) == (4, 5, 4, 9) and r.lift == pytest.approx(4 * 9 / 20) and r.conviction == pytest.approx((1 - 4 / 9) / (1 - 4 / 5))


def test_identical_large_baskets_are_counted_once_each(spark):
    rows = [(i, i + 1, t) for t in range(5) for i in range(1, 40)] + [(100 + t, 200 + t, t + 50) for t in range(30)]
    e = spark.createDataFrame(rows, "a long, b long, tick long")
    items = C.basket_items(C.valid_events(e, spark.createDataFrame([(x,) for x in range(1, 300)], "id long")))
    got = {(r.a, r.b): r.n for r in C.collapsed_pairs(items, 8).collect()}
    assert got[1, 40] == 5 and len(got) == 40 * 39 // 2 + 30


def test_empty(spark):
    e, i = spark.createDataFrame([], "a long, b long, tick long"), spark.createDataFrame([], "id long")
    assert C.cooccurring(e, i).count() == 0
