"""Edge algebra against hand-computed values and a sequential replay."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from hebbspark.operators import edges as E
from hebbspark.params import ConfigError, EdgeParams

EVENTS = "seq long, a long, b long, tick long"
HALF = EdgeParams(lam=0.5)


def log(spark, rows):
    return spark.createDataFrame([(i + 1, a, b, t) for i, (a, b, t) in enumerate(rows)], EVENTS)


def state(df):
    return {(r.a, r.b): (r.weight, r.last_tick) for r in df.collect()}


def replay(rows, lam, eta=1.0):
    out = {}
    for a, b, tick in rows:
        if not a or not b or a == b or tick is None:
            continue
        w, last = out.get((min(a, b), max(a, b)), (0.0, tick))
        now = max(tick, last)
        gone = now - last
        w = w * (1 if lam <= 0 or not gone else max(0.0, 1 - lam) ** gone) + eta
        out[min(a, b), max(a, b)] = w, now
    return out


@pytest.mark.parametrize("lam", [0.0, 0.05, 0.5, 1.0])
@pytest.mark.parametrize("block", [None, 7])
def test_fold_is_replay(spark, lam, block):
    rng = random.Random(int(lam * 100))
    rows = [(rng.randint(0, 5), rng.randint(0, 5), rng.randint(0, 30)) for _ in range(300)]
    got = state(E.fold(log(spark, rows), EdgeParams(lam=lam), block=block))
    want = replay(rows, lam)
    assert got.keys() == want.keys()
    for k, (w, last) in want.items():
        assert got[k][1] == last and got[k][0] == pytest.approx(w, rel=1e-9)


def test_late_tick_counts_at_the_latest(spark):
    edges = E.fold(log(spark, [(1, 2, 101), (1, 2, 100)]), EdgeParams())
    assert E.at_tick(edges, 101, EdgeParams()).first().now == pytest.approx(2)


def test_nulls_self_loops_and_repeats(spark):
    rows = [(None, 2, 1), (1, None, 1), (3, 3, 1), (0, 4, 1), (1, 2, None), (2, 1, 1), (1, 2, 1)]
    assert state(E.fold(log(spark, rows), HALF)) == {(1, 2): (2.0, 1)}


@pytest.mark.parametrize("block", [None, 2])
def test_rows_delivered_twice(spark, block):
    e = spark.createDataFrame([(1, 1, 2, 0), (1, 1, 2, 0), (2, 2, 1, 0), (3, 1, 2, 1)], EVENTS)
    assert state(E.fold(e, EdgeParams(lam=0.0), block=block, once=True)) == {(1, 2): (3.0, 1)}


def test_empty_log(spark):
    edges = E.fold(spark.createDataFrame([], EVENTS), HALF)
    assert edges.count() == 0 and E.stats(edges, 5, HALF).first().edge_count == 0


def graph(spark):
    edges = E.freeze(E.fold(log(spark, [(1, 2, 10), (1, 3, 10), (2, 4, 10)]), HALF), 10, HALF)
    return edges, E.adjacency(edges)


def test_pair_weights_and_mass(spark):
    edges, _ = graph(spark)
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 4), (2, 2)], "a long, b long")
    got = {(r.a, r.b): r.pair_weight for r in E.pair_weights(pairs, edges, 11, HALF).collect()}
    assert got == {(1, 2): 0.5, (2, 1): 0.5, (1, 4): 0, (2, 2): 0}
    path = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 1, 2, 4])], "q long, pos long, node long")
    assert E.mass_along(path, edges, 10, HALF, ["q"]).first().mass == 3


def test_neighbors_degree_stats(spark):
    edges, adj = graph(spark)
    assert [r.dst for r in E.neighbors(adj, 10, HALF).where("src = 1").orderBy("dst").collect()] == [2, 3]
    assert [r.dst for r in E.neighbors(adj, 10, HALF, cap=1).where("src = 1").collect()] == [2]
    assert {r.node: r.degree for r in E.degree(adj).collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    dead = E.stats(edges, 100, HALF).first()
    assert (dead.edge_count, dead.node_count, dead.dropped) == (0, 0, 3)


def test_dead_edges_come_back_exactly(spark):
    rows = [(1, 2, 0)]
    assert E.freeze(E.fold(log(spark, rows), HALF), 11, HALF).count() == 0
    again = E.fold(log(spark, rows + [(1, 2, 11)]), HALF).first()
    assert again.weight == pytest.approx(1 + 0.5**11, abs=1e-12)


def test_shuffled_keeps_degrees(spark):
    edges = E.fold(log(spark, [(1, 2, 0), (1, 3, 0), (1, 4, 0), (2, 5, 0)]), HALF)
    deg = lambda e: sorted(r.degree for r in E.degree(E.adjacency(e)).collect())
    seen = set()
    for seed in range(6):
        other = E.shuffled(edges, seed)
        assert deg(other) == deg(edges)
        seen.add(frozenset((r.a, r.b) for r in other.collect()))
    assert len(seen) > 2
    scoped = E.shuffled(edges.withColumn("c", F.lit("x")).unionByName(edges.where("a = 1").withColumn("c", F.lit("y"))), 3, ["c"]).collect()
    assert {n for r in scoped if r.c == "y" for n in (r.a, r.b)} == {1, 2, 3, 4} and {n for r in scoped if r.c == "x" for n in (r.a, r.b)} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("block", [256, 7])
def test_cliques_by_blocks(spark, block):
    rng = random.Random(5)
    sets = {g: {rng.randint(1, 80) for _ in range(n)} for g, n in ((1, 60), (2, 3), (3, 1), (4, 30))}
    rows = [(g, x) for g, xs in sets.items() for x in xs] + [(1, min(sets[1])), (2, None), (2, 0)]
    got = [(r.g, r.a, r.b) for r in E.clique_pairs(spark.createDataFrame(rows, "g long, node long"), ["g"], block=block).collect()]
    want = {(g, a, b) for g, xs in sets.items() for a in xs for b in xs if a < b}
    assert len(got) == len(want) and set(got) == want
    assert E.clique_pairs(spark.createDataFrame([], "g long, node long"), ["g"]).count() == 0


def test_weak_paths(spark):
    edges = E.fold(log(spark, [(1, 2, 0), (2, 3, 0)]), HALF)
    paths = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 3]), (3, [2])], "query_id long, path array<long>")
    assert [(r.query_id, r.a, r.b) for r in E.weak_paths(paths, edges, 0, HALF, ["query_id"]).collect()] == [(2, 1, 3)]


def test_policies(spark):
    r = spark.createDataFrame([("c", 1, 1), ("c", 2, 1), ("c", 3, 2), ("c", 4, 2)], "corpus string, id long, tick long")
    near = spark.createDataFrame([("c", 4, 1)], "corpus string, id long, other long")
    two = lambda df: {(x.a, x.b) for x in E.canonical(df).select("a", "b").collect()}
    assert two(E.adjacent_pairs(r, ["corpus"])) == {(1, 2), (3, 4)}
    assert two(E.star_pairs(r, near, ["corpus"])) == {(1, 2), (3, 4), (1, 4)}
    assert two(E.combined_pairs(r, near, ["corpus"])) == {(1, 2), (3, 4), (1, 4), (1, 3)}


def test_capacity_keeps_first_seen(spark):
    edges = spark.createDataFrame([(1, 2, 5), (1, 3, 1), (1, 4, 3)], "a long, b long, seq long")
    assert {(r.a, r.b) for r in E.within_capacity(edges, "seq", 4).collect()} == {(1, 3), (1, 4)}


def test_parameters():
    for bad in ({"lam": float("nan")}, {"eta": -1.0}, {"floor": 0.0}, {"floor": 1.0}):
        with pytest.raises(ConfigError):
            EdgeParams(**bad)


def test_provenance(spark):
    e = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (1, 2, "x")], "a long, b long, origin string")
    assert E.provenance(e).first().origins == ["x", "y"]
    assert E.canonical(e).select(F.max("b")).first()[0] == 2


def test_clique_counts_in_tiles(spark):
    """Pairs are counted without being listed: repeated members, ids that are no node, groups cut in parts, blocks of few nodes."""
    rng = random.Random(5)
    rows = [(rng.randint(-3, 40), rng.choice([None, 0, *range(1, 30), 1 << 40])) for _ in range(1500)] + [(None, 3), (None, 4)]
    want = collections.Counter()
    for k in {k for k, _ in rows if k is not None}:
        want.update(itertools.combinations(sorted({x for g, x in rows if g == k and x}), 2))
    df = spark.createDataFrame(rows, "bucket long, node long")
    for kind in ({}, {"listed": 0}, {"listed": 0, "tile": 7}, {"listed": 0, "tile": 7, "most": 50}):
        got = E.clique_counts(df, "bucket", **kind)
        assert {(r.a, r.b): r.n for r in got.collect()} == want and got.count() == len(want)
