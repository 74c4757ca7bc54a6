"""Replay: sweeps are the same as one fold over all their events, and diagnosis places every gold record."""

import random

from pyspark.sql import functions as F

from hebbspark.operators import edges as E
from hebbspark.operators import lexical as L
from hebbspark.operators import replay as P
from hebbspark.params import EdgeParams, SearchParams

SCOPE = ["corpus"]


def test_replay_learns_from_its_results(spark):
    docs = L.documents(spark.createDataFrame([("c", i + 1, t) for i, t in enumerate(["red fox", "blue fox", "green", "dog"])], "corpus string, id long, content string"), SCOPE)
    q = spark.createDataFrame([(1, "c", "fox"), (2, "c", "dog")], "query_id long, corpus string, query string")
    first = spark.createDataFrame([(1, "c", 1, 3, 0)], "seq long, corpus string, a long, b long, tick long")
    p, e = SearchParams(budget=2), EdgeParams(lam=0.1)
    runs = list(P.replay(q, docs, E.fold(first, e, SCOPE), 2, 5, p, e, SCOPE))
    assert [s for s, _, _ in runs] == [0, 1, 2]
    events = first.select("corpus", "seq", "a", "b", "tick")
    for sweep, hits, _ in runs[:2]:
        pairs = E.clique_pairs(hits.withColumnRenamed("id", "node"), ["query_id", *SCOPE])
        events = events.unionByName(pairs.selectExpr("corpus", f"{10 * sweep + 10} + query_id AS seq", "a", "b", f"{5 + sweep}L AS tick"))
    rows = lambda df: {(r.a, r.b): (round(r.weight, 9), r.last_tick, r.events) for r in df.collect()}
    assert rows(runs[2][2]) == rows(E.fold(events, e, SCOPE))
    assert P.changed_packets(runs[0][1], runs[0][1], SCOPE).count() == 0


def test_all_sweeps_of_a_scope_in_one_task(spark):
    """The same hits as sweep by sweep, with late edges, an edge at no record, an empty scope, a large one, and no more jobs for more sweeps."""
    rng = random.Random(3)
    words = "amber blue coral dune ember fox green hill iris jade".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    docs = [(c, i * 3, text()) for c in ("x", "y", "z") for i in range(1, {"x": 30, "y": 12, "z": 22}[c])]
    docs = L.documents(spark.createDataFrame(docs, "corpus string, id long, content string"), SCOPE).persist()
    q = spark.createDataFrame([(k, "xyw"[k % 3] if k < 9 else "z", text()) for k in range(1, 13)], "query_id long, corpus string, query string")
    pairs = [(k, rng.choice("xyv"), rng.randint(1, 30) * 3, rng.randint(1, 30) * 3, rng.randint(0, 60)) for k in range(80)]
    edges = E.fold(spark.createDataFrame(pairs, "seq long, corpus string, a long, b long, tick long"), EdgeParams(lam=0.1), SCOPE)
    p, e, at = SearchParams(budget=4, seeds=3, cutoff=0.01), EdgeParams(lam=0.1, floor=0.05), (0, 1, 3, 5)
    rows = lambda df: {(r.query_id, r.corpus, r.id, r["rank"]) for r in df.collect()}
    want = {s: rows(hits) for s, hits, _ in P.replay(q, docs, edges, 5, 8, p, e, SCOPE) if s in at}
    for large in (P.LARGE_SCOPE, 120):
        got = P.replay_at(q, docs, edges, at, 8, p, e, SCOPE, large=large).persist()
        assert {s: rows(got.where(F.col("sweep") == s)) for s in at} == want and all(want.values())
        assert got.count() == sum(map(len, want.values()))

    def jobs(last: int) -> int:
        spark.sparkContext.setJobGroup(f"sweeps to {last}", "")
        P.replay_at(q, docs, edges, (last,), 8, p, e, SCOPE).count()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweeps to {last}"))

    assert jobs(9) <= jobs(1) + 3


def test_scopes_without_questions(spark):
    """Tasks whose scopes have edges only give no hits."""
    docs = L.documents(spark.createDataFrame([("x", 1, "fox"), ("x", 2, "fox dog")], "corpus string, id long, content string"), SCOPE)
    q = spark.createDataFrame([(1, "x", "fox")], "query_id long, corpus string, query string")
    events = [(i, f"v{i}", 1, 2, 0) for i in range(12)] + [(20, "x", 1, 2, 0)]
    edges = E.fold(spark.createDataFrame(events, "seq long, corpus string, a long, b long, tick long"), EdgeParams(), SCOPE)
    got = P.replay_at(q, docs, edges, (0, 2), 5, SearchParams(budget=2), EdgeParams(), SCOPE).collect()
    assert sorted((r.sweep, r.corpus, r.id) for r in got) == [(0, "x", 1), (0, "x", 2), (2, "x", 1), (2, "x", 2)]


def test_diagnosis(spark):
    key = "query_id long, corpus string, id long"
    gold = spark.createDataFrame([(1, "c", 1), (1, "c", 2), (1, "c", 2), (1, "c", 9)], key)
    lexical = spark.createDataFrame([(1, "c", 1, 1)], f"{key}, rank int")
    seeds = spark.createDataFrame([(1, "c", 1, 1.0)], "query_id long, corpus string, node long, weight double")
    arcs = spark.createDataFrame([(1, "c", 2, 2), (1, "c", 1, 2)], "query_id long, corpus string, hop int, dst long")
    assoc = spark.createDataFrame([(1, "c", 2, 0.5)], f"{key}, association double")
    out = {r.id: (r.is_seed, r.lexical_rank, r.association, r.first_hop, r.final_rank) for r in P.diagnosis(gold, lexical, seeds, arcs, assoc, lexical, SCOPE).collect()}
    assert out == {1: (True, 1, 0.0, None, 1), 2: (False, None, 0.5, 1, None), 9: (False, None, 0.0, None, None)}
