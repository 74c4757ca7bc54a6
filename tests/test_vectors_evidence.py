"""Vectors, geometry, evidence packets and the question pipeline."""

import json
import math

import numpy as np
import pytest

from hebbspark.operators import activate as A
from hebbspark.operators import edges as E
from hebbspark.operators import evidence as Q
from hebbspark.operators import vectors as V
from hebbspark.params import EdgeParams

FLAT = EdgeParams(lam=0.0)
VEC = "id long, vec array<float>"


def edges(spark, pairs):
    return E.fold(spark.createDataFrame([(i + 1, a, b, 0) for i, (a, b) in enumerate(pairs)], "seq long, a long, b long, tick long"), FLAT)


def test_hash_embedder(spark):
    e = V.HashEmbedder(16, 3)
    out = e.encode(["Red red fox", "", None])
    assert np.linalg.norm(out[0]) == pytest.approx(1) and not out[1].any() and not out[2].any()
    df = V.embed(spark.createDataFrame([(1, "fox red RED"), (2, None)], "id long, content string"), e)
    got = {r.id: r.vec for r in df.collect()}
    assert np.allclose(got[1], out[0]) and not any(got[2])


@pytest.mark.parametrize("block", [3, 4096])
def test_seed_topk(spark, block):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 5)).astype(np.float32)
    x[7] = x[3]
    v = spark.createDataFrame([(i + 1, [float(a) for a in r]) for i, r in enumerate(x)] + [(99, None), (98, [1.0])], VEC)
    q = spark.createDataFrame([(1, [float(a) for a in x[3]]), (2, None)], "query_id long, vec array<float>")
    got = [r.id for r in V.seed_topk(q, v, 4, block).orderBy("rank").collect()]
    s = np.round(x.astype(float) @ x[3].astype(float), 9)
    assert got == [i + 1 for i in sorted(range(30), key=lambda i: (-s[i], i))[:4]]


def test_walks(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 5.0])], VEC)
    starts = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, 4, [1.0, 0.0])], "query_id long, node long, direction array<double>")
    got = {r.query_id: r.path for r in V.walk(starts, E.adjacency(edges(spark, [(1, 2), (2, 3), (1, 4)])), v, 0, FLAT).collect()}
    assert got[1] == [1, 2, 3] and got[2] == [] and got[3][0] == 4
    assert {r.query_id: r.path for r in V.walk(starts, E.adjacency(edges(spark, [(1, 2), (2, 3)])), v, 0, FLAT, hops=1).collect()}[1] == [1, 2]


def test_axis_and_sectors(spark):
    m = spark.createDataFrame([(1, i, [float(i), 0.1 * (-1) ** i]) for i in range(1, 6)] + [(2, 7, [1.0, 1.0])], "group_id long, id long, vec array<float>")
    got = V.axis(m).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place) if r.group_id == 1] == [1, 2, 3, 4, 5]
    assert [r.projection for r in got if r.group_id == 2] == [0.0]
    c = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "group_id long, vec array<float>")
    s = V.sectors(c, m).collect()
    assert len(s) == 12 and sum(r["count"] for r in s) == 5


@pytest.mark.parametrize("rows", [3, 6, 400])
def test_directions_are_those_of_the_whole_group(spark, rows):
    rng = np.random.default_rng(rows)
    x = (rng.standard_normal((rows, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 7).astype(np.float32)
    centre = x[0] + 0.1
    m = spark.createDataFrame([(1, i + 1, [float(v) for v in r]) for i, r in enumerate(x)] + [(1, 9999, None)], "group_id long, id long, vec array<float>").repartition(3)
    _, _, vt = np.linalg.svd(x.astype(float) - x.astype(float).mean(axis=0), full_matrices=False)
    d = vt[:2] * np.sign(vt[[0, 1], np.argmax(np.abs(vt[:2]), axis=1)])[:, None]
    got = {r.id: r.projection for r in V.axis(m).collect()}
    assert all(got[i + 1] == pytest.approx(float(x[i].astype(float) @ d[0]), abs=1e-6) for i in range(rows)) and len(got) == rows
    c = spark.createDataFrame([(1, [float(v) for v in centre])], "group_id long, vec array<float>")
    step = x.astype(float) - np.array([np.float32(v) for v in centre], dtype=float)
    angle = np.arctan2(step @ d[1], step @ d[0])
    want = np.bincount(np.clip(np.floor((angle + np.pi) / (2 * np.pi / 12)).astype(int), 0, 11), minlength=12)
    assert [r["count"] for r in V.sectors(c, m).orderBy("sector").collect()] == want.tolist()
    assert V.axis(m.limit(0)).count() == 0 and V.sectors(c, m.limit(0)).count() == 0


def test_holes_and_recall(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.8, 0.2]), (4, [0.0, 1.0])], VEC)
    e = edges(spark, [(1, 2)])
    holes = V.unexplored(v.where("id = 1"), v, e, 0, FLAT).collect()
    assert {(r.a, r.b) for r in holes} == {(1, 3)}
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, vec array<float>")
    trans = A.transitions(E.adjacency(edges(spark, [(4, 1)])), 0, FLAT)
    hits = V.recall(q, v, trans, live=v.where("id <> 2"), budget=3, seeds=1).orderBy("rank").collect()
    assert [r.id for r in hits] == [4, 1] or [r.id for r in hits] == [1, 4]


TEXTS = ['Été: 12:00 — not before 09:00.', 'quote " backslash \\ tab\t newline\n', "\U0001f600 emoji", "", None]


def test_packet_bytes(spark):
    rows = spark.createDataFrame([(1, str(i), t, i) for i, t in enumerate(TEXTS)], "q long, id string, text string, rank int")
    want = len(json.dumps([{"id": str(i), "text": t or ""} for i, t in enumerate(TEXTS)], ensure_ascii=False).encode())
    assert Q.evidence_bytes(rows, ["q"]).first().bytes == want


@pytest.mark.parametrize("limit", [1, 2, 5])
@pytest.mark.parametrize("budget", [2, 60, 110, 1000])
def test_fit_is_greedy_and_whole(spark, budget, limit):
    rows = [(1, str(i), t or "", i) for i, t in enumerate(TEXTS)]
    got = [r.id for r in Q.fit_records(spark.createDataFrame(rows, "q long, id string, text string, rank int"), ["q"], budget, limit).orderBy("rank").collect()]
    assert got == [e.id for e in Q.fit([Q.Evidence(r[1], r[2]) for r in rows], budget, limit)]


def test_oracle_packet_and_arms(spark):
    gold = spark.createDataFrame([(1, 5), (1, 9)], "q long, id long")
    other = spark.createDataFrame([(1, 3, 1), (1, 5, 2), (1, 4, 3)], "q long, id long, rank int")
    packet = Q.oracle_packet(gold, other, ["q"], 3)
    assert [r.id for r in packet.orderBy("position").collect()] == [5, 9, 3]
    assert Q.oracle_packet(gold, other, ["q"], 1).count() == 2
    assert Q.without(packet, gold, ["q"]).count() == 1
    texts = packet.selectExpr("q", "id", "'x' AS text")
    new = Q.replaced(texts, spark.createDataFrame([(1, 9, "y")], "q long, id long, text string"), ["q"])
    assert {r.id: r.text for r in new.collect()} == {5: "x", 9: "y", 3: "x"}


def test_citations(spark):
    rows = [(1, ["a"], ["a", "b"], False), (2, ["c"], ["a"], False), (3, [], ["a"], False), (4, [], ["a"], True)]
    got = {r.case_id: r.valid for r in Q.invalid_citations(spark.createDataFrame(rows, "case_id long, cited array<string>, supplied array<string>, abstained boolean")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


class Stub:
    def __init__(self, *answers):
        self.answers, self.prompts = list(answers), []

    def structured(self, prompt, schema):
        self.prompts.append(prompt)
        return self.answers.pop(0)


POOL = {"q": [Q.Evidence("1", "one"), Q.Evidence("2", "two")], "more": [Q.Evidence("2", "two"), Q.Evidence("3", "three")]}


def ask(controller, answerer, **limits):
    return Q.EvidencePipeline(lambda q, n: POOL.get(q, []), controller, answerer, Q.PipelineLimits(**limits)).ask("q")


def test_pipeline():
    c = Stub({"selected": ["1"], "queries": ["more", "x", "y"]}, {"selected": ["1", "3"], "queries": []}, {"supported": True})
    got = ask(c, Stub({"answer": "yes", "citations": ["3"], "abstained": False}))
    assert (got.answer, got.rounds, [e.id for e in got.evidence], got.abstained) == ("yes", 2, ["1", "3"], False)


@pytest.mark.parametrize(
    "controller,answerer",
    [
        (Stub({"selected": ["99"], "queries": []}), Stub()),
        (Stub({"selected": ["1"], "queries": []}), Stub({"answer": "x", "citations": ["2"], "abstained": False})),
        (Stub({"selected": ["1"], "queries": []}), Stub({"answer": "x", "citations": [], "abstained": False})),
        (Stub({"selected": ["1"], "queries": []}, {"supported": False}), Stub({"answer": "x", "citations": ["1"], "abstained": False})),
    ],
)
def test_pipeline_abstains(controller, answerer):
    assert ask(controller, answerer).abstained


def test_plan_schema():
    s = Q.plan_schema(["1", "2"])
    assert s["properties"]["selected"]["items"]["enum"] == ["1", "2"] and s["properties"]["queries"]["maxItems"] == 2
    assert Q.plan_schema([])["properties"]["selected"]["maxItems"] == 0


def test_parse_and_prompt():
    assert Q.parse_json('```json\n{"supported": true}\n```', Q.CHECK) == {"supported": True}
    for bad in ("no", "[]", '{"supported": 1}', '{"supported": true, "x": 1}'):
        with pytest.raises(Q.ProviderError):
            Q.parse_json(bad, Q.CHECK)
    assert json.loads(Q.make_prompt("é?", [Q.Evidence("1", "x")]).split("evidence: ")[1]) == [{"id": "1", "text": "x"}]
    with pytest.raises(ValueError):
        Q.PipelineLimits(rounds=4)
    assert math.isfinite(Q.PipelineLimits().final)
