"""Lifecycle rewrites and evaluation measures."""

import math
import re
from math import comb

import pytest
from pyspark.sql import functions as F

from hebbspark.functions.stem import porter
from hebbspark.operators import cases as C
from hebbspark.operators import edges as E
from hebbspark.operators import evalops as B
from hebbspark.operators import lifecycle as M
from hebbspark.params import EdgeParams

REC = "id long, content string, writer string, tick long, layer int, valid_from long, valid_to long, supersedes long, bytes long"


def records(spark, *rows):
    return spark.createDataFrame([(i, c, "w", t, 0, t, None, None, b) for i, c, t, b in rows], REC)


def test_supersede(spark):
    r = records(spark, (1, "a", 0, 1), (2, "b", 1, 1))
    out = {x.id: x for x in M.supersede(r, spark.createDataFrame([(1, 2, 1), (1, 2, 5), (None, 2, 1)], "old long, new long, tick long")).collect()}
    assert out[1].valid_to == 1 and out[2].supersedes == 1 and out[2].valid_from == 1
    both = M.supersede(r, spark.createDataFrame([(1, 2, 1)], "old long, new long, tick long"))
    assert [x.id for x in M.live(both).collect()] == [2]
    assert [x.id for x in M.as_of(both, 0).collect()] == [1] and [x.id for x in M.as_of(both, 1).collect()] == [2]


def test_promote(spark):
    r = records(spark, (1, "a", 0, 1), (2, "b", 0, 1)).withColumn("layer", F.lit(1))
    assert [x.id for x in M.live(M.promote(r, spark.createDataFrame([(2,), (2,), (9,)], "id long"))).collect()] == [2]


def test_ttl_is_inclusive(spark):
    r = records(spark, (1, "a", 0, 1), (2, "b", 1, 1))
    assert [x.id for x in M.expired(r, 2, 2).collect()] == [1] and M.expired(r, 2, 0).count() == 0
    assert [x.id for x in M.unexpired(r, 2, 2).collect()] == [2]


@pytest.mark.parametrize("most,size,buckets", [(2, 100, 256), (9, 7, 2), (9, 0, 3), (9, 100, 1)])
def test_eviction_is_oldest_first(spark, most, size, buckets):
    rows = [(i, "x", 0, b) for i, b in [(3, 5), (7, 1), (8, 3), (20, 2), (21, 2)]]
    kept = {x.id for x in M.kept_suffix(records(spark, *rows), most, size, buckets=buckets).collect()}
    want = list(rows)
    while len(want) > 1 and (len(want) > most or sum(r[3] for r in want) > size):
        want.pop(0)
    assert kept == {r[0] for r in want}


def test_enforce(spark):
    r = records(spark, (1, "a", 0, 5), (2, "b", 0, 5))
    with pytest.raises(M.QuotaExceeded):
        M.enforce(r, 0, 0, 1, 100)
    assert [x.id for x in M.enforce(r, 0, 0, 1, 100, "oldest").collect()] == [2]


def test_forget_takes_events(spark):
    r = records(spark, (1, "a", 0, 1), (2, "b", 0, 1), (3, "c", 0, 1))
    e = spark.createDataFrame([(1, 1, 2, 0), (2, 2, 3, 0), (3, 3, 1, 0)], "seq long, a long, b long, tick long")
    left, events = M.forget(r, e, spark.createDataFrame([(1,)], "id long"))
    assert left.count() == 2 and [x.seq for x in events.collect()] == [2]
    assert [x.seq for x in M.with_live_ends(e, left).collect()] == [2]


def test_evidence(spark):
    df = spark.createDataFrame([(["D1:2; D1:1", "D1:2"], ["D1:1", "D3:3"]), (None, ["D1:1"]), ([], None)], "e array<string>, found array<string>")
    got = df.select(B.evidence_ids("e").alias("g"), *[c.alias(n) for n, c in B.evidence_recall("found", B.evidence_ids("e")).items()]).collect()
    assert got[0].g == ["D1:1", "D1:2"] and (got[0].recall, got[0].any_found, got[0].all_found) == (0.5, True, False)
    assert got[1].g == [] and got[1].recall is None


@pytest.mark.parametrize("w,lo", [(8, 0), (4, 4), (0, 0), (3, 11), (700, 600), (2000, 1500)])
def test_sign_test(spark, w, lo):
    n = w + lo
    want = 1.0 if not n else min(1.0, 2 * sum(comb(n, k) for k in range(min(w, lo) + 1)) / 2**n)
    got = spark.createDataFrame([(w, lo)], "w long, l long").select(B.sign_test("w", "l").alias("p")).first().p
    assert got == pytest.approx(want, rel=1e-9)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")
    assert {r.test: round(r.adjusted, 9) for r in B.holm(df).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_answers(spark):
    rows = [("The red, fox!", "a red fox and fox", 2, 0.8), ("", "", 4, 0.0), ("", "the", 4, 0.0), ("cat", "dog", 4, 0.0), ("x", "x; y", 3, 1.0), ("red, blue", "blue, green", 1, 0.5)]
    rows += [(None, "z", 4, 0.0), ("z", None, 4, 0.0), ("don't", "dont", 2, 1.0), ("running", "runs", 2, 1.0), ("cats, dogs", "cats,dogs", 1, 1.0), ("a blue, drawer", "the blue drawer", 1, 0.5 * (2 / 3 + 2 / 3) * 1.0), ("go", "go", None, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, predicted string, gold string, category int, want double")
    got = B.answer_f1(df).orderBy("i").collect()
    assert [r.f1 for r in got] == pytest.approx([r.want for r in got])
    assert B.answer_f1(df.where("i = 9"), stem=False).first().f1 == 0.0
    said = [("Room RM1234.", "RM1234", True), ("144 cells", "144", True), ("RM1234 or RM5555", "RM1234", False), ("It is not RM1234", "RM1234", False), ("1440", "144", False), ("Not enough information.", "Not enough information", True), ("not enough information cells", "Not enough information", False), (None, "144", False), (' "144". ', "144", True)]
    ex = spark.createDataFrame(said, "a string, g string, want boolean").select("want", B.exact_answer("a", "g").alias("x"))
    assert all(r.x == r.want for r in ex.collect())


@pytest.mark.parametrize(
    "words",
    [
        "caresses:caress ponies:poni ties:tie cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop",
        "falling:fall hissing:hiss failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit vietnamization:vietnam operator:oper",
        "triplicate:triplic formalize:formal electrical:electr goodness:good revival:reviv allowance:allow airliner:airlin adjustable:adjust replacement:replac adoption:adopt effective:effect",
        "probate:probat rate:rate cease:ceas controll:control roll:roll running:run runs:run flies:fli dies:die died:die is:is y:y dying:die",
    ],
)
def test_stems(words):
    assert all(porter(a) == b for a, b in (w.split(":") for w in words.split()))


def test_paired_and_bootstrap(spark):
    rows = [(i, f"c{i % 5}", arm, v) for i in range(40) for arm, v in (("x", 1.0 if i % 4 else 0.0), ("y", 0.5))]
    pairs = B.paired(spark.createDataFrame(rows, "case long, cl string, arm string, v double"), ["case", "cl"], "arm", ["x", "y"], "v")
    o = B.outcomes(pairs, "x", "y").first()
    assert (o.cases, o.wins, o.losses, o.mean_delta) == (40, 30, 10, 0.25)
    b = B.cluster_bootstrap(pairs.withColumn("d", F.col("x") - F.col("y")), "cl", "d", 400).first()
    assert b.low <= b.mean <= b.high and b.mean == pytest.approx(0.25)
    again = B.cluster_bootstrap(pairs.repartition(7).withColumn("d", F.col("x") - F.col("y")), "cl", "d", 400).first()
    assert (again.low, again.high) == pytest.approx((b.low, b.high))
    k = B.cluster_outcomes(pairs, "x", "y", "cl").collect()
    assert len(k) == 5 and sum(r.mean_delta for r in k) / 5 == pytest.approx(0.25) and {r.outcome for r in k} <= {1, 0, -1}
    for bad in (rows[1:], [*rows, rows[0]]):
        with pytest.raises(ValueError, match="not paired"):
            B.paired(spark.createDataFrame(bad, "case long, cl string, arm string, v double"), ["case", "cl"], "arm", ["x", "y"], "v")
    assert B.cluster_bootstrap(pairs.withColumn("d", F.col("x")).limit(0), "cl", "d", 10).first().low is None


def test_sampling_jobs_and_reports(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, s int")
    assert B.stratified_sample(df, ["s"], "id", 4, excluded=df.where("id < 3")).where("id < 3").count() == 0
    assert B.stratified_sample(df, ["s"], "id", 4).count() == 12
    jobs = spark.createDataFrame([(1, "m", "in"), (2, "m", "in2")], "job_id long, model string, input string")
    sha = jobs.select(F.sha2(F.to_json(F.struct("input")), 256).alias("h")).first().h
    cache = spark.createDataFrame([(1, "m", sha)], "job_id long, model string, input_sha string")
    assert [r.job_id for r in B.pending_jobs(jobs, cache).collect()] == [2]
    with pytest.raises(ValueError):
        B.pending_jobs(jobs, cache.withColumn("input_sha", F.lit("x")))
    arms = spark.createDataFrame([(1, "oracle", True), (1, "counterfactual", True), (1, "bridge_removed", True), (2, "oracle", True)], "case_id long, arm string, correct boolean")
    assert {r.case_id: r.all_correct for r in B.causal_pairs(arms).collect()} == {1: True, 2: False}
    f = B.family_summary(B.causal_pairs(arms.withColumn("family", F.lit("x")), keep=["family"])).first()
    assert (f.cases, f.oracle, f.bridge_removed, f.all_correct) == (2, 2, 1, 1)
    found = B.mined(spark.createDataFrame([(i, "who was it" if i % 2 else "x") for i in range(20)], "query_id long, query string"), ["^who"], n=4).collect()
    assert sorted(r.draw for r in found) == [1, 2, 3, 4] and all(r.query_id % 2 for r in found)
    calls = spark.createDataFrame([("a", False, 3, None, 1.0), ("a", True, 9, 9, 9.0)], "arm string, unavailable boolean, input_tokens long, output_tokens long, seconds double")
    assert B.usage_report(calls).first().input_tokens == 3
    assert B.best_weight(spark.createDataFrame([(0.4, 0.5), (0.1, 0.5), (0.0, 0.2)], "weight double, mean_recall double")).first().weight == 0.1
    curve = lambda *rows: B.promoted(spark.createDataFrame(rows, "session int, graph double, adjacency double, low double")).first().promote
    base = [(0, 0.5, 0.5, 0.0), (1, 0.5, 0.5, 0.0), (5, 0.52, 0.5, 0.0)]
    assert curve(*base, (50, 0.53, 0.5, 0.001)) and not curve(*base, (50, 0.53, 0.5, 0.0)) and not curve(*base, (50, 0.519, 0.5, 0.1)) and not curve((0, 0.5, 0.5, 0.1), (1, 0.525, 0.5, 0.1), (50, 0.53, 0.5, 0.1)) and not curve(*base, (50, 0.53, 0.525, 0.1))
    assert math.isclose(B.distribution(df, [], "id").first().median, 14.5)


def test_rollup_summary(spark):
    df = spark.createDataFrame([("x", 1, 1.0, True, True), ("x", 2, None, None, None)], "arm string, category int, recall double, any_found boolean, all_found boolean")
    got = {(r.arm, r.category): (r.questions, r.mean_recall) for r in B.recall_summary(df, ["arm", "category"]).collect()}
    assert got[(None, None)] == (2, 1.0) and got[("x", 2)] == (1, None)


def test_generated_cases(spark):
    rows = C.chain_cases(spark, 3, 5, seed=2).collect()
    assert len(rows) == 9 and {r.family for r in rows} == set(C.FAMILIES)
    for r in rows:
        assert r.gold != r.counterfactual_gold and len(r.observations) == len(r.facts) + 5 and sum(a != b for a, b in zip(r.facts, r.alternate)) == 1
        assert {o.text for o in r.observations} >= set(r.facts)
        if r.family == "arithmetic":
            number = lambda t: int(re.findall(r" (\d+) ", t)[-1])
            assert math.prod(number(t) for t in r.facts) == int(r.gold) and math.prod(number(t) for t in r.alternate) == int(r.counterfactual_gold)
        else:
            assert r.gold in " ".join(r.facts)
    assert [tuple(r) for r in C.chain_cases(spark, 3, 5, seed=2).collect()] == [tuple(r) for r in rows]


@pytest.mark.parametrize("layout,edges", [("hot", 1), ("disjoint", 4), ("uniform", 16)])
def test_contention_counts_are_exact(spark, layout, edges):
    state = E.fold(C.contention_log(spark, layout, 4, 300, 16), EdgeParams(lam=0.0)).collect()
    assert len(state) == edges and sum(r.events for r in state) == 1200 == sum(r.weight for r in state)
    with pytest.raises(ValueError):
        C.contention_log(spark, "ring", 1, 1)
