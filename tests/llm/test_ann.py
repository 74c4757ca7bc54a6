"""Similar vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hebbspark.llm import ann as N
from hebbspark.llm import partition as P

DIM = 16


def clouds(seed, groups, per, spread=0.15):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, DIM))
    return np.repeat(centre, per, axis=0) + spread * rng.standard_normal((groups * per, DIM))


def brute(ids, x, k, least=None):
    x = np.asarray(x, dtype=np.float32).astype(np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i and (least is None or s[i, j] >= least)), key=lambda j: (-s[i, j], ids[j]))
        out |= {(ids[i], ids[j]) for j in order[:k]}
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "id long, embedding array<float>")


def test_recall_with_few_probes(spark):
    x = clouds(1, 60, 20)
    ids = list(range(1, len(x) + 1))
    p = N.AnnParams(dim=DIM, k=5, probes=4, sample=600, part_rows=64, index_block=50, query_block=90, extra=10)
    got = {(r.id, r.neighbour) for r in N.similar_vectors(frame(spark, ids, x), p).collect()}
    want = brute(ids, x, 5)
    assert len(got & want) / len(want) >= 0.97 and len(got) == 5 * len(ids)


def test_limit_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    x = clouds(2, 6, 4, 0.05).tolist()
    x += [x[0]] * 8 + [(2 * np.array(x[4])).tolist()]
    ids = list(range(10, 10 + len(x)))
    bad = [(500, [float("nan")] + [1.0] * (DIM - 1)), (501, [0.0] * DIM), (502, None), (503, [1.0] * 3), (504, [float("inf")] + [1.0] * (DIM - 1)), (505, [None] + [1.0] * (DIM - 1)), (None, [1.0] * DIM)]
    df = spark.createDataFrame([*[(i, [float(v) for v in r]) for i, r in zip(ids, x)], *bad, (10, [float(v) for v in x[0]])], "id long, embedding array<float>")
    df = df.withColumn("rep", F.lit(1)).withColumn("vec", F.lit("x"))
    p = N.AnnParams(dim=DIM, k=3, probes=1, least=0.85, extra=20)
    got = {(r.id, r.neighbour) for r in N.similar_vectors(df, p).collect()}
    assert got == brute(ids, x, 3, 0.85)
    some = N.similar_vectors(df, p, asking=F.col("id") % 5 == 0).collect()
    assert {(r.id, r.neighbour) for r in some} == {g for g in got if g[0] % 5 == 0} and max(r["rank"] for r in some) == 3
    assert rng is not None


def test_empty_table(spark):
    assert N.similar_vectors(spark.createDataFrame([], "id long, embedding array<float>"), N.AnnParams(dim=DIM)).count() == 0


def test_parts_are_balanced_and_cut_few_edges():
    x = clouds(4, 16, 40, 0.2)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    g = P.neighbour_graph(x, 8)
    own = P.balanced_parts(x, g, 8)
    assert np.bincount(own, minlength=8).max() <= np.ceil(len(x) / 8 * 1.1)
    assert (own[g] == own[:, None]).mean() > 0.7
    r = P.train_router(x, g, own, 8)
    assert (P.best(r.logits(x), 2) == own[:, None]).any(axis=1).mean() > 0.9


def test_parts_follow_the_rows_in_two_levels(spark):
    x = clouds(5, 300, 20)
    p = N.AnnParams(dim=DIM, probes=3, sample=1024, region_sample=512, part_rows=60)
    reps = frame(spark, range(1, len(x) + 1), x).withColumnsRenamed({"id": "rep", "embedding": "vec"})
    router = N.fit(reps, len(x), p)
    assert 60 <= router.parts <= 200 and len(router.low) == 10
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    top = router.top(u, 3)
    sizes = np.bincount(top[:, 0], minlength=router.parts)
    assert sizes.max() < 8 * 60 and top.min() >= 0 and (np.sort(top, axis=1)[:, 1:] != np.sort(top, axis=1)[:, :-1]).all()
    assert N.fit(reps, len(x), N.AnnParams(dim=DIM, sample=1024, region_sample=512, part_rows=60, most_parts=16)).parts <= 24


def test_regions_with_few_parts_leave_places_open():
    one = P.fit_router(np.zeros((0, 4), dtype=np.float32), 1, hidden=0)
    two = P.TwoLevels(P.Router(*(np.zeros(s, dtype=np.float32) for s in ((4, 1), 1, (1, 3), 3, (4, 3)))), [one] * 3, wide=2)
    got = two.top(np.eye(4, dtype=np.float32), 3)
    assert got.shape == (4, 3) and (got[:, 2] == -1).all() and (got[:, :2] >= 0).all()


@pytest.mark.parametrize("rows", [0, 1, 5])
def test_tiny_samples_make_one_part(rows):
    assert P.fit_router(np.ones((rows, 4), dtype=np.float32), 10).parts == 1


@pytest.mark.parametrize("least", [None, 0.85])
def test_dense_group_of_which_the_copies_tell_nothing(spark, least):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(DIM)
    x = np.concatenate([centre + 0.003 * rng.standard_normal((400, DIM)), centre * rng.uniform(0.5, 2, (300, 1)), clouds(7, 5, 8)])
    ids = [int(i) for i in rng.permutation(len(x)) + 1]
    p = N.AnnParams(dim=DIM, k=5, probes=1, least=least, index_block=200, query_block=300)
    got = {(r.id, r.neighbour) for r in N.similar_vectors(frame(spark, ids, x), p).collect()}
    assert got == brute(ids, x, 5, least)


def test_multiples_are_one_class(spark):
    x = np.random.default_rng(8).integers(-99, 100, (3, DIM)).astype(np.float32)
    rows = np.concatenate([x, 3 * x, 0.25 * x, -x])
    reps, members = N.vector_classes(frame(spark, range(1, 13), rows), N.AnnParams(dim=DIM), "id", "embedding")
    assert {(r.rep, r.id) for r in members.collect()} == {(i if k < 3 else i + 9, i + 3 * k) for i in (1, 2, 3) for k in range(4)} and reps.count() == 6


@pytest.mark.parametrize("dim", [7, 16])
def test_twelve_bit_copies_come_back(dim):
    x = np.random.default_rng(3).integers(-2047, 2048, (50, dim)).astype(np.int16)
    assert (N._unpack(N._pack(x), dim) == x).all() and N._pack(x).shape[1] == dim + -(-dim // 2)
