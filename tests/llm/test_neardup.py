"""Near duplicates against all pairs, skew, and edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hebbspark.llm import neardup as D
from hebbspark.llm.queries import writer_key

SETS = D.NearDupParams(similarity=0.7, shingle=1, least_terms=3)
WORDS = [f"w{i}" for i in range(400)]


def noisy(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return out


def corpus(seed, groups=25):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = rng.sample(WORDS, 20)
        for k in range(rng.randint(1, 4)):
            rows.append((len(rows) + 1, " ".join(noisy(rng, base, rng.choice([0, 1, 2, 6]))), rng.choice(["ann", " Ann ", "bob"])))
    return rows


def truth(rows, s, least):
    seen = {i: (set((t or "").split()), (w or "").strip().lower()) for i, t, w in rows if i is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(seen), 2) if seen[a][1] and seen[a][1] == seen[b][1] and min(len(seen[a][0]), len(seen[b][0])) >= least and len(seen[a][0] & seen[b][0]) >= s * len(seen[a][0] | seen[b][0])}


def found(df, p=SETS):
    return {(r.id_a, r.id_b) for r in D.near_duplicates(df, p, key=writer_key()).pairs().collect()}


def test_all_pairs(spark):
    rows = corpus(3)
    df = spark.createDataFrame([*rows, rows[0], (None, "a b c d", "ann"), (900, None, "ann"), (901, "", "ann"), (902, rows[0][1], None), (903, rows[0][1], "  ")], "id long, text string, writer string").withColumn("class", F.lit("x")).withColumn("k", F.lit(1))
    assert found(df) == truth(rows, 0.7, 3)


def test_crowded_buckets_lose_nothing(spark):
    rng = random.Random(9)
    base = rng.sample(WORDS, 30)
    rows = [(i, " ".join([*base, f"x{i}", f"y{i % 9}"]), "ann") for i in range(1, 41)]
    df = spark.createDataFrame(rows, "id long, text string, writer string")
    tight = D.NearDupParams(similarity=0.7, shingle=1, least_terms=3, bucket_limit=4)
    assert found(df, tight) == truth(rows, 0.7, 3) and len(truth(rows, 0.7, 3)) == 780


def test_groups_count_links(spark):
    rows = [(1, "a b c d e f g h", "w"), (2, "a b c d e f g h", "w"), (3, "a b c d e f g z", "w"), (4, "q r s t", "w")]
    out = {r.id: (r["class"], r.copies, r.links, r.group) for r in D.near_duplicates(spark.createDataFrame(rows, "id long, text string, writer string"), SETS, key=writer_key()).groups().collect()}
    assert out == {1: (1, 2, 2, 1), 2: (1, 2, 2, 1), 3: (3, 1, 2, 1), 4: (4, 1, 0, 4)}


def test_five_word_shingles_by_default(spark):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(1, text), (2, text.replace("t59", "u59")), (3, " ".join(reversed(text.split()))), (4, "short text"), (5, "short text")]
    got = {(r.id_a, r.id_b) for r in D.near_duplicates(spark.createDataFrame(rows, "id long, text string")).pairs().collect()}
    assert got == {(1, 2), (4, 5)}


def test_empty_table(spark):
    nd = D.near_duplicates(spark.createDataFrame([], "id long, text string, writer string"), SETS, key=writer_key())
    assert nd.pairs().count() == 0 and nd.groups().count() == 0


def test_samples_agree_as_often_as_the_weights_do():
    rng = np.random.default_rng(5)
    h = rng.integers(-(1 << 62), 1 << 62, 60)
    wa, wb = rng.uniform(0.5, 9, 60).astype(np.float32), rng.uniform(0.5, 9, 60).astype(np.float32)
    wb[:30] = wa[:30]
    v = D.icws_bands(np.concatenate([h, h]), np.concatenate([wa, wb]), np.array([60, 60]), 4000, 1, 3)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert (v[0] == v[1]).mean() == pytest.approx(want, abs=0.03)


def test_band_recall():
    p = D.NearDupParams()
    assert D.band_recall(0.8, p) > 0.999999 and D.band_recall(0.6, p) > 0.99


@pytest.mark.parametrize("limit", [4, 256])
def test_rare_terms_that_differ_lose_no_pair(spark, limit):
    rows = [(i, " ".join([*WORDS[:18], f"x{i}", f"y{i}", f"z{i}"]), "ann") for i in range(1, 201)]
    df = spark.createDataFrame(rows, "id long, text string, writer string")
    p = D.NearDupParams(similarity=0.7, shingle=1, least_terms=18, bucket_limit=limit)
    assert found(df, p) == truth(rows, 0.7, 18) and len(truth(rows, 0.7, 18)) == 19_900


@pytest.mark.parametrize("head_limit", [1, 16_384])
def test_connected_groups(spark, head_limit):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(i, 300) for i in range(200, 210)] + [(400, 401), (401, 400), (400, 400)]
    links += [(b, a) for a, b in rng.sample(links, 20)]
    want: dict[int, int] = {}
    for nodes in (range(1, 41), range(100, 160), [*range(200, 210), 300], (400, 401)):
        want.update({n: min(nodes) for n in nodes})
    got = D.connected(spark.createDataFrame(links, "a long, b long"), head_limit).collect()
    assert {r.node: r.group for r in got} == want and len(got) == len(want)
    assert D.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_very_frequent_terms_keep_their_counts(spark):
    rows = [(1, "q " * 40_000 + "x b", "w"), (2, "q " * 90_000 + "x b", "w"), (3, "q " * 5 + "x b", "w")]
    df = spark.createDataFrame(rows, "id long, text string, writer string")
    p = D.NearDupParams(similarity=0.7, shingle=1, least_terms=3)
    links = {(r.a, r.b): r.weighted for r in D.near_duplicates(df, p, key=writer_key()).links.collect()}
    idf = np.log(1 + 1)
    weight = lambda n: (1 + np.log(n)) * idf
    assert links[1, 2] == pytest.approx((weight(40_000) + 2 * idf) / (weight(90_000) + 2 * idf), rel=1e-5)


def test_more_crowded_buckets_than_are_set_apart_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "_HOT", 1)
    rng = random.Random(9)
    base = rng.sample(WORDS, 30)
    rows = [(i, " ".join([*base, f"x{i}", f"y{i % 9}"]), "ann") for i in range(1, 41)]
    df = spark.createDataFrame(rows, "id long, text string, writer string")
    assert found(df, D.NearDupParams(similarity=0.7, shingle=1, least_terms=3, bucket_limit=4)) == truth(rows, 0.7, 3)


def test_one_text_in_a_third_of_all_rows(spark):
    rng = random.Random(12)
    rows = [(i, "same words here now again", "ann") for i in range(1, 41)] + [(100 + i, " ".join(rng.sample(WORDS, 6)), "ann") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, writer string")
    out = D.near_duplicates(df, SETS, key=writer_key()).groups(head_limit=2).collect()
    assert len(out) == 120 and {(r["class"], r.copies, r.links) for r in out if r.id < 100} == {(1, 40, 39)}


@pytest.mark.parametrize("limit", [4, 256])
def test_chance_meetings_are_no_candidates(spark, limit, monkeypatch):
    monkeypatch.setattr(D, "_BLOCK", 16, raising=False)
    rng = random.Random(21)
    words = [f"v{i}" for i in range(5000)]
    rows = [(i, " ".join([*WORDS[:12], *rng.sample(words, 14)]), "ann") for i in range(1, 301)]
    rows += [(1000 + i, " ".join([*t.split()[:-2], f"n{i}"]), "ann") for i, t, _ in rows[:20]]
    want = truth(rows, 0.7, 18)
    p = D.NearDupParams(similarity=0.7, shingle=1, least_terms=18, bucket_limit=limit)
    shingles = D.shingled(spark.createDataFrame(rows, "id long, text string, writer string"), p, key=writer_key()).persist()
    pairs = {(r.a, r.b) for r in D.candidates(D.weighted_sets(shingles, D.classes(shingles, p), p).persist(), p).collect()}
    assert len(want) == 20 and want <= pairs and len(pairs) < 200


def test_sketches_differ_no_more_than_the_sets(spark):
    rng = random.Random(8)
    rows = []
    for n in (1, 5, 40, 400):
        for _ in range(25):
            both = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
            rows.append((both + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(n))], both))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    for r in df.select("a", "b", F.array(*D.sketch("a")).alias("x"), F.array(*D.sketch("b")).alias("y")).collect():
        bits = sum(bin((u ^ v) & (1 << 64) - 1).count("1") for u, v in zip(r.x, r.y, strict=True))
        assert bits <= len(r.a) - len(r.b) and bits % 2 == (len(r.a) - len(r.b)) % 2
