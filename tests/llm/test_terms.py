"""Distinctive terms: exact tails, adjustment, and edge cases."""

import math

import numpy as np
import pytest

from hebbspark.llm import terms as X


def exact_tail(n, draws, marked, total):
    c = math.comb
    return sum(c(marked, k) * c(total - marked, draws - k) for k in range(n, min(marked, draws) + 1)) / c(total, draws)


def test_upper_tail_is_exact():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        total = int(rng.integers(2, 4000))
        marked, draws = int(rng.integers(1, total + 1)), int(rng.integers(1, total + 1))
        low, high = max(0, draws - (total - marked)), min(marked, draws)
        if high >= 1:
            rows.append((int(rng.integers(max(1, low), high + 1)), draws, marked, total))
    got = X.log_upper_tail(*map(np.array, zip(*rows)))
    for r, g in zip(rows, got):
        want = exact_tail(*r)
        assert math.exp(g) == pytest.approx(want, rel=1e-8, abs=1e-300) or (want > 0.999999 and g == pytest.approx(0, abs=1e-8))


def test_large_collections_keep_their_digits():
    n, draws, marked, total = 1, 40, 7, 10**12
    want = -math.expm1(sum(math.log1p(-marked / (total - i)) for i in range(draws)))
    assert math.exp(X.log_upper_tail([n], [draws], [marked], [total])[0]) == pytest.approx(want, rel=1e-6)


def test_log_factorial_and_falling():
    for x in (0, 1, 5, 2047, 2048, 50_000):
        assert X.log_factorial(np.array([x]))[0] == pytest.approx(math.lgamma(x + 1), rel=1e-12, abs=1e-12)
    for x, m in ((5000, 3), (5000, 4999), (20, 7), (10**6, 10**3)):
        assert X.log_falling([x], [m])[0] == pytest.approx(math.lgamma(x + 1) - math.lgamma(x - m + 1), rel=1e-9)


ROWS = [
    (1, "red fox red fox jumps", "w"),
    (1, "red fox red fox jumps", "w"),
    (2, "red dog", None),
    (3, None, "w"),
    (4, "", "w"),
    (5, "  ", "w"),
    (None, "red red", "w"),
    (6, "fox fox fox the the", "w"),
    (7, "Über-FOX 42", "w"),
]


def test_scores(spark):
    df = spark.createDataFrame(ROWS, "id long, text string, term string")
    out = {(r.id, r.term): r for r in X.distinctive_terms(df).collect()}
    assert set(out) == {(1, "red"), (1, "fox"), (2, "red"), (6, "fox"), (7, "fox")}
    assert out[1, "red"].records == 4 and out[1, "red"].df == 2 and out[1, "red"].n == 2 and out[1, "red"].draws == 5
    total = 5 + 2 + 3 + 3
    for (i, t), r in out.items():
        assert math.exp(r.log_p) == pytest.approx(exact_tail(r.n, r.draws, r.cf, total), rel=1e-9)
    # Two tests in record 1: the adjusted value follows Benjamini and Hochberg.
    p = sorted(math.exp(out[1, t].log_p) for t in ("red", "fox"))
    want = [min(1, 2 * p[0], p[1]) if 2 * p[0] > p[1] else 2 * p[0], min(1, p[1])]
    assert sorted(math.exp(out[1, t].log_q) for t in ("red", "fox")) == pytest.approx([min(want[0], want[1]), want[1]])
    assert all(r.score >= 0 for r in out.values())


def test_top_terms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a1 b1 c1 d1", "a1 b1 c1 d1", "e1", "e1"])], "id long, text string")
    got = [(r.id, r.term) for r in X.top_terms(X.distinctive_terms(df), 3).orderBy("id", "term").collect()]
    assert got == [(0, "a1"), (0, "b1"), (0, "c1"), (1, "a1"), (1, "b1"), (1, "c1"), (2, "e1"), (3, "e1")]


def test_hot_and_rare_terms_agree_for_any_head(spark):
    df = spark.createDataFrame([(i, f"common word{i % 7} solo{i}" + " long" * (i % 5)) for i in range(60)], "id long, text string")
    views = [sorted((r.id, r.term, round(r.score, 9)) for r in X.distinctive_terms(df, head_limit=h).collect()) for h in (1, 4, 1 << 14)]
    assert views[0] == views[1] == views[2] and views[0]


def test_empty_table(spark):
    assert X.distinctive_terms(spark.createDataFrame([], "id long, text string")).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 60_000 + "rare"), (2, "rare word")], "id long, text string")
    got = {(r.id, r.term): r.score for r in X.distinctive_terms(df).collect()}
    assert len(got) == 4 and all(np.isfinite(list(got.values())))
