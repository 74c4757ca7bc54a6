"""Evaluation: evidence recall, paired comparisons, bootstraps, answer scores, audits and sampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hebbspark.functions.stem import porter
from hebbspark.operators.ranking import numbered
from hebbspark.session import written

DIGITS = 9


def evidence_ids(evidence: Column | str) -> Column:
    """The distinct turn ids (``D<session>:<turn>``) named anywhere in the array, sorted; empty for null."""
    joined = F.array_join(evidence, " ")
    return F.coalesce(F.array_sort(F.array_distinct(F.regexp_extract_all(joined, F.lit(r"(D\d+:\d+)"), F.lit(1)))), F.array().cast("array<string>"))


def evidence_recall(retrieved: Column | str, gold: Column | str) -> dict[str, Column]:
    """recall, any_found and all_found of two arrays of ids; null where there is no gold; unresolved gold is missed."""
    gold = F.array_distinct(gold)
    hit, n = F.size(F.array_intersect(retrieved, gold)), F.size(gold)
    some = n > 0
    return {"recall": F.when(some, F.round(hit / n, DIGITS)), "any_found": F.when(some, hit > 0), "all_found": F.when(some, hit == n)}


def recall_summary(scored: DataFrame, by: Sequence[str] = ("category",), value: str = "recall") -> DataFrame:
    """Means over the scored rows per group, and over all of them with null keys (a rollup)."""
    out = scored.rollup(*by).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count(value).alias("scored"),
        F.round(F.avg(value), 6).alias("mean_recall"),
        F.round(F.avg(F.col("any_found").cast("int")), 6).alias("any_rate"),
        F.round(F.avg(F.col("all_found").cast("int")), 6).alias("all_rate"),
    )
    return out


def distribution(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, median and 95th percentile with linear interpolation, exact."""
    q = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"))


def unpaired(rows: DataFrame, case: Sequence[str], arm: str, arms: Sequence[str]) -> DataFrame:
    """(case, problem): cases that lack one of the arms or have one twice; none if the cohort is complete."""
    wanted = F.array(*(F.lit(a) for a in arms))
    seen = rows.where(F.col(arm).isin(list(arms))).groupBy(*case).agg(F.collect_set(arm).alias("_a"), F.count(F.lit(1)).alias("_n"))
    problem = F.when(F.size(F.array_except(wanted, "_a")) > 0, "incomplete").when(F.col("_n") > len(arms), "duplicate")
    return seen.select(*case, problem.alias("problem")).where("problem IS NOT NULL")


def paired(rows: DataFrame, case: Sequence[str], arm: str, arms: Sequence[str], value: str, strict: bool = True) -> DataFrame:
    """One row per case with a column for each arm.

    A case that lacks an arm or has one twice is an error; without ``strict``
    incomplete cases are dropped, and of repeated arms one value counts.
    """
    if strict and (bad := unpaired(rows, case, arm, arms).limit(3).collect()):
        raise ValueError("the cohort is not paired: " + "; ".join(str(tuple(r)) for r in bad))
    out = rows.groupBy(*case).pivot(arm, list(arms)).agg(F.first(value))
    return out.dropna(subset=list(arms))


def cluster_outcomes(pairs: DataFrame, candidate: str, reference: str, cluster: str, tolerance: float = 1e-12) -> DataFrame:
    """(cluster, cases, mean_delta, outcome): the mean difference of each cluster, and 1, 0 or -1 for its sign."""
    out = pairs.groupBy(cluster).agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col(candidate) - F.col(reference)).alias("mean_delta"))
    return out.withColumn("outcome", F.when(F.col("mean_delta") > tolerance, 1).when(F.col("mean_delta") < -tolerance, -1).otherwise(0))


def outcomes(pairs: DataFrame, candidate: str, reference: str, by: Sequence[str] = (), tolerance: float = 1e-12) -> DataFrame:
    """Wins, ties and losses of candidate against reference, with the mean difference and its quartiles."""
    d = F.col(candidate) - F.col(reference)
    q = lambda p: F.round(F.percentile(d, F.lit(p)), 6)
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(d > tolerance).alias("wins"),
        F.count_if(F.abs(d) <= tolerance).alias("ties"),
        F.count_if(d < -tolerance).alias("losses"),
        F.round(F.avg(d), 6).alias("mean_delta"),
        q(0.25).alias("q25"),
        q(0.5).alias("q50"),
        q(0.75).alias("q75"),
    )


def sign_test(wins: Column | str, losses: Column | str) -> Column:
    """Exact two-sided binomial probability without ties, 1 if there is nothing to compare.

    The smaller tail is C(n, m) times a nested sum of ratios, so that nothing
    overflows.
    """
    w, lo = (F.col(c) if isinstance(c, str) else c for c in (wins, losses))
    w, lo = w.cast("long"), lo.cast("long")
    n, m = w + lo, F.least(w, lo)
    steps = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))
    log_c = F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.log((n - m + k) / k))
    nested = F.aggregate(steps, F.lit(1.0), lambda s, k: 1 + s * k / (n - k + 1))
    p = F.exp(log_c + F.log(nested) - (n - 1) * F.lit(float(np.log(2))))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def holm(tests: DataFrame, p: str = "p", by: Sequence[str] = (), key: str = "test") -> DataFrame:
    """Adds ``adjusted``: the running maximum of (m - rank + 1) p in rising order of p, at most 1.  A family is small."""
    family = Window.partitionBy(*(by or [F.lit(0)]))
    order = family.orderBy(p, key)
    scaled = F.least(F.lit(1.0), (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("_s", scaled).withColumn("adjusted", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def transitions(pairs: DataFrame, before: str, after: str, delta: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the four changes of a yes/no outcome between two arms, and what each adds to the mean difference."""
    total = pairs.count()
    return pairs.groupBy(*by, F.col(before).alias("before"), F.col(after).alias("after")).agg(F.count(F.lit(1)).alias("cases"), F.round(F.sum(delta) / F.lit(float(max(total, 1))), 6).alias("contribution"))


def drawn(seed: int, *parts: Column) -> Column:
    """A whole number below 2^60 from a digest of the seed and the parts, the same in every engine."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _drawn_means(rows: DataFrame, cluster: str, values: Sequence[str], draws: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The sums and counts of the clusters, and of each draw of as many clusters as there are the mean m0, m1, ... of each value."""
    sound = F.col(cluster).isNotNull()
    for value in values:
        sound = sound & F.col(value).isNotNull()
    sums = [F.sum(value).alias(f"s{i}") for i, value in enumerate(values)]
    per = rows.where(sound).groupBy(F.col(cluster).alias("_k")).agg(*sums, F.count(F.lit(1)).alias("n"))
    placed = written(numbered(per, ["_k"], "_j").drop("_k").withColumn("_j", F.col("_j") - 1), "clusters")
    many = placed.count()
    picks = placed.select("_j", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).select("draw", F.pmod(drawn(seed, F.col("draw"), F.col("_j")), F.lit(max(many, 1))).alias("_j"))
    counted = picks.groupBy("draw", "_j").agg(F.count(F.lit(1)).alias("c"))
    means = [(F.sum(F.col("c") * F.col(f"s{i}")) / F.sum(F.col("c") * F.col("n"))).alias(f"m{i}") for i in range(len(values))]
    return placed, counted.join(placed, "_j").groupBy("draw").agg(*means)


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int = 3000, seed: int = 7) -> DataFrame:
    """(mean, low, high): 95 % interval of the mean of the rows, as many clusters drawn with replacement as there are.

    Clusters are reduced to sum and count and numbered; pick j of a draw is a
    digest of seed, draw and j, so a draw needs no list of clusters in one
    place, and picks of one cluster are counted before they meet its sums.
    Rows without a cluster or value do not count; no rows give nulls.
    """
    placed, means = _drawn_means(rows, cluster, [value], draws, seed)
    q = means.agg(F.percentile("m0", F.lit(0.025)).alias("low"), F.percentile("m0", F.lit(0.975)).alias("high"))
    mean = placed.agg((F.sum("s0") / F.sum("n")).alias("mean"))
    return q.withColumn("mean", mean.scalar()).select("mean", "low", "high")


def cluster_intervals(rows: DataFrame, cluster: str, values: Sequence[str], draws: int = 3000, seed: int = 7) -> DataFrame:
    """One row with <value>_low and <value>_high of each value: the intervals of ``cluster_bootstrap``, from draws that are made once.

    Rows that lack any of the values do not count.
    """
    _, means = _drawn_means(rows, cluster, values, draws, seed)
    ends = ((f"{value}_{end}", i, at) for i, value in enumerate(values) for end, at in (("low", 0.025), ("high", 0.975)))
    return means.agg(*(F.percentile(f"m{i}", F.lit(at)).alias(name) for name, i, at in ends))


# Words that answers are compared without, and the punctuation marks that are deleted from them.
ARTICLES = ("a", "an", "the", "and")
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def answer_tokens(text: Column | str) -> Column:
    """Lower-case words of an answer without punctuation marks and articles; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(F.trim(plain), r"\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two token arrays; 0 where nothing is shared, also if both are empty."""
    same = overlap(predicted, gold)
    return F.when(same == 0, 0.0).otherwise(2 * same / (F.size(predicted) + F.size(gold)))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _stems(parts: pd.Series) -> pd.Series:
    return parts.map(lambda ps: [[porter(w) for w in ws] for ws in ps])


def answer_f1(rows: DataFrame, predicted: str = "predicted", gold: str = "gold", category: str | None = "category", stem: bool = True, name: str = "f1") -> DataFrame:
    """``rows`` with the token F1 of two texts, on stems unless ``stem`` is off.

    Category 1 is the mean over the gold's parts, cut at commas, of the best
    part of the prediction; category 3 takes the gold before the first
    semicolon; any other, or none, compares the whole texts.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = lambda c: F.transform(F.split(text(c), ","), answer_tokens)
    many = F.coalesce(F.col(category) == 1, F.lit(False)) if category else F.lit(False)
    first = F.coalesce(F.col(category) == 3, F.lit(False)) if category else F.lit(False)
    head = F.element_at(F.split(text(gold), ";"), 1)
    out = rows.withColumn("_p", F.when(many, parts(predicted)).otherwise(F.array(answer_tokens(text(predicted)))))
    out = out.withColumn("_g", F.when(many, parts(gold)).when(first, F.array(answer_tokens(head))).otherwise(F.array(answer_tokens(text(gold)))))
    if stem:
        out = out.withColumn("_p", _stems("_p")).withColumn("_g", _stems("_g"))
    best = F.transform("_g", lambda g: F.array_max(F.transform("_p", lambda p: token_f1(p, g))))
    return out.withColumn(name, F.aggregate(best, F.lit(0.0), lambda a, v: a + v) / F.size("_g")).drop("_p", "_g")


def exact_answer(answer: Column | str, gold: Column | str) -> Column:
    """Whether the whole answer is the gold, regardless of case and marks around it.

    A gold that begins with ``rm`` may stand after the word room, any other
    before the word cells, but ``not enough information`` stands alone.  A long
    answer is never searched for the gold; null is no answer.
    """
    answer, gold = (F.col(c) if isinstance(c, str) else c for c in (answer, gold))
    text = F.btrim(F.lower(F.trim(answer)), F.lit(" .`\""))
    want = F.lower(gold)
    room = F.regexp_replace(text, r"^room\s+", "") == want
    cells = F.regexp_replace(text, r"\s+cells$", "") == want
    more = F.when(want == "not enough information", F.lit(False)).when(want.startswith("rm"), room).otherwise(cells)
    return F.coalesce((text == want) | more, F.lit(False))


def best_weight(scores: DataFrame, weight: str = "weight", value: str = "mean_recall") -> DataFrame:
    """The weight with the best value, ties to the smaller weight."""
    return scores.agg(F.max_by(weight, F.struct(F.col(value), -F.col(weight))).alias(weight), F.max(value).alias(value))


def promoted(curve: DataFrame, step: str = "session", least: float = 0.01) -> DataFrame:
    """(gain, advantage, promote) of a curve (step, graph, adjacency, low) with one row for each checkpoint.

    gain is the last graph value minus the second checkpoint's, advantage the
    last graph value minus the last adjacency value.  Promoted is a curve with
    both at ``least`` or above, the last interval above 0, and a last value not
    below the one before.  A curve is a few checkpoints; fewer than two give null.
    """
    rows = curve.agg(F.sort_array(F.collect_list(F.struct(step, "graph", "adjacency", "low"))).alias("c"))
    at = lambda i: F.try_element_at("c", F.lit(i))
    out = rows.select((at(-1)["graph"] - at(2)["graph"]).alias("gain"), (at(-1)["graph"] - at(-1)["adjacency"]).alias("advantage"), at(-1)["low"].alias("_low"), (at(-1)["graph"] - at(-2)["graph"]).alias("_rise"))
    return out.select("gain", "advantage", ((F.col("gain") >= least) & (F.col("advantage") >= least) & (F.col("_low") > 0) & (F.col("_rise") >= 0)).alias("promote"))


def stratified_sample(rows: DataFrame, stratum: Sequence[str], key: str, n: int, seed: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """n rows of each stratum, drawn by a hash of key and seed."""
    pool = rows if excluded is None else rows.join(excluded.select(key), key, "left_anti")
    order = Window.partitionBy(*stratum).orderBy(drawn(seed, F.col(key)), F.col(key))
    return pool.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def pending_jobs(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs (job_id, model, input) that no cached result (job_id, model, input_sha) answers.

    A cached result of the same job and model with another input is an error.
    """
    keyed = jobs.withColumn("input_sha", F.sha2(F.to_json(F.struct("input")), 256))
    clash = keyed.join(cache.select("job_id", "model", F.col("input_sha").alias("_c")), ["job_id", "model"]).where(F.col("_c") != F.col("input_sha"))
    if not clash.isEmpty():
        raise ValueError("cached results belong to other inputs")
    return keyed.join(cache.select("job_id", "model", "input_sha"), ["job_id", "model", "input_sha"], "left_anti")


def causal_pairs(arms: DataFrame, case: str = "case_id", arm: str = "arm", correct: str = "correct", keep: Sequence[str] = ()) -> DataFrame:
    """One row per case and ``keep``: whether the oracle, counterfactual and bridge-removed arms are all correct."""
    names = ["oracle", "counterfactual", "bridge_removed"]
    wide = arms.groupBy(case, *keep).pivot(arm, names).agg(F.max(F.col(correct).cast("int")))
    return wide.withColumn("all_correct", F.coalesce(F.col(names[0]) + F.col(names[1]) + F.col(names[2]) == 3, F.lit(False)))


def family_summary(pairs: DataFrame, family: str = "family") -> DataFrame:
    """(family, cases, oracle, counterfactual, bridge_removed, all_correct): correct cases of each family."""
    names = ["oracle", "counterfactual", "bridge_removed"]
    return pairs.groupBy(family).agg(F.count(F.lit(1)).alias("cases"), *(F.sum(F.coalesce(n, F.lit(0))).alias(n) for n in names), F.count_if("all_correct").alias("all_correct"))


def usage_report(calls: DataFrame, by: Sequence[str] = ("arm",)) -> DataFrame:
    """Calls, tokens and latency per arm; calls whose provider was unavailable do not count."""
    used = calls.where(~F.coalesce("unavailable", F.lit(False)))
    return used.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.round(F.percentile("seconds", F.lit(0.5)), 6).alias("median_seconds"))


def missing_sources(gold: DataFrame, found: DataFrame, lexical: DataFrame, turns: DataFrame, reached: DataFrame | None = None, scope: Sequence[str] = ("corpus",), gate: DataFrame | None = None) -> DataFrame:
    """Gold turns outside the budget: lexical rank, activation, gate, distance, previous and next turn.

    gold: (query_id, scope, id); found and lexical: (query_id, scope, id, rank);
    reached: (query_id, scope, id, association); turns: (scope, id, tick, ...);
    gate: (query_id, scope, id) of the records that the query's entity lets
    through, for queries that have one.  turn_distance is the distance in turns
    from the nearest retrieved turn of the same session, null without one.
    """
    key = ["query_id", *scope, "id"]
    order = Window.partitionBy(*scope).orderBy("id")
    around = turns.select(*scope, "id", "tick", F.lag("id").over(order).alias("prev_id"), F.lead("id").over(order).alias("next_id"))
    out = gold.select(*key).distinct().join(found.select(*key), key, "left_anti").join(lexical.select(*key, F.col("rank").alias("lexical_rank")), key, "left")
    if reached is not None:
        out = out.join(reached.select(*key, "association"), key, "left").withColumn("association", F.coalesce("association", F.lit(0.0)))
    if gate is not None:
        gated = gate.select("query_id").distinct().withColumn("_has", F.lit(True))
        out = out.join(gated, "query_id", "left").join(gate.select(*key).distinct().withColumn("_in", F.lit(True)), key, "left")
        out = out.withColumn("gated_out", F.coalesce("_has", F.lit(False)) & F.col("_in").isNull()).drop("_has", "_in")
    out = out.join(around, [*scope, "id"])
    # Ids run on inside a session, so that a difference of ids is one of turns.
    seen = found.select(*key).join(turns.select(*scope, "id", "tick"), [*scope, "id"]).withColumnRenamed("id", "_other")
    near = out.select(*key, "tick").join(seen, ["query_id", *scope, "tick"]).groupBy(*key).agg(F.min(F.abs(F.col("_other") - F.col("id"))).alias("turn_distance"))
    return out.join(near, key, "left")


def mined(questions: DataFrame, patterns: Sequence[str], text: str = "query", seed: int = 0, n: int | None = None) -> DataFrame:
    """Questions that match every pattern with their place ``draw`` in an order that depends on the seed; the first ``n`` of them if given."""
    out = questions
    for p in patterns:
        out = out.where(F.col(text).rlike(p))
    out = out.withColumn("_d", drawn(seed, F.col("query_id")))
    if n is not None:
        out = out.orderBy("_d", "query_id").limit(n)
    return numbered(out, ["_d", "query_id"], "draw").drop("_d")
