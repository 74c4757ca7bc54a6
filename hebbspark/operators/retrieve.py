"""Retrieval: lexical seeds, activation, fusion and stable top-k, for a batch of queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hebbspark.operators.activate import Activation, activate, witness_paths
from hebbspark.operators.lexical import bm25
from hebbspark.operators.ranking import ranked, stable_topk
from hebbspark.params import SearchParams
from hebbspark.session import written

FUSED_DIGITS = 9


def seeds_of(lexical: DataFrame, count: int, scope: Sequence[str] = ()) -> DataFrame:
    """(query_id, scope, node, weight): the best positive records of each query, weights of sum 1."""
    best = stable_topk(lexical, ["query_id", *scope], "lexical", count).where("lexical > 0")
    total = F.sum("lexical").over(Window.partitionBy("query_id", *scope))
    return best.select("query_id", *scope, F.col("id").alias("node"), (F.col("lexical") / total).alias("weight"))


@dataclass
class Components:
    lexical: DataFrame
    seeds: DataFrame
    activation: Activation | None
    association: DataFrame | None


def components(queries: DataFrame, docs: DataFrame, trans: DataFrame | None, p: SearchParams = SearchParams(), scope: Sequence[str] = ()) -> Components:
    """Lexical scores, and what the graph adds to them beyond the seeds' own weight."""
    # Tables: plans that hold kept frames within kept frames are described at a length that grows with each of them.
    lexical = written(bm25(queries, docs, scope), "lexical")
    seeds = written(seeds_of(lexical, p.seeds, scope), "seeds")
    if trans is None or p.graph_weight == 0:
        return Components(lexical, seeds, None, None)
    return over_graph(Components(lexical, seeds, None, None), trans, p, scope)


def over_graph(c: Components, trans: DataFrame, p: SearchParams = SearchParams(), scope: Sequence[str] = ()) -> Components:
    """The same lexical scores and seeds with the activation over one more graph."""
    lexical, seeds = c.lexical, c.seeds
    act = activate(seeds, trans, p.hops, p.cutoff, None, scope, mass=1.0)  # the seeds' weights sum to 1
    key = ["query_id", *scope, "node"]
    more = act.scores.join(act.seeds.withColumnRenamed("score", "_own"), key, "left")
    gain = F.greatest(F.col("score") - F.coalesce("_own", F.lit(0.0)), F.lit(0.0))
    association = more.select("query_id", *scope, F.col("node").alias("id"), gain.alias("association"))
    return Components(lexical, seeds, act, written(association, "association"))


def shares(queries: DataFrame, docs: DataFrame, c: Components, p: SearchParams, scope: Sequence[str] = (), positive_only: bool = False) -> DataFrame:
    """(query_id, scope, id, lexical, association, _lexical, _association): all records that can be in a result, scores also as shares of their maximum.

    Records that neither score reaches follow by id, so a query gets budget
    rows wherever its scope has them; only the 2 * budget smallest ids of a
    scope can be among those, and no others are joined.
    """
    key = ["query_id", *scope]
    rows = c.lexical.select(*key, "id", "lexical", F.lit(0.0).alias("association"))
    if c.association is not None:
        rows = rows.unionByName(c.association.select(*key, "id", F.lit(0.0).alias("lexical"), "association"))
    if not positive_only:
        ids = docs.select(*scope, "id").where("id IS NOT NULL")
        if scope:
            order = Window.partitionBy(*scope).orderBy("id")
            first = ids.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2 * p.budget).drop("_r")
            fill = queries.select(*key).join(first, list(scope))
        else:
            few = ids.orderBy("id").limit(2 * p.budget).agg(F.collect_list("id"))
            fill = queries.select("query_id", F.explode(few.scalar()).alias("id"))
        rows = rows.unionByName(fill.select(*key, "id", F.lit(0.0).alias("lexical"), F.lit(0.0).alias("association")))
    both = rows.groupBy(*key, "id").agg(F.sum("lexical").alias("lexical"), F.sum("association").alias("association"))
    top = Window.partitionBy(*key)
    share = lambda name: F.col(name) / F.greatest(F.max(name).over(top), F.lit(1e-12))
    return both.withColumn("_lexical", share("lexical")).withColumn("_association", share("association"))


def _score(weight: float) -> Column:
    return F.round(F.col("_lexical") + F.lit(float(weight)) * F.col("_association"), FUSED_DIGITS)


def fused(queries: DataFrame, docs: DataFrame, c: Components, p: SearchParams, scope: Sequence[str] = (), positive_only: bool = False) -> DataFrame:
    """(query_id, scope, id, lexical, association, score, rank): the budget's best records of every query."""
    scored = shares(queries, docs, c, p, scope, positive_only).withColumn("score", _score(p.graph_weight)).drop("_lexical", "_association")
    return stable_topk(scored, ["query_id", *scope], "score", p.budget)


def fused_arms(queries: DataFrame, docs: DataFrame, c: Components, p: SearchParams, weights: Mapping[str, float], scope: Sequence[str] = ()) -> DataFrame:
    """(arm, query_id, scope, id, score, rank): the result at each of the named graph weights, from scores that are computed once."""
    key = ["query_id", *scope]
    out = shares(queries, docs, c, p, scope)
    for i, weight in enumerate(weights.values()):
        out = ranked(out.withColumn(f"_s{i}", _score(weight)), key, f"_s{i}", name=f"_r{i}")
    arms = F.array(*(F.struct(F.lit(name).alias("arm"), F.col(f"_s{i}").alias("score"), F.col(f"_r{i}").alias("rank")) for i, name in enumerate(weights)))
    chosen = out.select(*key, "id", F.explode(F.filter(arms, lambda a: a["rank"] <= p.budget)).alias("_a"))
    return chosen.select("_a.arm", *key, "id", "_a.score", "_a.rank")


def search(queries: DataFrame, docs: DataFrame, trans: DataFrame | None, p: SearchParams = SearchParams(), scope: Sequence[str] = (), positive_only: bool = False) -> DataFrame:
    return fused(queries, docs, components(queries, docs, trans, p, scope), p, scope, positive_only)


def explain(queries: DataFrame, docs: DataFrame, trans: DataFrame, p: SearchParams = SearchParams(), scope: Sequence[str] = (), c: Components | None = None) -> DataFrame:
    """The search result with ``added_by_graph``, and the witness path and its hop where the graph reaches the record."""
    c = components(queries, docs, trans, p, scope) if c is None else c
    group, key = ["query_id", *scope], ["query_id", *scope, "id"]
    both = shares(queries, docs, c, p, scope).withColumn("score", _score(p.graph_weight)).withColumn("_plain", _score(0))
    both = ranked(ranked(both, group, "_plain", name="_place"), group, "score").where(F.col("rank") <= p.budget)
    out = both.withColumn("added_by_graph", F.col("_place") > p.budget).drop("_lexical", "_association", "_plain", "_place")
    if c.activation is None:
        return out.withColumn("hop", F.lit(None).cast("int")).withColumn("path", F.lit(None).cast("array<long>"))
    return out.join(witness_paths(c.activation, scope).withColumnRenamed("node", "id"), key, "left")


def live_only(hits: DataFrame, records: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Hits on records that are not superseded and not conjecture; applied after the top-k, so there may be fewer than the budget."""
    alive = records.where("valid_to IS NULL AND layer = 0").select(*scope, "id")
    return hits.join(alive, [*scope, "id"], "left_semi")


def recall_events(hits: DataFrame, tick: int) -> DataFrame:
    """(query_id, nodes, tick): the sets that a recall co-activates, those of more than one record."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_set("id")).alias("nodes")).where(F.size("nodes") > 1).withColumn("tick", F.lit(tick).cast("long"))


def recall(queries: DataFrame, docs: DataFrame, records: DataFrame, trans: DataFrame | None, tick: int, p: SearchParams = SearchParams(), scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The live hits of a search, and the events that recalling them adds to the log; searching itself changes nothing."""
    hits = live_only(search(queries, docs, trans, p, scope), records, scope)
    return hits, recall_events(hits, tick)


def connected(queries: DataFrame, docs: DataFrame, trans: DataFrame, p: SearchParams = SearchParams(), scope: Sequence[str] = ()) -> DataFrame:
    """(query_id, scope, id, position): one root per query, and whole witness paths admitted in order of the fused score.

    A path is admitted if the records it would add still fit the budget; one
    that does not fit is passed over.  The order-dependent choice runs per
    query over the records the root reaches.
    """
    # A hop passes on a mass of 1 at most and drops what is below the cutoff: a query reaches hops / cutoff records at most.
    one = SearchParams(p.budget, p.hops, 1, p.graph_weight, p.cutoff)
    c = components(queries, docs, trans, one, scope)
    key = ["query_id", *scope]
    paths = witness_paths(c.activation, scope, simple=True).withColumnRenamed("node", "id")
    every = SearchParams(1 << 30, one.hops, 1, one.graph_weight, one.cutoff)
    order = fused(queries, docs, c, every, scope, positive_only=True).select(*key, "id", "rank")
    rows = paths.join(order, [*key, "id"])
    budget = p.budget

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list[int] = []
        for path in pdf.sort_values("rank")["path"]:
            new = [n for n in path if n not in chosen]
            if len(chosen) + len(new) <= budget:
                chosen += new
        head = {k: pdf[k].iloc[0] for k in key}
        return pd.DataFrame({**{k: [v] * len(chosen) for k, v in head.items()}, "id": chosen, "position": range(1, len(chosen) + 1)})

    schema = T.StructType([*(rows.schema[k] for k in key), T.StructField("id", T.LongType()), T.StructField("position", T.LongType())])
    return rows.select(*key, "id", "rank", "path").groupBy(*key).applyInPandas(admit, schema)
