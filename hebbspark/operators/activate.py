"""Spreading activation: a bounded number of hops, unrolled into joins and sums.

A node passes its mass on to its neighbours in proportion to the decayed edge
weights of its whole row.  A contribution below the cutoff is dropped; the
masses that reach one node in one hop are merged before the next.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hebbspark.operators.edges import at_tick
from hebbspark.operators.ranking import stable_topk
from hebbspark.operators.skew import hot_keys, salted_join
from hebbspark.params import EdgeParams
from hebbspark.session import written

DIGITS = 12


def transitions(adj: DataFrame, tick: int | Column, p: EdgeParams, scope: Sequence[str] = (), hot: Sequence[int] | None = None) -> DataFrame:
    """(scope, src, dst, share): the share of a node's mass that each neighbour gets at the tick.

    The rows of hot nodes are spread over several tasks; they are looked for unless ``hot`` names them.
    """
    read = at_tick(adj, tick, p).where(F.col("now") > 0).select(*scope, "src", "dst", "now")
    if hot is None:
        read = read.persist()  # the hot rows are found before they are joined
        hot = hot_keys(read.groupBy(*scope, "src").agg(F.count(F.lit(1)).alias("_n")), [*scope, "src"], "_n")
    mass = read.groupBy(*scope, "src").agg(F.sum("now").alias("mass"))
    return salted_join(read, mass, [*scope, "src"], hot).select(*scope, "src", "dst", (F.col("now") / F.col("mass")).alias("share"))


@dataclass
class Activation:
    """seeds and scores: (query_id, scope, node, score); arcs: per hop (query_id, scope, hop, src, dst, contribution)."""

    seeds: DataFrame
    scores: DataFrame
    fronts: list[DataFrame]
    arcs: list[DataFrame] = field(default_factory=list)

    def all_arcs(self) -> DataFrame:
        out = self.arcs[0]
        for a in self.arcs[1:]:
            out = out.unionByName(a)
        return out


def valid_seeds(seeds: DataFrame, trans: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Seeds with a positive finite weight and an id within the snapshot; repeated ones are summed."""
    sound = seeds.where((F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")))
    top = trans.groupBy(*scope).agg(F.max("src").alias("_top"))
    sound = sound.join(top, list(scope)) if scope else sound.withColumn("_top", top.scalar())
    return sound.where(F.col("node") <= F.col("_top")).groupBy("query_id", *scope, "node").agg(F.sum("weight").alias("score"))


def hubs(trans: DataFrame, scope: Sequence[str] = (), least: int | None = None) -> list[int]:
    """The nodes whose rows hold a large share of all transitions, for ``activate``."""
    return hot_keys(trans.groupBy(*scope, "src").agg(F.count(F.lit(1)).alias("_n")), [*scope, "src"], "_n", least=least)


def activate(seeds: DataFrame, trans: DataFrame, hops: int = 2, cutoff: float = 1e-3, cap: int | None = 64, scope: Sequence[str] = (), merge: bool = True, hot: Sequence[int] | None = None, mass: float | None = None) -> Activation:
    """Spread seeds (query_id, scope, node, weight) over ``trans``.

    Scores are the sums over all hops, the seeds' own weight included; the
    ``cap`` best of each query stay, and of them those at the cutoff or above.
    Without ``merge`` every path is followed on its own.  The rows of hubs
    (``hot``, found by ``hubs`` if not given) are spread over several tasks.
    ``mass`` is a bound of the sum of a query's seed weights.  No node can ever
    hold more, so a share below cutoff / mass leads nowhere, and a node has at
    most mass / cutoff larger ones: hubs need no care then.
    """
    if mass is not None:
        trans, hot = trans.where(F.col("share") >= F.lit(cutoff / mass * (1 - 1e-9))), []
    hot = hubs(trans, scope) if hot is None else hot
    key = ["query_id", *scope]
    front = valid_seeds(seeds, trans, scope)
    fronts, arcs = [front], []
    for hop in range(1, hops + 1):
        met = salted_join(trans, front.withColumnRenamed("node", "src"), [*scope, "src"], hot)
        step = met.select(*key, F.lit(hop).alias("hop"), "src", "dst", (F.col("score") * F.col("share")).alias("contribution")).where(F.col("contribution") >= cutoff)
        # A table: the next hop, the sums and the paths all read it, and their plans stay short.
        step = written(step, "hop")
        arcs.append(step)
        front = step.select(*key, F.col("dst").alias("node"), F.col("contribution").alias("score"))
        if merge:
            front = front.groupBy(*key, "node").agg(F.sum("score").alias("score"))
        fronts.append(front)
    total = fronts[0]
    for f in fronts[1:]:
        total = total.unionByName(f)
    total = total.groupBy(*key, "node").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    if cap is not None:
        total = stable_topk(total, key, "score", cap, "node").drop("rank")
    return Activation(fronts[0], total.where(F.col("score") >= cutoff), fronts, arcs)


def profile(seeds: DataFrame, act: Activation, trans: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(query_id, counters): what the spreading visited, see the columns.

    frontier_entries and max_frontier count the nodes that hops start from;
    row_visits those of them with neighbours; unique_rows and decay_evaluations
    the distinct rows and their degrees; edge_visits all degrees visited;
    merged_entries what arrived at a node that the same hop already had.
    """
    deg = trans.groupBy(*scope, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    visits = None
    for hop, front in enumerate(act.fronts[:-1]):
        part = front.select("query_id", *scope, "node", F.lit(hop).alias("hop"))
        visits = part if visits is None else visits.unionByName(part)
    visits = visits.join(deg, [*scope, "node"], "left")
    sizes = visits.groupBy("query_id", "hop").agg(F.count(F.lit(1)).alias("c"))
    front = sizes.groupBy("query_id").agg(F.sum("c").alias("frontier_entries"), F.max("c").alias("max_frontier"))
    rows = visits.groupBy("query_id").agg(F.count("deg").alias("row_visits"), F.coalesce(F.sum("deg"), F.lit(0)).alias("edge_visits"))
    once = visits.select("query_id", *scope, "node", "deg").distinct().groupBy("query_id").agg(F.count("deg").alias("unique_rows"), F.coalesce(F.sum("deg"), F.lit(0)).alias("decay_evaluations"))
    arrived = act.all_arcs().groupBy("query_id", "hop", *scope, "dst").agg((F.count(F.lit(1)) - 1).alias("m"))
    again = seeds.groupBy("query_id", *scope, "node").agg((F.count(F.lit(1)) - 1).alias("m"))
    merged = arrived.select("query_id", "m").unionByName(again.select("query_id", "m")).groupBy("query_id").agg(F.sum("m").alias("merged_entries"))
    return front.join(rows, "query_id").join(once, "query_id").join(merged, "query_id", "left").withColumn("merged_entries", F.coalesce("merged_entries", F.lit(0)))


def witness_paths(act: Activation, scope: Sequence[str] = (), simple: bool = False) -> DataFrame:
    """(query_id, scope, node, hop, path): how each node was first reached.

    Hop by hop a node is entered by its largest contribution, ties by the
    smaller source; the path of the first hop that reaches it is kept.  With
    ``simple`` a path does not return to a node it already holds.
    """
    key = ["query_id", *scope]
    layer = act.seeds.select(*key, "node", F.array("node").alias("path"))
    found = layer.withColumn("hop", F.lit(0))
    for hop, arcs in enumerate(act.arcs, start=1):
        met = arcs.join(layer.withColumnRenamed("node", "src"), [*key, "src"])
        if simple:
            met = met.where(~F.array_contains("path", F.col("dst")))
        best = F.max_by(F.struct("path", "src"), F.struct(F.round("contribution", DIGITS), -F.col("src")))
        layer = met.groupBy(*key, "dst").agg(best.alias("_b")).select(*key, F.col("dst").alias("node"), F.array_append("_b.path", F.col("dst")).alias("path"))
        found = found.unionByName(layer.withColumn("hop", F.lit(hop)))
    return found.groupBy(*key, "node").agg(F.min("hop").alias("hop"), F.min_by("path", "hop").alias("path"))
