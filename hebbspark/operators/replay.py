"""Longitudinal replay: retrieval that learns from its own results, sweep by sweep."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hebbspark.operators.activate import DIGITS, hubs, transitions
from hebbspark.operators.edges import adjacency, clique_pairs, freeze
from hebbspark.operators.retrieve import FUSED_DIGITS, components, fused, over_graph
from hebbspark.params import EdgeParams, SearchParams
from hebbspark.session import written
from hebbspark.streaming.fold import merge_fold


def replay(queries: DataFrame, docs: DataFrame, edges: DataFrame, sweeps: int, start: int, p: SearchParams = SearchParams(), e: EdgeParams = EdgeParams(), scope: Sequence[str] = ()) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """(sweep, hits, edges before it) for sweeps 0 to ``sweeps``.

    All queries of a sweep see the snapshot of its start; then the records of
    every result are linked with each other at the sweep's tick, and the graph
    is published once.  Each state is a table, so the plan does not grow, and
    the lexical scores, which no sweep changes, are computed once.
    """
    base = components(queries, docs, None, p, scope)
    hot = hubs(adjacency(edges, scope), scope)
    for sweep in range(sweeps + 1):
        tick = start + sweep
        trans = transitions(adjacency(freeze(edges, tick, e), scope), tick, e, scope, hot)
        hits = written(fused(queries, docs, over_graph(base, trans, p, scope), p, scope), "sweep")
        yield sweep, hits, edges
        if sweep < sweeps:
            pairs = clique_pairs(hits.withColumnRenamed("id", "node"), ["query_id", *scope])
            events = pairs.select(*scope, F.col("query_id").alias("seq"), "a", "b", F.lit(tick).cast("long").alias("tick"))
            edges = written(merge_fold(edges, events, e, scope=scope), "edges")


#: Rows (lexical scores, seeds and edges) of the scopes that one task replays together.
PACK_ROWS = 200_000
#: Rows of a scope above which its sweeps are plans, so that no scope is one task's work.
LARGE_SCOPE = 2_000_000
#: Steps along edges that are laid out at once.
STEPS = 1 << 22


def _spread(node: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place): every place from first[node[i]] up to first[node[i] + 1]."""
    count = first[node + 1] - first[node]
    i = np.repeat(np.arange(len(node)), count)
    return i, np.arange(len(i)) + np.repeat(first[node] - (np.cumsum(count) - count), count)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, values, len(keys))


def _hop(front: tuple[np.ndarray, np.ndarray], first: np.ndarray, dst: np.ndarray, share: np.ndarray, nodes: int, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    key, score = front
    query, node = key // nodes, key % nodes
    steps = np.cumsum(first[node + 1] - first[node])
    cuts = np.searchsorted(steps, np.arange(STEPS, steps[-1] if len(steps) else 0, STEPS))
    keys, values = [], []
    for part in np.split(np.arange(len(key)), cuts):
        i, place = _spread(node[part], first)
        value = score[part][i] * share[place]
        ok = value >= cutoff
        keys.append(query[part][i[ok]] * nodes + dst[place[ok]])
        values.append(value[ok])
    return _summed(np.concatenate(keys), np.concatenate(values))


def _sweeps(pdf: pd.DataFrame, scope: Sequence[str], at: Sequence[int], start: int, p: SearchParams, e: EdgeParams) -> pd.DataFrame:
    """The hits at the sweeps ``at`` of some scopes, see ``replay_at``; one array holds what a table holds there."""
    keep = min(1.0, max(0.0, 1 - e.lam))
    kind, code = pdf["_kind"].to_numpy(), pdf.groupby(list(scope), sort=True).ngroup().to_numpy()
    edge = kind == 2
    if edge.all():
        none = np.zeros(0, np.int64)
        return pd.DataFrame({"sweep": none, "query_id": none, **{c: pdf[c].to_numpy()[:0] for c in scope}, "id": none, "rank": none})
    own = pd.DataFrame({"s": np.r_[code, code[edge]], "n": np.r_[pdf["_y"].to_numpy(), pdf["_x"].to_numpy()[edge]]})
    # Numbers of nodes rise by scope and id.
    node = own.groupby(["s", "n"], sort=True).ngroup().to_numpy()
    names = own.drop_duplicates().sort_values(["s", "n"])
    ids, of, nodes = names["n"].to_numpy(), names["s"].to_numpy(), len(names)
    asked = pd.DataFrame({"s": code, "q": pdf["_x"].to_numpy()})[~edge]
    query = asked.groupby(["s", "q"], sort=True).ngroup().to_numpy()
    queries = asked.drop_duplicates().sort_values(["s", "q"])
    key, value = query * nodes + node[: len(pdf)][~edge], pdf["_v"].to_numpy()[~edge]
    lexical, seed = kind[~edge] == 0, (kind[~edge] == 1) & (value > 0) & np.isfinite(value)
    base, own_weight = _summed(key[lexical], value[lexical]), _summed(key[seed], value[seed])
    x, y = node[len(pdf) :], node[: len(pdf)][edge]
    edges = x * nodes + y
    by = np.argsort(edges)
    edges, weight, last = edges[by], pdf["_v"].to_numpy()[edge][by], pdf["_last"].to_numpy()[edge][by].astype(np.int64)
    out = []
    for sweep in range(max(at) + 1):
        tick = start + sweep
        now = weight * keep ** np.maximum(tick - last, 0).astype(np.float64)
        alive = np.flatnonzero(now >= e.floor)
        a, b = edges[alive] // nodes, edges[alive] % nodes
        src, dst, read = np.r_[a, b], np.r_[b, a], np.r_[now[alive], now[alive]]
        share = read / np.bincount(src, read, nodes)[src]
        far = np.flatnonzero(share >= p.cutoff * (1 - 1e-9))
        far = far[np.argsort(src[far], kind="stable")]
        src, dst, share = src[far], dst[far], share[far]
        first = np.r_[0, np.cumsum(np.bincount(src, minlength=nodes))]
        top = np.full(of[-1] + 1, -1)
        top[of[src]] = src  # of equal scopes the last, which is the largest, stays
        valid = own_weight[0] % nodes <= top[of[own_weight[0] % nodes]]
        front = own_weight[0][valid], own_weight[1][valid]
        fronts = [front]
        for _ in range(p.hops):
            front = _hop(front, first, dst, share, nodes, p.cutoff)
            fronts.append(front)
        reached, score = _summed(np.concatenate([k for k, _ in fronts]), np.concatenate([v for _, v in fronts]))
        score = np.round(score, DIGITS)
        reached, score = reached[score >= p.cutoff], score[score >= p.cutoff]
        given = np.zeros(len(reached))
        if len(fronts[0][0]):
            place = np.minimum(np.searchsorted(fronts[0][0], reached), len(fronts[0][0]) - 1)
            given = np.where(fronts[0][0][place] == reached, fronts[0][1][place], 0.0)
        more = np.maximum(score - given, 0.0)
        keys, group = np.unique(np.r_[base[0], reached], return_inverse=True)
        terms = np.bincount(group[: len(base[0])], base[1], len(keys))
        association = np.bincount(group[len(base[0]) :], more, len(keys))
        q, n = keys // nodes, keys % nodes
        begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        which = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(q)]))
        part = lambda v: v / np.maximum(np.maximum.reduceat(v, begins), 1e-12)[which]  # noqa: B023, E731
        fused_score = np.floor((part(terms) + p.graph_weight * part(association)) * 10**FUSED_DIGITS + 0.5)
        best = np.lexsort((n, -fused_score, q))
        rank = np.arange(len(q)) - begins[which] + 1  # the same in either order, because queries sort first
        hit = best[rank <= p.budget]
        q, n, rank = q[hit], n[hit], rank[rank <= p.budget]
        if sweep in at:
            own_query = queries.iloc[q]
            out.append(pd.DataFrame({"sweep": sweep, "query_id": own_query["q"].to_numpy(), "_s": own_query["s"].to_numpy(), "id": ids[n], "rank": rank}))
        if sweep == max(at):
            break
        linked = np.unique(q * nodes + n)
        linked = linked[ids[linked % nodes] > 0]
        q, n = linked // nodes, linked % nodes
        ends = np.searchsorted(q, q, side="right")
        count = ends - np.arange(len(q)) - 1
        i = np.repeat(np.arange(len(q)), count)
        other = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        new, gain = _summed(n[i] * nodes + n[other], np.full(len(i), float(e.eta)))
        every, group = np.unique(np.r_[edges, new], return_inverse=True)
        was, added = group[: len(edges)], group[len(edges) :]
        at_last, folded = np.full(len(every), tick), np.zeros(len(every))
        at_last[was] = last
        folded[was] = weight
        then = np.maximum(at_last[added], tick)
        folded[added] = folded[added] * keep ** (then - at_last[added]).astype(np.float64) + gain
        at_last[added] = then
        edges, weight, last = every, folded, at_last
    hits = pd.concat(out)
    names = pdf[list(scope)].assign(_s=code).drop_duplicates("_s").sort_values("_s")
    for c in scope:
        hits[c] = names[c].to_numpy()[hits["_s"].to_numpy()]
    return hits[["sweep", "query_id", *scope, "id", "rank"]]


def replay_at(queries: DataFrame, docs: DataFrame, edges: DataFrame, at: Sequence[int], start: int, p: SearchParams, e: EdgeParams, scope: Sequence[str], pack: int = PACK_ROWS, large: int = LARGE_SCOPE) -> DataFrame:
    """(sweep, query_id, scope, id, rank): the hits of ``replay`` at the sweeps ``at``, from 0.

    Nothing passes from one scope to another, so a task takes some scopes
    through all sweeps in arrays: the number of jobs does not depend on the
    number of sweeps.  Scopes of more than ``large`` rows are replayed by plans.
    """
    names = list(scope)
    base = components(queries, docs, None, p, scope)
    edges = written(edges, "edges")
    place = docs.select(*names, "id").where("id IS NOT NULL").groupBy(*names).agg(F.slice(F.sort_array(F.collect_list("id")), 1, 2 * p.budget).alias("_ids"))
    fill = queries.select("query_id", *names).join(place, names).select("query_id", *names, F.explode("_ids").alias("id"))
    row = lambda df, kind, x, y, v, last=None: df.select(*names, F.lit(kind).alias("_kind"), F.col(x).alias("_x"), F.col(y).alias("_y"), v.alias("_v"), (F.lit(0).cast("long") if last is None else F.col(last)).alias("_last"))
    rows = row(base.lexical, 0, "query_id", "id", F.col("lexical")).unionByName(row(fill, 0, "query_id", "id", F.lit(0.0)))
    rows = rows.unionByName(row(base.seeds, 1, "query_id", "node", F.col("weight"))).unionByName(row(edges, 2, "a", "b", F.col("weight"), "last_tick"))
    rows = written(rows, "replay")
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_c"))
    total = rows.count()
    over = written(sizes.where(F.col("_c") > large).select(*names), "large")
    packs = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // pack))
    few = rows.join(over, names, "left_anti").withColumn("_pack", F.pmod(F.xxhash64(*names), F.lit(packs)))
    field = lambda df, c: df.schema[c]
    schema = T.StructType([T.StructField("sweep", T.IntegerType()), T.StructField("query_id", T.LongType()), *(field(rows, c) for c in names), T.StructField("id", T.LongType()), T.StructField("rank", T.IntegerType())])
    out = few.repartition(packs, "_pack").groupBy("_pack").applyInPandas(lambda pdf: _sweeps(pdf, names, at, start, p, e), schema)
    out = written(out, "replayed")
    if over.isEmpty():
        return out
    only = lambda df: df.join(over, names, "left_semi")
    for sweep, hits, _ in replay(only(queries), only(docs), only(edges), max(at), start, p, e, scope):
        if sweep in at:
            out = out.unionByName(hits.select(F.lit(sweep).alias("sweep"), "query_id", *names, "id", "rank"))
    return out


def changed_packets(before: DataFrame, after: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Hits (query_id, scope, id, rank) that two runs do not share: none if the packets are the same."""
    key = ["query_id", *scope, "id", "rank"]
    return before.select(*key).exceptAll(after.select(*key)).unionByName(after.select(*key).exceptAll(before.select(*key)))


def diagnosis(gold: DataFrame, lexical: DataFrame, seeds: DataFrame, arcs: DataFrame, association: DataFrame, hits: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One row per required record: seed or not, lexical rank, association, first hop that reaches it, final rank."""
    key = ["query_id", *scope, "id"]
    first = arcs.groupBy("query_id", *scope, F.col("dst").alias("id")).agg(F.min("hop").alias("first_hop"))
    own = seeds.select("query_id", *scope, F.col("node").alias("id"), F.lit(True).alias("is_seed"))
    out = gold.select(*key).distinct()
    for part in (own, lexical.select(*key, F.col("rank").alias("lexical_rank")), association.select(*key, "association"), first, hits.select(*key, F.col("rank").alias("final_rank"))):
        out = out.join(part, key, "left")
    return out.select(*key, F.coalesce("is_seed", F.lit(False)).alias("is_seed"), "lexical_rank", F.coalesce("association", F.lit(0.0)).alias("association"), "first_hop", "final_rank")
