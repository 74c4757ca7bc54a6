"""The catalogue of queries: each takes (spark, folder of tables) and returns a DataFrame.

``sql`` holds the same queries for DuckDB, where SQL can express them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hebbspark import tables
from hebbspark.functions.text import tokens
from hebbspark.operators import activate as A
from hebbspark.operators import cases as C
from hebbspark.operators import edges as E
from hebbspark.operators import entity as N
from hebbspark.operators import evalops as B
from hebbspark.operators import evidence as Q
from hebbspark.operators import lexical as L
from hebbspark.operators import lifecycle as M
from hebbspark.operators import ranking as K
from hebbspark.operators import replay as P
from hebbspark.operators import retrieve as R
from hebbspark.operators import vectors as V
from hebbspark.params import EdgeParams, SearchParams
from hebbspark.plans import sql
from hebbspark.session import shared_folder, written
from hebbspark.sources.snapshot import is_folder
from hebbspark.streaming.fold import FoldSink, run_available, run_stateful, window_counts, window_pairs

SCOPE = ["corpus"]
#: Logical time at which the graphs of the conversations are read.
NOW = sql.NOW
EDGES = EdgeParams()
SEARCH = SearchParams()

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTERED[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.QUERIES.items() if k in REGISTERED}


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Measures rounded for comparison; adding 0.0 turns -0.0 into 0.0."""
    for n in names:
        df = df.withColumn(n, F.round(F.col(n), digits) + F.lit(0.0))
    return df


# Text and lexical search


@query
def tokenize_terms(spark, folder):
    d = tables.table(spark, folder, "documents").select("doc_id", F.explode(tokens("text")).alias("term"))
    return d.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query
def corpus_stats(spark, folder):
    d = L.documents(tables.table(spark, folder, "documents"), text="text", id_col="doc_id")
    return rounded(L.corpus_stats(d), "avg")


def _docs(spark, folder) -> DataFrame:
    return L.documents(tables.turns(spark, folder), SCOPE).persist()


@query
def bm25_topk(spark, folder):
    scored = L.bm25(tables.questions(spark, folder), _docs(spark, folder), SCOPE)
    top = K.stable_topk(scored, ["query_id", "corpus"], "lexical", 10)
    return rounded(top.select("query_id", "corpus", "id", "lexical", "rank"), "lexical")


@query
def prefix_bm25_top3(spark, folder):
    return rounded(L.prefix_bm25(_docs(spark, folder), SCOPE, 3).select("corpus", "id", "other", "lexical", "rank"), "lexical")


# Edges


def _context(spark, folder) -> DataFrame:
    """(corpus, id, other): the three best earlier turns of each turn."""
    return L.prefix_bm25(_docs(spark, folder), SCOPE, 3).select("corpus", "id", "other")


def _policy(spark, folder, policy: str, near: DataFrame | None = None) -> DataFrame:
    t = tables.turns(spark, folder)
    if policy == "adjacent":
        return E.adjacent_pairs(t, SCOPE)
    near = _context(spark, folder) if near is None else near
    if policy == "learned":
        return E.context_pairs(t, near, SCOPE)
    return (E.star_pairs if policy == "star" else E.combined_pairs)(t, near, SCOPE)


def _pairs(events: DataFrame) -> DataFrame:
    return E.canonical(events).select("corpus", "seq", "a", "b", "tick").distinct()


@query
def edges_adjacent(spark, folder):
    return _pairs(_policy(spark, folder, "adjacent"))


@query
def edges_star(spark, folder):
    return _pairs(_policy(spark, folder, "star"))


@query
def edges_combined(spark, folder):
    return _pairs(_policy(spark, folder, "combined"))


@query
def coactivation_pairs(spark, folder):
    return E.clique_pairs(tables.baskets(spark, folder), ["basket", "tick"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("baskets"))


@query
def edge_fold(spark, folder):
    pairs = E.clique_pairs(tables.baskets(spark, folder), ["basket", "tick"]).withColumnRenamed("basket", "seq")
    return rounded(E.fold(pairs, EDGES), "weight")


def _log_edges(spark, folder) -> DataFrame:
    return E.fold(tables.assoc_log(spark, folder), EDGES, once=True)


def _log_now(spark, folder) -> int:
    """The latest tick of the association log, at which its graph is read."""
    return tables.assoc_log(spark, folder).agg(F.max("tick")).first()[0] or 0


@query
def edge_fold_late_ticks(spark, folder):
    return rounded(_log_edges(spark, folder), "weight")


@query
def edge_fold_live(spark, folder):
    events = M.with_live_ends(tables.assoc_log(spark, folder), tables.record_ticks(spark, folder))
    return rounded(E.fold(events, EDGES, once=True), "weight")


@query
def edge_decay_at_tick(spark, folder):
    return rounded(E.at_tick(_log_edges(spark, folder), _log_now(spark, folder), EDGES).select("a", "b", "now"), "now")


@query
def edge_snapshot_pruned(spark, folder):
    return rounded(E.freeze(_log_edges(spark, folder), _log_now(spark, folder), EDGES), "weight")


@query
def edge_peek_vs_snapshot(spark, folder):
    """What a read of the live state sees beyond a snapshot published before the last tenth of the log."""
    events = tables.assoc_log(spark, folder)
    cut = events.agg(F.floor(F.max("seq") * 9 / 10)).first()[0] or 0
    live = E.at_tick(E.fold(events, EDGES, once=True), _log_now(spark, folder), EDGES).select("a", "b", F.col("now").alias("peek"))
    old = E.freeze(E.fold(events.where(F.col("seq") <= cut), EDGES, once=True), _log_now(spark, folder), EDGES)
    seen = E.at_tick(old, _log_now(spark, folder), EDGES).select("a", "b", F.col("now").alias("snapshot"))
    both = live.join(seen, ["a", "b"], "left").withColumn("snapshot", F.coalesce("snapshot", F.lit(0.0)))
    return rounded(both, "peek", "snapshot").where("peek <> snapshot")


def _log_adjacency(spark, folder) -> DataFrame:
    return E.adjacency(E.freeze(_log_edges(spark, folder), _log_now(spark, folder), EDGES))


@query
def adjacency_degree(spark, folder):
    return E.degree(_log_adjacency(spark, folder))


@query
def neighbors_cap(spark, folder):
    return rounded(E.neighbors(_log_adjacency(spark, folder), _log_now(spark, folder), EDGES, 1e-3, 16), "now")


@query
def pair_weights(spark, folder):
    """Weights between consecutive records of each tick."""
    pairs = E.adjacent_pairs(tables.record_ticks(spark, folder)).select("a", "b", "tick")
    snap = E.freeze(_log_edges(spark, folder), _log_now(spark, folder), EDGES)
    return rounded(E.pair_weights(pairs, snap, _log_now(spark, folder), EDGES), "pair_weight")


@query
def edge_mass_along(spark, folder):
    """The edge mass along the records of each tick, in order of id."""
    paths = tables.record_ticks(spark, folder).where("tick IS NOT NULL").select(F.col("tick").alias("path_id"), F.col("id").alias("pos"), F.col("id").alias("node"))
    snap = E.freeze(_log_edges(spark, folder), _log_now(spark, folder), EDGES)
    return rounded(E.mass_along(paths, snap, _log_now(spark, folder), EDGES, ["path_id"]), "mass")


@query
def graph_stats(spark, folder):
    return rounded(E.stats(_log_edges(spark, folder), _log_now(spark, folder), EDGES, 1 << 20), "load_factor")


@query
def edge_provenance(spark, folder):
    """Which policies make each edge of the conversations, as one text."""
    both = _policy(spark, folder, "adjacent").withColumn("origin", F.lit("adjacent")).unionByName(_policy(spark, folder, "star").withColumn("origin", F.lit("star")))
    return E.provenance(both.select("corpus", "a", "b", "origin"), SCOPE).select("corpus", "a", "b", F.array_join("origins", ",").alias("origins"))


@query
def edges_admitted(spark, folder):
    """The edges of the log that a table with room for half of them admits."""
    first = E.canonical(tables.assoc_events(spark, folder).where("tick IS NOT NULL")).groupBy("a", "b").agg(F.min("seq").alias("first_seen"))
    return E.within_capacity(first, "first_seen", first.count() * 5 // 7)


@query
def shuffled_graph(spark, folder):
    return rounded(E.shuffled(_log_edges(spark, folder), 11), "weight")


@query
def contention_counts(spark, folder):
    """Edges and exact update counts after eight agents' 5,000 writes each, in every layout."""
    out = None
    for layout in C.LAYOUTS:
        state = E.fold(C.contention_log(spark, layout, 8, 5000), EdgeParams(lam=0.0))
        part = state.agg(F.count(F.lit(1)).alias("edges"), F.sum("events").alias("updates"), F.max("events").alias("most"), F.round(F.sum("weight"), 6).alias("weight")).withColumn("layout", F.lit(layout))
        out = part if out is None else out.unionByName(part)
    return out


# Activation


def _graph(spark, folder, policy: str = "adjacent", near: DataFrame | None = None) -> DataFrame:
    events = _policy(spark, folder, "star" if policy == "shuffled" else policy, near)
    edges = E.freeze(E.fold(events, EDGES, SCOPE), NOW, EDGES)
    if policy == "shuffled":
        edges = E.shuffled(edges, 11, SCOPE)
    return written(A.transitions(E.adjacency(edges, SCOPE), NOW, EDGES, SCOPE), "transitions")


def _seeded(spark, folder) -> tuple[DataFrame, DataFrame]:
    lexical = L.bm25(tables.questions(spark, folder), _docs(spark, folder), SCOPE)
    return R.seeds_of(lexical, SEARCH.seeds, SCOPE), _graph(spark, folder)


def _activation(spark, folder, hops: int, cutoff: float, cap: int | None = 64) -> DataFrame:
    seeds, trans = _seeded(spark, folder)
    return rounded(A.activate(seeds, trans, hops, cutoff, cap, SCOPE).scores, "score")


@query
def activation_1hop(spark, folder):
    return _activation(spark, folder, 1, 1e-3)


@query
def activation_2hop(spark, folder):
    return _activation(spark, folder, 2, 1e-3)


@query
def activation_cutoff(spark, folder):
    return _activation(spark, folder, 2, 0.05, None)


@query
def activation_paths(spark, folder):
    """The older rule: every path is followed on its own, and cut off on its own."""
    seeds, trans = _seeded(spark, folder)
    return rounded(A.activate(seeds, trans, 2, 1e-3, None, SCOPE, merge=False).scores, "score")


@query
def activation_arcs(spark, folder):
    seeds, trans = _seeded(spark, folder)
    return rounded(A.activate(seeds, trans, 2, 1e-3, None, SCOPE).all_arcs(), "contribution")


@query
def activation_profile(spark, folder):
    seeds, trans = _seeded(spark, folder)
    return A.profile(seeds, A.activate(seeds, trans, 2, 1e-3, None, SCOPE), trans, SCOPE)


# Retrieval


def _hits(spark, folder, weight: float = 0.4, policy: str = "adjacent") -> DataFrame:
    trans = _graph(spark, folder, policy) if weight else None
    p = SearchParams(graph_weight=weight)
    return R.search(tables.questions(spark, folder).select("query_id", "corpus", "query"), _docs(spark, folder), trans, p, SCOPE)


def _published(hits: DataFrame) -> DataFrame:
    return rounded(hits.select("query_id", "corpus", "id", "lexical", "association", "score", "rank"), "lexical", "association", "score")


@query
def retrieve_lexical(spark, folder):
    return _published(_hits(spark, folder, 0))


@query
def retrieve_associative(spark, folder):
    return _published(_hits(spark, folder))


def _explained(spark, folder) -> DataFrame:
    q = tables.questions(spark, folder).select("query_id", "corpus", "query")
    return R.explain(q, _docs(spark, folder), _graph(spark, folder), SEARCH, SCOPE)


@query
def retrieve_added_by_graph(spark, folder):
    return rounded(_explained(spark, folder).where("added_by_graph").select("query_id", "corpus", "id", "score", "rank"), "score")


@query
def retrieve_witness_paths(spark, folder):
    return _explained(spark, folder).where("path IS NOT NULL").select("query_id", "corpus", "id", "hop", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query
def witness_path_steps(spark, folder):
    """How many steps each witness path of a result has, and how many of them no living edge carries."""
    paths = _explained(spark, folder).where("path IS NOT NULL").select("query_id", "corpus", "id", "path")
    edges = E.freeze(E.fold(_policy(spark, folder, "adjacent"), EDGES, SCOPE), NOW, EDGES)
    weak = E.weak_paths(paths, edges, NOW, EDGES, ["query_id", "id"], SCOPE).groupBy("query_id", "corpus", "id").agg(F.count(F.lit(1)).alias("weak"))
    return paths.join(weak, ["query_id", "corpus", "id"], "left").select("query_id", "corpus", "id", (F.size("path") - 1).alias("steps"), F.coalesce("weak", F.lit(0)).alias("weak"))


@query
def retrieve_connected(spark, folder):
    q = tables.questions(spark, folder).select("query_id", "corpus", "query")
    return R.connected(q, _docs(spark, folder), _graph(spark, folder), SEARCH, SCOPE)


@query
def retrieve_ablation_variants(spark, folder):
    """The ten best hits of each question without a graph, and with the graph of each policy or of the shuffled star.

    Lexical scores and seeds are computed once for all of them.
    """
    q, docs = tables.questions(spark, folder).select("query_id", "corpus", "query"), _docs(spark, folder)
    c, near = R.components(q, docs, None, SEARCH, SCOPE), written(_context(spark, folder), "context")
    out = R.fused(q, docs, c, SearchParams(graph_weight=0), SCOPE).select(F.lit("lexical").alias("variant"), "query_id", "id", "rank")
    for policy in ("adjacent", "learned", "star", "combined", "shuffled"):
        trans = _graph(spark, folder, policy, near)
        hits = R.fused(q, docs, R.over_graph(c, trans, SEARCH, SCOPE), SEARCH, SCOPE)
        out = out.unionByName(hits.select(F.lit(policy).alias("variant"), "query_id", "id", "rank"))
    return out.where("rank <= 10")


@query
def mixed_packet(spark, folder):
    """Eight lexical hits, filled by associative ones to twelve and by ids to sixteen."""
    hits = _hits(spark, folder)
    lex = _hits(spark, folder, 0)
    first = lex.select("query_id", "corpus", "id", F.row_number().over(Window.partitionBy("query_id", "corpus").orderBy("id")).alias("rank"))
    return K.merged_quotas([(lex, 8), (hits, 12), (first, 16)], ["query_id", "corpus"]).select("query_id", "corpus", "id", "rank")


# Vectors


def _vectors(spark, folder) -> DataFrame:
    v = tables.table(spark, folder, "embeddings")
    return v.select((F.col("vec_id") + 1).alias("id"), F.col("embedding").alias("vec"), "label")


def _asking(vectors: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return vectors.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "vec")


def _label_edges(spark, folder) -> DataFrame:
    """Edges between consecutive vectors of one label."""
    v = _vectors(spark, folder).select("id", F.col("label").cast("long").alias("tick"))
    return E.fold(E.adjacent_pairs(v).select("seq", "a", "b", "tick"), EdgeParams(lam=0.0))


@query
def vector_seed_topk(spark, folder):
    v = _vectors(spark, folder)
    return rounded(V.seed_topk(_asking(v), v.select("id", "vec"), 8).select("query_id", "id", "similarity", "rank"), "similarity")


@query
def vector_recall(spark, folder):
    v, p = _vectors(spark, folder), EdgeParams(lam=0.0)
    trans = A.transitions(E.adjacency(_label_edges(spark, folder)), 0, p)
    return rounded(V.recall(_asking(v), v.select("id", "vec"), trans), "score")


@query
def structural_holes(spark, folder):
    v = _vectors(spark, folder)
    nodes = v.where(F.col("id") % 20 == 0)
    return rounded(V.unexplored(nodes, v.select("id", "vec"), _label_edges(spark, folder), 0, EdgeParams(lam=0.0)).select("a", "b", "similarity"), "similarity")


@query
def walk_directional(spark, folder):
    v = _vectors(spark, folder)
    starts = v.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("id").alias("node"), F.col("vec").alias("direction"))
    paths = V.walk(starts, E.adjacency(_label_edges(spark, folder)), v.select("id", "vec"), 0, EdgeParams(lam=0.0))
    return paths.select("query_id", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query
def axis_order(spark, folder):
    v = _vectors(spark, folder)
    return rounded(V.axis(v.select(F.col("label").cast("long").alias("group_id"), "id", "vec")), "projection")


@query
def sector_histogram(spark, folder):
    v = _vectors(spark, folder)
    adj = E.neighbors(E.adjacency(_label_edges(spark, folder)), 0, EdgeParams(lam=0.0))
    near = V.seed_topk(_asking(v), v.select("id", "vec"), 24).where("query_id <> id")
    members = near.select(F.col("query_id").alias("group_id"), "id").unionByName(adj.join(_asking(v).select(F.col("query_id").alias("src")), "src").select(F.col("src").alias("group_id"), F.col("dst").alias("id"))).distinct()
    return rounded(V.sectors(_asking(v).withColumnRenamed("query_id", "group_id"), members.join(v.select("id", "vec"), "id")), "theta")


@query
def hash_embedding(spark, folder):
    e = V.embed(tables.records(spark, folder).select("id", "content"), V.HashEmbedder(128))
    return rounded(e.select("id", F.posexplode("vec").alias("place", "value")).where("value <> 0").withColumn("value", F.col("value").cast("double")), "value")


# Entities


def _roles(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns, names and role links, each kept: routing and scoring read them several times."""
    t = tables.turns(spark, folder).persist()
    known = written(_names(t), "names")
    return t, known, written(N.links(t, known), "roles")


def _names(turns: DataFrame) -> DataFrame:
    return N.names(turns.select("corpus", F.col("speaker").alias("entity"), F.col("speaker").alias("alias")), SCOPE)


@query
def entity_problems(spark, folder):
    """What is wrong with the speakers as a table of names, if the first word of each is taken as an alias."""
    t = tables.turns(spark, folder)
    own = t.select("corpus", F.col("speaker").alias("entity"), F.col("speaker").alias("alias"))
    short = t.select("corpus", F.col("speaker").alias("entity"), F.element_at(F.split(F.trim("speaker"), " "), 1).alias("alias"))
    return N.problems(own.unionByName(short), t.where("tick > 1"), SCOPE)


@query
def entity_ablation(spark, folder):
    """The ten best hits of gated questions in each arm: whose query, which texts, and whether the gate holds."""
    t, known, roles = _roles(spark, folder)
    routed = N.route(tables.questions(spark, folder).select("query_id", "corpus", "query"), known, roles)
    arms = N.ablation_arms(routed, L.documents(t, SCOPE), L.documents(t, SCOPE, "body"), _graph(spark, folder), roles)
    return arms.where("rank <= 10").select("arm", "query_id", "id", "rank")


@query
def entity_only(spark, folder):
    """Gated questions ranked by their topic alone, without the graph."""
    t, known, roles = _roles(spark, folder)
    routed = N.route(tables.questions(spark, folder).select("query_id", "corpus", "query"), known, roles).where("mode = 'entity'")
    hits = N.entity_search(routed, L.documents(t, SCOPE), L.documents(t, SCOPE, "body"), None, roles)
    return rounded(hits.select("query_id", "corpus", "id", "score", "rank"), "score")


@query
def entity_links(spark, folder):
    t = tables.turns(spark, folder)
    return N.links(t, _names(t))


@query
def entity_route(spark, folder):
    t = tables.turns(spark, folder)
    known = _names(t)
    q = tables.questions(spark, folder).select("query_id", "corpus", "query")
    out = N.route(q, known, N.links(t, known))
    return out.select("query_id", "corpus", "mode", "entity", "candidate_count", F.array_join("entities", ",").alias("entities"), F.array_join(tokens("topic_query"), " ").alias("topic_terms"))


@query
def entity_gated_topk(spark, folder):
    t, known, roles = _roles(spark, folder)
    routed = N.route(tables.questions(spark, folder).select("query_id", "corpus", "query"), known, roles)
    hits = N.entity_search(routed, L.documents(t, SCOPE), L.documents(t, SCOPE, "body"), _graph(spark, folder), roles)
    return rounded(hits.select("query_id", "corpus", "id", "score", "rank", "mode", F.array_join("link_types", ",").alias("link_types")), "score")


# Lifecycle


@query
def supersede_history(spark, folder):
    """Records of one writer in one text form a history: each is superseded by the next."""
    r = tables.records(spark, folder).withColumn("key", F.when(F.col("content").isNotNull() & F.col("writer").isNotNull(), F.sha2(F.concat_ws("\n", "writer", "content"), 256)))
    return M.versions(r, "key").select("id", "valid_from", "valid_to", "supersedes")


@query
def live_records(spark, folder):
    r = tables.records(spark, folder).withColumn("key", F.when(F.col("content").isNotNull() & F.col("writer").isNotNull(), F.sha2(F.concat_ws("\n", "writer", "content"), 256)))
    return M.live(M.versions(r, "key")).select("id", "tick")


@query
def ttl_expired(spark, folder):
    r = tables.record_sizes(spark, folder)
    now = r.agg(F.max("tick")).first()[0] or 0
    return M.expired(r, now, max(1, now // 2)).select("id", "tick")


@query
def evict_oldest(spark, folder):
    r = tables.record_sizes(spark, folder)
    totals = M.quota_totals(r).first()
    return M.evicted(r, totals.records * 3 // 4, totals.bytes // 2).select("id", "bytes")


@query
def forget_cascade(spark, folder):
    """The association log without the records of the busiest writer's key ``id % 10 = 0``."""
    r = tables.record_ticks(spark, folder)
    _, events = M.forget(r, tables.assoc_events(spark, folder), r.where("id % 10 = 0"))
    return events.select("seq", "a", "b", "tick")


@query
def ordered_multi_get(spark, folder):
    """The records of each tick, asked for by falling ids with one that does not exist, in that order."""
    r = tables.records(spark, folder).where("tick IS NOT NULL")
    asked = r.groupBy("tick").agg(F.concat(F.array(F.lit(-1).cast("long")), F.sort_array(F.collect_list("id"), asc=False)).alias("ids"))
    return K.ordered_get(asked.select(F.col("tick").alias("request"), "ids"), r.select("id", "writer"), ["request"])


@query
def quota_totals(spark, folder):
    return M.quota_totals(tables.record_sizes(spark, folder))


# Evidence


@query
def evidence_bytes(spark, folder):
    t = tables.turns(spark, folder).select("corpus", F.col("dia_id").alias("id"), F.col("content").alias("text"))
    return Q.evidence_bytes(t, ["corpus"])


@query
def fit_records(spark, folder):
    hits = _hits(spark, folder).select("query_id", "corpus", "id", "rank")
    texts = tables.turns(spark, folder).select("corpus", "id", F.col("content").alias("text"))
    return Q.fit_records(hits.join(texts, ["corpus", "id"]), ["query_id"], 1200, 8).select("query_id", "id", "rank")


@query
def oracle_packet(spark, folder):
    gold, hits = _gold_turns(spark, folder), _hits(spark, folder, 0)
    return Q.oracle_packet(gold, hits, ["query_id", "corpus"], 8)


@query
def bridge_removed_packet(spark, folder):
    """The eight best lexical hits of each question without its evidence turns."""
    packet = _hits(spark, folder, 0).where("rank <= 8").select("query_id", "corpus", "id", "rank")
    return Q.without(packet, _gold_turns(spark, folder), ["query_id", "corpus"])


@query
def counterfactual_packet(spark, folder):
    """The same packet with the evidence turns' texts replaced, here by their capitals."""
    t = tables.turns(spark, folder).select("corpus", "id", F.col("content").alias("text"))
    packet = _hits(spark, folder, 0).where("rank <= 8").select("query_id", "corpus", "id", "rank").join(t, ["corpus", "id"])
    changed = _gold_turns(spark, folder).distinct().join(t, ["corpus", "id"]).withColumn("text", F.upper(F.translate("text", "aeiou", "AEIOU")))
    out = Q.replaced(packet, changed, ["query_id", "corpus"])
    return out.select("query_id", "corpus", "id", "rank", F.md5(F.regexp_replace("text", "[^a-zA-Z]", "")).alias("digest"))


# Evaluation


def _gold(spark, folder) -> DataFrame:
    return tables.questions(spark, folder).select("query_id", "corpus", "category", B.evidence_ids("evidence").alias("gold"))


def _gold_turns(spark, folder) -> DataFrame:
    ids = _gold(spark, folder).select("query_id", "corpus", F.explode("gold").alias("dia_id"))
    return ids.join(tables.turns(spark, folder).select("corpus", "id", "dia_id"), ["corpus", "dia_id"]).select("query_id", "corpus", "id")


@query
def gold_evidence(spark, folder):
    return _gold(spark, folder).select("query_id", F.array_join("gold", ",").alias("gold"))


def _measured(spark, folder, hits: DataFrame, arms: list[str]) -> DataFrame:
    """(arm, query_id, corpus, category, recall, any_found, all_found) of hits (arm, query_id, corpus, id)."""
    got = hits.join(tables.turns(spark, folder).select("corpus", "id", "dia_id"), ["corpus", "id"]).groupBy("arm", "query_id").agg(F.collect_set("dia_id").alias("found"))
    gold = _gold(spark, folder).withColumn("arm", F.explode(F.array(*(F.lit(a) for a in arms))))
    scored = gold.join(got, ["arm", "query_id"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    measures = B.evidence_recall("found", "gold")
    return scored.select("arm", "query_id", "corpus", "category", *(c.alias(n) for n, c in measures.items()))


def _weighted_arms(spark, folder, weights: dict[str, float]) -> DataFrame:
    q, docs = tables.questions(spark, folder).select("query_id", "corpus", "query"), _docs(spark, folder)
    c = R.components(q, docs, _graph(spark, folder), SEARCH, SCOPE)
    return _measured(spark, folder, R.fused_arms(q, docs, c, SEARCH, weights, SCOPE), list(weights))


def _arms(spark, folder) -> DataFrame:
    return _weighted_arms(spark, folder, {"lexical": 0.0, "associative": SEARCH.graph_weight})


@query
def evidence_recall(spark, folder):
    return rounded(_arms(spark, folder).select("arm", "query_id", "recall", "any_found", "all_found"), "recall")


@query
def recall_summary(spark, folder):
    return B.recall_summary(_arms(spark, folder), ["arm", "category"])


@query
def recall_percentiles(spark, folder):
    return B.distribution(_arms(spark, folder).where("recall IS NOT NULL"), ["arm"], "recall")


def _recall_pairs(spark, folder) -> DataFrame:
    return B.paired(_arms(spark, folder).where("recall IS NOT NULL"), ["query_id", "corpus", "category"], "arm", ["associative", "lexical"], "recall")


@query
def paired_outcomes(spark, folder):
    return B.outcomes(_recall_pairs(spark, folder), "associative", "lexical", ["category"])


@query
def sign_test(spark, folder):
    o = B.outcomes(_recall_pairs(spark, folder), "associative", "lexical", ["category"])
    return o.select("category", "wins", "losses", F.round(B.sign_test("wins", "losses"), 6).alias("p"))


@query
def holm_adjust(spark, folder):
    tests = sign_test(spark, folder).select(F.col("category").alias("test"), "p")
    return rounded(B.holm(tests).select("test", "p", "adjusted"), "adjusted")


@query
def abstention_transitions(spark, folder):
    """Questions with no evidence found, before and after the graph takes part."""
    a = _arms(spark, folder).where("recall IS NOT NULL").withColumn("none", ~F.col("any_found"))
    wide = a.groupBy("query_id").pivot("arm", ["associative", "lexical"]).agg(F.first("none").alias("none"), F.first("recall").alias("recall"))
    wide = wide.withColumn("delta", F.col("associative_recall") - F.col("lexical_recall"))
    return B.transitions(wide, "lexical_none", "associative_none", "delta")


@query
def cluster_bootstrap(spark, folder):
    pairs = _recall_pairs(spark, folder).withColumn("delta", F.col("associative") - F.col("lexical"))
    return rounded(B.cluster_bootstrap(pairs, "corpus", "delta"), "mean", "low", "high")


@query
def cluster_means(spark, folder):
    """The mean difference of the arms in each conversation, and its sign."""
    return rounded(B.cluster_outcomes(_recall_pairs(spark, folder), "associative", "lexical", "corpus"), "mean_delta")


def _answers(spark, folder) -> DataFrame:
    """(query_id, gold, category, predicted): the best hit's body as the answer to each question."""
    hits = _hits(spark, folder).where("rank = 1").join(tables.turns(spark, folder).select("corpus", "id", "body"), ["corpus", "id"])
    q = tables.questions(spark, folder).select("query_id", F.col("answer").alias("gold"), "category")
    return q.join(hits.select("query_id", F.col("body").alias("predicted")), "query_id")


@query
def token_f1(spark, folder):
    """Each answer against the best hit's body, on stems."""
    return rounded(B.answer_f1(_answers(spark, folder), category=None), "f1").select("query_id", "f1")


@query
def token_f1_words(spark, folder):
    """The same on words as they stand."""
    return rounded(B.answer_f1(_answers(spark, folder), category=None, stem=False), "f1").select("query_id", "f1")


@query
def category_f1(spark, folder):
    """Each answer against the best hit's body by the rules of its category, on stems."""
    return rounded(B.answer_f1(_answers(spark, folder)), "f1").select("query_id", "f1")


@query
def category_f1_words(spark, folder):
    """The same on words as they stand."""
    return rounded(B.answer_f1(_answers(spark, folder), stem=False), "f1").select("query_id", "f1")


@query
def exact_answers(spark, folder):
    """Each question's answer in four spellings, two of which are exact."""
    q = tables.questions(spark, folder).where("answer IS NOT NULL")
    spellings = F.array(F.col("answer"), F.concat(F.lit(' "'), F.upper("answer"), F.lit('". ')), F.concat(F.lit("it is "), "answer"), F.concat("answer", F.lit(" cells")))
    said = q.select("query_id", "answer", F.posexplode(spellings).alias("spelling", "said"))
    return said.select("query_id", "spelling", B.exact_answer("said", "answer").alias("exact"))


@query
def promotion(spark, folder):
    """The promotion rule over the recall at rising graph weights, each against the search without a graph."""
    names = [f"w{i}" for i in range(len(sql.WEIGHTS))]
    arms = _weighted_arms(spark, folder, dict(zip(names, sql.WEIGHTS))).where("recall IS NOT NULL")
    wide = written(B.paired(arms, ["query_id", "corpus", "category"], "arm", names, "recall"), "arms")
    curve = None
    for i, w in enumerate(names):
        row = wide.agg(F.round(F.avg(w), 9).alias("graph"), F.round(F.avg("w0"), 9).alias("adjacency"), F.percentile(F.col(w) - F.col("w0"), F.lit(0.9)).alias("low")).withColumn("session", F.lit(i))
        curve = row if curve is None else curve.unionByName(row)
    return rounded(B.promoted(curve), "gain", "advantage")


@query
def missing_source_audit(spark, folder):
    """Evidence turns outside the result: lexical rank, activation, gate, distance, and the turns around them."""
    q, docs = tables.questions(spark, folder).select("query_id", "corpus", "query"), _docs(spark, folder)
    t, known, roles = _roles(spark, folder)
    c = R.components(q, docs, _graph(spark, folder), SEARCH, SCOPE)
    lexical = K.ranked(c.lexical, ["query_id", "corpus"], "lexical")
    gate = N.route(q, known, roles).where("mode = 'entity'").select("query_id", "corpus", "entity").join(roles, ["corpus", "entity"])
    out = B.missing_sources(_gold_turns(spark, folder), R.fused(q, docs, c, SEARCH, SCOPE), lexical, t, c.association, SCOPE, gate)
    return rounded(out, "association").select("query_id", "corpus", "id", "lexical_rank", "association", "gated_out", "tick", "turn_distance", "prev_id", "next_id")


def _lexical(spark, folder) -> DataFrame:
    return L.bm25(tables.questions(spark, folder), _docs(spark, folder), SCOPE)


@query
def retrieval_diagnosis(spark, folder):
    """Where each evidence turn of a question is lost or found on its way to the result."""
    q, docs = tables.questions(spark, folder).select("query_id", "corpus", "query"), _docs(spark, folder)
    c = R.components(q, docs, _graph(spark, folder), SEARCH, SCOPE)
    lexical = K.ranked(c.lexical, ["query_id", "corpus"], "lexical")
    out = P.diagnosis(_gold_turns(spark, folder), lexical, c.seeds, c.activation.all_arcs(), c.association, R.fused(q, docs, c, SEARCH, SCOPE), SCOPE)
    return rounded(out, "association")


def _dev(corpus: str = "corpus") -> Column:
    """Whether a conversation is one of those that choices are made on: half of them, by a digest."""
    return F.pmod(F.conv(F.substring(F.md5(corpus), 1, 8), 16, 10).cast("long"), F.lit(2)) == 0


def _grid(spark, folder, modes: tuple[str, ...]) -> DataFrame:
    """(split, policy, mode, mean_recall, complete) of each edge policy and retrieval mode."""
    q, docs = tables.questions(spark, folder).select("query_id", "corpus", "query"), _docs(spark, folder)
    near, c = written(_context(spark, folder), "context"), R.components(q, docs, None, SEARCH, SCOPE)
    hits, arms = None, []
    for policy in ("star", "combined"):
        trans = _graph(spark, folder, policy, near)
        for mode in modes:
            arms.append(f"{policy} {mode}")
            got = R.connected(q, docs, trans, SEARCH, SCOPE) if mode == "connected" else R.fused(q, docs, R.over_graph(c, trans, SEARCH, SCOPE), SEARCH, SCOPE)
            got = got.select(F.lit(arms[-1]).alias("arm"), "query_id", "corpus", "id")
            hits = got if hits is None else hits.unionByName(got)
    scored = _measured(spark, folder, hits, arms).withColumn("split", F.when(_dev(), "development").otherwise("held out"))
    part = lambda i: F.element_at(F.split("arm", " "), i)
    return scored.groupBy("split", part(1).alias("policy"), part(2).alias("mode")).agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.count_if("all_found").alias("complete"))


@query
def policy_grid(spark, folder):
    """Mean recall and complete answers of each edge policy and retrieval mode, on either half of the conversations."""
    return _grid(spark, folder, ("associative", "connected"))


@query
def policy_grid_associative(spark, folder):
    """The associative half of the grid."""
    return _grid(spark, folder, ("associative",))


#: The sweeps of the longitudinal replay, and those at which it is measured.
SWEEPS = 50
CHECKPOINTS = (0, 1, 5, 10, 25, 50)


def _curve(spark, folder, sweeps: int = SWEEPS, checkpoints: tuple[int, ...] = CHECKPOINTS) -> DataFrame:
    """(session, graph, adjacency, lexical, low, high) for each checkpoint of a replay that starts from the star graph."""
    q, docs = tables.questions(spark, folder).select("query_id", "corpus", "query"), _docs(spark, folder)
    c = R.components(q, docs, _graph(spark, folder), SEARCH, SCOPE)
    still = written(R.fused_arms(q, docs, c, SEARCH, {"adjacency": SEARCH.graph_weight, "lexical": 0.0}, SCOPE).select("arm", "query_id", "corpus", "id"), "control")
    edges = E.fold(_policy(spark, folder, "star"), EDGES, SCOPE)
    at = sorted(c for c in checkpoints if c <= sweeps)
    graph = {sweep: f"graph{sweep}" for sweep in at}
    hits = P.replay_at(q, docs, edges, at, NOW, SEARCH, EDGES, SCOPE)
    arms = still.unionByName(hits.select(F.concat(F.lit("graph"), F.col("sweep").cast("string")).alias("arm"), "query_id", "corpus", "id"))
    names = [*graph.values(), "adjacency", "lexical"]
    wide = written(B.paired(_measured(spark, folder, arms, names).where("recall IS NOT NULL"), ["query_id", "corpus"], "arm", names, "recall", strict=False), "checkpoints")
    deltas = wide.select("corpus", *((F.col(name) - F.col("adjacency")).alias(name) for name in graph.values()))
    between = B.cluster_intervals(deltas, "corpus", list(graph.values()))
    means = written(wide.agg(*(F.avg(name).alias(name) for name in names)).crossJoin(between), "means")
    parts = [F.struct(F.lit(sweep).alias("session"), F.col(name).alias("graph"), "adjacency", "lexical", F.col(f"{name}_low").alias("low"), F.col(f"{name}_high").alias("high")) for sweep, name in graph.items()]
    return means.select(F.inline(F.array(*parts)))


@query
def longitudinal_curve(spark, folder):
    """Mean recall at checkpoints of 50 sweeps in which every result links its records, with the unchanged arms and the interval of the difference."""
    return rounded(_curve(spark, folder), "graph", "adjacency", "lexical", "low", "high")


def _calls(spark, folder) -> DataFrame:
    """One call for each question: its sizes as tokens, a time from its id, every seventh unavailable."""
    q = tables.questions(spark, folder)
    return q.select(
        F.col("category").cast("string").alias("arm"),
        (F.col("query_id") % 7 == 0).alias("unavailable"),
        F.length("query").cast("long").alias("input_tokens"),
        F.length("answer").cast("long").alias("output_tokens"),
        (F.col("query_id") % 13 / F.lit(10.0)).alias("seconds"),
    )


@query
def usage_report(spark, folder):
    return B.usage_report(_calls(spark, folder))


@query
def pending_jobs(spark, folder):
    """The questions that a cache with the results of every second one leaves to be asked."""
    jobs = tables.questions(spark, folder).select(F.col("query_id").alias("job_id"), F.lit("m").alias("model"), F.col("query").alias("input"))
    cache = jobs.where("job_id % 2 = 0").select("job_id", "model", F.sha2(F.to_json(F.struct("input")), 256).alias("input_sha"))
    return B.pending_jobs(jobs, cache).select("job_id")


@query
def causal_families(spark, folder):
    """Cases of each category in which all three causal arms are right, with outcomes that depend on the question's id."""
    right = {"oracle": 2, "counterfactual": 3, "bridge_removed": 5}
    arms = F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), (F.col("query_id") % n != 0).alias("correct")) for a, n in right.items()))).alias("x")
    rows = tables.questions(spark, folder).select(F.col("query_id").alias("case_id"), F.col("category").alias("family"), arms).select("case_id", "family", "x.*")
    return B.family_summary(B.causal_pairs(rows, keep=["family"]))


@query
def stratified_questions(spark, folder):
    return B.stratified_sample(tables.questions(spark, folder), ["category"], "query_id", 20).select("query_id", "category")


@query
def best_graph_weight(spark, folder):
    """The graph weight with the best mean recall over the development conversations, ties to the smaller, and its recall over the others."""
    arms = _weighted_arms(spark, folder, {str(w): w for w in sql.WEIGHTS})
    split = arms.withColumn("dev", _dev())
    means = split.groupBy(F.col("arm").cast("double").alias("weight")).agg(*(F.round(F.avg(F.when(c, F.col("recall"))), 6).alias(n) for n, c in (("mean_recall", F.col("dev")), ("test_recall", ~F.col("dev")))))
    return B.best_weight(means).join(means.select("weight", "test_recall"), "weight")


# Streams


@query
def coactivation_windows(spark, folder):
    return window_counts(tables.table(spark, folder, "events"))


def _stream(spark, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream, whether the table is one file or a folder of files."""
    reader = spark.readStream.schema(tables.table(spark, folder, name).schema)
    path = f"{folder}/{name}.parquet"
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query
def stream_association_fold(spark, folder):
    """The association log as a stream of files, folded batch by batch into the same state as edge_fold_late_ticks."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    prepare = lambda df: df.where("id IS NOT NULL").select(F.col("id").alias("seq"), "a", "b", "tick").distinct()
    return rounded(run_available(_stream(spark, folder, "associations"), FoldSink(spark, place, EDGES), f"{place}/offsets", prepare), "weight")


@query
def stream_coactivation_fold(spark, folder):
    """Users active in the same ten minutes, folded from a stream of the event table."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return rounded(run_available(_stream(spark, folder, "events"), FoldSink(spark, place, EDGES), f"{place}/offsets", window_pairs), "weight")


@query
def stream_snapshot(spark, folder):
    """The snapshot that the stream of the log publishes at its end."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    prepare = lambda df: df.where("id IS NOT NULL").select(F.col("id").alias("seq"), "a", "b", "tick").distinct()
    sink = FoldSink(spark, place, EDGES)
    run_available(_stream(spark, folder, "associations"), sink, f"{place}/offsets", prepare)
    return rounded(sink.snapshot(), "weight")


@query
def stream_stateful_fold(spark, folder):
    """The association log as a stream whose state is kept per edge in the state store."""
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    log = _stream(spark, folder, "associations").where("id IS NOT NULL").select(F.col("id").alias("seq"), "a", "b", "tick")
    return rounded(run_stateful(log, place, EDGES), "weight")
