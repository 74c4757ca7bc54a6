"""Entity-gated retrieval: names, role links, routing and scoring inside the gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hebbspark.operators.lexical import bm25
from hebbspark.operators.ranking import stable_topk
from hebbspark.operators.retrieve import FUSED_DIGITS, Components, components, fused
from hebbspark.params import SearchParams
from hebbspark.session import written


def name_key(name: Column | str) -> Column:
    """Names are the same without outer spaces and regardless of case."""
    return F.lower(F.trim(name))


def names(aliases: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, key, entity) from (scope, entity, alias); blank aliases are dropped."""
    return aliases.select(*scope, name_key("alias").alias("key"), name_key("entity").alias("entity")).where("key <> '' AND entity <> ''").distinct()


def ambiguous(known: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Keys that are bound to more than one entity: a table of names should have none."""
    return known.groupBy(*scope, "key").agg(F.sort_array(F.collect_set("entity")).alias("entities")).where(F.size("entities") > 1)


def problems(aliases: DataFrame, records: DataFrame | None = None, scope: Sequence[str] = (), speaker: str = "speaker") -> DataFrame:
    """(scope, problem, name): what makes a table of (scope, entity, alias) unusable; a sound one gives no rows.

    blank: a null or blank name; ambiguous: a name of several entities;
    undeclared: an entity that is not among its own names; unknown speaker: a
    speaker of ``records`` that is no entity.
    """
    key, entity = name_key("alias"), name_key("entity")
    named = aliases.select(*scope, key.alias("key"), entity.alias("entity"))
    blank = named.where((F.coalesce("key", F.lit("")) == "") | (F.coalesce("entity", F.lit("")) == "")).select(*scope, F.lit("blank").alias("problem"), F.coalesce("key", F.lit("")).alias("name"))
    known = names(aliases, scope)
    double = ambiguous(known, scope).select(*scope, F.lit("ambiguous").alias("problem"), F.col("key").alias("name"))
    bare = known.join(known.select(*scope, F.col("key").alias("entity")), [*scope, "entity"], "left_anti").select(*scope, F.lit("undeclared").alias("problem"), F.col("entity").alias("name"))
    out = blank.unionByName(double).unionByName(bare)
    if records is not None:
        said = records.select(*scope, name_key(speaker).alias("key")).where("key IS NOT NULL").distinct()
        out = out.unionByName(said.join(known.select(*scope, F.col("entity").alias("key")), [*scope, "key"], "left_anti").select(*scope, F.lit("unknown speaker").alias("problem"), F.col("key").alias("name")))
    return out.distinct()


def checked_names(aliases: DataFrame, records: DataFrame | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """``names``, or an error if the table has problems."""
    found = problems(aliases, records, scope).limit(5).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.name!r}" for r in found))
    return names(aliases, scope)


_LETTER = r"[\p{L}\p{N}_]"


def patterns(known: DataFrame, scope: Sequence[str]) -> DataFrame:
    """(scope, pattern): one regular expression with all names of a scope, longest first, at word borders only."""
    keys = F.sort_array(F.collect_set(F.struct((-F.length("key")).alias("l"), "key")))
    quoted = F.transform(keys, lambda k: F.concat(F.lit("\\Q"), F.replace(k["key"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return known.groupBy(*scope).agg(F.concat(F.lit(rf"(?<!{_LETTER})("), F.array_join(quoted, "|"), F.lit(rf")(?!{_LETTER})")).alias("pattern"))


def matches(texts: DataFrame, known: DataFrame, scope: Sequence[str], keep: Sequence[str], text: str) -> DataFrame:
    """(scope, keep, key): names found in the text from the left, longest first, without overlaps."""
    found = texts.join(patterns(known, scope), list(scope)).withColumn("_t", F.lower(text))
    return found.select(*scope, *keep, F.explode(F.array_distinct(F.regexp_extract_all("_t", F.col("pattern"), F.lit(1)))).alias("key"))


def links(records: DataFrame, known: DataFrame, scope: Sequence[str] = ("corpus",), body: str = "body", speaker: str = "speaker") -> DataFrame:
    """(scope, entity, role, id): authored_by from the speaker, mentions from names in the body."""
    wrote = records.select(*scope, "id", name_key(speaker).alias("key")).join(known, [*scope, "key"]).select(*scope, "entity", F.lit("authored_by").alias("role"), "id")
    said = matches(records, known, scope, ["id"], body).join(known, [*scope, "key"]).select(*scope, "entity", F.lit("mentions").alias("role"), "id")
    return wrote.unionByName(said).distinct()


def out_of_step(docs: DataFrame, body_docs: DataFrame, scope: Sequence[str] = ("corpus",)) -> DataFrame:
    """Records that only one of the two indexes has: none if they are in step."""
    key = [*scope, "id"]
    left, right = docs.select(*key), body_docs.select(*key)
    return left.join(right, key, "left_anti").unionByName(right.join(left, key, "left_anti"))


def route(queries: DataFrame, known: DataFrame, roles: DataFrame, scope: Sequence[str] = ("corpus",)) -> DataFrame:
    """``queries`` with mode, entity, topic_query, candidate_count and entities, the list of all that it names.

    A query that names exactly one entity which has candidates is gated, the
    names cut out of its topic_query; all others take the plain way.
    """
    hit = matches(queries, known, scope, ["query_id"], "query").join(known, [*scope, "key"])
    single = hit.groupBy("query_id").agg(F.min("entity").alias("entity"), F.array_sort(F.collect_set("entity")).alias("entities"))
    sizes = roles.groupBy(*scope, "entity").agg(F.countDistinct("id").alias("candidate_count"))
    out = queries.join(single, "query_id", "left").join(sizes, [*scope, "entity"], "left").join(patterns(known, scope), list(scope), "left")
    gated = (F.coalesce(F.size("entities"), F.lit(0)) == 1) & F.coalesce(F.col("candidate_count") > 0, F.lit(False))
    topic = F.when(gated, F.trim(F.regexp_replace("query", F.concat(F.lit("(?i)"), F.col("pattern")), F.lit(" ")))).otherwise(F.col("query"))
    return out.select(
        *queries.columns,
        F.when(gated, "entity").otherwise("adjacency").alias("mode"),
        F.when(gated, F.col("entity")).alias("entity"),
        topic.alias("topic_query"),
        F.when(gated, F.col("candidate_count")).otherwise(F.lit(0)).alias("candidate_count"),
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities"),
    )


def _inside_scores(inside: DataFrame, lexical: DataFrame, association: DataFrame | None, p: SearchParams, key: Sequence[str]) -> DataFrame:
    """Candidates with their score: both parts divided by their maximum among the candidates of the query."""
    scored = inside.join(lexical, [*key, "id"], "left")
    scored = scored.join(association, [*key, "id"], "left") if association is not None else scored.withColumn("association", F.lit(0.0))
    top = Window.partitionBy(*key)
    share = lambda name: F.coalesce(name, F.lit(0.0)) / F.greatest(F.max(F.coalesce(name, F.lit(0.0))).over(top), F.lit(1e-12))
    return scored.withColumn("score", F.round(share("lexical") + F.lit(float(p.graph_weight)) * share("association"), FUSED_DIGITS))


def entity_search(routed: DataFrame, docs: DataFrame, body_docs: DataFrame, trans: DataFrame | None, roles: DataFrame, p: SearchParams = SearchParams(), scope: Sequence[str] = ("corpus",)) -> DataFrame:
    """(query_id, scope, id, score, rank, mode, link_types).

    Gated queries rank the entity's records only: BM25 of the topic over the
    bodies, and the activation of the original query, each divided by its
    maximum among the candidates; records without a score are eligible.  The
    others are the plain search.  Without ``trans`` the graph adds nothing.
    """
    key = ["query_id", *scope]
    routed = written(routed, "routed")
    gated = routed.where("mode = 'entity'")
    c: Components = components(routed, docs, trans, p, scope)
    plain = fused(routed, docs, c, p, scope).join(routed.where("mode <> 'entity'").select(*key), key, "left_semi").select(*key, "id", "score", "rank", F.lit("adjacency").alias("mode"))
    topic = bm25(gated.select(*key, F.col("topic_query").alias("query")), body_docs, scope)
    # One row for each candidate, with the roles that make it one.
    inside = gated.select(*key, "entity").join(roles, [*scope, "entity"]).groupBy(*key, "id").agg(F.sort_array(F.collect_set("role")).alias("link_types"))
    best = stable_topk(_inside_scores(inside, topic, c.association, p, key), key, "score", p.budget).select(*key, "id", "score", "rank", F.lit("entity").alias("mode"), "link_types")
    return best.unionByName(plain.withColumn("link_types", F.array().cast("array<string>")))


def ablation_arms(routed: DataFrame, docs: DataFrame, body_docs: DataFrame, trans: DataFrame, roles: DataFrame, p: SearchParams = SearchParams(), scope: Sequence[str] = ("corpus",)) -> DataFrame:
    """(arm, query_id, scope, id, rank) of the gated queries in seven arms.

    adjacency: the plain search; adjacency_stripped_query: the same with the
    topic as query; strip_lexical_keep_original_seeds: lexical scores of the
    topic, activation of the original query.  body_original and body_stripped
    score the bodies by the original query or the topic, gated or ungated, with
    the activation of the original query.
    """
    key = ["query_id", *scope]
    gated = written(routed.where("mode = 'entity'"), "gated")
    topics = gated.select(*key, F.col("topic_query").alias("query"))
    whole, stripped = components(gated.select(*key, "query"), docs, trans, p, scope), components(topics, docs, trans, p, scope)
    bodies = {"original": bm25(gated.select(*key, "query"), body_docs, scope), "stripped": bm25(topics, body_docs, scope)}
    over = lambda lexical: Components(lexical, whole.seeds, whole.activation, whole.association)
    arms = {"adjacency": whole, "adjacency_stripped_query": stripped, "strip_lexical_keep_original_seeds": over(stripped.lexical)}
    arms |= {f"body_{name}_ungated": over(lexical) for name, lexical in bodies.items()}
    out = None
    for arm, c in arms.items():
        part = fused(gated.select(*key, "query"), docs, c, p, scope).select(F.lit(arm).alias("arm"), *key, "id", "rank")
        out = part if out is None else out.unionByName(part)
    inside = gated.select(*key, "entity").join(roles.select(*scope, "entity", "id").distinct(), [*scope, "entity"]).select(*key, "id")
    for name, lexical in bodies.items():
        best = stable_topk(_inside_scores(inside, lexical, whole.association, p, key), key, "score", p.budget)
        out = out.unionByName(best.select(F.lit(f"body_{name}_gated").alias("arm"), *key, "id", "rank"))
    return out
