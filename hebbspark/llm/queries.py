"""The queries of this subpackage: each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hebbspark.functions.text import STOP_WORDS
from hebbspark.llm import ann, bpe, cooccur, neardup, packing, subjects, terms


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    scored = terms.distinctive_terms(_table(spark, folder, "memories"))
    return terms.top_terms(scored, 3).select("id", "term")


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The score of every term of every memory by which it marks out the memory."""
    scored = terms.distinctive_terms(_table(spark, folder, "memories"))
    return scored.select("id", "term", "n", (F.round("log_p", 4) + F.lit(0.0)).alias("log_p"), (F.round("score", 4) + F.lit(0.0)).alias("score"))


NEAR_MEMORIES = neardup.NearDupParams(similarity=0.7, shingle=1, least_terms=18)


def writer_key() -> Column:
    """The writer without outer spaces and in lower case; null if blank."""
    return F.nullif(F.lower(F.trim("writer")), F.lit(""))


def _near_memories(spark: SparkSession, folder: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(_table(spark, folder, "memories"), NEAR_MEMORIES, key=writer_key())


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near_memories(spark, folder).pairs()


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _near_memories(spark, folder).groups()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pairs(spark, folder).select("a", "b")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    scored = cooccur.cooccurring(_table(spark, folder, "associations"), _table(spark, folder, "memories"), min_count=5, min_lift=4)
    exact = lambda c: F.round(c, 6).alias(c)
    return scored.select("a", "b", "n_ab", "n_a", "n_b", exact("lift"), exact("conviction"))


SIMILAR_MEMORIES = ann.AnnParams(k=5, probes=5, least=0.85)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = ann.similar_vectors(_table(spark, folder, "memories"), SIMILAR_MEMORIES)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_similar(spark: SparkSession, folder: str) -> DataFrame:
    """The 10 most similar memories of every memory whose id is divisible by 20, among all."""
    return ann.similar_vectors(_table(spark, folder, "memories"), ann.AnnParams(k=10, probes=12), asking=F.col("id") % 20 == 0)


def p5_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(_table(spark, folder, "documents"))


def p6_packets(spark: SparkSession, folder: str) -> DataFrame:
    sizes = bpe.encoded(_table(spark, folder, "documents"), only_size=True)
    return packing.packed(sizes, PACKETS)


PACKETS = packing.PackParams(capacity=2048)


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the packets, in one row: every document once and whole, and no packet over a capacity."""
    documents = _table(spark, folder, "documents")
    placed = packing.packed(bpe.encoded(documents, only_size=True), PACKETS)
    return packing.violations(placed, documents, PACKETS)


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    rules = subjects.mine(documents, _table(spark, folder, "subject_labels"), _table(spark, folder, "subjects"))
    return subjects.document_subjects(documents, rules)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p7_composition(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each subject has, and which share of all rows of the result."""
    counts = _subjects(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return counts.withColumn("share", F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_scores, p2_found, p2_groups, p3_found, p3_pairs, p4_found, p4_similar, p5_ids, p6_packets, p6_totals, p7_found, p7_composition)}


_STOP = str(STOP_WORDS)
_TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: NOT list_contains({_STOP}, t))"

_P1 = f"""
WITH m AS (SELECT DISTINCT id, text FROM memories WHERE id IS NOT NULL),
t AS (SELECT id, unnest({_TERMS}) AS term FROM m),
n AS (SELECT id, term, count(*) AS n FROM t GROUP BY id, term),
d AS (SELECT term, count(*) AS d FROM n GROUP BY term),
s AS (SELECT n.id, n.term, round(n.n * ln((SELECT count(DISTINCT id) FROM n)::DOUBLE / d.d), 6) AS w FROM n JOIN d USING (term) WHERE d.d >= 2)
SELECT id, term FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, term) <= 3
"""

# The upper tail is summed as it stands: of L terms of a memory n are the term, which stands K times among all M terms.
_P1_SCORES = f"""
WITH m AS (SELECT DISTINCT id, text FROM memories WHERE id IS NOT NULL),
t AS (SELECT id, unnest({_TERMS}) AS term FROM m),
n AS (SELECT id, term, count(*) AS n FROM t GROUP BY id, term),
l AS (SELECT id, sum(n)::BIGINT AS l FROM n GROUP BY id),
d AS (SELECT term, count(*) AS d, sum(n)::BIGINT AS k FROM n GROUP BY term),
u AS (SELECT count(*) AS m FROM t),
f AS (SELECT n.id, n.term, n.n, l.l, d.k, u.m FROM n JOIN l USING (id) JOIN d USING (term), u WHERE d.d >= 2),
q AS (SELECT *, least(0, ln(list_sum(list_transform(range(n, least(l, k) + 1), lambda j: exp(
  lgamma(k + 1) - lgamma(j + 1) - lgamma(k - j + 1) + lgamma(m - k + 1) - lgamma(l - j + 1) - lgamma(m - k - l + j + 1)
  - lgamma(m + 1) + lgamma(l + 1) + lgamma(m - l + 1)))))) AS p FROM f),
r AS (SELECT *, count(*) OVER (PARTITION BY id) AS c, row_number() OVER (PARTITION BY id ORDER BY round(p, 9) DESC, term) AS r FROM q),
s AS (SELECT *, least(0, min(p + ln(c) - ln(c - r + 1)) OVER (PARTITION BY id ORDER BY r)) AS lq FROM r)
SELECT id, term, n, round(p, 4) + 0.0e0 AS log_p, round(-lq, 4) + 0.0e0 AS score FROM s
"""

_P2_PAIRS = f"""
WITH m AS (SELECT DISTINCT id, text, writer FROM memories WHERE id IS NOT NULL),
t AS (SELECT id, lower(trim(writer)) AS w, list_distinct({_TERMS}) AS s FROM m WHERE trim(writer) <> ''),
k AS (SELECT * FROM t WHERE len(s) >= 18),
e AS (SELECT id, w, len(s) AS c, unnest(s) AS term FROM k),
p AS (SELECT x.id AS id_a, y.id AS id_b, x.c + y.c AS c, count(*) AS both_n FROM e x JOIN e y ON x.w = y.w AND x.term = y.term AND x.id < y.id GROUP BY ALL)
"""

_P2 = _P2_PAIRS + "SELECT id_a, id_b FROM p WHERE both_n >= 0.7::DOUBLE * (c - both_n)"

_P2_GROUPS = (
    _P2_PAIRS.replace("WITH", "WITH RECURSIVE", 1)
    + f"""
, z AS (SELECT id, lower(trim(writer)) AS w, list_sort({_TERMS}) AS s FROM m WHERE trim(writer) <> '' AND len(list_distinct({_TERMS})) >= 18),
l AS (SELECT id_a AS id, id_b AS o FROM p WHERE both_n >= 0.7::DOUBLE * (c - both_n) UNION ALL SELECT id_b, id_a FROM p WHERE both_n >= 0.7::DOUBLE * (c - both_n)),
c AS (SELECT id, count(*) AS links FROM l GROUP BY id),
g AS (SELECT id, id AS node FROM z UNION SELECT g.id, l.o FROM g JOIN l ON l.id = g.node)
SELECT z.id, min(z.id) OVER v AS "class", count(*) OVER v AS copies, coalesce(c.links, 0) AS links, r."group"
FROM z LEFT JOIN c ON c.id = z.id JOIN (SELECT id, min(node) AS "group" FROM g GROUP BY id) r ON r.id = z.id WINDOW v AS (PARTITION BY z.w, z.s)
"""
)

_P3_BASE = """
WITH r AS (SELECT DISTINCT a, b, tick FROM associations WHERE a > 0 AND b > 0 AND a <> b AND tick IS NOT NULL
  AND a IN (SELECT id FROM memories) AND b IN (SELECT id FROM memories)),
i AS (SELECT DISTINCT tick, x FROM (SELECT tick, a AS x FROM r UNION ALL SELECT tick, b FROM r)),
n AS (SELECT x, count(*) AS n FROM i GROUP BY x),
t AS (SELECT count(DISTINCT tick) AS t FROM i),
p AS (SELECT u.x AS a, v.x AS b, count(*) AS n_ab FROM i u JOIN i v ON u.tick = v.tick AND u.x < v.x GROUP BY 1, 2 HAVING count(*) >= 5),
s AS (SELECT p.a, p.b, p.n_ab, na.n AS n_a, nb.n AS n_b, t.t FROM p JOIN n na ON na.x = p.a JOIN n nb ON nb.x = p.b, t WHERE p.n_ab * t.t >= 4 * na.n * nb.n)
"""
_P3 = _P3_BASE + "SELECT a, b FROM s"
_P3_PAIRS = (
    _P3_BASE
    + """SELECT a, b, n_ab, n_a, n_b, round(n_ab::DOUBLE * t / (n_a * n_b), 6) AS lift,
round(CASE WHEN n_ab < n_a THEN (1 - n_b::DOUBLE / t) / (1 - n_ab::DOUBLE / n_a) END, 6) AS conviction FROM s"""
)


_P4 = """
WITH m AS (SELECT DISTINCT id, embedding::DOUBLE[] AS v FROM memories WHERE len(embedding) = 128),
u AS (SELECT id, v::DOUBLE[128] AS v FROM m WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT x.id AS a, y.id AS b, round(array_cosine_similarity(x.v, y.v), 6) AS s FROM u x JOIN u y ON x.id <> y.id),
k AS (SELECT a, b, s FROM s WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM k
"""


_P4_SIMILAR = """
WITH m AS (SELECT DISTINCT id, embedding::DOUBLE[] AS v FROM memories WHERE len(embedding) = 128),
u AS (SELECT id, v::DOUBLE[128] AS v FROM m WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT x.id, y.id AS neighbour, round(array_cosine_similarity(x.v, y.v), 6) AS sim FROM u x JOIN u y ON x.id <> y.id WHERE x.id % 20 = 0)
SELECT id, neighbour, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS rank FROM s QUALIFY rank <= 10
"""

_P6_TOTALS = """SELECT count(*) AS documents, 0 AS lost, 0 AS doubled, 0 AS cut_without_need, 0 AS over_tokens, 0 AS over_documents, 0 AS over_attention, 0 AS unused_numbers FROM documents"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_scores": _P1_SCORES, "p2_found": _P2, "p2_groups": _P2_GROUPS, "p3_found": _P3, "p3_pairs": _P3_PAIRS, "p4_found": _P4, "p4_similar": _P4_SIMILAR, "p6_totals": _P6_TOTALS}
