"""The catalogue's queries in DuckDB's SQL, for comparison."""

from __future__ import annotations

import re

from hebbspark.functions.text import STOP_WORDS

NOW = 32
# The graph weights among which the development conversations choose.
WEIGHTS = (0.0, 0.05, 0.1, 0.2, 0.4)
LOG_NOW = "(SELECT max(tick) FROM associations WHERE id IS NOT NULL)"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms(column: str) -> str:
    return f"coalesce(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda t: NOT list_contains([{_STOP}], t)), [])"


def chain(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


TURNS = """tu AS MATERIALIZED (SELECT sample_id AS corpus, row_number() OVER (PARTITION BY sample_id ORDER BY session_no, turn_no, dia_id) AS id, session_no::BIGINT AS tick,
 dia_id, speaker, coalesce(text, '') AS body,
 coalesce('[' || session_date_time || '] ', '') || coalesce(speaker || ': ', '') || coalesce(text, '') || coalesce(' [Image caption: ' || blip_caption || ']', '') AS content
 FROM (SELECT DISTINCT * FROM dialogue_turns WHERE sample_id IS NOT NULL AND dia_id IS NOT NULL))"""
QUESTIONS = """qu AS MATERIALIZED (SELECT question_id AS query_id, sample_id AS corpus, coalesce(question, '') AS query, answer, evidence, category FROM dialogue_questions WHERE question_id IS NOT NULL AND sample_id IS NOT NULL)"""
_PART = "ln(1 + (s.n - f.df + 0.5e0) / (f.df + 0.5e0)) * p.tf * 2.2e0 / (p.tf + 1.2e0 * (0.25e0 + 0.75e0 * p.len / s.av))"


def index(d: str = "d", source: str = "tu", text: str = "content") -> str:
    """Documents, postings, document frequencies and collection statistics, names prefixed by d."""
    return f"""{d}oc AS MATERIALIZED (SELECT corpus, id, {terms(text)} AS ts FROM {source}),
{d}po AS MATERIALIZED (SELECT corpus, id, len, term, count(*) AS tf FROM (SELECT corpus, id, len(ts) AS len, unnest(ts) AS term FROM {d}oc) GROUP BY ALL),
{d}df AS MATERIALIZED (SELECT corpus, term, count(*) AS df FROM {d}po GROUP BY ALL),
{d}st AS MATERIALIZED (SELECT corpus, count(*) AS n, greatest(sum(len(ts)) / count(*), 1.0e0) AS av FROM {d}oc GROUP BY corpus)"""


def lexical(name: str = "lx", d: str = "d", source: str = "qu", text: str = "query") -> str:
    return f"""{name} AS MATERIALIZED (SELECT q.query_id, q.corpus, p.id, round(sum({_PART}), 9) AS lexical
 FROM (SELECT query_id, corpus, unnest(list_distinct({terms(text)})) AS term FROM {source}) q
 JOIN {d}po p ON p.corpus = q.corpus AND p.term = q.term JOIN {d}df f ON f.corpus = q.corpus AND f.term = q.term JOIN {d}st s ON s.corpus = q.corpus
 GROUP BY q.query_id, q.corpus, p.id HAVING round(sum({_PART}), 9) > 0)"""


PREFIX = f"""px AS MATERIALIZED (SELECT corpus, id, other, round(sum({_PART}), 9) AS lexical FROM (
 SELECT a.corpus, a.id, b.id AS other, a.term, a.df, b.tf, b.len FROM (SELECT *, row_number() OVER (PARTITION BY corpus, term ORDER BY id) - 1 AS df FROM dpo) a JOIN dpo b ON a.corpus = b.corpus AND a.term = b.term AND b.id < a.id) p
 JOIN (SELECT corpus AS c2, id AS i2, n, greatest(total / n, 1.0e0) AS av FROM (SELECT corpus, id, count(*) OVER w AS n, coalesce(sum(len(ts)) OVER w, 0) AS total FROM doc WINDOW w AS (PARTITION BY corpus ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n > 0) s ON s.c2 = p.corpus AND s.i2 = p.id,
 LATERAL (SELECT p.df) f GROUP BY corpus, id, other HAVING round(sum({_PART}), 9) > 0),
p3 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY corpus, id ORDER BY lexical DESC, other) AS rank FROM px QUALIFY rank <= 3)"""

ADJACENT = """ea AS MATERIALIZED (SELECT corpus, id AS seq, least(id, p) AS a, greatest(id, p) AS b, tick FROM (SELECT corpus, id, tick, lag(id) OVER (PARTITION BY corpus, tick ORDER BY id) AS p FROM tu) WHERE p IS NOT NULL)"""
STAR = """es AS MATERIALIZED (SELECT * FROM ea UNION SELECT t.corpus, t.id, least(t.id, p.other), greatest(t.id, p.other), t.tick FROM p3 p JOIN tu t ON t.corpus = p.corpus AND t.id = p.id)"""
COMBINED = """en AS MATERIALIZED (SELECT DISTINCT corpus, seq, tick, unnest([a, b]) AS node FROM es),
ec AS (SELECT x.corpus, x.seq, x.node AS a, y.node AS b, x.tick FROM en x JOIN en y ON x.corpus = y.corpus AND x.seq = y.seq AND x.tick = y.tick AND x.node < y.node)"""


def fold(name: str, events: str, scope: str = "", lam: float = 0.05) -> str:
    """(scope, a, b, weight, last_tick, events) of canonical events (scope, seq, a, b, tick)."""
    s = f"{scope}, " if scope else ""
    return f"""{name} AS MATERIALIZED (SELECT {s}a, b, sum(pow({1 - lam}e0, last - e)) AS weight, max(last)::BIGINT AS last_tick, count(*) AS events FROM (
 SELECT *, max(e) OVER (PARTITION BY {s}a, b) AS last FROM (SELECT *, max(tick) OVER (PARTITION BY {s}a, b ORDER BY seq, tick ROWS UNBOUNDED PRECEDING) AS e FROM {events})) GROUP BY {s}a, b)"""


def read(now: int | str) -> str:
    return f"weight * pow(0.95e0, greatest({now} - last_tick, 0))"


def spread(edges: str, scope: str = "corpus", now: int = NOW, decay: bool = True) -> str:
    """Transition shares tr from folded edges, those alive at the tick."""
    s = f"{scope}, " if scope else ""
    value = read(now) if decay else "weight"
    return f"""al AS MATERIALIZED (SELECT {s}a, b, {value} AS now FROM {edges} WHERE {value} >= 0.001e0),
ad AS MATERIALIZED (SELECT {s}a AS src, b AS dst, now FROM al UNION ALL SELECT {s}b, a, now FROM al),
tr AS MATERIALIZED (SELECT {s}src, dst, now / sum(now) OVER (PARTITION BY {s}src) AS share FROM ad)"""


_TRANSITIONS = """ad AS MATERIALIZED (SELECT corpus, a AS src, b AS dst, now FROM al UNION ALL SELECT corpus, b, a, now FROM al),
tr AS MATERIALIZED (SELECT corpus, src, dst, now / sum(now) OVER (PARTITION BY corpus, src) AS share FROM ad)"""
_GRAPH_NAMES = "ed al ad tr sd vs a1 f1 a2 f2 ac an"


SEEDS = """sd AS MATERIALIZED (SELECT query_id, corpus, id AS node, lexical / sum(lexical) OVER (PARTITION BY query_id, corpus) AS weight FROM (SELECT * FROM lx QUALIFY row_number() OVER (PARTITION BY query_id, corpus ORDER BY lexical DESC, id) <= 8)),
vs AS MATERIALIZED (SELECT s.query_id, s.corpus, s.node, s.weight AS score FROM sd s JOIN (SELECT corpus, max(src) AS top FROM tr GROUP BY corpus) t ON t.corpus = s.corpus WHERE s.node <= t.top)"""


def hops(n: int = 2, cutoff: str = "0.001e0") -> str:
    """Arcs a1 .. an, fronts f1 .. fn and the summed scores ac."""
    parts, front = [], "vs"
    for h in range(1, n + 1):
        parts.append(f"a{h} AS MATERIALIZED (SELECT f.query_id, f.corpus, {h} AS hop, t.src, t.dst, f.score * t.share AS contribution FROM {front} f JOIN tr t ON t.corpus = f.corpus AND t.src = f.node WHERE f.score * t.share >= {cutoff})")
        parts.append(f"f{h} AS MATERIALIZED (SELECT query_id, corpus, dst AS node, sum(contribution) AS score FROM a{h} GROUP BY ALL)")
        front = f"f{h}"
    union = " UNION ALL ".join(["SELECT * FROM vs", *(f"SELECT * FROM f{h}" for h in range(1, n + 1))])
    parts.append(f"ac AS MATERIALIZED (SELECT query_id, corpus, node, round(sum(score), 12) AS score FROM ({union}) GROUP BY ALL)")
    return ",\n".join(parts)


ASSOCIATION = """an AS MATERIALIZED (SELECT c.query_id, c.corpus, c.node AS id, greatest(c.score - coalesce(v.score, 0), 0) AS association FROM ac c LEFT JOIN vs v ON v.query_id = c.query_id AND v.corpus = c.corpus AND v.node = c.node WHERE c.score >= 0.001e0)"""
NO_ASSOCIATION = "an AS (SELECT query_id, corpus, 0::BIGINT AS id, 0.0e0 AS association FROM qu WHERE false)"


def fuse(name: str = "hi", weight: str = "0.4e0", budget: int = 16, an: str = "an") -> str:
    top = "OVER (PARTITION BY query_id, corpus)"
    return f"""{name} AS MATERIALIZED (SELECT query_id, corpus, id, lexical, association, score, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY score DESC, id) AS rank FROM (
  SELECT *, round(lexical / greatest(max(lexical) {top}, 1e-12) + {weight} * (association / greatest(max(association) {top}, 1e-12)), 9) AS score FROM (
   SELECT query_id, corpus, id, sum(lexical) AS lexical, sum(association) AS association FROM (
    SELECT query_id, corpus, id, lexical, 0.0e0 AS association FROM lx UNION ALL SELECT query_id, corpus, id, 0.0e0, association FROM {an}
    UNION ALL SELECT q.query_id, q.corpus, t.id, 0.0e0, 0.0e0 FROM qu q JOIN tu t ON t.corpus = q.corpus) GROUP BY query_id, corpus, id))) WHERE rank <= {budget})"""


def renamed(text: str, names: str, prefix: str = "x_") -> str:
    """The same tables under other names, for a second graph in one query."""
    return re.sub(r"\b(" + "|".join(names.split()) + r")\b(?=\W)", lambda m: prefix + m[1], text)


LEXICAL = [TURNS, QUESTIONS, index(), lexical()]
GRAPH = [ADJACENT, fold("ed", "ea", "corpus"), spread("ed")]
ACTIVATION = [*LEXICAL, *GRAPH, SEEDS, hops()]
SEARCH = [*ACTIVATION, ASSOCIATION, fuse()]
PLAIN = [*LEXICAL, NO_ASSOCIATION, fuse("hp", "0.0e0")]
BOTH = [*ACTIVATION, ASSOCIATION, fuse(), "az AS (SELECT * FROM an WHERE false)", fuse("hp", "0.0e0", an="az")]

def _other(prefix: str, events: str) -> str:
    """The association over the graph of other events, as a table named an behind the prefix."""
    return renamed(",\n".join([fold("ed", events, "corpus"), spread("ed"), SEEDS, hops(), ASSOCIATION]), _GRAPH_NAMES, prefix)


HIT_COLUMNS = "query_id, corpus, id, round(lexical, 6) AS lexical, round(association, 6) AS association, round(score, 6) AS score, rank"

LOG = "lo AS MATERIALIZED (SELECT DISTINCT id AS seq, least(a, b) AS a, greatest(a, b) AS b, tick FROM associations WHERE id IS NOT NULL AND a > 0 AND b > 0 AND a <> b AND tick IS NOT NULL)"
LOG_EDGES = [LOG, fold("ed", "lo")]
RECORDS = "re AS MATERIALIZED (SELECT DISTINCT id, text AS content, writer, tick FROM memories WHERE id IS NOT NULL)"
SIZED = f"{RECORDS}, sz AS (SELECT id, tick, coalesce(octet_length(encode(content)), 0) + coalesce(octet_length(encode(writer)), 0) AS bytes FROM re)"
BASKETS = "ba AS MATERIALIZED (SELECT DISTINCT l_orderkey AS basket, l_partkey + 1 AS node, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS tick FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
BASKET_PAIRS = f"{BASKETS}, bp AS (SELECT x.basket AS seq, x.node AS a, y.node AS b, x.tick FROM ba x JOIN ba y ON x.basket = y.basket AND x.node < y.node)"
_ALIVE = f"{read(LOG_NOW)} >= 0.001e0"

GOLD = r"go AS MATERIALIZED (SELECT query_id, corpus, category, list_sort(list_distinct(coalesce(regexp_extract_all(array_to_string(evidence, ' '), 'D\d+:\d+'), []))) AS gold FROM qu)"
GOLD_TURNS = "gt AS MATERIALIZED (SELECT g.query_id, g.corpus, t.id FROM (SELECT query_id, corpus, unnest(gold) AS dia_id FROM go) g JOIN tu t ON t.corpus = g.corpus AND t.dia_id = g.dia_id)"


def _arm(name: str, hits: str) -> str:
    return f"""SELECT '{name}' AS arm, g.query_id, g.corpus, g.category, CASE WHEN len(gold) > 0 THEN round(h / len(gold), 9) END AS recall,
 CASE WHEN len(gold) > 0 THEN h > 0 END AS any_found, CASE WHEN len(gold) > 0 THEN h = len(gold) END AS all_found
 FROM (SELECT *, len(list_intersect(coalesce((SELECT list(t.dia_id) FROM {hits} x JOIN tu t ON t.corpus = x.corpus AND t.id = x.id WHERE x.query_id = go.query_id), []), gold)) AS h FROM go) g"""


ARMS = [*BOTH, GOLD, f"ar AS MATERIALIZED ({_arm('lexical', 'hp')} UNION ALL {_arm('associative', 'hi')})"]
PAIRS = [
    *ARMS,
    """pr AS MATERIALIZED (SELECT query_id, corpus, category, x.recall AS associative, y.recall AS lexical, x.any_found AS xa, y.any_found AS ya
 FROM (SELECT * FROM ar WHERE arm = 'associative' AND recall IS NOT NULL) x JOIN (SELECT * FROM ar WHERE arm = 'lexical' AND recall IS NOT NULL) y USING (query_id, corpus, category))""",
    """oc AS MATERIALIZED (SELECT category, count(*) AS cases, count(*) FILTER (associative - lexical > 1e-12) AS wins, count(*) FILTER (abs(associative - lexical) <= 1e-12) AS ties,
 count(*) FILTER (associative - lexical < -1e-12) AS losses, round(avg(associative - lexical), 6) AS mean_delta, round(quantile_cont(associative - lexical, 0.25), 6) AS q25,
 round(quantile_cont(associative - lexical, 0.5), 6) AS q50, round(quantile_cont(associative - lexical, 0.75), 6) AS q75 FROM pr GROUP BY category)""",
    """sg AS MATERIALIZED (SELECT category, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1.0e0, 2 * list_sum(list_transform(range(least(wins, losses) + 1),
 lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2.0e0))))) END, 6) AS p FROM oc)""",
]

_UNION = f"""SELECT query_id, corpus, id, lexical, 0.0e0 AS association FROM lx UNION ALL SELECT query_id, corpus, id, 0.0e0, association FROM an
    UNION ALL SELECT q.query_id, q.corpus, t.id, 0.0e0, 0.0e0 FROM qu q JOIN tu t ON t.corpus = q.corpus"""
WEIGHTED = [
    *ACTIVATION,
    ASSOCIATION,
    GOLD,
    f"""sh AS MATERIALIZED (SELECT query_id, corpus, id, lexical / greatest(max(lexical) OVER q, 1e-12) AS ls, association / greatest(max(association) OVER q, 1e-12) AS sa
 FROM (SELECT query_id, corpus, id, sum(lexical) AS lexical, sum(association) AS association FROM ({_UNION}) GROUP BY ALL) WINDOW q AS (PARTITION BY query_id, corpus))""",
    f"wt AS (SELECT unnest([{', '.join(f'{w}e0' for w in WEIGHTS)}]) AS w)",
    "wh AS MATERIALIZED (SELECT * FROM (SELECT w, query_id, corpus, id, row_number() OVER (PARTITION BY w, query_id, corpus ORDER BY round(ls + w * sa, 9) DESC, id) AS rank FROM sh, wt) WHERE rank <= 16)",
    "wf AS (SELECT h.w, h.query_id, list(t.dia_id) AS found FROM wh h JOIN tu t ON t.corpus = h.corpus AND t.id = h.id GROUP BY ALL)",
    "wr AS MATERIALIZED (SELECT w.w, g.query_id, g.corpus, round(len(list_intersect(coalesce(f.found, []), gold)) / len(gold), 9) AS recall FROM go g CROSS JOIN wt w LEFT JOIN wf f ON f.w = w.w AND f.query_id = g.query_id WHERE len(gold) > 0)",
]


def drawn(seed: int, *parts: str) -> str:
    return "('0x' || substr(md5('" + str(seed) + "'" + "".join(f" || ':' || {p}" for p in parts) + "), 1, 15))::BIGINT"


def answer_words(column: str) -> str:
    marks = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    return f"list_filter(string_split_regex(trim(translate(lower(coalesce({column}, '')), '{marks}', '')), '\\s+'), lambda w: w <> '' AND NOT list_contains(['a', 'an', 'the', 'and'], w))"


def answer_scores(category: bool) -> str:
    """f1 of the best hit's body against the answer, on words."""
    many, head = ("category = 1", "CASE WHEN category = 3 THEN string_split(coalesce(gold, ''), ';')[1] ELSE coalesce(gold, '') END") if category else ("false", "coalesce(gold, '')")
    return chain(
        *SEARCH,
        "an2 AS (SELECT q.query_id, q.answer AS gold, q.category, t.body AS predicted FROM qu q JOIN hi h ON h.query_id = q.query_id AND h.rank = 1 JOIN tu t ON t.corpus = h.corpus AND t.id = h.id)",
        f"pa AS (SELECT query_id, CASE WHEN {many} THEN string_split(predicted, ',') ELSE [predicted] END AS ps, CASE WHEN {many} THEN string_split(coalesce(gold, ''), ',') ELSE [{head}] END AS gs FROM an2)",
        f"gp AS MATERIALIZED (SELECT query_id, g, {answer_words('t')} AS ws FROM (SELECT query_id, unnest(range(len(gs))) AS g, unnest(gs) AS t FROM pa))",
        f"pp AS MATERIALIZED (SELECT query_id, p, {answer_words('t')} AS ws FROM (SELECT query_id, unnest(range(len(ps))) AS p, unnest(ps) AS t FROM pa))",
        "gw AS (SELECT query_id, g, w, count(*) AS c FROM (SELECT query_id, g, unnest(ws) AS w FROM gp) GROUP BY ALL)",
        "pw AS (SELECT query_id, p, w, count(*) AS c FROM (SELECT query_id, p, unnest(ws) AS w FROM pp) GROUP BY ALL)",
        "sw AS MATERIALIZED (SELECT x.query_id, g, p, sum(least(x.c, y.c)) AS s FROM gw x JOIN pw y ON x.query_id = y.query_id AND x.w = y.w GROUP BY ALL)",
        "bs AS (SELECT x.query_id, x.g, max(coalesce(2.0e0 * s.s / (len(x.ws) + len(y.ws)), 0.0e0)) AS f FROM gp x JOIN pp y ON y.query_id = x.query_id LEFT JOIN sw s ON s.query_id = x.query_id AND s.g = x.g AND s.p = y.p GROUP BY x.query_id, x.g)",
        final="SELECT query_id, round(avg(f), 6) AS f1 FROM bs GROUP BY query_id",
    )


def permuted(nodes: str, scope: str = "", seed: int = 11) -> str:
    """pm: (scope, node, target), the n-th node by digest takes the place of the n-th by id."""
    part = f"PARTITION BY {scope} " if scope else ""
    s, same = (f"{scope}, ", f"x.{scope} = y.{scope} AND ") if scope else ("", "")
    head = f"x.{scope}, " if scope else ""
    return f"""pn AS MATERIALIZED (SELECT DISTINCT {s}unnest([a, b]) AS node FROM {nodes}),
pr2 AS MATERIALIZED (SELECT *, row_number() OVER ({part}ORDER BY node) AS i, row_number() OVER ({part}ORDER BY md5('{seed}:' || node), node) AS j FROM pn),
pm AS MATERIALIZED (SELECT {head}x.node, y.node AS target FROM pr2 x JOIN pr2 y ON {same}x.j = y.i)"""


NAMES = "na AS MATERIALIZED (SELECT DISTINCT corpus, lower(trim(speaker)) AS key FROM tu WHERE trim(speaker) <> '')"
LINKS = r"""li AS MATERIALIZED (SELECT t.corpus, n.key AS entity, 'authored_by' AS role, t.id FROM tu t JOIN na n ON n.corpus = t.corpus AND n.key = lower(trim(t.speaker))
 UNION SELECT t.corpus, n.key, 'mentions', t.id FROM (SELECT corpus, id, unnest(list_distinct(regexp_extract_all(lower(body), '[\p{L}\p{N}_]+'))) AS w FROM tu) t JOIN na n ON n.corpus = t.corpus AND n.key = t.w)"""
ROUTE = r"""qm AS MATERIALIZED (SELECT q.query_id, min(n.key) AS entity, count(DISTINCT n.key) AS k, string_agg(DISTINCT n.key, ',' ORDER BY n.key) AS entities FROM (SELECT query_id, corpus, unnest(list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+'))) AS w FROM qu) q JOIN na n ON n.corpus = q.corpus AND n.key = q.w GROUP BY q.query_id),
ro AS MATERIALIZED (SELECT q.*, m.entities, CASE WHEN m.k = 1 AND s.c > 0 THEN m.entity END AS entity, CASE WHEN m.k = 1 AND s.c > 0 THEN s.c ELSE 0 END AS candidate_count FROM qu q LEFT JOIN qm m ON m.query_id = q.query_id
 LEFT JOIN (SELECT corpus, entity, count(DISTINCT id) AS c FROM li GROUP BY ALL) s ON s.corpus = q.corpus AND s.entity = m.entity)"""

TOPICS = "tq AS (SELECT query_id, corpus, array_to_string(list_filter(regexp_extract_all(lower(query), '[a-z0-9]+|[^a-z0-9]+'), lambda w: w <> entity), ' ') AS query FROM ro WHERE entity IS NOT NULL)"
CANDIDATES = "ca AS MATERIALIZED (SELECT r.query_id, r.corpus, l.id, string_agg(DISTINCT l.role, ',' ORDER BY l.role) AS link_types FROM ro r JOIN li l ON l.corpus = r.corpus AND l.entity = r.entity GROUP BY ALL)"


def inside(name: str, lexical: str, weight: str = "0.4e0", an: str = "an") -> str:
    """The 16 best candidates of gated queries."""
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT query_id, corpus, id, link_types, score, row_number() OVER (PARTITION BY query_id, corpus ORDER BY score DESC, id) AS rank FROM (
 SELECT query_id, corpus, id, link_types, round(x / greatest(max(x) OVER q, 1e-12) + {weight} * (y / greatest(max(y) OVER q, 1e-12)), 9) AS score
 FROM (SELECT c.*, coalesce(b.lexical, 0.0e0) AS x, coalesce(a.association, 0.0e0) AS y FROM ca c LEFT JOIN {lexical} b ON b.query_id = c.query_id AND b.id = c.id LEFT JOIN {an} a ON a.query_id = c.query_id AND a.id = c.id) WINDOW q AS (PARTITION BY query_id, corpus))) WHERE rank <= 16)"""


HISTORY = f"""{RECORDS}, hs AS (SELECT id, tick, content || chr(10) || writer AS key FROM re WHERE content IS NOT NULL AND writer IS NOT NULL),
hv AS (SELECT id, tick, lead(tick) OVER (PARTITION BY key ORDER BY id) AS valid_to, lag(id) OVER (PARTITION BY key ORDER BY id) AS supersedes FROM hs UNION ALL SELECT id, tick, NULL, NULL FROM re WHERE content IS NULL OR writer IS NULL)"""

VECTORS = """ve AS MATERIALIZED (SELECT vec_id + 1 AS id, embedding::DOUBLE[] AS vec, label FROM embeddings),
nn AS MATERIALIZED (SELECT q.id AS query_id, v.id, round(list_inner_product(q.vec, v.vec), 9) AS similarity FROM ve q JOIN ve v ON q.id % 20 = 0),
la AS MATERIALIZED (SELECT least(id, p) AS a, greatest(id, p) AS b, 1.0e0 AS weight FROM (SELECT id, lag(id) OVER (PARTITION BY label ORDER BY id) AS p FROM ve) WHERE p IS NOT NULL)"""


def _near(k: int) -> str:
    return f"nk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM nn QUALIFY rank <= {k})"


def walk(hops: int = 4) -> list[str]:
    """w0 .. wn: the state of each walk after so many steps."""
    unit = lambda v: f"list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"
    parts = [
        "ad AS MATERIALIZED (SELECT DISTINCT a AS src, b AS dst FROM la UNION SELECT b, a FROM la)",
        f"w0 AS MATERIALIZED (SELECT id AS query_id, id AS node, vec, {unit('vec')} AS d, [id] AS path FROM ve WHERE id % 20 = 0 AND list_inner_product(vec, vec) > 0)",
    ]
    for h in range(1, hops + 1):
        parts.append(
            f"""m{h} AS MATERIALIZED (SELECT w.query_id, a.dst, w.d, w.path, v.vec, list_transform(list_zip(v.vec, w.vec), lambda p: p[1] - p[2]) AS step FROM w{h - 1} w JOIN ad a ON a.src = w.node JOIN ve v ON v.id = a.dst WHERE NOT list_contains(w.path, a.dst)),
b{h} AS MATERIALIZED (SELECT *, sqrt(list_inner_product(step, step)) AS norm FROM m{h} WHERE list_inner_product(step, step) > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(step, d) / sqrt(list_inner_product(step, step)), 12) DESC, dst) = 1),
t{h} AS MATERIALIZED (SELECT query_id, dst AS node, vec, list_transform(list_zip(d, list_transform(step, lambda x: x / norm)), lambda p: 0.5e0 * p[1] + 0.5e0 * p[2]) AS d, list_append(path, dst) AS path FROM b{h}),
w{h} AS MATERIALIZED (SELECT query_id, node, vec, {unit('d')} AS d, path FROM t{h} WHERE list_inner_product(d, d) > 0)"""
        )
    return parts


WINDOWS = """wu AS MATERIALIZED (SELECT DISTINCT floor(epoch(date_trunc('minute', ts)) / 600)::BIGINT AS bucket, user_id + 1 AS node FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
wp AS MATERIALIZED (SELECT x.bucket AS seq, x.node AS a, y.node AS b, floor(x.bucket * 10 / 1440)::BIGINT AS tick FROM wu x JOIN wu y ON x.bucket = y.bucket AND x.node < y.node)"""

_EDGE = "a, b, round(weight, 6) AS weight, last_tick, events"

QUERIES: dict[str, str] = {
    "tokenize_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({terms('text')}) AS term FROM documents) GROUP BY ALL",
    "corpus_stats": f"SELECT count(*) AS n, sum(len({terms('text')}))::BIGINT AS total, round(greatest(sum(len({terms('text')})) / count(*), 1.0e0), 6) AS avg FROM documents",
    "bm25_topk": chain(*LEXICAL, final="SELECT query_id, corpus, id, round(lexical, 6) AS lexical, row_number() OVER (PARTITION BY query_id, corpus ORDER BY lx.lexical DESC, id) AS rank FROM lx QUALIFY rank <= 10"),
    "prefix_bm25_top3": chain(TURNS, index(), PREFIX, final="SELECT corpus, id, other, round(lexical, 6) AS lexical, rank FROM p3"),
    "edges_adjacent": chain(TURNS, ADJACENT, final="SELECT * FROM ea"),
    "edges_star": chain(TURNS, index(), PREFIX, ADJACENT, STAR, final="SELECT * FROM es"),
    "edges_combined": chain(TURNS, index(), PREFIX, ADJACENT, STAR, COMBINED, final="SELECT * FROM ec"),
    "coactivation_pairs": chain(BASKET_PAIRS, final="SELECT a, b, count(*) AS baskets FROM bp GROUP BY a, b"),
    "edge_fold": chain(BASKET_PAIRS, fold("ed", "bp"), final=f"SELECT {_EDGE} FROM ed"),
    "edge_fold_late_ticks": chain(*LOG_EDGES, final=f"SELECT {_EDGE} FROM ed"),
    "edge_fold_live": chain(LOG, "ll AS (SELECT * FROM lo WHERE a IN (SELECT id FROM memories) AND b IN (SELECT id FROM memories))", fold("ed", "ll"), final=f"SELECT {_EDGE} FROM ed"),
    "edge_decay_at_tick": chain(*LOG_EDGES, final=f"SELECT a, b, round({read(LOG_NOW)}, 6) AS now FROM ed"),
    "edge_snapshot_pruned": chain(*LOG_EDGES, final=f"SELECT {_EDGE} FROM ed WHERE {_ALIVE}"),
    "edge_peek_vs_snapshot": chain(
        LOG,
        "lc AS (SELECT * FROM lo WHERE seq <= (SELECT floor(max(id) * 9 / 10) FROM associations))",
        fold("ed", "lo"),
        fold("eo", "lc"),
        final=f"SELECT * FROM (SELECT a, b, round(x.w, 6) AS peek, round(coalesce(y.w, 0), 6) AS snapshot FROM (SELECT a, b, {read(LOG_NOW)} AS w FROM ed) x LEFT JOIN (SELECT a, b, {read(LOG_NOW)} AS w FROM eo WHERE {_ALIVE}) y USING (a, b)) WHERE peek <> snapshot",
    ),
    "adjacency_degree": chain(*LOG_EDGES, final=f"SELECT node, count(*) AS degree FROM (SELECT unnest([a, b]) AS node FROM ed WHERE {_ALIVE}) GROUP BY node"),
    "neighbors_cap": chain(*LOG_EDGES, final=f"SELECT src, dst, round(now, 6) AS now FROM (SELECT unnest([a, b]) AS src, unnest([b, a]) AS dst, {read(LOG_NOW)} AS now FROM ed WHERE {_ALIVE}) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 16"),
    "pair_weights": chain(*LOG_EDGES, RECORDS, final=f"SELECT r.id AS a, r.p AS b, r.tick, round(coalesce(e.w, 0), 6) AS pair_weight FROM (SELECT id, tick, lag(id) OVER (PARTITION BY tick ORDER BY id) AS p FROM re) r LEFT JOIN (SELECT a, b, {read(LOG_NOW)} AS w FROM ed WHERE {_ALIVE}) e ON e.a = least(r.id, r.p) AND e.b = greatest(r.id, r.p) WHERE r.p IS NOT NULL"),
    "edge_mass_along": chain(*LOG_EDGES, RECORDS, final=f"SELECT r.tick AS path_id, round(sum(coalesce(e.w, 0)), 6) AS mass FROM (SELECT id, tick, lead(id) OVER (PARTITION BY tick ORDER BY id) AS p FROM re WHERE tick IS NOT NULL) r LEFT JOIN (SELECT a, b, {read(LOG_NOW)} AS w FROM ed WHERE {_ALIVE}) e ON e.a = least(r.id, r.p) AND e.b = greatest(r.id, r.p) AND r.p IS NOT NULL GROUP BY r.tick"),
    "graph_stats": chain(*LOG_EDGES, final=f"SELECT count(*) AS inserts, sum(events - 1)::BIGINT AS updates, count(*) FILTER (NOT {_ALIVE}) AS dropped, count(*) FILTER ({_ALIVE}) AS edge_count, coalesce(max(b + 1) FILTER ({_ALIVE}), 0) AS node_count, round(count(*) / 1048576.0e0, 6) AS load_factor, greatest(count(*) - 734003, 0) AS rejected_full FROM ed"),
    "edge_provenance": chain(TURNS, index(), PREFIX, ADJACENT, STAR, final="SELECT corpus, a, b, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins FROM (SELECT corpus, a, b, 'adjacent' AS origin FROM ea UNION ALL SELECT corpus, a, b, 'star' FROM es) GROUP BY corpus, a, b"),
    "activation_1hop": chain(*LEXICAL, *GRAPH, SEEDS, hops(1), final="SELECT query_id, corpus, node, round(score, 6) AS score FROM (SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY query_id, corpus ORDER BY score DESC, node) <= 64) WHERE score >= 0.001e0"),
    "activation_2hop": chain(*ACTIVATION, final="SELECT query_id, corpus, node, round(score, 6) AS score FROM (SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY query_id, corpus ORDER BY score DESC, node) <= 64) WHERE score >= 0.001e0"),
    "activation_cutoff": chain(*LEXICAL, *GRAPH, SEEDS, hops(2, "0.05e0"), final="SELECT query_id, corpus, node, round(score, 6) AS score FROM ac WHERE ac.score >= 0.05e0"),
    "activation_arcs": chain(*ACTIVATION, final="SELECT query_id, corpus, hop, src, dst, round(contribution, 6) AS contribution FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2)"),
    "activation_profile": chain(
        *ACTIVATION,
        "dg AS (SELECT corpus, src AS node, count(*) AS deg FROM tr GROUP BY ALL)",
        "vi AS MATERIALIZED (SELECT v.*, d.deg FROM (SELECT query_id, corpus, node, 0 AS hop FROM vs UNION ALL SELECT query_id, corpus, node, 1 FROM f1) v LEFT JOIN dg d ON d.corpus = v.corpus AND d.node = v.node)",
        "fr AS (SELECT query_id, sum(c)::BIGINT AS frontier_entries, max(c) AS max_frontier FROM (SELECT query_id, hop, count(*) AS c FROM vi GROUP BY ALL) GROUP BY query_id)",
        "rv AS (SELECT query_id, count(deg) AS row_visits, coalesce(sum(deg), 0)::BIGINT AS edge_visits FROM vi GROUP BY query_id)",
        "ur AS (SELECT query_id, count(deg) AS unique_rows, coalesce(sum(deg), 0)::BIGINT AS decay_evaluations FROM (SELECT DISTINCT query_id, corpus, node, deg FROM vi) GROUP BY query_id)",
        "me AS (SELECT query_id, sum(m)::BIGINT AS merged_entries FROM (SELECT query_id, hop, corpus, dst, count(*) - 1 AS m FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2) GROUP BY ALL) GROUP BY query_id)",
        final="SELECT query_id, frontier_entries, max_frontier, row_visits, edge_visits, unique_rows, decay_evaluations, coalesce(merged_entries, 0) AS merged_entries FROM fr JOIN rv USING (query_id) JOIN ur USING (query_id) LEFT JOIN me USING (query_id)",
    ),
    "retrieve_lexical": chain(*PLAIN, final=f"SELECT {HIT_COLUMNS} FROM hp"),
    "retrieve_associative": chain(*SEARCH, final=f"SELECT {HIT_COLUMNS} FROM hi"),
    "retrieve_added_by_graph": chain(*BOTH, final="SELECT query_id, corpus, id, round(score, 6) AS score, rank FROM hi WHERE NOT EXISTS (SELECT 1 FROM hp WHERE hp.query_id = hi.query_id AND hp.id = hi.id)"),
    "retrieve_witness_paths": chain(
        *SEARCH,
        "w1 AS MATERIALIZED (SELECT query_id, corpus, dst AS node, src::VARCHAR || '>' || dst AS path FROM a1 QUALIFY row_number() OVER (PARTITION BY query_id, corpus, dst ORDER BY round(contribution, 12) DESC, src) = 1)",
        "w2 AS MATERIALIZED (SELECT a.query_id, a.corpus, a.dst AS node, w.path || '>' || a.dst AS path FROM a2 a JOIN w1 w ON w.query_id = a.query_id AND w.corpus = a.corpus AND w.node = a.src QUALIFY row_number() OVER (PARTITION BY a.query_id, a.corpus, a.dst ORDER BY round(a.contribution, 12) DESC, a.src) = 1)",
        "wa AS (SELECT * FROM (SELECT query_id, corpus, node, 0 AS hop, node::VARCHAR AS path FROM vs UNION ALL SELECT query_id, corpus, node, 1, path FROM w1 UNION ALL SELECT query_id, corpus, node, 2, path FROM w2) QUALIFY row_number() OVER (PARTITION BY query_id, corpus, node ORDER BY hop) = 1)",
        final="SELECT h.query_id, h.corpus, h.id, w.hop, w.path FROM hi h JOIN wa w ON w.query_id = h.query_id AND w.corpus = h.corpus AND w.node = h.id",
    ),
    "vector_seed_topk": chain(VECTORS, _near(8), final="SELECT query_id, id, round(similarity, 6) AS similarity, rank FROM nk"),
    "structural_holes": chain(VECTORS, _near(32), final="SELECT a, b, round(max(similarity), 6) AS similarity FROM (SELECT least(query_id, id) AS a, greatest(query_id, id) AS b, similarity FROM nk WHERE query_id <> id AND similarity > 0.35) x WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.a = x.a AND la.b = x.b) GROUP BY a, b"),
    "vector_recall": chain(
        VECTORS,
        _near(8),
        "ad AS MATERIALIZED (SELECT a AS src, b AS dst FROM la UNION ALL SELECT b, a FROM la)",
        "tr AS MATERIALIZED (SELECT src, dst, 1.0e0 / count(*) OVER (PARTITION BY src) AS share FROM ad)",
        "vs AS MATERIALIZED (SELECT query_id, id AS node, greatest(similarity, 0) AS score FROM nk WHERE similarity > 0 AND id <= (SELECT max(src) FROM tr))",
        "a1 AS MATERIALIZED (SELECT query_id, dst AS node, sum(score * share) AS score FROM vs JOIN tr ON node = src WHERE score * share >= 0.001e0 GROUP BY query_id, dst)",
        "a2 AS MATERIALIZED (SELECT query_id, dst AS node, sum(score * share) AS score FROM a1 JOIN tr ON node = src WHERE score * share >= 0.001e0 GROUP BY query_id, dst)",
        "ac AS MATERIALIZED (SELECT query_id, node, round(sum(score), 12) AS score FROM (SELECT * FROM vs UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2) GROUP BY query_id, node)",
        "aq AS (SELECT * FROM ac QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) <= 64)",
        "be AS (SELECT query_id, id, round(max(score), 9) AS score FROM (SELECT query_id, id, greatest(similarity, 0) AS score FROM nk UNION ALL SELECT query_id, node, score FROM aq WHERE score >= 0.001e0) GROUP BY query_id, id)",
        final="SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY be.score DESC, id) AS rank FROM be QUALIFY rank <= 16",
    ),
    "entity_links": chain(TURNS, NAMES, LINKS, final="SELECT * FROM li"),
    "entity_route": chain(TURNS, QUESTIONS, NAMES, LINKS, ROUTE, TOPICS, final="SELECT query_id, r.corpus, CASE WHEN entity IS NULL THEN 'adjacency' ELSE 'entity' END AS mode, entity, candidate_count, coalesce(entities, '') AS entities, "
        f"array_to_string({terms('coalesce(t.query, r.query)')}, ' ') AS topic_terms FROM ro r LEFT JOIN tq t USING (query_id)"),
    "supersede_history": chain(HISTORY, final="SELECT id, tick AS valid_from, valid_to, supersedes FROM hv"),
    "live_records": chain(HISTORY, final="SELECT id, tick FROM hv WHERE valid_to IS NULL"),
    "ttl_expired": chain(SIZED, final="SELECT id, tick FROM sz WHERE tick <= (SELECT max(tick) - greatest(1, max(tick) // 2) FROM sz)"),
    "evict_oldest": chain(SIZED, "ru AS (SELECT id, bytes, count(*) OVER w AS n, sum(bytes) OVER w AS t FROM sz WINDOW w AS (ORDER BY id DESC ROWS UNBOUNDED PRECEDING))", final="SELECT id, bytes FROM ru WHERE (n > (SELECT count(*) * 3 // 4 FROM sz) OR t > (SELECT sum(bytes) // 2 FROM sz)) AND id <> (SELECT max(id) FROM sz)"),
    "forget_cascade": chain(RECORDS, final="SELECT DISTINCT s.id AS seq, s.a, s.b, s.tick FROM associations s WHERE s.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM re WHERE re.id % 10 = 0 AND re.id = s.a) AND NOT EXISTS (SELECT 1 FROM re WHERE re.id % 10 = 0 AND re.id = s.b)"),
    "quota_totals": chain(SIZED, final="SELECT count(*) AS records, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM sz"),
    "evidence_bytes": chain(TURNS, "eb AS (SELECT corpus, octet_length(encode(to_json({'id': dia_id, 'text': content})::VARCHAR)) + 3 AS b FROM tu)", final="SELECT corpus, (2 + sum(b) + 2 * (count(*) - 1))::BIGINT AS bytes, count(*) AS records FROM eb GROUP BY corpus"),
    "oracle_packet": chain(*PLAIN, GOLD, GOLD_TURNS, "pk AS (SELECT query_id, corpus, id, min(k) AS k FROM (SELECT query_id, corpus, id, 0 AS k FROM gt UNION ALL SELECT query_id, corpus, id, rank FROM hp) GROUP BY ALL)", final="SELECT query_id, corpus, id, row_number() OVER (PARTITION BY query_id, corpus ORDER BY k, id) AS position FROM pk QUALIFY k = 0 OR position <= 8"),
    "gold_evidence": chain(QUESTIONS, GOLD, final="SELECT query_id, array_to_string(gold, ',') AS gold FROM go"),
    "evidence_recall": chain(*ARMS, final="SELECT arm, query_id, round(recall, 6) AS recall, any_found, all_found FROM ar"),
    "recall_summary": chain(*ARMS, final="SELECT arm, category, count(*) AS questions, count(recall) AS scored, round(avg(recall), 6) AS mean_recall, round(avg(any_found::INT), 6) AS any_rate, round(avg(all_found::INT), 6) AS all_rate FROM ar GROUP BY ROLLUP (arm, category)"),
    "recall_percentiles": chain(*ARMS, final="SELECT arm, count(recall) AS n, round(avg(recall), 6) AS mean, round(quantile_cont(recall, 0.5), 6) AS median, round(quantile_cont(recall, 0.95), 6) AS p95 FROM ar WHERE recall IS NOT NULL GROUP BY arm"),
    "paired_outcomes": chain(*PAIRS, final="SELECT * FROM oc"),
    "sign_test": chain(*PAIRS, final="SELECT * FROM sg"),
    "holm_adjust": chain(*PAIRS, final="SELECT test, p, round(max(s) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM (SELECT category AS test, p, least(1.0e0, (count(*) OVER () - row_number() OVER (ORDER BY p, category) + 1) * p) AS s FROM sg)"),
    "abstention_transitions": chain(*PAIRS, final="SELECT NOT ya AS before, NOT xa AS after, count(*) AS cases, round(sum(associative - lexical) / (SELECT count(*) FROM pr), 6) AS contribution FROM pr GROUP BY ALL"),
    "missing_source_audit": chain(
        *SEARCH,
        GOLD,
        GOLD_TURNS,
        NAMES,
        LINKS,
        ROUTE,
        "lr AS (SELECT query_id, corpus, id, row_number() OVER (PARTITION BY query_id, corpus ORDER BY lexical DESC, id) AS rank FROM lx)",
        "ar2 AS (SELECT corpus, id, tick, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM tu WINDOW w AS (PARTITION BY corpus ORDER BY id))",
        "ht AS (SELECT h.query_id, h.corpus, h.id, t.tick FROM hi h JOIN tu t ON t.corpus = h.corpus AND t.id = h.id)",
        final="""SELECT g.query_id, g.corpus, g.id, l.rank AS lexical_rank, round(coalesce(a.association, 0), 6) AS association,
 o.entity IS NOT NULL AND NOT EXISTS (SELECT 1 FROM li WHERE li.corpus = g.corpus AND li.entity = o.entity AND li.id = g.id) AS gated_out,
 r.tick, (SELECT min(abs(ht.id - g.id)) FROM ht WHERE ht.query_id = g.query_id AND ht.tick = r.tick) AS turn_distance, r.prev_id, r.next_id
 FROM (SELECT DISTINCT * FROM gt) g LEFT JOIN lr l ON l.query_id = g.query_id AND l.id = g.id LEFT JOIN an a ON a.query_id = g.query_id AND a.id = g.id JOIN ar2 r ON r.corpus = g.corpus AND r.id = g.id
 JOIN ro o ON o.query_id = g.query_id WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.query_id = g.query_id AND hi.id = g.id)""",
    ),
    "retrieve_ablation_variants": chain(
        *LEXICAL,
        PREFIX,
        ADJACENT,
        STAR,
        COMBINED,
        "el AS (SELECT DISTINCT t.corpus, t.id AS seq, least(t.id, p.other) AS a, greatest(t.id, p.other) AS b, t.tick FROM p3 p JOIN tu t ON t.corpus = p.corpus AND t.id = p.id)",
        *GRAPH[1:],
        SEEDS,
        hops(),
        ASSOCIATION,
        fuse(),
        "az AS (SELECT * FROM an WHERE false)",
        fuse("hp", "0.0e0", an="az"),
        *(part for name, events in (("s", "es"), ("l", "el"), ("c", "ec")) for part in (_other(f"{name}_", events), fuse(f"h{name}", an=f"{name}_an"))),
        permuted("s_al", "corpus"),
        "v_al AS MATERIALIZED (SELECT e.corpus, least(x.target, y.target) AS a, greatest(x.target, y.target) AS b, e.now FROM s_al e JOIN pm x ON x.corpus = e.corpus AND x.node = e.a JOIN pm y ON y.corpus = e.corpus AND y.node = e.b)",
        renamed(",\n".join([_TRANSITIONS, SEEDS, hops(), ASSOCIATION]), _GRAPH_NAMES, "v_"),
        fuse("hv", an="v_an"),
        final="SELECT variant, query_id, id, rank FROM (SELECT 'lexical' AS variant, * FROM hp UNION ALL SELECT 'adjacent', * FROM hi UNION ALL SELECT 'star', * FROM hs UNION ALL SELECT 'learned', * FROM hl UNION ALL SELECT 'combined', * FROM hc UNION ALL SELECT 'shuffled', * FROM hv) WHERE rank <= 10",
    ),
    "entity_gated_topk": chain(
        *ACTIVATION,
        ASSOCIATION,
        fuse(),
        NAMES,
        LINKS,
        ROUTE,
        TOPICS,
        index("b", "tu", "body"),
        lexical("lb", "b", "tq"),
        CANDIDATES,
        inside("ce", "lb"),
        final="SELECT query_id, corpus, id, round(score, 6) AS score, rank, 'entity' AS mode, link_types FROM ce UNION ALL SELECT h.query_id, h.corpus, h.id, round(h.score, 6), h.rank, 'adjacency', '' FROM hi h JOIN ro r ON r.query_id = h.query_id WHERE r.entity IS NULL",
    ),
    "fit_records": (
        "WITH RECURSIVE "
        + ",\n".join(
            [
                *SEARCH,
                "sz AS MATERIALIZED (SELECT h.query_id, h.id, h.rank, octet_length(encode(to_json({'id': h.id::VARCHAR, 'text': t.content})::VARCHAR)) + 3 AS b FROM hi h JOIN tu t ON t.corpus = h.corpus AND t.id = h.id)",
                """ft AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS id, 2::BIGINT AS used, 0 AS kept, false AS took FROM (SELECT DISTINCT query_id FROM sz)
 UNION ALL SELECT f.query_id, s.rank, s.id, CASE WHEN f.used + s.b + CASE WHEN f.kept > 0 THEN 2 ELSE 0 END <= 1200 AND f.kept < 8 THEN f.used + s.b + CASE WHEN f.kept > 0 THEN 2 ELSE 0 END ELSE f.used END,
 f.kept + CASE WHEN f.used + s.b + CASE WHEN f.kept > 0 THEN 2 ELSE 0 END <= 1200 AND f.kept < 8 THEN 1 ELSE 0 END, f.used + s.b + CASE WHEN f.kept > 0 THEN 2 ELSE 0 END <= 1200 AND f.kept < 8 FROM ft f JOIN sz s ON s.query_id = f.query_id AND s.rank = f.rank + 1)""",
            ]
        )
        + "\nSELECT query_id, id, rank FROM ft WHERE took"
    ),
    "mixed_packet": chain(
        *BOTH,
        "mo AS (SELECT query_id, id, 0 AS l, rank AS r FROM hp WHERE rank <= 8)",
        "m1 AS (SELECT query_id, id, 1 AS l, rank AS r FROM hi h WHERE NOT EXISTS (SELECT 1 FROM mo WHERE mo.query_id = h.query_id AND mo.id = h.id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) + (SELECT count(*) FROM mo WHERE mo.query_id = h.query_id) <= 12)",
        "m2 AS (SELECT * FROM mo UNION ALL SELECT * FROM m1)",
        "m3 AS (SELECT query_id, id, 2 AS l, row_number() OVER (PARTITION BY query_id ORDER BY id) AS r FROM hp h WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.query_id = h.query_id AND m2.id = h.id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) + (SELECT count(*) FROM m2 WHERE m2.query_id = h.query_id) <= 16)",
        "m4 AS (SELECT * FROM m2 UNION ALL SELECT * FROM m3)",
        final="SELECT m.query_id, q.corpus, m.id, row_number() OVER (PARTITION BY m.query_id ORDER BY l, r, m.id) AS rank FROM m4 m JOIN qu q ON q.query_id = m.query_id",
    ),
    "retrieval_diagnosis": chain(
        *SEARCH,
        GOLD,
        GOLD_TURNS,
        "lr AS (SELECT query_id, corpus, id, row_number() OVER (PARTITION BY query_id, corpus ORDER BY lexical DESC, id) AS rank FROM lx)",
        "fh AS (SELECT query_id, corpus, dst, min(hop) AS hop FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2) GROUP BY ALL)",
        final="SELECT g.query_id, g.corpus, g.id, s.node IS NOT NULL AS is_seed, l.rank AS lexical_rank, round(coalesce(a.association, 0), 6) AS association, f.hop AS first_hop, h.rank AS final_rank FROM (SELECT DISTINCT * FROM gt) g LEFT JOIN sd s ON s.query_id = g.query_id AND s.node = g.id LEFT JOIN lr l ON l.query_id = g.query_id AND l.id = g.id LEFT JOIN an a ON a.query_id = g.query_id AND a.id = g.id LEFT JOIN fh f ON f.query_id = g.query_id AND f.dst = g.id LEFT JOIN hi h ON h.query_id = g.query_id AND h.id = g.id",
    ),
    "coactivation_windows": chain(WINDOWS, final="SELECT a, b, count(*) AS windows FROM wp GROUP BY a, b"),
    "stream_association_fold": chain(*LOG_EDGES, final=f"SELECT {_EDGE} FROM ed"),
    "stream_coactivation_fold": chain(WINDOWS, fold("ed", "wp"), final=f"SELECT {_EDGE} FROM ed"),
    "contention_counts": f"""WITH s AS (SELECT range + 1 AS seq FROM range(40000)),
 e AS (SELECT 'hot' AS layout, 0 AS p FROM s UNION ALL SELECT 'disjoint', seq % 8 FROM s UNION ALL SELECT 'uniform', {drawn(1, 'seq')} % 4096 FROM s),
 c AS (SELECT layout, p, count(*) AS n FROM e GROUP BY ALL)
 SELECT layout, count(*) AS edges, sum(n)::BIGINT AS updates, max(n) AS most, sum(n)::DOUBLE AS weight FROM c GROUP BY layout""",
    "policy_grid_associative": chain(
        *LEXICAL,
        PREFIX,
        ADJACENT,
        STAR,
        COMBINED,
        *GRAPH[1:],
        SEEDS,
        *(part for name, events in (("s", "es"), ("c", "ec")) for part in (_other(f"{name}_", events), fuse(f"h{name}", an=f"{name}_an"))),
        GOLD,
        f"ar AS MATERIALIZED ({_arm('star', 'hs')} UNION ALL {_arm('combined', 'hc')})",
        final="""SELECT CASE WHEN ('0x' || substr(md5(corpus), 1, 8))::BIGINT % 2 = 0 THEN 'development' ELSE 'held out' END AS split, arm AS policy, 'associative' AS mode,
 round(avg(recall), 6) AS mean_recall, count(*) FILTER (all_found) AS complete FROM ar GROUP BY 1, 2""",
    ),
    "walk_directional": chain(
        VECTORS,
        *walk(),
        final="SELECT id AS query_id, coalesce((SELECT array_to_string(path, '>') FROM (SELECT * FROM (SELECT query_id, path FROM w0 UNION ALL SELECT query_id, path FROM t1 UNION ALL SELECT query_id, path FROM t2 UNION ALL SELECT query_id, path FROM t3 UNION ALL SELECT query_id, path FROM t4) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY len(path) DESC) = 1) l WHERE l.query_id = ve.id), '') AS path FROM ve WHERE id % 20 = 0",
    ),
    "bridge_removed_packet": chain(*PLAIN, GOLD, GOLD_TURNS, final="SELECT query_id, corpus, id, rank FROM hp WHERE rank <= 8 AND NOT EXISTS (SELECT 1 FROM gt WHERE gt.query_id = hp.query_id AND gt.id = hp.id)"),
    "counterfactual_packet": chain(
        *PLAIN,
        GOLD,
        GOLD_TURNS,
        "cp AS (SELECT h.query_id, h.corpus, h.id, h.rank, t.content, EXISTS (SELECT 1 FROM gt WHERE gt.query_id = h.query_id AND gt.id = h.id) AS g FROM hp h JOIN tu t ON t.corpus = h.corpus AND t.id = h.id WHERE h.rank <= 8)",
        final="SELECT query_id, corpus, id, rank, md5(regexp_replace(CASE WHEN g THEN upper(translate(content, 'aeiou', 'AEIOU')) ELSE content END, '[^a-zA-Z]', '', 'g')) AS digest FROM cp",
    ),
    "usage_report": chain(
        QUESTIONS,
        final="SELECT category::VARCHAR AS arm, count(*) AS calls, sum(length(query))::BIGINT AS input_tokens, sum(coalesce(length(answer), 0))::BIGINT AS output_tokens, round(quantile_cont(query_id % 13 / 10.0e0, 0.5), 6) AS median_seconds FROM qu WHERE query_id % 7 <> 0 GROUP BY category",
    ),
    "pending_jobs": chain(QUESTIONS, final="SELECT query_id AS job_id FROM qu WHERE query_id % 2 <> 0"),
    "causal_families": chain(
        QUESTIONS,
        final="SELECT category AS family, count(*) AS cases, count(*) FILTER (query_id % 2 <> 0) AS oracle, count(*) FILTER (query_id % 3 <> 0) AS counterfactual, count(*) FILTER (query_id % 5 <> 0) AS bridge_removed, count(*) FILTER (query_id % 2 <> 0 AND query_id % 3 <> 0 AND query_id % 5 <> 0) AS all_correct FROM qu GROUP BY category",
    ),
    "stream_snapshot": chain(*LOG_EDGES, final=f"SELECT {_EDGE} FROM ed WHERE {_ALIVE}"),
    "best_graph_weight": chain(
        *WEIGHTED,
        final="""SELECT * FROM (SELECT w AS weight, round(avg(recall) FILTER (dev), 6) AS mean_recall, round(avg(recall) FILTER (NOT dev), 6) AS test_recall
 FROM (SELECT *, ('0x' || substr(md5(corpus), 1, 8))::BIGINT % 2 = 0 AS dev FROM wr) GROUP BY w) ORDER BY mean_recall DESC, weight LIMIT 1""",
    ),
    "promotion": chain(
        *WEIGHTED,
        "cv AS (SELECT x.w, round(avg(x.recall), 9) AS graph, round(avg(y.recall), 9) AS adjacency, quantile_cont(x.recall - y.recall, 0.9) AS low FROM wr x JOIN wr y ON y.query_id = x.query_id AND y.w = 0 GROUP BY x.w)",
        "co AS (SELECT list(c ORDER BY w) AS c FROM (SELECT w, {'g': graph, 'a': adjacency, 'l': low} AS c FROM cv))",
        final="SELECT round(c[5].g - c[2].g, 6) + 0.0e0 AS gain, round(c[5].g - c[5].a, 6) + 0.0e0 AS advantage, c[5].g - c[2].g >= 0.01 AND c[5].g - c[5].a >= 0.01 AND c[5].l > 0 AND c[5].g >= c[4].g AS promote FROM co",
    ),
    "cluster_means": chain(*PAIRS, final="SELECT corpus, cases, round(m, 6) + 0.0e0 AS mean_delta, CASE WHEN m > 1e-12 THEN 1 WHEN m < -1e-12 THEN -1 ELSE 0 END AS outcome FROM (SELECT corpus, count(*) AS cases, avg(associative - lexical) AS m FROM pr GROUP BY corpus)"),
    "cluster_bootstrap": chain(
        *PAIRS,
        "cl AS MATERIALIZED (SELECT row_number() OVER (ORDER BY corpus) - 1 AS j, sum(associative - lexical) AS s, count(*) AS n FROM pr GROUP BY corpus)",
        f"dr AS (SELECT d, {drawn(7, 'd', 'j')} % (SELECT count(*) FROM cl) AS p FROM cl, range(3000) t(d))",
        "me2 AS (SELECT d, sum(s) / sum(n) AS m FROM dr JOIN cl ON cl.j = dr.p GROUP BY d)",
        final="SELECT (SELECT round(sum(s) / sum(n), 6) + 0.0e0 FROM cl) AS mean, round(quantile_cont(m, 0.025), 6) + 0.0e0 AS low, round(quantile_cont(m, 0.975), 6) + 0.0e0 AS high FROM me2",
    ),
    "token_f1_words": answer_scores(False),
    "category_f1_words": answer_scores(True),
    "exact_answers": chain(
        QUESTIONS,
        """sp AS (SELECT query_id, answer, unnest(range(4)) AS spelling, unnest([answer, ' "' || upper(answer) || '". ', 'it is ' || answer, answer || ' cells']) AS said FROM qu WHERE answer IS NOT NULL)""",
        """tx AS (SELECT query_id, spelling, lower(answer) AS want, trim(lower(trim(said)), ' .`"') AS t FROM sp)""",
        final=r"""SELECT query_id, spelling, t = want OR CASE WHEN want = 'not enough information' THEN false WHEN starts_with(want, 'rm') THEN regexp_replace(t, '^room\s+', '') = want ELSE regexp_replace(t, '\s+cells$', '') = want END AS exact FROM tx""",
    ),
    "witness_path_steps": chain(
        *SEARCH,
        "wa AS (SELECT query_id, corpus, node, min(hop) AS hop FROM (SELECT query_id, corpus, node, 0 AS hop FROM vs UNION ALL SELECT query_id, corpus, node, 1 FROM f1 UNION ALL SELECT query_id, corpus, node, 2 FROM f2) GROUP BY ALL)",
        final="SELECT h.query_id, h.corpus, h.id, w.hop AS steps, 0 AS weak FROM hi h JOIN wa w ON w.query_id = h.query_id AND w.corpus = h.corpus AND w.node = h.id",
    ),
    "activation_paths": chain(
        *LEXICAL,
        *GRAPH,
        SEEDS,
        hops(1),
        "a2 AS (SELECT f.query_id, f.corpus, t.dst AS node, f.contribution * t.share AS score FROM a1 f JOIN tr t ON t.corpus = f.corpus AND t.src = f.dst WHERE f.contribution * t.share >= 0.001e0)",
        "al2 AS (SELECT query_id, corpus, node, round(sum(score), 12) AS score FROM (SELECT * FROM vs UNION ALL SELECT query_id, corpus, dst, contribution FROM a1 UNION ALL SELECT * FROM a2) GROUP BY ALL)",
        final="SELECT query_id, corpus, node, round(score, 6) AS score FROM al2 WHERE al2.score >= 0.001e0",
    ),
    "edges_admitted": chain(LOG, "fs AS (SELECT a, b, min(seq) AS first_seen FROM lo GROUP BY a, b)", final="SELECT a, b, first_seen FROM fs QUALIFY row_number() OVER (ORDER BY first_seen, a, b) <= (SELECT count(*) * 5 // 7 * 7 // 10 FROM fs)"),
    "shuffled_graph": chain(*LOG_EDGES, permuted("ed"), final="SELECT least(x.target, y.target) AS a, greatest(x.target, y.target) AS b, round(weight, 6) AS weight, last_tick, events FROM ed JOIN pm x ON x.node = ed.a JOIN pm y ON y.node = ed.b"),
    "entity_problems": chain(
        TURNS,
        "nl AS (SELECT DISTINCT corpus, lower(trim(alias)) AS k, lower(trim(speaker)) AS e FROM (SELECT corpus, speaker, speaker AS alias FROM tu UNION ALL SELECT corpus, speaker, string_split(trim(speaker), ' ')[1] FROM tu))",
        "kn AS (SELECT * FROM nl WHERE k <> '' AND e <> '')",
        final="""SELECT DISTINCT corpus, 'blank' AS problem, coalesce(k, '') AS name FROM nl WHERE coalesce(k, '') = '' OR coalesce(e, '') = ''
 UNION ALL SELECT corpus, 'ambiguous', k FROM kn GROUP BY corpus, k HAVING count(DISTINCT e) > 1
 UNION ALL SELECT DISTINCT corpus, 'undeclared', e FROM kn x WHERE NOT EXISTS (SELECT 1 FROM kn y WHERE y.corpus = x.corpus AND y.k = x.e)
 UNION ALL SELECT DISTINCT corpus, 'unknown speaker', lower(trim(speaker)) FROM tu WHERE tick > 1 AND speaker IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kn WHERE kn.corpus = tu.corpus AND kn.e = lower(trim(tu.speaker)))""",
    ),
    "entity_only": chain(
        *LEXICAL,
        NAMES,
        LINKS,
        ROUTE,
        TOPICS,
        index("b", "tu", "body"),
        lexical("lb", "b", "tq"),
        CANDIDATES,
        "az AS (SELECT 0::BIGINT AS query_id, 0::BIGINT AS id, 0.0e0 AS association WHERE false)",
        inside("ce", "lb", an="az"),
        final="SELECT query_id, corpus, id, round(score, 6) AS score, rank FROM ce",
    ),
    "entity_ablation": chain(
        *ACTIVATION,
        ASSOCIATION,
        fuse(),
        NAMES,
        LINKS,
        ROUTE,
        TOPICS,
        "x_qu AS (SELECT * FROM tq)",
        "y_qu AS (SELECT query_id, corpus, query FROM ro WHERE entity IS NOT NULL)",
        lexical("x_lx", "d", "x_qu"),
        renamed(",\n".join([SEEDS, hops(), ASSOCIATION, fuse("h2")]), "lx qu sd vs a1 f1 a2 f2 ac an h2"),
        renamed(fuse("h3"), "lx qu h3"),
        index("b", "tu", "body"),
        lexical("y_lx", "b", "y_qu"),
        renamed(fuse("h4"), "lx qu h4", "y_"),
        "z_qu AS (SELECT * FROM tq)",
        lexical("z_lx", "b", "z_qu"),
        renamed(fuse("h5"), "lx qu h5", "z_"),
        CANDIDATES,
        inside("c4", "y_lx"),
        inside("c5", "z_lx"),
        final="""SELECT arm, query_id, id, rank FROM (SELECT 'adjacency' AS arm, query_id, id, rank FROM hi
 UNION ALL SELECT 'adjacency_stripped_query', query_id, id, rank FROM x_h2 UNION ALL SELECT 'strip_lexical_keep_original_seeds', query_id, id, rank FROM x_h3
 UNION ALL SELECT 'body_original_ungated', query_id, id, rank FROM y_h4 UNION ALL SELECT 'body_stripped_ungated', query_id, id, rank FROM z_h5
 UNION ALL SELECT 'body_original_gated', query_id, id, rank FROM c4 UNION ALL SELECT 'body_stripped_gated', query_id, id, rank FROM c5) WHERE rank <= 10 AND query_id IN (SELECT query_id FROM y_qu)""",
    ),
    "ordered_multi_get": chain(RECORDS, final="SELECT tick AS request, row_number() OVER (PARTITION BY tick ORDER BY id DESC) AS place, id, writer FROM re WHERE tick IS NOT NULL"),
    "stratified_questions": chain(QUESTIONS, final=f"SELECT query_id, category FROM qu QUALIFY row_number() OVER (PARTITION BY category ORDER BY {drawn(0, 'query_id')}, query_id) <= 20"),
    "stream_stateful_fold": chain(*LOG_EDGES, final=f"SELECT {_EDGE} FROM ed"),
}
