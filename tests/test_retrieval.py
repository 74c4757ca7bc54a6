"""BM25, activation, fusion, explanation and entity routing against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hebbspark.functions.text import STOP_WORDS
from hebbspark.operators import activate as A
from hebbspark.operators import edges as E
from hebbspark.operators import entity as N
from hebbspark.operators import lexical as L
from hebbspark.operators import ranking as K
from hebbspark.operators import retrieve as R
from hebbspark.params import EdgeParams, SearchParams

FLAT = EdgeParams(lam=0.0)
SCOPE = ["corpus"]


def docs(spark, texts, corpus="c"):
    rows = spark.createDataFrame([(corpus, i + 1, t) for i, t in enumerate(texts)], "corpus string, id long, content string")
    return L.documents(rows, SCOPE)


def asked(spark, *texts):
    return spark.createDataFrame([(i + 1, "c", t) for i, t in enumerate(texts)], "query_id long, corpus string, query string")


def tokens(t):
    out, word = [], ""
    for ch in (t or "").lower() + " ":
        if ch in "abcdefghijklmnopqrstuvwxyz0123456789":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return [w for w in out if w not in STOP_WORDS]


def plain_bm25(texts, query):
    toks = [tokens(t) for t in texts]
    avg = max(sum(map(len, toks)) / len(toks), 1)
    df = Counter(w for t in toks for w in set(t))
    out = {}
    for i, t in enumerate(toks):
        tf = Counter(t)
        s = sum(math.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w in set(tokens(query)) if tf[w])
        if s > 0:
            out[i + 1] = s
    return out


TEXTS = ["apple pie and train", "the train station", None, "", "apple APPLE apple", "Ünïcode train42 x", "pear"]


def test_bm25(spark):
    got = L.bm25(asked(spark, "apple train apple", "nothing here", ""), docs(spark, TEXTS), SCOPE).collect()
    mine = {(r.query_id, r.id): r.lexical for r in got}
    want = {(1, i): s for i, s in plain_bm25(TEXTS, "apple train apple").items()}
    assert mine.keys() == want.keys()
    for k in want:
        assert mine[k] == pytest.approx(want[k], abs=1e-8)


def test_prefix_bm25_is_sequential(spark):
    texts = ["red fox", "blue fox", "red red dog", None, "fox dog", "dog fox red blue"]
    got = defaultdict(list)
    for r in L.prefix_bm25(docs(spark, texts), SCOPE, 3).orderBy("id", "rank").collect():
        got[r.id].append(r.other)
    for i in range(1, len(texts)):
        s = plain_bm25(texts[:i], texts[i])
        want = [j for j, _ in sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]]
        assert got.get(i + 1, []) == want


@pytest.mark.parametrize("k", [0, 1, 4, 20])
def test_stable_topk(spark, k):
    rows = [(1, i, float(i % 3)) for i in range(1, 18)]
    df = spark.createDataFrame(rows, "g long, id long, s double")
    got = [r.id for r in K.stable_topk(df, ["g"], "s", k).orderBy("rank").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (-r[2], r[1]))][:k]


def adj(spark, pairs, tick=0):
    e = spark.createDataFrame([(i + 1, "c", a, b, tick) for i, (a, b) in enumerate(pairs)], "seq long, corpus string, a long, b long, tick long")
    return A.transitions(E.adjacency(E.fold(e, FLAT, SCOPE), SCOPE), tick, FLAT, SCOPE)


def seeds(spark, **w):
    return spark.createDataFrame([(1, "c", int(k[1:]), v) for k, v in w.items()], "query_id long, corpus string, node long, weight double")


def dense(pairs, start, hops, n):
    w = [[0.0] * (n + 1) for _ in range(n + 1)]
    for a, b in pairs:
        w[a][b] = w[b][a] = w[a][b] + 1
    front, total = list(start), list(start)
    for _ in range(hops):
        nxt = [0.0] * (n + 1)
        for u in range(n + 1):
            m = sum(w[u])
            for v in range(n + 1):
                if m and front[u]:
                    nxt[v] += front[u] * w[u][v] / m
        front, total = nxt, [x + y for x, y in zip(total, nxt)]
    return total


def test_activation_one_hop(spark):
    act = A.activate(seeds(spark, n1=1.0), adj(spark, [(1, 2), (1, 3), (2, 4)]), 1, 0.0, 64, SCOPE)
    assert {r.node: r.score for r in act.scores.collect()} == {1: 1.0, 2: 0.5, 3: 0.5}


def test_activation_is_matrix_powers(spark):
    pairs = [(1, 2), (1, 3), (2, 4), (3, 4)]
    trans = adj(spark, pairs)
    for merge in (True, False):
        act = A.activate(seeds(spark, n1=1.0), trans, 4, 0.0, None, SCOPE, merge=merge)
        want = dense(pairs, [0, 1.0, 0, 0, 0], 4, 4)
        got = {r.node: r.score for r in act.scores.collect()}
        for n in range(1, 5):
            assert got[n] == pytest.approx(want[n], abs=1e-9)
    p = A.profile(seeds(spark, n1=1.0), A.activate(seeds(spark, n1=1.0), trans, 4, 0.0, None, SCOPE), trans, SCOPE).first()
    assert p.decay_evaluations == 8 and p.merged_entries > 0


def test_cutoff_is_per_contribution_and_merging_helps(spark):
    pairs = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)]
    trans = adj(spark, pairs)
    reach = lambda merge: {r.node for r in A.activate(seeds(spark, n1=1.0), trans, 3, 0.1, 64, SCOPE, merge=merge).scores.collect()}
    assert 5 in reach(True) and 5 not in reach(False)


def test_bad_seeds(spark):
    s = seeds(spark, n1=1.0, n2=-1.0, n3=float("nan"), n9=1.0)
    assert [r.node for r in A.valid_seeds(s, adj(spark, [(1, 2)]), SCOPE).collect()] == [1]


def test_witness_path(spark):
    act = A.activate(seeds(spark, n1=1.0), adj(spark, [(1, 2), (2, 3)]), 2, 0.0, None, SCOPE)
    paths = {r.node: (r.hop, r.path) for r in A.witness_paths(act, SCOPE).collect()}
    assert paths == {1: (0, [1]), 2: (1, [1, 2]), 3: (2, [1, 2, 3])}
    simple = {r.node: r.path for r in A.witness_paths(act, SCOPE, simple=True).collect()}
    assert all(len(set(p)) == len(p) for p in simple.values())


def test_search_pads_by_id_and_graph_adds(spark):
    d = docs(spark, ["alpha amber", "beta blue", "gamma", "delta"])
    q = asked(spark, "alpha", "zzz")
    plain = {(r.query_id, r["rank"]): r.id for r in R.search(q, d, None, SearchParams(budget=3, graph_weight=0), SCOPE).collect()}
    assert plain == {(1, 1): 1, (1, 2): 2, (1, 3): 3, (2, 1): 1, (2, 2): 2, (2, 3): 3}
    out = R.explain(q, d, adj(spark, [(1, 4)]), SearchParams(budget=2), SCOPE).where("query_id = 1").orderBy("rank").collect()
    assert [(r.id, r.added_by_graph) for r in out] == [(1, False), (4, True)] and out[1].path == [1, 4]


def test_connected_paths_are_prefix_closed(spark):
    d = docs(spark, ["root word", "b", "c", "d", "e"])
    got = R.connected(asked(spark, "root"), d, adj(spark, [(1, 2), (2, 3), (1, 4), (4, 5)]), SearchParams(budget=4), SCOPE).orderBy("position").collect()
    assert got[0].id == 1 and 1 < len(got) <= 4


def test_entity_routing(spark):
    t = spark.createDataFrame(
        [("c", 1, 1, "Mira", "turtles live in the pond"), ("c", 2, 1, "Nate", "I like trains"), ("c", 3, 1, "nate ", "Mira keeps turtles"), ("c", 4, 1, None, None)],
        "corpus string, id long, tick long, speaker string, body string",
    )
    known = N.names(spark.createDataFrame([("c", "Mira", "Mira"), ("c", "Mira", "M"), ("c", "Nate", "Nate"), ("c", "Nate", "")], "corpus string, entity string, alias string"), SCOPE)
    assert N.ambiguous(known, SCOPE).count() == 0
    roles = N.links(t, known)
    assert {(r.entity, r.role, r.id) for r in roles.collect()} == {("mira", "authored_by", 1), ("nate", "authored_by", 2), ("nate", "authored_by", 3), ("mira", "mentions", 3)}
    q = asked(spark, "Where does M keep turtles?", "Do Mira and Nate meet?", "anything else?")
    routed = N.route(q, known, roles)
    assert {r.query_id: r["mode"] for r in routed.collect()} == {1: "entity", 2: "adjacency", 3: "adjacency"}
    content = t.withColumnRenamed("body", "content")
    hits = N.entity_search(routed, L.documents(content, SCOPE), L.documents(t, SCOPE, "body"), adj(spark, [(1, 2), (2, 3)]), roles)
    gated = hits.where("query_id = 1").orderBy("rank").collect()
    assert {r.id for r in gated} == {1, 3} and gated[0].link_types == (["authored_by"] if gated[0].id == 1 else ["mentions", "authored_by"][:1])
    assert hits.where("query_id = 2").count() == 4


def test_two_names_for_one_key_are_ambiguous(spark):
    known = N.names(spark.createDataFrame([("c", "A", "x"), ("c", "B", "X ")], "corpus string, entity string, alias string"), SCOPE)
    assert N.ambiguous(known, SCOPE).count() == 1


def test_merged_quotas(spark):
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "q long, id long, rank int")
    two = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 13, 3)], "q long, id long, rank int")
    got = [r.id for r in K.merged_quotas([(one, 2), (two, 4)], ["q"]).orderBy("rank").collect()]
    assert got == [10, 11, 12, 13]


def test_recall_filters_after_the_budget_and_returns_events(spark):
    d = docs(spark, ["alpha amber", "alpha", "gamma", "alpha beta"])
    records = spark.createDataFrame([("c", 1, None, 0), ("c", 2, 5, 0), ("c", 3, None, 0), ("c", 4, None, 1)], "corpus string, id long, valid_to long, layer int")
    hits, events = R.recall(asked(spark, "alpha gamma"), d, records, None, 7, SearchParams(budget=4, graph_weight=0), SCOPE)
    assert {r.id for r in hits.collect()} == {1, 3}
    e = events.first()
    assert e.nodes == [1, 3] and e.tick == 7
    assert N.out_of_step(d, d.where("id <> 2"), SCOPE).count() == 1


def test_one_edge_over_time(spark):
    """An edge reinforced at ticks 1, 39 and 61 links a seed to a record that no word finds."""
    p = EdgeParams()
    log = spark.createDataFrame([(i, 1, 2, t) for i, t in enumerate((1, 39, 61))], "seq long, a long, b long, tick long")
    e = E.fold(log, p)
    assert e.first().weight == pytest.approx(0.95**60 + 0.95**22 + 1)
    trans = A.transitions(E.adjacency(E.freeze(e, 61, p)), 61, p)
    seed = spark.createDataFrame([(1, 1, 0.82)], "query_id long, node long, weight double")
    reach = lambda hops: {r.node: r.score for r in A.activate(seed, trans, hops).scores.collect()}
    assert reach(0) == {1: 0.82} and reach(1) == {1: 0.82, 2: 0.82}


@pytest.mark.parametrize("first,all_pairs", [(1, 0), (64, 0), (1, 64)])
def test_pruned_prefix_is_whole(spark, first, all_pairs):
    rng = random.Random(8)
    words = ["the1"] * 30 + ["some"] * 12 + [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(90)]
    got = {(r.id, r.other): (r.rank, r.lexical) for r in L.prefix_bm25(docs(spark, texts), SCOPE, 3, first, all_pairs).collect()}
    want = {}
    for i in range(1, len(texts)):
        scores = plain_bm25(texts[:i], texts[i])
        order = sorted((j for j in scores if round(scores[j], 9) > 0), key=lambda j: (-round(scores[j], 9), j))[:3]
        want |= {(i + 1, j): (n, round(scores[j], 9)) for n, j in enumerate(order, 1)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)
    frame = lambda rows: L.documents(spark.createDataFrame(rows, "id long, content string"))
    numbered = list(enumerate(texts, 1))
    late = L.latest_bm25(frame(numbered[:70]), frame(numbered[70:]), 3).collect()
    assert {(r.id, r.other): r.rank for r in late} == {k: v[0] for k, v in want.items() if k[0] > 70}
    assert L.latest_bm25(frame([]), frame([(1, "x")]), 3).count() == 0


@pytest.mark.parametrize("scope", [[], SCOPE])
def test_search_fills_by_the_ids_there_are(spark, scope):
    rows = [("c", i, "fox" if i == 130 else "dog") for i in range(100, 140)]
    d = L.documents(spark.createDataFrame(rows, "corpus string, id long, content string"), scope)
    q = spark.createDataFrame([(1, "c", "fox"), (2, "c", "cat")], "query_id long, corpus string, query string").select("query_id", *scope, "query")
    got = [(r.query_id, r.id) for r in R.search(q, d, None, SearchParams(), scope).orderBy("query_id", "rank").collect()]
    assert got == [(1, 130), *((1, i) for i in range(100, 115)), *((2, i) for i in range(100, 116))]


def test_arms_equal_single_searches(spark):
    d = docs(spark, ["red fox", "blue fox", "green", "dog"])
    trans = A.transitions(E.adjacency(E.fold(spark.createDataFrame([("c", 1, 1, 3, 0), ("c", 2, 3, 4, 0)], "corpus string, seq long, a long, b long, tick long"), FLAT, SCOPE), SCOPE), 0, FLAT, SCOPE)
    q = asked(spark, "fox", "nothing")
    c = R.components(q, d, trans, SearchParams(), SCOPE)
    arms = R.fused_arms(q, d, c, SearchParams(budget=3), {"x": 0.0, "y": 0.7}, SCOPE).collect()
    for name, w in (("x", 0.0), ("y", 0.7)):
        one = R.search(q, d, trans, SearchParams(budget=3, graph_weight=w), SCOPE).collect()
        assert {(r.query_id, r.id, r.rank, r.score) for r in arms if r.arm == name} == {(r.query_id, r.id, r.rank, r.score) for r in one}


def test_names_that_cannot_be_used(spark):
    rows = [("c", "Ann", "Ann"), ("c", "Bob", "Bob"), ("c", "Bob", "ann "), ("c", "Cy", "seer"), ("c", "Dee", " "), ("c", "Dee", "dee"), ("c", None, "x")]
    names = spark.createDataFrame(rows, "corpus string, entity string, alias string")
    turns = spark.createDataFrame([("c", 1, "Ann"), ("c", 2, "Zed"), ("c", 3, None)], "corpus string, id long, speaker string")
    got = {(r.problem, r.name) for r in N.problems(names, turns, SCOPE).collect()}
    assert got == {("ambiguous", "ann"), ("undeclared", "cy"), ("blank", ""), ("blank", "x"), ("unknown speaker", "zed")}
    with pytest.raises(ValueError, match="ambiguous"):
        N.checked_names(names.where("entity IN ('Ann', 'Bob')"), None, SCOPE)
    sound = names.where("alias IN ('Ann', 'Bob')")
    assert N.checked_names(sound, turns.where("id = 1"), SCOPE).count() == 2


def test_names_with_marks_are_found(spark):
    names = N.names(spark.createDataFrame([("c", "a\\Eb", "a\\Eb"), ("c", "c++", "c++"), ("c", "o.k", "o.k")], "corpus string, entity string, alias string"), SCOPE)
    texts = spark.createDataFrame([("c", 1, "say A\\EB now"), ("c", 2, "use C++ here"), ("c", 3, "oxk and ok")], "corpus string, id long, body string")
    assert {(r.id, r.key) for r in N.matches(texts, names, SCOPE, ["id"], "body").collect()} == {(1, "a\\eb"), (2, "c++")}


def test_ablation_arms(spark):
    t = spark.createDataFrame([("c", i, s, b) for i, (s, b) in enumerate([("Ann", "the red fox"), ("Bob", "a blue fox"), ("Ann", "green tea"), ("Bob", "fox and tea for Ann")], 1)], "corpus string, id long, speaker string, body string").withColumn("content", F.concat("speaker", F.lit(": "), "body"))
    known = N.names(t.select("corpus", F.col("speaker").alias("entity"), F.col("speaker").alias("alias")), SCOPE)
    roles = N.links(t, known)
    routed = N.route(asked(spark, "which fox did Ann see", "fox"), known, roles)
    trans = A.transitions(E.adjacency(E.fold(spark.createDataFrame([("c", 1, 1, 3, 0)], "corpus string, seq long, a long, b long, tick long"), FLAT, SCOPE), SCOPE), 0, FLAT, SCOPE)
    arms = N.ablation_arms(routed, L.documents(t, SCOPE), L.documents(t, SCOPE, "body"), trans, roles).collect()
    assert len({r.arm for r in arms}) == 7 and {r.query_id for r in arms} == {1}
    of = lambda arm: [r.id for r in sorted(arms, key=lambda r: r["rank"]) if r.arm == arm]
    gated = N.entity_search(routed, L.documents(t, SCOPE), L.documents(t, SCOPE, "body"), trans, roles).where("query_id = 1").orderBy("rank").collect()
    assert of("body_stripped_gated") == [r.id for r in gated] and set(of("body_stripped_gated")) == {1, 3, 4} and len(of("adjacency")) == 4
