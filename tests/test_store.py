"""Streams, snapshots, checkpoints, the managed store, its service and the configuration."""

import io
import json
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from hebbspark.operators import edges as E
from hebbspark.params import ConfigError, EdgeParams, MemoryConfig, edge_table_capacity
from hebbspark.operators.lifecycle import QuotaExceeded
from hebbspark.sources import dialogue, results, service, snapshot
from hebbspark.sources.managed import InvalidRequest, ManagedMemory
from hebbspark.sources.memory import Memory, MemoryAgent
from hebbspark.streaming import fold as S

HALF = EdgeParams(lam=0.5)
EVENTS = "seq long, a long, b long, tick long"


def log(seed, n):
    rng = random.Random(seed)
    return [(i + 1, rng.randint(0, 4), rng.randint(0, 4), rng.randint(0, 9)) for i in range(n)]


def same(x, y):
    a, b = ({(r.a, r.b): (round(r.weight, 9), r.last_tick, r.events) for r in df.collect()} for df in (x, y))
    assert a == b and a


def test_merge_fold_is_one_fold(spark):
    rows = log(1, 120)
    whole = E.fold(spark.createDataFrame(rows, EVENTS), HALF)
    state = spark.createDataFrame([], S.STATE)
    for at in range(0, 120, 40):
        state = S.merge_fold(state, spark.createDataFrame(rows[at : at + 40], EVENTS), HALF, block=16)
    same(state, whole)


def test_streams(spark, tmp_path):
    rows = log(2, 90)
    for k in range(3):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole = E.fold(spark.createDataFrame(rows, EVENTS), HALF)
    sink = S.FoldSink(spark, str(tmp_path / "state"), HALF, publish_every=2)
    same(S.run_available(source(), sink, str(tmp_path / "offsets")), whole)
    assert sink.snapshot().count() == E.freeze(whole, 9, HALF).count()
    sink(spark.createDataFrame(rows, EVENTS), 0)  # a batch that was folded already
    same(sink.state(), whole)
    q = S.stateful_fold(source(), HALF).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "o2")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("SELECT a, b, max_by(weight, events) AS weight, max_by(last_tick, events) AS last_tick, max(events) AS events FROM folded GROUP BY a, b")
    same(last, whole)


def test_stateful_groups(spark, tmp_path):
    """Many edges share a row of the state store, and so a call of Python: repeated and late rows, edges that come back, new ones."""
    rng = random.Random(7)
    rows = [(i + 1, rng.randint(0, 40), rng.randint(0, 40), rng.randint(0, 30)) for i in range(3000)]
    for k in range(3):
        part = rows[k * 1000 : k * 1000 + 1000]
        spark.createDataFrame(part + part[:50], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.stateful_fold(source, HALF, groups=8).writeStream.outputMode("update").format("memory").queryName("grouped").option("checkpointLocation", str(tmp_path / "o")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 8
    last = spark.sql("SELECT a, b, max_by(weight, events) AS weight, max_by(last_tick, events) AS last_tick, max(events) AS events FROM grouped GROUP BY a, b")
    same(last, E.fold(spark.createDataFrame(rows, EVENTS), HALF))


def test_pair_stream(spark):
    df = spark.createDataFrame([(1, 5, [3, 1, 3, 0, 2]), (2, 6, [4]), (3, 6, None)], "seq long, tick long, nodes array<long>")
    assert {(r.a, r.b) for r in S.pair_stream(df).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_snapshot_integrity(spark, tmp_path):
    adj = snapshot.snapshot_of(E.fold(spark.createDataFrame([(1, 1, 2, 3), (2, 2, 3, 3)], EVENTS), HALF))
    snapshot.save_snapshot(adj, str(tmp_path / "s"), 2)
    assert snapshot.load_snapshot(spark, str(tmp_path / "s")).count() == 4
    adj.where("NOT (src = 1 AND dst = 2)").write.parquet(str(tmp_path / "t"))
    with pytest.raises(snapshot.StorageError):
        snapshot.load_snapshot(spark, str(tmp_path / "t"))


def config(tmp_path, **sections):
    return MemoryConfig({"storage": {"path": str(tmp_path / "m")}, **sections})


def test_managed_memory(spark, tmp_path):
    m = ManagedMemory(spark, config(tmp_path, graph={"edge_policy": "adjacent", "lambda": 0.0}))
    assert m.remember("alpha amber", "ann") == {"id": 1, "tick": 0, "evicted_ids": []}
    m.remember_all([("beta blue", None), ("alpha beta amber blue", "bob")])
    assert {(r.a, r.b) for r in m.events().collect()} == {(1, 2), (2, 3)}
    m.advance()
    m.remember("gamma", None)
    assert m.events().count() == 2
    got = m.recall("alpha", 2)
    assert [r["id"] for r in got["records"]] == [1, 3] or [r["id"] for r in got["records"]] == [3, 1]
    assert m.recall("alpha", 2, "none")["records"] == []
    assert got["retrieval"]["seeds"] == [1, 3] and {r["id"] for r in got["retrieval"]["results"]} == {1, 3}
    linked = m.recall("amber", 3, hops=1)["retrieval"]["results"]
    assert {r["id"]: r["path"] for r in linked}[2] in ([1, 2], [3, 2]) and {r["id"]: r["hop"] for r in linked}[1] == 0
    assert {r["id"]: r["path"] for r in m.recall("amber", 3, hops=0)["retrieval"]["results"]}[2] is None
    for wrong in ({"hops": 9}, {"hops": True}, {"limit": 0}, {"mode": "x"}):
        with pytest.raises(InvalidRequest):
            m.recall("alpha", **wrong)
    assert m.associate([1, 4])["pairs_reinforced"] == 1 and m.get(4)["content"] == "gamma" and m.get(77) is None
    assert [r["id"] for r in m.many([4, 99, 1, 4])] == [4, 1, 4] and m.many([]) == []
    for bad in ([1], [1, 1], [1, 99], "x"):
        with pytest.raises(InvalidRequest):
            m.associate(bad)
    before = {(r.a, r.b): r.weight for r in m.edges().collect()}
    m.checkpoint()
    again = ManagedMemory(spark, m.config)
    assert again.recovery == "checkpoint" and {(r.a, r.b): r.weight for r in again.edges().collect()} == before
    assert m.forget(2) == {"forgotten": True, "id": 2} and m.forget(2) == {"forgotten": False, "id": 2}
    assert {(r.a, r.b) for r in m.events().collect()} == {(1, 4)} and ManagedMemory(spark, m.config).recovery == "replay"
    assert m.compact()["parts_after"] == 2 and m.stats()["records"] == 3
    with pytest.raises(ConfigError):
        ManagedMemory(spark, config(tmp_path, graph={"edge_policy": "adjacent", "lambda": 0.1}))
    other = ManagedMemory(spark, config(tmp_path, graph={"edge_policy": "star", "lambda": 0.0}))
    assert other.stats()["records"] == 3
    with pytest.raises(ConfigError):
        m.stats()


def test_writers_that_meet_lose_nothing(spark, tmp_path):
    c = config(tmp_path)
    two = [ManagedMemory(spark, c), ManagedMemory(spark, c)]
    with ThreadPoolExecutor(2) as pool:
        ids = [i for part in pool.map(lambda m: [m.remember(f"writer memory {k}")["id"] for k in range(3)], two) for i in part]
    assert sorted(ids) == [1, 2, 3, 4, 5, 6] and two[0].stats()["records"] == 6
    two[0].forget(1)
    assert two[1].get(1) is None


def test_a_crash_between_revisions_leaves_the_last_one(spark, tmp_path):
    m = ManagedMemory(spark, config(tmp_path))
    m.remember("kept")
    (tmp_path / "m" / "memory-000000000099.json.abc.tmp").write_text("half")
    m._part("records", spark.createDataFrame([], "id long"))
    assert ManagedMemory(spark, m.config).stats()["records"] == 1


def test_quotas(spark, tmp_path):
    m = ManagedMemory(spark, config(tmp_path, limits={"max_text_bytes": 12, "max_record_bytes": 12}, retention={"overflow": "oldest"}))
    for text, writer in (("x" * 13, ""), ("x" * 10, "abc")):
        with pytest.raises(QuotaExceeded):
            m.remember(text, writer)
    assert m.remember("ééé")["id"] == 1 and m.remember("β" * 6)["evicted_ids"] == [1]
    rng = random.Random(1)
    d = ManagedMemory(spark, config(tmp_path / "d", storage={"path": str(tmp_path / "d"), "max_database_bytes": 65536}, limits={"max_record_bytes": 20000}))
    accepted = 0
    with pytest.raises(QuotaExceeded):
        for _ in range(20):
            d.remember("".join(chr(rng.randint(33, 120)) for _ in range(16000)))
            accepted += 1
    assert 0 < accepted < 20 and d.stats()["records"] == accepted and d.stats()["database_bytes"] <= 65536


def test_growth_and_edge_quota(spark, tmp_path):
    m = ManagedMemory(spark, config(tmp_path, graph={"initial_capacity": 2, "max_capacity": 32}))
    for i in range(5):
        m.remember(f"shared token {i}")
    s = m.stats()
    assert 2 < s["capacity"] <= 32 and s["inserts"] <= s["capacity"] and ManagedMemory(spark, m.config).stats()["capacity"] == s["capacity"]
    f = ManagedMemory(spark, config(tmp_path, storage={"path": str(tmp_path / "f")}, graph={"initial_capacity": 2, "max_capacity": 2, "allow_growth": False}))
    f.remember("shared a")
    f.remember("shared b")
    with pytest.raises(QuotaExceeded):
        f.remember("shared c")
    assert f.stats()["records"] == 2


def test_edges_are_folded_once_for_a_revision(spark, tmp_path, monkeypatch):
    from hebbspark.sources import managed

    m = ManagedMemory(spark, config(tmp_path))
    m.remember_all([("one two", None), ("two three", None)])
    m.edges()
    monkeypatch.setattr(managed.E, "fold", lambda *a, **k: pytest.fail("folded again"))
    m.recall("two")
    m.remember("three four")
    got = {(r.a, r.b): r.events for r in m.edges().collect()}
    monkeypatch.undo()
    assert got == {(r.a, r.b): r.events for r in E.fold(m.events(), m.config.edges).collect()}
    m.close()
    assert not list((tmp_path / "m").glob("published-*"))


def test_damaged_checkpoint_is_not_used(spark, tmp_path):
    m = ManagedMemory(spark, config(tmp_path))
    m.remember_all([("one two", None), ("two three", None)])
    made = m.checkpoint()
    assert m._checkpoint_state()
    spark.createDataFrame([(7, 8, 1.0, 1, 1)], "a long, b long, weight double, last_tick long, events long").write.mode("overwrite").parquet(f"{m.folder}/checkpoint/{made['generation']}/edges")
    assert m._checkpoint_state() is None and m.edges().count() == 1


def test_the_slower_writer_fails(spark, tmp_path):
    m = ManagedMemory(spark, config(tmp_path))
    stale = m._meta()
    m.remember("first")
    with pytest.raises(snapshot.StorageError):
        m._commit(stale)
    assert m.stats()["records"] == 1


def test_eviction_and_ttl(spark, tmp_path):
    m = ManagedMemory(spark, config(tmp_path, limits={"max_nodes": 2}, retention={"overflow": "oldest", "ttl_ticks": 2}))
    m.remember_all([("a", None), ("b", None)])
    assert m.remember("c") == {"id": 3, "tick": 0, "evicted_ids": [1]}
    assert m.advance(2)["expired_ids"] == [2, 3]


def test_service(spark, tmp_path):
    m = ManagedMemory(spark, config(tmp_path, limits={"max_request_bytes": 1024, "max_record_bytes": 50}))
    lines = [
        {"id": 1, "method": "remember", "params": {"text": "hello"}},
        {"id": 2, "method": "get", "params": {"id": 1}},
        {"id": 3, "method": "drop", "params": {}},
        {"id": 4, "method": "remember", "params": {"text": "x" * 60}},
        {"id": 5, "method": "get", "params": {"nope": 1}},
    ]
    raw = b"\n".join(json.dumps(x).encode() for x in lines) + b"\nnot json\n" + b"y" * 3000 + b"\n" + b'{"id": 6, "method": "stats"}\n'
    out = io.BytesIO()
    service.serve(m, io.BytesIO(raw), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["ok"] for g in got] == [True, True, False, False, False, False, False, True]
    assert [g["error"]["code"] for g in got if not g["ok"]] == ["invalid_request", "quota_exceeded", "invalid_request", "invalid_json", "request_too_large"]
    bulk = service.parse_requests(spark.createDataFrame([(json.dumps(x),) for x in lines] + [("nope",)], "value string"))
    assert [r.error for r in bulk.collect()] == [None, None, "invalid_request", None, None, "invalid_json"]


class Echo:
    def structured(self, prompt, schema):
        self.prompt = prompt
        return {"answer": "seen", "citations": [], "abstained": False}


def test_memory_in_ram_and_agent(spark):
    with Memory(spark, EdgeParams(lam=0.0)) as m:
        agent = MemoryAgent(m, Echo())
        a = agent.observe("Mira calls her token the silver pebble", "ann")
        b = agent.observe("The silver pebble is in the blue drawer")
        m.advance()
        c = agent.observe("Lunch is soup")
        assert [a, b, c] == [1, 2, 3] and {(r.a, r.b) for r in m.edges().collect()} == {(1, 2)}
        assert [e.id for e in m.recall("silver", 2)] == ["2", "1"] and m.recall("silver", 0) == []
        assert {(r.a, r.b): r.weight for r in m.edges().collect()} == {(1, 2): 2.0}
        before = m.stats()
        out = agent.ask("Mira", budget=2)
        assert [e["id"] for e in out["evidence"]] == ["1", "2"] and out["retrieval"]["results"][1]["path"] == [1, 2] and m.stats() == before and before["nodes"] == 3
        assert '"silver pebble"' not in agent.provider.prompt and "Mira" in agent.provider.prompt and "ann" not in agent.provider.prompt.split("evidence:")[1].replace("drawer", "")
        assert [e.id for e in agent.context("Mira", "connected", 2)[0]] == ["1", "2"] and agent.context("Mira", "none") == ([], {})
        new = m.supersede(1, "Mira calls her token the red stone")
        assert new == 4 and "1" not in {e.id for e in m.recall("Mira token")} and m.records().where("id = 1").first().valid_to == m.tick
        hidden = m.remember("Mira may own a pebble", layer=1)
        assert str(hidden) not in {e.id for e in m.recall("Mira")}
        m.promote([hidden])
        assert str(hidden) in {e.id for e in m.recall("Mira")}
        assert m.axis([1, 2, 3])[0] and m.sectors(1) == [] and isinstance(m.unexplored("pebble"), list)
        for wrong in (lambda: agent.context("x", "y"), lambda: m.supersede(99, "x")):
            with pytest.raises(InvalidRequest):
                wrong()
    for wrong in (lambda: Memory(spark, retrieval="x"), lambda: Memory(spark, graph_weight=-1), lambda: MemoryAgent(m, Echo(), "ring")):
        with pytest.raises(ValueError):
            wrong()
    e = Memory(spark, retrieval="embedding")
    e.remember("red fox")
    e.remember("blue whale")
    assert e.recall("red fox", 1)[0].id == "1"


def test_facts_and_chat(spark, tmp_path):
    m = ManagedMemory(spark, config(tmp_path))
    assert service.import_facts(m, [f"fact number {i}" for i in range(8)]) == list(range(1, 9))
    assert m.get(6)["tick"] == 0 and m.get(7)["tick"] == 1
    agent = MemoryAgent(m, Echo())
    got = list(service.chat(agent, ["", "/remember the whale is blue", "/session", "whale", "/quit", "more"]))
    assert len(got) == 1 and got[0]["evidence"][0]["text"] == "the whale is blue" and m._meta()["tick"] == 2
    with pytest.raises(InvalidRequest):
        service.import_facts(m, [1])


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 0.5), (2, None, None)], "id long, text string, x double")
    results.write_lines(df, str(tmp_path / "lines"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "lines")).orderBy("id").collect() == df.collect()
    results.write_csv(df, str(tmp_path / "csv"), ["x", "text", "id"])
    back = spark.read.schema("x double, text string, id long").option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).select("id", "text", "x")
    assert back.orderBy("id").collect() == df.collect()
    results.write_document(df, str(tmp_path / "d.json"), name="n")
    assert json.loads((tmp_path / "d.json").read_text()) == {"name": "n", "rows": [r.asDict() for r in df.collect()]}
    assert results.markdown(df.select("id").withColumn("t", F.lit("a|b\nc"))) == "| id | t |\n| - | - |\n| 1 | a\\|b c |\n| 2 | a\\|b c |\n"


def test_client():
    echo = "import sys, json\nfor l in sys.stdin:\n r = json.loads(l)\n print(json.dumps({'id': r['id'], 'ok': r['method'] != 'bad', 'result': 7, 'error': {'code': 'c', 'message': ''}}), flush=True)"
    c = service.MemoryClient(["python", "-c", echo], timeout=20)
    assert c.call("stats") == 7
    with pytest.raises(service.ServiceError) as e:
        c.call("bad")
    assert e.value.code == "c"
    c.close()


def test_dialogue_files(spark, tmp_path):
    sample = [{"sample_id": "s", "conversation": {"session_10": [{"dia_id": "D10:1", "speaker": "A", "text": "late"}], "session_2": [{"dia_id": "D2:1", "speaker": "B", "text": "early", "blip_caption": "cap"}], "session_2_date_time": "1 May"}, "qa": [{"question": "q?", "answer": 3, "evidence": ["D2:1"], "category": 2}]}]
    (tmp_path / "d.json").write_text(json.dumps(sample))
    s = dialogue.read_samples(spark, str(tmp_path / "d.json"))
    rows = dialogue.turns(s).orderBy("session_no").collect()
    assert [(r.session_no, r.turn_no, r.text, r.session_date_time) for r in rows] == [(2, 1, "early", "1 May"), (10, 1, "late", None)]
    assert dialogue.questions(s).first().answer == "3"
    (tmp_path / "f.json").write_text(json.dumps([f"fact {i}" for i in range(8)]))
    assert [r.tick for r in dialogue.facts(spark, str(tmp_path / "f.json")).orderBy("id").collect()] == [0] * 6 + [1] * 2


@pytest.mark.parametrize(
    "bad",
    [
        {"nope": {}},
        {"graph": {"x": 1}},
        {"graph": {"lambda": 2}},
        {"graph": {"edge_policy": "ring"}},
        {"graph": {"initial_capacity": 3}},
        {"graph": {"initial_capacity": 8, "max_capacity": 4}},
        {"limits": {"max_record_bytes": 1 << 30}},
        {"retention": {"overflow": "drop"}},
        {"retrieval": {"hops": 9}},
        {"retrieval": {"default_limit": 65}},
        {"version": 2},
    ],
)
def test_bad_configurations(bad):
    with pytest.raises(ConfigError):
        MemoryConfig(bad)


def test_configuration_file(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"version": 1, "storage": {"path": "data"}, "graph": {"lambda": 0}}))
    c = MemoryConfig.load(tmp_path / "c.json")
    assert c["storage"]["path"] == str(tmp_path / "data") and c.edges.lam == 0 and c["retrieval"]["default_limit"] == 8
    with pytest.raises(ConfigError):
        MemoryConfig.load(tmp_path / "none.json")
    assert edge_table_capacity(4) == 16


def test_entry_without_the_subpackage():
    import __spark_entry__ as entry

    assert "retrieve_associative" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
