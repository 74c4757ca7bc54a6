"""A managed memory: records and association events in a folder, versioned by manifests.

Ids are public and stable.  The tables are parquet parts.  Each revision has a
manifest of its own, which is created in one step and only if no other writer
has created it: a writer that was too slow prepares its change again on the
newer revision, and a crash leaves the last revision whole.  ``remember_all``
writes a batch in one step, ``remember`` is a batch of one.  Generated answers
never become records.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hebbspark.operators import edges as E
from hebbspark.operators import lexical as L
from hebbspark.operators import lifecycle as M
from hebbspark.operators.activate import transitions
from hebbspark.operators.evidence import fit_records
from hebbspark.operators.ranking import ordered_get
from hebbspark.operators.retrieve import components, explain, fused
from hebbspark.operators.vectors import HashEmbedder
from hebbspark.params import ConfigError, MemoryConfig, SearchParams
from hebbspark.sources.snapshot import StorageError, create_text, listed, load_checkpoint, read_text, remove, save_checkpoint, size
from hebbspark.streaming.fold import merge_fold

RECORDS = "id long, content string, writer string, tick long, bytes long, embedding array<float>"
EVENTS = "seq long, a long, b long, tick long"
#: A table of edges is full at seven tenths of its capacity.
LOAD = 0.7
ATTEMPTS = 50


class InvalidRequest(ValueError):
    pass


class Conflict(StorageError):
    """Another writer was faster."""


class ManagedMemory:
    def __init__(self, spark: SparkSession, config: MemoryConfig = MemoryConfig()):
        self.spark, self.config = spark, config
        self.folder = config["storage"]["path"].rstrip("/")
        self.embedder = HashEmbedder()
        self._published: dict | None = None
        self.recovery = "new"
        if not self._revisions():
            first = {"revision": 0, "tick": 0, "next_id": 1, "next_seq": 1, "config": config.fingerprint(), "learning": config.learning(), "capacity": config["graph"]["initial_capacity"], "removals": 0, "records": [], "events": []}
            create_text(spark, self._manifest(0), json.dumps(first))
        meta = self._meta(check=False)
        if meta["learning"] != config.learning():
            raise ConfigError("decay, gain and floor are fixed for this folder")
        if size(spark, self.folder) and self._stored(meta) > config["storage"]["max_database_bytes"]:
            raise M.QuotaExceeded("the folder exceeds the database quota")
        if meta["config"] != config.fingerprint():
            self._change(lambda m: (self._limited({**m, "config": config.fingerprint()}), None), check=False)
        if meta["revision"]:
            self.recovery = "checkpoint" if self._checkpoint_state() else "replay"

    # Tables and manifests

    def _manifest(self, revision: int) -> str:
        return f"{self.folder}/memory-{revision:012d}.json"

    def _revisions(self) -> list[str]:
        return listed(self.spark, self.folder, "memory-*.json")

    def _meta(self, check: bool = True) -> dict:
        for _ in range(ATTEMPTS):
            text = read_text(self.spark, f"{self.folder}/{self._revisions()[-1]}")
            if text is not None:  # else a writer has replaced it meanwhile
                meta = json.loads(text)
                if check and meta["config"] != self.config.fingerprint():
                    raise ConfigError("the configuration was changed elsewhere; open the memory again")
                return meta
        raise StorageError("no manifest can be read")

    def _read(self, parts: list[str], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in parts))

    def records(self, meta: dict | None = None) -> DataFrame:
        return self._read((meta or self._meta())["records"], RECORDS)

    def _log(self, meta: dict) -> DataFrame:
        return self._read(meta["events"], EVENTS)

    def events(self, meta: dict | None = None) -> DataFrame:
        meta = meta or self._meta()
        return M.with_live_ends(self._log(meta), self.records(meta))

    def _part(self, name: str, df: DataFrame) -> str:
        part = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{part}")
        return part

    def _rows(self, rows: list[tuple], schema: str) -> DataFrame:
        """The rows of one request, as one file."""
        return self.spark.createDataFrame(rows, schema).coalesce(1)

    def _stored(self, meta: dict) -> int:
        return sum(size(self.spark, f"{self.folder}/{p}") for p in [*meta["records"], *meta["events"]])

    def _commit(self, meta: dict) -> None:
        """Publish what was prepared on one revision; if another writer was faster, nothing changes."""
        new = {**meta, "revision": meta["revision"] + 1}
        old = self._revisions()
        if not create_text(self.spark, self._manifest(new["revision"]), json.dumps(new)):
            raise Conflict("another writer changed the memory")
        kept = {*new["records"], *new["events"]}
        before = json.loads(read_text(self.spark, f"{self.folder}/{old[-1]}") or "{}")
        for part in [*before.get("records", []), *before.get("events", [])]:
            if part not in kept:
                remove(self.spark, f"{self.folder}/{part}")
        for name in old[:-1]:
            remove(self.spark, f"{self.folder}/{name}")

    def _change(self, prepare: Callable[[dict], tuple[dict, object]], check: bool = True):
        """Prepare a change on the newest revision and publish it, again if another writer was faster; whatever fails leaves no part behind."""
        for attempt in range(ATTEMPTS):
            was = self._meta(check)
            meta, parts = was, []
            try:
                meta, out = prepare(dict(was))
                parts = [p for p in [*meta["records"], *meta["events"]] if p not in {*was["records"], *was["events"]}]
                if parts and self._stored(meta) > self.config["storage"]["max_database_bytes"]:
                    raise M.QuotaExceeded("the database quota is reached")
                self._commit(meta)
                return out
            except Conflict:
                self._drop(parts)
                if attempt == ATTEMPTS - 1:
                    raise
            except Exception:
                self._drop(parts)
                raise

    def _drop(self, parts: list[str]) -> None:
        for part in parts:
            remove(self.spark, f"{self.folder}/{part}")

    # Writes

    def _limited(self, meta: dict) -> dict:
        """The manifest after time to live and quotas, for records that are there already."""
        limits, keep = self.config["limits"], self.config["retention"]
        held = self.records(meta)
        kept = M.enforce(held, meta["tick"], keep["ttl_ticks"], limits["max_nodes"], limits["max_text_bytes"], keep["overflow"])
        if kept is held or kept.count() == held.count():
            return meta
        return self._without(meta, kept)

    def _without(self, meta: dict, kept: DataFrame) -> dict:
        """The manifest with these records only; the events of the others go."""
        records = [self._part("records", kept)]
        left = M.with_live_ends(self._log(meta), self._read(records, RECORDS))
        return {**meta, "records": records, "events": [self._part("events", left)], "removals": meta["removals"] + 1}

    def _grown(self, meta: dict) -> dict:
        """The manifest with a capacity that holds all edges; beyond the largest capacity it is an error."""
        graph = self.config["graph"]
        capacity = max(graph["initial_capacity"], min(meta["capacity"], graph["max_capacity"]))
        # The events bound the edges: they are counted only where that says nothing.
        if meta["next_seq"] - 1 > capacity * LOAD:
            edges = E.canonical(self._log(meta)).select("a", "b").distinct().count()
            while edges > capacity * LOAD:
                if not graph["allow_growth"] or capacity >= graph["max_capacity"]:
                    raise M.QuotaExceeded("the edge quota is reached")
                capacity *= 2
        return {**meta, "capacity": capacity}

    def remember(self, text: str, writer: str | None = "") -> dict:
        """``{id, tick, evicted_ids}``."""
        return self.remember_all([(text, writer)])[0]

    def remember_all(self, items: list[tuple[str, str | None]]) -> list[dict]:
        """Records of the current tick in order, linked by the policy to what was there before each of them."""
        limits = self.config["limits"]
        sized = []
        for text, writer in items:
            if not isinstance(text, str) or not text.strip():
                raise InvalidRequest("a record needs a text")
            if writer is not None and not isinstance(writer, str):
                raise InvalidRequest("a writer is a text")
            sized.append(len(text.encode()) + len((writer or "").encode()))
            if sized[-1] > limits["max_record_bytes"]:
                raise M.QuotaExceeded("the record is too long")
        vectors = self.embedder.encode([t for t, _ in items])

        def prepare(meta: dict) -> tuple[dict, list[dict]]:
            first, tick = meta["next_id"], meta["tick"]
            rows = [(first + i, t, w, tick, n, [float(x) for x in v]) for i, ((t, w), n, v) in enumerate(zip(items, sized, vectors))]
            new = self._rows(rows, RECORDS)
            held, gone = self.records(meta), []
            if self._over(meta, len(items), sum(sized)):
                everything, keep = held.unionByName(new), self.config["retention"]
                kept = M.enforce(everything, tick, keep["ttl_ticks"], limits["max_nodes"], limits["max_text_bytes"], keep["overflow"])
                gone = [r.id for r in everything.select("id").join(kept.select("id"), "id", "left_anti").orderBy("id").collect()]
                if gone:
                    meta = self._without(meta, kept)
                    held = self.records(meta).where(F.col("id") < first)
            if not gone:
                meta = {**meta, "records": [*meta["records"], self._part("records", new)]}
            pairs = self._pairs(held, new, [r[0] for r in rows], tick)
            if pairs:
                events = [(meta["next_seq"] + i, a, b, tick) for i, (_, a, b) in enumerate(pairs)]
                meta = {**meta, "events": [*meta["events"], self._part("events", self._rows(events, EVENTS))]}
            meta = self._grown({**meta, "next_id": first + len(items), "next_seq": meta["next_seq"] + len(pairs)})
            return meta, [{"id": r[0], "tick": tick, "evicted_ids": gone if i == len(rows) - 1 else []} for i, r in enumerate(rows)]

        return self._change(prepare)

    def _over(self, meta: dict, more: int, nbytes: int) -> bool:
        """Whether the quotas must be looked at."""
        limits = self.config["limits"]
        totals = M.quota_totals(self.records(meta)).first()
        return totals.records + more > limits["max_nodes"] or totals.bytes + nbytes > limits["max_text_bytes"]

    def _pairs(self, held: DataFrame, new: DataFrame, ids: list[int], tick: int) -> list[tuple[int, int, int]]:
        """(seq, a, b) of the edge policy for the records of one request: the one before in the tick, and up to three similar ones."""
        policy = self.config["graph"]["edge_policy"]
        previous = held.where(F.col("tick") == tick).agg(F.max("id")).first()[0]
        near: dict[int, list[int]] = {}
        if policy != "adjacent":
            docs = lambda df: L.documents(df.select("id", "content"))
            for r in L.latest_bm25(docs(held), docs(new), 3).collect():  # at most three for each new record
                near.setdefault(r.id, []).append(r.other)
        out = []
        for n in ids:
            around = sorted({*near.get(n, []), *([previous] if previous is not None else [])})
            if policy == "combined":
                active = sorted([*around, n])
                out += [(n, a, b) for i, a in enumerate(active) for b in active[i + 1 :]]
            else:
                out += [(n, min(a, n), max(a, n)) for a in around]
            previous = n
        return out

    def associate(self, ids: list[int]) -> dict:
        """Link 2 to 64 distinct records of the memory with each other."""
        if not isinstance(ids, list) or not all(isinstance(i, int) and not isinstance(i, bool) and i > 0 for i in ids) or not 2 <= len(ids) <= 64 or len(set(ids)) != len(ids):
            raise InvalidRequest("associate takes 2 to 64 distinct ids")

        def prepare(meta: dict) -> tuple[dict, dict]:
            if self.records(meta).where(F.col("id").isin(ids)).count() != len(ids):
                raise InvalidRequest("unknown id")
            ordered = sorted(ids)
            pairs = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :]]
            rows = [(meta["next_seq"] + i, a, b, meta["tick"]) for i, (a, b) in enumerate(pairs)]
            meta = {**meta, "events": [*meta["events"], self._part("events", self._rows(rows, EVENTS))], "next_seq": meta["next_seq"] + len(rows)}
            return self._grown(meta), {"pairs_reinforced": len(rows), "tick": meta["tick"]}

        return self._change(prepare)

    def forget(self, id: int) -> dict:
        """``{forgotten, id}``: whether the record was there; its events go with it."""
        if not isinstance(id, int) or isinstance(id, bool) or id <= 0:
            raise InvalidRequest("an id is a positive number")
        if not self.get(id):
            return {"forgotten": False, "id": id}
        return self._change(lambda meta: (self._without(meta, self.records(meta).where(F.col("id") != id)), {"forgotten": True, "id": id}))

    def advance(self, steps: int = 1) -> dict:
        if not isinstance(steps, int) or isinstance(steps, bool) or steps < 1:
            raise InvalidRequest("steps must be positive")

        def prepare(meta: dict) -> tuple[dict, dict]:
            now, ttl = meta["tick"] + steps, self.config["retention"]["ttl_ticks"]
            if now >= 1 << 32:
                raise InvalidRequest("the last tick is reached")
            over = [r.id for r in M.expired(self.records(meta), now, ttl).orderBy("id").collect()] if ttl else []
            meta = {**meta, "tick": now}
            if over:
                meta = self._without(meta, M.unexpired(self.records(meta), now, ttl))
            return meta, {"tick": now, "expired_ids": over}

        return self._change(prepare)

    # Reads

    def get(self, id: int) -> dict | None:
        if not isinstance(id, int) or isinstance(id, bool) or id <= 0:
            raise InvalidRequest("an id is a positive number")
        r = self.records().where(F.col("id") == id).drop("embedding").first()
        return r.asDict() if r else None

    def many(self, ids: list[int]) -> list[dict]:
        """The records of these ids in their order, repeats kept, unknown ids left out."""
        asked = self.spark.createDataFrame([(list(ids),)], "ids array<long>").withColumn("request", F.lit(1))
        got = ordered_get(asked, self.records().drop("embedding"), ["request"]).orderBy("place").drop("request", "place")
        return [r.asDict() for r in got.collect()]

    def edges(self) -> DataFrame:
        """The folded edges of the newest revision.

        They are folded once for a revision.  If only events were added since
        the last time, those alone are folded, onto the edges that were known.
        """
        meta = self._meta()
        was = self._published
        if was and was["events"] == meta["events"] and was["removals"] == meta["removals"]:
            return was["edges"]
        state = self._checkpoint_state(meta)
        p = self.config.edges
        if state:
            edges = state["edges"]
        elif was and was["removals"] == meta["removals"] and meta["events"][: len(was["events"])] == was["events"]:
            edges = merge_fold(was["edges"], self._read(meta["events"][len(was["events"]) :], EVENTS), p)
        else:
            edges = E.fold(self.events(meta), p)
        part = self._part("published", edges.select("a", "b", "weight", "last_tick", "events"))
        if was:
            remove(self.spark, f"{self.folder}/{was['part']}")
        edges = self.spark.read.schema("a long, b long, weight double, last_tick long, events long").parquet(f"{self.folder}/{part}")
        self._published = {"events": meta["events"], "removals": meta["removals"], "edges": edges, "part": part}
        return edges

    def close(self) -> None:
        """Remove what was kept for this instance alone."""
        if self._published:
            remove(self.spark, f"{self.folder}/{self._published['part']}")
            self._published = None

    def recall(self, query: str, limit: int | None = None, mode: str = "associative", hops: int | None = None) -> dict:
        """Ranked records that fit the context budget, the ids that did not, and how they were found.

        ``retrieval`` has the seeds and, for each result, scores, hop and path
        from a seed, and whether the graph brought it in.
        """
        if not isinstance(query, str) or not query.strip():
            raise InvalidRequest("recall needs a query")
        find, p = self.config["retrieval"], self.config.edges
        if mode not in ("none", "lexical", "associative"):
            raise InvalidRequest("unknown mode")
        limit, hops = find["default_limit"] if limit is None else limit, find["hops"] if hops is None else hops
        if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= find["max_limit"]:
            raise InvalidRequest("limit out of range")
        if not isinstance(hops, int) or isinstance(hops, bool) or not 0 <= hops <= 8:
            raise InvalidRequest("hops must be from 0 to 8")
        out = {"records": [], "omitted_ids": [], "context_bytes_limit": find["max_context_bytes"], "retrieval": {}}
        if mode == "none":
            return out
        meta = self._meta()
        held = self.records(meta)
        docs = L.documents(held)
        asked = self.spark.createDataFrame([(1, query)], "query_id long, query string")
        s = SearchParams(limit, hops, 8, find["graph_weight"] if mode == "associative" else 0)
        trans = transitions(E.adjacency(E.freeze(self.edges(), meta["tick"], p)), meta["tick"], p) if s.graph_weight else None
        c = components(asked, docs, trans, s)
        hits = explain(asked, docs, trans, s, c=c) if trans is not None else fused(asked, docs, c, s)
        hits = hits.join(held.select("id", F.col("content").alias("text"), "writer", "tick"), "id").persist()
        rows = [r.asDict() for r in hits.orderBy("rank").collect()]  # at most limit rows
        kept = {r.id for r in fit_records(hits.select("query_id", "id", "text", F.col("rank").cast("long").alias("rank")), ["query_id"], find["max_context_bytes"], limit).collect()}
        shown = ("id", "text", "writer", "tick", "score", "rank")
        out["records"] = [{k: r[k] for k in shown} for r in rows if r["id"] in kept]
        out["omitted_ids"] = [r["id"] for r in rows if r["id"] not in kept]
        traced = ("id", "lexical", "association", "score", "added_by_graph", "hop", "path")
        out["retrieval"] = {"seeds": [r.node for r in c.seeds.orderBy(F.col("weight").desc(), "node").collect()], "results": [{k: r[k] for k in traced if k in r} for r in rows]}
        return out

    def context(self, query: str, limit: int | None = None, mode: str = "associative", hops: int | None = None) -> list[tuple[str, str]]:
        return [(str(r["id"]), r["text"]) for r in self.recall(query, limit, mode, hops)["records"]]

    def stats(self) -> dict:
        meta = self._meta()
        totals = M.quota_totals(self.records(meta)).first()
        graph = E.stats(self.edges(), meta["tick"], self.config.edges, meta["capacity"]).first().asDict()
        return {
            "records": totals.records,
            "bytes": totals.bytes,
            "database_bytes": self._stored(meta),
            "events": self._log(meta).count(),
            "tick": meta["tick"],
            "revision": meta["revision"],
            "recovery": self.recovery,
            "capacity": meta["capacity"],
            **graph,
        }

    # Checkpoints

    def _expected(self, meta: dict) -> dict:
        return {"version": 1, "revision": meta["revision"], "tick": meta["tick"], "learning": meta["learning"], "capacity": meta["capacity"]}

    def _checkpoint_state(self, meta: dict | None = None) -> dict | None:
        return load_checkpoint(self.spark, f"{self.folder}/checkpoint", self._expected(meta or self._meta()))

    def checkpoint(self) -> dict:
        """Save records, events and edges of this revision; the tables stay the authority."""
        meta = self._meta()
        events = self.events(meta)
        out = save_checkpoint(self.spark, f"{self.folder}/checkpoint", self.records(meta), events, E.fold(events, self.config.edges), self._expected(meta), self.config["storage"]["max_checkpoint_bytes"])
        return {"generation": out["generation"], "revision": out["revision"]}

    def compact(self) -> dict:
        """Rewrite the parts as one each, without events of forgotten records."""

        def prepare(meta: dict) -> tuple[dict, dict]:
            before = len(meta["records"]) + len(meta["events"])
            records, events = [self._part("records", self.records(meta))], [self._part("events", self.events(meta))]
            return {**meta, "records": records, "events": events}, {"parts_before": before, "parts_after": 2}

        return self._change(prepare)
