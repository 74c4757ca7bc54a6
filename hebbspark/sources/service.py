"""Newline-delimited JSON service over a managed memory, its client, and the command line."""

from __future__ import annotations

import argparse
import importlib
import json
import queue
import subprocess
import sys
import threading
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hebbspark.operators.evidence import AnswerProvider
from hebbspark.operators.lifecycle import QuotaExceeded
from hebbspark.params import ConfigError, MemoryConfig
from hebbspark.sources.managed import InvalidRequest, ManagedMemory
from hebbspark.sources.memory import MemoryAgent
from hebbspark.sources.snapshot import StorageError

# The verbs, the parameters each may have, and the error codes.
VERBS = {
    "remember": {"text", "writer"},
    "recall": {"query", "limit", "mode", "hops"},
    "get": {"id"},
    "forget": {"id"},
    "associate": {"ids"},
    "advance": {"steps"},
    "stats": set(),
    "checkpoint": set(),
    "compact": set(),
}
CODES = ((QuotaExceeded, "quota_exceeded"), (ConfigError, "config_error"), (StorageError, "storage_error"), (InvalidRequest, "invalid_request"), (TypeError, "invalid_request"))


def dispatch(memory: ManagedMemory, method: str, params: dict):
    if method not in VERBS or not isinstance(params, dict) or not set(params) <= VERBS[method]:
        raise InvalidRequest("unknown method or parameter")
    return getattr(memory, method)(**params)


def respond(memory: ManagedMemory, request) -> dict:
    """The response to one parsed request: ``{id, ok, result}`` or ``{id, ok, error}`` with a code."""
    number = request.get("id") if isinstance(request, dict) else None
    try:
        if not isinstance(request, dict) or not set(request) <= {"id", "method", "params"}:
            raise InvalidRequest("a request is an object with id, method and params")
        return {"id": number, "ok": True, "result": dispatch(memory, request.get("method"), request.get("params", {}))}
    except Exception as e:  # noqa: BLE001 - every failure becomes a response
        code = next((c for t, c in CODES if isinstance(e, t)), "storage_error")
        return {"id": number, "ok": False, "error": {"code": code, "message": str(e)[:200]}}


def serve(memory: ManagedMemory, source: IO[bytes], sink: IO[bytes], max_bytes: int | None = None) -> None:
    """One response line per request line; lines over the limit are drained and answered with a code."""
    limit = max_bytes or memory.config["limits"]["max_request_bytes"]
    while line := source.readline(limit + 1):
        if len(line) > limit and not line.endswith(b"\n"):
            while (rest := source.readline(limit + 1)) and not rest.endswith(b"\n"):
                pass
            answer = {"id": None, "ok": False, "error": {"code": "request_too_large", "message": ""}}
        elif not line.strip():
            continue
        else:
            try:
                answer = respond(memory, json.loads(line))
            except ValueError:
                answer = {"id": None, "ok": False, "error": {"code": "invalid_json", "message": ""}}
        sink.write(json.dumps(answer, ensure_ascii=False).encode() + b"\n")
        sink.flush()


REQUEST = T.StructType([T.StructField("id", T.LongType()), T.StructField("method", T.StringType()), T.StructField("params", T.MapType(T.StringType(), T.StringType()))])


def parse_requests(lines: DataFrame, max_bytes: int = 64 << 10, text: str = "value") -> DataFrame:
    """(id, method, params, error) of request lines in bulk, batch or stream."""
    request = F.from_json(text, REQUEST)
    size = F.octet_length(F.col(text))
    known = F.coalesce(F.col("r.method").isin(*VERBS), F.lit(False))
    error = F.when(size > max_bytes, "request_too_large").when(F.col("r").isNull() | (F.col("r.id").isNull() & F.col("r.method").isNull()), "invalid_json").when(~known, "invalid_request")
    return lines.withColumn("r", request).withColumn("error", error).select("r.id", "r.method", "r.params", "error")


class ServiceError(RuntimeError):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}")
        self.code = code


class MemoryClient:
    """Calls a service process; responses are matched by request id, and a late one ends the process."""

    def __init__(self, command: Sequence[str], timeout: float = 120.0):
        self.timeout, self._next = timeout, 0
        self._process = subprocess.Popen(list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        self._lines: queue.Queue[bytes] = queue.Queue()
        threading.Thread(target=self._pump, daemon=True).start()

    def _pump(self) -> None:
        for line in self._process.stdout:
            self._lines.put(line)
        self._lines.put(b"")

    def call(self, method: str, **params):
        self._next += 1
        self._process.stdin.write(json.dumps({"id": self._next, "method": method, "params": params}).encode() + b"\n")
        self._process.stdin.flush()
        try:
            line = self._lines.get(timeout=self.timeout)
        except queue.Empty:
            self.close()
            raise ServiceError("timeout") from None
        if not line:
            raise ServiceError("closed")
        answer = json.loads(line)
        if answer.get("id") != self._next:
            self.close()
            raise ServiceError("mismatch")
        if not answer["ok"]:
            raise ServiceError(answer["error"]["code"], answer["error"]["message"])
        return answer["result"]

    def close(self) -> None:
        self._process.kill()
        self._process.wait()


#: Facts of an imported list that share a tick.
FACTS_A_TICK = 6


def import_facts(memory: ManagedMemory, facts: Sequence[str]) -> list[int]:
    """Remember a list of observations, a new tick after every six; their ids."""
    if not isinstance(facts, list) or not all(isinstance(x, str) for x in facts):
        raise InvalidRequest("facts are a list of texts")
    ids: list[int] = []
    for at in range(0, len(facts), FACTS_A_TICK):
        if at:
            memory.advance()
        ids += [r["id"] for r in memory.remember_all([(x, "") for x in facts[at : at + FACTS_A_TICK]])]
    return ids


def chat(agent: MemoryAgent, lines: Iterable[str], mode: str = "associative", budget: int = 8) -> Iterator[dict]:
    """Answers to lines of text: ``/remember TEXT`` observes, ``/session`` ends the tick, ``/quit`` ends; any other line is a question."""
    for line in lines:
        line = line.strip()
        if line == "/quit":
            return
        if line == "/session":
            agent.memory.advance()
        elif line.startswith("/remember "):
            agent.observe(line[len("/remember ") :])
        elif line:
            yield agent.ask(line, mode, budget)


def provider_of(name: str) -> AnswerProvider:
    """What ``module:factory`` makes."""
    module, _, factory = name.partition(":")
    return getattr(importlib.import_module(module), factory)()


def main(argv: Sequence[str] | None = None) -> int:
    """``<verb> --config FILE [--params JSON]``: one call, or ``serve``, ``init``, ``facts`` and ``chat``."""
    from hebbspark.session import local_session

    parser = argparse.ArgumentParser(prog="hebbspark")
    parser.add_argument("verb", choices=["init", "serve", "facts", "chat", *VERBS])
    parser.add_argument("--config", required=True)
    parser.add_argument("--params", default="{}")
    parser.add_argument("--facts", help="a JSON file with a list of observations")
    parser.add_argument("--provider", help="module:factory of the answer provider, for chat")
    parser.add_argument("--question", help="one question instead of lines from the input, for chat")
    args = parser.parse_args(argv)
    try:
        memory = ManagedMemory(local_session(2), MemoryConfig.load(args.config))
    except Exception as e:  # noqa: BLE001
        print(json.dumps({"ok": False, "error": {"code": "startup_error", "message": str(e)[:200]}}))
        return 1
    if args.facts:
        try:
            ids = import_facts(memory, json.loads(Path(args.facts).read_text(encoding="utf-8")))
        except (OSError, ValueError, QuotaExceeded, StorageError) as e:
            print(json.dumps({"ok": False, "error": {"code": next((c for t, c in CODES if isinstance(e, t)), "storage_error"), "message": str(e)[:200]}}))
            return 1
        if args.verb == "facts":
            print(json.dumps({"ok": True, "result": {"ids": ids}}))
            return 0
    if args.verb in ("facts", "chat"):
        if args.verb == "facts" or not args.provider:
            parser.error("facts needs --facts, chat needs --provider")
        agent = MemoryAgent(memory, provider_of(args.provider))
        for answer in chat(agent, [args.question] if args.question else sys.stdin):
            print(json.dumps(answer, ensure_ascii=False, default=str), flush=True)
        return 0
    if args.verb == "serve":
        serve(memory, sys.stdin.buffer, sys.stdout.buffer)
        return 0
    answer = {"ok": True, "result": memory.stats()} if args.verb == "init" else respond(memory, {"method": args.verb, "params": json.loads(args.params)})
    print(json.dumps(answer, ensure_ascii=False))
    return 0 if answer["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
