"""Evidence packets under byte budgets, answer checks and the bounded question pipeline."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hebbspark.operators.ranking import stable_topk


def item_bytes(id_text: Column, text: Column) -> Column:
    """UTF-8 bytes of one record in the packet's JSON, ``{"id": ..., "text": ...}``."""
    return F.octet_length(F.to_json(F.struct(F.coalesce(id_text, F.lit("")).alias("id"), F.coalesce(text, F.lit("")).alias("text")))) + 3


def packet_bytes(sizes: Column, count: Column) -> Column:
    """Bytes of a whole packet from the sum of its items' bytes and their number; an empty packet has 2."""
    return F.when(count == 0, F.lit(2)).otherwise(2 + sizes + 2 * (count - 1))


def evidence_bytes(rows: DataFrame, group: Sequence[str], id_col: str = "id", text: str = "text") -> DataFrame:
    """(group, bytes, records)."""
    sized = rows.withColumn("_b", item_bytes(F.col(id_col).cast("string"), F.col(text)))
    return sized.groupBy(*group).agg(F.sum("_b").alias("_s"), F.count(F.lit(1)).alias("records")).select(*group, packet_bytes(F.col("_s"), F.col("records")).cast("long").alias("bytes"), "records")


def fit_records(rows: DataFrame, group: Sequence[str], max_bytes: int, limit: int, order: str = "rank", id_col: str = "id", text: str = "text") -> DataFrame:
    """Rows admitted in order as long as the packet fits: a record that would overflow is passed over, never cut.

    A group is one query's ranked list, which the caller has bounded.  Only
    the sizes are folded, inside the JVM.
    """
    size = item_bytes(F.col(id_col).cast("string"), F.col(text)).cast("long")
    listed = rows.withColumn("_b", size).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), "_b"))).alias("_l"))
    start = F.struct(F.lit(2).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        need = acc["used"] + x["_b"] + F.when(F.size(acc["kept"]) > 0, 2).otherwise(0)
        fits = (need <= max_bytes) & (F.size(acc["kept"]) < limit)
        return F.struct(F.when(fits, need).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["kept"], x["o"])).otherwise(acc["kept"]).alias("kept"))

    chosen = listed.select(*group, F.explode(F.aggregate("_l", start, step)["kept"]).alias(order))
    return rows.join(chosen.withColumn(order, F.col(order).cast(rows.schema[order].dataType)), [*group, order], "left_semi")


def oracle_packet(gold: DataFrame, distractors: DataFrame, group: Sequence[str], budget: int) -> DataFrame:
    """(group, id, position): all gold records first, then the best distractors up to the budget.

    A group with more gold than budget keeps all of its gold and no distractor.
    """
    rows = gold.select(*group, "id", F.lit(0).alias("_k"), F.lit(0).cast("long").alias("rank")).unionByName(distractors.select(*group, "id", F.lit(1).alias("_k"), F.col("rank").cast("long").alias("rank")))
    once = rows.groupBy(*group, "id").agg(F.min(F.struct("_k", "rank")).alias("_s")).select(*group, "id", "_s._k", "_s.rank")
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_k", "rank", "id"))
    return once.withColumn("position", place).where((F.col("_k") == 0) | (F.col("position") <= budget)).select(*group, "id", "position")


def without(packet: DataFrame, removed: DataFrame, group: Sequence[str]) -> DataFrame:
    """The packet without some records: counterfactual and bridge-removed arms."""
    return packet.join(removed.select(*group, "id"), [*group, "id"], "left_anti")


def replaced(packet: DataFrame, texts: DataFrame, group: Sequence[str]) -> DataFrame:
    """The packet with the text of some records replaced, from (group, id, text)."""
    new = texts.select(*group, "id", F.col("text").alias("_t"))
    return packet.join(new, [*group, "id"], "left").withColumn("text", F.coalesce("_t", "text")).drop("_t")


def invalid_citations(answers: DataFrame) -> DataFrame:
    """(case, invalid, valid): cited ids that were not supplied; a substantive answer needs a citation.

    ``answers`` has case_id, cited, supplied (arrays of ids) and abstained.
    """
    bad = F.array_sort(F.array_except("cited", "supplied"))
    return answers.select("case_id", bad.alias("invalid"), ((F.size(bad) == 0) & (F.col("abstained") | (F.size("cited") > 0))).alias("valid"))


# The parts below run on the driver, one question at a time.


class ProviderError(RuntimeError):
    pass


class AnswerProvider(Protocol):
    """Returns a JSON object for a prompt; the keys it must have are given by name and type."""

    def structured(self, prompt: str, schema: dict[str, type]) -> dict: ...


@dataclass(frozen=True)
class Evidence:
    id: str
    text: str


@dataclass
class Completion:
    answer: str
    citations: list[str]
    abstained: bool
    rounds: int = 0
    evidence: list[Evidence] = field(default_factory=list)
    usage: dict[str, int] = field(default_factory=dict)


ANSWER = {"answer": str, "citations": list, "abstained": bool}
PLAN = {"selected": list, "queries": list}
CHECK = {"supported": bool}


def plan_schema(reviewed: Sequence[str], queries: int = 2) -> dict:
    """JSON schema of a plan: ids of the reviewed records only, and at most two new queries."""
    ids = {"type": "array", "items": {"type": "string", "enum": list(reviewed)}, "uniqueItems": True} if reviewed else {"type": "array", "maxItems": 0}
    return {"type": "object", "additionalProperties": False, "required": list(PLAN), "properties": {"selected": ids, "queries": {"type": "array", "items": {"type": "string"}, "maxItems": queries}}}


def parse_json(text: str, schema: dict[str, type]) -> dict:
    """One JSON object, in a code fence or bare, with exactly these keys and types."""
    fenced = re.fullmatch(r"\s*```(?:json)?\s*(.*?)\s*```\s*", text, re.DOTALL)
    try:
        value = json.loads(fenced[1] if fenced else text)
    except ValueError as e:
        raise ProviderError("the answer is not JSON") from e
    if not isinstance(value, dict) or set(value) != set(schema) or any(type(value[k]) is not t for k, t in schema.items()):
        raise ProviderError("the answer has other keys or types")
    return value


def packet_json(evidence: Sequence[Evidence]) -> str:
    return json.dumps([{"id": e.id, "text": e.text} for e in evidence], ensure_ascii=False)


def fit(evidence: Sequence[Evidence], max_bytes: int, limit: int) -> list[Evidence]:
    """``fit_records`` for one list on the driver."""
    kept: list[Evidence] = []
    for e in evidence:
        if len(kept) == limit:
            break
        if len(packet_json([*kept, e]).encode()) <= max_bytes:
            kept.append(e)
    return kept


PROFILES = {
    "baseline": "Answer the question from the evidence.",
    "grounded": "Answer the question from the evidence alone; cite the ids you rely on, and abstain if the evidence does not say.",
}


def make_prompt(question: str, evidence: Sequence[Evidence], profile: str = "baseline") -> str:
    """Instructions, then the question and the evidence as JSON and nothing else."""
    return f"{PROFILES[profile]}\nquestion: {json.dumps(question, ensure_ascii=False)}\nevidence: {packet_json(evidence)}"


@dataclass(frozen=True)
class PipelineLimits:
    rounds: int = 2
    candidates: int = 24
    final: int = 8
    context_bytes: int = 12_000
    review_bytes: int = 32_000
    verify: bool = True

    def __post_init__(self):
        if not (1 <= self.rounds <= 3 and 1 <= self.final <= self.candidates <= 64 and 2 <= self.context_bytes <= self.review_bytes <= 128_000):
            raise ValueError("pipeline limits out of range")


class EvidencePipeline:
    """Retrieve, let the controller choose and ask again within bounds, answer, verify, or abstain."""

    def __init__(self, retrieve: Callable[[str, int], list[Evidence]], controller: AnswerProvider, answerer: AnswerProvider, limits: PipelineLimits = PipelineLimits(), profile: str = "grounded"):
        self.retrieve, self.controller, self.answerer, self.limits, self.profile = retrieve, controller, answerer, limits, profile

    def ask(self, question: str) -> Completion:
        pool: dict[str, Evidence] = {}
        selected: list[str] = []
        queries, rounds, usage = [question], 0, {"calls": 0}
        try:
            while rounds < self.limits.rounds and queries:
                rounds += 1
                for q in queries:
                    for e in self.retrieve(q, self.limits.candidates):
                        pool.setdefault(e.id, e)
                order = list(dict.fromkeys([*selected, *pool]))
                review = fit([pool[i] for i in order], self.limits.review_bytes, self.limits.candidates)
                usage["calls"] += 1
                plan = self.controller.structured(make_prompt(question, review, "baseline"), PLAN)
                known = {e.id for e in review}
                if set(plan) != set(PLAN) or not all(isinstance(i, str) and i in known for i in plan["selected"]) or not all(isinstance(q, str) for q in plan["queries"]):
                    raise ProviderError("the plan names records that were not shown")
                selected = list(dict.fromkeys(plan["selected"]))
                queries = [q for q in plan["queries"][:2] if q.strip()]
            packet = fit([pool[i] for i in selected], self.limits.context_bytes, self.limits.final)
            usage["calls"] += 1
            got = self.answerer.structured(make_prompt(question, packet, self.profile), ANSWER)
            supplied = {e.id for e in packet}
            if not set(got["citations"]) <= supplied or (not got["abstained"] and not got["citations"]):
                raise ProviderError("citations do not match the evidence")
            if self.limits.verify and not got["abstained"]:
                cited = [e for e in packet if e.id in got["citations"]]
                usage["calls"] += 1
                check = self.controller.structured(make_prompt(f"{question}\n{got['answer']}", cited, self.profile), CHECK)
                if not check["supported"]:
                    raise ProviderError("the cited evidence does not support the answer")
            return Completion(got["answer"], got["citations"], got["abstained"], rounds, packet, usage)
        except (ProviderError, KeyError, TypeError):
            return Completion("", [], True, rounds, [], usage)


def context_rows(hits: DataFrame, texts: DataFrame, max_bytes: int, limit: int, scope: Sequence[str] = ()) -> DataFrame:
    """(query_id, scope, id, rank, text): the ranked hits that fit the packet."""
    rows = stable_topk(hits.join(texts, [*scope, "id"]), ["query_id", *scope], "score", limit)
    return fit_records(rows, ["query_id", *scope], max_bytes, limit).select("query_id", *scope, "id", "rank", "text")
