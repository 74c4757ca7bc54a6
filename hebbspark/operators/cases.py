"""Generated cases for evaluations: short chains of facts with a changed twin, and logs for exact counts."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hebbspark.operators.evalops import drawn

CASE = "case_id string, family string, question string, gold string, counterfactual_gold string, facts array<string>, alternate array<string>, required array<int>, counterfactual_required array<int>, observations array<struct<id: string, text: string>>"
FAMILIES = ("alias", "arithmetic", "temporal")


def _alias(rng: random.Random, n: list[int]) -> dict:
    gold, other = f"rm{n[3]}", f"rm{n[4]}"
    chain = lambda room: [f"Crate K{n[0]} travels under the label L{n[1]}.", f"The label L{n[1]} is stuck on pallet P{n[2]}.", f"Pallet P{n[2]} waits in {room}."]
    return {"question": f"Where does crate K{n[0]} wait?", "gold": gold, "counterfactual_gold": other, "facts": chain(gold), "alternate": chain(other), "required": [0, 1, 2], "counterfactual_required": [0, 1, 2]}


def _arithmetic(rng: random.Random, n: list[int]) -> dict:
    a, b, c = (rng.randint(2, 9) for _ in range(3))
    d = c + rng.randint(1, 4)
    chain = lambda k: [f"Job K{n[0]} takes {a} trays of sort S{n[1]}.", f"A tray of sort S{n[1]} has {b} rows of unit U{n[2]}.", f"A row of unit U{n[2]} has {k} cells."]
    return {"question": f"How many cells does job K{n[0]} take?", "gold": str(a * b * c), "counterfactual_gold": str(a * b * d), "facts": chain(c), "alternate": chain(d), "required": [0, 1, 2], "counterfactual_required": [0, 1, 2]}


def _temporal(rng: random.Random, n: list[int]) -> dict:
    rooms = [f"rm{x}" for x in n[2:5]]
    early, middle, late, after = (f"{h:02d}:00" for h in (8, 11, 17, 15))
    chain = lambda second: [f"Parcel K{n[0]} is known as handle H{n[1]}.", *(f"At {t} handle H{n[1]} was carried to {room}." for t, room in zip((early, second, late), rooms))]
    return {"question": f"Where was parcel K{n[0]} at 13:00?", "gold": rooms[1], "counterfactual_gold": rooms[0], "facts": chain(middle), "alternate": chain(after), "required": [0, 2], "counterfactual_required": [0, 1]}


def chain_cases(spark: SparkSession, per_family: int = 4, distractors: int = 16, seed: int = 0) -> DataFrame:
    """Questions over two or three facts each, in three families, with a twin whose changed fact changes the answer.

    The observations are the facts and the distractors in a random order; the
    required lists name the facts an answer needs.  The same seed gives the
    same cases.
    """
    rows = []
    for family, make in zip(FAMILIES, (_alias, _arithmetic, _temporal)):
        for k in range(per_family):
            rng = random.Random(f"{seed}:{family}:{k}")
            case = make(rng, rng.sample(range(1000, 10_000), 5))
            noise = [rng.choice(["Crate Z{0} waits in rm{1}.", "A row of unit Z{0} has {1} cells.", "Handle Z{0} was carried to rm{1}.", "Job Z{0} was put off to week {1}."]).format(rng.randint(10_000, 99_999), rng.randint(10, 999)) for _ in range(distractors)]
            seen = [*((f"s{i}", t) for i, t in enumerate(case["facts"])), *((f"d{i}", t) for i, t in enumerate(noise))]
            rng.shuffle(seen)
            rows.append((f"{family}-{k}", family, *(case[c] for c in ("question", "gold", "counterfactual_gold", "facts", "alternate", "required", "counterfactual_required")), seen))
    return spark.createDataFrame(rows, CASE)


LAYOUTS = ("hot", "disjoint", "uniform")


def contention_log(spark: SparkSession, layout: str, agents: int, writes: int, edges: int = 4096) -> DataFrame:
    """(seq, a, b, tick): every agent's writes to one shared edge, to an edge of its own, or to one of ``edges`` drawn anew each time."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout is one of {LAYOUTS}")
    rows = spark.range(1, agents * writes + 1).withColumnRenamed("id", "seq")
    place = {"hot": F.lit(0).cast("long"), "disjoint": F.pmod("seq", F.lit(agents)), "uniform": F.pmod(drawn(1, F.col("seq")), F.lit(edges))}[layout]
    return rows.select("seq", (2 * place + 1).alias("a"), (2 * place + 2).alias("b"), F.lit(0).cast("long").alias("tick"))
