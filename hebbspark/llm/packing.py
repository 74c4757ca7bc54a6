"""Filling packets of fixed capacity with whole documents.

Items of one size are alike, so the packing is planned over sizes and counts:
at most capacity + 1 of them, however many documents there are.  The plan is a
vector best fit in decreasing size.  A bin has three capacities: tokens,
documents, and attention cost, which is the sum of the squared sizes.  The
attention capacity is below the square of the token capacity, so it binds where
one long document would be joined by others; a document whose own cost exceeds
it, which may not be split, has a packet to itself.  Of the open bins that have room in all of them, the one is chosen whose remaining
capacity has the smallest weighted norm after the item is in it, or with which
the item has the largest weighted dot product.  Open bins with equal remains
are one group, so a step of the plan places many items.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class PackParams:
    """attention_share: the sum of squared sizes that documents may have together, as a part of capacity squared; choose: "norm" or "dot"."""

    capacity: int = 2048
    documents: int = 256
    attention_share: float = 0.9
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    choose: str = "norm"
    shard_rows: int = 50_000

    @property
    def limits(self) -> tuple[int, int, int]:
        return self.capacity, self.documents, int(self.attention_share * self.capacity**2)


@dataclass(frozen=True)
class Plan:
    """Rows (size, first rank, first bin, items per bin): rank r of a size goes to bin first_bin + (r - first_rank) // per."""

    size: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    per: np.ndarray
    bins: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        key = (self.size << 44) + self.rank
        at = np.searchsorted(key, (size.astype(np.int64) << 44) + rank, side="right") - 1
        return self.bin[at] + (rank - self.rank[at]) // self.per[at]


def plan_packing(counts: Mapping[int, int], p: PackParams) -> Plan:
    """Place counts[size] items of each size; sizes are 0 to capacity."""
    full = np.array(p.limits, dtype=np.float64)
    weights = np.array(p.weights, dtype=np.float64)
    room = np.zeros((1024, 3), dtype=np.int64)
    many = np.zeros(1024, dtype=np.int64)
    start = np.zeros(1024, dtype=np.int64)
    groups = bins = 0
    steps: list[tuple[int, int, int, int]] = []

    def add(left: np.ndarray, n: int, first: int) -> None:
        nonlocal room, many, start, groups
        if n <= 0:
            return
        if groups == len(many):
            keep = many[:groups] > 0
            used = int(keep.sum())
            size = max(1024, 2 * used)
            room, many, start = (np.concatenate([v[:groups][keep], np.zeros((size - used, *v.shape[1:]), dtype=np.int64)]) for v in (room, many, start))
            groups = used
        room[groups], many[groups], start[groups] = left, n, first
        groups += 1

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left, rank = counts[size], 0
        item = np.array([size, 1, size * size], dtype=np.int64)
        if size > p.capacity:
            raise ValueError(f"an item of {size} exceeds the capacity {p.capacity}")
        if item[2] > p.limits[2]:
            steps.append((size, 0, bins, 1))
            bins += left
            continue
        while left:
            fits = np.flatnonzero((many[:groups] > 0) & (room[:groups] >= item).all(axis=1))
            if len(fits):
                rest = room[fits]
                if p.choose == "dot":
                    value = -((rest / full) * (item / full) * weights).sum(axis=1)
                else:
                    value = ((((rest - item) / full) ** 2) * weights).sum(axis=1)
                g = int(fits[np.argmin(value)])
                have, n, first = room[g].copy(), int(many[g]), int(start[g])
            else:
                g, have, n, first = -1, np.array(p.limits), left, bins
            per = int(min(have[k] // item[k] for k in range(3) if item[k]))
            whole = min(n, left // per)
            if not whole:
                per, whole = left, 1
            steps.append((size, rank, first, per))
            rank, left = rank + per * whole, left - per * whole
            if g < 0:
                bins += whole
            else:
                many[g], start[g] = n - whole, first + whole
            add(have - per * item, whole, first)
    steps.sort()
    columns = np.array(steps, dtype=np.int64).reshape(-1, 4).T
    return Plan(columns[0], columns[1], columns[2], columns[3], bins)


def packed(sizes: DataFrame, p: PackParams = PackParams(), id_col: str = "doc_id", size_col: str = "n") -> DataFrame:
    """(id, part, packet, start, tokens): where every document goes.

    A document within the capacity is one row.  A longer one fills packets of
    its own, and what remains is one more part; start is the place of the part
    in the document.  Documents of size 0 or of null size take a document's
    place and no tokens.  Packets are numbered from 0 without gaps, and the
    numbers do not depend on how the rows are distributed.  Ids must be unique;
    ids that are null are placed too.  An empty table gives an empty result.
    """
    cap = p.capacity
    rows = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("n"))
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / cap), F.lit(1)) - 1)
    items = rows.select("id", "n", F.explode(parts).alias("part"))
    items = items.select("id", "part", (F.col("part") * cap).alias("start"), F.least(F.lit(cap), F.col("n") - F.col("part") * cap).alias("tokens")).persist()
    # One row for every size there is: capacity + 1 at most.
    counts = {r.tokens: r.n for r in items.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = items.sparkSession.sparkContext.broadcast(plan_packing(counts, p))
    shards = max(1, sum(counts.values()) // p.shard_rows)
    sharded = items.withColumn("shard", F.pmod(F.xxhash64("id", "part"), F.lit(shards)))
    # Ranks within a size, shard by shard, so that no size is in one task.
    before = sharded.groupBy("tokens", "shard").agg(F.count(F.lit(1)).alias("c"))
    before = before.withColumn("before", F.sum("c").over(Window.partitionBy("tokens").orderBy("shard")) - F.col("c")).drop("c")
    local = sharded.withColumn("r", F.row_number().over(Window.partitionBy("tokens", "shard").orderBy("id", "part")) - 1)

    @F.pandas_udf(T.LongType())
    def place(size: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(plan.value.place(size.to_numpy(), rank.to_numpy()))

    ranked = local.join(before, ["tokens", "shard"]).withColumn("packet", place("tokens", F.col("r") + F.col("before")))
    return ranked.select(F.col("id").alias(id_col), F.col("part").cast("int").alias("part"), "packet", "start", "tokens")


def violations(placed: DataFrame, documents: DataFrame, p: PackParams = PackParams(), id_col: str = "doc_id") -> DataFrame:
    """One row of counts, all but documents 0 if the packing is sound.

    lost: documents without a part; doubled: parts that occur twice;
    cut_without_need: documents of several parts that fit one packet;
    over_...: packets beyond a capacity, that of attention only where several
    documents share the packet; unused_numbers: packet numbers without a packet.
    Documents must have distinct ids that are not null.
    """
    per = placed.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("part").alias("parts"), F.sum("tokens").alias("n"))
    met = documents.select(id_col).join(per, id_col, "left")
    of_documents = met.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("rows").isNull()).alias("lost"),
        F.coalesce(F.sum(F.col("rows") - F.col("parts")), F.lit(0)).alias("doubled"),
        F.count_if((F.col("parts") > 1) & (F.col("n") <= p.capacity)).alias("cut_without_need"),
    )
    tokens, many, attention = p.limits
    loads = placed.groupBy("packet").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("tokens") * F.col("tokens")).alias("c"))
    of_packets = loads.agg(
        F.count_if(F.col("n") > tokens).alias("over_tokens"),
        F.count_if(F.col("k") > many).alias("over_documents"),
        F.count_if((F.col("k") > 1) & (F.col("c") > attention)).alias("over_attention"),
        (F.coalesce(F.max("packet") + 1, F.lit(0)) - F.count(F.lit(1))).alias("unused_numbers"),
    )
    both = of_documents.unionByName(of_packets, allowMissingColumns=True)
    return both.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in both.columns))
