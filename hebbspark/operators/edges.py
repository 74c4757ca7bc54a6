"""The association graph: event pairs, the decaying fold, snapshots and reads.

Edges are undirected and stored as a < b.  The state of an edge after its
events is a closed form, so it is one aggregation, not a sequential replay:
event i counts at tick e_i, the running maximum of the ticks in event order,
and the weight at the last of them is the sum of eta (1 - lam) ** (last - e_i).

``scope`` names key columns, such as a conversation, within which node ids are
local; they take part in every key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hebbspark.functions.decay import decayed, factor
from hebbspark.operators.ranking import numbered
from hebbspark.params import EdgeParams

SEQ_BLOCK = 1 << 20


def canonical(events: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pair as (smaller, larger); rows with a null, zero or repeated end are dropped."""
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    valid = events.where((F.col(a) > 0) & (F.col(b) > 0) & (F.col(a) != F.col(b)))
    return valid.select(*[c for c in events.columns if c not in (a, b)], low.alias("a"), high.alias("b"))


def other_end(node: Column) -> Column:
    return F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a"))


#: Nodes of a group that are enumerated against each other in one place.
CLIQUE_BLOCK = 256


def clique_pairs(sets: DataFrame, group: Sequence[str], node: str = "node", block: int = CLIQUE_BLOCK) -> DataFrame:
    """All pairs a < b of the distinct nodes of each group; groups of fewer than two give none.

    A group of up to ``block`` nodes is one array, whose pairs need no join.  A
    larger one is cut into blocks of about that size, which meet two by two, so
    no task holds more than two of them.
    """
    keys = list(group)
    one = sets.select(*keys, F.col(node).alias("_x")).where("_x > 0").distinct().persist()
    sizes = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    pairs_of = lambda rows: rows.select(*keys, "_xs", F.posexplode("_xs").alias("_i", "a")).select(*keys, "a", F.explode(F.slice("_xs", F.col("_i") + 2, F.size("_xs"))).alias("b"))
    if (sizes.agg(F.max("_c")).first()[0] or 0) <= block:
        return pairs_of(one.groupBy(*keys).agg(F.sort_array(F.collect_list("_x")).alias("_xs")))
    large = sizes.select(*keys, F.ceil(F.col("_c") / block).cast("int").alias("_of")).where("_of > 1")
    cut = one.join(large, keys, "left").withColumn("_of", F.coalesce("_of", F.lit(1))).withColumn("_g", F.pmod(F.xxhash64("_x"), F.col("_of")).cast("int"))
    blocks = cut.groupBy(*keys, "_of", "_g").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    met = blocks.where("_of > 1").select(*keys, "_g", "_xs", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_o")).where("_g <> _o")
    lower = met.where("_g < _o").select(*keys, F.col("_g").alias("_l"), F.col("_o").alias("_r"), F.col("_xs").alias("_ys"))
    upper = met.where("_g > _o").select(*keys, F.col("_o").alias("_l"), F.col("_g").alias("_r"), "_xs")
    across = lower.join(upper, [*keys, "_l", "_r"]).select(*keys, "_xs", F.explode("_ys").alias("_y")).select(*keys, "_y", F.explode("_xs").alias("_x"))
    return pairs_of(blocks).unionByName(across.select(*keys, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")))


#: Pairs up to which they are listed and counted; more are counted in tiles and never listed.
LISTED_PAIRS = 1 << 24
#: Nodes of either side of a tile, and the pairs and members of a tile's side that are counted at once.
TILE, TILE_PAIRS, TILE_MEMBERS = 4096, 1 << 29, 1 << 22


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members of a block's groups as places in its sorted nodes."""
    nodes, place = np.unique(pdf["_x"].to_numpy(), return_inverse=True)
    by = np.lexsort((place, pdf["_k"].to_numpy()))
    groups, first = np.unique(pdf["_k"].to_numpy()[by], return_index=True)
    kind = np.uint16 if len(nodes) <= 1 << 16 else np.uint32
    packed = (nodes.astype(np.int64), groups.astype(np.int64), np.r_[first, len(by)].astype(np.int64), place[by].astype(kind))
    head = {c: [pdf[c].iloc[0]] for c in ("_g", "_c")}
    return pd.DataFrame({**head, **{n: [x.tobytes()] for n, x in zip(("nodes", "groups", "first"), packed)}, "members": [packed[3].tobytes()], "width": [packed[3].itemsize]})


def _tile(left: dict, right: dict | None) -> Iterator[pa.RecordBatch]:
    """The pairs across two blocks, or inside one, with the number of groups that hold both."""
    def of(row: dict) -> list[np.ndarray]:
        return [*(np.frombuffer(row[n], np.int64) for n in ("nodes", "groups", "first")), np.frombuffer(row["members"], f"u{row['width']}")]

    (ln, lg, lf, lm), (rn, rg, rf, rm) = of(left), of(right or left)
    counts = np.zeros((len(ln), len(rn)), np.int32)
    for i, j in zip(*np.intersect1d(lg, rg, assume_unique=True, return_indices=True)[1:]):
        u, v = lm[lf[i] : lf[i + 1]], rm[rf[j] : rf[j + 1]]
        at = max(1, (1 << 20) // len(v))
        for k in range(0, len(u), at):
            counts[u[k : k + at, None], v] += 1  # a group holds a node once
    at = max(1, (1 << 20) // len(rn))
    for k in range(0, len(ln), at):
        part = counts[k : k + at]
        x, y = np.nonzero(part if right else np.triu(part, k + 1))
        a, b = ln[k + x], rn[y]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(part[x, y].astype(np.int64))], ["a", "b", "n"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of their tile, one or two for each."""
    held = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["_l"] == row["_r"]:
                yield from _tile(row, None)
            elif held is not None and all(held[c] == row[c] for c in ("_c", "_l", "_r")):
                yield from _tile(held, row)
                held = None
            else:
                held = row


def clique_counts(sets: DataFrame, group: str, node: str = "node", listed: int = LISTED_PAIRS, tile: int = TILE, most: int = TILE_PAIRS, members: int = TILE_MEMBERS) -> DataFrame:
    """(a, b, n): the pairs of ``clique_pairs`` with the number of groups that hold both; ``group`` is a whole number.

    Where the pairs are many, nodes fall into blocks, and a task counts the
    pairs across two blocks in one array: what is moved are the packed members
    of the groups, once for each block, and not the pairs.  Only where a tile
    has more than ``most`` pairs are its groups cut and the counts added up.
    """
    one = sets.select(F.col(group).cast("long").alias("_k"), F.col(node).cast("long").alias("_x")).where("_x > 0 AND _k IS NOT NULL").distinct().persist()
    size = one.groupBy("_k").agg(F.count(F.lit(1)).alias("_c")).agg(F.sum("_c").alias("rows"), F.sum(F.col("_c") * (F.col("_c") - 1) / 2).alias("pairs")).first()
    if (size.pairs or 0) <= listed:
        return clique_pairs(one, ["_k"], "_x").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    blocks = -(-one.select("_x").distinct().count() // tile)
    tiles = blocks * (blocks + 1) // 2
    parts = int(max(1, -(-size.pairs // (tiles * most)), -(-size.rows // (blocks * members))))
    cut = one.select("_k", "_x", F.pmod(F.xxhash64("_x"), F.lit(blocks)).cast("int").alias("_g"), F.pmod(F.xxhash64("_k", F.lit(17)), F.lit(parts)).cast("int").alias("_c"))
    packed = cut.repartition(blocks * parts, "_g", "_c").groupBy("_g", "_c").applyInPandas(_block, "_g int, _c int, nodes binary, groups binary, first binary, members binary, width int")
    met = packed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("_g", "_o").alias("_l"), F.greatest("_g", "_o").alias("_r"), *packed.columns)
    placed = met.repartition(tiles * parts, "_c", "_l", "_r").sortWithinPartitions("_c", "_l", "_r", "_g")
    counted = placed.mapInArrow(_tiles, "a long, b long, n long")
    return counted if parts == 1 else counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


def adjacent_pairs(records: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, seq, a, b, tick): each record with the one before it in the same tick."""
    order = Window.partitionBy(*scope, "tick").orderBy("id")
    prev = records.select(*scope, "id", "tick", F.lag("id").over(order).alias("p")).where("p IS NOT NULL")
    return prev.select(*scope, F.col("id").alias("seq"), F.col("id").alias("a"), F.col("p").alias("b"), "tick")


def context_pairs(records: DataFrame, context: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Each record with every context record (scope, id, other), and with nothing else."""
    near = context.join(records.select(*scope, "id", "tick"), [*scope, "id"])
    return near.select(*scope, F.col("id").alias("seq"), F.col("id").alias("a"), F.col("other").alias("b"), "tick").distinct()


def star_pairs(records: DataFrame, context: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Each record with the previous one of its tick and with every context record (scope, id, other)."""
    return adjacent_pairs(records, scope).unionByName(context_pairs(records, context, scope)).distinct()


def combined_pairs(records: DataFrame, context: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """The clique over the record, the previous one of its tick and its context."""
    star = star_pairs(records, context, scope)
    own = star.select(*scope, "seq", "tick", F.explode(F.array("a", "b")).alias("node"))
    return clique_pairs(own, [*scope, "seq", "tick"])


def fold(events: DataFrame, p: EdgeParams = EdgeParams(), scope: Sequence[str] = (), block: int | None = SEQ_BLOCK, once: bool = False) -> DataFrame:
    """(scope, a, b, weight, last_tick, events) from (scope, seq, a, b, tick); late ticks count at the latest tick so far.

    With ``block``, events of one edge are first folded by blocks of ``seq``
    and equal ticks become counts, so that an edge that holds a large share of
    all events is not one task's work.  Null ticks and invalid pairs are
    dropped; equal ``seq`` are ordered by tick.  With ``once``, rows that are
    equal in all columns count once; they meet in the exchange that the fold
    needs anyway.
    """
    keys = [*scope, "a", "b"]
    valid = canonical(events.where(F.col("tick").isNotNull()))
    up_to_here = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if block:
        valid = valid.withColumn("_block", F.floor(F.col("seq") / block))
        if once:
            valid = valid.repartition(*keys, "_block").dropDuplicates([*keys, "_block", "seq", "tick"])
        local = Window.partitionBy(*keys, "_block").orderBy("seq", "tick")
        counted = valid.withColumn("_e", F.max("tick").over(up_to_here(local))).groupBy(*keys, "_block", "_e").agg(F.count(F.lit(1)).alias("_n"))
        order = Window.partitionBy(*keys).orderBy("_block", "_e")
        settled = counted.withColumn("_e", F.max("_e").over(up_to_here(order)))
    else:
        if once:
            valid = valid.repartition(*keys).dropDuplicates([*keys, "seq", "tick"])
        order = Window.partitionBy(*keys).orderBy("seq", "tick")
        settled = valid.withColumn("_e", F.max("tick").over(up_to_here(order))).withColumn("_n", F.lit(1))
    last = F.max("_e").over(Window.partitionBy(*keys))
    gain = F.col("_n") * F.lit(float(p.eta)) * factor(F.col("_last") - F.col("_e"), p.lam)
    return settled.withColumn("_last", last).groupBy(*keys).agg(F.sum(gain).alias("weight"), F.max("_last").alias("last_tick"), F.sum("_n").alias("events"))


def at_tick(edges: DataFrame, tick: int | Column, p: EdgeParams) -> DataFrame:
    """Edges with a column ``now``: the weight as read at the tick."""
    return edges.withColumn("now", decayed(F.col("weight"), F.col("last_tick"), tick, p.lam))


def freeze(edges: DataFrame, tick: int | Column, p: EdgeParams) -> DataFrame:
    """The snapshot: edges alive at the tick, with their stored weight and tick."""
    return at_tick(edges, tick, p).where(F.col("now") >= p.floor).drop("now")


def adjacency(edges: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, src, dst, weight, last_tick): both directions of every edge."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return edges.select(*scope, ends.alias("_e"), "weight", "last_tick").select(*scope, "_e.src", "_e.dst", "weight", "last_tick")


def pair_weights(pairs: DataFrame, edges: DataFrame, tick: int | Column, p: EdgeParams, scope: Sequence[str] = ()) -> DataFrame:
    """``pairs`` (scope, a, b, ...) with the weight read at the tick, 0 for a missing edge or a = b."""
    keyed = pairs.withColumn("_a", F.least("a", "b")).withColumn("_b", F.greatest("a", "b"))
    read = at_tick(edges, tick, p).select(*scope, F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("now").alias("pair_weight"))
    return keyed.join(read, [*scope, "_a", "_b"], "left").drop("_a", "_b").withColumn("pair_weight", F.coalesce("pair_weight", F.lit(0.0)))


def mass_along(paths: DataFrame, edges: DataFrame, tick: int | Column, p: EdgeParams, group: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """(group, mass): the sum of the weights of consecutive nodes, from (group, scope, pos, node)."""
    nxt = F.lead("node").over(Window.partitionBy(*group).orderBy("pos"))
    steps = paths.select(*dict.fromkeys([*group, *scope]), F.col("node").alias("a"), nxt.alias("b"))
    return pair_weights(steps, edges, tick, p, scope).groupBy(*group).agg(F.sum("pair_weight").alias("mass"))


def neighbors(adj: DataFrame, tick: int | Column, p: EdgeParams, cutoff: float = 1e-3, cap: int = 256, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, src, dst, now): of each node the first ``cap`` neighbours by id whose weight reaches the cutoff."""
    read = at_tick(adj, tick, p).where(F.col("now") >= cutoff)
    order = Window.partitionBy(*scope, "src").orderBy("dst")
    return read.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).select(*scope, "src", "dst", "now")


def degree(adj: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    return adj.groupBy(*scope, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def stats(edges: DataFrame, tick: int | Column, p: EdgeParams, capacity: int | None = None) -> DataFrame:
    """One row: distinct edges, updates, edges dead at the tick, snapshot edges, node count (largest id + 1), and with a capacity the load and the edges over it."""
    alive = F.col("now") >= p.floor
    out = at_tick(edges, tick, p).agg(
        F.count(F.lit(1)).alias("inserts"),
        F.coalesce(F.sum(F.col("events") - 1), F.lit(0)).alias("updates"),
        F.count_if(~alive).alias("dropped"),
        F.count_if(alive).alias("edge_count"),
        F.coalesce(F.max(F.when(alive, F.col("b") + 1)), F.lit(0)).alias("node_count"),
    )
    if capacity is None:
        return out
    over = F.greatest(F.col("inserts") - F.lit(capacity * 7 // 10), F.lit(0))
    return out.withColumn("load_factor", F.col("inserts") / F.lit(float(capacity))).withColumn("rejected_full", over.cast("long"))


def weak_paths(paths: DataFrame, edges: DataFrame, tick: int | Column, p: EdgeParams, group: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """(group, a, b) of the steps of paths (group, scope, path) that no edge alive at the tick carries: none if all paths are sound."""
    keys = list(dict.fromkeys([*group, *scope]))
    steps = paths.select(*keys, F.posexplode("path").alias("_i", "a"), "path").where(F.col("_i") + 1 < F.size("path")).select(*keys, "a", F.get("path", F.col("_i") + 1).alias("b"))
    return pair_weights(steps, edges, tick, p, scope).where(F.col("pair_weight") <= 0).select(*keys, "a", "b")


def within_capacity(edges: DataFrame, first_seen: str, capacity: int) -> DataFrame:
    """The edges a table of this capacity admits at 70 % load: those seen first."""
    return numbered(edges, [first_seen, "a", "b"], "_place").where(F.col("_place") <= capacity * 7 // 10).drop("_place")


def shuffled(edges: DataFrame, seed: int = 0, scope: Sequence[str] = ()) -> DataFrame:
    """A null model: the same topology under a random permutation of all node ids of each scope.

    The node that is n-th by a digest of its id takes the place of the n-th by
    id.  Both places come from sorts by ranges, so no scope is one task's work;
    a scope has the same places in either order, because it sorts first.
    """
    nodes = edges.select(*scope, F.explode(F.array("a", "b")).alias("node")).distinct()
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("node").cast("string")))
    by_id = numbered(nodes, [*scope, "node"], "_n").withColumnRenamed("node", "to")
    by_digest = numbered(nodes.withColumn("_d", digest), [*scope, "_d", "node"], "_n").select(*scope, "node", "_n")
    perm = by_digest.join(by_id, [*scope, "_n"]).select(*scope, "node", "to")
    out = edges
    for end in ("a", "b"):
        out = out.join(perm.withColumnRenamed("node", end).withColumnRenamed("to", f"_{end}"), [*scope, end])
    return out.withColumn("a", F.least("_a", "_b")).withColumn("b", F.greatest("_a", "_b")).drop("_a", "_b")


def provenance(events: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, a, b, origins): the sorted origins of each edge, from events with a column origin."""
    return canonical(events).groupBy(*scope, "a", "b").agg(F.sort_array(F.collect_set("origin")).alias("origins"))
