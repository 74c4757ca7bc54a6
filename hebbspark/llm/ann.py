"""The k most similar vectors of every vector, through a learned partition.

Routers in two levels, each fitted on a bounded sample (``partition``), send
every vector to the part it most probably belongs to, where it is indexed, and
as a query to the ``probes`` most probable parts.  The parts number the vectors
divided by a constant, so the work for a vector does not grow with the table.  Inside a part, queries meet the index in tiles
of bounded size on twelve-bit copies of the vectors.  Each copy carries its
distance from the vector, so that a meeting has proven bounds; every meeting
that these do not exclude is computed again from the stored values in double
precision, pair by pair where a query has few in a tile, else in a second tile
of the stored vectors.  Vectors that differ by a factor only are one class that
is indexed once.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hebbspark.llm.partition import TwoLevels, best, fit_router
from hebbspark.operators.skew import lookup_join
from hebbspark.session import written


@dataclass(frozen=True)
class AnnParams:
    """sample: most vectors a router is fitted on; part_rows: wanted vectors in a part.

    The parts number the vectors divided by part_rows, in about as many regions
    as a region has parts.  most_parts bounds the routers that are broadcast, at
    2 * (dim + 1) bytes a part: 17 MB, reached at 134 million vectors, from where
    on a larger table has larger parts unless it is raised.  index_block and
    query_block bound a tile; a query with more than k + extra possible
    neighbours in a tile meets the tile's stored vectors, unless all such
    queries of the tile have no more pairs than it has stored vectors.
    """

    dim: int = 128
    k: int = 5
    probes: int = 5
    least: float | None = None
    sample: int = 16_384
    region_sample: int = 4096
    part_rows: int = 2048
    most_parts: int = 65_536
    index_block: int = 8192
    query_block: int = 32_768
    extra: int = 5


def usable(vector: Column | str, dim: int) -> Column:
    """The vector has ``dim`` values, none null, all finite, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & sound & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def vector_classes(vectors: DataFrame, p: AnnParams, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(rep, vec) of every usable vector that is no multiple of another, and (rep, id) of all ids that have it or a multiple."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vec")).where(F.col("id").isNotNull() & usable("vec", p.dim))
    # Quotients of floats are equal as doubles only where they are equal, so vectors share them just if one is a multiple of the other.  -0.0 and 0.0 are one value.
    top = F.array_max(F.transform("vec", lambda x: F.abs(x).cast("double")))
    plain = F.transform("vec", lambda x: x.cast("double") / F.col("top") + F.lit(0.0))
    # One exchange of the vectors, by the id that later joins use.
    one = rows.dropDuplicates(["id"]).withColumn("top", top).withColumn("h1", F.xxhash64(plain)).withColumn("h2", F.xxhash64(F.lit(1), plain)).drop("top").persist()
    prints = one.select("id", F.struct("h1", "h2").alias("print"))
    named = prints.groupBy("print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = written(lookup_join(prints, named, "print", "n").select("rep", "id"), "members")
    reps = one.select(F.col("id").alias("rep"), "vec").join(members.where(F.col("rep") == F.col("id")).select("rep"), "rep", "left_semi")
    return reps, members


_BASE = 1 << 62
#: How the routers inside the regions are trained: one linear layer, longer than the regions' router.
_LOW = {"hidden": 0, "epochs": 40, "rate": 1e-2}


def _order(seed: int) -> Column:
    """A whole number from -2^62 to 2^62 - 1 that depends on rep alone."""
    return F.shiftright(F.xxhash64(F.lit(seed), F.col("rep")), 1)


def _limit(share: float) -> int:
    """What _order is below for this share of all rows."""
    return int(min(max(share, 0.0), 1.0) * 2 * _BASE) - _BASE


_FITTED = T.StructType([T.StructField("region", T.IntegerType()), T.StructField("model", T.BinaryType())])


def fit(reps: DataFrame, rows: int, p: AnnParams) -> TwoLevels:
    """The routers.  That of the regions is fitted on the driver, those of the parts by one task for each region.

    No router sees more than ``sample`` or ``region_sample`` vectors, taken by
    the order of a hash of their id.
    """
    chosen = reps.withColumn("o", _order(0)).where(F.col("o") < F.lit(_limit(0.95 * p.sample / max(rows, 1))))
    batch = chosen.select("o", "rep", "vec").toArrow().sort_by([("o", "ascending"), ("rep", "ascending")]).slice(0, p.sample)
    x = _unit(batch.column("vec").combine_chunks(), p.dim).astype(np.float32) if batch.num_rows else np.zeros((0, p.dim), dtype=np.float32)
    wanted = max(1, min(-(-rows // p.part_rows), p.most_parts))
    regions = fit_router(x, min(math.isqrt(wanted - 1) + 1, p.sample // 32))
    seen = np.bincount(best(regions.logits(x), 1)[:, 0], minlength=regions.parts) if len(x) else np.zeros(1)
    about = (seen + 1) * (rows / (len(x) + regions.parts))
    parts = np.maximum(1, np.minimum(np.ceil(about * wanted / max(rows, 1)), p.region_sample // 32)).astype(int)
    limits = [_limit(0.95 * p.region_sample / n) for n in np.maximum(about, 1)]
    model = reps.sparkSession.sparkContext.broadcast((regions, limits, parts))
    drawn = T.StructType([T.StructField("region", T.IntegerType()), T.StructField("o", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("vec", T.ArrayType(T.FloatType()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, limit, _ = model.value
        limit = np.array(limit)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                own = best(router.logits(_unit(some.column("vec"), p.dim).astype(np.float32)), 1)[:, 0]
                keep = pa.array(np.flatnonzero(some.column("o").to_numpy() < limit[own]))
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)).take(keep), *(some.column(c).take(keep) for c in ("o", "rep", "vec"))], drawn.names)

    def learn(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, _, wish = model.value
        region = key[0].as_py()
        table = table.sort_by([("o", "ascending"), ("rep", "ascending")]).slice(0, p.region_sample)
        router = fit_router(_unit(table.column("vec").combine_chunks(), p.dim).astype(np.float32), int(wish[region]), **_LOW)
        return pa.table({"region": pa.array([region], pa.int32()), "model": pa.array([pickle.dumps(router.packed())], pa.binary())})

    most = max(limits)
    some = reps.withColumn("o", _order(1)).where(F.col("o") < F.lit(most)).select("o", "rep", "vec").mapInArrow(assign, drawn)
    fitted = {r.region: pickle.loads(r.model).unpacked() for r in some.groupBy("region").applyInArrow(learn, _FITTED).toLocalIterator()}
    one = fit_router(np.zeros((0, p.dim), dtype=np.float32), 1, **_LOW)
    return TwoLevels(regions, [fitted.get(i, one) for i in range(regions.parts)])


_ROUTED = T.StructType([T.StructField("rep", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("e", T.FloatType()), T.StructField("parts", T.ArrayType(T.IntegerType()))])


def _pack(x: np.ndarray) -> np.ndarray:
    """Numbers of twelve bits as bytes: the upper eight bits of all, then the lower four of two in one byte."""
    low = np.zeros((len(x), -(-x.shape[1] // 2) * 2), np.uint8)
    low[:, : x.shape[1]] = x & 15
    return np.concatenate([(x >> 4).astype(np.int8).view(np.uint8), low[:, ::2] | low[:, 1::2] << 4], axis=1)


def _unpack(raw: np.ndarray, dim: int) -> np.ndarray:
    high, low = raw[:, :dim].view(np.int8).astype(np.float32), raw[:, dim:]
    both = np.stack([low & 15, low >> 4], axis=2).reshape(len(raw), -1)[:, :dim]
    return high * np.float32(16) + both.astype(np.float32)


def routed(reps: DataFrame, router: TwoLevels, p: AnnParams) -> DataFrame:
    """(rep, v, e, parts): a twelve-bit copy of each vector, how far their directions are apart at most, and its most probable parts."""
    spark = reps.sparkSession
    model = spark.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = _unit(some.column("vec"), p.dim)
                small = np.rint(x * (2047 / np.abs(x).max(axis=1, keepdims=True))).astype(np.int16)
                copy = small.astype(np.float64)
                e = np.linalg.norm(x - copy / np.linalg.norm(copy, axis=1, keepdims=True), axis=1) + 1e-6
                packed = _pack(small)
                raw = pa.py_buffer(packed.tobytes())
                places = pa.py_buffer((np.arange(len(x) + 1) * packed.shape[1]).astype(np.int32).tobytes())
                v = pa.Array.from_buffers(pa.binary(), len(x), [None, places, raw])
                top = r.top(x.astype(np.float32), p.probes).astype(np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum((top >= 0).sum(axis=1))]).astype(np.int32))
                parts = pa.ListArray.from_arrays(ends, pa.array(top[top >= 0]))
                yield pa.RecordBatch.from_arrays([some.column("rep"), v, pa.array(e.astype(np.float32)), parts], _ROUTED.names)

    return reps.select("rep", "vec").mapInArrow(run, _ROUTED)


#: More than what single precision adds to a similarity of two copies.
_FLOAT = 5e-5
#: Similarities that are equal after rounding are no further apart.
_ROUND = 1e-6

#: A pair with bounds of its similarity, or where ib >= 0 a query that must meet all stored vectors of a tile, none of them nearer than high.
_MET = T.StructType([T.StructField(c, t) for c, t in (("q", T.LongType()), ("i", T.LongType()), ("low", T.FloatType()), ("high", T.FloatType()), ("part", T.IntegerType()), ("ib", T.IntegerType()), ("qb", T.IntegerType()))])


def _own(names: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the meetings of a vector with itself; ids are in order."""
    c = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
    r = np.flatnonzero(ids[c] == names)
    return r, c[r]


def _tile(p: AnnParams, keep: int):
    def vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = table.column("v").combine_chunks()
        a = a.chunk(0) if isinstance(a, pa.ChunkedArray) else a
        if not len(a):
            return np.zeros(0, np.int64), np.zeros((0, p.dim), np.float32), np.zeros(0, np.float32)
        _, ends, raw = a.buffers()
        ends = np.frombuffer(ends, np.int32)[a.offset : a.offset + len(a) + 1]
        x = _unpack(np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].reshape(len(a), -1), p.dim)
        return table.column("rep").to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True), table.column("e").to_numpy()

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        qi, q, qe = vectors(table.take(np.flatnonzero(asks)))
        stored = table.take(np.flatnonzero(~asks))
        ii, x, xe = vectors(stored.sort_by("rep"))
        part, ib, qb = (k.as_py() for k in key)
        found: list[tuple[np.ndarray, ...]] = []
        room = len(ii)
        for at in range(0, len(qi) if len(ii) else 0, 512):
            s = q[at : at + 512] @ x.T
            names, slack = qi[at : at + 512], qe[at : at + 512] + np.float32(_FLOAT)
            s[_own(names, ii)] = -9
            may = s >= (-2 if p.least is None else p.least - _ROUND) - slack[:, None] - xe
            many = np.flatnonzero(np.count_nonzero(may, axis=1) > keep)
            if len(many):
                # The k-th highest lower bound; what cannot reach it is not among the k nearest.
                low = s[many] - xe
                kth = np.partition(low, len(ii) - p.k, axis=1)[:, len(ii) - p.k]
                may[many] &= s[many] + xe >= (kth - 2 * slack[many] - np.float32(_ROUND))[:, None]
                # As many pairs of such queries as there are stored vectors cost no more than those would.
                count = np.count_nonzero(may[many], axis=1)
                still = (count > keep) & (np.cumsum(np.where(count > keep, count, 0)) > room)
                room -= int(count[(count > keep) & ~still].sum())
                many, low = many[still], low[still]
            if len(many):
                high = np.where(may[many], s[many] + xe, np.float32(-9)).max(axis=1) + slack[many]
                n, none = len(many), np.full(len(many), -9, np.float32)
                found.append((names[many], np.zeros(n, np.int64), none, high, np.full(n, ib, np.int32)))
                # Their k best still tell other tiles what is near enough.
                may[many] = False
                may[many[:, None], np.argpartition(low, len(ii) - p.k, axis=1)[:, len(ii) - p.k :]] = True
            r, c = np.nonzero(may)
            v, e = s[r, c], xe[c] + slack[r]
            found.append((names[r], ii[c], v - e, v + e, np.full(len(r), -1, np.int32)))
        types = (np.int64, np.int64, np.float32, np.float32, np.int32)
        cols = [np.concatenate(z).astype(t) for z, t in zip(zip(*found), types)] if found else [np.zeros(0, t) for t in types]
        here = [np.full(len(cols[0]), k, np.int32) for k in (part, qb)]
        return pa.table(dict(zip(_MET.names, [*cols[:4], here[0], cols[4], here[1]])))

    return run


_PAIR = T.StructType([T.StructField("q", T.LongType()), T.StructField("i", T.LongType())])


def _stored_tile(p: AnnParams):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        stored, asking = table.take(np.flatnonzero(~asks)).sort_by("rep"), table.take(np.flatnonzero(asks))
        ii, qi = stored.column("rep").to_numpy(), asking.column("rep").to_numpy()
        x, asked = (_unit(t.column("vec").combine_chunks(), p.dim) if t.num_rows else np.zeros((0, p.dim)) for t in (stored, asking))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for at in range(0, len(qi) if len(ii) else 0, 512):
            s = np.round(asked[at : at + 512] @ x.T, 6)
            names = qi[at : at + 512]
            s[_own(names, ii)] = -9
            kth = np.partition(s, max(0, len(ii) - p.k), axis=1)[:, max(0, len(ii) - p.k)][:, None]
            above, equal = s > kth, s == kth
            # The columns are in the order of the ids: of equal similarities the first ones.
            near = above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= p.k - np.count_nonzero(above, axis=1)[:, None]))
            r, c = np.nonzero(near & (s >= (-2 if p.least is None else p.least)))
            found.append((names[r], ii[c]))
        return pa.table({"q": np.concatenate([f[0] for f in found]), "i": np.concatenate([f[1] for f in found])})

    return run


_SIMS = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("up", T.BooleanType()), T.StructField("down", T.BooleanType()), T.StructField("sim", T.DoubleType())])


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of vx and vy in double precision."""
    for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
        n = batch.num_rows
        x, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) for c in ("vx", "vy"))
        dot = lambda a, b: np.einsum("ij,ij->i", a, b)
        sim = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "y", "up", "down")), pa.array(sim)], _SIMS.names)


def near_classes(reps: DataFrame, asking: DataFrame | None, p: AnnParams) -> DataFrame:
    """(q, i, sim): of each asking representative the most similar others, sim exact and rounded to 6 decimals.

    ``asking`` lists the representatives that ask, in a column rep; all do without it.
    """
    rows = reps.count()
    router = fit(reps, rows, p)
    placed = written(routed(reps, router, p), "placed")
    ask = placed if asking is None else placed.join(asking, "rep", "left_semi")
    # How many blocks a part has: one row for each part, at most most_parts.
    home = F.element_at("parts", 1).alias("part")
    heard = ask.select(F.explode("parts").alias("part"), F.lit(0).alias("s"), F.lit(1).alias("a"))
    many = lambda name, block: F.greatest(F.ceil(F.sum(name) / block), F.lit(1)).cast("int")
    blocks = placed.select(home, F.lit(1).alias("s"), F.lit(0).alias("a")).unionByName(heard).groupBy("part").agg(many("s", p.index_block).alias("ni"), many("a", p.query_block).alias("nq"))
    blocks = written(blocks, "blocks")
    own = {k: F.pmod(F.xxhash64(F.lit(7), "rep"), F.col(f"n{k}")).cast("int") for k in "iq"}
    spread = {k: F.explode(F.sequence(F.lit(0), F.col(f"n{k}") - 1)) for k in "iq"}
    index = placed.select("rep", "v", "e", home).join(F.broadcast(blocks), "part").select("rep", "v", "e", F.lit(False).alias("asks"), "part", own["i"].alias("ib"), spread["q"].alias("qb"))
    query = ask.select("rep", "v", "e", F.explode("parts").alias("part")).join(F.broadcast(blocks), "part").select("rep", "v", "e", F.lit(True).alias("asks"), "part", spread["i"].alias("ib"), own["q"].alias("qb"))
    met = index.unionByName(query).groupBy("part", "ib", "qb").applyInArrow(_tile(p, p.k + p.extra), _MET)
    per = Window.partitionBy("q")
    met = met.withColumn("r", F.row_number().over(per.orderBy(F.col("low").desc()))).withColumn("kth", F.max(F.when(F.col("r") == p.k, F.col("low"))).over(per))
    met = met.where(F.col("kth").isNull() | (F.col("high") >= F.col("kth") - F.lit(_ROUND))).drop("r", "kth")
    met = written(met, "met")
    chosen = met.where(F.col("ib") < 0).select("q", "i")
    crowded = met.where(F.col("ib") >= 0).select(F.col("q").alias("rep"), "part", "ib", "qb")
    if not crowded.isEmpty():
        tiles = crowded.select("part", "ib", "qb").distinct()
        held = placed.select("rep", home).join(F.broadcast(blocks), "part").select("rep", "part", own["i"].alias("ib")).join(tiles, ["part", "ib"])
        both = held.withColumn("asks", F.lit(False)).unionByName(crowded.withColumn("asks", F.lit(True)))
        stored = both.join(reps, "rep").groupBy("part", "ib", "qb").applyInArrow(_stored_tile(p), _PAIR)
        chosen = chosen.unionByName(stored)
    # Each unordered pair is computed once; the vectors that no pair needs stay where they are.
    pairs = chosen.select(F.least("q", "i").alias("x"), F.greatest("q", "i").alias("y"), (F.col("q") < F.col("i")).alias("up"))
    pairs = pairs.groupBy("x", "y").agg(F.max("up").alias("up"), F.max(~F.col("up")).alias("down"))
    left, right = reps.select(F.col("rep").alias("x"), F.col("vec").alias("vx")), reps.select(F.col("rep").alias("y"), F.col("vec").alias("vy"))
    sims = pairs.join(left, "x").join(right, "y").select("x", "y", "up", "down", "vx", "vy").mapInArrow(_similarities, _SIMS)
    sims = sims.withColumn("sim", F.round("sim", 6))
    ways = F.array(F.when(F.col("up"), F.struct(F.col("x").alias("q"), F.col("y").alias("i"))), F.when(F.col("down"), F.struct(F.col("y").alias("q"), F.col("x").alias("i"))))
    out = sims.select("sim", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select("w.q", "w.i", "sim")
    return out if p.least is None else out.where(F.col("sim") >= p.least)


#: Most lists that are looked up in a broadcast; a class with fewer than one in so many of the rows is no burden for a task.
_LISTS = 1024


def similar_vectors(vectors: DataFrame, p: AnnParams = AnnParams(), id_col: str = "id", vector_col: str = "embedding", asking: Column | None = None) -> DataFrame:
    """(id, neighbour, sim, rank): of each asking row the up to k most similar others, ties by the smaller id.

    ``asking`` is a condition on a column id; all rows ask without it.  Vectors
    that are null, of another length, all zero or hold a null, NaN or infinite
    value neither ask nor are found; rows with one id count once; with
    ``p.least`` only neighbours at least that similar come out.  An empty table
    gives an empty result; other columns are ignored.
    """
    reps, members = vector_classes(vectors, p, id_col, vector_col)
    asks = members if asking is None else members.where(asking)
    near = near_classes(reps, None if asking is None else asks.select("rep").distinct(), p)
    # Of a class at most its k + 1 smallest ids can be among the best of any row.
    small = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= p.k + 1)
    several = small.where(F.col("r") == 2).select(F.col("rep").alias("q"), F.col("rep").alias("i"), F.lit(1.0).alias("sim"))
    listed = near.unionByName(several).join(small.select(F.col("rep").alias("i"), F.col("id").alias("neighbour")), "i")
    order = lambda of: Window.partitionBy(of).orderBy(F.col("sim").desc(), "neighbour")
    short = listed.withColumn("r", F.row_number().over(order("q"))).where(F.col("r") <= p.k + 1).select("q", "neighbour", "sim")
    # One list for each class that asks, so that a class of many rows is looked up and not met in one task.
    lists = short.groupBy("q").agg(F.collect_list(F.struct("neighbour", "sim")).alias("l"))
    lists = lists.join(asks.groupBy(F.col("rep").alias("q")).agg(F.count(F.lit(1)).alias("n")), "q")
    out = lookup_join(asks.select(F.col("rep").alias("q"), "id"), lists, "q", "n", _LISTS).select("id", F.explode("l").alias("x")).select("id", "x.neighbour", "x.sim")
    out = out.where(F.col("id") != F.col("neighbour"))
    return out.withColumn("rank", F.row_number().over(order("id"))).where(F.col("rank") <= p.k).select("id", "neighbour", "sim", "rank")
