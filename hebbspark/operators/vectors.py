"""Vectors and geometry: embedding, similarity search in blocks, holes, axes, sectors and walks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hebbspark.operators.activate import activate
from hebbspark.operators.edges import at_tick, pair_weights
from hebbspark.operators.ranking import stable_topk
from hebbspark.params import EdgeParams

DIGITS = 9


class Embedder(Protocol):
    """Anything that turns texts into rows of ``dim`` numbers."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Counts of lower-case words in ``dim`` buckets, chosen by a keyed digest, scaled to length 1; no words give zeros."""

    def __init__(self, dim: int = 128, seed: int = 0):
        self.dim, self.seed = dim, seed

    def encode(self, texts: list[str]) -> np.ndarray:
        place: dict[str, int] = {}
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for word in (text or "").lower().split():
                if word not in place:
                    digest = hashlib.blake2b(f"{self.seed}:{word}".encode(), digest_size=8).digest()
                    place[word] = int.from_bytes(digest, "little") % self.dim
                out[row, place[word]] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def embed(records: DataFrame, embedder: Embedder, text: str = "content", out: str = "vec") -> DataFrame:
    """``records`` with a vector for every row; null texts are embedded as empty ones."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.encode([t or "" for t in texts])), index=texts.index, dtype=object)

    return records.withColumn(out, run(F.col(text)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays in double precision, term by term in order."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, v: s + v)


def seed_topk(queries: DataFrame, vectors: DataFrame, k: int = 8, block: int = 4096) -> DataFrame:
    """(query_id, id, similarity, rank): the k rows of ``vectors`` (id, vec) with the largest inner product, ties by id.

    Exact, in tiles of query rows and vector rows: queries are a stated set,
    and no tile holds more than about ``block`` of either.  Rows whose vectors
    are null or of another length than the other side's do not meet.
    """
    tiles = lambda df, name: max(1, -(-df.count() // block))
    nq, nv = tiles(queries, "q"), tiles(vectors, "v")
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.where("vec IS NOT NULL").select(F.col("query_id").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.lit(True).alias("asks"), F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("qt"), side(nv).alias("vt"))
    v = vectors.where("vec IS NOT NULL AND id >= 1").select("id", F.col("vec").cast("array<double>").alias("vec"), F.lit(False).alias("asks"), side(nq).alias("qt"), F.pmod(F.xxhash64("id"), F.lit(nv)).cast("int").alias("vt"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.assign(n=pdf["vec"].str.len())
        for _, same in pdf.groupby("n"):
            ask, have = same[same["asks"]], same[~same["asks"]].sort_values("id")
            if not len(ask) or not len(have):
                continue
            a, b = np.stack(ask["vec"].to_numpy()), np.stack(have["vec"].to_numpy())
            ids = have["id"].to_numpy()
            for at in range(0, len(a), 256):
                s = np.round(a[at : at + 256] @ b.T, DIGITS)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out.append(pd.DataFrame({"query_id": np.repeat(ask["id"].to_numpy()[at : at + 256], best.shape[1]), "id": ids[best].ravel(), "similarity": np.take_along_axis(s, best, axis=1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    met = q.unionByName(v).groupBy("qt", "vt").applyInPandas(tile, "query_id long, id long, similarity double")
    return stable_topk(met, ["query_id"], "similarity", k)


def recall(queries: DataFrame, vectors: DataFrame, trans: DataFrame, live: DataFrame | None = None, budget: int = 16, seeds: int = 8, hops: int = 2, cutoff: float = 1e-3) -> DataFrame:
    """(query_id, id, score, rank): seeds by similarity, spread over the graph, the larger of both counts; live records only."""
    near = seed_topk(queries, vectors, seeds).withColumn("similarity", F.greatest("similarity", F.lit(0.0)))
    act = activate(near.select("query_id", F.col("id").alias("node"), F.col("similarity").alias("weight")), trans, hops, cutoff, 4 * budget)
    both = near.select("query_id", "id", F.col("similarity").alias("score")).unionByName(act.scores.select("query_id", F.col("node").alias("id"), "score"))
    best = both.groupBy("query_id", "id").agg(F.round(F.max("score"), DIGITS).alias("score"))
    if live is not None:
        best = best.join(live.select("id"), "id", "left_semi")
    return stable_topk(best, ["query_id"], "score", budget).select("query_id", "id", "score", "rank")


def unexplored(nodes: DataFrame, vectors: DataFrame, edges: DataFrame, tick: int, p: EdgeParams, k: int = 32, tau: float = 0.35, eps: float = 1e-3) -> DataFrame:
    """(a, b, similarity, pair_weight): structural holes, pairs that are similar and hardly linked.

    For every listed node its k most similar rows, itself among them, then
    those above tau whose edge reads below eps at the tick; each pair once.
    """
    asks = vectors.join(nodes.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "vec")
    near = seed_topk(asks, vectors, k).where((F.col("query_id") != F.col("id")) & (F.col("similarity") > tau))
    pairs = near.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return pair_weights(pairs, edges, tick, p).where(F.col("pair_weight") < eps)


_MOMENTS = "group_id long, n long, s array<double>, q array<double>"


def directions(members: DataFrame, count: int) -> DataFrame:
    """(group_id, n, d): the number of vectors of each group and their first principal directions, from (group_id, vec).

    A group is never gathered.  Where a batch has more of its vectors than they
    have values, they become one sum and one matrix of products; few ones stay
    as they are.  A direction's largest component is positive.  The vectors of
    a group have one length; null ones do not count.
    """

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for group, own in pdf.groupby("group_id"):
                x = np.stack(own["vec"].to_numpy()).astype(np.float64)
                if len(x) > x.shape[1]:
                    yield pd.DataFrame({"group_id": [group], "n": [len(x)], "s": [x.sum(axis=0)], "q": [(x.T @ x).ravel()]})
                else:
                    yield pd.DataFrame({"group_id": group, "n": 1, "s": list(x), "q": [None] * len(x)})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = int(pdf["n"].sum()), np.stack(pdf["s"].to_numpy())
        mean = s.sum(axis=0) / n
        single = s[pdf["q"].isna().to_numpy()] - mean
        spread = single.T @ single
        for m, own, q in zip(pdf["n"], pdf["s"], pdf["q"]):
            if q is not None:
                own = np.asarray(own)
                spread += np.asarray(q).reshape(len(mean), -1) - np.outer(own, mean) - np.outer(mean, own) + m * np.outer(mean, mean)
        _, v = np.linalg.eigh(spread)
        top = v.T[::-1][:count]
        top = top * np.sign(top[np.arange(len(top)), np.argmax(np.abs(top), axis=1)])[:, None]
        return pd.DataFrame({"group_id": [pdf["group_id"].iloc[0]], "n": [n], "d": [top.tolist()]})

    rows = members.where("vec IS NOT NULL").select("group_id", "vec").mapInPandas(reduce, _MOMENTS)
    return rows.groupBy("group_id").applyInPandas(solve, "group_id long, n long, d array<array<double>>")


def axis(members: DataFrame) -> DataFrame:
    """(group_id, id, projection, place): nodes of a group along its first principal direction.

    ``members`` has group_id, id, vec; a group is one query's node set.  Ties go
    by id; a group of one projects to 0.
    """
    rows = members.where("vec IS NOT NULL").select("group_id", "id", "vec")
    met = rows.join(directions(members, 1), "group_id")
    placed = met.select("group_id", "id", F.when(F.col("n") > 1, dot("vec", F.col("d")[0])).otherwise(F.lit(0.0)).alias("projection"))
    order = Window.partitionBy("group_id").orderBy(F.round("projection", DIGITS), "id")
    return placed.withColumn("place", F.row_number().over(order).cast("long"))


def sectors(centres: DataFrame, members: DataFrame, n: int = 12) -> DataFrame:
    """(group_id, sector, count, theta): neighbours of each centre by angle in their first two principal directions.

    ``centres`` has group_id, vec; ``members`` group_id, id, vec.  The plane is
    that of the centred displacements, the angles those of the displacements
    themselves; theta is the middle of the sector.  Fewer than 3 neighbours
    give no row, empty sectors count 0.
    """
    own = centres.where("vec IS NOT NULL").select("group_id", F.col("vec").alias("_c")).dropDuplicates(["group_id"])
    plane = directions(members, 2).where((F.col("n") >= 3) & (F.size("d") > 1)).join(own, "group_id")
    step = 2 * math.pi / n
    part = lambda i: dot("vec", F.col("d")[i]) - dot("_c", F.col("d")[i])
    angle = F.atan2(part(1), part(0))
    at = F.least(F.greatest(F.floor((angle + math.pi) / step), F.lit(0)), F.lit(n - 1))
    counted = members.where("vec IS NOT NULL").join(plane, "group_id").groupBy("group_id", at.alias("sector")).agg(F.count(F.lit(1)).alias("count"))
    every = plane.select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("sector"))
    theta = (F.col("sector") + 0.5) * step - math.pi
    return every.join(counted, ["group_id", "sector"], "left").select("group_id", "sector", F.coalesce("count", F.lit(0)).alias("count"), theta.alias("theta"))


def walk(starts: DataFrame, adj: DataFrame, vectors: DataFrame, tick: int, p: EdgeParams, hops: int = 4, alpha: float = 0.5, cap: int = 32) -> DataFrame:
    """(query_id, path): greedy walks along a direction, from (query_id, node, direction).

    At every hop the unvisited neighbour alive at the tick whose displacement
    has the largest cosine with the direction is taken, ties by the smaller id;
    the direction then turns towards the step by 1 - alpha.  A zero direction
    gives an empty path; the path ends where no neighbour is left, after
    ``hops`` steps, or at ``cap`` nodes.
    """
    rows = at_tick(adj, tick, p).where(F.col("now") >= p.floor).select("src", "dst")
    vec = vectors.where("vec IS NOT NULL").select(F.col("id").alias("node"), F.col("vec").cast("array<double>").alias("vec"))
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(dot(c, c)))
    state = starts.select("query_id", "node", F.col("direction").cast("array<double>").alias("d")).where(dot("d", "d") > 0)
    state = state.join(vec, "node").select("query_id", "node", "vec", unit(F.col("d")).alias("d"), F.array("node").alias("path"))
    done = state.select("query_id", "path")
    for _ in range(min(hops, cap - 1)):
        met = state.join(rows, state.node == rows.src).where(~F.array_contains("path", F.col("dst")))
        met = met.join(vec.select(F.col("node").alias("dst"), F.col("vec").alias("to")), "dst").withColumn("step", F.zip_with("to", "vec", lambda x, y: x - y)).withColumn("norm", F.sqrt(dot("step", "step"))).where("norm > 0")
        met = met.withColumn("cos", F.round(dot("step", "d") / F.col("norm"), 12))
        best = Window.partitionBy("query_id").orderBy(F.col("cos").desc(), "dst")
        met = met.withColumn("_r", F.row_number().over(best)).where("_r = 1")
        path = F.array_append("path", F.col("dst"))
        done = done.unionByName(met.select("query_id", path.alias("path")))
        turned = F.zip_with("d", "step", lambda x, y: F.lit(float(alpha)) * x + F.lit(1.0 - alpha) * y / F.col("norm"))
        state = met.select("query_id", F.col("dst").alias("node"), F.col("to").alias("vec"), turned.alias("d"), path.alias("path")).where(dot("d", "d") > 0).withColumn("d", unit(F.col("d")))
    longest = done.groupBy("query_id").agg(F.max_by("path", F.size("path")).alias("path"))
    return starts.select("query_id").join(longest, "query_id", "left").withColumn("path", F.coalesce("path", F.array().cast("array<long>")))
