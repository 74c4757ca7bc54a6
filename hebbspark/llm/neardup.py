"""Near-duplicate records: weighted min-hashing over TF-IDF shingles, banded and verified.

Improved consistent weighted sampling (Ioffe 2010) gives every record one
sample per hash function, such that two records agree in a sample with the
probability of their weighted Jaccard similarity.  As that can be far below the
set similarity where rare shingles differ, as many samples are taken with all
weights equal; the exact set similarity alone decides.  Records with equal shingle
counts are one class, and only class representatives are hashed and compared.
Samples are banded; a band bucket of up to ``bucket_limit`` representatives
gives its pairs as candidates.  Of the members of larger buckets the candidates
come from the bucket as well or from an exact prefix filter, which finds every
pair at the set similarity asked for, whichever compares fewer, so no link is
lost to the limit.  Pairs whose sketches prove them too different are no
candidates: chance meetings grow with the square of a key's records, links do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hebbspark.functions.text import tokens
from hebbspark.operators.skew import HEAD_LIMIT, lookup_join
from hebbspark.session import written


@dataclass(frozen=True)
class NearDupParams:
    """shingle: terms per shingle; least_terms: distinct shingles a record must have to take part; bands: of either kind of samples."""

    similarity: float = 0.8
    shingle: int = 5
    least_terms: int = 1
    bands: int = 64
    rows: int = 4
    bucket_limit: int = 256
    seed: int = 20240711
    head_limit: int = HEAD_LIMIT


def shingles(text: Column | str, size: int) -> Column:
    """The runs of ``size`` consecutive terms, joined by spaces; a shorter text is one shingle, an empty text none."""
    terms = tokens(text)
    if size == 1:
        return terms
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(terms) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(terms, i, size), " "))
    return F.when(F.size(terms) == 0, F.array().cast("array<string>")).otherwise(runs)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit states, by the splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def icws_keys(hashes: np.ndarray, weights: np.ndarray, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each weighted element and sample: the logarithm to be minimised, and the step t that is part of the sample."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        base = hashes.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)
        base = base + (np.arange(samples, dtype=np.uint64) * np.uint64(5) + np.uint64(seed))[None, :] * step
        u = [_uniform(base + np.uint64(i) * step) for i in range(5)]
    r = -np.log(u[0] * u[1])
    t = np.floor(np.log(weights)[:, None] / r + u[4])
    return (np.log(-np.log(u[2] * u[3])) - r * (t - u[4]) - r).astype(np.float32), t.astype(np.int32)


def icws_bands(flat: np.ndarray, weights: np.ndarray, sizes: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """(records, bands) int64 hashes of the samples; record i owns the next sizes[i] >= 1 elements of flat and weights."""
    flat, weights = flat.astype(np.int64), weights.astype(np.float32)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    with np.errstate(over="ignore"):
        joint = flat.view(np.uint64) * np.uint64(0xD1342543DE82EF95) ^ weights.view(np.uint32).astype(np.uint64) * np.uint64(0xAF251AF3B0F025B5)
    _, first, where = np.unique(joint, return_index=True, return_inverse=True)
    h, w = flat[first], weights[first].astype(np.float64)
    names = h.view(np.uint64)[:, None]
    out = np.empty((len(sizes), bands), dtype=np.int64)
    step = max(1, 16 // rows)
    for at in range(0, bands, step):
        width = min(step, bands - at) * rows
        low, t = icws_keys(h, w, width, seed + at * rows * 7)
        with np.errstate(over="ignore"):
            code = (names ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))) * np.uint64(0xC4CEB9FE1A85EC53)
        bits = low.view(np.uint32)
        # Floats in the order of their values, above the code: one minimum finds the sample, and equal floats fall to the smaller code.
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        key = (ordered << np.uint64(32)) | (code >> np.uint64(32))
        picked = np.minimum.reduceat(key[where], starts, axis=0) & np.uint64(0xFFFFFFFF)
        with np.errstate(over="ignore"):
            for b in range(width // rows):
                mix = np.full(len(sizes), np.uint64(at + b + 1))
                for k in range(rows):
                    mix = (mix ^ picked[:, b * rows + k]) * np.uint64(0x9E3779B97F4A7C15)
                    mix ^= mix >> np.uint64(29)
                out[:, at + b] = mix.view(np.int64)
    return out


_BANDED = T.StructType([T.StructField("rep", T.LongType()), T.StructField("k", T.LongType()), T.StructField("m", T.IntegerType()), T.StructField("buckets", T.ArrayType(T.LongType()))])


def band_buckets(sets: DataFrame, p: NearDupParams) -> DataFrame:
    """(rep, k, m, buckets): the bucket of each band, from (rep, k, hs, ws)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small slices: a worker that waits for its next task holds little memory.
        for batch in (b.slice(at, 2500) for b in batches for at in range(0, b.num_rows, 2500)):
            hs, ws = batch.column("hs"), batch.column("ws")
            sizes = hs.value_lengths().to_numpy()
            flat, weights = hs.flatten().to_numpy(), ws.flatten().to_numpy()
            plain = icws_bands(flat, np.ones_like(weights), sizes, p.bands, p.rows, p.seed + 1_000_003)
            v = np.concatenate([icws_bands(flat, weights, sizes, p.bands, p.rows, p.seed), ~plain], axis=1)
            k = batch.column("k").to_numpy().view(np.uint64)[:, None]
            with np.errstate(over="ignore"):
                v = ((v.view(np.uint64) ^ (k * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)).view(np.int64)
            ends = pa.array((np.arange(len(v) + 1) * v.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("k"), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], _BANDED.names)

    return sets.select("rep", "k", "hs", "ws").mapInArrow(run, _BANDED)


def _weighted_jaccards(ha: pa.Array, wa: pa.Array, hb: pa.Array, wb: pa.Array) -> np.ndarray:
    """Sum of the smaller weights over the sum of the larger; both sides have distinct hashes."""
    n = len(ha)
    pair = np.concatenate([np.repeat(np.arange(n), x.value_lengths().to_numpy()) for x in (ha, hb)])
    h = np.concatenate([x.flatten().to_numpy() for x in (ha, hb)])
    w = np.concatenate([x.flatten().to_numpy() for x in (wa, wb)]).astype(np.float64)
    order = np.lexsort((h, pair))
    pair, h, w = pair[order], h[order], w[order]
    same = (pair[1:] == pair[:-1]) & (h[1:] == h[:-1])
    both = np.bincount(pair[1:][same], np.minimum(w[1:], w[:-1])[same], n)
    return both / np.maximum(np.bincount(pair, w, n) - both, 1e-300)


_COMPARED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("weighted", T.DoubleType()), T.StructField("jaccard", T.DoubleType())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 2500) for b in batches for at in range(0, b.num_rows, 2500)):
        ha, wa, hb, wb = (batch.column(c) for c in ("ha", "wa", "hb", "wb"))
        ones = [pa.ListArray.from_arrays(x.offsets, pa.array(np.ones(len(x.values)))) for x in (ha, hb)]
        plain = _weighted_jaccards(ha, ones[0], hb, ones[1])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(_weighted_jaccards(ha, wa, hb, wb)), pa.array(plain)], _COMPARED.names)


def shingled(records: DataFrame, p: NearDupParams, id_col: str = "id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(id, k, hs): hashes of the shingles in order, repeats kept, one row per id; k is a hash of the key, null without one."""
    key = F.lit("") if key is None else key
    rows = records.select(F.col(id_col).alias("id"), F.when(key.isNotNull(), F.xxhash64(key)).alias("k"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("id").isNotNull()).dropDuplicates(["id"])
    return rows.select("id", "k", F.array_sort(F.transform(shingles("text", p.shingle), lambda t: F.xxhash64(t))).alias("hs"))


def able(rows: DataFrame, p: NearDupParams) -> DataFrame:
    return rows.where(F.col("k").isNotNull() & (F.size(F.array_distinct("hs")) >= p.least_terms))


def classes(rows: DataFrame, p: NearDupParams) -> DataFrame:
    """(id, class): records of one key with the same shingles and counts are one class, named by its smallest id."""
    prints = able(rows, p).select("id", F.struct("k", F.xxhash64("hs").alias("h1"), F.xxhash64(F.lit(1), "hs").alias("h2")).alias("print"))
    heads = prints.groupBy("print").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n"))
    return lookup_join(prints, heads, "print", "n", p.head_limit).select("id", "class")


def weighted_sets(rows: DataFrame, members: DataFrame, p: NearDupParams) -> DataFrame:
    """(rep, k, hs, idfs, ws): hashes and TF-IDF weights of each representative's shingles.

    The weight is (1 + ln n) ln(1 + N / d); N and d are of all rows.
    """
    total = rows.where(F.size("hs") > 0).count()
    every = rows.select(F.explode(F.array_distinct("hs")).alias("h"))
    spread = every.groupBy("h").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + F.lit(float(total)) / F.col("df")).cast("float"))
    mine = able(rows, p).join(members.where(F.col("id") == F.col("class")).select("id"), "id", "left_semi")
    counted = mine.select("id", "k", F.explode("hs").alias("h")).groupBy("id", "k", "h").agg(F.count(F.lit(1)).cast("int").alias("n"))
    weighed = lookup_join(counted, spread, "h", "df", p.head_limit)
    # Grouped by id alone, so that joins on it need no further exchange; the lists are filled row by row and stay aligned.
    sets = weighed.groupBy("id").agg(F.first("k").alias("k"), F.collect_list("h").alias("hs"), F.collect_list("idf").alias("idfs"), F.collect_list("n").alias("ns"))
    weigh = F.zip_with("idfs", "ns", lambda i, n: ((1 + F.log(n.cast("double"))) * i).cast("float"))
    return sets.select(F.col("id").alias("rep"), "k", "hs", "idfs", weigh.alias("ws"))


#: One over the share of all rows from which a bucket is set apart.
_HOT = 65_536
#: Members of a bucket that one task compares with all others.
_BLOCK = 4_096
#: 64-bit words of a sketch.
_WORDS = 2


def sketch(hashes: str) -> list[Column]:
    """Columns s0, s1...: bit i is the parity of the number of hashes that fall on it.

    Two sketches differ in at most as many bits as there are elements in only
    one of the two sets.
    """
    bit = f"pmod(h, {64 * _WORDS})"
    return [F.expr(f"aggregate(filter({hashes}, h -> {bit} div 64 = {i}), 0L, (s, h) -> s ^ shiftleft(1L, cast({bit} % 64 AS int)))").alias(f"s{i}") for i in range(_WORDS)]


def _may_match(p: NearDupParams) -> Column:
    """Of rows x and y with m and a sketch: whether the sets may be as similar as asked for; never false where they are."""
    m, n = F.col("x.m"), F.col("y.m")
    # Sets of sizes m and n have a similarity of at most min / max, and similar ones differ in at most (m + n) (1 - s) / (1 + s) elements.
    fits = F.least(m, n) >= p.similarity * F.greatest(m, n) - 1e-9
    apart = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(_WORDS)), F.lit(0))
    return (F.col("x.rep") < F.col("y.rep")) & fits & (apart <= (m + n) * ((1 - p.similarity) / (1 + p.similarity)) + 1e-6)


def candidates(sets: DataFrame, p: NearDupParams) -> DataFrame:
    """(a, b), distinct, a < b: pairs of representatives of one key that may be similar enough."""
    each = band_buckets(sets, p).select("rep", "m", F.explode("buckets").alias("bucket")).persist()
    # Buckets with a 65,536th of the rows of a 64th of the table are set apart before the exchange.  There can be no more than
    # 65,536 of them, and of what is left no bucket is a large share of the exchange.
    seen = each.where(F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(64)) == 0).groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).persist()
    rows = seen.agg(F.sum("c")).first()[0] or 0
    hot = seen.where(F.col("c") >= max(8, p.bucket_limit // 16, -(-rows // _HOT))).select("bucket").persist()
    in_bucket = F.count(F.lit(1)).over(Window.partitionBy("bucket"))
    met = written(each.join(F.broadcast(hot), "bucket", "left_anti").withColumn("size", in_bucket).where(F.col("size") > 1), "buckets")
    apart = each.join(F.broadcast(hot), "bucket", "left_semi").select("rep")
    sketches = sets.select("rep", *sketch("hs"))
    pair = F.col("x.rep").alias("a"), F.col("y.rep").alias("b")

    def within(met: DataFrame) -> DataFrame:
        """Pairs of members of one bucket; members of a large one are compared block by block."""
        rows = met.join(sketches, "rep")
        blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
        x = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).alias("x")
        y = rows.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("y")
        return x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") == F.col("y.block")) & _may_match(p)).select(*pair)

    small, crowded = met.where(F.col("size") <= p.bucket_limit), met.where(F.col("size") > p.bucket_limit)
    if hot.isEmpty() and crowded.isEmpty():
        return within(small).distinct()
    # Any two sets at the similarity share one of their first m - ceil(s m) + 1 elements in a common order.
    head = F.size("hs") - F.ceil(p.similarity * F.size("hs") - 1e-9) + 1
    rarest = F.sort_array(F.arrays_zip(F.col("idfs").alias("i"), F.col("hs").alias("h")), asc=False)
    heads = sets.join(crowded.select("rep").unionByName(apart).distinct(), "rep", "left_semi")
    heads = heads.select("rep", "k", F.size("hs").alias("m"), *sketch("hs"), F.explode(F.slice(rarest, F.lit(1), head.cast("int"))).alias("e"))
    heads = written(heads.withColumn("h", F.col("e.h")).drop("e"), "heads")
    # A crowded bucket goes to the prefix filter where its members meet fewer others by their first elements than in all their crowded buckets.
    named = heads.select("rep", F.xxhash64("k", "h").alias("e"))
    by_heads = lookup_join(named, named.groupBy("e").agg(F.count(F.lit(1)).alias("n")), "e", "n", p.head_limit).groupBy("rep").agg(F.sum("n").alias("by_heads"))
    by_buckets = crowded.groupBy("rep").agg(F.sum("size").alias("by_buckets"))
    weighed = crowded.select("bucket", "rep").join(by_buckets.join(by_heads, "rep"), "rep")
    dear = written(weighed.groupBy("bucket").agg(F.sum("by_heads").alias("h"), F.sum("by_buckets").alias("b")).where("b > h").select("bucket"), "dear-buckets")
    near = within(small.unionByName(crowded.join(dear, "bucket", "left_anti").select(*small.columns)))
    filtered = heads.join(crowded.join(dear, "bucket", "left_semi").select("rep").unionByName(apart).distinct(), "rep", "left_semi")
    x, y = filtered.alias("x"), filtered.alias("y")
    rest = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.h") == F.col("y.h")) & _may_match(p)).select(*pair)
    return near.unionByName(rest).distinct()


def verified(pairs: DataFrame, sets: DataFrame, p: NearDupParams) -> DataFrame:
    """(a, b, weighted, jaccard) of the candidates whose sets of shingles are at least as similar as asked for."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = sets.select("rep", "hs", "ws").join(needed, "rep", "left_semi")
    left = sets.select(F.col("rep").alias("a"), F.col("hs").alias("ha"), F.col("ws").alias("wa"))
    right = sets.select(F.col("rep").alias("b"), F.col("hs").alias("hb"), F.col("ws").alias("wb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(_compared, _COMPARED)
    return met.where(F.col("jaccard") >= p.similarity)


def connected(links: DataFrame, head_limit: int = HEAD_LIMIT) -> DataFrame:
    """(node, group) of every node with a link: the smallest node that a chain of links leads to.

    Alternating large and small stars (Kiveris and others 2014): each step hangs
    a node's neighbours below its smallest one, first the larger, then the
    smaller, until nothing changes; the steps grow with the logarithm of the
    longest chain.  Every step is a table, and the smallest neighbours of hubs
    are looked up, so neither lineage nor a hub's links meet in one place.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    print_ = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    was = print_(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        edges = written(lookup_join(both, least, "u", "n", head_limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        # Every edge now leads from a larger to a smaller node.
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        down = lookup_join(edges, least, "u", "n", head_limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = print_(edges)
        if now == was:
            break
        was = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())


@dataclass
class NearDuplicates:
    """members: (id, class) of every record that takes part; links: (a, b, weighted, jaccard) between classes."""

    members: DataFrame
    links: DataFrame

    def groups(self, head_limit: int = HEAD_LIMIT) -> DataFrame:
        """(id, class, copies, links, group): one row per record.

        links counts the other records that it is similar to; records that a
        chain of links connects have one group, the smallest id among them.
        """
        size = self.members.groupBy("class").agg(F.count(F.lit(1)).alias("copies"))
        both = self.links.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(self.links.select(F.col("b").alias("class"), F.col("a").alias("other")))
        far = both.join(size.select(F.col("class").alias("other"), "copies"), "other").groupBy("class").agg(F.sum("copies").alias("far"))
        grouped = connected(self.links.select("a", "b"), head_limit)
        per = size.join(far, "class", "left").join(grouped.withColumnRenamed("node", "class"), "class", "left")
        per = per.select("class", "copies", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("links"), F.coalesce("group", "class").alias("group"))
        return lookup_join(self.members.select("id", "class"), per, "class", "copies", head_limit).select("id", "class", "copies", "links", "group")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: every pair of records, copies expanded."""
        near = self.links.select("a", "b")
        ends = near.unionByName(self.members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b")))
        left = self.members.select(F.col("class").alias("a"), F.col("id").alias("x"))
        right = self.members.select(F.col("class").alias("b"), F.col("id").alias("y"))
        out = ends.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
        return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicates(records: DataFrame, p: NearDupParams = NearDupParams(), id_col: str = "id", text_col: str = "text", key: Column | None = None) -> NearDuplicates:
    """Records of one key whose shingle sets have a Jaccard similarity of ``p.similarity`` or more.

    ``key`` is a column of ``records``; a record whose key is null takes no
    part, and without ``key`` all records are compared.  Null and empty texts
    have no shingles and take no part unless least_terms is 0; rows with one id
    count once; other columns are ignored; an empty table gives empty results.
    Equal texts of one key are one class with a similarity of 1.
    """
    rows = written(shingled(records, p, id_col, text_col, key), "shingles")
    members = written(classes(rows, p), "classes")
    sets = written(weighted_sets(rows, members, p), "sets")
    pairs = written(candidates(sets, p), "candidates")
    return NearDuplicates(members, written(verified(pairs, sets, p), "links"))


def band_recall(similarity: float, p: NearDupParams) -> float:
    """The probability that a pair of this similarity, weighted or of the sets, shares a band of that kind."""
    return 1 - math.pow(1 - similarity**p.rows, p.bands)
