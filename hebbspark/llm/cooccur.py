"""Pairs of items that share baskets more often than chance.

Identical baskets are collapsed into one with a weight, every distinct basket
is enumerated once, and the weights are summed by pair.  Two bounds prune items
before any pair exists, and lose nothing: a pair shares at most min(n(a), n(b))
baskets, so an item in fewer than ``min_count`` baskets is in no result, and
neither is one in more than T / min_lift of the T baskets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hebbspark.operators.skew import HEAD_LIMIT, lookup_join
from hebbspark.session import written

BLOCK = 256


def valid_events(events: DataFrame, items: DataFrame, a: str = "a", b: str = "b", basket: str = "tick", item_id: str = "id", head_limit: int = HEAD_LIMIT) -> DataFrame:
    """(a, b, basket) of the rows whose two items differ, are above 0 and are both listed; null baskets are dropped."""
    rows = events.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(basket).alias("basket"))
    rows = rows.where((F.col("a") > 0) & (F.col("b") > 0) & (F.col("a") != F.col("b")) & F.col("basket").isNotNull())
    ends = rows.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    known = written(ends.join(items.select(F.col(item_id).alias("x")).distinct(), "x", "left_semi"), "known")
    # One item may be an end of a large share of all rows: such are looked up.
    for end in ("a", "b"):
        rows = lookup_join(rows, known.withColumnRenamed("x", end), end, "n", head_limit).drop("n")
    return rows.select("a", "b", "basket")


def basket_items(events: DataFrame) -> DataFrame:
    """(basket, x), distinct: the items that stand at either end of a row of the basket."""
    return events.select("basket", F.explode(F.array("a", "b")).alias("x")).distinct()


def collapsed_pairs(items: DataFrame, block: int = BLOCK, head_limit: int = HEAD_LIMIT) -> DataFrame:
    """(a, b, n): in how many baskets each pair a < b is, of (basket, x) rows that are distinct.

    Baskets of up to ``block`` items become sorted arrays, equal arrays one row
    with a weight.  Larger baskets are never gathered: equal ones are found by
    count and two hash sums, and one of each is enumerated block against block,
    so that no task holds more than two blocks of about ``block`` items, and
    their sizes and weights are looked up, so that no task gets a whole basket.
    """
    sized = lookup_join(items, items.groupBy("basket").agg(F.count(F.lit(1)).alias("size")), "basket", "size", head_limit)
    arrays = sized.where(F.col("size") <= block).groupBy("basket").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    weighed = arrays.where(F.size("xs") > 1).groupBy("xs").agg(F.count(F.lit(1)).alias("w"))
    pairs = (
        weighed.select("w", "xs", F.posexplode("xs").alias("i", "a"))
        .where(F.col("i") + 1 < F.size("xs"))
        .select("w", "a", F.explode(F.expr("slice(xs, i + 2, size(xs))")).alias("b"))
    )

    members = sized.where(F.col("size") > block).withColumn("g", F.pmod(F.xxhash64("x"), F.ceil(F.col("size") / block)))
    prints = members.groupBy("basket").agg(
        F.first("size").alias("size"),
        F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(F.lit(1), "x").cast("decimal(38,0)")).alias("h2"),
    )
    chosen = prints.groupBy("size", "h1", "h2").agg(F.min("basket").alias("basket"), F.count(F.lit(1)).alias("w"))
    chosen = chosen.select("basket", "w", F.col("size").alias("rows"))
    blocks = lookup_join(members, chosen, "basket", "rows", head_limit).groupBy("basket", "w", "size", "g").agg(F.collect_list("x").alias("xs"))
    met = blocks.select("basket", "w", "xs", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block) - 1)).alias("other"))
    keyed = met.select("basket", "w", F.least("g", "other").alias("g1"), F.greatest("g", "other").alias("g2"), "g", "xs")
    left = keyed.where(F.col("g") == F.col("g1")).select("basket", "w", "g1", "g2", F.col("xs").alias("ys"))
    right = keyed.where(F.col("g") == F.col("g2")).select("basket", "g1", "g2", "xs")
    tiles = left.join(right, ["basket", "g1", "g2"]).select("w", "g1", "g2", F.explode("ys").alias("y"), "xs").select("w", "g1", "g2", "y", F.explode("xs").alias("x"))
    tiles = tiles.where((F.col("g1") != F.col("g2")) | (F.col("y") < F.col("x")))
    wide = tiles.select("w", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return pairs.select("w", "a", "b").unionByName(wide).groupBy("a", "b").agg(F.sum("w").alias("n"))


def cooccurring(events: DataFrame, items: DataFrame, min_count: int = 5, min_lift: float = 4, block: int = BLOCK, head_limit: int = HEAD_LIMIT, **columns: str) -> DataFrame:
    """Pairs a < b in ``min_count`` baskets or more, with a lift of ``min_lift`` or more.

    Result: a, b, n_ab, n_a, n_b, baskets, lift, conviction.  Lift is
    n_ab T / (n_a n_b); conviction is that of a -> b, null where a never comes
    without b.  Rows with a null, zero or unlisted item, with a = b, or without
    a basket do not count; repeated rows count once; an empty table gives an
    empty result.  ``columns`` renames a, b, basket, item_id.
    """
    member = written(basket_items(valid_events(events, items, head_limit=head_limit, **columns)), "baskets")
    total = member.select("basket").distinct().count()
    counts = member.groupBy("x").agg(F.count(F.lit(1)).alias("n_x")).withColumn("baskets", F.lit(total).cast("long"))
    flagged = counts.withColumn("keep", (F.col("n_x") >= min_count) & (F.col("n_x") * F.lit(min_lift) <= F.col("baskets")))
    flagged = written(flagged, "items")
    kept = lookup_join(member, flagged, "x", "n_x", head_limit).where("keep").select("basket", "x")
    kept = written(kept, "kept")
    often = collapsed_pairs(kept, block, head_limit).where(F.col("n") >= min_count)
    of = flagged.where("keep")
    out = often.join(of.select(F.col("x").alias("a"), F.col("n_x").alias("n_a"), "baskets"), "a").join(of.select(F.col("x").alias("b"), F.col("n_x").alias("n_b")), "b")
    out = out.where(F.col("n") * F.col("baskets") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
    lift = F.col("n").cast("double") * F.col("baskets") / (F.col("n_a") * F.col("n_b"))
    alone = 1 - F.col("n").cast("double") / F.col("n_a")
    conviction = F.when(F.col("n") < F.col("n_a"), (1 - F.col("n_b").cast("double") / F.col("baskets")) / alone)
    return out.select("a", "b", F.col("n").alias("n_ab"), "n_a", "n_b", "baskets", lift.alias("lift"), conviction.alias("conviction"))
