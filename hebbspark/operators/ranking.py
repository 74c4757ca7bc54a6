"""Stable top-k and ordered choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hebbspark.session import written


def ranked(rows: DataFrame, group: Sequence[str], score: str | Column, node: str = "id", name: str = "rank") -> DataFrame:
    """Rows with their 1-based place by score, highest first, ties by node."""
    score = F.col(score) if isinstance(score, str) else score
    order = Window.partitionBy(*group).orderBy(score.desc_nulls_last(), F.col(node))
    return rows.withColumn(name, F.row_number().over(order))


def stable_topk(rows: DataFrame, group: Sequence[str], score: str | Column, k: int, node: str = "id") -> DataFrame:
    """The k best rows of each group, exact, ties by node; none for k <= 0."""
    return ranked(rows, group, score, node).where(F.col("rank") <= max(k, 0))


def merged_quotas(lists: Sequence[tuple[DataFrame, int]], group: Sequence[str], cap: int = 64) -> DataFrame:
    """(group, id, rank): ranked lists joined in order, each up to its quota in total, first occurrence kept.

    Each entry is (rows with group, id and rank; length that the result may
    have after this list).
    """
    key = [*group, "id"]
    out = None
    for k, (rows, quota) in enumerate(lists):
        own = rows.select(*key, "rank")
        if out is None:
            out = own.where(F.col("rank") <= min(quota, cap)).withColumn("_list", F.lit(k))
            continue
        have = out.groupBy(*group).agg(F.count(F.lit(1)).alias("_have"))
        new = own.join(out.select(*key), key, "left_anti").join(have, list(group), "left")
        new = new.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy("rank")) + F.coalesce("_have", F.lit(0)))
        out = out.unionByName(new.where(F.col("_place") <= min(quota, cap)).select(*key, "rank", F.lit(k).alias("_list")))
    return out.select(*key, F.row_number().over(Window.partitionBy(*group).orderBy("_list", "rank", "id")).alias("rank"))


def ordered_get(requests: DataFrame, records: DataFrame, group: Sequence[str], ids: str = "ids") -> DataFrame:
    """(group, place, record columns): the records that each row of ``requests`` lists, in the order of its ids, repeats kept, unknown ids left out."""
    asked = requests.select(*group, F.posexplode(ids).alias("place", "id"))
    return asked.join(records, "id").select(*group, "place", *records.columns)


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """``rows`` with their place from 1 in the order, which must be total: a sort by ranges, and a count of each range.

    No task holds more than a range; what comes to the driver is one count a range.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, total = [], 0
    for r in sorted(ranged.groupBy("_range").count().collect()):
        before.append((r[0], total))
        total += r[1]
    first = F.broadcast(rows.sparkSession.createDataFrame(before, "_range int, _first long"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(first, "_range").withColumn(name, (inside + F.col("_first")).cast("long")).drop("_range", "_first")
