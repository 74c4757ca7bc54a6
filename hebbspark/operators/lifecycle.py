"""Record lifecycle as table rewrites: supersession, retention, quotas, forgetting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hebbspark.operators.skew import hot_keys, salted_join


class QuotaExceeded(ValueError):
    pass


def supersede(records: DataFrame, replacements: DataFrame) -> DataFrame:
    """Apply (old, new, tick): the old record ends at the tick, the new one points back to it.

    Of several replacements of one record the first by (tick, new) counts.
    """
    first = replacements.where("old IS NOT NULL AND new IS NOT NULL AND old <> new").groupBy("old").agg(F.min(F.struct("tick", "new")).alias("_r"))
    first = first.select("old", F.col("_r.new").alias("new"), F.col("_r.tick").alias("tick"))
    back = first.groupBy(F.col("new").alias("id")).agg(F.min("old").alias("_old"), F.min("tick").alias("_from"))
    out = records.join(first.select(F.col("old").alias("id"), F.col("tick").alias("_to")), "id", "left").join(back, "id", "left")
    return (
        out.withColumn("valid_to", F.coalesce("_to", "valid_to"))
        .withColumn("supersedes", F.coalesce("_old", "supersedes"))
        .withColumn("valid_from", F.coalesce("_from", "valid_from"))
        .select(*records.columns)
    )


def versions(records: DataFrame, key: str, order: str = "id") -> DataFrame:
    """History by a key: each record is superseded by the next one with the same key; null keys have no history."""
    w = Window.partitionBy(key).orderBy(order)
    keyed, rest = records.where(F.col(key).isNotNull()), records.where(F.col(key).isNull())
    out = keyed.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(w), "valid_to")).withColumn("supersedes", F.coalesce(F.lag("id").over(w), "supersedes"))
    return out.unionByName(rest)


def promote(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Conjectures (layer 1) that are listed become observations (layer 0)."""
    listed = ids.select("id").distinct().withColumn("_p", F.lit(True))
    return records.join(listed, "id", "left").withColumn("layer", F.when(F.col("_p") & (F.col("layer") == 1), 0).otherwise(F.col("layer"))).drop("_p")


def live(records: DataFrame) -> DataFrame:
    return records.where("valid_to IS NULL AND layer = 0")


def as_of(records: DataFrame, tick: int) -> DataFrame:
    """Records valid at a tick."""
    return records.where((F.col("valid_from") <= tick) & (F.col("valid_to").isNull() | (F.col("valid_to") > tick)))


def expired(records: DataFrame, now: int, ttl: int) -> DataFrame:
    """Records whose time to live is over: tick <= now - ttl; ttl 0 keeps all."""
    return records.where(F.lit(ttl > 0) & (F.col("tick") <= now - ttl))


def unexpired(records: DataFrame, now: int, ttl: int) -> DataFrame:
    return records if ttl <= 0 else records.where(F.col("tick").isNull() | (F.col("tick") > now - ttl))


def quota_totals(records: DataFrame, size: str = "bytes") -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def kept_suffix(records: DataFrame, max_records: int, max_bytes: int, size: str = "bytes", buckets: int = 256) -> DataFrame:
    """Evict the oldest records until both totals fit: the longest run of the newest ids that fits; the newest always stays.

    Totals behind each record are found in two steps, per range of ids and
    inside each range, so that no window holds the whole table.
    """
    known = records.where("id IS NOT NULL")
    span = known.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if span.hi is None:
        return known
    width = max(1, (span.hi - span.lo) // buckets + 1)
    sized = known.withColumn("_s", F.coalesce(F.col(size), F.lit(0))).withColumn("_g", ((F.col("id") - span.lo) / width).cast("int"))
    per = sized.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"), F.sum("_s").alias("_t")).collect()  # at most ``buckets`` rows
    count = total = 0
    after = {}
    for r in sorted(per, key=lambda r: -r["_g"]):
        after[r["_g"]] = (count, total)
        count, total = count + r["_c"], total + r["_t"]
    look = records.sparkSession.createDataFrame([(g, c, t) for g, (c, t) in after.items()], "_g int, _ac long, _at long")
    inside = Window.partitionBy("_g").orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = sized.join(F.broadcast(look), "_g").withColumn("_n", F.count(F.lit(1)).over(inside) + F.col("_ac")).withColumn("_b", F.sum("_s").over(inside) + F.col("_at"))
    return run.where(((F.col("_n") <= max_records) & (F.col("_b") <= max_bytes)) | (F.col("id") == span.hi)).select(*records.columns)


def evicted(records: DataFrame, max_records: int, max_bytes: int, size: str = "bytes") -> DataFrame:
    return records.where("id IS NOT NULL").join(kept_suffix(records, max_records, max_bytes, size).select("id"), "id", "left_anti")


def enforce(records: DataFrame, now: int, ttl: int, max_records: int, max_bytes: int, overflow: str = "reject", size: str = "bytes") -> DataFrame:
    """Drop expired records, then reject an overflow or evict the oldest; a newest record over the quota by itself is an error."""
    rest = unexpired(records, now, ttl)
    totals = quota_totals(rest, size).first()
    if totals.records <= max_records and totals.bytes <= max_bytes:
        return rest
    if overflow == "reject":
        raise QuotaExceeded("the record or byte quota is exceeded")
    newest = rest.where("id IS NOT NULL").agg(F.max_by(F.coalesce(F.col(size), F.lit(0)), "id")).first()[0]
    if max_records < 1 or (newest is not None and newest > max_bytes):
        raise QuotaExceeded("the newest record cannot fit the quota")
    return kept_suffix(rest, max_records, max_bytes, size)


def forget(records: DataFrame, events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and events without the listed ids; events go with either end."""
    gone = ids.select("id").distinct()
    left = _ends(events, gone, "left_anti")
    return records.join(gone, "id", "left_anti"), left.select(*events.columns)


def with_live_ends(events: DataFrame, records: DataFrame) -> DataFrame:
    """Events whose two ends are both retained records."""
    ids = records.select("id").where("id IS NOT NULL").distinct()
    return _ends(events, ids, "left_semi").select(*events.columns)


def _ends(events: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Both ends joined with distinct ids; an end that a large share of the events has is spread over several tasks."""
    out = events
    for end in ("a", "b"):
        hot = hot_keys(events.groupBy(end).agg(F.count(F.lit(1)).alias("_n")), [end], "_n")
        out = salted_join(out, ids.withColumnRenamed("id", end), [end], hot, how)
    return out
