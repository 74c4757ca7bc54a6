"""BM25 over a batch of queries, with one collection per scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hebbspark.functions.text import tokens
from hebbspark.operators.skew import hot_keys, salted_join

K1, B = 1.2, 0.75
DIGITS = 9


def documents(records: DataFrame, scope: Sequence[str] = (), text: str = "content", id_col: str = "id") -> DataFrame:
    """(scope, id, terms, len): every record, also those without a term."""
    return records.select(*scope, F.col(id_col).alias("id"), tokens(text).alias("terms")).withColumn("len", F.size("terms").cast("long"))


def postings(docs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, term, id, tf, len)."""
    return docs.select(*scope, "id", "len", F.explode("terms").alias("term")).groupBy(*scope, "id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, n, total, avg): n counts every record, the empty ones too; avg is at least 1."""
    out = docs.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    return out.withColumn("avg", F.greatest(F.col("total") / F.col("n"), F.lit(1.0)))


def term_score(n: Column, df: Column, tf: Column, length: Column, avg: Column) -> Column:
    """The share of one query term in a record's BM25 score."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / avg))


def bm25(queries: DataFrame, docs: DataFrame, scope: Sequence[str] = (), query: str = "query") -> DataFrame:
    """(query_id, scope, id, lexical): records that share a term with the query; terms of a query count once."""
    wanted = queries.select("query_id", *scope, F.explode(F.array_distinct(tokens(query))).alias("term"))
    index = postings(docs, scope)
    spread = index.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df")).persist()
    hot = hot_keys(spread, [*scope, "term"], "df")
    known = wanted.join(spread, [*scope, "term"])
    stats = corpus_stats(docs, scope)
    known = known.join(stats, list(scope)) if scope else known.withColumn("n", stats.select("n").scalar()).withColumn("avg", stats.select("avg").scalar())
    hits = salted_join(index, known, [*scope, "term"], hot)
    part = term_score(F.col("n"), F.col("df"), F.col("tf"), F.col("len"), F.col("avg"))
    return hits.groupBy("query_id", *scope, "id").agg(F.round(F.sum(part), DIGITS).alias("lexical")).where(F.col("lexical") > 0)


def latest_bm25(old: DataFrame, new: DataFrame, k: int = 3) -> DataFrame:
    """(id, other, lexical, rank): ``prefix_bm25`` for the records of ``new`` alone, all of which follow those of ``old``.

    The old records are read once, and only their postings of the new records'
    terms are moved; the running counts are over the new records only.
    """
    base = corpus_stats(old).select("n", "total").first()
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)  # the records of one request
    n, total = F.count(F.lit(1)).over(before) + F.lit(base.n), F.coalesce(F.sum("len").over(before), F.lit(0)) + F.lit(base.total)
    sized = new.select("id", n.alias("n"), total.alias("total")).where("n > 0").withColumn("avg", F.greatest(F.col("total") / F.col("n"), F.lit(1.0)))
    asks = postings(new).select("id", "term")
    index = postings(old.unionByName(new)).join(F.broadcast(asks.select("term").distinct()), "term", "left_semi")
    met = asks.join(index.withColumnRenamed("id", "other"), "term").where(F.col("other") < F.col("id"))
    df = met.groupBy("id", "term").agg(F.count(F.lit(1)).alias("df"))
    hits = met.join(F.broadcast(df), ["id", "term"]).join(F.broadcast(sized), "id")
    part = term_score(F.col("n"), F.col("df"), F.col("tf"), F.col("len"), F.col("avg"))
    scored = hits.groupBy("id", "other").agg(F.round(F.sum(part), DIGITS).alias("lexical")).where("lexical > 0")
    place = Window.partitionBy("id").orderBy(F.col("lexical").desc(), "other")
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


#: Postings that a record's rarest terms may have together when its first candidates are looked for.
FIRST_POSTINGS = 64
#: Pairs for each posting up to which all of them are scored.
ALL_PAIRS = 64


def prefix_bm25(docs: DataFrame, scope: Sequence[str], k: int = 3, first: int = FIRST_POSTINGS, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """(scope, id, other, lexical, rank): for each record the k best earlier ones, scored against what was there before it.

    Each record is a query on the records of its scope with smaller ids.  Where
    records that share a term make more than ``all_pairs`` pairs for a posting,
    the postings of a frequent term are not met by all its records: the rarest
    terms of a record give k candidates and with them a score that its k best
    reach at least.  The most frequent terms whose largest contributions stay
    below that score in sum cannot bring in a record by themselves, so only the
    other terms propose records, and those that can still reach the score are
    completed.  Either way gives the same rows.
    """
    key, pair = [*scope, "id"], [*scope, "id", "other"]
    order = Window.partitionBy(*scope).orderBy("id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sized = docs.select(*key, F.count(F.lit(1)).over(before).alias("n"), F.coalesce(F.sum("len").over(before), F.lit(0)).alias("total"))
    sized = sized.where("n > 0").withColumn("avg", F.greatest(F.col("total") / F.col("n"), F.lit(1.0)))
    index = postings(docs, scope).persist()
    asks = index.select(*scope, "term", "id", (F.row_number().over(Window.partitionBy(*scope, "term").orderBy("id")) - 1).alias("df")).where("df > 0")
    asks = asks.join(sized.select(*key, "n", "avg"), key)
    earlier = index.select(*scope, "term", F.col("id").alias("other"), "tf", "len")
    part = term_score(F.col("n"), F.col("df"), F.col("tf"), F.col("len"), F.col("avg"))

    def partial(some: DataFrame) -> DataFrame:
        return some.join(earlier, [*scope, "term"]).where(F.col("other") < F.col("id")).groupBy(*pair).agg(F.sum(part).alias("_s"))

    def chosen(sums: DataFrame, total: Column) -> DataFrame:
        scored = sums.select(*pair, F.round(total, DIGITS).alias("lexical")).where("lexical > 0")
        place = Window.partitionBy(*key).orderBy(F.col("lexical").desc(), "other")
        return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    held = index.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("rows"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).first()
    if (held.pairs or 0) <= all_pairs * (held.rows or 0):
        return chosen(partial(asks), F.col("_s"))
    most = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.lit(K1 + 1)
    by_record = Window.partitionBy(*key)
    upto = lambda *by: by_record.orderBy(*by, "term").rowsBetween(Window.unboundedPreceding, 0)
    asks = asks.withColumn("_most", most).withColumn("_postings", F.sum("df").over(upto("df"))).withColumn("_below", F.sum("_most").over(upto("_most"))).persist()
    near = partial(asks.where(F.col("_postings") <= first))
    best = Window.partitionBy(*key).orderBy(F.col("_s").desc())
    floor = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select(*key, (F.col("_s") - 1e-6).alias("_floor"))
    split = asks.join(floor, key, "left").withColumn("_leads", F.coalesce(F.col("_below") >= F.col("_floor"), F.lit(True)))
    led = partial(split.where("_leads"))
    # The most that the terms which do not lead can add to a record.
    rest = split.where("NOT _leads").groupBy(*key).agg(F.max("_below").alias("_more"), F.first("_floor").alias("_floor"))
    open_ = led.join(rest, key, "left").where(F.col("_floor").isNull() | (F.col("_s") + F.col("_more") >= F.col("_floor"))).select(*pair, "_s")
    added = open_.join(split.where("NOT _leads").select(*key, "term", "n", "df", "avg"), key).join(earlier, [*scope, "term", "other"]).groupBy(*pair).agg(F.sum(part).alias("_t"))
    return chosen(open_.join(added, pair, "left"), F.col("_s") + F.coalesce("_t", F.lit(0.0)))
