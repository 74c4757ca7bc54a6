"""Distinctive terms of a record: exact hypergeometric enrichment with false-discovery control.

The collection is seen as an urn of M term occurrences, K of them the term in
question; a record draws L of them without replacement.  The probability that
the term turns up n times or more in the record by chance is the upper tail of
the hypergeometric distribution.  It is summed exactly, in the log domain, from
the largest term of the sum on; the Benjamini-Hochberg adjustment then runs
over the terms tested in one record, and the score is the negative natural
logarithm of the adjusted probability.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hebbspark.functions.text import tokens
from hebbspark.operators.skew import HEAD_LIMIT, lookup_join

_TABLE = 2048
_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE, dtype=np.float64)))])


def _stirling(x: np.ndarray) -> np.ndarray:
    """The correction of Stirling's series for ln x!."""
    y = 1.0 / x
    z = y * y
    return y * (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680)))


def log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x! for whole x >= 0: a table for small x, Stirling's series beyond."""
    x = np.asarray(x, dtype=np.float64)
    big = np.maximum(x, _TABLE - 1)
    far = (big + 0.5) * np.log(big) - big + 0.5 * np.log(2 * np.pi) + _stirling(big)
    return np.where(x < _TABLE, _LOG_FACTORIAL[np.minimum(x, _TABLE - 1).astype(np.int64)], far)


def log_falling(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """ln of x (x-1) ... (x-m+1), without the cancellation of two large log-gammas."""
    x, m = np.asarray(x, dtype=np.float64), np.asarray(m, dtype=np.float64)
    rest = x - m
    large = (x >= _TABLE) & (rest >= 16)
    sx, sr = np.where(large, x, 32.0), np.where(large, rest, 16.0)
    sm = sx - sr
    series = sm * np.log(sx) - (sr + 0.5) * np.log1p(-sm / sx) - sm + _stirling(sx) - _stirling(sr)
    return np.where(large, series, log_factorial(np.maximum(x, 0)) - log_factorial(np.maximum(rest, 0)))


def log_upper_tail(n, draws, marked, total) -> np.ndarray:
    """ln P(X >= n), X hypergeometric: ``draws`` of ``total`` items of which ``marked`` count.

    Above the mode the tail is summed upwards, below it the other side is
    summed downwards and taken from one; either sum starts at its largest term.
    """
    n, draws, marked, total = (np.asarray(v, dtype=np.float64) for v in (n, draws, marked, total))
    mode = np.floor((draws + 1) * (marked + 1) / (total + 2))
    low = n <= mode
    k = np.where(low, n - 1, n)
    out = np.zeros(len(n))
    live = ~(low & (n <= np.maximum(0, draws - (total - marked))))  # else the tail is all there is
    k, L, K, M, low_ = k[live], draws[live], marked[live], total[live], low[live]
    first = log_falling(K, k) + log_falling(L, k) - log_factorial(k) + log_falling(M - K, L - k) - log_falling(M, L)
    sums, term = np.ones(len(k)), np.ones(len(k))
    at = np.arange(len(k))
    kk, LL, KK, MM, down = k.copy(), L, K, M, low_
    while len(at):
        up = (KK - kk) * (LL - kk) / ((kk + 1) * (MM - KK - LL + kk + 1))
        dn = kk * (MM - KK - LL + kk) / ((KK - kk + 1) * (LL - kk + 1))
        term = term * np.where(down, dn, up)
        sums[at] += term
        kk = kk + np.where(down, -1, 1)
        go = term > 1e-17 * sums[at]
        at, term, kk, LL, KK, MM, down = (v[go] for v in (at, term, kk, LL, KK, MM, down))
    log_sum = first + np.log(sums)
    with np.errstate(divide="ignore"):
        out[live] = np.where(low_, np.log1p(-np.minimum(np.exp(np.minimum(log_sum, 0.0)), 1.0 - 1e-16)), np.minimum(log_sum, 0.0))
    return out


@F.pandas_udf(T.DoubleType())
def _log_tail(n: pd.Series, draws: pd.Series, marked: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series(log_upper_tail(n.to_numpy(), draws.to_numpy(), marked.to_numpy(), total.to_numpy()))


def record_terms(records: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, term, n, draws): how often each term stands in each record, and the record's length in terms.

    Rows with one id count once; rows with a null id, and records without a
    term (null, empty, blank), give no row.
    """
    one = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull()).dropDuplicates(["id"])
    found = one.select("id", tokens("text").alias("found")).select("id", F.size("found").alias("draws"), F.explode("found").alias("term"))
    return found.groupBy("id", "draws", "term").agg(F.count(F.lit(1)).alias("n")).select("id", "term", "n", F.col("draws").cast("long").alias("draws"))


def collection_stats(postings: DataFrame) -> DataFrame:
    """(term, df, cf, records, total): one row per term; records and total are of the whole collection."""
    sizes = postings.groupBy("id").agg(F.first("draws").alias("draws")).agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("draws"), F.lit(0)).alias("total")).first()
    return (
        postings.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))
        .withColumn("records", F.lit(sizes.records).cast("long"))
        .withColumn("total", F.lit(sizes.total).cast("long"))
    )


def distinctive_terms(records: DataFrame, id_col: str = "id", text_col: str = "text", min_df: int = 2, head_limit: int = HEAD_LIMIT) -> DataFrame:
    """Score every term of every record by how much it marks out the record.

    Result: id, term, n, df, records, draws, cf, log_p, log_q, score; one row
    for each term of a record that ``min_df`` records or more hold.  Ties of
    log_p share the adjusted value of the last of them.  Null, empty and blank
    texts and null ids give no row, repeated ids count once, an empty table
    gives an empty result; other columns of ``records`` are ignored.
    """
    postings = record_terms(records, id_col, text_col).persist()
    stats = collection_stats(postings).where(F.col("df") >= min_df)
    joined = lookup_join(postings, stats, "term", "df", head_limit)
    tested = joined.withColumn("log_p", _log_tail(F.col("n"), F.col("draws"), F.col("cf"), F.col("total")))
    # The least likely term comes last; the step-up minimum runs from the likeliest on.
    falling = Window.partitionBy("id").orderBy(F.col("log_p").desc(), F.col("term"))
    ranked = tested.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy("id"))).withColumn("_r", F.row_number().over(falling))
    raw = F.col("log_p") + F.log(F.col("_m").cast("double")) - F.log((F.col("_m") - F.col("_r") + 1).cast("double"))
    out = ranked.withColumn("log_q", F.least(F.lit(0.0), F.min(raw).over(falling.rowsBetween(Window.unboundedPreceding, 0))))
    return out.select("id", "term", "n", "df", "records", "draws", "cf", "log_p", "log_q", (-F.col("log_q") + F.lit(0.0)).alias("score"))


def top_terms(scored: DataFrame, k: int = 3) -> DataFrame:
    """Of each record the k terms with the highest n ln(N/d), rounded to 6 decimals, ties by term: (id, term, n, df, score, weight).

    An exact ranking over the rows of ``distinctive_terms`` by the stated
    weight; the score comes along and has no part in the ranking.
    """
    weight = F.round(F.col("n") * F.log(F.col("records") / F.col("df")), 6)
    order = Window.partitionBy("id").orderBy(F.col("weight").desc(), F.col("term"))
    ranked = scored.withColumn("weight", weight).withColumn("_k", F.row_number().over(order))
    return ranked.where(F.col("_k") <= k).select("id", "term", "n", "df", "score", "weight")
