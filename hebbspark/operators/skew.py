"""Joins that stay balanced when one key holds a large share of the rows.

``lookup_join`` splits a dictionary table (one row per key, with the number
of rows the key has on the other side) into a head that may be broadcast and a
tail.  A key is in the head if it holds at least 1/limit of all rows, so at
most ``limit`` keys can be: the size of the broadcast is bounded by a
parameter, whatever the data.  No tail key holds more than 1/limit of the
rows, so the shuffled part has no hot key.

Where the other side has many rows for a key, ``salted_join`` spreads the rows
of the few keys that ``hot_keys`` finds over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD_LIMIT = 16_384
#: Bytes of a text key that may be in the head, so that its size is bounded as well as its rows.
LONGEST_KEY = 256


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, limit: int = HEAD_LIMIT) -> DataFrame:
    """Inner join of ``left`` with the dictionary ``right`` on ``key``, which may be a struct.

    ``right`` has one row per key; ``weight`` is its column with the key's
    number of rows in ``left``.  Head keys are looked up in a broadcast table
    of at most ``limit`` rows and never shuffled; the rest is an equi-join.
    Null keys match nothing.  The dictionary is computed once and kept, and
    its total weight is read first, as one number.
    """
    names = [c for c in left.columns if c != key] + [key] + [c for c in right.columns if c != key]
    right = right.persist()
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * F.lit(limit) >= F.lit(total)
    if isinstance(right.schema[key].dataType, T.StringType):
        hot = hot & (F.octet_length(key) <= LONGEST_KEY)
    head, tail = right.where(hot), right.where(~hot)
    in_head = left.join(F.broadcast(head), key).select(*names)
    rest = left.join(F.broadcast(head.select(key)), key, "left_anti").join(tail, key).select(*names)
    return in_head.unionByName(rest)


#: A key is hot if it holds one part in so many of all rows: there can be no more hot keys than that.
HOT_SHARE = 256
#: A key with fewer rows is no burden for a task, whatever its share.
HOT_LEAST = 100_000
SALTS = 32


def hot_keys(counts: DataFrame, keys: Sequence[str], weight: str, share: int = HOT_SHARE, least: int | None = None) -> list[int]:
    """Hashes of the keys that hold 1/share of the total weight or more, at most ``share`` of them, and ``least`` rows.

    ``counts`` has one row per key.
    """
    least = HOT_LEAST if least is None else least
    seen = counts.agg(F.sum(weight).alias("total"), F.max(weight).alias("most")).first()
    if seen.total is None or seen.most < max(least, seen.total / share):
        return []
    hot = counts.where((F.col(weight) >= least) & (F.col(weight) * F.lit(share) >= F.lit(seen.total)))
    return [r[0] for r in hot.select(F.xxhash64(*keys)).distinct().collect()]


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], hot: Sequence[int], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """A join on ``keys`` in which the rows of ``big`` with a hot key are spread over ``salts`` tasks.

    Rows of ``small`` with such a key are copied to all of them; all other rows
    are moved once.  ``how`` may be inner, left_semi or left_anti.  Two keys with
    one hash are both spread, which changes nothing but where rows go.
    """
    keys = list(keys)
    if not hot:
        return big.join(small, keys, how)
    is_hot = F.xxhash64(*keys).isin([int(h) for h in hot])
    spread = F.pmod(F.xxhash64(F.lit(17), *(F.col(c) for c in big.columns)), F.lit(salts)).cast("int")
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    left = big.withColumn("_salt", F.when(is_hot, spread).otherwise(F.lit(0)))
    return left.join(small.withColumn("_salt", copies), [*keys, "_salt"], how).drop("_salt")
