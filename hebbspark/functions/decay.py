"""Exponential decay by logical ticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def factor(elapsed: Column, lam: float) -> Column:
    """(1 - lam) ** elapsed; no decay for lam <= 0, all at once for lam >= 1."""
    if lam <= 0:
        return F.lit(1.0)
    if lam >= 1:
        return F.when(elapsed <= 0, 1.0).otherwise(0.0)
    return F.pow(F.lit(1.0 - lam), elapsed.cast("double"))


def decayed(weight: Column, last: Column, now: Column | int, lam: float) -> Column:
    """A weight of tick ``last`` as read at ``now``; a read before ``last`` does not undo decay."""
    now = F.lit(now).cast("long") if isinstance(now, int) else now
    return weight * factor(F.greatest(now - last, F.lit(0)), lam)
