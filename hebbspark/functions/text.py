"""Tokens of a text: lower case, maximal runs of a-z and 0-9, without stop words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the token rule.
STOP_WORDS = (
    "a an the is are was were be been to of and or in on at for with it its that this "
    "did does do what when where who how which would could should"
).split()


def tokens(text: Column | str) -> Column:
    """Array of the text's terms in order, repeats kept; empty for a null or empty text."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(found, lambda t: ~t.isin(*STOP_WORDS))
    return F.coalesce(kept, F.array().cast("array<string>"))
