"""Stems of English words by Porter's algorithm (1980), with the well-known extensions for short words.

Extensions: a few irregular words are looked up, words of one or two letters
stay, "ies" and "ied" after a single letter keep "ie", and y becomes i after
any consonant that is not the first letter.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The irregular words, and the suffixes of each step with what replaces them.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """v for a vowel and c for a consonant; y is a vowel after a consonant."""
    out = ""
    for c in word:
        vowel = c in "aeiou" or (c == "y" and out[-1:] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return _shape(word).count("vc")


def _closed(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y, or is a vowel and a consonant."""
    shape = _shape(word)
    return shape == "vc" or (shape[-3:] == "cvc" and word[-1] not in "wxy")


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
    if cut is None:
        return w
    if cut.endswith(("at", "bl", "iz")):
        return cut + "e"
    if len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c":
        return cut if cut[-1] in "lsz" else cut[:-1]
    return cut + "e" if _measure(cut) == 1 and _closed(cut) else cut


def _replaced(w: str, rules: tuple[tuple[str, str], ...]) -> str:
    """The first rule whose suffix the word has decides, whether or not enough is left for it."""
    for end, instead in rules:
        if w.endswith(end):
            left = w[: -len(end)]
            return left + instead if _measure(left) else w
    return w


def _derived(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]):
        return _derived(w[:-4] + "al")
    if w.endswith("logi"):
        return w[:-1] if _measure(w[:-3]) else w
    return _replaced(w, STEP_2)


def _bare(w: str) -> str:
    for end in STEP_4:
        if w.endswith(end) and not (end in ("ent", "ment") and w.endswith("e" + "ment")):
            left = w[: -len(end)]
            if end == "ion" and left[-1:] not in ("s", "t"):
                return w
            return left if _measure(left) > 1 else w
    return w


def _final(w: str) -> str:
    if w.endswith("e"):
        left = w[:-1]
        m = _measure(left)
        if m > 1 or (m == 1 and not _closed(left)):
            w = left
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _past(_plural(w))
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    return _final(_bare(_replaced(_derived(w), STEP_3)))


def stemmed(words: Column | str) -> Column:
    """Stems of an array of words; null for null."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: [None if w is None else porter(w) for w in ws] if ws is not None else None)

    return run(words)
