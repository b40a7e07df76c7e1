"""Stemming by Porter's rules, and ROUGE-L over stems.

The rules are those of the published algorithm with its author's later changes and the common extensions: short words
in -ied and -ies keep an e, -alli, -fulli, -bli and -logi are rewritten, a two-letter vowel-consonant stem counts as
short, and a few words have fixed stems.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.metrics import lcs_length

#: Words whose stems follow no rule.
FIXED = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
#: Endings and what replaces them where a vowel-consonant pair comes before.
SECOND = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
THIRD = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
#: Endings that go where two such pairs come before.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or c == "y" and out.endswith("c") else "c"
    return out


def pairs(word: str) -> int:
    """Vowel-consonant pairs."""
    return len(re.findall("v+c+", shape(word)))


def short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x and y, or is a vowel and a consonant."""
    s = shape(word)
    return s == "vc" or s.endswith("cvc") and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if pairs(w[:-3]) else w
    end = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in shape(w[: -len(e)])), None)
    if end is None:
        return w
    stem = w[: -len(end)]
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and shape(stem).endswith("c"):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if pairs(stem) == 1 and short(stem) else stem


def _last_y(w: str) -> str:
    return w[:-1] + "i" if w.endswith("y") and len(w) > 2 and shape(w[:-1]).endswith("c") else w


def _replaced(w: str, rules) -> str:
    """By the first rule whose ending fits, if a pair comes before it."""
    for end, new in rules:
        if w.endswith(end):
            return w[: -len(end)] + new if pairs(w[: -len(end)]) else w
    return w


def _second(w: str) -> str:
    if w.endswith("alli") and pairs(w[:-4]):
        return _second(w[:-2])
    if w.endswith("logi"):
        return w[:-1] if pairs(w[:-3]) else w
    return _replaced(w, SECOND)


def _fourth(w: str) -> str:
    end = next((e for e in FOURTH if w.endswith(e)), None)
    if end is None or pairs(w[: -len(end)]) < 2 or end == "ion" and w[-4] not in "st":
        return w
    return w[: -len(end)]


def _final(w: str) -> str:
    if w.endswith("e"):
        n = pairs(w[:-1])
        if n > 1 or n == 1 and not short(w[:-1]):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and pairs(w[:-1]) > 1 else w


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in FIXED:
        return FIXED[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _last_y, _second, lambda w: _replaced(w, THIRD), _fourth, _final):
        word = step(word)
    return word


_split = re.compile("[^a-z0-9]+").split


def stems(text: str | None, cache: dict[str, str]) -> list[str]:
    """Lower-case runs of a-z and 0-9, those of over three characters stemmed; `cache` holds words met before."""
    out = []
    for w in _split((text or "").lower()):
        if w:
            if w not in cache:
                cache[w] = stem(w) if len(w) > 3 else w
            out.append(cache[w])
    return out


def rouge_l_stemmed(most: int = 1 << 18) -> Callable[[Column, Column], Column]:
    """A function of prediction and gold: F1 of the longest common subsequence of their stems, 0 where a side has none.

    A worker stems each distinct word once; it forgets its words when it holds `most`.
    """

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cache: dict[str, str] = {}
        for pred, gold in batches:
            out = []
            for p, g in zip(pred, gold, strict=True):
                a, b = stems(p, cache), stems(g, cache)
                common = lcs_length(a, b)
                out.append(2.0 * (common / len(a)) * (common / len(b)) / (common / len(a) + common / len(b)) if common else 0.0)
                if len(cache) > most:
                    cache.clear()
            yield pd.Series(out, dtype="float64")

    return score
