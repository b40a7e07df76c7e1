"""Answer-quality metrics as Columns; the longest common subsequence as a vectorised pandas UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import is_refusal, normalize_a, tokens


def let(f, *columns: Column) -> Column:
    """f over columns that are evaluated once, however often f names them."""
    held = F.array(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))))
    return F.element_at(F.transform(held, lambda s: f(*(s[f"c{i}"] for i in range(len(columns))))), 1)


def exact_match(pred: Column, gold: Column) -> Column:
    return (normalize_a(pred) == normalize_a(gold)).cast("double")


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))


def f1_of(common: Column, n_pred: Column, n_gold: Column, both_empty: float = 0.0) -> Column:
    """2PR / (P + R) from counts; `both_empty` where both sides have no token."""
    p, r = common / n_pred, common / n_gold
    return F.when((n_pred == 0) & (n_gold == 0), both_empty).when((n_pred == 0) | (n_gold == 0) | (common == 0), 0.0).otherwise(2 * p * r / (p + r))


def token_f1(pred: Column, gold: Column, both_empty: float = 0.0) -> Column:
    def score(p: Column, g: Column) -> Column:
        return let(lambda c: f1_of(c, F.size(p), F.size(g), both_empty), common_tokens(p, g))

    return let(score, tokens(normalize_a(pred)), tokens(normalize_a(gold)))


def contains_answer(pred: Column, gold: Column) -> Column:
    return let(lambda p, g: F.when(g == "", 0.0).otherwise(F.contains(p, g).cast("double")), normalize_a(pred), normalize_a(gold))


def lcs_length(a: list, b: list) -> int:
    """Row by row: a cell is the greatest of the one above, the one to the left, and a match on the diagonal."""
    if len(a) == 0 or len(b) == 0:
        return 0
    ids: dict = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a])
    y = np.array([ids.setdefault(w, len(ids)) for w in b])
    row = np.zeros(len(y) + 1, np.int64)
    for w in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == w, row[:-1] + 1, 0)))
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def _rouge_l(pred: pd.Series, gold: pd.Series) -> pd.Series:
    def score(p: list, g: list) -> float:
        common = lcs_length(p, g)
        return 2.0 * (common / len(p)) * (common / len(g)) / (common / len(p) + common / len(g)) if common else 0.0

    return pd.Series([score(p, g) for p, g in zip(pred, gold, strict=True)], dtype="float64")


def rouge_l(pred: Column, gold: Column) -> Column:
    return _rouge_l(tokens(normalize_a(pred)), tokens(normalize_a(gold)))


def rouge_1(pred: Column, gold: Column) -> Column:
    return token_f1(pred, gold)


def gold_in_retrieved(gold: Column, context: Column) -> Column:
    """The normalised gold is in the context, or at least half of its three or more tokens are."""

    def judge(g: Column, c: Column) -> Column:
        inside = F.contains(F.array_join(c, " "), F.array_join(g, " "))
        share = F.size(F.filter(g, lambda t: F.array_contains(c, t))) / F.size(g)
        return F.when(F.size(g) == 0, False).otherwise(inside | ((F.size(g) >= 3) & (share >= 0.5)))

    return let(judge, tokens(normalize_a(gold)), tokens(normalize_a(context)))


def refusal_credit(metric: Column, pred: Column, found: Column, lenient: bool = False) -> Column:
    """A refusal is right where the gold was not retrieved."""
    return F.when(is_refusal(pred, lenient) & ~found, 1.0).otherwise(metric)


def answer_hit(passages: Column, answer: Column) -> Column:
    """The answer, or all of its words, is in one passage (lower-cased)."""
    a = F.lower(answer)
    return F.exists(passages, lambda p: F.contains(F.lower(p), a) | F.forall(F.split(a, " "), lambda w: F.contains(F.lower(p), w)))


def credited(metric: Column, refused: Column, found: Column) -> Column:
    """A metric with credit for refusals, by any predicate of what a refusal is: 1 where the gold was not retrieved."""
    return F.when(refused & ~found, 1.0).otherwise(metric)
