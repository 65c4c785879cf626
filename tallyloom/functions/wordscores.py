"""Word errors and n-gram scores of two texts in one Arrow function: quadratic work a row has no place in interpreted folds."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, functions as F

from .stemming import plain_tokens, tokens


def word_errors(reference: list[str], hypothesis: list[str]) -> int:
    """Insertions, deletions and substitutions between two word lists."""
    row = list(range(len(hypothesis) + 1))
    for i, w in enumerate(reference, 1):
        corner, row[0] = row[0], i
        for j, x in enumerate(hypothesis, 1):
            corner, row[j] = row[j], corner if x == w else 1 + min(corner, row[j], row[j - 1])
    return row[-1]


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of it in the bits of one number."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def f1(common: int, n_said: int, n_truth: int) -> float:
    return 2 * common / (n_said + n_truth) if common else 0.0


def ngram_f1(reference: list[str], hypothesis: list[str], n: int) -> float:
    """F1 of n-grams, each counted as often as both texts hold it."""
    r, h = (Counter(zip(*(w[i:] for i in range(n)))) for w in (reference, hypothesis))
    return f1((r & h).total(), h.total(), r.total())


def rouge(reference: list[str], hypothesis: list[str]) -> tuple[float, float, float]:
    return ngram_f1(reference, hypothesis, 1), ngram_f1(reference, hypothesis, 2), f1(longest_common(reference, hypothesis), len(hypothesis), len(reference))


def _each(r: pd.Series, h: pd.Series, score) -> list:
    return [None if not isinstance(a, str) or not isinstance(b, str) else score(a, b) for a, b in zip(r, h)]


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word errors over the number of reference words, 1 at least; null for null."""

    def run(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_each(r, h, lambda a, b: word_errors(x := a.split(), b.split()) / max(1, len(x))), dtype="float64")

    return F.pandas_udf(run, "double")(reference, hypothesis)


def rouge_scores(reference: Column, hypothesis: Column, stemming: bool) -> Column:
    """(unigram, bigram, longest) F1 of two texts; null for null."""
    prepare = tokens if stemming else plain_tokens

    def run(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        found = _each(r, h, lambda a, b: rouge(prepare(a), prepare(b)))
        return pd.DataFrame([x or (None,) * 3 for x in found], columns=["unigram", "bigram", "longest"], dtype="float64")

    return F.pandas_udf(run, "unigram double, bigram double, longest double")(reference, hypothesis)
