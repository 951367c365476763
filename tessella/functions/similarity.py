"""String similarity that no built-in expresses (matching-block ratios), as Arrow-batched pandas UDFs over canonical terms."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessella.functions.text import canonical_term

MATCH, REVIEW = 0.90, 0.80


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(1 << 16)
def strict_ratio(a: str, b: str) -> float:
    """Of two canonical terms: 1 if equal, 0 if one is empty, else the better of the plain and the word-sorted ratio."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return max(_ratio(a, b), _ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))


@lru_cache(1 << 16)
def token_set_ratio(a: str, b: str) -> float:
    """As strict, or better by shared words: 1 if one's words contain the other's, 0 without shared words."""
    strict, x, y = strict_ratio(a, b), set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    if not both:
        return strict
    left = (both + " " + " ".join(sorted(x - y))).strip()
    right = (both + " " + " ".join(sorted(y - x))).strip()
    return max(strict, _ratio(both, left), _ratio(both, right), _ratio(left, right))


@F.pandas_udf(DoubleType())
def _strict(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([strict_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def set_match_settled(a: Column, b: Column, least: float = MATCH) -> tuple[Column, Column]:
    """Of two canonical terms, whether they match as ``token_set_match`` for sure, and whether they cannot: equal terms and terms whose
    words contain one another match; without a shared word a ratio is at most twice the shorter length over both."""
    x, y = F.split(a, " "), F.split(b, " ")
    inside = (a != "") & (b != "") & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    low, both = F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)
    return (a == b) | inside, ~F.arrays_overlap(x, y) & (2 * low < least * both)


def canonical_similarity(a: Column, b: Column) -> Column:
    """As ``similarity``, for terms that are canonical already."""
    return _strict(a, b)


def canonical_set_similarity(a: Column, b: Column) -> Column:
    """As ``token_set_similarity``, for terms that are canonical already."""
    return _token_set(a, b)


def similarity(a: Column, b: Column) -> Column:
    return _strict(canonical_term(a), canonical_term(b))


def token_set_similarity(a: Column, b: Column) -> Column:
    return _token_set(canonical_term(a), canonical_term(b))


def fuzzy_match(a: Column, b: Column, least: float = MATCH) -> Column:
    return similarity(a, b) >= least


def token_set_match(a: Column, b: Column, least: float = MATCH) -> Column:
    return token_set_similarity(a, b) >= least
