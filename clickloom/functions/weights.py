"""Position weights, decays and similarities as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_score(step: Column) -> Column:
    """1 - step / 10 below 100 and 0 beyond; negative from 11 on, and kept so."""
    return F.when(step < 100, 1 - 0.1 * step.cast("double")).otherwise(F.lit(0.0))


#: Decays of a neighbour's score by the step of its most recent shared item (1: the last click).
DECAYS: dict[str, Callable[[Column], Column]] = {
    "canonical": linear_score,
    "linear": lambda i: F.when(i <= 100, 1 - 0.1 * i.cast("double")).otherwise(F.lit(0.0)),
    "same": lambda i: F.lit(1.0),
    "div": lambda i: 1 / i.cast("double"),
    "log": lambda i: 1 / F.log10(i + F.lit(1.7)),
    "quadratic": lambda i: 1 / (i * i).cast("double"),
}

#: Weights of the item at position i (1: oldest) of n clicks.
POSITION_WEIGHTS: dict[str, Callable[[Column, Column], Column]] = {
    "linear": lambda i, n: F.when(i <= 10, 1 - 0.1 * (n - i).cast("double")).otherwise(F.lit(0.0)),
    "same": lambda i, n: F.lit(1.0),
    "div": lambda i, n: i / n,
    "log": lambda i, n: 1 / F.log10(n - i + F.lit(1.7)),
    "quadratic": lambda i, n: F.pow(i / n, 2),
}


def similarity(kind: str, shared: Column, left: Column, right: Column) -> Column:
    """Of two item sets by their sizes and shared items. cosine_legacy divides by one root and multiplies by the other."""
    shared, left, right = (c.cast("double") for c in (shared, left, right))
    return {
        "jaccard": shared / (left + right - shared),
        "tanimoto": shared / (left + right - shared),
        "cosine": shared / (F.sqrt(left) * F.sqrt(right)),
        "cosine_legacy": shared / F.sqrt(left) * F.sqrt(right),
        "binary": 2 * shared / (2 * shared + left + right),
    }[kind]


def time_decay(score: Column, age_seconds: Column) -> Column:
    """score * (7/8) ** days, days rounded half to even."""
    return score * F.pow(F.lit(7.0 / 8.0), F.bround(age_seconds / 86400))


def idf_additive(score: Column, idf: Column, weight: float) -> Column:
    return score + score * idf * F.lit(float(weight))
