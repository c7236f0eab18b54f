"""Closed-form statistics as column expressions; undefined values are null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def wilson(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, clamped to [0, 1] and rounded to 6; null without trials."""
    n, p = trials.cast("double"), ratio(successes, trials)
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    den = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (mid - half) / den), F.least(F.lit(1.0), (mid + half) / den)
    return F.when(trials > 0, F.round(low, 6)), F.when(trials > 0, F.round(high, 6))


def phi(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    """Correlation of two binary variables, rounded to 6; null where a margin is 0."""
    a, b, c, d = (x.cast("double") for x in (n11, n10, n01, n00))
    den = (a + b) * (c + d) * (a + c) * (b + d)
    return F.when(den > 0, F.round((a * d - b * c) / F.sqrt(den), 6))


def precision_recall(tp: Column, fp: Column, fn: Column, digits: int = 3) -> tuple[Column, Column]:
    return F.round(ratio(tp, tp + fp), digits), F.round(ratio(tp, tp + fn), digits)


def effective_votes(k: Column, rho: Column) -> Column:
    """Independent votes that k votes of mean correlation rho are worth; null without rho or where the form is undefined."""
    den = 1 + (k - 1) * rho
    return F.when(rho.isNotNull() & (den > 0), F.round(k / den, 6))
