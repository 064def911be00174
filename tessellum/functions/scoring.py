"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def freshness(decay: Column, created_s: Column, as_of: int) -> Column:
    """exp(-decay x days since)."""
    return F.exp(-decay * (F.lit(as_of) - created_s) / 86400.0)


def trust_level(authority: Column) -> Column:
    return F.when(authority >= 0.7, "high").when(authority >= 0.4, "medium").otherwise("low")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))
