"""Arithmetic of weights, schedules and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate_scale(step: Column, warmup: int, total: int) -> Column:
    """Linear rise over the warm-up, then linear fall to 0."""
    rise = (step + 1) / F.lit(float(max(1, warmup)))
    fall = F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, rise).otherwise(fall)


def prover_weight(proof: Column, verify_seconds: Column, successes: Column) -> Column:
    """Shorter, quicker proofs of seldom proved statements weigh more."""
    return F.exp(-0.001 * F.length(proof) - 0.01 * verify_seconds) / successes


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """NaN where a vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(float("nan")))


def token_count(tokens: Column, pad: int) -> Column:
    return F.size(F.filter(tokens, lambda t: t != pad))
