"""Deterministic randomness from hashes: equal on every cluster, run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int | Column, salt: str, *key: Column | str) -> Column:
    columns = [F.col(k) if isinstance(k, str) else k for k in key]
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.sha2(F.concat_ws("|", seed.cast("string"), F.lit(salt), *(c.cast("string") for c in columns)), 256)


def uniform(seed: int | Column, salt: str, *key: Column | str) -> Column:
    """Uniform in [0, 1): 52 bits of the digest."""
    return F.conv(F.substring(digest(seed, salt, *key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def shuffle_key(seed: int | Column, salt: str, *key: Column | str) -> Column:
    """Sorting by it is a seeded full shuffle."""
    return digest(seed, salt, *key)


def priority(seed: int | Column, salt: str, weight: Column | str, *key: Column | str) -> Column:
    """The largest n of these are a weighted sample without replacement; weight 0 raises."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    return F.pow(uniform(seed, salt, *key), F.lit(1.0) / weight)
