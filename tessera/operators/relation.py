"""Relational building blocks with explicit order: what loops over ordered lists mean.

Nulls in keys are equal to each other. ``order`` columns must make the order total;
where rows tie in all of them, either may be taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scan import first_rows


def _best(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    """One row per key, by partial aggregation: a hot key sends one row per task."""
    row = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_row")).select(*(F.col("_row")[c].alias(c) for c in df.columns))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _best(df, keys, order, F.min_by)


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _best(df, keys, order, F.max_by)


def capped(df: DataFrame, by: Sequence[str], cap: int | Column, order: Sequence[Column | str]) -> DataFrame:
    """The first ``cap`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")


def distinct_then_capped(df: DataFrame, pair: Sequence[str], by: Sequence[str], cap: int, order: Sequence[str]) -> DataFrame:
    """The first row of each pair, then the first ``cap`` of those in each group."""
    return capped(first_wins(df, pair, order), by, cap, list(order))


def top(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows; all of them for n <= 0."""
    return df.orderBy(*order) if n <= 0 else first_rows(df, order, n)


def insert_if_absent(new: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose key is not present."""
    return new.join(present.select(*keys).distinct(), list(keys), "left_anti")


def union_first_wins(sources: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All sources in turn, then the first of each key."""
    tagged = [s.withColumn("_source", F.lit(k)) for k, s in enumerate(sources)]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    return first_wins(every, keys, ["_source", *order]).drop("_source")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unknown_keys(df: DataFrame, keys: Sequence[str], known: DataFrame) -> DataFrame:
    return df.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` if no key repeats; raises otherwise."""
    twice = repeated_keys(df, keys).limit(1).collect()
    if twice:
        raise ValueError(f"repeated key: {twice[0].asDict()}")
    return df


def require_fk(df: DataFrame, keys: Sequence[str], known: DataFrame) -> DataFrame:
    """``df`` if all its keys are known; raises otherwise."""
    unknown = unknown_keys(df, keys, known).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown key: {unknown[0].asDict()}")
    return df


def require_domain(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows with another value raise when they are read."""
    bad = F.raise_error(F.concat(F.lit(f"{column} out of its domain: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")
    return df.withColumn(column, F.when(F.col(column).isin(*values), F.col(column)).otherwise(bad))


def round_robin(df: DataFrame, workers: int, ord_col: str = "ord") -> DataFrame:
    return df.withColumn("worker", F.pmod(F.col(ord_col), F.lit(workers)))


def batched(df: DataFrame, size: int, accumulate: int = 1, ord_col: str = "ord") -> DataFrame:
    """Adds batch and group numbers; ord counts from 0 without gaps."""
    batch = F.floor(F.col(ord_col) / size)
    return df.withColumn("batch", batch).withColumn("batch_group", F.floor(batch / accumulate))


def kth_smallest(df: DataFrame, column: str, k: int) -> float | None:
    """The value at place k (from 0) in ascending order, found by counting bins that narrow
    down: no sort, and never more than the bins on the driver."""
    bins = 1024
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low is not None and low < high:
        width = (high - low) / bins
        if low + width == low:
            break
        place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
        inside = values.filter(F.col("v").between(low, high))
        for row in sorted(inside.groupBy(place.alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()):
            if below + row["n"] > k:
                low, high = row["low"], row["high"]
                break
            below += row["n"]
        else:
            return None
    return low


def cutoff(df: DataFrame, column: str, fraction: float) -> float:
    """The value at place min(int(n * fraction), n - 1); infinite without rows."""
    n = df.filter(F.col(column).isNotNull()).count()
    return float("inf") if n == 0 else kth_smallest(df, column, min(int(n * fraction), n - 1))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    return every


def weighted_top(df: DataFrame, draw: Column, n: int, tie: str = "id") -> DataFrame:
    """A weighted sample without replacement: the ``n`` rows of the largest priorities."""
    return first_rows(df, [F.desc(draw), tie], n)
