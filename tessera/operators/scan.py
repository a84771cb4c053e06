"""Numbers and running sums in a global order, without one task that sees all rows.

Two passes: rows are dealt by ranges of the order, sorted within them and written down once;
each range's totals (a row for each range and group) are summed over the ranges before it and
added back. Ranges are cut from a sample by Spark, so that a group or run of any size spreads
over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import checkpointed

#: Bits of a row's number within its task in ``monotonically_increasing_id``; the task's stand above.
ROW_BITS = 33
#: Up to so many first rows are kept by each task and meet at once.
FEW = 10_000


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``df`` in ranges of (by, order), with ``_at``: rising in that order, its high bits the range."""
    keys = [*by, *order]
    return checkpointed(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))


def _with_totals(rows: DataFrame, by: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Adds to each row the totals of its group's earlier ranges (``_before_*``) and the ``_at`` of its
    group's first row in its range (``_first``)."""
    rows = rows.withColumn("_range", F.shiftright("_at", ROW_BITS))
    per = rows.groupBy("_range", *by).agg(F.min("_at").alias("_first"), *(v.alias(f"_before_{k}") for k, v in totals.items()))
    if by:
        earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("_range", *by, "_first", *(F.coalesce(F.sum(f"_before_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in totals))
    else:  # a row for each range
        found = per.orderBy("_range").collect()
        sums = [[0, *accumulate(r[f"_before_{k}"] or 0 for r in found)] for k in totals]
        per = rows.sparkSession.createDataFrame([(r["_range"], r["_first"], *(s[j] for s in sums)) for j, r in enumerate(found)], per.schema)
        per = F.broadcast(per)
    other = per.select(F.col("_range").alias("_r"), *(F.col(c).alias(f"_b{j}") for j, c in enumerate(by)), "_first", *(f"_before_{k}" for k in totals))
    same = F.col("_range") == F.col("_r")
    for j, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_b{j}"))
    return rows.join(other, same).drop("_r", *(f"_b{j}" for j in range(len(by))))


def numbered(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "ord") -> DataFrame:
    """Adds ``name``: each row's place (from 0 without gaps) in its group's order. ``order`` must be
    total; rows equal in all of it are numbered one after another in either way."""
    rows = _with_totals(ranged(df.drop(name), by, order), by, {"rows": F.count(F.lit(1))})
    return rows.withColumn(name, F.col("_before_rows") + F.col("_at") - F.col("_first")).drop("_at", "_range", "_first", "_before_rows")


def running_sums(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Adds for each (name, column) of ``sums`` the column's sum over the rows of the group up to this
    one; nulls count as nothing."""
    rows = _with_totals(ranged(df.drop(*sums), by, order), by, {k: F.sum(c) for k, c in sums.items()})
    so_far = Window.partitionBy("_range", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    added = {k: F.coalesce(F.sum(c).over(so_far), F.lit(0)) + F.col(f"_before_{k}") for k, c in sums.items()}
    return rows.withColumns(added).drop("_at", "_range", "_first", *(f"_before_{k}" for k in sums))


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of a total order, ``n`` of any size."""
    if n <= FEW:
        return df.orderBy(*order).limit(max(n, 0))
    return numbered(df, order, name="_place").filter(F.col("_place") < n).drop("_place")
