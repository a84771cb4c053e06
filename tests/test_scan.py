"""Global numbers and running sums, against serial ones."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import scan


def rows(n=3000):
    rng = random.Random(4)
    return [(k, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([None, *range(9)]), rng.random()) for k in rng.sample(range(n), n)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_numbers_and_sums_are_serial(spark, by):
    data = rows()
    df = spark.createDataFrame(data, "id LONG, g STRING, v INT, x DOUBLE").repartition(7)
    numbers = {r["id"]: r["place"] for r in scan.numbered(df, [F.desc("x"), "id"], by, "place").collect()}
    sums = {r["id"]: (r["total"], r["n"]) for r in scan.running_sums(df.withColumn("one", F.lit(1)), [F.desc("x"), "id"], {"total": "v", "n": "one"}, by).collect()}
    seen, total = {}, {}
    for k, g, v, _ in sorted(data, key=lambda r: (-r[3], r[0])):
        g = g if by else 0
        assert numbers[k] == seen.get(g, 0)
        seen[g] = seen.get(g, 0) + 1
        total[g] = total.get(g, 0) + (v or 0)
        assert sums[k] == (total[g], seen[g])
    assert len(numbers) == len(sums) == len(data)


def test_empty_and_one(spark):
    df = spark.createDataFrame([], "id LONG, g STRING, v INT")
    assert scan.numbered(df, ["id"]).count() == 0 and scan.running_sums(df, ["id"], {"t": "v"}, ["g"]).count() == 0
    one = spark.createDataFrame([(5, None, None)], "id LONG, g STRING, v INT")
    assert scan.numbered(one, ["id"], ["g"]).first()["ord"] == 0 and scan.running_sums(one, ["id"], {"t": "v"}).first()["t"] == 0


def test_first_rows_of_any_number(spark, monkeypatch):
    monkeypatch.setattr(scan, "FEW", 10)
    df = spark.createDataFrame([(r[0], r[3]) for r in rows()], "id LONG, x DOUBLE")
    want = [r[0] for r in sorted(rows(), key=lambda r: r[3])]
    for n in (-1, 0, 5, 700, 5000):
        assert {r[0] for r in scan.first_rows(df, ["x", "id"], n).collect()} == set(want[: max(n, 0)])


def test_one_group_spreads_over_ranges(spark, monkeypatch):
    """No exchange to one partition, no window over all rows or a whole group: the plan of each pass."""
    plans = []
    real = scan.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(scan, "checkpointed", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).withColumn("g", F.lit("one"))
        for out in (scan.numbered(df, ["id"], ["g"]), scan.numbered(df, ["id"]), scan.running_sums(df, ["id"], {"s": "id"}, ["g"])):
            assert "rangepartitioning" in plans[-1] and "SinglePartition" not in plans[-1] and "Window" not in plans[-1]
            assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
        kept = scan.ranged(df, ["g"], ["id"])
        assert kept.select(F.shiftright("_at", scan.ROW_BITS).alias("r")).distinct().count() >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_window_without_a_partition_key():
    top = Path(scan.__file__).resolve().parents[1]
    for path in [*top.glob("operators/*.py"), *top.glob("plans/*.py")]:
        assert "Window.orderBy(" not in path.read_text(), path
