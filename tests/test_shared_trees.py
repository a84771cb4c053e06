"""Trees that share nodes: counts of paths against the projection's copies."""

import random

import pytest

from tessera.operators import tree

NODES = "tree_id INT, id BIGINT, node_type STRING, value DOUBLE, proven BOOLEAN, is_root BOOLEAN"
EDGES = "tree_id INT, parent BIGINT, ord INT, child BIGINT"


def test_counts_are_the_projections(spark):
    """Random graphs of OR and AND nodes: as many copies and the same rates as the projected trees."""
    rng, nodes, edges = random.Random(6), [], []
    for t in range(25):
        n = rng.choice([1, 2, 6, 12])
        kinds = ["OR"] + [rng.choice(["OR", "OR", "AND"]) for _ in range(n - 1)]
        kinds[-1] = "OR"
        nodes += [(t, k, kind, rng.choice([0.0, -1.0, -2.0]), rng.random() < 0.5, k == 0) for k, kind in enumerate(kinds)]
        for k, kind in enumerate(kinds):
            below = [c for c in range(k + 1, n) if kind == "OR" or kinds[c] == "OR"]
            some = rng.sample(below, min(len(below), rng.choice([0, 1, 2, 3]) if kind == "OR" else max(1, rng.choice([1, 2]))))
            edges += [(t, k, j, c) for j, c in enumerate(some)]
    nodes, edges = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    copies = tree.project(spark, nodes, edges, depth=50)
    want = {(r["tree_id"], r["id"]): r["count"] for r in copies.groupBy("tree_id", "id").count().collect()}
    assert {(r["tree_id"], r["id"]): int(r["paths"]) for r in tree.path_counts(nodes, edges, 50).collect()} == want
    rates = {tuple(r) for r in tree.frontier_rate(copies).collect()}
    assert {(r[0], int(r[1]), int(r[2]), r[3]) for r in tree.frontier_rate_by_counts(nodes, edges, 50).collect()} == rates


def test_cycles_raise(spark):
    nodes = spark.createDataFrame([(0, k, "OR", 0.0, False, k == 0) for k in range(3)], NODES)
    edges = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 2), (0, 2, 0, 1)], EDGES)
    with pytest.raises(ValueError, match="more than 5 levels"):
        tree.path_counts(nodes, edges, 5)


def test_nothing_is_broadcast_where_files_look_small(spark, monkeypatch):
    """Nodes made by ``explode`` from a few rows look small to Spark: no level may send them through the driver."""
    from pyspark.sql import functions as F

    plans, real = [], tree.written

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(tree, "written", seen)
    ids = spark.range(4).select(F.col("id").cast("int").alias("tree_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(30).cast("long"))).alias("id"))
    nodes = ids.select("tree_id", "id", F.lit("OR").alias("node_type"), F.lit(0.0).alias("value"), (F.col("id") % 2 == 0).alias("proven"), (F.col("id") == 0).alias("is_root"))
    edges = ids.filter("id > 0").select("tree_id", ((F.col("id") - 1) / 2).cast("long").alias("parent"), ((F.col("id") - 1) % 2).cast("int").alias("ord"), F.col("id").alias("child"))
    rates = tree.frontier_rate_by_counts(nodes, edges, 50)
    copies = tree.frontier_rate(tree.project(spark, nodes, edges, depth=50))
    assert [(int(r[1]), int(r[2])) for r in rates.collect()] == [(4, 8)] * 4 == [(r[1], r[2]) for r in copies.collect()]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in (rates, copies)]
    assert len(plans) == 5 and not any("Broadcast" in p for p in plans)
