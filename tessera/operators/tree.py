"""AND/OR search trees: hardest-subproblem projection and the frontier's solve rate.

Trees are node tables (tree_id, id, node_type, value, proven, is_root) and edge tables
(tree_id, parent, ord, child), all trees at once.

Joins here merge: node and edge tables are often derived from small files by ``explode``, and Spark,
which judges them by those files, would send them whole through the driver at every level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.scratch import checkpointed, scratch_path, written

#: Deeper trees raise.
MAX_DEPTH = 10_000
#: Edges of a bucket of those that paths are counted over, and buckets at most.
BUCKET_EDGES, MAX_BUCKETS = 1 << 18, 1000
_ROWS = "spark.sql.cteRecursionRowLimit"


def node_tables(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (tree_id, tree STRUCT<root_id, nodes>): nodes and edges."""
    each = trees.select("tree_id", F.col("tree.root_id").alias("root_id"), F.explode("tree.nodes").alias("n"))
    nodes = each.select("tree_id", F.col("n.id").alias("id"), "n.node_type", "n.value", "n.proven", (F.col("n.id") == F.col("root_id")).alias("is_root"))
    edges = each.select("tree_id", F.col("n.id").alias("parent"), F.posexplode("n.children").alias("ord", "c")).select("tree_id", "parent", "ord", F.col("c.node_id").alias("child"), F.col("c.action").alias("action"))
    return nodes, edges


def collapsed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """OR to OR: an AND child is replaced by its OR child of lowest value (the first of equal ones).
    AND nodes without children and AND children of AND nodes raise."""
    kinds = nodes.select("tree_id", "id", "node_type", "value")
    typed = edges.join(kinds.select("tree_id", F.col("id").alias("child"), F.col("node_type").alias("child_type"), F.col("value").alias("child_value")).hint("merge"), ["tree_id", "child"])
    typed = typed.join(kinds.select("tree_id", F.col("id").alias("parent"), F.col("node_type").alias("parent_type")).hint("merge"), ["tree_id", "parent"])
    below = typed.filter("parent_type = 'AND'")
    first = F.struct("child_value", "ord")
    sound = F.when(F.bool_and(F.col("child_type") == "OR"), F.min_by("child", first)).otherwise(F.raise_error(F.lit("an AND node below an AND node")).cast("bigint"))
    action = F.min_by("action", first) if "action" in edges.columns else F.lit(None).cast("string")
    hardest = below.groupBy("tree_id", "parent").agg(sound.alias("focus"), action.alias("selected_focus_action")).select("tree_id", F.col("parent").alias("child"), "focus", "selected_focus_action")
    above = typed.filter("parent_type = 'OR'").join(hardest.hint("merge"), ["tree_id", "child"], "left")
    target = F.when(F.col("child_type") == "OR", F.col("child")).otherwise(F.coalesce("focus", F.raise_error(F.lit("an AND node without children")).cast("bigint")))
    return above.select("tree_id", "parent", "ord", target.alias("child"), F.when(F.col("child_type") == "AND", F.col("child")).alias("collapsed_and_node_id"), "selected_focus_action")


def project(spark: SparkSession, nodes: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Nodes of the projected trees: tree_id, node (preorder number), id, path, parent_path, value, proven.
    A node that several paths reach is repeated for each. The walk runs once, for all trees, and is
    written down: what reads the projection does not walk again."""
    own = uuid.uuid4().hex
    roots = nodes.filter("is_root")
    bad = F.raise_error(F.lit("a projected node that is no OR node")).cast("bigint")
    roots.select("tree_id", F.when(F.col("node_type") == "OR", F.col("id")).otherwise(bad).alias("id")).createOrReplaceTempView(f"tessera_roots_{own}")
    # written down once: each level of the walk reads them again
    written(collapsed_edges(nodes, edges).select("tree_id", "parent", "ord", "child")).createOrReplaceTempView(f"tessera_edges_{own}")
    walked = spark.sql(
        f"""
        WITH RECURSIVE walk(tree_id, id, path) MAX RECURSION LEVEL {depth} AS (
          SELECT tree_id, id, array(0) FROM tessera_roots_{own}
          UNION ALL
          SELECT /*+ MERGE(e) */ w.tree_id, e.child, array_append(w.path, e.ord) FROM walk w JOIN tessera_edges_{own} e ON e.tree_id = w.tree_id AND e.parent = w.id
        )
        SELECT tree_id, id, path, slice(path, 1, greatest(size(path) - 1, 0)) AS parent_path,
               row_number() OVER (PARTITION BY tree_id ORDER BY path) - 1 AS node
        FROM walk
        """
    )
    # the depth bounds the walk, the rows of all trees together need no bound
    bound = spark.conf.get(_ROWS, None)
    spark.conf.set(_ROWS, "-1")
    try:
        return checkpointed(walked.join(nodes.select("tree_id", "id", "value", "proven").hint("merge"), ["tree_id", "id"]))
    finally:
        spark.conf.unset(_ROWS) if bound is None else spark.conf.set(_ROWS, bound)
        spark.catalog.dropTempView(f"tessera_roots_{own}")
        spark.catalog.dropTempView(f"tessera_edges_{own}")


def path_counts(nodes: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(tree_id, id, paths): by how many paths the projection reaches each node, which is how many copies
    of it ``project`` makes. Counts go down the collapsed edges level by level, one row for a node and
    level however many paths meet there, so that trees that share nodes cost what their edges do. Nodes
    below ``depth`` levels (a cycle) raise."""
    return _path_counts(nodes, written(collapsed_edges(nodes, edges).select("tree_id", "parent", "child")), depth)


def _path_counts(nodes: DataFrame, collapsed: DataFrame, depth: int) -> DataFrame:
    """``path_counts`` over collapsed edges, whose children are OR nodes. They are dealt and written once,
    by buckets of their parents, so that a level shuffles its own rows alone."""
    spark = nodes.sparkSession
    buckets = min(MAX_BUCKETS, 1 + collapsed.count() // BUCKET_EDGES)
    bad = F.raise_error(F.lit("a projected node that is no OR node")).cast("decimal(38,0)")
    one = F.when(F.col("node_type") == "OR", F.lit(1).cast("decimal(38,0)")).otherwise(bad)
    front = nodes.filter("is_root").select("tree_id", "id", one.alias("paths"))
    path, level = scratch_path(spark, "paths"), 0
    table = f"tessera_edges_{uuid.uuid4().hex}"
    dealt = collapsed.select("tree_id", F.col("parent").alias("id"), "child").repartition(buckets, "tree_id", "id")
    dealt.write.bucketBy(buckets, "tree_id", "id").option("path", scratch_path(spark, "edges")).saveAsTable(table)
    try:
        below = spark.table(table)
        while True:
            front.write.parquet(f"{path}/level={level}")
            here = spark.read.schema(front.schema).parquet(f"{path}/level={level}")
            if here.isEmpty():
                break
            if level > depth:
                raise ValueError(f"a tree of more than {depth} levels")
            summed = F.sum("paths").cast("decimal(38,0)")
            front = below.join(here.hint("merge"), ["tree_id", "id"]).groupBy("tree_id", F.col("child").alias("id")).agg(summed.alias("paths"))
            level += 1
    finally:
        spark.sql(f"DROP TABLE {table}")
    return spark.read.parquet(path).groupBy("tree_id", "id").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))


def frontier_rate_by_counts(nodes: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """``frontier_rate`` of the projection without making it: each node counts as often as paths reach it."""
    down = written(collapsed_edges(nodes, edges).select("tree_id", "parent", "child"))
    paths = written(_path_counts(nodes, down, depth))
    parents = down.select("tree_id", F.col("parent").alias("id")).distinct()
    leaves = paths.join(parents.hint("merge"), ["tree_id", "id"], "left_anti").select("tree_id", "id")
    above = down.join(leaves.withColumnRenamed("id", "child").hint("merge"), ["tree_id", "child"], "left_semi").select("tree_id", F.col("parent").alias("id"))
    single = leaves.join(nodes.filter("is_root").select("tree_id", "id").hint("merge"), ["tree_id", "id"], "left_semi")
    reached = paths.join(nodes.select("tree_id", "id", "proven").hint("merge"), ["tree_id", "id"])
    frontier = reached.join(above.union(single).distinct().hint("merge"), ["tree_id", "id"], "left_semi")
    solved, total = F.coalesce(F.sum(F.when(F.col("proven"), F.col("paths"))), F.lit(0)), F.sum("paths")
    return frontier.groupBy("tree_id").agg(solved.cast("decimal(38,0)").alias("solved_frontier_nodes"), total.cast("decimal(38,0)").alias("total_frontier_nodes"), (solved.cast("double") / total.cast("double")).alias("solve_rate"))


def frontier_rate(projected: DataFrame) -> DataFrame:
    """Per tree: solved and total frontier nodes and their ratio. The frontier holds the nodes with
    a leaf below them; a tree of one node is its own frontier."""
    parents = projected.select("tree_id", F.col("parent_path").alias("path")).distinct()
    leaves = projected.join(parents.hint("merge"), ["tree_id", "path"], "left_anti")
    above = leaves.filter(F.size("parent_path") > 0).select("tree_id", F.col("parent_path").alias("path")).distinct()
    single = leaves.filter(F.size("parent_path") == 0).select("tree_id", "path")
    frontier = projected.join(above.union(single).hint("merge"), ["tree_id", "path"], "left_semi")
    return frontier.groupBy("tree_id").agg(
        F.count_if("proven").alias("solved_frontier_nodes"), F.count(F.lit(1)).alias("total_frontier_nodes"), (F.count_if("proven") / F.count(F.lit(1))).alias("solve_rate")
    )
