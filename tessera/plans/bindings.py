"""The domain's relations bound to the test tables, as DataFrames and as SQL.

Each SQL text is a list of common table expressions to put after WITH.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.concat(F.lit("theorem t"), key, F.lit(" : "), F.col("o_orderpriority"), F.lit(" := by")).alias("statement"),
        F.lit(None).cast("string").alias("header"),
        F.array("o_orderstatus").alias("labels"),
        (1 + F.col("o_orderkey") % 3).cast("double").alias("matching_weight"),
        F.lit("dataset").alias("source"),
        F.col("o_orderkey").alias("ord"),
    )


STATEMENTS = """
statements AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, concat('theorem t', o_orderkey, ' : ', o_orderpriority, ' := by') AS statement,
         o_orderstatus AS label, CAST(1 + o_orderkey % 3 AS DOUBLE) AS matching_weight, o_orderkey AS ord
  FROM orders
)"""

_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def attempts(spark: SparkSession, sf_dir: str, lemmas: bool = False) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    # rows have no key of their own: their order within a statement is that of all columns
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)).cast("long")
    lines = lines.withColumn("ord", place)
    brand = F.lit(None).cast("string")
    if lemmas:
        lines = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")
        brand = F.col("p_brand")
    key = F.col("l_orderkey").cast("string")
    return lines.select(
        F.concat_ws(":", key, F.col("ord").cast("string")).alias("request_id"),
        key.alias("statement_id"),
        F.col("l_linenumber").cast("long").alias("attempt"),
        F.lit("llm").alias("solver"),
        F.when(F.col("l_returnflag") == "R", "proved").when(F.col("l_returnflag") == "A", "failed").otherwise("timeout").alias("status"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("exact L"), (F.col("l_partkey") % 7).cast("string"))).alias("proof"),
        F.col("l_quantity").alias("duration_seconds"),
        F.col("l_suppkey").alias("generated_tokens"),
        (F.col("l_tax") * 100).alias("verify_seconds"),
        F.when(brand.isNotNull(), F.array(brand)).otherwise(F.array().cast("array<string>")).alias("invoked_lemmas"),
        F.lit(1).cast("long").alias("multiplicity"),
        F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string")).alias("raw_output"),
        (F.col("l_linenumber") % 3).alias("round"),
        "ord",
    )


ATTEMPTS = f"""
attempts AS (
  SELECT concat_ws(':', l_orderkey, ord) AS request_id, CAST(l_orderkey AS VARCHAR) AS statement_id, l_linenumber AS attempt,
         CASE l_returnflag WHEN 'R' THEN 'proved' WHEN 'A' THEN 'failed' ELSE 'timeout' END AS status,
         CASE WHEN l_linestatus = 'F' THEN concat('exact L', l_partkey % 7) END AS proof,
         l_quantity AS duration_seconds, l_suppkey AS generated_tokens, l_tax * 100 AS verify_seconds,
         concat('r', l_suppkey % 3) AS raw_output, l_linenumber % 3 AS round, l_partkey, ord
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_LINE_ORDER)}) AS ord FROM lineitem)
)"""

RATES = """
rates AS (
  SELECT statement_id, count(*) AS attempts, count(*) FILTER (status = 'proved') AS successes,
         count(*) FILTER (status = 'proved') / count(*) AS score
  FROM attempts GROUP BY statement_id
)"""


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("full_name")).distinct().filter("NOT endswith(full_name, '5')")
    return names.withColumn("statement", F.concat(F.lit("lemma "), "full_name"))


DECLARATIONS = """
declarations AS (SELECT DISTINCT p_brand AS full_name, concat('lemma ', p_brand) AS statement FROM part WHERE NOT ends_with(p_brand, '5'))"""


def conjectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of status P, with a lemma in two of three."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        key.cast("string").alias("id"),
        F.concat(F.lit("theorem t"), key.cast("string"), F.lit(" : "), "o_orderpriority", F.lit(" := by")).alias("statement"),
        F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string"))).alias("shared_lemma"),
        F.lit("lemma l : True").alias("shared_lemma_statement"),
        F.concat(F.lit("theorem e"), key.cast("string"), F.lit(" := by")).alias("easy_statement"),
        F.lit(" simp").alias("easy_proof"),
        key.alias("ord"),
    )


CONJECTURES = """
conjectures AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, concat('theorem t', o_orderkey, ' : ', o_orderpriority, ' := by') AS statement,
         CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Brand#', o_orderkey % 25 + 1) END AS shared_lemma, o_orderkey AS ord
  FROM orders WHERE o_orderstatus = 'P'
)"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and weighted targets."""
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), (1 + F.col("label") % 3).cast("double").alias("weight"))
    return every.filter("id % 2 = 0").drop("weight"), every.filter("id % 2 = 1")


VECTORS = """
candidates AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id % 2 = 0),
targets AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, 1 + label % 3 AS weight FROM embeddings WHERE vec_id % 2 = 1)"""


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as one ternary AND/OR tree: even depths are OR nodes, and leaves always are."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("value"), (F.col("p_size") % 2 == 0).alias("proven"))
    n = parts.agg(F.max("id")).first()[0]
    # the level k starts at (3**k - 1) / 2
    depth = F.floor(F.log(F.col("id") * 2 + 1.5) / F.lit(1.0986122886681098)).cast("int")
    inner = F.col("id") * 3 + 1 <= n
    nodes = parts.select(F.lit(0).alias("tree_id"), "id", F.when((depth % 2 == 1) & inner, "AND").otherwise("OR").alias("node_type"), "value", "proven", (F.col("id") == 0).alias("is_root"))
    edges = parts.filter("id > 0").select(F.lit(0).alias("tree_id"), F.expr("(id - 1) div 3").alias("parent"), ((F.col("id") - 1) % 3).cast("int").alias("ord"), F.col("id").alias("child"))
    return nodes, edges


TREE = """
nodes AS (
  SELECT p_partkey AS id, p_retailprice AS value, p_size % 2 = 0 AS proven,
         CASE WHEN CAST(floor(ln(p_partkey * 2 + 1.5) / 1.0986122886681098) AS INT) % 2 = 1
                   AND p_partkey * 3 + 1 <= (SELECT max(p_partkey) FROM part) THEN 'AND' ELSE 'OR' END AS node_type
  FROM part
),
edges AS (SELECT (p_partkey - 1) // 3 AS parent, (p_partkey - 1) % 3 AS ord, p_partkey AS child FROM part WHERE p_partkey > 0),
focus AS (
  SELECT e.parent AS id, arg_min(e.child, c.value * 10 + e.ord * 0.001) AS target
  FROM edges e JOIN nodes c ON c.id = e.child JOIN nodes p ON p.id = e.parent WHERE p.node_type = 'AND' GROUP BY 1
),
collapsed AS (
  SELECT e.parent, e.ord, coalesce(f.target, e.child) AS child
  FROM edges e JOIN nodes p ON p.id = e.parent AND p.node_type = 'OR' JOIN nodes c ON c.id = e.child
  LEFT JOIN focus f ON f.id = e.child AND c.node_type = 'AND'
),
walk AS (
  SELECT CAST(0 AS BIGINT) AS id, [CAST(0 AS BIGINT)] AS path
  UNION ALL SELECT e.child, list_append(w.path, e.ord) FROM walk w JOIN collapsed e ON e.parent = w.id
),
projected AS (
  SELECT w.id, w.path, w.path[1:len(w.path) - 1] AS parent_path, row_number() OVER (ORDER BY w.path) - 1 AS node, n.value, n.proven
  FROM walk w JOIN nodes n ON n.id = w.id
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's next turn, as prompt and target tokens (word lengths)."""
    turns = table(spark, sf_dir, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("next_role", F.lead("role").over(after)).withColumn("next_text", F.lead("text").over(after)).filter("role = 'user' AND next_role = 'assistant'")
    tokens = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w).cast("int"))
    return pairs.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", F.col("text").alias("prompt"), F.col("next_text").alias("target"), tokens("text").alias("prompt_tokens"), tokens("next_text").alias("target_tokens")
    )


TOKEN_ROWS = """
pairs AS (
  SELECT concat_ws(':', conv_id, turn) AS id, conv_id, turn, text AS prompt, next_text AS target,
         list_transform(string_split(text, ' '), lambda w: length(w)) AS prompt_tokens,
         list_transform(string_split(next_text, ' '), lambda w: length(w)) AS target_tokens
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant'
)"""
