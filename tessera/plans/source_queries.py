"""Queries over files that are written from the test tables first: logs, records, sources, versions."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import conjectures as C
from tessera.operators import relation, scoring, tokens
from tessera.plans import bindings as B
from tessera.plans.queries import SQL, query, r6
from tessera.plans.scratch import scratch_path
from tessera.sources import metrics, publish, records
from tessera.streaming import keyed


@query("SELECT event_id, event_type, value FROM events")
def torn_log(spark, d):
    """A log whose last line a crash has cut."""
    path = scratch_path(spark, "log")
    records.write_lines(B.events(spark, d).select("event_id", "event_type", "value", F.col("event_id").alias("ord")), path)
    publish.write_text(spark, f"{path}/zz-last.json", '{"event_id": 1, "event_ty')
    return records.read_resumable(spark, path, "event_id BIGINT, event_type STRING, value DOUBLE").drop("ord")


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'open') AS o_orderstatus, CAST(3 AS INT) AS retries, CAST(NULL AS VARCHAR) AS remark FROM orders")
def typed_records(spark, d):
    """Records with missing, null and unknown fields."""
    rows = B.table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.lit(1).alias("unknown"))
    kinds = T.StructType([T.StructField("o_orderkey", T.LongType(), False), T.StructField("o_orderstatus", T.StringType()), T.StructField("retries", T.IntegerType()), T.StructField("remark", T.StringType())])
    return records.typed(rows, kinds, {"o_orderstatus": "open", "retries": 3})


@query("SELECT CAST(doc_id AS VARCHAR) AS id, concat('theorem d', doc_id, ' : p := by') AS statement, concat('part', doc_id % 4) AS label FROM documents")
def problem_rows(spark, d):
    docs, path = B.table(spark, d, "documents"), scratch_path(spark, "problems")
    name = F.col("doc_id").cast("string")
    parts = []
    for k in range(4):
        rows = docs.filter(F.col("doc_id") % 4 == k).select(name.alias("id"), F.concat(F.lit("theorem d"), name, F.lit(" : p :=  by sorry")).alias("theorem"), F.col("doc_id").alias("ord"))
        records.write_lines(rows, f"{path}/{k}.jsonl")
        parts.append(records.load_problems(spark, f"{path}/{k}.jsonl", [f"part{k}"]))
    return relation.union_all(parts).select("id", "statement", F.col("labels")[0].alias("label"))


_SOURCE = "SELECT substr(sha256(concat('import A', chr(10), s)), 1, 20) AS id, s AS statement, {weight} AS matching_weight, CAST({k} AS INT) AS source FROM (SELECT concat('theorem {letter}', {key}, ' : q := by') AS s FROM {table})"


@query(" UNION ALL ".join(_SOURCE.format(**x) for x in ({"weight": "2.0e0", "k": 0, "letter": "p", "key": "p_partkey", "table": "part"}, {"weight": "1.0e0", "k": 1, "letter": "c", "key": "c_custkey", "table": "customer"})))
def statement_sources(spark, d):
    """All sources of a configuration, one after the other."""
    root, entries = scratch_path(spark, "sources"), []
    for table, key, letter, weight in (("part", "p_partkey", "p", 2.0), ("customer", "c_custkey", "c", 1.0)):
        rows = B.table(spark, d, table).select(
            F.concat(F.lit(f"theorem {letter}"), F.col(key).cast("string"), F.lit(" : q := by")).alias("formal_statement"), F.lit("import A\n").alias("header"), F.lit("train").alias("split"), F.array(F.lit("t")).alias("tags"), F.col(key).alias("ord")
        )
        records.write_lines(rows, f"{root}/{table}.jsonl")
        entries.append({"dataset_path": f"{table}.jsonl", "label": [table], "weight": weight})
    publish.write_text(spark, f"{root}/sources.json", json.dumps(entries))
    return records.load_statements(spark, f"{root}/sources.json", root).select("id", "statement", "matching_weight", F.col("ord.source").alias("source"))


@query("SELECT event_id, event_type FROM events")
def published_events(spark, d):
    """Three additions, each tried twice, and read as one version."""
    root, rows = scratch_path(spark, "published"), B.events(spark, d).select("event_id", "event_type")
    for _ in range(2):
        for k in range(3):
            publish.append(rows.filter(F.col("event_id") % 3 == k), root, once=f"part {k}")
    return publish.read(spark, root)


@query(
    f"""WITH {B.ATTEMPTS}, {B.RATES}, {B.CONJECTURES}
    SELECT (SELECT count(*) FROM attempts) AS solver_attempts, (SELECT count(*) FROM rates WHERE successes > 0) AS solved_statements, (SELECT count(*) FROM orders) AS selected_statements,
           (SELECT count(*) FROM conjectures) AS conjectures, (SELECT count(*) FROM part) AS conjecture_inputs,
           (SELECT count(*) FROM documents) AS training_examples, (SELECT count(*) FROM documents WHERE lang = 'en') AS conjecture_examples"""
)
def round_metrics(spark, d):
    examples = B.table(spark, d, "documents").select(F.when(F.col("lang") == "en", "conjecture").otherwise("proof").alias("kind"))
    summary = scoring.round_summary(B.attempts(spark, d), B.statements(spark, d), B.conjectures(spark, d))
    out = scoring.round_metrics(summary, B.table(spark, d, "part"), examples)
    return out.select("solver_attempts", "solved_statements", "selected_statements", "conjectures", "conjecture_inputs", "training_examples", "conjecture_examples")


@query(
    f"""WITH {B.ATTEMPTS}, small AS (
      SELECT statement_id, count(*) AS n, count(*) FILTER (status = 'proved') AS s, sum(duration_seconds) AS seconds, sum(verify_seconds) AS verify
      FROM attempts WHERE ord <= 3 GROUP BY 1 HAVING count(*) = 3),
    large AS (SELECT statement_id, status, attempt, duration_seconds AS seconds, verify_seconds AS verify FROM attempts WHERE ord = 4)
    SELECT statement_id AS problem_id, 'solve_rate' AS retry_method, a.n AS retry_searches, CAST(200 AS INT) AS retry_rollouts_per_search, a.s AS retry_successes, round(a.s / a.n, 6) AS retry_solve_rate,
           round(a.seconds + a.verify, 6) AS retry_total_seconds, 'alphaproof_hardest_subproblem' AS large_search_method, CAST(1024 AS INT) AS large_search_rollouts, b.status AS large_search_status,
           b.attempt AS large_search_solved_frontier_nodes, b.attempt + 1 AS large_search_total_frontier_nodes, round(b.attempt / (b.attempt + 1), 6) AS large_search_solve_rate, round(b.seconds + b.verify, 6) AS large_search_total_seconds
    FROM small a JOIN large b USING (statement_id)"""
)
def comparison_records(spark, d):
    every = B.attempts(spark, d)
    small = every.filter("ord <= 3")
    full = small.groupBy("statement_id").count().filter("count = 3").select("statement_id")
    nodes = F.col("attempt")
    large = every.filter("ord = 4").withColumns({"solved_frontier_nodes": nodes, "total_frontier_nodes": nodes + 1, "solve_rate": nodes / (nodes + 1)})
    out = scoring.comparison_records(small.join(full, "statement_id", "left_semi"), large, 3)
    rounded = ("retry_solve_rate", "retry_total_seconds", "large_search_solve_rate", "large_search_total_seconds")
    plain = ("problem_id", "retry_method", "retry_searches", "retry_rollouts_per_search", "retry_successes", "large_search_method", "large_search_rollouts", "large_search_status", "large_search_solved_frontier_nodes", "large_search_total_frontier_nodes")
    return out.select(*plain, *(r6(c).alias(c) for c in rounded))


@query(
    f"""WITH {B.CONJECTURES}, named AS (
      SELECT substr(sha256(concat('theorem q', ord % 700, ':= by')), 1, 20) AS id, concat('theorem q', ord % 700, ':= by') AS statement, id AS conjecture_input_id, shared_lemma, ord FROM conjectures)
    SELECT id, statement, arg_min(conjecture_input_id, ord) AS conjecture_input_id, arg_min(shared_lemma, ord) AS shared_lemma FROM named
    WHERE id NOT IN (SELECT substr(sha256(concat('theorem q', p_partkey, ':= by')), 1, 20) FROM part WHERE p_partkey % 3 = 0) GROUP BY 1, 2"""
)
def new_conjectures(spark, d):
    """A conjecturer's texts as conjectures: parsed, canonical, not known, the first of equal ones."""
    ideas = B.conjectures(spark, d)
    inputs = ideas.select("id", F.lit(None).cast("string").alias("header"), F.array(F.lit("l")).alias("labels"), F.col("easy_statement").alias("seed_statement"), F.col("easy_proof").alias("seed_proof"), "shared_lemma", "shared_lemma_statement", "ord")
    outputs = ideas.select(F.col("id").alias("conjecture_input_id"), F.concat(F.lit(" q"), (F.col("ord") % 700).cast("string"), F.lit("\n</hard theorem>")).alias("text"), "ord")
    from tessera.functions.text import stable_id

    known = B.table(spark, d, "part").filter("p_partkey % 3 = 0").select(stable_id(F.concat(F.lit("theorem q"), F.col("p_partkey").cast("string"), F.lit(":= by"))).alias("id"))
    return C.parsed_conjectures(outputs, inputs, known).select("id", "statement", "conjecture_input_id", "shared_lemma")


def _event_stream(spark, d):
    return spark.readStream.schema(B.events(spark, d).schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream_insert_if_absent(spark, d):
    """A stream that is started twice: the second run finds nothing new."""
    root = scratch_path(spark, "stream")
    for _ in range(2):
        stream = _event_stream(spark, d).select("user_id", "event_type", "event_id")
        keyed.insert_if_absent(stream, f"{root}/rows", ["user_id", "event_type"], ["event_id"], f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/rows")


@query(
    """SELECT user_id, arg_min(event_id, rank) AS event_id, arg_min(event_type, rank) AS event_type
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value IS NULL, value DESC, event_id) AS rank FROM events) GROUP BY 1"""
)
def stream_best_rows(spark, d):
    root = scratch_path(spark, "stream")
    best = keyed.best_rows(_event_stream(spark, d).select("user_id", "event_id", "event_type", "value"), ["user_id"], "value", ["event_id"])
    keyed.into_table(best, f"{root}/best", ["user_id"], f"{root}/checkpoint").awaitTermination()
    return keyed.newest(spark, f"{root}/best", ["user_id"]).select("user_id", "event_id", "event_type")


@query(SQL["length_stats"])
def observed_length_stats(spark, d):
    """The same figures, observed while the examples are written."""
    seen = metrics.write_observed(B.token_rows(spark, d), scratch_path(spark, "examples"), tokens.length_metrics(60))
    return spark.createDataFrame([tuple(seen[c] for c in ("read", "kept", "too_long", "truncated", "target_tokens"))], "read BIGINT, kept BIGINT, too_long BIGINT, truncated BIGINT, target_tokens BIGINT")


@query("SELECT event_id AS step, CAST(user_id AS DOUBLE) AS examples_seen, value AS loss FROM events")
def training_log(spark, d):
    """Each event as a training step, logged by name and read as a table."""
    root = scratch_path(spark, "metrics")
    log = metrics.MetricsLog(spark, root, "run", {"seed": 1})
    log.log_steps(B.events(spark, d).select(F.col("event_id").alias("step"), F.col("user_id").alias("examples_seen"), F.col("value").alias("loss")))
    log.log_epoch(-1, 1, {"loss": 0.5}, {"loss": 0.25}, 7)
    log.finish(0)
    table = metrics.metric_table(spark, root, "run", ["train/examples_seen", "train/loss"])
    return table.select("step", F.col("`train/examples_seen`").alias("examples_seen"), F.col("`train/loss`").alias("loss"))
