"""What lies outside the data plane: provers, verifiers, embedders and tree searches.

A provider maps a DataFrame to a DataFrame. Recorded providers answer from a table; a
live one would use ``mapInPandas`` with one model or checker session per partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import chat_prompt, checker_source, dependency_query, extract_proof, fenced, invoked_lemmas, prover_prompt, unfenced, verified
from tessera.operators.evaluate import join_results, overlay_verified
from tessera.operators.relation import last_wins
from tessera.operators.tree import frontier_rate, node_tables, project
from tessera.operators.scoring import collapse_duplicates

Provider = Callable[[DataFrame], DataFrame]

#: Handlers by name: (requests to prompts, completions to proofs, target of training).
HANDLERS = {
    "completion": (lambda r: prover_prompt(r["statement"], r["header"]), lambda text, statement: unfenced(text), lambda statement, proof: proof),
    "chat": (lambda r: chat_prompt(r["statement"], r["header"]), extract_proof, fenced),
}


def prompted(requests: DataFrame, handler: str) -> DataFrame:
    return requests.withColumn("prompt", HANDLERS[handler][0](requests))


def parsed(completions: DataFrame, handler: str) -> DataFrame:
    """Of (statement, raw_output): the proof in it, null without one."""
    return completions.withColumn("proof", HANDLERS[handler][1](F.col("raw_output"), F.col("statement")))


def recorded(answers: DataFrame, key: str) -> Provider:
    """Answers each row from a table by key; a row without an answer gets nulls."""
    last = last_wins(answers, [key], ["ord"]).drop("ord")
    return lambda rows: rows.join(last, key, "left")


def solve(requests: DataFrame, prover: Provider, verifier: Provider) -> DataFrame:
    """Attempts of a language model: equal outputs collapse before they are verified."""
    made = prover(requests.withColumnRenamed("id", "request_id"))
    attempts = made.select(
        "request_id", "statement_id", "attempt", F.lit("llm").alias("solver"), "seed", F.lit("failed").alias("status"), "proof",
        "duration_seconds", "generated_tokens", F.lit(0.0).alias("verify_seconds"), F.array().cast("array<string>").alias("invoked_lemmas"), F.lit(1).cast("long").alias("multiplicity"), "raw_output", F.col("seed").alias("ord"),
    )
    return verify(collapse_duplicates(attempts), verifier)


def verify(attempts: DataFrame, verifier: Provider) -> DataFrame:
    """Only attempts with a proof go to the verifier, which names verified, verify_seconds, invoked_lemmas."""
    sent = attempts.filter("proof IS NOT NULL")
    checked = verifier(sent.drop("verify_seconds", "invoked_lemmas"))
    done = checked.withColumn("status", F.when(F.coalesce("verified", F.lit(False)), "proved").otherwise(F.col("status"))).drop("verified")
    done = done.withColumn("verify_seconds", F.coalesce("verify_seconds", F.lit(0.0))).withColumn("invoked_lemmas", F.coalesce("invoked_lemmas", F.array().cast("array<string>")))
    return overlay_verified(attempts, done.select(*attempts.columns))


def checks(attempts: DataFrame, requests: DataFrame) -> DataFrame:
    """Attempts with their requests' statements (the last of an id) as code for the checker and the
    query for the constants used; an attempt of an unknown request raises."""
    known = last_wins(requests, ["id"], ["ord"]).select(F.col("id").alias("request_id"), "statement", "header")
    joined = attempts.join(known, "request_id", "left")
    statement = F.coalesce("statement", F.raise_error(F.concat(F.lit("an unknown request: "), "request_id")).cast("string"))
    return joined.select(*attempts.columns, checker_source(F.col("header"), statement, F.col("proof")).alias("code"), dependency_query(statement).alias("query"))


def checked(attempts: DataFrame, replies: DataFrame, declarations: DataFrame) -> DataFrame:
    """Attempts by the checker's replies (request_id, messages, dependencies, seconds, error): proved
    without an error or a sign of sorry, else failed; lemmas are the constants that are declared.
    What the checker failed on is failed alone, and the rest goes on. An attempt without a reply raises."""
    joined = attempts.drop("status", "verify_seconds", "invoked_lemmas").join(replies, "request_id", "left")
    answered = F.coalesce(F.col("seconds"), F.raise_error(F.concat(F.lit("no reply for "), "request_id")).cast("double"))
    told = joined.withColumn("verify_seconds", answered).withColumn("_used", F.when(F.col("error").isNull(), invoked_lemmas(F.col("dependencies"))))
    each = told.select("request_id", F.posexplode("_used").alias("_at", "full_name")).join(declarations.select("full_name").distinct(), "full_name")
    lemmas = each.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("_at", "full_name"))), lambda x: x["full_name"]).alias("invoked_lemmas"))
    status = F.when(F.col("error").isNull() & verified(F.col("messages")), "proved").otherwise("failed")
    done = told.withColumn("status", status).join(lemmas, "request_id", "left")
    return done.withColumn("invoked_lemmas", F.coalesce("invoked_lemmas", F.array().cast("array<string>"))).select(*attempts.columns)


def searched(requests: DataFrame, results: DataFrame, verifier: Provider) -> DataFrame:
    """Attempts of a tree search: each request with its last result (a missing one raises) and its
    tree's frontier; equal attempts collapse, and what is proved goes to the verifier."""
    spark = requests.sparkSession
    asked = requests.select(F.col("id").alias("request_id"), "statement_id", "attempt", "seed", "ord")
    joined = join_results(asked, results.select("request_id", "status", "proof", "duration_seconds", "generated_tokens", "verify_seconds", "tree", "ord"))
    rates = frontier_rate(project(spark, *node_tables(joined.select(F.col("request_id").alias("tree_id"), "tree")))).withColumnRenamed("tree_id", "request_id")
    attempts = joined.join(rates, "request_id", "left").select(
        "request_id", "statement_id", "attempt", F.lit("alphaproof").alias("solver"), "seed", "status", "proof", "duration_seconds", F.coalesce("generated_tokens", F.lit(0)).cast("long").alias("generated_tokens"),
        F.coalesce("verify_seconds", F.lit(0.0)).alias("verify_seconds"), F.array().cast("array<string>").alias("invoked_lemmas"), F.lit(1).cast("long").alias("multiplicity"), F.lit(None).cast("string").alias("raw_output"),
        "solved_frontier_nodes", "total_frontier_nodes", "solve_rate", "ord",
    )
    once = collapse_duplicates(attempts)
    proved = verifier(once.filter("status = 'proved'").drop("verify_seconds", "invoked_lemmas"))
    done = proved.withColumn("status", F.when(F.coalesce("verified", F.lit(False)), "proved").otherwise("failed")).drop("verified")
    return overlay_verified(once, done.select(*once.columns))


def dispatch(kind: str, solvers: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame], DataFrame]:
    """The solver of a kind; an unknown kind raises."""
    if kind not in solvers:
        raise ValueError(f"an unknown solver: {kind}")
    return solvers[kind]


def with_hooks(conjectures: DataFrame, *hooks: Provider) -> DataFrame:
    """Screening and ranking hooks in turn; none leaves the table as it is."""
    for hook in hooks:
        conjectures = conjectures.transform(hook)
    return conjectures
