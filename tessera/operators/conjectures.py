"""From proved statements to conjecture inputs, conjectures and proof requests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.draw import priority, shuffle_key, uniform
from tessera.functions.text import TRIVIAL_LEMMA, canonical_statement, conjecture_labels, conjecturer_prompt, parse_conjecture, stable_id
from tessera.operators.relation import distinct_then_capped, first_wins, insert_if_absent, last_wins
from tessera.operators.scan import first_rows, numbered
from tessera.operators.scoring import SOURCE_RATE


def proved_sources(attempts: DataFrame, statements: DataFrame, rates: DataFrame) -> DataFrame:
    """Proofs worth building on: proved, of a known statement solved often enough, the first of equal ones."""
    good = attempts.filter("status = 'proved' AND proof IS NOT NULL")
    known = good.join(statements.select(F.col("id").alias("statement_id")).distinct(), "statement_id", "left_semi")
    often = rates.filter(F.col("score") > SOURCE_RATE).select("statement_id")
    return first_wins(known.join(often, "statement_id", "left_semi"), ["statement_id", "proof"], ["ord"])


def known_lemmas(attempts: DataFrame, declarations: DataFrame) -> DataFrame:
    """A row for each invoked lemma that is declared, in order (place)."""
    named = attempts.select("*", F.posexplode("invoked_lemmas").alias("place", "lemma"))
    return named.join(declarations.select(F.col("full_name").alias("lemma")).distinct(), "lemma", "left_semi")


def conjecture_inputs(attempts: DataFrame, statements: DataFrame, rates: DataFrame, declarations: DataFrame, unproved_count: int, trivial_chance: float, cap_fraction: float, seed: int) -> DataFrame:
    """Seeds for conjectures: proofs with a lemma each, at most one row per (statement, lemma) and
    a capped number per lemma, drawn by the statements' weights. The trivial lemma is ''."""
    sources = proved_sources(attempts, statements, rates)
    lemmas = known_lemmas(sources, declarations).select(*sources.columns, "lemma")
    trivial = sources.filter(uniform(seed, "trivial", "request_id") < trivial_chance).withColumn("lemma", F.lit(""))
    every = lemmas.unionByName(trivial).withColumn("_shuffle", shuffle_key(seed, "shuffle", "request_id", "lemma"))
    kept = distinct_then_capped(every, ["statement_id", "lemma"], ["lemma"], math.ceil(cap_fraction * unproved_count), ["_shuffle"])
    by_id = last_wins(statements, ["id"], ["ord"]).select(
        F.col("id").alias("statement_id"), F.col("statement").alias("seed_statement"), "header", "labels", "matching_weight"
    )
    named = kept.join(by_id, "statement_id").join(declarations.select(F.col("full_name").alias("lemma"), F.col("statement").alias("_lemma")), "lemma", "left")
    drawn = named.withColumn("_priority", priority(seed, "priority", "matching_weight", "request_id", "lemma"))
    drawn = numbered(drawn, [F.desc("_priority"), "request_id", "lemma"], name="_index").filter(F.col("_index") < unproved_count)
    return drawn.withColumn("generation_seed", F.lit(seed) + F.col("_index")).select(
        stable_id(F.concat("request_id", F.lit("\n"), "lemma")).alias("id"),
        F.col("statement_id").alias("seed_statement_id"),
        "seed_statement",
        F.coalesce("proof", F.lit("")).alias("seed_proof"),
        F.col("request_id").alias("source_attempt_id"),
        F.col("lemma").alias("shared_lemma"),
        F.when(F.col("lemma") == "", TRIVIAL_LEMMA).otherwise(F.col("_lemma")).alias("shared_lemma_statement"),
        (F.col("lemma") == "").alias("trivial_lemma"),
        "header",
        "labels",
        "matching_weight",
        "generation_seed",
    )


def generation_prompts(inputs: DataFrame, samples: int, seed_step: int = 1) -> DataFrame:
    """Sample-major: all inputs for sample 0, then all for sample 1, and so on (ord)."""
    n = inputs.count()
    wide = inputs.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    prompt = conjecturer_prompt(F.col("shared_lemma_statement"), F.col("seed_statement"), F.col("seed_proof"), generation=True)
    return wide.withColumn("prompt", prompt).withColumn("ord", F.col("sample") * n + F.col("ord"))


def parsed_conjectures(outputs: DataFrame, inputs: DataFrame, existing: DataFrame, limit: int = 0, seed: int = 0) -> DataFrame:
    """Outputs (conjecture_input_id, text, ord) as new conjectures: canonical, not existing, the first
    of equal ones, with rewritten labels, shuffled."""
    joined = outputs.join(inputs.withColumnRenamed("id", "conjecture_input_id").drop("ord"), "conjecture_input_id")
    named = joined.withColumn("statement", canonical_statement(parse_conjecture(F.col("text"))))
    named = named.withColumn("id", stable_id(F.concat(F.coalesce("header", F.lit("")), "statement")))
    fresh = first_wins(insert_if_absent(named, existing, ["id"]), ["id"], ["ord"])
    fresh = fresh.select(
        "id", "conjecture_input_id", "statement", F.col("seed_statement").alias("easy_statement"), F.col("seed_proof").alias("easy_proof"), "shared_lemma", "shared_lemma_statement", "header", conjecture_labels(F.col("labels")).alias("labels")
    )
    order = [shuffle_key(seed, "conjectures", "id"), "id"]
    return first_rows(fresh, order, limit) if limit > 0 else fresh.orderBy(*order)


def proof_requests(pool: DataFrame, attempts: int, seed: int) -> DataFrame:
    """``attempts`` numbered requests for each statement of the pool (ord from 0 without gaps)."""
    wide = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    return wide.select(
        F.concat_ws(":", F.col("id"), F.col("attempt").cast("string")).alias("id"),
        F.col("id").alias("statement_id"),
        "statement",
        "header",
        F.col("attempt").cast("long").alias("attempt"),
        (F.lit(seed) + F.col("ord") * attempts + F.col("attempt")).cast("long").alias("seed"),
        "source",
    )
