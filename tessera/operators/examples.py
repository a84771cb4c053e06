"""Training examples: prover, conjecturer, replay and supervised ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.draw import shuffle_key
from tessera.functions.numeric import prover_weight
from tessera.functions.text import conjecture_target, conjecturer_prompt, prover_prompt, stable_id
from tessera.operators.matching import match_to_targets
from tessera.operators.relation import cutoff, first_wins, last_wins, union_first_wins
from tessera.plans.scratch import checkpointed


def with_success_counts(attempts: DataFrame) -> DataFrame:
    """Adds the statement's proved multiplicity (null proofs count)."""
    proved = attempts.groupBy("statement_id").agg(F.sum(F.when(F.col("status") == "proved", F.col("multiplicity")).otherwise(0)).alias("success_count"))
    return attempts.join(proved, "statement_id")


def prover_examples(attempts: DataFrame, pool: DataFrame, rates: DataFrame, threshold: float, round_index: int = 0) -> DataFrame:
    """Verified proofs of statements that are not too easy, the first of equal ones. A proved
    statement without a rate or outside the pool raises; of a pool's rows with one id the last counts."""
    counted = with_success_counts(attempts).filter("status = 'proved' AND proof IS NOT NULL")
    rated = counted.join(rates.select("statement_id", F.col("score").alias("_score")), "statement_id", "left")
    score = F.coalesce("_score", F.raise_error(F.lit("a proved statement without a rate")).cast("double"))
    kept = first_wins(rated.filter(score <= threshold), ["statement_id", "proof"], ["ord"])
    pool = last_wins(pool, ["id"], ["ord"] if "ord" in pool.columns else ["statement", "header"])
    named = kept.join(pool.select(F.col("id").alias("statement_id"), F.col("statement").alias("_statement"), "header"), "statement_id", "left")
    statement = F.coalesce("_statement", F.raise_error(F.lit("a proof of an unknown statement")).cast("string"))
    return named.select(
        prover_prompt(statement, F.col("header")).alias("prompt"),
        F.col("proof").alias("target"),
        prover_weight(F.col("proof"), F.col("verify_seconds"), F.col("success_count")).alias("weight"),
        F.lit("proof").alias("kind"),
        "statement_id",
        F.lit(round_index).alias("round"),
        "ord",
    )


def conjecture_stats(conjectures: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per conjecture: successes (proofs given), whether one reuses the lemma, the shortest proof."""
    proofs = attempts.filter("status = 'proved' AND proof IS NOT NULL").select("statement_id", "multiplicity", "invoked_lemmas", F.length("proof").alias("_length"))
    joined = conjectures.select("id", "shared_lemma").join(proofs, F.col("id") == F.col("statement_id"))
    per = joined.groupBy("id").agg(F.sum("multiplicity").alias("successes"), F.bool_or(F.array_contains("invoked_lemmas", F.col("shared_lemma"))).alias("reused"), F.min("_length").alias("minimum_proof_length"))
    return conjectures.join(per, "id", "left").withColumn("successes", F.coalesce("successes", F.lit(0))).withColumn("reused", F.coalesce("reused", F.lit(False)))


def rejection_reason(rate: Column, threshold: float, trivial: Column, successes: Column, reused: Column) -> Column:
    """Null for the classes that go on: trivial ones with a success, and those that reuse their lemma."""
    return F.when(~((rate > 0) & (rate <= threshold)), "pass_rate").when(trivial & (successes > 0), None).when(~trivial & reused, None).otherwise("lemma_not_reused")


def filter_conjectures(conjectures: DataFrame, attempts: DataFrame, rates: DataFrame, threshold: float, trivial_ratio: float, trivial_least: int, elegance: float, seed: int) -> DataFrame:
    """One row for each conjecture with its figures, whether it is selected, and why not."""
    stats = conjecture_stats(conjectures, attempts).join(rates.select(F.col("statement_id").alias("id"), F.col("score").alias("_rate")), "id", "left")
    stats = stats.withColumn("pass_rate", F.coalesce("_rate", F.lit(0.0))).withColumn("trivial_lemma", F.col("shared_lemma") == "").drop("_rate")
    reason = rejection_reason(F.col("pass_rate"), threshold, F.col("trivial_lemma"), F.col("successes"), F.col("reused"))
    # counted, ranked and cut below: the joins run once
    judged = checkpointed(stats.withColumn("rejection_reason", reason))
    named = judged.filter("rejection_reason IS NULL AND NOT trivial_lemma").count()
    cap = max(int(trivial_ratio * named), trivial_least)
    # the trivial ones that stay are a limit's, which takes each task's first ones before they meet
    trivial = judged.filter("rejection_reason IS NULL AND trivial_lemma").select("id")
    stay = trivial.orderBy(shuffle_key(seed, "unfocused", "id"), "id").limit(cap).withColumn("_stays", F.lit(True))
    judged = judged.join(stay, "id", "left")
    over = F.col("rejection_reason").isNull() & F.col("trivial_lemma") & F.col("_stays").isNull()
    judged = judged.withColumn("rejection_reason", F.when(over, "unfocused_cap").otherwise(F.col("rejection_reason"))).drop("_stays")
    score = F.when(F.col("rejection_reason").isNull(), F.col("minimum_proof_length") / F.length("statement"))
    judged = judged.withColumn("elegance_score", score)
    least = cutoff(judged, "elegance_score", elegance)
    low = F.col("elegance_score") < F.lit(least)
    judged = judged.withColumn("rejection_reason", F.when(F.col("rejection_reason").isNull() & low, "elegance").otherwise(F.col("rejection_reason")))
    return judged.withColumn("selected", F.col("rejection_reason").isNull())


def conjecturer_examples(filtered: DataFrame, round_index: int = 0) -> DataFrame:
    """Prompt and target of each selected conjecture."""
    return filtered.filter("selected").select(
        conjecturer_prompt(F.col("shared_lemma_statement"), F.col("easy_statement"), F.col("easy_proof")).alias("prompt"),
        conjecture_target(F.col("statement")).alias("target"),
        F.lit(1.0).alias("weight"),
        F.lit("conjecture").alias("kind"),
        F.col("id").alias("statement_id"),
        F.lit(round_index).alias("round"),
        "ord",
    )


def replay_window(df: DataFrame, round_index: int, rounds: int) -> DataFrame:
    """Rounds r - rounds + 1 to r; a filter on the partition column."""
    return df.filter(F.col("round").between(max(0, round_index - rounds + 1), round_index))


def replay_examples(attempts: DataFrame, pools: DataFrame, rates: DataFrame, round_index: int, rounds: int, threshold: float) -> DataFrame:
    """Prover examples of each round of the window by that round's rates, first wins over rounds."""
    parts = []
    for r in range(max(0, round_index - rounds + 1), round_index + 1):
        of = lambda df, r=r: df.filter(F.col("round") == r).drop("round")
        parts.append(prover_examples(of(attempts), of(pools), of(rates), threshold, r))
    return dedup_examples(parts)


def dedup_examples(sources: list[DataFrame]) -> DataFrame:
    return union_first_wins(sources, ["prompt", "target"], ["ord"])


def sft_examples(records: DataFrame) -> DataFrame:
    """Rows of either shape: {prompt, target} or {formal_statement, proof, header}."""
    ready = F.col("prompt").isNotNull() & F.col("target").isNotNull()
    prompt = F.when(ready, F.col("prompt")).otherwise(prover_prompt(F.col("formal_statement"), F.col("header")))
    name = F.when(ready, stable_id(F.col("prompt"))).otherwise(stable_id(F.concat(F.coalesce("header", F.lit("")), "formal_statement")))
    return records.select(
        prompt.alias("prompt"),
        F.when(ready, F.col("target")).otherwise(F.col("proof")).alias("target"),
        F.coalesce("weight", F.lit(1.0)).alias("weight"),
        F.lit("sft").alias("kind"),
        name.alias("statement_id"),
        F.lit(-1).alias("round"),
        "ord",
    )


def first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    return first_wins(df, keys, ["ord"])


def match_conjecturer_examples(examples: DataFrame, vectors: DataFrame, targets: DataFrame, capacity: float = 3.0) -> DataFrame:
    """Examples with the weights that matching to ``targets`` (id, vector, weight) gives; those that no
    target takes go, and without targets none stays. ``vectors``: (ord, vector) of the examples."""
    weights = match_to_targets(vectors.select(F.col("ord").alias("id"), "vector"), targets, capacity)
    return examples.drop("weight").join(weights.select(F.col("candidate_id").alias("ord"), "weight"), "ord").select(*examples.columns)


def prepare_training_examples(sft: DataFrame, replay: DataFrame, conjectures: DataFrame) -> DataFrame:
    """Supervised, replayed and conjecture examples as one set, of equal ones the first; none raises."""
    return require_some(dedup_examples([sft, replay, conjectures]))


def require_some(examples: DataFrame) -> DataFrame:
    """``examples`` if there are any; none raises."""
    if examples.isEmpty():
        raise ValueError("no training examples")
    return examples
