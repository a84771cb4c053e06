"""Solve rates, their history, and what to train on next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.draw import shuffle_key, uniform
from tessera.operators.relation import first_wins
from tessera.operators.scan import first_rows

#: Statements solved less often than this stay in the curriculum.
CURRICULUM_RATE = 0.35
SOURCE_RATE = 0.35
REPLAY_CHANCE = 0.05


def collapse_duplicates(attempts: DataFrame) -> DataFrame:
    """Equal outputs of a statement as one attempt: multiplicity and costs add up, the rest
    is the first attempt's. Null proofs and outputs are equal to each other."""
    keys, sums = ("statement_id", "proof", "status", "raw_output"), ("duration_seconds", "generated_tokens", "multiplicity")
    rest = [c for c in attempts.columns if c not in (*keys, *sums)]
    grouped = attempts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), F.min_by(F.struct(*rest), "ord").alias("_first"))
    return grouped.select(*(F.col("_first")[c].alias(c) if c in rest else F.col(c) for c in attempts.columns))


def _proved(value):
    return F.sum(F.when(F.col("status") == "proved", value).otherwise(0))


def solve_rates(attempts: DataFrame) -> DataFrame:
    """statement_id, method, score, attempts, successes."""
    per = attempts.groupBy("statement_id").agg(F.sum("multiplicity").alias("attempts"), _proved(F.col("multiplicity")).alias("successes"))
    return per.select("statement_id", F.lit("solve_rate").alias("method"), (F.col("successes") / F.col("attempts")).alias("score"), "attempts", "successes")


def frontier_scores(attempts: DataFrame) -> DataFrame:
    """Scores of tree searches: exactly one attempt for each statement, its frontier's rate."""
    one = F.when(F.count(F.lit(1)) == 1, F.lit(1)).otherwise(F.raise_error(F.lit("a statement with several searches")).cast("int"))
    per = attempts.groupBy("statement_id").agg(one.cast("long").alias("attempts"), F.max("solve_rate").alias("score"), _proved(F.lit(1)).cast("long").alias("successes"))
    return per.select("statement_id", F.lit("alphaproof_hardest_subproblem").alias("method"), "score", "attempts", "successes")


def assess(attempts: DataFrame) -> DataFrame:
    """Each statement by its first attempt's solver."""
    first = first_wins(attempts, ["statement_id"], ["ord"]).select("statement_id", F.col("solver").alias("_solver"))
    tagged = attempts.join(first, "statement_id")
    return solve_rates(tagged.filter("_solver = 'llm'")).unionByName(frontier_scores(tagged.filter("_solver <> 'llm'")))


def best_of_history(scores: DataFrame) -> DataFrame:
    """The greatest score of each statement; of equal ones the earliest (round, ord)."""
    order = F.struct(-F.col("score"), F.col("round"), F.col("ord"))
    row = F.struct(*(F.col(c) for c in scores.columns))
    return scores.groupBy("statement_id").agg(F.min_by(row, order).alias("_row")).select("_row.*")


def select_curriculum(statements: DataFrame, rates: DataFrame, seed: int, limit: int = 0) -> DataFrame:
    """Unsolved and seldom solved statements, and a few of the rest, shuffled; all for limit <= 0."""
    rated = statements.join(rates.select(F.col("statement_id").alias("id"), "score"), "id", "left")
    rate = F.coalesce("score", F.lit(0.0))
    kept = rated.filter((rate == 0) | (rate < CURRICULUM_RATE) | (uniform(seed, "select", "id") < REPLAY_CHANCE)).drop("score")
    order = [shuffle_key(seed, "shuffle", "id"), "id"]
    return kept.orderBy(*order) if limit <= 0 else first_rows(kept, order, limit)


def unproved(statements: DataFrame, scores: DataFrame) -> DataFrame:
    """Statements (with repeats) that no score proves."""
    return statements.join(scores.filter("successes > 0").select(F.col("statement_id").alias("id")), "id", "left_anti")


def pass_at_k(statements: DataFrame, scores: DataFrame) -> DataFrame:
    """Share of statements with a success; without statements the division raises."""
    solved = scores.filter("successes > 0").agg(F.count(F.lit(1)).alias("solved"))
    total = statements.agg(F.count(F.lit(1)).alias("total"))
    return solved.join(F.broadcast(total)).select("solved", "total", (F.col("solved") / F.col("total")).alias("pass_at_k"))


def pass_percent(scores: DataFrame) -> DataFrame:
    """100 * solved / all, 0 without rows."""
    n, solved = F.count(F.lit(1)), F.count_if(F.col("successes") > 0)
    return scores.agg(F.when(n > 0, 100.0 * solved / n).otherwise(0.0).alias("pass_percent"))


def score_records(attempts: DataFrame) -> DataFrame:
    """Per problem and solver: score, attempts, successes and seconds."""
    per = attempts.groupBy(F.col("statement_id").alias("problem_id"), "solver").agg(
        F.sum("multiplicity").alias("attempts"),
        _proved(F.col("multiplicity")).alias("successes"),
        F.sum("duration_seconds").alias("solver_seconds"),
        F.sum("verify_seconds").alias("verification_seconds"),
    )
    return per.withColumn("score", F.col("successes") / F.col("attempts")).withColumn("total_seconds", F.col("solver_seconds") + F.col("verification_seconds"))


def round_summary(attempts: DataFrame, statements: DataFrame, conjectures: DataFrame) -> DataFrame:
    """One row of counts and sums for a round; solved counts statements with a success."""
    rates = solve_rates(attempts)
    solved = rates.agg(F.count_if(F.col("successes") > 0).alias("solved_statements"))
    spent = attempts.agg(
        F.sum("multiplicity").alias("solver_attempts"), F.sum("generated_tokens").alias("generated_tokens"), F.sum("duration_seconds").alias("solver_seconds"), F.sum("verify_seconds").alias("verification_seconds")
    )
    counts = statements.agg(F.count(F.lit(1)).alias("selected_statements")).join(conjectures.agg(F.count(F.lit(1)).alias("conjectures")))
    return spent.join(solved).join(counts)


def compare_retries(retries: DataFrame, large: DataFrame, expected: int) -> DataFrame:
    """Problems with both: many small attempts against one large one, side by side."""

    def per(df: DataFrame, prefix: str, wanted: int) -> DataFrame:
        n = F.sum("multiplicity")
        checked = F.when(n == wanted, n).otherwise(F.raise_error(F.lit(f"{prefix}: another number of attempts than {wanted}")).cast("long"))
        return df.groupBy(F.col("statement_id").alias("problem_id")).agg(
            checked.alias(f"{prefix}_attempts"), _proved(F.col("multiplicity")).alias(f"{prefix}_successes"), F.sum("duration_seconds").alias(f"{prefix}_solver_seconds"), F.sum("verify_seconds").alias(f"{prefix}_verification_seconds")
        ).withColumn(f"{prefix}_rate", F.col(f"{prefix}_successes") / F.col(f"{prefix}_attempts"))

    return per(retries, "retry", expected).join(per(large, "large", 1), "problem_id")


# Rollouts of the two kinds of search and the methods' names.
RETRY_ROLLOUTS, LARGE_ROLLOUTS = 200, 1024
RETRY_METHOD, LARGE_METHOD = "solve_rate", "alphaproof_hardest_subproblem"


def comparison_records(retries: DataFrame, large: DataFrame, expected: int) -> DataFrame:
    """``compare_retries`` as whole records: methods, rollouts, status, frontier and total seconds too."""
    both = compare_retries(retries, large, expected)
    status = large.select(F.col("statement_id").alias("problem_id"), F.col("status").alias("large_search_status"), *(F.col(c).alias(f"large_search_{c}") for c in ("solved_frontier_nodes", "total_frontier_nodes", "solve_rate")))
    seconds = lambda p, q: [F.col(f"{p}_solver_seconds").alias(f"{q}_solver_seconds"), F.col(f"{p}_verification_seconds").alias(f"{q}_verification_seconds"), (F.col(f"{p}_solver_seconds") + F.col(f"{p}_verification_seconds")).alias(f"{q}_total_seconds")]
    return both.join(status, "problem_id").select(
        "problem_id", F.lit(RETRY_METHOD).alias("retry_method"), F.col("retry_attempts").alias("retry_searches"), F.lit(RETRY_ROLLOUTS).alias("retry_rollouts_per_search"), "retry_successes", F.col("retry_rate").alias("retry_solve_rate"), *seconds("retry", "retry"),
        F.lit(LARGE_METHOD).alias("large_search_method"), F.lit(LARGE_ROLLOUTS).alias("large_search_rollouts"), "large_search_status", "large_search_solved_frontier_nodes", "large_search_total_frontier_nodes", "large_search_solve_rate", *seconds("large", "large_search"),
    )


def round_metrics(summary: DataFrame, inputs: DataFrame, examples: DataFrame) -> DataFrame:
    """A round's summary with the numbers of its inputs and of its training and conjecture examples."""
    counts = examples.agg(F.count(F.lit(1)).alias("training_examples"), F.count_if(F.col("kind") == "conjecture").alias("conjecture_examples"))
    return summary.join(counts).join(inputs.agg(F.count(F.lit(1)).alias("conjecture_inputs")))
