"""Resumable evaluation: what is done, what is missing, and results by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.relation import insert_if_absent, last_wins, require_domain, require_fk, require_unique

# Budgets and the solvers' names in records.
BUDGETS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048)
SOLVERS = ("llm", "alphaproof")


def nested_results(attempts: DataFrame, by: str = "problem_id") -> DataFrame:
    """One row per problem with its attempts in order."""
    fields = [c for c in attempts.columns if c not in (by, "ord")]
    return attempts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", *fields))), lambda a: F.struct(*(a[f].alias(f) for f in fields))).alias("attempts"))


def unnested_results(results: DataFrame, by: str = "problem_id") -> DataFrame:
    """A row for each saved attempt, in order (ord)."""
    return results.select(by, F.posexplode("attempts").alias("ord", "a")).select(by, "ord", "a.*")


def completed(results: DataFrame, problems: DataFrame) -> DataFrame:
    """Results by problem: each problem known, none twice."""
    return require_unique(require_fk(results, ["problem_id"], problems), ["problem_id"])


def remaining(problems: DataFrame, results: DataFrame) -> DataFrame:
    return insert_if_absent(problems, results, ["problem_id"])


def missing_scores(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Results whose (problem, solver) has no score yet."""
    checked = require_domain(scores, "solver", SOLVERS)
    return insert_if_absent(results, checked, ["problem_id", "solver"])


def budget_sweep(problems: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    return problems.select("*", F.explode(F.array(*map(F.lit, budgets))).alias("simulations"))


def split_requests(requests: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    return requests.filter(F.col("attempt") < first), requests.filter(F.col("attempt") >= first)


def overlay_verified(attempts: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified rows (the last of a request) replace attempts of the same request; others stay."""
    verified = last_wins(verified, ["request_id"], ["ord"] if "ord" in verified.columns else [c for c in verified.columns if c != "request_id"])
    new = verified.select("request_id", F.struct(*(c for c in attempts.columns if c != "request_id")).alias("_new"))
    joined = attempts.join(new, "request_id", "left")
    return joined.select(*(F.col(c) if c == "request_id" else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in attempts.columns))


def join_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Each request with its last result; a request without one raises."""
    last = last_wins(results, ["request_id"], ["ord"]).drop("ord").withColumn("_matched", F.lit(True))
    joined = requests.join(last, "request_id", "left")
    return joined.filter(F.coalesce("_matched", F.raise_error(F.concat(F.lit("no result for "), "request_id")).cast("boolean"))).drop("_matched")


def zip_strict(left: DataFrame, right: DataFrame) -> DataFrame:
    """By position (ord); a position that one side lacks raises."""
    if left.count() != right.count():
        raise ValueError("the sides have different lengths")
    joined = left.withColumn("_left", F.lit(True)).join(right.withColumn("_right", F.lit(True)), "ord", "full")
    both = F.coalesce(F.col("_left") & F.col("_right"), F.raise_error(F.lit("the sides have different positions")).cast("boolean"))
    return joined.filter(both).drop("_left", "_right")


def resumed(rows: DataFrame, done: int) -> DataFrame:
    """What is left after the first ``done`` positions."""
    return rows.filter(F.col("ord") >= done)


def single_results(results: DataFrame, by: str = "problem_id") -> DataFrame:
    """Results that hold one attempt each, in the shape of unnested ones."""
    return results.select(by, F.lit(0).alias("ord"), "attempt.*")


def plot_rows(scores: DataFrame, budget: str = "simulations") -> DataFrame:
    """Mean score per budget with the budget's binary logarithm, in its order."""
    per = scores.groupBy(budget).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("problems"))
    return per.withColumn("log2_budget", F.log2(budget)).orderBy(budget)


def per_split(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
