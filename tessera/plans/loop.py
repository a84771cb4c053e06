"""One round of self-play over partitioned Parquet: each phase is written once and read back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.conjectures import conjecture_inputs, generation_prompts, parsed_conjectures, proof_requests
from tessera.operators.examples import conjecturer_examples, dedup_examples, filter_conjectures, match_conjecturer_examples, prover_examples, require_some
from tessera.operators.scan import numbered
from tessera.operators.scoring import assess, best_of_history, round_metrics, round_summary, select_curriculum, unproved
from tessera.plans.providers import Provider, solve, with_hooks
from tessera.sources.records import checkpointed, completed, round_pool


@dataclass(frozen=True)
class Settings:
    seed: int = 0
    statements_per_round: int = 0
    attempts: int = 4
    samples: int = 1
    trivial_chance: float = 0.2
    cap_fraction: float = 0.1
    threshold: float = 0.5
    trivial_ratio: float = 0.5
    trivial_least: int = 1
    elegance: float = 0.2
    capacity: float = 3.0
    replay_rounds: int = 1


_SCORE = "statement_id STRING, method STRING, score DOUBLE, attempts BIGINT, successes BIGINT, round INT, ord BIGINT"
_ATTEMPT = "request_id STRING, statement_id STRING, status STRING, proof STRING, invoked_lemmas ARRAY<STRING>, ord BIGINT"


def best_state(spark: SparkSession, root: str, before: int) -> DataFrame:
    """The best score of each statement over the rounds before ``before`` that were scored, as
    ``best_of_history`` gives it. Each round's state is written down: a round reads the state of the one
    before and its own scores, not all rounds. Rounds without complete scores are passed over."""
    if before <= 0:
        return spark.createDataFrame([], _SCORE)
    last = before - 1
    if not completed(spark, f"{root}/round={last:03d}/assessments"):
        return best_state(spark, root, last)

    def merged() -> DataFrame:
        new = spark.read.parquet(f"{root}/round={last:03d}/assessments").select("statement_id", "method", "score", "attempts", "successes", F.lit(last).alias("round"), F.lit(0).cast("long").alias("ord"))
        return best_of_history(best_state(spark, root, last).unionByName(new))

    return checkpointed(spark, root, "best", last, merged)


def run_round(spark: SparkSession, root: str, index: int, statements: DataFrame, declarations: DataFrame, settings: Settings, conjecturer: Provider, prover: Provider, verifier: Provider, sft: DataFrame | None = None, embed: Provider | None = None, hooks: tuple[Provider, ...] = (), train: Provider | None = None) -> dict[str, DataFrame]:
    """Select, conjecture, attempt, score and build examples. Phases that a former run completed are
    read, not run again; earlier rounds are read through their folders. ``sft``: supervised examples
    besides; ``embed`` adds a vector to rows with a text, by which conjecture examples are matched
    to the statements that no round has proved (without it they keep their weights); ``train`` gets the
    examples and gives rows of metrics, and is never run without examples: that raises."""
    rates = best_state(spark, root, index).drop("ord", "round")
    phase = lambda r, name: spark.read.parquet(f"{root}/round={r:03d}/{name}")

    selected = checkpointed(spark, root, "selected", index, lambda: numbered(select_curriculum(statements, rates, settings.seed + index, settings.statements_per_round), ["id"]))

    def inputs() -> DataFrame:
        old = spark.createDataFrame([], _ATTEMPT)
        for r in range(index):
            if completed(spark, f"{root}/round={r:03d}/solve_attempts"):
                old = old.unionByName(phase(r, "solve_attempts").select(*old.columns))
        wanted = unproved(selected, rates).count()
        made = conjecture_inputs(old, statements, rates, declarations, wanted, settings.trivial_chance, settings.cap_fraction, settings.seed + index)
        return numbered(made, ["generation_seed"])

    seeds = checkpointed(spark, root, "conjecture_inputs", index, inputs)
    made = checkpointed(
        spark, root, "conjectures", index,
        lambda: numbered(parsed_conjectures(conjecturer(generation_prompts(seeds, settings.samples)).select(F.col("id").alias("conjecture_input_id"), "text", "ord"), seeds, statements.select("id"), seed=settings.seed), ["id"]),
    )
    made = with_hooks(made, *hooks)
    pool = numbered(round_pool(selected, made), ["source", "id"])
    requests = checkpointed(spark, root, "proof_requests", index, lambda: proof_requests(pool, settings.attempts, settings.seed))
    attempts = checkpointed(spark, root, "solve_attempts", index, lambda: solve(requests, prover, verifier))
    scores = checkpointed(spark, root, "assessments", index, lambda: assess(attempts.withColumn("solve_rate", F.lit(None).cast("double"))))
    filtered = checkpointed(
        spark, root, "conjecture_filter_metrics", index,
        lambda: filter_conjectures(made, attempts, scores, settings.threshold, settings.trivial_ratio, settings.trivial_least, settings.elegance, settings.seed),
    )
    def training() -> DataFrame:
        parts = []
        for r in range(max(0, index - settings.replay_rounds + 1), index):
            if completed(spark, f"{root}/round={r:03d}/assessments"):
                of = round_pool(phase(r, "selected"), phase(r, "conjectures")).select("id", "statement", "header", "ord")
                parts.append(prover_examples(phase(r, "solve_attempts"), of, phase(r, "assessments"), settings.threshold, r))
        replay = dedup_examples([*parts, prover_examples(attempts, pool.select("id", "statement", "header", "ord"), scores, settings.threshold, index)])
        ideas = conjecturer_examples(filtered, index)
        if embed is not None:
            left = unproved(unproved(statements, scores), rates)
            # targets are served in the statements' order
            targets = embed(numbered(left, ["ord", "id"], name="place").select(F.col("place").alias("id"), F.col("statement").alias("text"), F.col("matching_weight").alias("weight")))
            ideas = match_conjecturer_examples(ideas, embed(ideas.select("ord", F.col("target").alias("text"))), targets, settings.capacity)
        return dedup_examples([*([sft] if sft is not None else []), replay, ideas])

    examples = checkpointed(spark, root, "training_examples", index, training)
    trained = checkpointed(spark, root, "training_metrics", index, lambda: train(require_some(examples))) if train is not None else None
    return {"selected": selected, "conjecture_inputs": seeds, "conjectures": made, "attempts": attempts, "scores": scores, "filtered": filtered, "examples": examples, **({"training_metrics": trained} if trained is not None else {}), "summary": round_metrics(round_summary(attempts, selected, made), seeds, examples)}
