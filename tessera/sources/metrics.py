"""Metrics: observed in the pass that writes a table, and kept in a versioned table of their own."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.sources import publish

_ROW = "run_id STRING, step BIGINT, name STRING, value DOUBLE"
#: Rows that a log holds back before it adds them to its table.
HELD = 1000


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column]) -> dict[str, Any]:
    """Writes ``df`` and returns the aggregates ``metrics`` of its rows, from the one pass that writes."""
    seen = Observation()
    df.observe(seen, *(c.alias(k) for k, c in metrics.items())).write.parquet(path)
    return seen.get


def step_rows(steps: DataFrame, run_id: str, prefix: str = "train", step: str = "step") -> DataFrame:
    """A row (run_id, step, name, value) for each metric of a table of steps; nulls give none."""
    names = [c for c in steps.columns if c != step]
    each = F.explode(F.array(*(F.struct(F.lit(f"{prefix}/{c}").alias("name"), F.col(c).cast("double").alias("value")) for c in names))).alias("m")
    return steps.select(F.lit(run_id).alias("run_id"), F.col(step).cast("long").alias("step"), each).select("run_id", "step", "m.name", "m.value").filter("value IS NOT NULL")


class MetricsLog:
    """A training run's metrics by step, in the table at ``root`` that all runs share.

    A run's name is used once: a second run of it raises. Rows are added in batches; what is logged
    shows after ``flush``, a validation, an epoch or ``finish``."""

    def __init__(self, spark: SparkSession, root: str, run_id: str, config: dict[str, Any] | None = None):
        self.spark, self.root, self.run_id, self.held = spark, root, run_id, []
        if not publish.create_text(spark, f"{root}/runs/{run_id}.json", json.dumps(config or {}, sort_keys=True)):
            raise ValueError(f"a run named {run_id} is there")

    # The names under which metrics are known.
    def log_training(self, step: int, loss: float, learning_rate: float, examples_seen: int, target_tokens_seen: int) -> None:
        self._log(step, {"train/loss": loss, "train/learning_rate": learning_rate, "train/examples_seen": examples_seen, "train/target_tokens_seen": target_tokens_seen})

    def log_validation(self, step: int, metrics: dict[str, float], samples: int) -> None:
        self._log(step, {**{f"validation/{k}": v for k, v in metrics.items()}, "validation/samples": samples})
        self.flush()

    def log_epoch(self, step: int, epoch: int, training: dict[str, float], validation: dict[str, float], samples: int) -> None:
        self._log(step, {"train/epoch": epoch, **{f"train/epoch_{k}": v for k, v in training.items()}})
        self.log_validation(step, validation, samples)

    def log_steps(self, steps: DataFrame, prefix: str = "train") -> None:
        """All steps of a table at once."""
        publish.append(step_rows(steps, self.run_id, prefix), self.root)

    def _log(self, step: int, values: dict[str, float]) -> None:
        self.held += [(self.run_id, step, k, float(v)) for k, v in values.items()]
        if len(self.held) >= HELD:
            self.flush()

    def flush(self) -> None:
        if self.held:
            publish.append(self.spark.createDataFrame(self.held, _ROW).coalesce(1), self.root)
            self.held = []

    def finish(self, exit_code: int) -> None:
        self._log(-1, {"exit_code": exit_code})
        self.flush()


def metric_rows(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    rows = publish.read(spark, root)
    return rows if run_id is None else rows.filter(F.col("run_id") == run_id)


def metric_table(spark: SparkSession, root: str, run_id: str, names: list[str]) -> DataFrame:
    """A run's steps with a column for each of ``names``."""
    rows = metric_rows(spark, root, run_id).filter(F.col("name").isin(names))
    return rows.groupBy("step").agg(*(F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names))
