import pytest
from pyspark.sql import functions as F

from tessera.sources import metrics


def test_a_runs_metrics(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(metrics, "HELD", 8)
    root = f"file://{tmp_path}/metrics"
    log = metrics.MetricsLog(spark, root, "r1", {"seed": 3})
    for step in range(5):
        log.log_training(step, 1.0 / (step + 1), 0.1, 4 * step, 100 * step)
    log.log_validation(4, {"loss": 0.5}, 9)
    log.log_epoch(4, 1, {"loss": 0.4}, {"loss": 0.6}, 11)
    log.finish(0)
    other = metrics.MetricsLog(spark, root, "r2")
    other.log_steps(spark.createDataFrame([(1, 0.5, None), (2, None, 3)], "step LONG, loss DOUBLE, n INT"))
    table = {r["step"]: (r["train/loss"], r["train/examples_seen"]) for r in metrics.metric_table(spark, root, "r1", ["train/loss", "train/examples_seen"]).collect()}
    assert table == {k: (1.0 / (k + 1), 4.0 * k) for k in range(5)}
    names = {r["name"] for r in metrics.metric_rows(spark, root, "r1").collect()}
    assert {"validation/loss", "validation/samples", "train/epoch", "train/epoch_loss", "exit_code"} <= names
    assert sorted((r["step"], r["name"], r["value"]) for r in metrics.metric_rows(spark, root, "r2").collect()) == [(1, "train/loss", 0.5), (2, "train/n", 3.0)]
    with pytest.raises(ValueError, match="r1 is there"):
        metrics.MetricsLog(spark, root, "r1")


def test_one_pass_writes_and_observes(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(100).mapInArrow(counted, "id LONG")
    seen = metrics.write_observed(rows, str(tmp_path / "out"), {"n": F.count(F.lit(1)), "most": F.max("id")})
    assert seen == {"n": 100, "most": 99} and read.value == 100 and spark.read.parquet(str(tmp_path / "out")).count() == 100
