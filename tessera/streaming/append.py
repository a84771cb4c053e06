"""Stateful forms of the incremental operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.relation import first_wins


def insert_if_absent(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Appends to the table at ``path`` the rows whose key it lacks, the first of equal keys in a
    batch. Each batch's rows are found by an anti-join with the table and carry the batch's number,
    so a batch that is run again after a crash adds nothing twice."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        fresh = first_wins(rows, list(keys), list(order))
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
            fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
        fresh.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_best(scores: DataFrame) -> DataFrame:
    """The greatest score so far of each statement, for update mode."""
    return scores.groupBy("statement_id").agg(F.max("score").alias("score"))


def distinct_keys(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """The first row of each key; state older than ``late`` is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
