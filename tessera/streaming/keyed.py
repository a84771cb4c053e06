"""Keyed state on Structured Streaming: what is known of a key lives in the state store, and a restart
goes on from the checkpoint without reading the sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on executors' disks, for streams started from now on in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _FirstRow(StatefulProcessor):
    """A key's first row by ``order`` of the batch that the key comes in first; nothing of it later."""

    def __init__(self, order: list[str], expiry: int | None):
        self.order, self.expiry = order, expiry

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "here BOOLEAN", self.expiry)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        first = None
        for part in rows:
            both = part if first is None else pd.concat([first, part])
            first = both.sort_values(self.order, kind="stable").head(1)
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_rows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], expiry_ms: int | None = None) -> DataFrame:
    """The rows whose key was not seen before, the first by ``order`` of equal ones in a batch. A key
    that was not seen for ``expiry_ms`` (of processing time) is forgotten; without it none is."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(*keys).transformWithStateInPandas(_FirstRow(list(order), expiry_ms), stream.schema, "Append", "ProcessingTime" if expiry_ms else "None")


def insert_if_absent(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, expiry_ms: int | None = None, **trigger) -> StreamingQuery:
    """Appends to the table at ``path`` the rows whose key it lacks. The state store knows the keys: no
    batch reads the table, and the sink's own log keeps a batch that is run again from adding twice."""
    fresh = first_rows(stream, keys, order, expiry_ms)
    return fresh.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def best_rows(scores: DataFrame, keys: Sequence[str], score: str, order: Sequence[str] = ()) -> DataFrame:
    """Each key's whole row of the greatest score so far, of equal ones the first by ``order``; for update
    mode, which sends a key's row again when it came up in a batch."""
    row = F.struct(*(c for c in scores.columns if c not in keys))
    rank = F.struct(F.col(score).isNull(), -F.col(score), *order)
    return scores.groupBy(*keys).agg(F.min_by(row, rank).alias("_row")).select(*keys, "_row.*")


def totals(steps: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Each key's rows and sums so far; for update mode, resumable from its checkpoint."""
    return steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(c) for c in sums))


def into_table(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the newest row of each key of a stream in update mode: every batch is a folder of its own
    under ``path``, named by its number, so that a batch run again replaces itself; ``newest`` reads them."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/part={number}")

    return stream.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    rows = spark.read.parquet(path).drop("part")
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row")).select(*keys, "_row.*")
