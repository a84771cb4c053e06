"""A persistent table from digests to a value, bucketed and sorted by digest.

Every append writes a generation: one sorted file a bucket, published by a version that
lists the live generations. A version is created only where it is not there, so that an
append which failed leaves no trace and of two writers none is lost: the later one tries
again on top of the other's version. Look-ups are sort-merge joins that read the
generations bucket by bucket: no exchange and no sort stands over them. A generation's
buckets follow from the digests counted; once there are many generations they are merged
into one, dealt anew by the count of all. Everything is DataFrame code.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, fresh_path
from tessera.sources import publish

#: Generations that a look-up reads at most; more are merged into one.
GENERATIONS = 8
#: Digests a bucket holds, about; buckets of an empty or small generation; Spark's own most.
BUCKET_ROWS = 10_000_000
LEAST_BUCKETS, MOST_BUCKETS = 32, 100_000
#: With one file a bucket, the scan's order is the files'.
_SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class DigestStore:
    """digest -> ``value`` under ``path``, which later sessions can open again.

    ``buckets`` fixes the buckets of all generations; such a store keeps the number it was
    made with. Without it each generation's are sized by its rows.
    """

    def __init__(self, spark: SparkSession, value: str, value_type: str = "BIGINT", path: str | None = None, buckets: int | None = None):
        self.spark, self.value, self.value_type = spark, value, value_type
        self.path = path or fresh_path(spark, "digest-store")
        self.buckets = buckets
        spark.conf.set(_SORTED_SCAN, "true")
        if buckets and (names := self.generations()):
            self.buckets = _buckets(names[0])

    def version(self) -> int:
        """The newest version; 0 for an empty store."""
        return publish.newest(self.spark, self.path)[0] + 1

    def generations(self) -> list[str]:
        return sorted(publish.newest(self.spark, self.path)[1]["folders"])

    def _publish(self, names: list[str], version: int) -> bool:
        """Makes ``names`` the live generations as ``version``; whether there was no such version yet."""
        return publish.create_text(self.spark, f"{self.path}/_versions/{version - 1:020d}.json", json.dumps({"folders": names}))

    def _commit(self, change: Callable[[list[str]], list[str]]) -> None:
        """The next version by ``change`` of the live generations, on top of the others' where they were first."""
        for _ in range(publish.MOST_TRIES):
            version = self.version()
            if self._publish(change(self.generations()), version + 1):
                return
        raise RuntimeError(f"no version of {self.path} after {publish.MOST_TRIES} tries")

    def dealt_into(self, rows: int) -> int:
        """Buckets of a generation of so many digests: powers of two, so that generations often share them."""
        wanted = -(-rows // BUCKET_ROWS)
        return min(max(LEAST_BUCKETS, 1 << max(wanted - 1, 0).bit_length()), MOST_BUCKETS)

    def _table(self, name: str) -> DataFrame:
        """A generation with its buckets, named in the catalog only until it is resolved."""
        table = f"digest_generation_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {table} (digest STRING, {self.value} {self.value_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {_buckets(name)} BUCKETS LOCATION '{self.path}/{name}'"
        )
        found = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        return found

    def _write(self, rows: DataFrame, dealt: bool) -> str:
        buckets = self.buckets or self.dealt_into(rows.count())
        name = f"generation-{buckets}-{uuid.uuid4().hex}"
        table = name.replace("-", "_")
        rows = rows.select("digest", self.value)
        rows = rows if dealt else rows.repartition(buckets, "digest")
        rows.write.format("parquet").bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")
        return name

    def read(self) -> DataFrame:
        """All digests, of which two writers may have left one twice."""
        parts = [self._table(name) for name in self.generations()]
        return reduce(DataFrame.unionByName, parts) if parts else self._none()

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], f"digest STRING, {self.value} {self.value_type}")

    def missing(self, keyed: DataFrame) -> DataFrame:
        """The rows of ``keyed`` whose digest the store lacks."""
        dealt = None
        for name in self._by_buckets():
            if _buckets(name) != dealt:
                dealt = _buckets(name)
                keyed = keyed.repartition(dealt, "digest")
            keyed = keyed.join(self._table(name).select("digest").hint("merge"), "digest", "left_anti")
        return keyed

    def look_up(self, keyed: DataFrame) -> DataFrame:
        """``keyed``, of distinct digests, with ``found`` and the store's value (the smallest of any): one
        pass over the store for the digests that it has and those that it lacks."""
        dealt, columns = None, keyed.columns
        found, value = F.lit(False), F.lit(None).cast(self.value_type)
        for k, name in enumerate(self._by_buckets()):
            if _buckets(name) != dealt:
                dealt = _buckets(name)
                keyed = keyed.repartition(dealt, "digest")
            there = self._table(name).select(F.col("digest").alias(f"__digest_{k}"), F.col(self.value).alias(f"__value_{k}"))
            keyed = keyed.join(there.hint("merge"), F.col("digest") == F.col(f"__digest_{k}"), "left")
            found = found | F.col(f"__digest_{k}").isNotNull()
            value = F.least(value, F.col(f"__value_{k}"))
        return keyed.select(*columns, found.alias("found"), value.alias(self.value))

    def known(self, keyed: DataFrame) -> DataFrame:
        """(digest, value) of the distinct digests of ``keyed`` that the store has; the smallest value of any."""
        parts = [keyed.select("digest").repartition(_buckets(name), "digest").join(self._table(name).hint("merge"), "digest") for name in self.generations()]
        if not parts:
            return self._none()
        return reduce(DataFrame.unionByName, parts).groupBy("digest").agg(F.min(self.value).alias(self.value))

    def _by_buckets(self) -> list[str]:
        """The generations, those of one number of buckets side by side, so that a batch is dealt once for them."""
        return sorted(self.generations(), key=lambda name: (_buckets(name), name))

    def append(self, fresh: DataFrame, dealt: bool = False) -> None:
        """Adds rows (digest, value), distinct and not in the store, as a generation; a written table is
        best, as its rows are counted first. ``dealt`` says that an aggregation by digest has partitioned
        them into the store's fixed number of buckets. Beyond ``GENERATIONS`` all are merged into one."""
        if not dealt and fresh.isEmpty():
            return
        name = self._write(fresh, dealt)
        self._commit(lambda names: [*names, name])
        if len(self.generations()) > GENERATIONS:
            self._merge()

    def _merge(self) -> None:
        """One generation in place of those that are live now; none where another writer has merged them
        meanwhile. What others append meanwhile stays beside it."""
        names = set(self.generations())
        rows = reduce(DataFrame.unionByName, [self._table(name) for name in sorted(names)])
        merged = self._write(rows.groupBy("digest").agg(F.min(self.value).alias(self.value)), False)
        self._commit(lambda live: [*(n for n in live if n not in names), merged] if names <= set(live) else live)

    def vacuum(self) -> list[str]:
        """Deletes the generations that the newest version does not list, and names them. Not while
        others write to the store or read an older version."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        live = set(self.generations())
        names = [s.getPath().getName() for s in files.listStatus(hadoop)] if files.exists(hadoop) else []
        gone = [name for name in names if name.startswith("generation-") and name not in live]
        for name in gone:
            drop_stored(self.spark, f"{self.path}/{name}")
        return gone


def _buckets(name: str) -> int:
    return int(name.split("-")[1])
