"""Sharding through fixed virtual slots.

Records hash into thousands of slots that never change. Bytes are summed per slot, a
slot-to-shard map is made from the sums and stored under a version; later batches and
other numbers of shards edit the newest map (move slots) and store the next version, so
records move only with slots.
The map has ``n_slots`` rows whatever the input, which is what the driver handles and
what is broadcast. The law held is ``bytes``: the shards' sizes are near equal.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, stored, whole_text

N_SLOTS = 8192
#: Bytes that each record costs besides its text.
RECORD_BYTES = 16


def slot_of(id_col: str, text_col: str, n_slots: int) -> Column:
    """By id and text, so that texts that share an id are spread; records without an id by their place too."""
    text = whole_text(text_col)
    own = F.when(F.col(id_col).isNull(), F.xxhash64(text, F.monotonically_increasing_id())).otherwise(F.xxhash64(F.col(id_col), text))
    return F.pmod(own, F.lit(n_slots)).cast("int")


class SlotMap:
    """Versions of the map: ``<path>/version=<n>`` holds (virtual_slot, shard)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "slot-map")

    def write(self, version: int, owner: dict[int, int]) -> DataFrame:
        rows = self.spark.createDataFrame(sorted(owner.items()), "virtual_slot INT, shard INT")
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")
        return self.read(version)

    def newest(self) -> int | None:
        """The last version that was written whole, None without any."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = hadoop(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(hadoop(self.path)):
            return None
        names = [s.getPath().getName() for s in files.listStatus(hadoop(self.path))]
        return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=") and files.exists(hadoop(f"{self.path}/{n}/_SUCCESS"))), default=None)

    def owners(self, version: int) -> dict[int, int]:
        return {r["virtual_slot"]: r["shard"] for r in self.read(version).collect()}

    def rebalance(self, bytes_of: dict[int, int], n_slots: int, n_shards: int) -> DataFrame:
        """The first map, or the newest one edited for these sums, as the next version."""
        version = self.newest()
        if version is None:
            return self.write(0, balanced(bytes_of, n_slots, n_shards))
        owner = self.owners(version)
        if len(owner) != n_slots:
            raise ValueError(f"the stored map has {len(owner)} slots")
        return self.write(version + 1, rebalanced(owner, bytes_of, n_shards))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.schema("virtual_slot INT, shard INT").parquet(f"{self.path}/version={version}")


def slot_bytes(sized: DataFrame) -> dict[int, int]:
    """Bytes per slot: at most ``n_slots`` rows come to the driver."""
    return {r[0]: r[1] for r in sized.groupBy("virtual_slot").agg(F.sum("size")).collect()}


def balanced(bytes_of: dict[int, int], n_slots: int, n_shards: int) -> dict[int, int]:
    """Largest slot first, each to the lightest shard; empty slots go round."""
    heap = [(0, k) for k in range(n_shards)]
    owner = {}
    for slot in sorted(range(n_slots), key=lambda s: (-bytes_of.get(s, 0), s)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + bytes_of.get(slot, 0), shard))
    return owner


def rebalanced(owner: dict[int, int], bytes_of: dict[int, int], n_shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """The map edited for new sums or another number of shards: slots leave overfull shards, and
    those of shards that are no more go to the lightest ones, the largest first."""
    owner = dict(owner)
    homeless = sorted((s for s, shard in owner.items() if shard >= n_shards), key=lambda s: (-bytes_of.get(s, 0), s))
    heap = [(sum(bytes_of.get(s, 0) for s, own in owner.items() if own == k), k) for k in range(n_shards)] if homeless else []
    heapq.heapify(heap)
    for slot in homeless:
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + bytes_of.get(slot, 0), shard))
    loads, held = [0] * n_shards, [[] for _ in range(n_shards)]
    for slot, shard in owner.items():
        loads[shard] += bytes_of.get(slot, 0)
        held[shard].append(slot)
    mean = sum(loads) / n_shards
    for _ in range(len(owner)):
        high, low = max(range(n_shards), key=lambda k: (loads[k], -k)), min(range(n_shards), key=lambda k: (loads[k], k))
        gap = loads[high] - loads[low]
        if loads[high] <= mean * (1 + tolerance) and loads[low] >= mean * (1 - tolerance):
            break
        fit = [s for s in held[high] if 0 < bytes_of.get(s, 0) < gap]
        if not fit:
            break
        slot = min(fit, key=lambda s: (abs(bytes_of[s] - gap / 2), s))
        held[high].remove(slot)
        held[low].append(slot)
        owner[slot] = low
        loads[high] -= bytes_of[slot]
        loads[low] += bytes_of[slot]
    return owner


def assign(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, store: SlotMap | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each record's shard and its place there: id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16; ``slot`` numbers a shard's
    records from 0 without gaps, by virtual slot, then id, then checksum (rows equal in
    all of these are alike, so which is first makes no difference). A record's virtual
    slot hangs on its id and text; without an id, on its place too, so that many of them
    are spread. Texts are hashed whole, however long. ``store`` names a map that earlier
    batches left; its newest version is edited for this batch and stored as the next.
    ``grown_shard`` is null under this law. Columns of other names are not read, whatever
    they are. An empty table gives no rows.
    """
    store = store or SlotMap(docs.sparkSession)
    sized = stored(
        docs.select(
            F.col(id_col),
            (F.octet_length(whole_text(text_col)).cast("long") + RECORD_BYTES).alias("size"),
            F.crc32(whole_text(text_col)).alias("text_crc32"),
            slot_of(id_col, text_col, n_slots).alias("virtual_slot"),
        ),
        "sized",
    )
    owner = store.rebalance(slot_bytes(sized), n_slots, n_shards)
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = sized.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    # n_slots rows at most, so the running sum within a shard is small and the join can broadcast
    placed = counts.join(F.broadcast(owner), "virtual_slot").withColumn("before", F.coalesce(F.sum("n").over(in_shard), F.lit(0)))
    in_slot = Window.partitionBy("virtual_slot").orderBy(id_col, "text_crc32", "size")
    return (
        sized.withColumn("place", F.row_number().over(in_slot) - 1)
        .join(F.broadcast(placed.drop("n")), "virtual_slot")
        .select(
            F.col(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
        )
    )


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
