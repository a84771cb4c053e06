"""Exact deduplication against a persistent digest index.

The index is bucketed and sorted by digest. A batch is hashed and its digests are grouped
with partial aggregation; a sort-merge anti-join against the index, read bucket by bucket
without exchange or sort, decides which digests are new. They are appended, and of their
texts the smallest id stays. Everything is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import one_space, stored, whole_text
from tessera.llm.digest_store import DigestStore


def digest_index(spark: SparkSession, path: str | None = None, id_type: str = "BIGINT", buckets: int | None = None) -> DigestStore:
    """digest -> the id that stays."""
    return DigestStore(spark, "keep_id", id_type, path, buckets)


def deduplicate(docs: DataFrame, index: DigestStore | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space;
    null counts as empty, and texts are hashed whole, however long. Of equal texts in a
    batch the smallest id stays, unless the index already names an id from an earlier
    batch. ``group_size`` counts this batch. Rows that repeat an id together with its
    text count in ``group_size`` and share its decision. A null id never stays while its
    group has another id; in a group of null ids only, ``keep_id`` is null and the rows
    stay. Columns of other names are not read, whatever they are. An empty table gives none.
    """
    spark = docs.sparkSession
    index = index or digest_index(spark, id_type=dict(docs.dtypes)[id_col])
    hashed = stored(docs.select(F.col(id_col).alias("id"), F.sha2(one_space(whole_text(text_col)), 256).alias("digest")), "digests")
    groups = stored(hashed.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    fresh = stored(index.missing(groups), "fresh-digests").withColumn("new", F.lit(True))
    old = groups.join(fresh.select("digest").hint("merge"), "digest", "left_anti").select("digest", "group_size")
    named = old.join(index.known(old).hint("merge"), "digest").select("digest", "keep_id", "group_size", F.lit(False).alias("new"))
    decided = stored(fresh.unionByName(named), "decided-digests")
    index.append(fresh)
    return hashed.join(decided.hint("merge"), "digest").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("new") & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op6_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches, the smaller ids first, so that the second meets a filled index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index = digest_index(spark)
    middle = F.lit(docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0])
    first = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    both = stored(deduplicate(docs.filter(first), index), "batch").unionByName(stored(deduplicate(docs.filter(~first), index), "batch"))
    sizes = both.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size"))
    return both.drop("group_size").join(stored(sizes, "group-sizes").hint("merge"), "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
