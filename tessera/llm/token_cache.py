"""Token counts through a digest cache.

The key of a text is the SHA-256 of the tokenizer's own digest and the text; for a
tokenizer that reads each run of white space as one space and then drops it, the text
has its runs as one space too, so that more texts share a count. Keys join to the counts
stored before; of the keys that miss, each distinct text is encoded once, and its count
is appended to the cache, which is bucketed and sorted by key.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chunks import drops_white_space
from tessera.llm.common import one_space, ship, stored, whole_text
from tessera.llm.digest_store import DigestStore


def tokenizer_digest(path: str) -> str:
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def count_cache(spark: SparkSession, path: str | None = None, buckets: int | None = None) -> DigestStore:
    """digest -> n_tokens."""
    return DigestStore(spark, "n_tokens", "BIGINT", path, buckets)


def _joins_white_space(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        return drops_white_space(json.load(f))


def _counter(path: str):
    def count(batches):
        import pyarrow as pa

        from tessera.llm.chunks import encoder, small_batches

        coder = encoder(path)
        for batch in small_batches(batches):
            _, ends = coder.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(np.diff(ends), pa.int64())], names=["digest", "n_tokens"])

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: DigestStore | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit, cached (whether the
    count was stored before).

    Null texts count as empty, with 0 bytes and 0 tokens. Nothing is truncated, however
    long. Ids may be null or repeat; they are only carried. Columns of other names are
    not read, whatever they are. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    cache = cache or count_cache(spark)
    version = tokenizer_digest(tokenizer_path)
    text = whole_text(text_col)
    if _joins_white_space(tokenizer_path):
        text = one_space(text)
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"),
        F.sha2(F.concat(F.lit(f"{version} "), text), 256).alias("digest"),
        text.alias("text"),
    )
    digests = stored(keyed.drop("text"), "count-digests")
    distinct = stored(digests.select("digest").distinct(), "distinct-digests")
    looked = stored(cache.look_up(distinct), "looked-up-digests")
    missing = looked.filter("NOT found").select("digest")
    # copies meet before the shuffle; each digest's text is encoded by one task
    texts = keyed.select("digest", "text").dropDuplicates(["digest"]).join(missing.hint("merge"), "digest", "left_semi")
    fresh = stored(texts.select("digest", "text").mapInArrow(_counter(tokenizer_path), "digest STRING, n_tokens BIGINT"), "fresh-counts")
    old = looked.filter("found").select("digest", "n_tokens", F.lit(True).alias("cached"))
    counts = stored(old.unionByName(fresh.withColumn("cached", F.lit(False))), "counts")
    cache.append(fresh)
    return digests.join(counts.hint("merge"), "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cached"
    )


def op4_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two batches, so that the second meets the counts of the first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokenizer, cache = public_tokenizers.path("word_bpe_49k.json"), count_cache(spark)
    middle = F.lit(docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0])
    first = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    return stored(count_tokens(docs.filter(first), tokenizer, cache), "batch").unionByName(count_tokens(docs.filter(~first), tokenizer, cache))
