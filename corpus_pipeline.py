"""Corpus pipeline: from raw documents to token ids, in stages written and read as Parquet.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last return
the columns of ``docs`` for the rows that stay. A document is what an id names: a
rejected id's rows all go, except that of equal rows (id and text) one stays. Rows
without an id cannot be named and stay, apart from equal ones. Columns beside ``doc_id``
and ``text`` are carried whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode
from tessera.llm.common import fresh_path, one_space, whole_text
from tessera.llm.decontamination import contamination
from tessera.llm.exact_dedup import deduplicate
from tessera.llm.ngram_join import jaccard_components
from tessera.llm.quality import resample

_KEY = "__pipeline_text_sha256"


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    return docs.join(rejected.select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    scored = resample(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.filter("NOT kept"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id, once."""
    kept = deduplicate(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("__pipeline_id"), F.col("text_sha256").alias(_KEY)).distinct()
    keyed = docs.withColumn(_KEY, F.sha2(one_space(whole_text("text")), 256))
    same = keyed["doc_id"].eqNullSafe(kept["__pipeline_id"]) & (keyed[_KEY] == kept[_KEY])
    return keyed.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", _KEY]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.75 or more: the smallest id."""
    linked = jaccard_components(docs.select("doc_id", "text"))
    return _without(docs, linked.filter("doc_id <> component_id"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return _without(docs, contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of the whole texts."""
    encoded = encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode_texts),
]

#: The near copies' components, the fitted models and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
