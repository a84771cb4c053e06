"""Supervised examples from source files with spans, and their split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import repository_path, span, strip

VALIDATION_SHARE = 0.1


def file_split(df: DataFrame, total: int, ord_col: str = "ord") -> DataFrame:
    """The last tenth of the files (rounded down) is for validation."""
    return df.withColumn("split", F.when(F.col(ord_col) >= total - int(total * VALIDATION_SHARE), "validation").otherwise("train"))


def outer_block(theorem: Column, source: Column) -> Column:
    """The one by-block that proves the whole theorem: its tree has nodes and no error, the text
    before it ends in ``:= by``, and only white space follows it. Several raise; null without one."""
    start, finish = theorem["span"]["start"], theorem["span"]["finish"]

    def fits(b: Column) -> Column:
        before = span(source, start, b["span"]["start"])
        after = span(source, b["span"]["finish"], finish)
        tree = b["tree"].isNotNull() & b["tree"]["error"].isNull() & (F.coalesce(F.size(b["tree"]["nodes"]), F.lit(0)) > 0)
        return b["span"].isNotNull() & tree & strip(before).endswith(":= by") & (strip(after) == "")

    found = F.filter(theorem["by_blocks"], fits)
    return F.when(F.size(found) > 1, F.raise_error(F.lit("several outer proof blocks")).cast("string")).otherwise(F.lit("")), F.try_element_at(found, F.lit(1))


def theorem_examples(files: DataFrame) -> DataFrame:
    """Of (path, source, theorems): formal_statement, proof, header, source path. Theorems with an
    error, without a span or with ``sorry`` or ``admit`` in their proof give none."""
    each = files.select("path", F.col("source").alias("_text"), F.posexplode("theorems").alias("ord", "t")).filter("t.error IS NULL AND t.span IS NOT NULL")
    check, block = outer_block(F.col("t"), F.col("_text"))
    chosen = each.withColumn("_block", block).withColumn("_check", check).filter("_block IS NOT NULL AND _check = ''")
    start, cut, end = F.col("t.span.start"), F.col("_block.span.start"), F.col("_block.span.finish")
    out = chosen.select(
        strip(span(F.col("_text"), start, cut)).alias("formal_statement"),
        F.regexp_replace(span(F.col("_text"), cut, end), r"(?U)\s+$", "").alias("proof"),
        span(F.col("_text"), F.lit(0), start).alias("header"),
        repository_path(F.col("path")).alias("source"),
        "ord",
    )
    return out.filter(~F.col("proof").contains("sorry") & ~F.col("proof").contains("admit"))


def write_splits(examples: DataFrame, path: str) -> None:
    """A folder for each split; an existing one raises."""
    examples.write.partitionBy("split").mode("errorifexists").parquet(path)
