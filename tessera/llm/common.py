"""What the corpus operators share: scratch tables, shipping of the package, text helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()

#: Bytes of an Arrow batch to or from a Python worker.
ARROW_BYTES = 8 << 20

#: The white space that the operators' contracts name: space, tab, line feed, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only on a single machine, where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        shared = f"file://{tempfile.gettempdir()}/tessera-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts the lineage there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once for each application."""
    # texts may be long: batches for the workers are cut by bytes as well as by rows
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="tessera-")) / "tessera_pkg.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted((root / "tessera").rglob("*.py")):
            out.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def one_space(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, f"{SPACE}+", " ")


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of the highest counts, ``most`` at most: all with as many occurrences as the last of
    them or more, by counts of counts in steps of an eighth of a power of two."""
    step = F.floor(F.log2(n) * 8)
    left, least = most, None
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0:
            break
        least = row["step"]
    return counts.limit(0) if least is None else counts.filter(step >= least)
