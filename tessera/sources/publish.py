"""Small files and versioned tables on any file system that Spark reaches, safe for several writers.

A table is a folder of data folders and a log of versions. A writer puts its rows into a folder
of its own, reads the newest version and creates the next one; a version is created only if it
is not there, so that of two writers one creates it and the other tries again on top of it.
Readers take the newest version: they see all of an addition or nothing of it.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "_versions"
#: Versions that a writer tries before it gives up.
MOST_TRIES = 1000


def _files(spark: SparkSession, path: str):
    """The Hadoop file context and path of ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    at = hadoop.Path(path)
    at = at.getFileSystem(conf).makeQualified(at)
    return hadoop, hadoop.FileContext.getFileContext(at.toUri(), conf), at


def exists(spark: SparkSession, path: str) -> bool:
    _, files, at = _files(spark, path)
    return files.util().exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    hadoop, files, at = _files(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _beside(spark: SparkSession, path: str, text: str) -> Any:
    """A finished file beside ``path``, to be moved there."""
    hadoop, files, at = _files(spark, path)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    new = hadoop.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    flags = jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE)
    options = gateway.new_array(hadoop.Options.CreateOpts, 1)
    options[0] = hadoop.Options.CreateOpts.createParent()
    out = files.create(new, flags, options)
    try:
        out.write(text.encode())
    finally:
        out.close()
    return new


def _move(spark: SparkSession, new: Any, path: str, over: bool) -> None:
    hadoop, files, at = _files(spark, path)
    kinds = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    kinds[0] = hadoop.Options.Rename.OVERWRITE if over else hadoop.Options.Rename.NONE
    files.rename(new, at, kinds)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces the file as a whole."""
    _move(spark, _beside(spark, path, text), path, True)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Writes the file if there is none, whole; whether it did. One of several writers does."""
    _, files, at = _files(spark, path)
    new = _beside(spark, path, text)
    if at.toUri().getScheme() == "file":  # a rename would replace the file: a link does not
        local = lambda p: p.toUri().getPath()
        try:
            os.link(local(new), local(at))
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(local(new))
    try:
        _move(spark, new, path, False)
        return True
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        files.delete(new, False)
        return False


def versions(spark: SparkSession, root: str) -> list[int]:
    hadoop, files, at = _files(spark, f"{root}/{_LOG}")
    if not files.util().exists(at):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(at)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def newest(spark: SparkSession, root: str) -> tuple[int, dict[str, Any]]:
    """The newest version's number and entry; (-1, no folders) for a table that has none."""
    there = versions(spark, root)
    return (there[-1], json.loads(read_text(spark, f"{root}/{_LOG}/{there[-1]:020d}.json"))) if there else (-1, {"folders": []})


def commit(spark: SparkSession, root: str, change: Callable[[dict[str, Any]], dict[str, Any]]) -> int:
    """Makes the next version from the newest by ``change``, which runs again on a newer one where
    another writer was first; returns its number."""
    for _ in range(MOST_TRIES):
        number, entry = newest(spark, root)
        if create_text(spark, f"{root}/{_LOG}/{number + 1:020d}.json", json.dumps(change(entry), sort_keys=True)):
            return number + 1
    raise RuntimeError(f"no version of {root} after {MOST_TRIES} tries")


def _written(df: DataFrame, root: str) -> str:
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return folder


def append(df: DataFrame, root: str, once: str | None = None) -> int:
    """Adds the rows; those of a name ``once`` are added once, however often that is tried."""
    spark = df.sparkSession
    if once is not None and once in newest(spark, root)[1].get("names", []):
        return newest(spark, root)[0]
    folder = _written(df, root)

    def change(entry: dict[str, Any]) -> dict[str, Any]:
        if once is not None and once in entry.get("names", []):
            return entry
        names = [*entry.get("names", []), once] if once is not None else entry.get("names", [])
        return {"folders": [*entry["folders"], folder], "names": names}

    return commit(spark, root, change)


def overwrite(df: DataFrame, root: str) -> int:
    """The rows in place of all others; what others add meanwhile goes too, as if added before."""
    folder = _written(df, root)
    return commit(df.sparkSession, root, lambda entry: {"folders": [folder], "names": entry.get("names", [])})


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is given."""
    number, entry = newest(spark, root) if version is None else (version, json.loads(read_text(spark, f"{root}/{_LOG}/{version:020d}.json")))
    if not entry["folders"]:
        raise ValueError(f"no rows in {root}")
    return spark.read.parquet(*(f"{root}/{f}" for f in entry["folders"]))


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A hash of the rows as a multiset: equal for equal rows in any order, files and partitions, and
    another where a row is changed, repeated or missing. Each row's digest is cut into eight numbers,
    which are added up (modulo 2 ** 64) by partial sums."""
    columns = sorted(df.columns) if columns is None else list(columns)
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
    row = df.select(*(p.alias(f"p{k}") for k, p in enumerate(parts))).agg(F.count(F.lit(1)), *(F.sum(f"p{k}") for k in range(8))).first()
    import hashlib

    text = ",".join(str(int(v or 0) % (1 << 64)) for v in row) + "|" + ",".join(columns)
    return hashlib.sha256(text.encode()).hexdigest()
