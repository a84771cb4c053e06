"""Ordered JSON and JSON Lines in and out, statement data sets, checkpoints and manifests."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import canonical_statement, dataset_labels, sorry_form, stable_id
from tessera.operators.relation import last_wins
from tessera.operators.scan import numbered
from tessera.sources import publish

ARTIFACT_SCHEMA = 2
STATEMENT_RECORD = "formal_statement STRING, header STRING, split STRING, tags ARRAY<STRING>"
SFT_RECORD = "prompt STRING, target STRING, formal_statement STRING, proof STRING, header STRING, weight DOUBLE"
DECLARATION = "full_name STRING, statement STRING"


#: Bits of a row's number within its task in ``monotonically_increasing_id``; the task's stand above.
_ROW_BITS = 33


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows just read from files with ``ord``: by file name, then place in the file. Spark packs
    files into tasks by size, so that a row's number alone follows no order of files: rows are named
    by the number of their (file, task) pair, then by their number in the task. Where files times tasks
    are more than the bits above a row's number can name, the pairs that there are get numbers, by a
    pass over the files."""
    spark, files = rows.sparkSession, sorted(rows.inputFiles())
    place = F.monotonically_increasing_id()
    if len(files) < 2:
        return rows.withColumn("ord", place)
    bare = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    numbers = spark.createDataFrame(list(enumerate(files)), "_number BIGINT, _file STRING").select("_number", bare(F.col("_file")).alias("_file"))
    placed = rows.select("*", place.alias("_place"), bare(F.col("_metadata.file_path")).alias("_file")).join(F.broadcast(numbers), "_file", "left")
    number = F.coalesce("_number", F.raise_error(F.concat(F.lit("a file without a number: "), "_file")).cast("bigint"))
    placed = placed.withColumn("_number", number).withColumn("_task", F.shiftright("_place", _ROW_BITS))
    tasks = rows.rdd.getNumPartitions()
    if len(files) * tasks < 1 << (63 - _ROW_BITS):
        pair = F.col("_number") * tasks + F.when(F.col("_task") < tasks, F.col("_task")).otherwise(F.raise_error(F.lit("a task without a number")).cast("bigint"))
    else:
        there = numbered(placed.select("_number", "_task").distinct(), ["_number", "_task"], name="_pair")
        placed, pair = placed.join(F.broadcast(there), ["_number", "_task"]), F.col("_pair")
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("ord", F.shiftleft(pair, _ROW_BITS) + row).select(*rows.columns, "ord")


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON Lines with ``ord`` rising by file name and place in the file; blank lines are skipped, a
    bad line raises."""
    return in_file_order(spark.read.schema(schema).option("mode", "FAILFAST").json(path))


def read_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON array of records; a file that holds no array raises."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = spark.read.text(path, wholetext=True).withColumn("_array", F.ltrim("value").startswith("["))
    parsed = F.from_json("value", T.ArrayType(kind), {"mode": "FAILFAST"})
    checked = F.when(F.col("_array"), parsed).otherwise(F.raise_error(F.lit("not a JSON array")).cast(T.ArrayType(kind)))
    return text.select(F.posexplode(checked).alias("ord", "r")).select("r.*", F.col("ord").cast("long").alias("ord"))


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return read_lines(spark, path, schema) if path.endswith(".jsonl") else read_array(spark, path, schema)


def read_resumable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines that a crash may have cut: one bad last line is left out, any other raises.
    A missing file is an empty one. The file is never changed."""
    kind = T.StructType.fromDDL(schema)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], kind).withColumn("ord", F.lit(0).cast("long"))
    lines = in_file_order(spark.read.text(path)).filter(F.trim("value") != "")
    wide = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("ord", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = parsed.filter("r._bad IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("at")).first()
    if bad["n"] and (bad["n"] > 1 or bad["at"] != lines.agg(F.max("ord")).first()[0]):
        raise ValueError(f"a damaged line inside {path}")
    return parsed.filter("r._bad IS NULL").select(*(F.col(f"r.{f.name}").alias(f.name) for f in kind.fields), "ord")


def typed(df: DataFrame, schema: T.StructType, defaults: dict[str, Any] | None = None) -> DataFrame:
    """Known fields only; defaults for missing ones; a missing required field raises."""
    defaults = defaults or {}
    columns = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        value = value.cast(f.dataType)
        if f.name in defaults:
            value = F.coalesce(value, F.lit(defaults[f.name]).cast(f.dataType))
        elif not f.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"a record without {f.name}")).cast(f.dataType))
        columns.append(value.alias(f.name))
    return df.select(*columns, *(["ord"] if "ord" in df.columns else []))


def statements(records: DataFrame, label: Sequence[str] = (), weight: float = 1.0) -> DataFrame:
    statement = canonical_statement(F.col("formal_statement"))
    labels = F.array(*map(F.lit, label)).cast("array<string>")
    return records.select(
        stable_id(F.concat(F.coalesce("header", F.lit("")), statement)).alias("id"),
        statement.alias("statement"),
        "header",
        dataset_labels(F.col("split"), F.col("tags"), labels).alias("labels"),
        F.lit(float(weight)).alias("matching_weight"),
        F.lit("dataset").alias("source"),
        "ord",
    )


def load_statements(spark: SparkSession, config_path: str, root: str = ".") -> DataFrame:
    """All sources of a configuration in turn; relative paths start at ``root``. Nothing is deduplicated."""
    parts = []
    for k, source in enumerate(read_json(config_path)):
        path = source["dataset_path"]
        path = path if os.path.isabs(path) or "://" in path else os.path.join(root, path)
        part = statements(read_records(spark, path, STATEMENT_RECORD), source.get("label", ()), source.get("weight", 1.0))
        parts.append(part.withColumn("ord", F.struct(F.lit(k).alias("source"), F.col("ord").alias("row"))))
    return reduce(DataFrame.unionByName, parts)


def load_problems(spark: SparkSession, path: str, labels: Sequence[str] = ()) -> DataFrame:
    rows = read_lines(spark, path, "id STRING, theorem STRING")
    return rows.select("id", canonical_statement(F.col("theorem")).alias("statement"), F.array(*map(F.lit, labels)).cast("array<string>").alias("labels"), "ord")


def row_at(df: DataFrame, index: int) -> DataFrame:
    """The row at a place; places out of bounds raise."""
    rows = df.orderBy("ord").limit(index + 1) if index >= 0 else df.limit(0)
    if index < 0 or rows.count() <= index:
        raise IndexError(index)
    return rows.orderBy(F.desc("ord")).limit(1)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def single_name(name: str) -> str:
    """A folder's name of one component; others raise."""
    if name in ("", ".", "..") or Path(name).name != name:
        raise ValueError("not a single folder name")
    return name


def round_dir(root: str, index: int) -> str:
    return f"{root}/round_{index:03d}"


def manifest_path(artifact: str) -> str:
    return f"{artifact}.manifest.json"


def declaration_map(rows: DataFrame) -> DataFrame:
    return last_wins(rows, ["full_name"], ["ord"]).select("full_name", "statement")


def declaration_names(rows: DataFrame) -> DataFrame:
    return rows.select("full_name").distinct()


def history(df: DataFrame, before: int) -> DataFrame:
    """Earlier rounds: a filter on the partition column."""
    return df.filter(F.col("round") < before)


def round_pool(selected: DataFrame, conjectures: DataFrame) -> DataFrame:
    tagged = conjectures.withColumn("source", F.lit("conjecture"))
    return selected.withColumn("source", F.lit("dataset")).unionByName(tagged, allowMissingColumns=True)


def load_config(path: str, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """TOML; missing keys of ``run`` take their defaults; relative paths of all sections (keys that end
    in _path or _dir) start at the file, ``~`` is the user's folder."""
    with open(path, "rb") as f:
        config = tomllib.load(f)
    config["run"] = {**(defaults or {}), **config.get("run", {})}
    base = Path(path).resolve().parent
    for section in (v for v in config.values() if isinstance(v, dict)):
        for key, value in section.items():
            if isinstance(value, str) and (key.endswith("_path") or key.endswith("_dir")):
                section[key] = str((base / Path(value).expanduser()).resolve())
    return config


def _remote(path: str) -> SparkSession | None:
    """The session, for a path with a scheme; others are the driver's own files."""
    if "://" not in path and not path.startswith("file:"):
        return None
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{path} needs a session")
    return spark


def read_json(path: str) -> Any:
    spark = _remote(path)
    return json.loads(publish.read_text(spark, path) if spark else Path(path).read_text(encoding="utf-8"))


def write_json(path: str, value: Any) -> None:
    """Replaces the file as a whole, on the driver or, with a scheme, on any file system."""
    spark = _remote(path)
    if spark:
        publish.write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2))
        return
    new = f"{path}.tmp"
    with open(new, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(new, path)


def write_lines(df: DataFrame, path: str) -> None:
    """A new folder of JSON Lines in order; complete once it holds _SUCCESS."""
    ordered = df.orderBy("ord").drop("ord") if "ord" in df.columns else df
    ordered.write.mode("errorifexists").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def completed(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` was written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def checkpointed(spark: SparkSession, root: str, name: str, round_index: int, build: Callable[[], DataFrame]) -> DataFrame:
    """Reads a round's phase if it was completed, else builds and writes it."""
    path = f"{root}/round={round_index:03d}/{name}"
    if not completed(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_manifest(path: str, provenance: dict[str, Any], tables: dict[str, DataFrame] | None = None) -> None:
    """``tables``: inputs whose rows are hashed as multisets, so that ``check_manifest`` finds changes."""
    content = {"content": {k: publish.content_hash(df) for k, df in tables.items()}} if tables else {}
    write_json(path, {"artifact_schema": ARTIFACT_SCHEMA, **provenance, **content})


def start_run(root: str, config_path: str, revisions: dict[str, Any], toolchain: str, declarations: str | None = None, tables: dict[str, DataFrame] | None = None) -> dict[str, Any]:
    """A run's manifest (revisions of the code, toolchain, model, solver, the declarations' own manifest,
    hashes of the input tables) and a copy of its configuration. A run that has one keeps it: another
    schema, another revision or changed tables raise."""
    path = f"{root}/manifest.json"
    config = load_config(config_path)
    provenance = {"revisions": revisions, "toolchain": toolchain, "base_model": config.get("model", {}).get("name"), "solver": config.get("solver", {}).get("kind")}
    if declarations is not None:
        provenance["declarations"] = check_manifest(manifest_path(declarations), {})
    spark = _remote(root)
    if publish.exists(spark, path) if spark else os.path.exists(path):
        return check_manifest(path, provenance, tables)
    if not spark:
        os.makedirs(root, exist_ok=True)
    write_manifest(path, provenance, tables)
    text = Path(config_path).read_text(encoding="utf-8")
    if spark:
        publish.write_text(spark, f"{root}/config.toml", text)
    else:
        Path(root, "config.toml").write_text(text, encoding="utf-8")
    return check_manifest(path, provenance, tables)


def write_declarations(rows: DataFrame, path: str, provenance: dict[str, Any]) -> dict[str, Any]:
    """The declarations by name as JSON Lines, and the manifest beside them; returns the manifest."""
    named = rows.select("full_name", "statement", F.col("full_name").alias("ord"))
    write_lines(named, path)
    write_manifest(manifest_path(path), {**provenance, "artifact": path, "declarations": count_lines(rows.sparkSession, path)})
    return check_manifest(manifest_path(path), {"artifact": path})


def search_requests(requests: DataFrame) -> DataFrame:
    """What a tree search is sent for each request: its statement ends in ``sorry``."""
    return requests.select(F.col("id").alias("request_id"), sorry_form(F.col("statement")).alias("theorem"), "header", "seed", *(["ord"] if "ord" in requests.columns else []))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def check_manifest(path: str, expected: dict[str, Any], tables: dict[str, DataFrame] | None = None) -> dict[str, Any]:
    """The manifest; another schema, another value of an expected key or other rows of a table raise."""
    manifest = read_json(path)
    if manifest.get("artifact_schema") != ARTIFACT_SCHEMA:
        raise ValueError("an artifact of another schema")
    stale = {k for k, v in expected.items() if manifest.get(k) != v}
    stale |= {k for k, df in (tables or {}).items() if manifest.get("content", {}).get(k) != publish.content_hash(df)}
    if stale:
        raise ValueError(f"stale: {sorted(stale)}")
    return manifest
