"""Token ids in byte-aligned variable-length coding with separate control bytes.

Ids are first replaced by their rank in the corpus by frequency (frequent ids become
small numbers), then four ranks share a control byte of four 2-bit lengths, and their
1 to 4 little-endian bytes follow in the data stream. Each document starts a control
byte; its last group is filled with zeros.

A file is a table of blocks in ascending order of documents. Each block is one binary
value: the magic ``TSVB0001``; as unsigned 64-bit integers the numbers of documents,
ids, control bytes and data bytes; the documents' ids (signed 64-bit), id counts
(unsigned 32-bit); the control bytes; the data bytes. ``part`` (a writing task) and
``skip`` (its ids before the block) order blocks. The ranks lie beside the blocks as
(rank, id), at most one row per vocabulary entry.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, fresh_path, ship, whole_text

MAGIC = b"TSVB0001"
#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18
END_ID = 1

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with ``counts`` ranks each: control bytes, data bytes, and where each
    document's begin in them (one more for the end)."""
    filled = (counts + 3) // 4 * 4
    ends = np.cumsum(filled)
    padded = np.zeros(int(filled.sum()), dtype="<u4")
    padded[np.arange(len(ranks)) + np.repeat(ends - filled - (np.cumsum(counts) - counts), counts)] = ranks
    extra = (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    groups = extra.reshape(-1, 4)
    control = groups[:, 0] | groups[:, 1] << 2 | groups[:, 2] << 4 | groups[:, 3] << 6
    data = padded.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]]
    control_at = np.concatenate([[0], ends // 4])
    group_bytes = np.concatenate([[0], np.cumsum(groups.sum(axis=1, dtype=np.int64) + 4)])
    return control, data, control_at, group_bytes[control_at]


def unpack(control: np.ndarray, data: bytes, counts: np.ndarray) -> np.ndarray:
    """All documents' ranks, by table lookup of the control bytes' lengths."""
    lengths = _LENGTHS[control].ravel()
    ends = np.cumsum(lengths, dtype=np.int64)
    at = ends - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    value = raw[at].astype(np.uint32)
    for k in range(1, 4):
        wide = np.flatnonzero(lengths > k)
        if len(wide):
            value[wide] |= raw[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    filled = (counts + 3) // 4 * 4
    keep = np.arange(int(counts.sum())) + np.repeat(np.cumsum(filled) - filled - (np.cumsum(counts) - counts), counts)
    return value[keep]


def block(doc_ids: list[int], counts: list[int], control: bytes, data: bytes) -> bytes:
    head = np.array([len(doc_ids), sum(counts), len(control), len(data)], dtype="<u8").tobytes()
    return b"".join((MAGIC, head, np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), control, data))


def read_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids, id counts, and all ranks of a block."""
    if raw[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, ids, n_control, n_data = (int(x) for x in np.frombuffer(raw, "<u8", 4, 8))
    at = 40 + 8 * docs
    doc_ids = np.frombuffer(raw, "<i8", docs, 40)
    counts = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    if len(raw) != at + n_control + n_data or int(counts.sum()) != ids:
        raise ValueError("a block of token ids is damaged")
    return doc_ids, counts, unpack(np.frombuffer(raw, np.uint8, n_control, at), raw[at + n_control :], counts)


def _encode(path: str, end_id: int):
    """(id, ids) of each text, and at the end (token, n) of what the task has seen."""

    def encode(batches):
        import pyarrow as pa

        from tessera.llm.chunks import encoder, small_batches
        from tessera.llm.pieces import binary_rows, with_last

        coder = encoder(path)
        total = np.zeros(0, np.int64)
        for batch in small_batches(batches):
            ids, ends = with_last(*coder.encode(batch.column("text")), end_id)
            got = np.bincount(ids, minlength=len(total))
            got[: len(total)] += total
            total = got
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("id"), binary_rows(ids, ends), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=["id", "ids", "token", "n"])
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.binary()), pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["id", "ids", "token", "n"])

    return encode


def _pack(rank_of, kind: str):
    def packed(batches):
        import pyarrow as pa

        from tessera.llm.chunks import small_batches

        rank = rank_of.value
        for batch in small_batches(batches, "ids", 2 << 20):
            ids = batch.column("ids")
            _, offsets, raw = ids.buffers()
            at = np.frombuffer(offsets, np.int32)[ids.offset : ids.offset + len(ids) + 1]
            counts = np.diff(at).astype(np.int64) // np.dtype(kind).itemsize
            values = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view(kind) if raw else np.zeros(0, kind)
            control, data, control_at, data_at = pack(rank[values], counts)
            binary = lambda values, at: pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(counts), binary(control, control_at), binary(data, data_at)], names=["id", "part", "n", "control", "data"])

    return packed


def _write_blocks(block_ids: int):
    def write(batches):
        import pyarrow as pa

        docs: list[int] = []
        counts: list[int] = []
        controls: list[bytes] = []
        datas: list[bytes] = []
        skip = size = 0
        part = None

        def out():
            value = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([skip], pa.int64()), pa.array([size], pa.int64()), pa.array([block(docs, counts, b"".join(controls), b"".join(datas))], pa.binary())],
                names=["part", "skip", "n_ids", "block"],
            )
            for held in (docs, counts, controls, datas):
                held.clear()
            return value

        for batch in batches:
            for doc, its_part, n, control, data in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "n", "control", "data")), strict=True):
                if docs and (its_part != part or size >= block_ids):
                    yield out()
                    skip, size = skip + size, 0
                if its_part != part:
                    part, skip = its_part, 0
                docs.append(doc)
                counts.append(n)
                controls.append(control)
                datas.append(data)
                size += n
        if docs:
            yield out()

    return write


def write_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts (null: empty), each followed by ``end_id``, into ``path``.

    Rows go in ascending order of their integer id; a row without an id is no document
    and raises, rows that repeat an id follow each other. An empty table makes an empty
    file.
    """
    from tessera.llm.chunks import encoder

    spark = docs.sparkSession
    ship(spark)
    named = docs.select(F.coalesce(F.col(id_col).cast("long"), F.raise_error(F.lit("a document without an id")).cast("long")).alias("id"), whole_text(text_col).alias("text"))
    scratch = fresh_path(spark, "encoded")
    kind = "id BIGINT, ids BINARY, token BIGINT, n BIGINT"
    named.mapInArrow(_encode(tokenizer_path, end_id), kind).write.option("compression", "zstd").parquet(scratch)
    encoded = spark.read.schema(kind).parquet(scratch)
    # one row per vocabulary entry that occurs: bounded by the tokenizer
    counted = encoded.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = [r[0] for r in counted.orderBy(F.desc("n"), "token").collect()]
    rank = np.zeros(max(tokens, default=0) + 1, dtype=np.uint32)
    rank[tokens] = np.arange(len(tokens), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(tokens)), "rank INT, token INT").coalesce(1).write.parquet(f"{path}/ranks")
    # ranges of ids of about equal counts; each is a part, sorted by one task
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = encoded.filter("id IS NOT NULL")
    cuts = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    above = F.array(*(F.lit(c).cast("long") for c in sorted(set(cuts or []))))
    part = F.size(F.filter(above, lambda c: c < F.col("id"))).alias("part")
    packed = rows.select("id", "ids", part).mapInArrow(_pack(spark.sparkContext.broadcast(rank), encoder(tokenizer_path).kind.str), "id BIGINT, part INT, n BIGINT, control BINARY, data BINARY")
    dealt = packed.repartitionById(n, F.col("part")).sortWithinPartitions("part", "id")
    blocks = dealt.mapInArrow(_write_blocks(block_ids), "part INT, skip BIGINT, n_ids BIGINT, block BINARY")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop_stored(spark, scratch)


def _read_blocks(token_of):
    def read(batches):
        import pyarrow as pa

        table = token_of.value
        for batch in batches:
            for start, raw in zip(batch.column("start").to_pylist(), batch.column("block").to_pylist(), strict=True):
                docs, counts, ranks = read_block(raw)
                ids = table[ranks]
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[e - c : e]) for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def _ids_of_blocks(token_of):
    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column("block").to_pylist():
                docs, counts, ranks = read_block(raw)
                ids, ends = token_of.value[ranks], np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array([ids[e - c : e].tolist() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)], pa.list_(pa.int64()))], names=["id", "ids"])

    return read


def _open(spark: SparkSession, path: str):
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    return spark.sparkContext.broadcast(np.array([r["token"] for r in ranks], dtype="<u4"))


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The documents of a file with their ids as arrays."""
    ship(spark)
    return spark.read.parquet(f"{path}/blocks").select("block").mapInArrow(_ids_of_blocks(_open(spark, path)), "id BIGINT, ids ARRAY<BIGINT>").withColumnRenamed("id", id_col)


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of a file: id, start, n_tokens, ids_crc32."""
    ship(spark)
    blocks = spark.read.parquet(f"{path}/blocks")
    # a row for each task that wrote
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = [], 0
    for part, n in parts:
        before.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "part INT, before BIGINT"))
    placed = blocks.join(offsets, "part").select((F.col("before") + F.col("skip")).alias("start"), "block")
    return placed.mapInArrow(_read_blocks(_open(spark, path)), "id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT").withColumnRenamed("id", id_col)


def op7_vbyte_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_digests(spark, path)
