"""A content-addressed WARC archive.

``payloads`` holds each distinct payload once under its SHA-256, bucketed and sorted by
it; ``headers`` holds the exact bytes that precede a record's payload, one row per record.
Joining them gives the original records: header, payload (responses), two line ends. An
archive is read through its rebuilt records, and both digests are verified then. A revisit
has no payload of its own; it refers to the response by its record id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, stored
from tessera.llm.digest_store import DigestStore

#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:tessera:page:"
DATE = "2024-01-01T00:00:00Z"
#: What some readers take for a line's end.
LINE_ENDS = ("\r", "\n", "\v", "\f", "\x85", "\u2028", "\u2029")


def base32_of_hex(digest: Column) -> Column:
    """The base32 form of 40 hexadecimal digits: 5 of them are 4 characters."""
    parts = []
    for k in range(0, 40, 5):
        bits = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*parts)


def sha1_base32(payload: Column) -> Column:
    return base32_of_hex(F.sha1(payload))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _payloads(spark: SparkSession, path: str) -> DigestStore:
    # as many buckets as the aggregation that finds the distinct payloads has partitions
    return DigestStore(spark, "payload", "BINARY", f"{path}/payloads", max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))


def write_archive(pages: DataFrame, path: str, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """A record per row of ``pages``; payload: the html in UTF-8 (null: empty), whole.

    Of records with equal payloads of at least ``min_payload`` bytes, that with the
    smallest id is the response and the others revisit it; smaller payloads are all
    responses. Rows with a null id are responses that nothing refers to; rows repeating
    the response's id are responses too, and each record has an id of its own. A null url
    becomes an empty one; characters in urls that end lines are percent-encoded. Columns
    of other names are not read, whatever they are. An empty table makes an empty archive.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    # copies meet before the shuffle
    _payloads(spark, path).append(named.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"]), dealt=True)
    url = F.coalesce("url", F.lit(""))
    for c in LINE_ENDS:
        url = F.replace(url, F.lit(c), F.lit("".join(f"%{b:02X}" for b in c.encode())))
    records = stored(
        named.select(
            F.monotonically_increasing_id().alias("n"), "id", url.alias("url"), F.sha2("payload", 256).alias("sha256"), sha1_base32(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size")
        ),
        "warc-records",
    )
    first = stored(records.filter("id IS NOT NULL").groupBy("sha256").agg(F.min(F.struct("id", "n")).alias("first")), "warc-first")
    placed = records.join(first.hint("merge"), "sha256", "left")
    revisit = F.coalesce((F.col("size") >= min_payload) & (F.col("id") != F.col("first.id")), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    urn = lambda c, n: F.concat(F.lit(f"<{RECORD_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(":"), F.col(n).cast("string"), F.lit(">"))
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn("id", "n")),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", urn("first.id", "first.n")))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"),
        http,
    )
    placed.select("sha256", F.when(revisit, F.lit(True)).otherwise(F.lit(False)).alias("bare"), F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def records(spark: SparkSession, path: str) -> DataFrame:
    """The original records' bytes: (digest, record); ``digest`` is the stored payload's, null without one."""
    headers = spark.read.parquet(f"{path}/headers")
    end = F.lit(b"\r\n\r\n")
    store = _payloads(spark, path)
    full = headers.filter("NOT bare").withColumnRenamed("sha256", "digest")
    with_payload = full.repartition(store.buckets, "digest").join(store.read().hint("merge"), "digest").select("digest", F.concat("header", "payload", end).alias("record"))
    return with_payload.unionByName(headers.filter("bare").select(F.lit(None).cast("string").alias("digest"), F.concat("header", end).alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """Of records' bytes: their named fields, and the payload of responses. Lines end in CR LF alone."""
    # as Latin-1 a character is a byte
    latin = F.decode("record", "ISO-8859-1")
    cut = records.withColumn("at", F.instr(latin, "\r\n\r\n")).withColumn("lines", F.split(F.decode(F.expr("substring(record, 1, at - 1)"), "UTF-8"), "\r\n"))

    def field(name: str) -> Column:
        return F.get(F.transform(F.filter("lines", lambda x: x.startswith(f"{name}: ")), lambda x: F.substring(x, F.lit(len(name) + 3), F.length(x))), F.lit(0))

    cut = cut.withColumn("block", F.expr("substring(record, at + 4)")).withColumn("length", field("Content-Length").cast("int"))
    # the block and the two line ends behind it are all that follows
    sound = (F.octet_length("block") == F.col("length") + 4) & (F.expr("substring(block, length + 1)") == F.lit(b"\r\n\r\n"))
    http = F.instr(F.decode("block", "ISO-8859-1"), "\r\n\r\n")
    urn = rf"^<{RECORD_URN}(none|-?\d+):(\d+)>$"
    number = lambda name, k: F.regexp_extract(field(name), urn, k).try_cast("long")
    return cut.withColumn("http", F.when(sound, http).otherwise(F.raise_error(F.lit("a record of another length than it says")).cast("int"))).select(
        "digest",
        field("WARC-Type").alias("record_type"),
        number("WARC-Record-ID", 1).alias("id"),
        number("WARC-Record-ID", 2).alias("n"),
        number("WARC-Refers-To", 1).alias("refers_to"),
        number("WARC-Refers-To", 2).alias("refers_n"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("told_digest"),
        F.expr("substring(block, http + 4, length - http - 3)").alias("payload"),
    )


def read_archive(spark: SparkSession, path: str, id_col: str = "page_id") -> DataFrame:
    """Per record: id, record_type, refers_to, payload_bytes, payload_digest, all from the rebuilt
    records' bytes; a revisit's payload is that of the response it refers to."""
    fields = parsed(records(spark, path))
    told, found = F.col("told_digest"), sha1_base32(F.col("payload"))
    sound = (F.sha2("payload", 256) == F.col("digest")) & (told == found)
    checked = F.when(F.col("record_type") == "revisit", told).when(sound, found).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("string"))
    rows = stored(fields.select("id", "n", "record_type", "refers_to", "refers_n", checked.alias("payload_digest"), F.octet_length("payload").cast("long").alias("size")), "warc-read")
    responses = rows.filter("record_type = 'response'")
    known = responses.select(F.col("n").alias("refers_n"), F.col("size").alias("full"), F.col("payload_digest").alias("of_response"))
    same = F.when(F.col("of_response") == F.col("payload_digest"), F.col("full")).otherwise(F.raise_error(F.lit("a revisit names another payload than its response")).cast("bigint"))
    revisits = rows.filter("record_type = 'revisit'").join(known.hint("merge"), "refers_n", "left").withColumn("size", same)
    shown = lambda df: df.select(F.col("id").alias(id_col), F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return shown(responses).unionByName(shown(revisits))


def op5_content_addressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path)
