"""Content-addressed web archive: payload bytes once per digest, exact record headers apart, records by joins.

An archive is two Parquet tables in one folder. ``payloads`` has each distinct payload once under
its SHA-256 digest; that equal digests mean equal bytes is verified over all rows while it is
written. ``records`` has the exact header block of every record and the digest of its payload.
A record is rebuilt by joining the two: header block, blank line, payload, two line ends.

Of records with equal payloads of at least ``revisit_from`` bytes, the one with the smallest id is
the response and the others are revisits that refer to it; shorter payloads are always responses.

Defined cases: a null payload is the empty payload; a null address gives no target line; a null id
never names a response that others refer to, unless all ids of its payload are null, and then each
such row is a response; rows that repeat the smallest id are all responses; an empty table makes
an empty archive; columns other than the three that are named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def header_block(date: str) -> Column:
    """The header lines of a record, without the blank line that ends them."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("record_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("uri", r"[\r\n]+", " ")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),
        F.when(F.col("record_type") == "revisit", F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(F.col("record_type") == "revisit", 0).otherwise(F.col("bytes")).cast("string")),
    ]
    return F.concat_ws(CRLF, *lines)  # drops the lines that are null


def write_archive(
    pages: DataFrame, folder: str, *, id_column: str = "page_id", uri_column: str = "url",
    payload_column: str = "html", revisit_from: int = 100, date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write the records of ``pages`` to the archive in ``folder``."""
    payload = F.encode(F.coalesce(F.col(payload_column).cast("string"), F.lit("")), "UTF-8")
    raw = pages.select(F.col(id_column).alias("record_id"), F.col(uri_column).cast("string").alias("uri"), payload.alias("payload"))
    raw = raw.withColumn("digest", F.sha2("payload", 256))

    # Smallest and largest payload of a digest differ only if two payloads share it. Both are
    # combined before the shuffle, so a payload with many copies sends one row per task.
    stored = raw.groupBy("digest").agg(F.min("payload").alias("payload"), F.max("payload").alias("other"))
    clash = F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("digest")))
    stored.select("digest", F.when(F.col("payload") == F.col("other"), F.col("payload")).otherwise(clash).alias("payload")).write.parquet(
        f"{folder}/payloads"
    )

    narrow = raw.select("record_id", "uri", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    long = F.col("bytes") >= revisit_from
    first = narrow.filter(long).groupBy("digest").agg(F.min("record_id").alias("first_id"))
    # Spark splits a digest that holds very many rows when it joins; the grouped side has one row each.
    typed = narrow.filter(long).join(first, "digest").unionByName(narrow.filter(~long), allowMissingColumns=True)
    again = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    typed = typed.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    typed = typed.withColumn("refers_to", F.when(again, F.col("first_id")))
    typed.select("record_id", "digest", header_block(date).alias("header")).write.parquet(f"{folder}/records")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archive: record_id, header, digest, and the full payload, for revisits too."""
    records, payloads = spark.read.parquet(f"{folder}/records"), spark.read.parquet(f"{folder}/payloads")
    return records.join(payloads, "digest")


def header_value(name: str) -> Column:
    value = F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def parsed(records: DataFrame) -> DataFrame:
    """Adds what the header lines and payloads say: record_type, refers_to, declared and actual digest, lengths."""
    return records.select(
        "*",
        header_value("WARC-Type").alias("record_type"),
        F.regexp_extract(header_value("WARC-Refers-To"), "<urn:page:(.*)>", 1).alias("refers_to"),
        F.regexp_extract(header_value("WARC-Payload-Digest"), "sha256:([0-9a-f]{64})", 1).alias("declared_digest"),
        F.sha2("payload", 256).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )


def record_bytes() -> Column:
    """The original record as it stands in a WARC file: a revisit has no body."""
    body = F.when(header_value("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    return F.concat(F.encode("header", "UTF-8"), end, body, end)


def export_warc(records: DataFrame, path: str) -> None:
    """Write the records as WARC files: the text writer's line end closes each record."""
    body = F.when(header_value("WARC-Type") == "revisit", F.lit("")).otherwise(F.decode("payload", "UTF-8"))
    records.select(F.concat(F.col("header"), F.lit(CRLF + CRLF), body).alias("value")).write.option("lineSep", CRLF + CRLF).text(path)
