"""Content-addressed WARC archive.

Layout of an archive (a folder of two Parquet tables):

* ``payloads``: (digest, payload), each distinct payload once under its SHA-256;
* ``records``: one row per record with its exact header bytes (WARC fields and, for
  responses, the HTTP header), its kind, and the digest of its payload.

A record is rebuilt by joining the two: header, blank line, payload, two line ends. A revisit
holds only headers and names the record that has the same payload.

Writing costs one shuffle of the distinct payloads: SHA-256 is taken map-side, ``max`` of
the id and the payload are combined before the shuffle, so thousands of copies of a page
leave a map task as one row. Reading verifies each stored payload against the digest it is
stored under, once, where it is scanned, and joins its bytes to the records on the
digest, whose hot values adaptive execution may split (``rebuild``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below this many bytes are never replaced by a revisit.
MIN_REVISIT = 1000
_DATE = "1970-01-01T00:00:00Z"
_EOL = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*lines: Column | str) -> Column:
    return F.concat(*[x for line in lines for x in ((F.lit(line) if isinstance(line, str) else line), F.lit(_EOL))])


def _record_id(page_id: Column) -> Column:
    """A WARC-Record-ID that names the page."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write_archive(pages: DataFrame, out: str, id_col: str = "page_id", url: str = "url", html: str = "html",
                  date: str = _DATE, min_revisit: int = MIN_REVISIT) -> None:
    """One record per row of ``pages``; the payload is ``html`` in UTF-8 (null: empty).

    Among records of equal payloads of at least ``min_revisit`` bytes those with the largest id
    are responses (rows that repeat that id too), the others revisit it; a null id
    counts as smaller than any. A null url gives an empty target. Other columns are
    ignored; an empty table gives an empty archive."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # equal digests must hold equal bytes: the second hash and the size may not differ
    stored = rows.groupBy("digest").agg(
        F.max("page_id").alias("lead"), F.min(F.xxhash64("payload")).alias("low"),
        F.max(F.xxhash64("payload")).alias("high"), F.first("payload").alias("payload"))
    stored = stored.withColumn("payload", F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads share the digest "), F.col("digest"))).cast("binary")))
    stored.select("digest", "lead", "payload").write.option("compression", "zstd").parquet(f"{out}/payloads")
    leads = pages.sparkSession.read.parquet(f"{out}/payloads").select("digest", "lead")
    heads = rows.select("page_id", "url", "digest", F.length("payload").alias("size")).join(leads, "digest")
    revisit = (F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("lead"))
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
                  F.concat(F.lit("Content-Length: "), F.col("size").cast("string")), "")
    head = [F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"))),
            F.concat(F.lit("WARC-Target-URI: "), clean), f"WARC-Date: {date}",
            F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))]
    response = F.concat(
        _lines("WARC/1.1", "WARC-Type: response", *head, "Content-Type: application/http; msgtype=response",
               F.concat(F.lit("Content-Length: "), (F.length(http) + F.col("size")).cast("string")), ""), http)
    again = _lines("WARC/1.1", "WARC-Type: revisit", *head, f"WARC-Profile: {_PROFILE}",
                   F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("lead"))), "Content-Length: 0", "")
    (heads.select("page_id", F.when(revisit, again).otherwise(response).cast("binary").alias("header"), "digest")
     .write.option("compression", "zstd").parquet(f"{out}/records"))


def _field(name: str) -> Column:
    """A field of the WARC header (up to its blank line); null if it is not there."""
    text = F.substring_index(F.col("header").cast("string"), _EOL + _EOL, 1)
    return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def _verified(payload: Column, digest: Column) -> Column:
    return F.when(F.sha2(payload, 256) == digest, payload).otherwise(
        F.raise_error(F.concat(F.lit("a payload does not have the digest "), digest)).cast("binary"))


def records(spark: SparkSession, out: str) -> DataFrame:
    """Every record with its parsed header: (page_id, header, digest, record_type, refers_to)."""
    rows = spark.read.parquet(f"{out}/records")
    kind = rows.schema["page_id"].dataType
    named = F.nullif(F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(.*)>", 1), F.lit(""))
    return rows.select("page_id", "header", _field("WARC-Payload-Digest").substr(F.lit(8), F.lit(64)).alias("digest"),
                       _field("WARC-Type").alias("record_type"), named.cast(kind).alias("refers_to"))


def rebuild(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, record_type, record, payload, refers_to, header_bytes): the original record bytes, by joining headers and
    payloads, and the full payload, of a revisit too. Each stored payload is verified once, before the join."""
    stored = spark.read.parquet(f"{out}/payloads").select("digest", _verified(F.col("payload"), F.col("digest")).alias("payload"))
    end = F.lit(_EOL + _EOL).cast("binary")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    return records(spark, out).join(stored, "digest").select(
        "page_id", "record_type", F.concat("header", body, end).alias("record"), "payload", "refers_to",
        F.length("header").alias("header_bytes"))


def read_archive(spark: SparkSession, out: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, from the rebuilt records: the
    payload is cut out of a response and is that of the record referred to for a revisit; ``payload_digest`` is SHA-1 in hex."""
    size = F.length("record") - F.col("header_bytes") - len(_EOL + _EOL)
    payload = F.when(F.col("record_type") == "response", F.substring(F.col("record"), F.col("header_bytes") + 1, size)) \
        .otherwise(F.col("payload"))
    return rebuild(spark, out).withColumn("held", payload).select(
        "page_id", F.length("held").cast("long").alias("payload_bytes"), F.sha1("held").alias("payload_digest"),
        "record_type", "refers_to")
