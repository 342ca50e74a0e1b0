"""WARC: captures written as request, response (or revisit) and metadata
records, and assembled again into one nested row per capture.

Writing: one Spark text write. A page row becomes three records in the same
task; a record is one text "line", and records end with the blank lines the
format asks for. A payload that an earlier page (smaller id) already has is
written as a ``revisit`` record without it. Files hold at most
``FILE_RECORDS`` records, so none grows with the corpus.

Reading: every record opens with the version line and the archive's own
``WARC-Warcinfo-ID`` (a fresh UUID for each archive, so no payload can hold
it); Spark's text reader splits on those two lines, which keeps one record in
memory at a time, whatever a file holds. ``Content-Length`` is checked for
every record.

Assembly: request, response and metadata are joined through
``WARC-Concurrent-To``: the response names its request, the metadata record
names its response. All of it is DataFrame expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release
from .common import broadcast_within, spread_join
from .urlfilter import host_of, path_of

CRLF = "\r\n"
FILE_RECORDS = 6000
BROADCAST_REVISITS = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(c: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits (10 hex digits) are 8 letters."""
    h = F.sha1(c.cast("binary"))
    eight = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _opening(archive_id: str) -> str:
    return f"WARC/1.1{CRLF}WARC-Warcinfo-ID: <urn:uuid:{archive_id}>{CRLF}"


def _one_line(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r"), F.lit("%0D")),
                     F.lit("\n"), F.lit("%0A"))


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload (of at least
    ``min_bytes``) a page with a smaller id has. Only ids and digests are
    shuffled, combined before the shuffle."""
    narrow = materialize(pages.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest"), "page-digests")
    first = (narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
             .where("n > 1 and refers_to is not null").drop("n"))
    return (spread_join(narrow, first, ["digest"], ["page_id"]).where("not (page_id <=> refers_to)")
            .select("page_id", "digest", "refers_to").distinct())


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0) -> str:
    """Write ``pages`` as gzipped WARC files under ``path``; returns the
    archive's id, which ``read_archive`` needs.

    Null payloads are empty. Of equal payloads the smallest id's is the
    response and others revisit it (rows that repeat that id stay responses;
    rows without an id revisit, or are responses where no equal row has one).
    Line breaks in URLs are percent-encoded. Other columns are ignored; an
    empty table gives an archive without records."""
    archive_id = str(uuid.uuid4())
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    p = p.withColumn("digest", base32_sha1(F.col("payload")))
    rev = materialize(revisits(p, min_bytes), "warc-revisits")
    r = broadcast_within(rev, rev.count(), BROADCAST_REVISITS).withColumnRenamed("page_id", "_page")
    p = p.join(r.withColumnRenamed("digest", "_digest"),
               F.expr("page_id <=> _page and digest = _digest"), "left")
    p = p.withColumn("n", F.monotonically_increasing_id())
    rid = lambda kind: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        F.md5(F.concat_ws(":", F.lit(archive_id), F.lit(kind), F.col("n"))),
        "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    is_rev = F.col("refers_to").isNotNull()

    def record(kind: Column, rec_id: Column, fields: list[Column], block: Column) -> Column:
        return F.concat(
            F.lit(_opening(archive_id)), F.lit("WARC-Type: "), kind,
            F.lit(f"{CRLF}WARC-Record-ID: "), rec_id,
            F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Target-URI: "), _one_line(F.col("url")),
            *fields, F.lit(f"{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
            F.lit(CRLF * 2), block)

    def field(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{CRLF}{name}: "), value.cast("string"))
        return F.coalesce(F.when(when, text) if when is not None else text, F.lit(""))

    request = record(F.lit("request"), rid("request"), [], F.concat(
        F.lit("GET "), _one_line(path_of(F.col("url"))), F.lit(f" HTTP/1.1{CRLF}Host: "),
        _one_line(host_of(F.col("url"))), F.lit(CRLF * 2)))
    response = record(
        F.when(is_rev, "revisit").otherwise("response"), rid("response"),
        [field("WARC-Concurrent-To", rid("request")),
         field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         field("WARC-Profile", F.lit(PROFILE), is_rev),
         field("WARC-Refers-To-Target-URI", F.concat(F.lit("urn:page:"), F.col("refers_to").cast("string")), is_rev)],
        F.concat(head, F.when(is_rev, "").otherwise(F.col("payload"))))
    metadata = record(F.lit("metadata"), rid("metadata"), [field("WARC-Concurrent-To", rid("response"))],
                      F.concat(F.lit("payload-bytes: "), F.octet_length("payload").cast("string"),
                               F.coalesce(F.concat(F.lit(f"{CRLF}page: "), F.col("page_id").cast("string")), F.lit("")),
                               F.lit(CRLF)))
    (p.select(F.explode(F.array(request, response, metadata)).alias("value"))
     .write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))
    release(rev)
    return archive_id


def read_archive(spark: SparkSession, path: str, archive_id: str) -> DataFrame:
    """``type, record_id, concurrent_to, uri, header, block`` of every record;
    fails on a record whose block is not as long as its header says."""
    r = (spark.read.option("lineSep", _opening(archive_id)).text(path).where("value != ''")
         .select(F.substring_index("value", CRLF * 2, 1).alias("header"), "value"))
    # the block lies between the header's blank line and the record's last two
    r = r.withColumn("block", F.expr("substring(value, length(header) + 5, length(value) - length(header) - 8)"))
    get = lambda name: F.nullif(F.regexp_extract(
        F.concat(F.lit(CRLF), F.col("header"), F.lit(CRLF)), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    whole = F.octet_length("block") == get("Content-Length").cast("long")
    return r.select(get("WARC-Type").alias("type"), get("WARC-Record-ID").alias("record_id"),
                    get("WARC-Concurrent-To").alias("concurrent_to"),
                    get("WARC-Target-URI").alias("uri"),
                    get("WARC-Payload-Digest").alias("digest"),
                    get("WARC-Refers-To-Target-URI").alias("refers_to"), "header",
                    F.when(whole, F.col("block")).otherwise(
                        F.raise_error(F.lit("a record's block has another length than its header says"))).alias("block"))


def assemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per capture: ``request``, ``response`` and ``metadata`` structs,
    joined through concurrent-to identifiers. A response without a request or
    metadata record keeps its row, with nulls there. Length and digest of a
    response are of the payload as read; ``with_payload=False`` leaves the
    payload itself out, so that the joins need not carry it."""
    body = F.expr("substring(block, length(substring_index(block, '\\r\\n\\r\\n', 1)) + 5)")
    req = records.where("type = 'request'").select(
        F.col("record_id").alias("q_id"), F.col("block").alias("q_block"))
    res = records.where("type in ('response', 'revisit')").select(
        F.col("record_id").alias("s_id"), F.col("concurrent_to").alias("q_id"), F.col("type").alias("s_type"),
        "uri", F.regexp_replace("digest", "^sha1:", "").alias("s_digest"),
        F.regexp_replace("refers_to", "^urn:page:", "").cast("long").alias("refers_to"),
        *[F.when(F.col("type") == "response", body).alias("payload")] * with_payload,
        F.when(F.col("type") == "response", F.octet_length(body)).alias("read_bytes"),
        F.when(F.col("type") == "response", base32_sha1(body)).alias("read_digest"))
    meta = records.where("type = 'metadata'").select(
        F.col("record_id").alias("m_id"), F.col("concurrent_to").alias("s_id"),
        F.nullif(F.regexp_extract("block", r"page: (-?\d+)", 1), F.lit("")).cast("long").alias("page_id"),
        F.regexp_extract("block", r"payload-bytes: (\d+)", 1).cast("long").alias("payload_bytes"))
    return res.join(req, "q_id", "left").join(meta, "s_id", "left").select(
        F.when(F.col("q_block").isNotNull(), F.struct(F.col("q_id").alias("record_id"), F.col("q_block").alias("block"))).alias("request"),
        F.struct(F.col("s_id").alias("record_id"), F.col("s_type").alias("type"), "uri",
                 F.col("s_digest").alias("digest"), "refers_to", *["payload"] * with_payload,
                 "read_bytes", "read_digest").alias("response"),
        F.when(F.col("m_id").isNotNull(), F.struct(F.col("m_id").alias("record_id"), "page_id", "payload_bytes")).alias("metadata"))
