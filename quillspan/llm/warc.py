"""Content-addressed WARC archive.

``write_archives`` turns pages into WARC/1.1 records in gzip files; ``read_archives`` streams them back record by
record, whatever the payloads contain; ``store_records`` keeps payload bytes once per verified SHA-256 and the exact
record headers in a table of their own; ``reconstruct`` joins the two into the original records.

Defined cases: a null payload is empty, a null url an empty one; line ends in urls are escaped; a null page_id is
written as an empty name and comes back as null, and it is a response unless an equal payload has an id; repeated
rows give a record each; a large payload whose largest page_id is repeated has a response for each such row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import load, stored
from quillspan.plans.registry import Builder
from quillspan.session import checkpoint_dir

#: Smaller payloads are written again rather than revisited.
MIN_REVISIT = 1_000
RECORDS_PER_FILE = 10_000
#: Fixed values of the format.
_END = "\r\n\r\n"
_NAME = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, sha1, n_bytes, refers_to): refers_to is set for revisits.

    Only payloads that occur twice are listed, so the pages meet a table that is broadcast while it is small.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    based = pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"),
        F.sha2(body.cast("binary"), 256).alias("sha256"), F.octet_length(body).cast("long").alias("n_bytes"),
    )
    again = stored(
        based.where(F.col("n_bytes") >= min_revisit).groupBy("sha256", "n_bytes")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return based.join(again, ["sha256", "n_bytes"], "left").select(
        "page_id", "url", "html", "sha1", "n_bytes", F.when(revisit, F.col("response_id")).alias("refers_to"))


def record_text(html: Column) -> Column:
    """One whole record as text, without the two line ends that close it."""
    name = lambda c: F.concat(F.lit(f"<{_NAME}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n_bytes").cast("string"), F.lit(_END))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")), F.lit("\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {_DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit(_END),
    )
    return F.concat(head, http, F.when(revisit, F.lit("")).otherwise(html))


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write one record per row; the closing line ends of a record are the line separator of the text files."""
    decide(pages, min_revisit).select(record_text(F.col("html")).alias("value")).write.option("lineSep", _END).option(
        "compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def _fields(head: bytes) -> dict[str, str]:
    rows = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (r.split(":", 1) for r in rows if ":" in r)}


def _name(value: str | None) -> str | None:
    return (value or "").strip("<>").removeprefix(_NAME) or None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream text pieces back into bytes and cut records by their declared length; holds one record at a time."""
    end = _END.encode()
    names = ["name", "record_type", "refers_to", "digest", "n_bytes", "sha256", "header", "payload"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.binary()]
    buffer, need = bytearray(), 0
    for batch in batches:
        rows, held = [], 0
        for piece in batch.column(0).to_pylist():
            buffer += piece
            buffer += end
            while len(buffer) >= need:
                if buffer.startswith(end):  # a file's last piece had no separator
                    del buffer[:4]
                head_end = buffer.find(end)
                if head_end < 0:
                    break
                head = bytes(buffer[: head_end + 4])
                fields = _fields(head)
                need = head_end + 8 + int(fields["content-length"])
                if len(buffer) < need:
                    break
                if buffer[need - 4 : need] != end or not head.startswith(b"WARC/"):
                    raise ValueError("a record's declared length does not meet its end")
                block = bytes(buffer[head_end + 4 : need - 4])
                del buffer[:need]
                need = 0
                at = block.find(end) + 4
                payload = block[at:] if fields["warc-type"] == "response" else None
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                rows.append((_name(fields["warc-record-id"]), fields["warc-type"], _name(fields.get("warc-refers-to")), digest,
                             None if payload is None else len(payload),
                             None if payload is None else hashlib.sha256(payload).hexdigest(), head + block[:at], payload))
                held += len(payload or b"")
                if not buffer:
                    break
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    if bytes(buffer) not in (b"", end):
        raise ValueError("an archive ends inside a record")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(name, record_type, refers_to, digest, n_bytes, sha256, header, payload) of every record, digests verified.

    Gzip files are read whole by one task each, in order, so records that the separator cut come together again.
    """
    pieces = spark.read.option("lineSep", _END).text(folder).select(F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(
        _records, "name string, record_type string, refers_to string, digest string, n_bytes long, sha256 string, "
                  "header binary, payload binary")


def store_records(records: DataFrame, folder: str) -> None:
    """Keep payload bytes once per SHA-256 and all headers apart, in one pass over the records.

    Payloads that several responses carry are listed first by digest; of each the response with the least name is
    kept. Where no digest repeats, nothing but digests is shuffled.
    """
    listed = records.where("record_type = 'response'").select("name", "sha256", "header")
    again = stored(listed.groupBy("sha256").agg(F.min(F.struct("name", F.sha2("header", 256).alias("h"))).alias("keep"),
                                                F.count("*").alias("n")).where("n > 1").drop("n"))
    met = records.join(again, "sha256", "left")
    first = F.col("keep").isNull() | (
        F.col("keep.name").eqNullSafe(F.col("name")) & (F.col("keep.h") == F.sha2("header", 256)))
    none = lambda kind: F.lit(None).cast(kind)
    header = F.struct(F.lit("header").alias("kind"), "name", "record_type", "refers_to", "digest", "sha256", "header",
                      none("binary").alias("payload"))
    payload = F.struct(F.lit("payload").alias("kind"), none("string").alias("name"), none("string").alias("record_type"),
                       none("string").alias("refers_to"), "digest", "sha256", none("binary").alias("header"), "payload")
    both = F.when(F.col("payload").isNotNull() & first, F.array(header, payload)).otherwise(F.array(header))
    met.select(F.inline(both)).write.option("compression", "zstd").partitionBy("kind").parquet(folder)


def reconstruct(spark: SparkSession, folder: str) -> DataFrame:
    """(name, record_type, refers_to, digest, header, payload): every record with its full payload."""
    rows = spark.read.parquet(folder)
    headers = rows.where("kind = 'header'").select("name", "record_type", "refers_to", "digest", "header")
    payloads = rows.where("kind = 'payload'").select("digest", "sha256", "payload")
    # Identical rows of a repeated page leave identical payload rows: same name, same header, same bytes.
    repeated = stored(payloads.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1"))
    single = payloads.join(repeated, "sha256", "left_anti")
    rest = payloads.join(repeated, "sha256", "left_semi").dropDuplicates(["sha256"])
    return headers.join(single.unionByName(rest).drop("sha256"), "digest")


def op7_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives into the store, and report the reconstructed records."""
    pages = load(spark, sf_dir, "pages")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/quillspan/{uuid.uuid4().hex}"
    write_archives(pages, f"{folder}-warc")
    store_records(read_archives(spark, f"{folder}-warc"), f"{folder}-store")
    kind = pages.schema["page_id"].dataType
    return reconstruct(spark, f"{folder}-store").select(
        F.col("name").cast(kind).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest, n) ELSE page_id END AS response FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM r
"""

QUERIES: dict[str, Builder] = {"op7_content_addressed_warc": op7_content_addressed_warc}
SQL: dict[str, str] = {"op7_content_addressed_warc": OP7_SQL}
