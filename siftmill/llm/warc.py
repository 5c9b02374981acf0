"""WARC archives: write captures as request, response or revisit, and metadata records, read them back, assemble transactions.

Archives are written by Spark's text writer, whose line separator is set to the two line ends
that close a WARC record, so a file is a plain sequence of records and commits with its task.
Reading takes one file per task through the binary source and cuts records by Content-Length.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.session import shared_folder, written_table

END = "\r\n"
LEAST_REVISIT = 100  # payloads below this many bytes are always written in full
RECORD_DDL = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes bigint, payload binary, extra string"


def _urn(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"urn:capture:{kind}:"), key.cast("string"))


def _record(headers: dict, block) -> F.Column:
    """A record without its closing line ends; headers that are null are left out."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{END}{k}: "), v)) for k, v in headers.items()]
    return F.concat(F.lit("WARC/1.1"), F.concat_ws("", *lines), F.lit(f"{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END * 2), block)


def classify(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Add payload, digest, n_bytes and ``first_key``: the smallest key with an equal payload, null for small payloads.

    The smallest key per digest is a combined aggregate, so a payload that a third of the pages
    share is one row per task before the shuffle; the join back may be split by adaptive execution.
    """
    full = pages.withColumn("payload", F.coalesce(F.col(html), F.lit("")))
    full = full.withColumn("n_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    light = full.select(F.col("digest").alias("d"), F.col("n_bytes").alias("n"), F.col(key).alias("k")).filter(F.col("n") >= LEAST_REVISIT)
    repeated = light.groupBy("d").agg(F.min("k").alias("first_key"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    return full.join(repeated, F.col("digest") == F.col("d"), "left").drop("d")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", records_per_file: int = 30_000) -> None:
    """Write three records per row: request, response (or revisit of the first equal payload), metadata.

    A null html is an empty payload; a null url leaves Target-URI out. Keys name the records; those of
    repeated or null keys get a number besides, so every row keeps its three records. Of equal payloads
    all rows of the smallest key are responses; rows of a greater or null key are revisits, which refer
    to the response by its key. Payloads that only null keys have are responses. The key itself
    travels in the metadata record. Extra columns are not written.
    """
    pages = pages.select(key, url, html)
    k = F.col(key)
    # Written, so that their size is known: few repeated keys are broadcast and the payloads are not shuffled for them.
    repeated = written_table(pages.groupBy(key).count().filter((F.col("count") > 1) & k.isNotNull()).select(key, F.lit(True).alias("again")), "repeated-keys")
    p = classify(pages, key, html).join(repeated, key, "left")
    unique = F.concat(F.coalesce(k.cast("string"), F.lit("null")), F.lit(":"), F.monotonically_increasing_id().cast("string"))
    p = p.withColumn("name", F.when(k.isNull() | F.col("again"), unique).otherwise(k.cast("string")))
    revisit = F.col("first_key").isNotNull() & F.coalesce(F.col("first_key") < k, F.lit(True))
    target = F.regexp_replace(F.col(url), r"[\r\n]", " ")
    http_head = F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END * 2}")
    response_id = _urn("response", F.col("name"))
    request = _record(
        {"WARC-Type": F.lit("request"), "WARC-Record-ID": F.concat(F.lit("<"), _urn("request", F.col("name")), F.lit(">")), "WARC-Concurrent-To": F.concat(F.lit("<"), response_id, F.lit(">")), "WARC-Target-URI": target, "Content-Type": F.lit("application/http; msgtype=request")},
        F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{END * 2}")),
    )
    response = _record(
        {
            "WARC-Type": F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
            "WARC-Record-ID": F.concat(F.lit("<"), response_id, F.lit(">")),
            "WARC-Refers-To": F.when(revisit, F.concat(F.lit("<"), _urn("response", F.col("first_key")), F.lit(">"))),
            "WARC-Profile": F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            "WARC-Target-URI": target,
            "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest")),
            "Content-Type": F.lit("application/http; msgtype=response"),
        },
        F.concat(http_head, F.when(revisit, F.lit("")).otherwise(F.col("payload"))),
    )
    metadata = _record(
        {"WARC-Type": F.lit("metadata"), "WARC-Record-ID": F.concat(F.lit("<"), _urn("metadata", F.col("name")), F.lit(">")), "WARC-Concurrent-To": F.concat(F.lit("<"), response_id, F.lit(">")), "WARC-Target-URI": target, "Content-Type": F.lit("application/warc-fields")},
        F.concat(F.lit("page: "), F.coalesce(k.cast("string"), F.lit("")), F.lit(END)),
    )
    records = p.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parse(content: bytes) -> Iterator[dict]:
    """The records of one archive, cut by Content-Length."""
    if content[:2] == b"\x1f\x8b":
        content = zlib.decompress(content, 31)
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in content[at:head_end].decode().split(END)[1:])
        start = head_end + 4
        at = start + int(head["Content-Length"])
        block, kind = content[start:at], head["WARC-Type"]
        at += 4
        payload = block.split(b"\r\n\r\n", 1)[1] if kind in ("response", "revisit") else None
        if kind == "response" and head["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        yield {
            "record_id": head["WARC-Record-ID"][1:-1],
            "record_type": kind,
            "concurrent_to": head.get("WARC-Concurrent-To", "<>")[1:-1] or None,
            "refers_to": head.get("WARC-Refers-To", "<>")[1:-1] or None,
            "target_uri": head.get("WARC-Target-URI"),
            "payload_digest": head.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None,
            "payload_bytes": len(payload) if kind == "response" else None,
            "payload": payload if kind == "response" else None,
            "extra": block.decode() if kind == "metadata" else None,
        }


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record below ``path``. ``payloads=False`` leaves the payloads in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in (c.split()[0] for c in RECORD_DDL.split(", "))])
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for record in _parse(batch.column(0)[i].as_py()):
                    rows.append(record if payloads else record | {"payload": None})
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri and the nested request, response and metadata records.

    Requests and metadata name their response by concurrent-to; all three meet in one aggregate
    keyed by that id. Of repeated records of a kind the smallest record id is kept; a capture
    without a response has a null response, records that name nothing and are no response go.
    """
    kind = F.when(F.col("record_type").isin("response", "revisit"), F.lit("response")).otherwise(F.col("record_type"))
    fields = F.struct("record_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "extra", "target_uri")
    keyed = records.withColumn("kind", kind).withColumn("capture_id", F.when(F.col("kind") == "response", F.col("record_id")).otherwise(F.col("concurrent_to")))
    of = lambda name: F.min_by(F.when(F.col("kind") == name, fields), F.when(F.col("kind") == name, F.col("record_id"))).alias(name)
    out = keyed.filter("capture_id is not null").groupBy("capture_id").agg(of("request"), of("response"), of("metadata"))
    return out.select("capture_id", F.coalesce("response.target_uri", "request.target_uri", "metadata.target_uri").alias("target_uri"), "request", "response", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """Give revisits the payload length of the responses with their digest. Only digests that revisits name take part, and
    captures without one are matched by their own id, so that no null or common digest gathers them in one task."""
    revisits = captures.filter("response.record_type = 'revisit'").select(F.col("response.payload_digest").alias("first_id")).distinct()
    sizes = captures.filter("response.record_type = 'response'").groupBy(F.col("response.payload_digest").alias("first_id")).agg(F.max("response.payload_bytes").alias("first_bytes"))
    sizes = sizes.join(revisits, "first_id", "left_semi")
    asks = F.when(F.col("response.record_type") == "revisit", F.col("response.payload_digest")).otherwise(F.col("capture_id"))
    full = captures.join(sizes, asks == F.col("first_id"), "left")
    return full.withColumn("payload_bytes", F.coalesce("response.payload_bytes", "first_bytes")).drop("first_id", "first_bytes")


def archive_and_read(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Write archives below the shared folder, read and assemble them: one nested row per capture."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/siftmill/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, key)
    return resolve(assemble(read_records(spark, path, payloads=False)))
