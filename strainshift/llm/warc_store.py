"""Content-addressed WARC archive.

Two tables: payloads, each distinct payload once under its SHA-256, compressed; and
headers, one row per record with the record's exact header block. A record is rebuilt by
joining its header to its payload; the payload is checked against its address and its
Payload-Digest when it is read.

Which record of a group is the response is decided on digests alone, so the groups of
copies, however large, are pre-aggregated narrow rows; payload bytes are shuffled once to
be filed and once, compressed, to be joined back.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainshift.session import shared_folder

#: Fixed value: the time every record carries; a real crawl passes its own column.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_header(kind: str, page, url: str | None, digest: str, length: int, refers_to=None,
                  refers_url: str | None = None, date: str = DATE) -> bytes:
    """The header block of a record, up to and with the empty line."""
    urn = lambda key: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{key}')}>"
    clean = lambda text: (text or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page)}", f"WARC-Target-URI: {clean(url)}",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Refers-To-Target-URI: {clean(refers_url)}",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html", f"Content-Length: {0 if kind == 'revisit' else length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _digested(pages: DataFrame) -> DataFrame:
    """page, url, html bytes, address and size; natively, on the way out of the scan."""
    data = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page", "url", data.alias("html")).withColumn(
        "address", F.unhex(F.sha2("html", 256))).withColumn("size", F.length("html").cast("long"))


def write_archive(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html",
                  least: int = 0) -> None:
    """File every row of pages as a WARC record under path/payloads and path/headers.

    Of the records with one payload of at least `least` bytes, that with the smallest page
    is the response and the others revisit it; smaller payloads are responses all, but are
    stored once too. Null html is the empty payload; a null page is smaller than any other;
    of rows that repeat a page, the one of the smallest url (null first) is the response.
    """
    rows = _digested(pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.col(html).alias("html")))

    def pack(batches):
        """Compress each payload the first time this task meets its address (32 bytes are kept of it)."""
        squeeze, met = zstandard.ZstdCompressor(level=LEVEL), set()
        for batch in batches:
            new = {a: i for i, a in reversed(list(enumerate(batch.column(0).to_pylist()))) if a not in met}
            met.update(new)
            packed = [squeeze.compress(batch.column(1)[i].as_py()) for i in new.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(packed, pa.binary())], ["address", "payload"])

    packed = rows.select("address", "html").mapInArrow(pack, "address binary, payload binary")
    packed.groupBy("address").agg(F.first("payload").alias("payload")).write.option(
        "compression", "uncompressed").parquet(f"{path}/payloads")

    kind = pages.schema[page].dataType.simpleString()
    first = rows.groupBy("address").agg(F.min(F.struct("page", "url")).alias("head"), F.count("*").alias("copies"))
    records = rows.select("page", "url", "address", "size", F.unhex(F.sha1("html")).alias("sha1")).join(first, "address")
    same = F.col("page").eqNullSafe(F.col("head.page")) & F.col("url").eqNullSafe(F.col("head.url"))
    revisit = (F.col("size") >= least) & (F.col("copies") > 1) & ~same
    records = records.select("page", "url", "address", "size", "sha1", revisit.alias("revisit"),
                             F.col("head.page").alias("refers_to"), F.col("head.url").alias("refers_url"))

    def head(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                kind_of = "revisit" if r["revisit"] else "response"
                out.append(record_header(kind_of, r["page"], r["url"], base64.b32encode(r["sha1"]).decode(), r["size"],
                                         r["refers_to"], r["refers_url"]))
            kinds = ["revisit" if v else "response" for v in batch.column("revisit").to_pylist()]
            refers = [x if v else None for x, v in zip(batch.column("refers_to").to_pylist(), batch.column("revisit").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page"), batch.column("address"), pa.array(kinds), pa.array(refers, batch.column("refers_to").type),
                 pa.array(out, pa.binary())], ["page", "address", "record_type", "refers_to", "header"])

    records.mapInArrow(head, f"page {kind}, address binary, record_type string, refers_to {kind}, header binary").write.option(
        "compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: page, record_type, refers_to, header, payload, payload_digest.

    Payloads are unpacked after the join and must have their address; a payload that has
    not, or is missing, ends the job.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    kind = headers.schema["page"].dataType.simpleString()

    def rebuild(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            data, digests = [], []
            for address, packed, header in zip(*(batch.column(c).to_pylist() for c in ("address", "payload", "header"))):
                if packed is None:
                    raise ValueError(f"no payload for {address.hex()}")
                payload = unpack.decompress(packed)
                digest = sha1_base32(payload)
                if hashlib.sha256(payload).digest() != address or f"\r\nWARC-Payload-Digest: sha1:{digest}\r\n".encode() not in header:
                    raise ValueError(f"payload {address.hex()} is damaged")
                data.append(payload)
                digests.append(digest)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page", "record_type", "refers_to", "header")), pa.array(data, pa.binary()),
                 pa.array(digests, pa.string())], ["page", "record_type", "refers_to", "header", "payload", "payload_digest"])

    return headers.join(payloads, "address", "left").mapInArrow(
        rebuild, f"page {kind}, record_type string, refers_to {kind}, header binary, payload binary, payload_digest string")


def new_archive(spark: SparkSession) -> str:
    """A path for an archive in the folder that all executors share."""
    return f"{shared_folder(spark)}/strainshift/warc-{uuid.uuid4().hex}"
