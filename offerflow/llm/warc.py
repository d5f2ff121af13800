"""WARC archives as chunked record tables.

A record is a run of rows ``(record_id, chunk_no, data)``: the header block in
chunk 0, then at most ``CHUNK`` bytes of payload in each row, packed as a gzip
member of its own, so that ``data`` in order is a ``.warc.gz`` stream and no
record has to be in memory as a whole. Each row carries the digest and length of
the payload so far. Readers take the rows of a record in order through one
running SHA-256.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_table_path, slices, utf8

CHUNK = 64 * 1024
LEAST_REVISIT = 100
#: All records carry the same date, so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
CHUNKS = "record_id string, chunk_no long, n_chunks long, data binary, so_far long, digest_so_far string"


def record_types(pages: DataFrame) -> DataFrame:
    """``page_id, digest, copies, record_type, first`` for each distinct page and payload; digests are summed before they meet.

    ``first`` is the page that a revisit refers to: its id, address and number of rows.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    rows = rows.groupBy("page_id", "digest").agg(F.max("size").alias("size"), F.count("*").alias("copies"), F.min("url").alias("url"))
    page = F.struct("page_id", "copies", "url")
    firsts = rows.filter((F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(page).alias("first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "digest", "copies",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("first"),
    )


def payload_chunks(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The payload of each page as gzip members with the running digest; every row of ``pages`` is a record of its own (``number``).

    Payloads are cut where they are read, so that tasks get chunks, never a payload.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"), F.monotonically_increasing_id().alias("number"))
    last = F.greatest(F.lit(0), F.floor((F.col("size") - 1) / chunk)).cast("int")
    cuts = rows.select("*", (last + 1).cast("long").alias("n_chunks"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    part = F.substring("html", F.col("chunk_no") * chunk + 1, F.lit(chunk))
    cuts = cuts.select("number", "page_id", "url", "digest", "size", F.col("chunk_no").cast("long").alias("chunk_no"), "n_chunks", part.alias("data"))
    names = [*cuts.columns, "so_far", "digest_so_far"]

    def run(batches):
        current, running, size = None, None, 0
        for batch in slices(batches, "data"):
            data, so_far, digests = [], [], []
            for number, part in zip(batch.column(0).to_pylist(), utf8(batch.column(7))):
                if number != current:
                    current, running, size = number, hashlib.sha256(), 0
                running.update(part)
                size += len(part)
                data.append(gzip.compress(part, 6, mtime=0))
                so_far.append(size)
                digests.append(running.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(data, pa.binary()), pa.array(so_far, pa.int64()), pa.array(digests, pa.string())], names)

    return cuts.mapInArrow(run, "number long, page_id long, url string, digest string, size long, chunk_no long, n_chunks long, data binary, so_far long, digest_so_far string")


def record_id(page_id, digest: str, copies: int, number: int) -> str:
    """By page and payload; rows that repeat both are told apart by their number."""
    return str(uuid.UUID(bytes=hashlib.sha256(f"{page_id} {digest} {number if copies > 1 else ''}".encode()).digest()[:16], version=4))


def _line(url) -> str:
    return (url or "").replace("\n", " ").replace("\r", " ")


def _header(record_type, url, name, page_id, first, digest, size) -> bytes:
    """The header block. A revisit names the record that it refers to, unless repeated rows of that page make it several."""
    revisit = record_type == "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: text/html; charset=utf-8",
        *([] if page_id is None else [f"Page-ID: {page_id}"]),
    ]
    if revisit:
        if first["copies"] == 1:
            lines.append(f"WARC-Refers-To: <urn:uuid:{record_id(first['page_id'], digest, 1, 0)}>")
        lines += [f"WARC-Refers-To-Target-URI: {_line(first['url'])}", f"WARC-Refers-To-Date: {DATE}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {0 if revisit else size}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archive(pages: DataFrame, target: str, chunk: int = CHUNK) -> None:
    """Write one record for each row of ``pages``: a response, or a revisit without payload.

    Of records with equal payloads of 100 bytes or more that with the smallest
    ``page_id`` is the response (all of them if rows repeat it). Null html is an
    empty payload; a null id is written without one and is never referred to
    unless it is alone. Other columns are not looked at. No rows: an empty archive.
    """
    types = record_types(pages).withColumnsRenamed({"page_id": "of_page", "digest": "of_digest"})
    chunks = payload_chunks(pages, chunk)
    joined = chunks.join(types, chunks["page_id"].eqNullSafe(types["of_page"]) & (chunks["digest"] == types["of_digest"]))
    kept = joined.filter((F.col("record_type") == "response") | (F.col("chunk_no") == 0))
    columns = ["number", "page_id", "url", "digest", "size", "chunk_no", "n_chunks", "so_far", "digest_so_far", "copies", "record_type", "first", "data"]

    def run(batches):
        for batch in slices(batches, "data"):
            rows = []
            for number, page_id, url, digest, size, k, n, so_far, running, copies, kind, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                name = record_id(page_id, digest, copies, number)
                if kind == "revisit":
                    rows.append((name, 0, 1, gzip.compress(_header(kind, url, name, page_id, first, digest, size) + b"\r\n\r\n", 6, mtime=0), 0, hashlib.sha256().hexdigest()))
                    continue
                head = gzip.compress(_header(kind, url, name, page_id, first, digest, size), 6, mtime=0) if k == 0 else b""
                end = gzip.compress(b"\r\n\r\n", 6, mtime=0) if k == n - 1 else b""
                rows.append((name, k, n, head + data + end, so_far, running))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["record_id", "chunk_no", "n_chunks", "data", "so_far", "digest_so_far"])

    kept.select(*columns).mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(target)


class RecordReader:
    """Takes the chunks of one record in order and keeps a running digest, never the payload."""

    def __init__(self):
        self.headers, self.head, self.left = None, b"", 0
        self.digest, self.size = hashlib.sha256(), 0

    def feed(self, data: bytes, so_far: int, digest_so_far: str) -> None:
        plain = gzip.decompress(data)
        if self.headers is None:
            self.head += plain
            at = self.head.find(b"\r\n\r\n")
            if at < 0:
                return
            lines = self.head[:at].decode().split("\r\n")
            self.headers = dict(line.split(": ", 1) for line in lines[1:] if ": " in line)
            self.left = int(self.headers["Content-Length"])
            plain, self.head = self.head[at + 4 :], b""
        part = plain[: self.left]
        self.left -= len(part)
        self.size += len(part)
        self.digest.update(part)
        if (self.size, self.digest.hexdigest()) != (so_far, digest_so_far):
            raise ValueError("damaged chunk")


def read_archive(spark, source: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record, from the archive alone.

    Records of one chunk are read where they lie; only the rows of longer ones
    are brought together. A revisit takes its length and the page that it refers to
    from the response with its payload digest.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string"

    def run(batches):
        current, reader = None, None

        def row():
            h = reader.headers
            if reader.left:
                raise ValueError("a record ends early")
            revisit = h["WARC-Type"] == "revisit"
            digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
            if not revisit and digest != reader.digest.hexdigest():
                raise ValueError("damaged record")
            return (int(h["Page-ID"]) if "Page-ID" in h else None, None if revisit else reader.size, digest, h["WARC-Type"])

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        for batch in slices(batches, "data"):
            rows = []
            for name, data, so_far, running in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if name != current:
                    if reader:
                        rows.append(row())
                    current, reader = name, RecordReader()
                reader.feed(data, so_far, running)
            if rows:
                yield batch_of(rows)
        if reader:
            yield batch_of([row()])

    chunks = spark.read.schema(CHUNKS).parquet(source)
    columns = ["record_id", "data", "so_far", "digest_so_far"]
    short = chunks.filter("n_chunks = 1").select(*columns)
    long = chunks.filter("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").select(*columns)
    records = short.mapInArrow(run, schema).unionByName(long.mapInArrow(run, schema))
    responses = records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"), F.min("page_id").alias("first"))
    found = records.join(responses, "payload_digest", "left")
    return found.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("first")).alias("refers_to"))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the archive of all pages to the shared folder and read it back."""
    target = new_table_path(pages.sparkSession, "warc")
    write_archive(pages, target)
    return read_archive(pages.sparkSession, target)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM r WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT r.page_id, r.payload_bytes, r.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND r.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id IS NOT NULL AND r.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM r LEFT JOIN f USING (payload_digest)
"""
