"""WARC archives: a writer with revisit records and a splittable reader.

Method of the reader: an archive (one gzip member per record) is cut into byte ranges. A task scans its range for the
gzip magic, validates each candidate by decoding the member's header and start, and owns the records whose members
start inside the range, reading past the range's end to finish the last one. A false magic inside
compressed data doesn't decode to a record and is passed over.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetfacts.llm.common import cut_lineage, read_table, staging_folder

# Payloads of at least this many bytes are written once.
REVISIT_BYTES = 1_000
RANGE_BYTES = 8_000_000
# A reading task is meant to get about this many bytes of archives.
TASK_BYTES = 64_000_000
_BLOCK = 1 << 20
_MAGIC = b"\x1f\x8b\x08"

MANIFEST = "path string, size long, records long"
RECORDS = (
    "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
)


def _open_folder(uri: str):
    """(filesystem, path) of a local path or of a URI that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _header(text: str | None) -> str:
    """A header value: percent-encoded where it isn't printable ASCII, so that it fits one line."""
    return "".join(c if " " < c <= "~" and c != "%" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def _unheader(text: str) -> str:
    from urllib.parse import unquote

    return unquote(text)


def record_bytes(page_id, url, record_type: str, payload: bytes | None, payload_bytes: int, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    if record_type == "response":
        block += payload or b""
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if record_type == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def parse_record(data: bytes) -> dict | None:
    """The fields of an uncompressed record, None if it isn't a whole WARC record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.") or not found:
        return None
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:])
    number = lambda key: (lambda v: int(v) if v else None)(fields.get(key, "").removeprefix("<urn:page:").removesuffix(">"))
    response = fields["WARC-Type"] == "response"
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number("WARC-Record-ID"), "url": None if url is None else _unheader(url),
        "record_type": fields["WARC-Type"], "payload": payload if response else None,
        "payload_bytes": len(payload) if response else int(http_fields["Content-Length"]),
        "payload_digest": hashlib.sha1(payload).hexdigest() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number("WARC-Refers-To"),
    }


def _write_batches(folder: str):
    def run(batches):
        from pyarrow import fs  # noqa: F401

        system, root = _open_folder(folder)
        # A task that is repeated writes another file; only files that a finished task reports are read.
        path, size, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
        stream = None
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(path, compression=None)
                data = record_bytes(
                    row["page_id"], row["url"], row["record_type"], row["payload"], row["payload_bytes"],
                    row["payload_digest"], row["refers_to"],
                )
                stream.write(data)
                size += len(data)
                records += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [path], "size": pa.array([size], pa.int64()), "records": pa.array([records], pa.int64())}
            )

    return run


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages with the fields of their records. Of equal payloads of at least `least` bytes, the row (or rows) with the
    largest page_id is a response and the others revisit it; where no page_id is known all are responses."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    # Digests first: payloads aren't moved. Only digests met more than once go on.
    last = (
        rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("digest"))
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL").drop("n")
    )
    joined = rows.join(
        last, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= least), "left"
    )
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select(
        "page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, F.col("last")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages as archives below `folder`, one file a task, and return their manifest (path, size, records).

    A null html is an empty payload; a null url is left out; repeated rows are records of their own; a null
    page_id is an empty record id. Columns other than page_id, url and html are not looked at. The manifest is a
    written table, so that reading it again writes nothing.
    """
    return cut_lineage(plan_records(pages).mapInArrow(_write_batches(folder), MANIFEST), "manifest")


def _member(stream, start: int, size: int) -> tuple[bytes | None, int]:
    """(record data, end) of the gzip member at `start`; None if it doesn't decode to a WARC record."""
    stream.seek(start)
    decoder, out, position = zlib.decompressobj(wbits=31), bytearray(), start
    try:
        while not decoder.eof:
            piece = stream.read(min(_BLOCK, size - position) if out else min(4096, size - position))
            if not piece:
                return None, start
            position += len(piece)
            out += decoder.decompress(piece)
            if len(out) >= 7 and not out.startswith(b"WARC/1."):
                return None, start
    except zlib.error:
        return None, start
    return bytes(out), position - len(decoder.unused_data)


def range_records(stream, size: int, start: int, end: int):
    """Records whose members start in [start, end), in order."""
    position = start
    while position < end:
        stream.seek(position)
        # A magic that begins in the range may end beyond it.
        block = stream.read(min(_BLOCK, end - position) + len(_MAGIC) - 1)
        at = block.find(_MAGIC)
        if at < 0:
            if position + len(block) >= min(size, end):
                return
            position += max(1, len(block) - len(_MAGIC) + 1)
            continue
        if position + at >= end:
            return
        data, after = _member(stream, position + at, size)
        record = parse_record(data) if data is not None else None
        if record is None:
            position += at + 1
        else:
            yield record
            position = after


def _read_batches(folder: str):
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
    ])

    def run(batches):
        system, _ = _open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(row["path"]) as stream:
                    rows, held = [], 0
                    for record in range_records(stream, row["size"], row["start"], row["end"]):
                        rows.append(record)
                        held += record["payload_bytes"]
                        if held > 4_000_000 or len(rows) >= 1_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(manifest: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of archives listed as (path, size); each byte range of `range_bytes` is a unit of work.

    Ranges are dealt out by number. Their rows are tiny, so by size Spark would give all of them to one task.
    """
    total = manifest.agg(F.sum("size")).first()[0] or 0
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = manifest.select(
        "path", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("size") - 1), F.lit(range_bytes))).alias("start")
    ).select("path", "size", "start", F.least("size", F.col("start") + range_bytes).alias("end"))
    return ranges.repartition(tasks).mapInArrow(_read_batches(folder), RECORDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = staging_folder(spark, "warc")
    manifest = write_archives(read_table(spark, sf_dir, "pages", "page_id", "url", "html"), folder)
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
l AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN l USING (payload_digest)
"""
