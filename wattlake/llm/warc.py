"""WARC archives: written one gzip member per record, read back sequentially.

Payloads are deduplicated before writing: of records with equal payloads the
one with the smallest id becomes a ``response``, the others ``revisit`` records
that name it and carry no payload. Only narrow ``(digest, id)`` rows are grouped;
the digests with copies are joined back to the pages, so a digest shared by a
third of all pages is one row on one side of that join.

Each task writes archives of about ``archive_bytes`` into the folder shared by
the cluster and returns one manifest row per finished archive. Archive names
are unique to an attempt and only the manifest rows that Spark commits count, so
archives of a failed or repeated attempt are never read. An archive is read by
one task, in constant memory but for one record: chunks go through an
incremental zlib object, a member's end starts the next record, and
``Content-Length`` frames its block.

Defined cases: a null payload is the empty payload; rows that repeat an id and
its payload share its role; a null id counts as larger than any other and reads
back as null; a null URL leaves out its header; line breaks in a URL are
percent-encoded; an empty table gives no archive and an empty result; a digest,
length or framing that does not hold is an error; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattlake.llm.common import stored
from wattlake.session import scratch_dir

ARCHIVE_BYTES = 32_000_000
CHUNK = 1 << 20
#: Bytes of archives that one task reads.
READ_BYTES = 1_000_000_000
#: A payload with more than this share of all copies is frequent.
HEAVY = 1e-3
VERSION = b"WARC/1.1\r\n"
ID_PREFIX, ID_SUFFIX = "<urn:x-page:", ">"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n") + deflate.flush()


def page_record(page_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"{ID_PREFIX}{page_id}{ID_SUFFIX}"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        headers.append(("WARC-Refers-To", f"{ID_PREFIX}{refers_to}{ID_SUFFIX}"))
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    return record(headers, block)


def members(stream) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one at a time."""
    rest, done = b"", False
    while True:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not rest and not done:
                rest = stream.read(CHUNK)
                done = not rest
            if done and not rest:
                if parts:
                    raise ValueError("archive ends inside a record")
                return
            parts.append(inflate.decompress(rest))
            rest = inflate.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, framed by its content length."""
    head, found, body = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines[1:])}
    length = int(headers["content-length"])
    if body[length:] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('warc-record-id')} is not framed by its content length")
    block = body[:length]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"block digest of {headers.get('warc-record-id')} does not hold")
    return headers, block


def read_records(stream) -> Iterator[tuple]:
    """Fields of ``RECORD`` and the payload of each response and revisit record."""
    for member in members(stream):
        headers, block = parse(member)
        kind = headers["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        fields = dict(line.lower().split(b": ", 1) for line in http.split(b"\r\n")[1:])
        size = int(fields[b"content-length"])
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its length and digest")
        yield (
            headers["warc-record-id"], kind, headers.get("warc-target-uri"), headers.get("warc-refers-to"), size, digest,
            payload if kind == "response" else None,
        )


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``(id, url, payload, digest, refers_to, revisit)`` of every row."""
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    copies = stored(
        rows.where(F.length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
    )
    # Payloads with a share of all copies are settled by a broadcast of at most 1 / HEAVY rows; the rest shuffle by digest,
    # the settled ones by their id.
    limit = HEAVY * (copies.agg(F.sum("n")).first()[0] or 0)
    heavy = copies.where(F.col("n") > limit).select("digest", F.col("first_id").alias("heavy_id"), F.lit(True).alias("settled"))
    other = copies.where(F.col("n") <= limit).select(F.col("digest").alias("key"), F.col("first_id").alias("other_id"))
    joined = rows.join(F.broadcast(heavy), "digest", "left")
    key = F.when(F.col("settled"), F.concat(F.lit("-"), F.xxhash64("id"))).otherwise(F.col("digest"))
    joined = joined.withColumn("key", key).join(other, "key", "left").withColumn("first_id", F.coalesce("heavy_id", "other_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select("id", "url", "payload", "digest", "first_id", revisit.alias("revisit"))


def write_archives(
    pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes the archives and returns their manifest ``(path, records, bytes)``."""
    folder = scratch_dir(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Named by a scheme that pyarrow knows; a bare path is a shared mount.
        fs, top = pafs.FileSystem.from_uri(folder)
        out = path = None
        records = size = 0
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, first_id, revisit = (c[i].as_py() for c in columns)
                if out is None:
                    fs.create_dir(top, recursive=True)
                    path = f"{top}/{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(path, compression=None)
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"),
                                      ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n"))
                data = page_record(
                    "" if page_id is None else str(page_id), url, payload,
                    base64.b32encode(bytes.fromhex(digest)).decode(), str(first_id) if revisit else None, date,
                )
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    yield _manifest(path, records, size)
                    out, records, size = None, 0, 0
        if out is not None:
            out.close()
            yield _manifest(path, records, size)

    # Written as a table, so each archive is named by exactly one committed attempt.
    return stored(
        with_roles(pages, id_col, url_col, payload_col, min_bytes).mapInArrow(write, "path string, records long, bytes long")
    )


def _manifest(path: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"]
    )


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of all archives of a manifest, verified; ``payload`` is null for revisits.

    ``payloads=False`` verifies payloads but does not return them.
    """
    base = scratch_dir(manifest.sparkSession)  # names the file system of the shared folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for row in read_records(stream):
                        rows.append(row)
                        size += len(row[-1] or b"") * payloads + 200
                        if size > 4 * CHUNK:
                            yield _records(rows, names, payloads)
                            rows, size = [], 0
                    if rows:
                        yield _records(rows, names, payloads)

    # Archives are of one size, so parts of as many of them hold READ_BYTES, and fewer only to keep all cores busy.
    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = min(n, max(manifest.sparkSession.sparkContext.defaultParallelism, size // READ_BYTES + 1))
    schema = RECORD + (", payload binary" if payloads else "")
    return manifest.select("path").repartition(max(1, parts)).mapInArrow(read, schema)


def _records(rows: list[tuple], names: list[str], payloads: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names] + [pa.binary()] * payloads
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
    return pa.RecordBatch.from_arrays(arrays, names + ["payload"] * payloads)
