"""WARC archives: writing, a normaliser for monolithic gzip, and reading by offset index.

:func:`write_archives` writes one gzip stream over many records per file, as crawlers that compress whole files do. Such
a file can only be read from its start. :func:`normalise` inflates the stream once, rewrites every record as a gzip member
of its own and writes a sidecar index of (offset, length, type, id), so that :func:`read_archives` reads each record alone.
Each step returns a written manifest of its files; a task that runs again writes the same file again, under a name of its
own until it is complete. Memory holds one record at a time.

Defined results: a null payload is empty; of records with equal payloads of at least ``least_bytes`` bytes the smallest id
is the response and others revisit it; rows that repeat the smallest id with an equal payload are all responses; a null id
is a revisit if its payload has another id, else a response; a null url leaves its header out; line breaks in a url are
percent-encoded; an empty table gives an empty result; other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:glyphql:page:"
STEP = 1 << 20
#: Payload bytes after which a task begins a new file.
FILE_BYTES = 512 << 20
MANIFEST = "file string, records long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP headers of the response without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, raw[end + 4 : end + 4 + int(headers["content-length"])]


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an uncompressed stream, one at a time."""
    held = bytearray()
    need = 0
    for chunk in chunks:
        held += chunk
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x.partition(b":")[2]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError(f"the archive ends within a record, {len(held)} bytes after the last whole one")


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or more members."""
    inflate = zlib.decompressobj(31)
    fresh = True
    for chunk in chunks:
        while chunk:
            out = inflate.decompress(chunk, STEP)
            fresh = False
            if out:
                yield out
            chunk = inflate.unconsumed_tail
            if inflate.eof:
                chunk = inflate.unused_data
                inflate, fresh = zlib.decompressobj(31), True
    if not fresh:
        raise EOFError("the gzip stream is cut short")


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Output:
    """A file that appears under its name only when it is complete."""

    def __init__(self, path: str):
        self.fs, self.path = _open(path)
        context = TaskContext.get()
        self.own = f"{self.path}.{context.taskAttemptId() if context else os.getpid()}.tmp"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.stream = self.fs.open_output_stream(self.own, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        from pyarrow import fs

        self.stream.close()
        if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
            self.fs.delete_file(self.path)  # of an earlier attempt of this task
        self.fs.move(self.own, self.path)


def _read_chunks(path: str) -> Iterator[bytes]:
    files, at = _open(path)
    with files.open_input_stream(at, compression=None) as f:
        while chunk := f.read(STEP):
            yield chunk


def _with_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``id, url, payload, refers_to``. Only ids and digests are grouped; payloads stay where they are, unless many rows
    are revisits."""
    keyed = pages.select("id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")).where(F.col("n") >= least_bytes)
    least = keyed.groupBy("sha", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    again = keyed.join(least, ["sha", "n"]).where("first is not null and not (id <=> first)").select(F.col("id").alias("again_id"), F.col("sha").alias("again_sha"), "first")
    again = materialise(again.distinct(), "revisits")
    on = F.col("id").eqNullSafe(F.col("again_id")) & (F.sha1("payload") == F.col("again_sha"))
    return pages.join(again, on, "left").select("id", "url", "payload", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, out: str, level: int = 6) -> DataFrame:
    """Writes ``id, url, payload, refers_to`` as monolithic gzip files under ``out``; returns their written manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, n, size, sink = TaskContext.get().partitionId(), 0, 0, 0, None
        done: list[tuple[str, int]] = []

        def finish() -> None:
            sink.write(squeeze.flush())
            sink.close()
            done.append((path, n))

        for batch in batches:
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    path, n, size = f"{out}/part-{part:06d}-{k:03d}.warc.gz", 0, 0
                    sink, squeeze = _Output(path), zlib.compressobj(level, zlib.DEFLATED, 31)
                sink.write(squeeze.compress(record(page_id, url, payload, first)))
                n, size = n + 1, size + len(payload)
                if size >= FILE_BYTES:
                    finish()
                    sink, k = None, k + 1
        if sink is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["file", "records"])

    rows = pages.select("id", "url", F.col("payload").cast("binary").alias("payload"), "refers_to")
    return materialise(rows.mapInArrow(write, MANIFEST), "archives")


def normalise(archives: DataFrame, out: str, level: int = 6) -> DataFrame:
    """Each file of the manifest again under ``out``, with one member per record and ``<name>.idx`` beside it."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, counts = [], []
            for source in batch.column(0).to_pylist():
                path = f"{out}/{os.path.basename(source)}"
                sink, index, offset, n = _Output(path), _Output(f"{path}.idx"), 0, 0
                for raw in records_of(inflated(_read_chunks(source))):
                    headers, _ = parse(raw)
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(raw) + squeeze.flush()
                    sink.write(member)
                    index.write(f"{offset}\t{len(member)}\t{headers['warc-type']}\t{headers['warc-record-id']}\n".encode())
                    offset, n = offset + len(member), n + 1
                sink.close()
                index.close()
                files.append(path)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(counts, pa.int64())], ["file", "records"])

    return materialise(_each_alone(archives).mapInArrow(rewrite, MANIFEST), "normalised")


def _each_alone(manifest: DataFrame) -> DataFrame:
    """A task for each file."""
    return manifest.repartition(max(1, manifest.count()))


def read_archives(normalised: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``id, url, payload_bytes, payload_digest, record_type, refers_to``: each record read alone by its index entry.

    A payload that does not have the digest of its header stops the job."""
    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def rows(path: str) -> Iterator[tuple]:
        files, at = _open(path)
        index = b"".join(_read_chunks(f"{path}.idx")).decode().splitlines()
        with files.open_input_file(at) as f:
            for line in index:
                offset, length, kind, _ = line.split("\t")
                f.seek(int(offset))
                headers, block = parse(zlib.decompress(f.read(int(length)), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload), payload_digest(payload)) != (size, digest):
                    raise ValueError(f"{path}, offset {offset}: the payload does not have its header's length and digest")
                ids = [headers.get(k, "<>").strip("<>").removeprefix(ID) for k in ("warc-record-id", "warc-refers-to")]
                yield ids[0] or None, headers.get("warc-target-uri"), size, digest, kind, ids[1] or None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in rows(path):
                    held.append(row)
                    if len(held) == 2000:
                        yield _batch(held, names, types)
                        held = []
                yield _batch(held, names, types)

    out = _each_alone(normalised).mapInArrow(read, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("id", "refers_to")})


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back; one row per record."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    out = fresh_path(spark, "warc")
    raw = write_archives(_with_revisits(rows, least_bytes), f"{out}/monolithic")
    ready = normalise(raw, f"{out}/members")
    return read_archives(ready, rows.schema["id"].dataType.simpleString()).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the 160 bits: each letter is 5 of them, cut from the hexadecimal digest by way of its 8 groups of 5 digits.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS n, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS first FROM p),
g AS (SELECT page_id, n, first, list_transform(range(0, 8), lambda k: CAST('0x' || substr(x, CAST(1 + 5 * k AS INTEGER), 5) AS BIGINT)) AS v FROM h)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""
