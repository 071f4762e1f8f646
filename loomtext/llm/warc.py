"""WARC archives written from pages and read back as a table of payload chunks.

Writing: each task appends its pages' records to an archive in the shared folder, every record
a gzip member of its own, and starts the next archive at ``ARCHIVE`` bytes. Payloads are
deflated piece by piece, with their digest computed on the way. Of records with equal payloads
of at least ``revisit_bytes``, the one with the largest page id is the response and the others
are revisits without a body that name it. Equal payloads are found from (digest, length)
alone; html is never shuffled for it unless there are more repeated payloads than may be
broadcast, and then their hot digests are salted.

Reading: archives are inflated as streams; each record becomes rows (record id, chunk number)
with at most ``CHUNK`` payload bytes, running length and, on the last, the digest of the whole
payload, computed incrementally. No record is held in memory as a whole. A revisit has one
empty chunk; its payload's digest and length stand in its header.

Files are named by attempt, and the manifest lists only those of tasks that succeeded.

Defined results: a null payload is empty; empty payloads are responses of one empty chunk.
Null page ids and urls are kept as null. Rows that share the largest page id of a payload are
all responses; where all of a payload's ids are null, so are all its rows. Repeated rows give
repeated records. Other columns are ignored. An empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import bytesvec as bv
from .scratch import filesystem, materialize, new_path

CHUNK, ARCHIVE, REVISIT_BYTES, MAX_BROADCAST, SALTS = 1 << 20, 64 << 20, 1000, 200_000, 16

_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


class Writer:
    """Appends gzip-member records to one archive stream."""

    def __init__(self, stream):
        self.stream, self.records, self.size = stream, 0, 0

    def _member(self, pieces: Iterator[bytes]) -> None:
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        for p in pieces:
            self._put(z.compress(p))
        self._put(z.flush())
        self.records += 1

    def _put(self, raw: bytes) -> None:
        if raw:
            self.stream.write(raw)
            self.size += len(raw)

    def write(self, record: str, headers: dict[str, str], kind: str, payload: memoryview) -> None:
        """One record; its body is the payload, or nothing for a revisit."""
        body = payload if kind == "response" else payload[:0]
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record}>", "Content-Type: application/octet-stream"]
        lines += [f"{k}: {v}" for k, v in headers.items()]
        lines.append(f"Content-Length: {len(body)}")
        head = ("\r\n".join(lines) + "\r\n\r\n").encode()
        self._member(x for x in (head, *(body[i : i + CHUNK] for i in range(0, len(body), CHUNK)), b"\r\n\r\n"))


class Chunks:
    """Parses an archive fed in pieces; yields (headers, chunk number, bytes, last)."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk, self.buffer, self.z = chunk, bytearray(), zlib.decompressobj(31)
        self.headers: dict[str, str] | None = None
        self.left = self.number = 0

    def feed(self, raw: bytes) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
        more = bool(raw)
        while more:
            # bounded steps: a small piece may inflate to a large payload
            out = self.z.decompress(raw, self.chunk)
            self.buffer += out
            if self.z.eof:
                raw = self.z.unused_data
                self.z = zlib.decompressobj(31)
                more = bool(raw)
            else:
                raw = self.z.unconsumed_tail
                more = bool(raw) or len(out) == self.chunk
            yield from self._parse()

    def _parse(self) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
        while True:
            if self.headers is None:
                start = 0
                while self.buffer[start : start + 2] == b"\r\n":
                    start += 2
                end = self.buffer.find(b"\r\n\r\n", start)
                if end < 0:
                    return
                lines = self.buffer[start:end].decode("utf-8", "replace").split("\r\n")
                self.headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                del self.buffer[: end + 4]
                self.left, self.number = int(self.headers["content-length"]), 0
            n = min(self.left, self.chunk)
            if len(self.buffer) < n:
                return
            body = bytes(self.buffer[:n])
            del self.buffer[:n]
            self.left -= n
            last = self.left == 0
            yield self.headers, self.number, body, last
            self.number += 1
            if last:
                self.headers = None


def _clean(value: str) -> str:
    """A header value without line breaks, reversibly."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _restore(value: str | None) -> str | None:
    return None if value is None else value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def with_types(pages: DataFrame, page_id: str, url: str, payload: str, revisit_bytes: int, max_broadcast: int) -> DataFrame:
    """page_id, url, payload, target: the response's page id where the record is a revisit."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    digest, long = F.sha1(F.encode("payload", "UTF-8")), F.octet_length("payload") >= revisit_bytes
    keys = p.where(long).select(digest.alias("digest"), F.octet_length("payload").alias("n"), "page_id")
    # partial aggregates leave one row a task for a payload, however often it occurs
    repeated = keys.groupBy("digest", "n").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("many")).where("many > 1 and target is not null")
    repeated = materialize(repeated.select("digest", "target"), "repeated")
    many = repeated.count()
    if not many:
        return p.withColumn("target", F.lit(None).cast(p.schema["page_id"].dataType))
    p = p.withColumn("d", F.when(long, digest))
    if many <= max_broadcast:
        p = p.join(F.broadcast(repeated.withColumnRenamed("digest", "d")), "d", "left")
    else:
        salted = repeated.withColumnRenamed("digest", "d").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["d", "salt"], "left").drop("salt")
    return p.select("page_id", "url", "payload", F.when(~F.coalesce(F.col("target") == F.col("page_id"), F.lit(False)), F.col("target")).alias("target"))


def write_archives(pages: DataFrame, directory: str, page_id: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Write the archives; the manifest has path, records and bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(directory)
        fs.create_dir(folder, recursive=True)
        part, name, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        writer = stream = path = None
        for batch in batches:
            ids, urls, texts, to = batch.columns
            for k in range(batch.num_rows):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{number:05d}-{name}.warc.gz"
                    stream = fs.open_output_stream(path, compression=None)
                    writer = Writer(stream)
                data = memoryview(texts[k].as_buffer())
                sha = hashlib.sha1()
                for i in range(0, len(data), CHUNK):
                    sha.update(data[i : i + CHUNK])
                headers = {"WARC-Payload-Digest": f"sha1:{sha.hexdigest()}", "X-Payload-Length": str(len(data))}
                if ids[k].is_valid:
                    headers["X-Page-ID"] = _clean(str(ids[k].as_py()))
                if urls[k].is_valid:
                    headers["WARC-Target-URI"] = _clean(urls[k].as_py())
                if to[k].is_valid:
                    headers["X-Refers-To-Page"] = _clean(str(to[k].as_py()))
                record = uuid.uuid5(uuid.NAMESPACE_OID, f"{name} {number} {writer.records}")
                writer.write(str(record), headers, "revisit" if to[k].is_valid else "response", data)
                if writer.size >= ARCHIVE:
                    stream.close()
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": writer.records, "bytes": writer.size}], _MANIFEST)
                    writer, number = None, number + 1
        if writer is not None:
            stream.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": writer.records, "bytes": writer.size}], _MANIFEST)

    rows = with_types(pages, page_id, url, payload, revisit_bytes, max_broadcast)
    return rows.mapInArrow(bv.lean(run), "path string, records long, bytes long")


_CHUNKS = "record_id string, chunk int, last boolean, record_type string, page_id string, url string, refers_to string, data binary, payload_bytes long, payload_digest string"


def read_chunks(manifest: DataFrame, directory: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of archives. Length and digest run with the chunks: length so far, and the digest on the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(directory)
        names = [x.split()[0] for x in _CHUNKS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                parser, sha, size = Chunks(chunk), hashlib.sha1(), 0
                with fs.open_input_stream(path, compression=None) as f:
                    while raw := f.read(1 << 18):
                        for head, number, body, last in parser.feed(raw):
                            if number == 0:
                                sha, size = hashlib.sha1(), 0
                            sha.update(body)
                            size += len(body)
                            digest, length = sha.hexdigest() if last else None, size
                            if head["warc-type"] == "revisit":
                                digest, length = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                            rows.append((head["warc-record-id"][10:-1], number, last, head["warc-type"], _restore(head.get("x-page-id")), _restore(head.get("warc-target-uri")), _restore(head.get("x-refers-to-page")), body if with_data else None, length, digest))
                            held += len(body) * with_data + 200
                            if held > 4 << 20:
                                yield out()
                                rows.clear()
                                held = 0
        if rows:
            yield out()

    spread = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return manifest.select("path").repartition(spread, "path").mapInArrow(bv.lean(run), _CHUNKS)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all pages to archives and report each page's record as read back."""
    directory = new_path(pages.sparkSession, "warc")
    manifest = materialize(write_archives(pages, directory, page_id, url, payload), "manifest")
    kind = pages.schema[page_id].dataType
    c = read_chunks(manifest, directory, with_data=False).where("last")
    return c.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS n, sha1(h) AS d FROM p),
m AS (SELECT d, n, max(page_id) AS target FROM k WHERE n >= 1000 GROUP BY d, n)
SELECT k.page_id, CAST(k.n AS BIGINT) AS payload_bytes, k.d AS payload_digest,
  CASE WHEN m.target <> k.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.target <> k.page_id THEN m.target END AS refers_to
FROM k LEFT JOIN m ON k.d = m.d AND k.n = m.n
"""
