"""WARC archives through a chunked record table: payloads move as rows of record identifier and chunk number.

Writing cuts payloads into chunk rows in the JVM; Python tasks stream them into gzip members, one a record. Reading
streams an archive's members back into chunk rows, each with the bytes, the CRC-32 and the SHA-256 of the payload up to its end.
No Python task holds more than a batch of chunks, however large a record is.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, new_folder, small_batches, table

CHUNK_BYTES = 1 << 16
#: Payloads below this are never replaced by a revisit.
MIN_REVISIT = 100
ARCHIVE_BYTES = 1 << 30
#: Payload bytes to a writing task at least, once each core has three: archives are not to be many small files.
TASK_BYTES = 1 << 27
#: Archive bytes that one task reads in a row, and reading tasks to a core at most: a task has several blocks of large inputs.
READ_BYTES, READ_WAVES = 1 << 23, 64
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, file string, offset long, length long"
CHUNKS = "record_id string, record_type string, refers_to string, target_uri string, payload_bytes long, payload_digest string, chunk_no long, last boolean, bytes_so_far long, crc32_so_far long, sha256_so_far string, chunk binary"


def revisits(records: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(id, digest, refers_to) of the records (id, digest, n_bytes) whose payload a record of a smaller id has as well.

    The least id of a digest is aggregated before the shuffle; a digest that many records share meets it in a join whose large
    partitions AQE can split. A null id is never replaced, nor referred to.
    """
    long_enough = records.where((F.col("n_bytes") >= min_bytes) & F.col("id").isNotNull())
    first = long_enough.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("_last")).where("_last > refers_to").drop("_last")
    return long_enough.select("id", "digest").join(first, "digest").where("id > refers_to").select("id", "digest", "refers_to").distinct()


def chunked(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk rows of records that have a column payload (binary): at least one row each, in order, in the record's own task."""
    n = F.greatest(F.ceil(F.octet_length("payload") / chunk_bytes), F.lit(1)).cast("int")
    out = records.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("n_chunks", n).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return out.withColumn("payload", F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)))


def _header(record_id: str, refers_to: str | None, uri: str | None, n_bytes: int, digest: str) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header that begins the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    length = len(http) + (n_bytes if refers_to is None else 0)
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_archives(records: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES, total_bytes: int | None = None) -> DataFrame:
    """Writes records (record_id, refers_to: null for a response, target_uri, digest, payload binary) and returns the index: record_id, file, offset, length.

    Each task writes files of its own names under the folder's URI and the stored index names the files of the tasks
    that succeeded (total_bytes of payloads, if known, bounds their number), so what a lost executor left behind is never read. The payload's digest is taken anew chunk by chunk and
    a record that does not have the digest that its header states fails the task.
    """
    spark = records.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        squeeze = digest = None
        begun = 0

        def put(data: bytes) -> None:
            nonlocal at
            out.write(data)
            at += len(data)

        for b in batches:
            index: list[tuple[str, str, int, int]] = []
            cols = {n: b.column(n).to_pylist() for n in b.schema.names}
            for i in range(b.num_rows):
                chunk, last = cols["payload"][i], cols["chunk_no"][i] == cols["n_chunks"][i] - 1
                if cols["chunk_no"][i] == 0:
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    head, http = _header(cols["record_id"][i], cols["refers_to"][i], cols["target_uri"][i], cols["n_bytes"][i], cols["digest"][i])
                    squeeze, digest, begun = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha256(), at
                    put(squeeze.compress(head + http))
                digest.update(chunk)
                if cols["refers_to"][i] is None:
                    put(squeeze.compress(chunk))
                if last:
                    if digest.hexdigest() != cols["digest"][i]:
                        raise ValueError(f"{cols['record_id'][i]}: the payload does not have the digest {cols['digest'][i]}")
                    put(squeeze.compress(b"\r\n\r\n") + squeeze.flush())
                    index.append((cols["record_id"][i], f"{folder}/{name}", begun, at - begun))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in index], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["record_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    small_batches(spark, 200)  # of chunk rows
    if total_bytes is not None:
        records = records.coalesce(max(3 * spark.sparkContext.defaultParallelism, total_bytes // TASK_BYTES))
    rows = chunked(records, chunk_bytes).select("record_id", "refers_to", "target_uri", "digest", "n_bytes", "n_chunks", "chunk_no", "payload")
    return materialise(spark, rows.mapInArrow(run, INDEX), "index")


class _Member:
    """One gzip member of an archive, read forward a little at a time."""

    def __init__(self, source, length: int):
        self.source, self.left, self.z, self.held = source, length, zlib.decompressobj(31), b""

    def _more(self, want: int) -> bool:
        if self.z.eof:
            return False
        raw = self.z.unconsumed_tail
        if not raw and self.left:
            raw = self.source.read(min(self.left, 1 << 16))
            self.left -= len(raw)
        if not raw:
            return False
        self.held += self.z.decompress(raw, want)
        return True

    def line(self) -> bytes:
        while (end := self.held.find(b"\r\n")) < 0:
            if not self._more(1 << 12):
                raise ValueError("an archive ends inside a header")
        got, self.held = self.held[:end], self.held[end + 2 :]
        return got

    def headers(self) -> dict[str, str]:
        out = {"": self.line().decode()}
        while line := self.line():
            k, _, v = line.decode().partition(":")
            out[k.strip().lower()] = v.strip()
        return out

    def bytes(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more(n - len(self.held)):
                raise ValueError("an archive ends inside a record")
        got, self.held = self.held[:n], self.held[n:]
        return got


def _records(source, length: int, chunk_bytes: int) -> Iterator[tuple]:
    """The chunk rows of one record."""
    member = _Member(source, length)
    warc = member.headers()
    size = int(warc["content-length"])
    http = member.headers()
    declared = int(http["content-length"])
    kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha256:")
    fixed = (warc["warc-record-id"].strip("<>"), kind, warc["warc-refers-to"].strip("<>") if "warc-refers-to" in warc else None, warc.get("warc-target-uri"), declared, digest)
    if kind == "revisit":
        yield (*fixed, 0, True, 0, 0, None, None)
        return
    sha, crc, at, no = hashlib.sha256(), 0, 0, 0
    while True:
        chunk = member.bytes(min(chunk_bytes, declared - at))
        sha.update(chunk)
        crc, at = zlib.crc32(chunk, crc), at + len(chunk)
        last = at == declared
        if last and (sha.hexdigest() != digest or member.bytes(4) != b"\r\n\r\n" or size < declared):
            raise ValueError(f"{fixed[0]}: the archive is damaged")
        yield (*fixed, no, last, at, crc, sha.hexdigest(), chunk)
        no += 1
        if last:
            return


def read_archives(index: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """The chunk rows (CHUNKS) of the indexed records; a revisit is one row without digests of its own. Without with_payload the chunks are checked and left out.

    Records of one block of a file are read by one task, in their order. Blocks are dealt out by hash, so no samples of the index
    reach the driver, and the number of tasks is bounded.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, min(-(-total // READ_BYTES), READ_WAVES * index.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"payload_bytes": pa.int64(), "chunk_no": pa.int64(), "last": pa.bool_(), "bytes_so_far": pa.int64(), "crc32_so_far": pa.int64(), "chunk": pa.binary()}
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        opened, source = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], types.get(n, pa.string())) for j, n in enumerate(names)], names=names)

        for b in batches:
            rows: list[tuple] = []
            held = 0
            for file, offset, length in zip(*(b.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True):
                if file != opened:
                    if source is not None:
                        source.close()
                    store, path = fs.FileSystem.from_uri(file)
                    opened, source = file, store.open_input_file(path)
                source.seek(offset)
                for row in _records(source, length, chunk_bytes):
                    rows.append(row if with_payload else (*row[:-1], None))
                    held += len(row[-1] or b"") if with_payload else 64
                    if held >= 1 << 23:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    blocks = index.repartition(parts, "file", F.floor(F.col("offset") / READ_BYTES))
    return blocks.sortWithinPartitions("file", "offset").mapInArrow(run, CHUNKS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through archives and back: what each page's record says after it has been read again."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("id"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    digests = materialise(spark, pages.select("id", "digest", F.octet_length("payload").alias("n_bytes")), "digests")  # payloads are scanned once for these, once to be written
    total = digests.agg(F.sum("n_bytes")).first()[0] or 0
    again = revisits(digests)
    again = again.select("id", "digest", _urn("refers_to").alias("refers_to"))
    records = pages.join(again, ["id", "digest"], "left").withColumn("record_id", F.coalesce(_urn("id"), F.lit("urn:page:null")))
    rows = read_archives(write_archives(records, new_folder(spark, "warc"), total_bytes=total), with_payload=False).where("last")
    number = lambda c: F.try_element_at(F.split(c, ":"), F.lit(3)).try_cast("long")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def _urn(c: str):
    return F.concat(F.lit("urn:page:"), F.col(c).cast("string"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100"""
