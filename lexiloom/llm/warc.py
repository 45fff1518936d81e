"""WARC archives written from and read back into chunked record tables."""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import arrow_rows, row_key, shared_input, shared_output
from lexiloom.operators.joins import spread_join
from lexiloom.session import cut_lineage, scratch_path

CHUNK_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DIGESTS = "record_id bigint, key bigint, payload_bytes bigint, payload_digest string"
READ = "record_id bigint, key bigint, chunk_no int, size int, data binary, record_type string, refers_to bigint, running_digest string, header_digest string, last boolean"
READ_FIELDS = [
    ("record_id", pa.int64()), ("key", pa.int64()), ("chunk_no", pa.int32()), ("size", pa.int32()), ("data", pa.binary()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("running_digest", pa.string()), ("header_digest", pa.string()), ("last", pa.bool_())]


def payload_chunks(pages: DataFrame, id_col: str, payload_col: str, uri_col: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record_id, key, chunk_no, data, uri): the chunked record table of a column of payloads.

    Chunks are numbered from 0 and hold at most ``chunk_bytes`` of the payload's UTF-8; a null or
    empty payload is one empty chunk. ``key`` is a hash of id and payload, so that records
    of one id stay apart; the uri stands in the first chunk only.
    """
    data = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "UTF-8")
    uri = F.col(f"`{uri_col}`") if uri_col else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("record_id"), row_key(id_col, payload_col).alias("key"), data.alias("data"), uri.alias("uri"))
    last = F.greatest(F.ceil(F.octet_length("data") / F.lit(chunk_bytes)).cast("int") - 1, F.lit(0))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return rows.select(
        "record_id", "key", "chunk_no", F.substring("data", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"),
        F.when(F.col("chunk_no") == 0, F.col("uri")).alias("uri"))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """(record_id, key, payload_bytes, payload_digest): SHA-1 in base32, carried from chunk to chunk.

    A record's chunks must stand together and in order, as ``payload_chunks`` gives them;
    ``in_order`` makes that so of any table.
    """
    return chunks.select("record_id", "key", "chunk_no", "data").mapInArrow(_digests, DIGESTS).distinct()


def in_order(chunks: DataFrame) -> DataFrame:
    return chunks.repartition("record_id", "key").sortWithinPartitions("record_id", "key", "chunk_no")


def _base32(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, digest, size, out = None, hashlib.sha1(), 0, []
    for record_id, key, chunk_no, data in arrow_rows(batches, "record_id", "key", "chunk_no", "data"):
        if chunk_no == 0:
            if at:
                out.append((*at, size, _base32(digest)))
            if len(out) == 10_000:
                yield _batch(out, _DIGEST_FIELDS)
                out = []
            at, digest, size = (record_id, key), hashlib.sha1(), 0
        digest.update(data)
        size += len(data)
    if at:
        out.append((*at, size, _base32(digest)))
    yield _batch(out, _DIGEST_FIELDS)


_DIGEST_FIELDS = [("record_id", pa.int64()), ("key", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]


def _batch(rows: list, fields: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def resolve_revisits(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to: of equal payloads of at least ``least_bytes`` the record
    with the largest id is the response, the others revisit it; smaller ones are all responses."""
    large = digests.where(F.col("payload_bytes") >= least_bytes)
    first = large.groupBy("payload_digest", "payload_bytes").agg(F.max("record_id").alias("first"))
    # a page copied very often is one hot digest
    out = spread_join(large, first, ["payload_digest", "payload_bytes"], spread_by=["record_id", "key"])
    revisit = ~F.col("record_id").eqNullSafe(F.col("first"))
    out = out.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")
    rest = digests.where(F.col("payload_bytes") < least_bytes).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("bigint")})
    return out.unionByName(rest)


def write_archives(chunks: DataFrame, records: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write one WARC record per row of ``records``; returns the manifest (part, file, n_records).

    A record's header row is dealt to the task of its chunks and sorted before them, so a record
    is written chunk by chunk, each record a gzip member of its own. Files get
    their names when complete, and the manifest names only those of tasks that succeeded.
    """
    heads = records.select(
        "record_id", "key", F.lit(-1).alias("chunk_no"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("uri"),
        "payload_bytes", "payload_digest", "record_type", "refers_to")
    none = {"payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    rows = in_order(chunks.select("*", *[F.lit(None).cast(t).alias(n) for n, t in none.items()]).unionByName(heads))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, n = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
        rows = arrow_rows(batches, "record_id", "key", "chunk_no", "data", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to")
        first = next(rows, None)
        if first is None:
            return
        with shared_output(folder, name) as stream:
            head, pack, seen = None, None, -1
            for record_id, key, chunk_no, data, uri, *fields in (r for source in ([first], rows) for r in source):
                if chunk_no == -1:
                    if pack:
                        stream.write(pack.compress(b"\r\n\r\n") + pack.flush())
                    head, pack, seen = fields, zlib.compressobj(1, zlib.DEFLATED, 31), -1
                    n += 1
                elif chunk_no > seen:  # the same record given twice is written once
                    if chunk_no == 0:
                        stream.write(pack.compress(_header(record_id, key, uri, date, *head)))
                    if head[2] == "response":
                        stream.write(pack.compress(data))
                    seen = chunk_no
            if pack:
                stream.write(pack.compress(b"\r\n\r\n") + pack.flush())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_records": pa.array([n], pa.int64())})

    return cut_lineage(rows.mapInArrow(write, "part int, file string, n_records bigint"), "manifest")


def _urn(record_id: int | None, key: int | None = None) -> str:
    return "urn:record:" + ("" if record_id is None else str(record_id)) + ("" if key is None else f":{key}")


def _header(record_id, key, uri, date, payload_bytes, payload_digest, record_type, refers_to) -> bytes:
    http = HTTP % payload_bytes
    lines = [
        ("WARC-Type", record_type), ("WARC-Record-ID", f"<{_urn(record_id, key)}>"), ("WARC-Date", date),
        ("WARC-Target-URI", urllib.parse.quote(uri, safe="!#$%&'()*+,/:;=?@[]~") if uri else _urn(record_id)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", len(http) + (payload_bytes if record_type == "response" else 0))]
    if record_type == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_urn(refers_to)}>")]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n" + http


class _Members:
    """The bytes of concatenated gzip members, inflated piece by piece."""

    def __init__(self, stream, piece: int = 1 << 18):
        self.stream, self.piece, self.held, self.inflate, self.rest = stream, piece, bytearray(), zlib.decompressobj(31), b""

    def _more(self) -> bool:
        raw = self.rest or self.stream.read(self.piece)
        if not raw:
            return False
        self.held += self.inflate.decompress(raw, 1 << 20)
        self.rest = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the file."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("torn archive")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError("torn archive")
            piece = bytes(self.held[:n])
            del self.held[: len(piece)]
            n -= len(piece)
            if piece:
                yield piece


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)}


def _int(s: str) -> int | None:
    return int(s) if s else None


def read_archive(stream, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> Iterator[tuple]:
    """Rows of the chunked record table of one archive: the payload in chunks of ``chunk_bytes``
    with the digest of all bytes up to each chunk's end; one chunk is in memory."""
    members = _Members(stream)
    while (head := members.until(b"\r\n\r\n")) is not None:
        warc = _fields(head.lstrip())
        record_id, _, key = re.match(r"<urn:record:(-?\d*)(:(-?\d+))?>", warc["warc-record-id"]).groups()
        length = int(warc["content-length"])
        http = members.until(b"\r\n\r\n")
        left, digest, chunk, nth, size = length - len(http), hashlib.sha1(), [], 0, 0
        refers = re.match(r"<urn:record:(-?\d*)", warc.get("warc-refers-to", ""))
        row = lambda last: (
            _int(record_id), _int(key), nth, size, b"".join(chunk) if with_data else None, warc["warc-type"],  # noqa: B023
            _int(refers[1]) if refers else None, _base32(digest), warc["warc-payload-digest"].removeprefix("sha1:"), last)  # noqa: B023
        while left:
            for piece in members.take(min(left, chunk_bytes - size)):
                digest.update(piece)
                size += len(piece)
                left -= len(piece)
                if with_data:
                    chunk.append(piece)
            if left:
                yield row(False)
                chunk, nth, size = [], nth + 1, 0
        yield row(True)
        if b"".join(members.take(4)) != b"\r\n\r\n":
            raise ValueError("record without its end")


def read_archives(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of all archives of a manifest, an archive a task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file,) in arrow_rows(batches, "file"):
            with shared_input(folder, file) as stream:
                held, nbytes = [], 0
                for row in read_archive(stream, chunk_bytes, with_data):
                    held.append(row)
                    nbytes += row[3] if with_data else 0
                    if len(held) == 5_000 or nbytes > 4 << 20:
                        yield _batch(held, READ_FIELDS)
                        held, nbytes = [], 0
                yield _batch(held, READ_FIELDS)

    n = max(1, manifest.count())
    return manifest.select("part", "file").repartitionByRange(n, "part").mapInArrow(read, READ)


def record_summaries(chunks: DataFrame, id_col: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to, digest_ok), from archives read back.

    A response's figures are those of its bytes; a revisit has the size of the record it refers to.
    """
    # a record's chunks add up; one row per record
    sizes = cut_lineage(chunks.groupBy("record_id", "key", "record_type", "refers_to", "header_digest").agg(
        F.sum(F.col("size").cast("bigint")).alias("payload_bytes"), F.max_by("running_digest", "chunk_no").alias("read_digest")), "summaries")
    full = sizes.where("record_type = 'response'")
    responses = full.select("record_id", "payload_bytes", F.col("read_digest").alias("payload_digest"), "record_type", "refers_to", (F.col("read_digest") == F.col("header_digest")).alias("digest_ok"))
    # ids may repeat with other payloads, so the digest is part of the reference
    targets = full.select(F.col("record_id").alias("refers_to"), F.col("read_digest").alias("header_digest"), "payload_bytes")
    revisits = spread_join(
        sizes.where("record_type = 'revisit'").drop("payload_bytes", "read_digest"), targets, ["refers_to", "header_digest"], how="left", spread_by=["record_id", "key"])
    revisits = revisits.select("record_id", "payload_bytes", F.col("header_digest").alias("payload_digest"), "record_type", "refers_to", F.col("payload_bytes").isNotNull().alias("digest_ok"))
    return responses.unionByName(revisits).withColumnRenamed("record_id", id_col)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", least_bytes: int = 0) -> DataFrame:
    """Write every page to archives in the shared folder and read them back, one row per record.

    Cases. A null payload is empty, and equal to an empty one. Null ids are written without one and
    are a response only where no other record has their payload. Rows of one id with different
    payloads are records of their own; wholly equal rows are one record. Payloads of any length
    go through in chunks. A null uri is replaced by the record's name. An empty table writes nothing
    and gives no rows. Other columns are not read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    chunks = payload_chunks(pages, id_col, payload_col, uri_col)
    records = resolve_revisits(cut_lineage(chunk_digests(chunks), "digests"), least_bytes)
    return record_summaries(read_archives(write_archives(chunks, records, folder), folder, with_data=False), id_col)
