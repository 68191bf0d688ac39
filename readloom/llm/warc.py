"""WARC archives by a chunked record table.

Writing: every page becomes a record. Its payload becomes rows (record, chunk_no, chunk) of ``CHUNK`` bytes, which
are dealt and sorted by record and stream into the gzip member of their record, with the digest carried along
from chunk to chunk: the writer holds one chunk. Of pages with equal payloads of at
least ``least`` bytes the one with the largest page_id is a response record; the others are revisit records,
which refer to it and hold its HTTP header only.

Reading: archives are read as streams. A record of any size becomes rows (record, chunk_no) with the
chunk's bytes and the SHA-1 of the payload up to and with that chunk, so no task holds a whole record; the
last chunk's digest is the payload's and must equal the header's.

Scale: which record is a response is decided on digests, without the payloads (those of one digest are
combined before the shuffle), and comes back to the pages by (page_id, digest). Digests of more than ``HOT`` ids
(that of the empty payload, say) are as few as the rows over ``HOT``: they are broadcast, and their rows not dealt. Archives are files of about
``FILE_BYTES`` in the shared folder; a retried task writes files of its own name and only the files of tasks
that ended are listed in the manifest, so lost executors leave no broken archive behind.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, shared_dir

CHUNK = 64 << 10
HOT = 1 << 20
FILE_BYTES = 64 << 20
#: Fixed value: the alphabet of base 32 (RFC 4648), as SQL text.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
STAMP = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, bytes, winner) once for each pair of page_id and digest: winner is the response's page_id, null if payloads of that size are never revisits."""
    keyed = pages.select("page_id", payload("html").alias("payload")).select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes"))
    keyed = settle(keyed.distinct())
    best = keyed.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("winner"), F.lit(True).alias("shared"), F.count("*").alias("ids"))
    best = settle(best)
    hot = F.broadcast(best.filter(F.col("ids") > HOT).drop("ids"))  # rows / HOT at most
    rest = keyed.join(hot.select("digest"), "digest", "left_anti").join(best.filter(F.col("ids") <= HOT).drop("ids"), "digest", "left")
    return rest.unionByName(keyed.join(hot, "digest"))


def payload(html: str):
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


def _name(page_id: object, digest: str, number: int = 0) -> str:
    """Identifier of a record: of the page, its payload, and the number of the record among those that agree in both."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}:{number}>"


def _id(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").split(":")[0]
    return int(digits) if digits else None


def base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


class Member:
    """One gzip member, written in chunks."""

    def __init__(self, to):
        self.to, self.zip, self.written = to, zlib.compressobj(1, zlib.DEFLATED, 31), 0

    def add(self, data: bytes) -> None:
        if made := self.zip.compress(data):
            self.to.write(made)
            self.written += len(made)

    def end(self) -> int:
        self.to.write(made := self.zip.flush())
        return self.written + len(made)


def record_head(kind: str, page_id: object, url: str | None, size: int, digest: str, http: bytes, refers_to: object = None, number: int = 0) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id, digest, number)}", f"WARC-Date: {STAMP}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_name(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(http) + (size if kind == 'response' else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass")


class Record:
    """One record as its chunks come: the head first, then each chunk, with the digest carried along; ``end`` tests it."""

    def __init__(self, to, page_id: object, url: str | None, digest: str, size: int, refers_to: object, revisit: bool, number: int = 0):
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        self.page_id, self.digest, self.revisit, self.seen, self.member = page_id, digest, revisit, hashlib.sha1(), Member(to)
        self.member.add(record_head("revisit" if revisit else "response", page_id, url, size, digest, http, refers_to, number))
        self.member.add(http)

    def add(self, chunk: bytes) -> None:
        self.seen.update(chunk)
        if not self.revisit:
            self.member.add(chunk)

    def end(self) -> int:
        """Compressed bytes written."""
        if base64.b32encode(self.seen.digest()).decode() != self.digest:
            raise ValueError(f"page {self.page_id}: the payload changed while it was written")
        self.member.add(b"\r\n\r\n")
        return self.member.end()


def chunk_rows(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """(page_id, url, digest, row, chunk_no, chunk): rows of up to ``size`` bytes of each page's payload, one empty one for an empty payload. row tells the pages apart."""
    whole = pages.select("page_id", "url", payload("html").alias("payload")).withColumn("row", F.monotonically_increasing_id())
    cut = lambda p: F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(p) - 1) / size)).cast("int")), lambda k: F.struct(k.alias("chunk_no"), F.substring(p, k * size + 1, F.lit(size)).alias("chunk"))
    )
    # an array of one payload: the lambda's variable, so a text is not encoded again for each chunk
    chunks = whole.select("page_id", "url", F.sha1("payload").alias("digest"), "row", F.inline(F.transform(F.array("payload"), cut)[0]))
    return chunks.select("page_id", "url", "digest", "row", "chunk_no", "chunk")


def write_archives(pages: DataFrame, at: str | None = None, least: int = 0) -> DataFrame:
    """Manifest (file, records, bytes) of the archives written under ``at`` (by default a new folder in the shared one).

    pages: page_id, url, html; others are left out. Null html is an empty payload, a null url gives no target header.
    Null ids are pages of their own, which others' responses go before. Of rows that agree in page_id and payload the
    first is the response if they hold the largest page_id; each has an identifier of its own. An empty table gives an
    empty manifest.
    """
    spark = pages.sparkSession
    at = at or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    types = record_types(pages, least).select(key.alias("key"), "digest", "bytes", "winner", "shared")
    # the chunks are dealt once, by the keys of the join; rows that agree in both are neighbours for the writer
    dealt = chunk_rows(pages).withColumn("key", key).repartition("key", "digest")
    typed = dealt.join(types, ["key", "digest"]).sortWithinPartitions("key", "digest", "url", "row", "chunk_no").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, folder = FileSystem.from_uri(at)
        store.create_dir(folder, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, records, size, before, number, record = None, "", 0, 0, None, 0, None

        def ended() -> None:
            nonlocal out, size, record
            if record is not None:
                size += record.end()
                record = None
            if out is not None and size >= FILE_BYTES:
                close()

        def close() -> None:
            nonlocal out
            out.close()
            done.append((name, records, size))
            out = None

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "bytes", "winner", "shared", "chunk_no"))
            for k, (page_id, url, digest, n, winner, shared, chunk_no) in enumerate(zip(*columns, strict=True)):
                if not chunk_no:
                    ended()
                    if out is None:
                        name = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                        out, records, size = store.open_output_stream(name, compression=None), 0, 0
                    number = number + 1 if (page_id, digest) == before else 0
                    before = page_id, digest
                    revisit = bool(shared) and (number > 0 or page_id != winner)
                    record = Record(out, page_id, url, base32_of_hex(digest), n, winner, revisit, number)
                    records += 1
                record.add(batch.column("chunk")[k].as_buffer())
        ended()
        if out is not None:
            close()
        columns = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["file", "records", "bytes"])

    manifest = settle(typed.mapInArrow(run, "file string, records long, bytes long"))
    scheme = at.split("://")[0] + "://" if "://" in at else ""
    return manifest.withColumn("file", F.concat(F.lit(scheme), "file"))


class Stream:
    """Bytes of consecutive gzip members, read in chunks."""

    def __init__(self, source):
        self.source, self.zip, self.ready = source, zlib.decompressobj(31), b""

    def more(self) -> bool:
        while True:
            raw = self.zip.unconsumed_tail or (self.zip.unused_data if self.zip.eof else b"") or self.source.read(CHUNK)
            if not raw:
                return False
            if self.zip.eof:
                self.zip = zlib.decompressobj(31)
            if got := self.zip.decompress(raw, CHUNK):
                self.ready += got
                return True

    def line(self) -> bytes | None:
        while (to := self.ready.find(b"\r\n")) < 0:
            if not self.more():
                return None
        out, self.ready = self.ready[:to], self.ready[to + 2 :]
        return out

    def take(self, most: int) -> bytes:
        if not self.ready and not self.more():
            raise EOFError("the archive ends inside a record")
        out, self.ready = self.ready[:most], self.ready[most:]
        return out


def headers(stream: Stream) -> dict[str, str]:
    out = {}
    while line := stream.line():
        key, _, value = line.decode("utf-8", "surrogatepass").partition(":")
        out[key.strip().lower()] = value.strip()
    return out


def chunks(source) -> Iterator[tuple]:
    """(page_id, record_type, refers_to, payload_bytes, header digest, chunk_no, chunk, bytes so far, digest so far, last) of every record of an open archive."""
    stream = Stream(source)
    while (first := stream.line()) is not None:
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        head = headers(stream)
        left, number, so_far, seen = int(head["content-length"]), 0, 0, hashlib.sha1()
        status = stream.line()
        http = headers(stream)
        # what the HTTP part took of the block, written in one form only
        left -= len(status) + 2 + sum(len(k) + len(v) + 4 for k, v in http.items()) + 2
        fixed = (_id(head["warc-record-id"]), head["warc-type"], _id(head.get("warc-refers-to")), int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:"))
        if head["warc-type"] == "revisit":
            yield (*fixed, 0, b"", fixed[3], fixed[4], True)
            continue
        while True:
            part = stream.take(min(left, CHUNK)) if left else b""
            left -= len(part)
            so_far += len(part)
            seen.update(part)
            now = base64.b32encode(seen.digest()).decode()
            if not left and (now != fixed[4] or so_far != fixed[3]):
                raise ValueError(f"page {fixed[0]}: the payload does not have the digest of its header")
            yield (*fixed, number, part, so_far, now, not left)
            number += 1
            if not left:
                break


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The chunked record table of all archives in a manifest: a task a file, batches of a few chunks."""
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "chunk", "bytes_so_far", "digest_so_far", "last"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, path = FileSystem.from_uri(name)
                with store.open_input_stream(path, compression=None) as source:
                    held: list[tuple] = []
                    weight = 0
                    for row in chunks(source):
                        held.append(row if payloads else (*row[:6], b"", *row[7:]))
                        weight += len(held[-1][6]) + 200
                        if weight >= 8 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    schema = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"
    return manifest.select("file").mapInArrow(run, schema)
