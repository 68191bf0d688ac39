"""BAM files as a Spark data source: ``spark.read.format("bam").load(path)`` after register(spark).

A file is cut into ranges of bytes. A range owns the records that begin in its compressed blocks: its task looks for the
first block, then for the first border of a record (a chain of plausible records), and reads on behind its end until the
last of them is whole. So no index is needed and a file is as many tasks as it has ranges. Paths are opened
by driver and executors alike, through pyarrow's file systems: a mounted or a Hadoop store, or a local path on a local master.

A text of the header that is not a BAM's, a block that does not inflate and a record that is cut off raise; an empty file has no records.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, read_name string, flag int, chromosome string, read_start long, read_end long, mapping_quality int, cigar string, seq string, mm string, ml array<int>"
PART_BYTES = 64 << 20
ROWS = 4096
# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08\x04"
BASES = b"=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
ON_REFERENCE = frozenset("MDN=X")
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
PAIRS = np.frombuffer(bytes(BASES[k] for b in range(256) for k in (b >> 4, b & 15)), np.uint8).reshape(256, 2)
HEAD = struct.Struct("<iiiBBHHHiiii")

ARROW = pa.schema(
    [("file", pa.string()), ("read_name", pa.string()), ("flag", pa.int32()), ("chromosome", pa.string()), ("read_start", pa.int64()), ("read_end", pa.int64()),
     ("mapping_quality", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("mm", pa.string()), ("ml", pa.list_(pa.int32()))]
)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the .bam files of a folder."""
    store, at = _opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        prefix = path.split("://")[0] + "://" if "://" in path else ""
        return sorted((prefix + x.path, x.size) for x in found if x.is_file and x.path.endswith(".bam"))
    return [(path, info.size)]


class Blocks:
    """The compressed blocks of a file."""

    def __init__(self, path: str):
        store, at = _opened(path)
        self.path, self.file = path, store.open_input_file(at)
        self.size = self.file.size()

    def length(self, at: int, head: bytes | None = None) -> int | None:
        """Bytes of the block at a place, None if there is none."""
        head = self.file.read_at(min(64, self.size - at), at) if head is None else head
        if len(head) < 18 or head[:4] != MAGIC:
            return None
        k, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
        while k + 4 <= min(end, len(head) - 2):
            kind, n = head[k : k + 2], struct.unpack_from("<H", head, k + 2)[0]
            if kind == b"BC" and n == 2:
                return struct.unpack_from("<H", head, k + 4)[0] + 1
            k += 4 + n
        return None

    def inflated(self, at: int) -> tuple[bytes, int]:
        """(content, place of the next block) of the block at a place."""
        n = self.length(at)
        if n is None:
            raise ValueError(f"{self.path}: no block at byte {at}")
        raw = self.file.read_at(n, at)
        if len(raw) < n:
            raise ValueError(f"{self.path}: the block at byte {at} is cut off")
        skip = 12 + struct.unpack_from("<H", raw, 10)[0]
        data = zlib.decompress(raw[skip:-8], -15)
        crc, size = struct.unpack_from("<II", raw, n - 8)
        if size != len(data) or crc != zlib.crc32(data):
            raise ValueError(f"{self.path}: the block at byte {at} is damaged")
        return data, at + n

    def first(self, lo: int, hi: int) -> int | None:
        """The first block that begins in [lo, hi)."""
        at = lo
        while at < hi:
            window = self.file.read_at(min(1 << 17, self.size - at), at)
            k = window.find(MAGIC)
            while k >= 0 and at + k < hi:
                n = self.length(at + k, window[k : k + 64] if k + 64 <= len(window) else None)
                if n is not None and (at + k + n == self.size or (at + k + n < self.size and self.length(at + k + n) is not None)):
                    try:
                        self.inflated(at + k)
                    except (ValueError, zlib.error):
                        pass
                    else:
                        return at + k
                k = window.find(MAGIC, k + 1)
            if len(window) < 64:
                return None
            at += len(window) - 63
        return None


def header(blocks: Blocks) -> tuple[list[str], int, int]:
    """(names of the contigs, block of the first record, its place in that block)."""
    data, starts, at = b"", [], 0

    def need(n: int) -> None:
        nonlocal data, at
        while len(data) < n:
            if at >= blocks.size:
                raise ValueError(f"{blocks.path}: the header is cut off")
            starts.append((len(data), at))
            more, at = blocks.inflated(at)
            data += more

    need(12)
    if data[:4] != b"BAM\1":
        raise ValueError(f"{blocks.path} is no BAM file")
    k = 8 + struct.unpack_from("<i", data, 4)[0]
    need(k + 4)
    names, (n,) = [], struct.unpack_from("<i", data, k)
    k += 4
    for _ in range(n):
        need(k + 4)
        (size,) = struct.unpack_from("<i", data, k)
        need(k + 8 + size)
        names.append(data[k + 4 : k + 3 + size].decode())
        k += 8 + size
    inside = [(o, b) for o, b in starts if o <= k]
    if k == len(data):  # the first record begins in the next block
        return names, at, 0
    return names, inside[-1][1], k - inside[-1][0]


def plausible(data: bytes, at: int, contigs: int) -> int:
    """Bytes of a record that may begin at a place; 0 if none can, -1 if more data are needed to tell."""
    if at + 36 > len(data):
        return -1
    size, contig, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = HEAD.unpack_from(data, at)
    if not (-1 <= contig < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and name >= 1 and 0 <= bases and size < 1 << 29):
        return 0
    if size < 32 + name + 4 * ops + (bases + 1) // 2 + bases:
        return 0
    end = at + 35 + name
    if end >= len(data):
        return -1
    if data[end] or not all(33 <= c < 127 for c in data[at + 36 : end]):
        return 0
    return 4 + size


def border(data: bytes, contigs: int, whole: bool, chain: int = 4) -> int | None:
    """The first place where ``chain`` plausible records follow each other, or as many as there are to the end if data are ``whole``; None if more data are needed."""
    for at in range(len(data)):
        k, n = at, 0
        while n < chain:
            if whole and k == len(data) and n:
                return at
            size = plausible(data, k, contigs) if k <= len(data) else -1
            if size <= 0:
                break
            k, n = k + size, n + 1
        else:
            return at
        if size < 0 and not whole:
            return None
    return len(data) if whole else None


def decoded(data: bytes, at: int, size: int, names: list[str]) -> tuple:
    """(read_name, flag, chromosome, read_start, read_end, mapping_quality, cigar, seq, mm, ml) of the record at a place."""
    _, contig, pos, name, quality, _, ops, flag, bases, *_ = HEAD.unpack_from(data, at)
    k = at + 36
    read_name = data[k : k + name - 1].decode("latin-1")
    k += name
    steps = [(x >> 4, OPERATIONS[x & 15]) for x in struct.unpack_from(f"<{ops}I", data, k)]
    k += 4 * ops
    packed = np.frombuffer(data, np.uint8, (bases + 1) // 2, k)
    seq = PAIRS[packed].tobytes()[:bases].decode()
    k += (bases + 1) // 2 + bases
    mm, ml, end = None, None, at + size
    while k + 3 <= end:
        tag, kind = data[k : k + 2].upper(), chr(data[k + 2])
        k += 3
        if kind in "ZH":
            stop = data.index(0, k)
            if tag == b"MM":
                mm = data[k:stop].decode()
            k = stop + 1
        elif kind == "B":
            item, n = chr(data[k]), struct.unpack_from("<i", data, k + 1)[0]
            if tag == b"ML" and item == "C":
                ml = list(data[k + 5 : k + 5 + n])
            k += 5 + n * TAG_SIZES[item]
        else:
            k += TAG_SIZES[kind]
    span = sum(n for n, op in steps if op in ON_REFERENCE)
    return read_name, flag, names[contig] if contig >= 0 else None, pos if pos >= 0 else None, pos + span if pos >= 0 else None, quality, "".join(f"{n}{op}" for n, op in steps) or None, seq or None, mm, ml


def records(path: str, lo: int, hi: int) -> Iterator[tuple]:
    """Decoded records that begin in blocks of [lo, hi) of a file."""
    blocks = Blocks(path)
    if not blocks.size:
        return
    names, first, skip = header(blocks)
    at = first if lo <= first < hi else blocks.first(max(lo, first), hi) if hi > first else None
    if at is None:
        return
    data, starts, k = b"", [], skip if at == first else None
    while True:
        done = at >= blocks.size
        if not done:
            starts.append((len(data), at))
            more, at = blocks.inflated(at)
            data += more
        if k is None:
            k = border(data, len(names), done)
            if k is None:
                continue
        while k < len(data):
            while len(starts) > 1 and starts[1][0] <= k:
                starts.pop(0)
            if starts[0][1] >= hi:
                return
            size = 4 + struct.unpack_from("<i", data, k)[0] if k + 4 <= len(data) else 1 << 62
            if k + size > len(data):
                break
            yield decoded(data, k, size, names)
            k += size
        if done:
            if k < len(data):
                raise ValueError(f"{path}: the last record is cut off")
            return
        if k >= len(data) and at >= hi:
            return
        if k:
            data = data[k:]
            starts = [(max(0, o - k), b) for o, b in starts if o > k or b == max(x for y, x in starts if y <= k)]
            k = 0


class Part(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.part = options["path"], int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[Part]:
        return [Part(path, lo, min(lo + self.part, size)) for path, size in listed(self.path) for lo in range(0, size, self.part)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        name, held = partition.path.rsplit("/", 1)[-1], []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip([[name] * len(held), *map(list, zip(*held, strict=True))], ARROW, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=ARROW)

        size = 0
        for r in records(partition.path, partition.lo, partition.hi):
            held.append(r)
            size += len(r[7] or "") + len(r[9] or ())
            if len(held) >= ROWS or size > 8 << 20:
                size = 0
                yield batch()
        if held:
            yield batch()


class BamSource(DataSource):
    """Options: path (a file, or a folder of .bam files), partbytes (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def scan(spark: SparkSession, path: str, part_bytes: int = PART_BYTES):
    """All records of a BAM file or folder, unmapped ones too: see SCHEMA. read_start counts from 0, read_end is the first position behind the read."""
    register(spark)
    return spark.read.format("bam").option("partbytes", part_bytes).load(path)
