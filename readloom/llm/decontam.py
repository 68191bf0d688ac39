"""Benchmark decontamination: every occurrence of a benchmark's word windows in whole texts, after Wu and Manber.

Texts are folded to words (A-Z lower-cased; a word is a run of digits, a-z and characters outside ASCII) with one space
around each. A pattern is a window of ``SIZE`` words of an item, or a whole shorter item, with the same spaces. Patterns
are searched in classes of similar length. In each, a shift table says by the last ``block`` bytes before a place how far the next
possible end of a pattern's beginning is; places in between are never looked at. Where the shift is 0, the hash of these bytes
and of the first ones names a bucket of patterns, and bytes are compared.

Scale: one pass over the texts, nothing is shuffled. Patterns go to the tasks in shards of ``SHARD`` bytes at most, each
a pass of its own; a benchmark of 10 million words is about twenty shards. Texts are searched in pieces of ``PIECE``
bytes that share ``SIZE`` - 1 words, so memory does not grow with a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, schema_with, settle_wide, text_bytes

SIZE = 10
PIECE = 1 << 20
SCAN = 4 << 20
SHARD = 32 << 20
#: Least lengths in bytes of the classes of patterns, and the bytes that a shift looks at.
CLASSES = ((40, 8), (20, 8), (8, 4), (0, 2))
LANE = 2048

WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
FOLD = bytes(x if (x := ord(chr(b).lower()) if b < 128 else b) in WORD else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)

Span = tuple[int, int]


def pieces(text: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in pieces that end at a word's end."""
    at, rest = 0, b""
    while at < len(text):
        folded = rest + text[at : at + most].translate(FOLD)
        at += most
        cut = len(folded) if at >= len(text) else folded.rfind(b" ") + 1
        rest = folded[cut:]
        if words := folded[:cut].split():
            yield words


def windows_of(items: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct (pattern, item_id) of items (item_id, text): windows of ``size`` words, or all words of a shorter item. Items without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
                tail: list[bytes] = []
                for words in pieces((text.as_py() or "").encode()):
                    tail += words
                    if len(tail) > size:
                        made = [b" ".join(tail[k : k + size]).decode() for k in range(len(tail) - size)]
                        yield pa.RecordBatch.from_arrays([pa.array(made), pa.array([item] * len(made), pa.int64())], ["pattern", "item_id"])
                        tail = tail[-size:]
                if tail:
                    yield pa.RecordBatch.from_arrays([pa.array([b" ".join(tail).decode()]), pa.array([item], pa.int64())], ["pattern", "item_id"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "pattern string, item_id long").distinct()


class Tables:
    """Shift table and buckets of the patterns of one class. Patterns are bytes, all of ``block`` bytes or more."""

    def __init__(self, patterns: list[bytes], block: int):
        self.block, self.least = block, min(map(len, patterns))
        self.kind = np.dtype(f"<u{block}")
        heads = np.frombuffer(b"".join(p[: self.least] for p in patterns), np.uint8).reshape(len(patterns), self.least)
        self.bits = min(24, max(12, (len(patterns) * self.least).bit_length() + 2))
        self.shift = np.full(1 << self.bits, min(self.least - block + 1, 60_000), np.uint16)
        for end in range(block, self.least + 1):
            blocks = np.ascontiguousarray(heads[:, end - block : end]).view(self.kind)[:, 0]
            np.minimum.at(self.shift, self.slot(blocks), min(self.least - end, 60_000))
        first, last = (np.ascontiguousarray(heads[:, x]).view(self.kind)[:, 0] for x in (slice(0, block), slice(self.least - block, self.least)))
        keys = self.key(first, last)
        order = np.argsort(keys, kind="stable")
        self.keys, self.patterns = keys[order], [patterns[k] for k in order]

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)

    def key(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        x = (first.astype(np.uint64) * _ODD) ^ (last.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return x ^ (x >> np.uint64(29))

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """(first byte, pattern) of all occurrences in text. The text is dealt to lanes that advance side by side, each by its own shifts."""
        if len(text) < self.least:
            return
        blocks = np.ndarray((len(text) - self.block + 1,), self.kind, text, 0, (1,))
        stop = len(text) - self.block + 1
        at = np.arange(self.least - self.block, stop, LANE)
        until = np.minimum(at + LANE, stop)
        hits = []
        while len(at):
            step = self.shift[self.slot(blocks[at])]
            zero = step == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.maximum(step, 1)
            going = at < until
            at, until = at[going], until[going]
        if not hits:
            return
        ends = np.sort(np.concatenate(hits))
        begins = ends - (self.least - self.block)
        keys = self.key(blocks[begins], blocks[ends])
        lo, hi = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        for k in np.flatnonzero(hi > lo):
            begin = int(begins[k])
            for pattern in self.patterns[lo[k] : hi[k]]:
                if text.startswith(pattern, begin):
                    yield begin, pattern


class Search:
    """Patterns (words with one space between) with the ids of their items, as tables by length."""

    def __init__(self, rows: list[tuple[str, int | None]]):
        self.items: dict[bytes, list[int]] = {}
        for pattern, item in rows:
            self.items.setdefault(b" " + pattern.encode() + b" ", []).extend([] if item is None else [item])
        self._tables: list[Tables] | None = None

    def __getstate__(self) -> dict:
        return {"items": self.items, "_tables": None}

    def tables(self) -> list[Tables]:
        if self._tables is None:
            self._tables, left = [], list(self.items)
            for least, block in CLASSES:
                if of := [p for p in left if len(p) >= least]:
                    self._tables.append(Tables(of, block))
                    left = [p for p in left if len(p) < least]
        return self._tables

    def occurrences(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        for t in self.tables():
            yield from t.occurrences(text)


def merged(spans: list[Span]) -> list[Span]:
    """Union of half-open spans, in order."""
    out: list[Span] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class Found:
    """What is found in the texts of a slice: (number of words, spans, items) of each."""

    def __init__(self, search: Search, rows: int, size: int):
        self.search, self.size = search, size
        self.words = [0] * rows
        self.spans: list[list[Span]] = [[] for _ in range(rows)]
        self.items: list[set[int]] = [set() for _ in range(rows)]
        self.waiting: list[tuple[int, int, bytes]] = []
        self.held = 0

    def add(self, row: int, text: bytes) -> None:
        tail: list[bytes] = []
        for words in pieces(text):
            piece = b" " + b" ".join(tail + words) + b" "
            self.waiting.append((row, self.words[row] - len(tail), piece))
            self.words[row] += len(words)
            tail = (tail + words)[1 - self.size :] if self.size > 1 else []
            self.held += len(piece)
            if self.held >= SCAN:
                self.scan()

    def scan(self) -> None:
        text = b"\0".join(x[2] for x in self.waiting)
        at = np.cumsum([0, *(len(x[2]) + 1 for x in self.waiting)])
        spaces, touched = None, set()
        for begin, pattern in self.search.occurrences(text):
            if spaces is None:
                spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            k = int(np.searchsorted(at, begin, side="right")) - 1
            row, first, _ = self.waiting[k]
            word = first + int(np.searchsorted(spaces, begin) - np.searchsorted(spaces, at[k]))
            self.spans[row].append((word, word + pattern.count(b" ") - 1))
            self.items[row].update(self.search.items[pattern])
            touched.add(row)
        for row in touched:
            self.spans[row] = merged(self.spans[row])
        self.waiting, self.held = [], 0


NEW = "n_words long, spans array<struct<start: long, end: long>>, items array<long>"


def _marked(docs: DataFrame, search: Search, size: int, again: bool) -> DataFrame:
    """One pass with the patterns of one shard; ``again``: docs have the results of others."""
    shared = docs.sparkSession.sparkContext.broadcast(search)  # SHARD bytes at most
    have = [f for f in docs.schema if f.name not in ("n_words", "spans", "items")]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                raw, offsets = text_bytes(batch.column("text"))
                found = Found(shared.value, len(batch), size)
                for row in range(len(batch)):
                    found.add(row, raw[offsets[row] : offsets[row + 1]].tobytes())
                found.scan()
                spans, items = found.spans, found.items
                if again:
                    before = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                    spans = [merged([(x["start"], x["end"]) for x in old] + new) for old, new in zip(before[0], spans, strict=True)]
                    items = [new.union(old) for old, new in zip(before[1], items, strict=True)]
                made = [
                    pa.array(found.words, pa.int64()),
                    pa.array([[{"start": lo, "end": hi} for lo, hi in x] for x in spans], span),
                    pa.array([sorted(x) for x in items], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in have), *made], [*(f.name for f in have), "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema_with(have, NEW))


def mark(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shard: int = SHARD) -> DataFrame:
    """docs with ``n_words``, ``spans`` (disjoint half-open spans of the words inside occurrences, in order) and ``items`` (ids of the items with occurring windows, in order).

    Columns of those names are replaced, all others pass through. Null and empty texts have no words and no spans. Repeated rows
    and null ids each give a row. Items without words match nothing; of repeated items each id counts once; an item
    without an id marks words and is not named. An empty table gives none, an empty benchmark marks nothing.
    """
    patterns = settle_wide(windows_of(benchmark, size))
    total = patterns.agg(F.sum(F.octet_length("pattern") + 16)).first()[0] or 0
    shards = -(-total * 9 // (8 * shard)) or 1
    for k in range(shards):
        mine = patterns if shards == 1 else patterns.filter(F.pmod(F.xxhash64("pattern", "item_id"), F.lit(shards)) == k)
        docs = _marked(docs, Search([(r.pattern, r.item_id) for r in mine.toLocalIterator()]), size, k > 0)
    return docs
