"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints of 64 bits link when they differ in at most four bits. The bits are cut into three groups
of 21, 21 and 22, so a linked pair differs in at most one bit of some group. In each group the anchors
are a covering code: the perfect Hamming code of length 15 on the first 15 bits, every pattern of the
other bits. Its covering radius is 1, so a fingerprint has one home anchor within 1. The pair's other
member lies within 1 + 1 of that anchor, so every fingerprint visits all anchors within the covering
radius plus the group's threshold (about 14 a group), and each anchor compares its homes with its
visitors. No linked pair is lost, whatever the data.

Scale: only distinct fingerprints take part (copies meet in one row before anything is replicated);
an anchor keeps its homes only, visitors stream past in blocks, and what it emits is a forest of at
most one edge a row. Anchors with more rows than ``TILE`` are split: their visitors are dealt over
several tasks, their homes go to each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components
from .common import parts, schema_with, settle

SEED = 42
GROUPS = ((0, 21), (21, 21), (42, 22))
TILE = 400_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of one text: majority of the bits of XXH64 (seed 42) over its shingles, repeats included.

    A-Z are lower-cased; fewer words than ``width`` make one shingle; no word makes fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split(): space and 9 to 13
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    else:
        first, last = [0], [len(line)]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), 1 << 15):  # a very long text in bounded memory
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first[at : at + (1 << 15)], last[at : at + (1 << 15)], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(first), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """docs with ``fp`` (the fingerprint's bits as a signed long) instead of ``text``; one pass, no shuffle. Null texts are empty; a column named fp is replaced."""
    fields = [f for f in docs.schema if f.name not in ("text", "fp")]
    keep = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text"):
                fps = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], [*keep, "fp"])

    return docs.mapInArrow(run, schema_with(fields, "fp long"))


def hamming15() -> tuple[np.ndarray, np.ndarray]:
    """Of each 15-bit value its codeword, and the flips to further codewords at distance 2 by syndrome (7 each)."""
    values = np.arange(1 << 15, dtype=np.int64)
    syndrome = np.zeros_like(values)
    for bit in range(15):
        syndrome ^= np.where(values >> bit & 1, bit + 1, 0)
    home = np.where(syndrome > 0, values ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), values)
    pairs = np.zeros((16, 7), np.int64)
    for s in range(1, 16):  # bits a, b with (a + 1) ^ (b + 1) = s: flipping both leads to a codeword
        pairs[s] = [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, 16) if a < a ^ s]
    return home, pairs[syndrome]


def anchor_rows(fps: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, home) of all replicas: for each group the home anchor and all within distance 2 that a neighbour by one bit may have as home."""
    home, flips = tables
    keys, rows, homes = [], [], []
    bits = fps.view(np.uint64)
    for g, (shift, width) in enumerate(GROUPS):
        value = (bits >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        head, tail, base = value & 0x7FFF, value >> 15, np.int64(g) << 40
        own = base | tail << 15 | home[head]
        keys.append(own), rows.append(fps), homes.append(np.ones(len(fps), bool))
        visits = [own]
        visits += [base | (tail ^ (1 << b)) << 15 | home[head] for b in range(width - 15)]
        off = home[head] != head  # a codeword has no second one within distance 2
        for visit in visits:
            keys.append(visit), rows.append(fps), homes.append(np.zeros(len(fps), bool))
        for k in range(7):
            keys.append((base | tail << 15 | head ^ flips[head, k])[off])
            rows.append(fps[off]), homes.append(np.zeros(int(off.sum()), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def replicate(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = hamming15()
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                key, fp, home = anchor_rows(whole.column("fp").slice(at, 4096).to_numpy(zero_copy_only=False), tables)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(home)], ["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def forest(homes: np.ndarray, visitors: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges that join what is linked between homes and visitors: one less than the members of each class at most."""
    nodes = np.unique(np.concatenate([homes, visitors]))
    label, edges = np.arange(len(nodes)), []
    seats, bits = np.searchsorted(nodes, visitors), visitors.view(np.uint64)
    for own in np.unique(homes):
        near = seats[np.bitwise_count(bits ^ own.view(np.uint64)) <= threshold]
        me = int(np.searchsorted(nodes, own))
        labels = np.unique(label[near])
        labels = labels[labels != label[me]]
        if len(labels):
            classes = np.append(labels, label[me])
            least = classes.min()
            edges += [(int(nodes[least]), int(nodes[x])) for x in classes if x != least]
            label[np.isin(label, classes)] = least
    return edges


def compare(rows: DataFrame, threshold: int, block: int = 1 << 15) -> DataFrame:
    """Edges (a, b) from rows sorted by (anchor, tile), homes first. Keeps the homes of one anchor and one block of visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, visitors, held, out = None, [], [], 0, []

        def flush(last: bool) -> None:
            nonlocal homes, visitors, held
            if homes and visitors:
                homes = [np.concatenate(homes)]
                seen = np.concatenate(visitors)
                if len(homes[0]) * len(seen) > 1:
                    out.extend(forest(homes[0], seen, threshold))
            visitors, held = [], 0
            if last:
                homes = []

        def emitted() -> pa.RecordBatch:
            made = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], ["a", "b"])

        for batch in batches:
            anchor, tile, fp, home = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "tile", "fp", "home"))
            cuts = np.flatnonzero((anchor[1:] != anchor[:-1]) | (tile[1:] != tile[:-1])) + 1
            edges = [0, *cuts.tolist(), len(anchor)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if (anchor[lo], tile[lo]) != key:
                    flush(True)
                    key = (anchor[lo], tile[lo])
                n = int(home[lo:hi].sum())
                if n:
                    homes.append(fp[lo : lo + n])
                if hi - lo > n:
                    visitors.append(fp[lo + n : hi])
                    held += hi - lo - n
                    if held >= block:
                        flush(False)
            if len(out) >= block:
                yield emitted()
        flush(True)
        yield emitted()

    return rows.mapInArrow(run, "a long, b long")


def links(fps: DataFrame, threshold: int = 4) -> DataFrame:
    """Edges between distinct fingerprints whose closure is the closure of all links. fps: one row per fingerprint, settled."""
    if threshold > 4:
        raise ValueError("three groups cover up to five differing bits less one: threshold is 4 at most")
    rows = replicate(fps)
    heavy = (
        rows.groupBy("anchor")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > TILE)
        .select("anchor", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    )
    rows = (
        rows.join(heavy, "anchor", "left")
        .withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        .withColumn("tile", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")))))
        .select("anchor", "tile", "fp", "home")
        .repartition("anchor", "tile")
        .sortWithinPartitions("anchor", "tile", F.desc("home"))
    )
    return compare(rows, threshold).distinct()


def groups(fingerprints: DataFrame, threshold: int = 4) -> DataFrame:
    """fingerprints (doc_id, fp, any others) with ``component_id``: the smallest doc_id that links reach, itself included, and ``root``: a fingerprint that names the class.

    Null doc_ids take part and lose against any other id; a class of null ids alone has component_id null. Repeated
    rows are in one class. Columns named component_id or root are replaced.
    """
    fingerprints = fingerprints.drop("component_id", "root", "_fp")
    fps = settle(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = settle(links(fps, threshold))
    roots = components.connected(edges)  # (node, root)
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # only classes of several fingerprints need their least id looked up
    several = named.filter(F.col("fp").isNotNull()).groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(several, "root").select(F.col("fp").alias("_fp"), "component_id", "root")
    return fingerprints.join(classes, F.col("fp") == F.col("_fp"), "left").drop("_fp")
