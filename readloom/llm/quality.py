"""Quality rules: exact base counts of every text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed trigrams of UTF-8 bytes: the trusted target (labelled
documents of good quality, a bounded sample of the labels, ``TRUSTED`` rows at most) and the raw corpus
(all trigrams of all documents). A document's score is the mean log ratio over its trigrams; it is kept
if the score reaches ``THRESHOLD``. Weights are whole numbers of 2^-20, so a score does not depend on
partitions, blocks or the order of sums.

Scale: two passes over the texts without shuffling them; what is shuffled is 2^16 counters a task. Texts are read in blocks, so
a task takes some 10 bytes a word beside the text at hand, and a few dozen a line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, schema_with, segment_sums, text_bytes, thinned
from .words import BLOCK, covered, twice, windows, word_hashes, word_starts

BUCKETS = 1 << 16
TRUSTED = 20_000
THRESHOLD = -0.5
UNIT = 1 << 20
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words


def buckets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all trigrams inside texts, offsets of each text's trigrams)."""
    n = np.maximum(np.diff(offsets) - 2, 0)
    after = np.concatenate([[0], np.cumsum(n)])
    if len(raw) < 3:
        return np.zeros(0, np.int64), after
    b = raw.astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    inside = np.ones(len(h), bool)
    for back in (1, 2):  # trigrams that begin in the last two bytes of a text reach into the next one
        cut = offsets[1:-1] - back
        inside[cut[(cut >= offsets[:-2]) & (cut >= 0) & (cut < len(h))]] = False
    return (h[inside] & np.uint32(BUCKETS - 1)).astype(np.int64), after


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """Ids of good documents: the ``most`` with the smallest hashes."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id")
    return thinned(good, ["doc_id"], most).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("trusted", F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of each bucket, target over raw corpus, as whole numbers of 1 / UNIT. Add-one smoothing; all zero without trusted rows."""
    # at most TRUSTED rows of one long and one flag: bounded, so it may be broadcast
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted_ids(labels)), "doc_id", "left").select("text", "trusted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((2, BUCKETS), np.int64)
        for whole in batches:
            for batch in parts(whole, "text"):
                mark = batch.column("trusted").fill_null(False).to_numpy(zero_copy_only=False)
                for first, end, got, after in trigram_blocks(*text_bytes(batch.column("text"))):
                    both[1] += np.bincount(got, minlength=BUCKETS)
                    if mark[first:end].any():
                        both[0] += np.bincount(got[np.repeat(mark[first:end], np.diff(after))], minlength=BUCKETS)
        seen = np.flatnonzero(both[1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(both[0][seen]), pa.array(both[1][seen])], ["bucket", "target", "raw"])

    counts = flagged.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.toLocalIterator():  # BUCKETS rows at most
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    return np.rint(ratio * UNIT).astype(np.int64)


def repeated_words(raw: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, their code points, words in three-word windows that occur twice or more) of each text.

    Words and windows are told apart by 64-bit hashes of their bytes.
    """
    chars, repeats = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    for lo, word, _ in word_starts(raw, offsets, block):
        add_sums(chars, word & ((raw[lo : lo + len(word)] & 0xC0) != 0x80), lo, offsets)
    words, _, hashes = word_hashes(raw, offsets, block)
    valid = windows(hashes, words, 3, block)
    begins = twice(hashes, valid, block)
    del hashes, valid
    inside = covered(begins, 3)
    for lo in range(0, len(inside), block):
        add_sums(repeats, inside[lo : lo + block], lo, np.concatenate([[0], np.cumsum(words)]))
    return words, chars, repeats


def add_sums(out: np.ndarray, values: np.ndarray, lo: int, offsets: np.ndarray) -> None:
    """Add to out the sums of a block of values, which begins at place lo, over the segments that offsets delimit."""
    first, end = int(np.searchsorted(offsets, lo, side="right")) - 1, int(np.searchsorted(offsets, lo + len(values)))
    edges = np.clip(offsets[first : end + 1] - lo, 0, len(values))
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    out[first:end] += running[edges[1:]] - running[edges[:-1]]


def trigram_blocks(raw: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, buckets, offsets) of the trigrams that begin in a block of bytes, by the texts that it touches; each trigram once."""
    for lo in range(0, len(raw), block):
        hi = min(lo + block, len(raw))
        first, end = int(np.searchsorted(offsets, lo, side="right")) - 1, int(np.searchsorted(offsets, hi))
        to = min(hi + 2, int(offsets[end]))  # no further than the last text that begins in the block
        yield first, end, *buckets(raw[lo:to], np.clip(offsets[first : end + 1] - lo, 0, to - lo))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line of the text (UTF-8). Of long lines a digest of 128 bits is kept."""
    seen: set[bytes] = set()
    at, lines = 0, 0
    while at < len(text):
        end = text.find(b"\n", at)
        line = text[at : end if end >= 0 else len(text)]
        at = end + 1 if end >= 0 else len(text)
        if line.strip(b" \t\v\f\r"):
            lines += 1
            seen.add(line if len(line) < 24 else b"#%d#" % len(line) + hashlib.blake2b(line, digest_size=16).digest())
    return lines - len(seen)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, base_failed and kept; columns of those names are replaced.

    Null and empty texts count nothing and fail the base rules. A text of fewer than three bytes has llr 0.
    """
    new = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "llr": "double", "base_failed": "boolean", "kept": "boolean"}
    have = [f for f in docs.schema if f.name not in new]
    symbol = np.isin(np.arange(256), list(SYMBOLS))
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for batch in parts(whole, "text", 2 << 20):
                raw, offsets = text_bytes(batch.column("text"))
                words, chars, repeats = repeated_words(raw, offsets)
                symbols, ratio = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for first, end, got, after in trigram_blocks(raw, offsets):
                    ratio[first:end] += segment_sums(table[got], after)
                for lo in range(0, len(raw), BLOCK):
                    add_sums(symbols, symbol[raw[lo : lo + BLOCK]], lo, offsets)
                llr = ratio / UNIT / np.maximum(np.diff(offsets) - 2, 1)
                failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEATED * words)
                lines = np.array([repeated_lines(raw[lo:hi].tobytes()) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
                made = [words, chars, symbols, lines, repeats, llr, failed, ~failed & (llr >= threshold)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in have), *map(pa.array, made)], [*(f.name for f in have), *new])

    return docs.mapInArrow(run, schema_with(have, ", ".join(f"{k} {v}" for k, v in new.items())))
