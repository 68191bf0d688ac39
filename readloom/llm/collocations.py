"""Phrase collocation mining: counts of all phrases by language, exact scores, and the best of each language.

Texts are lower-cased (A-Z) and cut into pieces at punctuation and line ends, pieces into words at spaces and tabs.
Phrases of 1 to ``longest`` words become rows and are counted by (lang, phrase). A phrase of two words or more with ``least`` occurrences is
a candidate; each cut into two parts compares its count with those of the parts, floor(1000000 a^2 / (l r)) in decimals
of 38 digits, and the weakest cut counts. A candidate goes if a candidate of one word more holds it and has half of its occurrences or more.

Only phrases with ``least`` occurrences are ever looked at (a part has at least as many as its phrase), and nearly all
phrases of a corpus are there once or twice. So texts are read several times. First all words are rows of 40 bits, counted
by Spark, and those with ``least`` occurrences or more set two bits each of a filter; then the pairs whose two words the filter
knows, then the phrases of three words whose two pairs it knows, and so on. Last, phrases that the filter knows become rows with their words. A collision of hashes lets a
rare phrase pass, never stops a frequent one, and the counts of the last reading are exact.

Scale: tasks add up their phrases before the shuffle, so one that is everywhere is one row a task. The filter has 16 bits a frequent phrase and
``MOST_BITS`` at most (32 MB): beyond some 20 million it passes more rare phrases, which costs rows, not results. Parts and
extensions are joined among frequent phrases only, which Spark splits where one word begins or ends very many. Ranks are taken in ``SHARES``
shares of a language first, so no task holds all candidates of a language.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, settle, text_bytes
from .words import mixed, word_hashes

LEAST = 10
LONGEST = 3
TOP = 2000
SHARES = 16
MOST_BITS = 1 << 28
SEGMENT = 1 << 20
HELD = 1 << 21

STOPS = b".,;:!?\n\x0b\x0c\r"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TO_SPACE = bytes(32 if b in STOPS or b == 9 else b for b in range(256))
IS_STOP = np.isin(np.arange(256), list(STOPS))
IS_WORD = ~IS_STOP & ~np.isin(np.arange(256), [9, 32])
_ODD = np.uint64(0x9E3779B97F4A7C15)
KEPT = ~np.uint64((1 << 24) - 1)  # of a hash 40 bits are kept: more phrases collide, rows are shorter


def segments(text: bytes, longest: int, most: int = SEGMENT) -> Iterator[tuple[bytes, int]]:
    """(lower-cased part of a text, how many of its words are there for what follows only).

    A part ends at a stop or, if there is none in ``most`` bytes, at a space; then the next one begins with the ``longest`` - 1 words before it.
    """
    at, rest, before = 0, b"", 0
    while at < len(text):
        part = rest + text[at : at + most].translate(LOWER)
        at += most
        cut, kept, carried = len(part), b"", 0
        if at < len(text):
            stop = max(part.rfind(bytes([s])) for s in STOPS)
            cut = stop + 1 if stop >= 0 else max(part.rfind(b" "), part.rfind(b"\t")) + 1
            if stop < 0 and cut:
                tail = part[:cut].split(b" ") if b"\t" not in part else part[:cut].replace(b"\t", b" ").split(b" ")
                words = [w for w in tail if w][1 - longest :] if longest > 1 else []
                kept, carried = b"".join(w + b" " for w in words), len(words)
        if cut:
            yield part[:cut], before
            rest, before = kept + part[cut:], carried
        else:
            rest = part


class Slice:
    """The phrases of some segments: hashes by size, and which of them lie in one piece and end behind what was carried over."""

    def __init__(self, parts_: list[tuple[str, bytes, int]], longest: int):
        raw = np.frombuffer(b"".join(p for _, p, _ in parts_), np.uint8)
        offsets = np.cumsum([0, *(len(p) for _, p, _ in parts_)])
        self.counts, starts, words = word_hashes(raw, offsets, is_word=IS_WORD)
        piece = np.searchsorted(np.flatnonzero(IS_STOP[raw]), starts)  # stops before the word
        owner = np.repeat(np.arange(len(parts_)), self.counts)
        langs = {lang: np.uint64(int.from_bytes(_digest(lang), "little")) for lang, _, _ in parts_}
        mine = np.array([langs[lang] for lang, _, _ in parts_], np.uint64)
        within = np.arange(len(words)) - (np.cumsum(self.counts) - self.counts)[owner]
        carried = np.array([c for _, _, c in parts_])[owner] if len(parts_) else within
        self.keys, self.valid = [mixed(words ^ mine[owner])], [within >= carried]
        for size in range(2, longest + 1):
            n = max(0, len(words) - size + 1)
            self.keys.append(mixed(self.keys[-1][:n] * _ODD + words[size - 1 :]))
            self.valid.append((piece[:n] == piece[size - 1 :]) & (owner[:n] == owner[size - 1 :]) & (within[size - 1 :] >= carried[size - 1 :]))
        self.keys = [k & KEPT for k in self.keys]

    def held_by(self, known: Filter, size: int) -> np.ndarray:
        """Which phrases of a size have both parts without the last and the first word in the filter."""
        n = len(self.keys[size - 1])
        inner = known.holds(self.keys[size - 2])
        return self.valid[size - 1] & inner[:n] & inner[1 : n + 1]


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=8).digest()


def slices(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[list[tuple[str, bytes, int]], Slice]]:
    """The texts of batches (lang, text) in slices of some megabytes, with their phrases."""
    for whole in batches:
        for batch in parts(whole, "text", 2 << 20):
            raw, offsets = text_bytes(batch.column("text"))
            held: list[tuple[str, bytes, int]] = []
            size = 0
            for row, lang in enumerate(batch.column("lang").to_pylist()):
                for part, carried in segments(raw[offsets[row] : offsets[row + 1]].tobytes(), longest):
                    held.append((lang, part, carried))
                    size += len(part)
                    if size >= 2 << 20:
                        yield held, Slice(held, longest)
                        held, size = [], 0
            if held:
                yield held, Slice(held, longest)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def hashed_counts(docs: DataFrame, longest: int, known: Filter | None = None) -> DataFrame:
    """(key, n): how often phrases of ``longest`` words occur, by hashes of language and words; with a filter those only whose two parts it knows. docs: lang, text."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # MOST_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], ["key", "n"])
            keys.clear()
            counts.clear()

        for _, got in slices(batches, longest):
            mine = got.keys[-1][got.valid[-1] if shared.value is None else got.held_by(shared.value, longest)]
            k, n = np.unique(mine, return_counts=True)
            keys.append(k)
            counts.append(n.astype(np.int64))
            size += len(k)
            if size > 2 * HELD:
                k, n = summed(np.concatenate(keys), np.concatenate(counts))
                keys[:], counts[:], size = [k], [n], len(k)
                if size > HELD:
                    yield from out()
                    size = 0
        if keys:
            k, n = summed(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [k], [n]
            yield from out()

    return docs.mapInArrow(run, "key long, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


class Filter:
    """A set of 64-bit keys, two bits each; may hold others too."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits) * 64).bit_length() + 1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys >> self.shift, (keys * _ODD) >> self.shift

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self.places(keys):
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def filter_of(keys: DataFrame, most_bits: int = MOST_BITS) -> Filter:
    """The filter of a table of keys: tasks set bits in filters of their own, and 64 bits at a time are put together by Spark."""
    n = keys.count()
    size = max(1 << 12, min(most_bits, 1 << max(0, 16 * n - 1).bit_length())) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Filter(np.zeros(size, np.uint64))
        for batch in batches:
            mine.add(batch.column("key").to_numpy().view(np.uint64))
        at = np.flatnonzero(mine.bits)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mine.bits[some].view(np.int64))], ["at", "bits"])

    whole = keys.select("key").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # most_bits / 64 rows at most
    out = Filter(np.zeros(size, np.uint64))
    out.bits[whole.column("at").to_numpy()] = whole.column("bits").to_numpy().view(np.uint64)
    return out


def phrases(docs: DataFrame, known: Filter, longest: int = LONGEST) -> DataFrame:
    """(text, a): counts, to be added up, of the phrases that may be frequent by the filter, as language, line end, phrase; an empty phrase has the number of a language's words. docs: lang, text.

    Rows leave a task in order, which packs them closer.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)  # MOST_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, found, total = shared.value, {}, Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counted in found.items():
                words, mark = sorted(counted), lang.encode() + b"\n"
                for lo in range(0, len(words), 1 << 16):
                    some = words[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([mark + w for w in some], pa.binary()).cast(pa.string()), pa.array([counted[w] for w in some], pa.int64())], ["text", "a"])
            found.clear()

        for held, got in slices(batches, longest):
            masks = [v & frequent.holds(k) for k, v in zip(got.keys, got.valid, strict=True)]
            ends = np.cumsum(got.counts)
            for k, (lang, part, carried) in enumerate(held):
                lo, hi = int(ends[k] - got.counts[k]), int(ends[k])
                words = [w for w in part.translate(TO_SPACE).split(b" ") if w]
                total[lang] += len(words) - carried
                for size, mask in enumerate(masks, 1):
                    if hi - lo < size:
                        break
                    mine = mask[lo : hi - size + 1]
                    rows = compress(words, mine) if size == 1 else map(b" ".join, compress(zip(*(words[j:] for j in range(size)), strict=False), mine))
                    found.setdefault(lang, Counter()).update(rows)
            if sum(map(len, found.values())) > HELD // 2:
                yield from out()
        yield from out()
        langs = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([x + "\n" for x in langs], pa.string()), pa.array([total[x] for x in langs], pa.int64())], ["text", "a"])

    return docs.mapInArrow(run, "text string, a long")


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of the candidates of counts (lang, size, phrase, a), with the cut of the lowest score, of several the first."""
    part = counts.filter((F.col("size") > 0) & (F.col("a") >= least)).select("lang", F.col("phrase").alias("part"), F.col("a").alias("of"))
    cuts = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    whole = counts.filter((F.col("size") > 1) & (F.col("a") >= least)).withColumn("cut", cuts)
    side = lambda c, n: part.select("lang", F.col("part").alias(c), F.col("of").alias(n))
    first = whole.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).join(side("left", "l"), ["lang", "left"]).drop("left")
    out = first.withColumn("right", F.expr("substring_index(phrase, ' ', cut - size)")).join(side("right", "r"), ["lang", "right"]).drop("right")
    d = {c: F.col(c).cast("decimal(15,0)") for c in ("a", "l", "r")}
    above, below = d["a"] * d["a"] * F.lit(1_000_000).cast("decimal(7,0)"), d["l"] * d["r"]
    each = out.withColumns({"above": above, "below": below}).withColumn("score", F.expr("above div below"))
    weakest = F.min(F.struct("score", "cut", "l", "r")).alias("x")
    return each.groupBy("lang", "size", "phrase", "a").agg(weakest).select("lang", "size", "phrase", "a", "x.l", "x.r", "x.score")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, a) of the phrases with ``least`` occurrences, and (lang, 0, '', words of the language). docs: lang, text."""
    known = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    keys, passed = None, None
    for size in range(1, longest + 1):
        often = settle(hashed_counts(known, size, passed).filter(F.col("n") >= least).select("key"))
        keys = often if keys is None else keys.unionByName(often)
        passed = filter_of(keys)
    counts = phrases(known, passed, longest).groupBy("text").agg(F.sum("a").alias("a"))
    phrase = F.substring_index("text", "\n", -1)
    named = counts.select(F.expr("left(text, length(text) - length(substring_index(text, '\\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "a")
    size = F.when(F.col("phrase") == "", 0).otherwise(F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1)
    return named.withColumn("size", size.cast("int")).filter((F.col("size") == 0) | (F.col("a") >= least)).select("lang", "size", "phrase", "a")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a (its occurrences), l and r (those of the parts), n (words of the language), score.

    Ordered by score and a, both falling, then by the phrase's bytes. Null and empty texts have no words; a null lang is ``und``,
    an empty one is a language of its own. Repeated rows count as often as they are there. An empty table gives no rows; other
    columns are left out. Counts are exact up to 10^15, scores up to 38 digits. longest: 2 or more.
    """
    counts = settle(frequent_phrases(docs, longest, least))
    total = counts.filter("size = 0").select("lang", F.col("a").alias("n"))
    frequent = counts.filter("size > 0")
    inner = [F.expr(f"substring_index(phrase, ' ', {k})") for k in ("size - 1", "1 - size")]
    held = frequent.filter("size > 2").select("lang", F.explode(F.array(*inner)).alias("phrase"), F.col("a").alias("of")).groupBy("lang", "phrase").agg(F.max("of").alias("of"))
    all_scored = scored(frequent, least)
    inside = (all_scored.lang == held.lang) & (all_scored.phrase == held.phrase) & (100 * held.of >= 50 * all_scored.a)
    best = all_scored.join(held, inside, "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES)).alias("share")
    first = best.withColumn("share", share).withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    # one row a language
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
