"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) and digit substitutions to Latin
letters, and writes l, 1, ! and | like i, so ``1D10T`` and ``idiot`` are the same string. The lexicon
holds whole words of any length and beginnings of words. It is learned from labelled documents: a term's weight is
its log odds between toxic and clean documents, and only terms whose G statistic is large enter. Exception phrases,
a matched word with the word before or after it, are learned from the same documents: those where the term's documents
are toxic far less often than elsewhere; the caller may add others. A document's
rate is the weight of its matched words (each by its heaviest term; words inside an exception phrase count
nothing) over its number of words. A passage up to a matched word that the text repeats word for word counts
once, in the weight as in the number of words: saying the same again changes nothing. The score is 0.7 at the rate that best parts the labelled
sample, and rises with the rate.

Fitting reads a bounded sample of labelled rows (``SAMPLE`` rows with the smallest hashes of their ids), which bounds
the lexicon: a term is in ``LEAST_DOCS`` toxic ones of them. Scoring is one pass over all whole texts with the lexicon
broadcast.
"""

from __future__ import annotations

import logging
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, schema_with, settle, settle_wide, thinned

LOG = logging.getLogger(__name__)

SAMPLE = 12_000
LEAST_G = 11.0
LEAST_DOCS = 2
#: A term's share of the toxic documents is at least so many times its share of the clean ones (half a document added to each).
RATIO = 8
PREFIXES = (4, 5, 6)
CUT = 0.7
#: Harmless phrases that contain words of abuse, beside those that are learned.
EXCEPTIONS = ("clown fish", "circus clown", "trash can", "trash bin", "trash bag", "pond scum")

# Characters that look like Latin letters or stand for them.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
}
FOLD = str.maketrans(LOOKALIKES | {chr(0xFF41 + k): LOOKALIKES.get(chr(97 + k), chr(97 + k)) for k in range(26)} | dict.fromkeys("​‌‍⁠­﻿", ""))
BREAK = re.compile(r"[^\w]+")
#: Marks that end a word stay marks: a trailing ! is no letter.
TRAILING = re.compile(r"[!|$]+(?=\s|$)")


def folded(text: str | None) -> str:
    """Folded words, one space around each; a single space if there are none."""
    plain = TRAILING.sub(" ", (text or "").lower()).translate(FOLD)
    plain = BREAK.sub(" ", plain).strip()
    return f" {plain} " if plain else " "


def terms(text: str | None) -> set[str]:
    """Candidate lexicon entries of a text: its words (with both spaces) and beginnings of its words (with the space before)."""
    out = set()
    for w in set(folded(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    middle: float = 0.01
    _made: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "exceptions": self.exceptions, "middle": self.middle, "_made": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._made is None:
            self._made = ahocorasick.Automaton()
            for term, w in self.weights.items():
                self._made.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                if (key := folded(phrase)) not in self._made:
                    self._made.add_word(key, (len(key), -1.0))
            self._made.make_automaton()
        return self._made

    def matches(self, plain: str) -> dict[int, tuple[float, int]]:
        """Of folded text: where (the space before) matched words outside exception phrases are, with weight and length of the heaviest term."""
        found: dict[int, tuple[float, int]] = {}
        excused = []
        if len(self.automaton()):
            for end, (size, w) in self.automaton().iter(plain):
                at = end - size + 1
                if w < 0:
                    excused.append((at, end))
                elif w > found.get(at, (0.0, 0))[0]:
                    found[at] = (w, size)
        for lo, hi in excused:
            at = lo
            while 0 <= at < hi:  # the words of the phrase
                found.pop(at, None)
                at = plain.find(" ", at + 1)
        return found

    def phrases(self, text: str | None) -> set[tuple[str, str]]:
        """(term, phrase) of the matched words with a neighbour each, and (term, '') of the terms."""
        plain, out = folded(text), set()
        for at, (_, size) in self.matches(plain).items():
            term, end = plain[at : at + size], plain.index(" ", at + 1)
            before, after = plain.rfind(" ", 0, at), plain.find(" ", end + 1)
            out.add((term, ""))
            if before >= 0:
                out.add((term, plain[before : end + 1]))
            if after >= 0:
                out.add((term, plain[at : after + 1]))
        return out

    def rate(self, text: str | None) -> float:
        """Weight of the matched words per word, without passages (from one match to the next) that were there before."""
        plain = folded(text)
        found = self.matches(plain)
        said, weights, words, done = set(), [], plain.count(" ") - 1, 0
        for at in sorted(found):
            end = plain.index(" ", at + 1)
            passage, done = plain[done:end], end
            if passage in said:
                words -= passage.count(" ")
            else:
                said.add(passage)
                weights.append(found[at][0])
        return math.fsum(weights) / max(1, words)

    def score(self, rate: float) -> float:
        """0 without a match, CUT at the middle rate, towards 1 above."""
        a, b = CUT * rate * rate, (1 - CUT) * self.middle * self.middle
        return a / (a + b) if a else 0.0


def g_statistic(pos: Column, neg: Column) -> Column:
    """G of a term in a of pos toxic and c of neg clean documents (columns a, c)."""
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    share, out = (a + c) / (pos + neg), F.lit(0.0)
    for seen, of in ((a, pos), (c, neg)):
        for k, part in ((seen, share), (of - seen, 1 - share)):
            out += F.when(k > 0, 2 * k * F.log(k / (of * part))).otherwise(0.0)
    return out


def counted(sample: DataFrame, entries: Callable[[str | None], set], names: list[str], most: int = 1 << 15) -> DataFrame:
    """(names, a, c): in how many toxic and clean documents of sample (text, toxic) each entry is. A task passes on its counts when it holds ``most`` entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for whole in batches:
            for batch in parts(whole, "text"):
                for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    seen[int(toxic > 0)].update(entries(text))
                    if len(seen[0]) + len(seen[1]) >= most:
                        yield passed_on(seen)
                        seen = {0: Counter(), 1: Counter()}
        yield passed_on(seen)

    def passed_on(seen: dict[int, Counter]) -> pa.RecordBatch:
        rows = list(seen[0].keys() | seen[1].keys())
        columns = list(zip(*rows, strict=True)) or [()] * len(names) if len(names) > 1 else [rows]
        made = [pa.array(x, pa.string()) for x in columns] + [pa.array([seen[k][x] for x in rows], pa.int64()) for k in (1, 0)]
        return pa.RecordBatch.from_arrays(made, [*names, "a", "c"])

    schema = ", ".join(f"{x} string" for x in names) + ", a long, c long"
    return sample.mapInArrow(count, schema).groupBy(*names).agg(F.sum("a").alias("a"), F.sum("c").alias("c"))


def learned_exceptions(sample: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Phrases whose documents are toxic by odds that are RATIO times smaller than those of the term's other documents, by the G statistic."""
    counts = settle(counted(sample, lexicon.phrases, ["term", "phrase"]))
    whole = counts.filter("phrase = ''").select("term", F.col("a").alias("pos"), F.col("c").alias("neg"))
    a, c, pos, neg = (F.col(x) for x in ("a", "c", "pos", "neg"))
    less = (a + 0.5) * (neg - c + 0.5) * RATIO < (c + 0.5) * (pos - a + 0.5)
    found = counts.filter(f"phrase <> '' and c >= {LEAST_DOCS}").join(whole, "term").filter(less).filter(g_statistic(pos, neg) >= LEAST_G)
    return tuple(sorted({r.phrase for r in found.select("phrase").collect()}))  # as many as the sample holds


def log_odds(a: float, c: float, pos: float, neg: float) -> float:
    """Lower end (one standard error) of a term's log odds between toxic and clean documents: what few documents say counts less."""
    a, c = a + 0.5, c + 0.5
    return math.log(a / (pos + 1)) - math.log(c / (neg + 1)) - math.sqrt(1 / a + 1 / c)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of a bounded sample of labelled documents outside the held-out third (crc32 of the id as text mod 3 = 1)."""
    train = labels.filter("doc_id is not null and toxic is not null").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    ids = (
        thinned(train, ["doc_id"], most).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS, most: int = SAMPLE) -> Lexicon:
    """The lexicon of docs (doc_id, text) and labels (doc_id, toxic). Null ids and labels teach nothing; of several labels of an id the largest holds."""
    sample = settle_wide(training_rows(docs, labels, most).repartition(8))
    size = sample.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n")).first()
    pos, neg = size.pos or 0, size.n - (size.pos or 0)
    if not pos or not neg:
        LOG.warning("%d toxic and %d clean documents to learn from: every score is 0", pos, neg)
        return Lexicon({}, exceptions)
    counts = counted(sample, terms, ["term"])
    more = (F.col("a") + 0.5) * (neg + 1) > RATIO * (F.col("c") + 0.5) * (pos + 1)
    graded = counts.filter((F.col("a") >= LEAST_DOCS) & more).filter(g_statistic(F.lit(float(pos)), F.lit(float(neg))) >= LEAST_G)
    rows = graded.collect()  # as many as the sample holds
    weights = {r.term: log_odds(r.a, r.c, pos, neg) for r in rows}
    lexicon = Lexicon({k: w for k, w in weights.items() if w > 0}, exceptions)
    if not lexicon.weights:
        LOG.warning("no term parts %d toxic from %d clean documents: every score is 0", pos, neg)
    else:
        lexicon = Lexicon(lexicon.weights, (*exceptions, *learned_exceptions(sample, lexicon)))
    pairs = rates(sample, lexicon).select("toxic", "rate").collect()  # as many as the sample has
    lexicon.middle = middle_rate([r.rate for r in pairs if r.toxic <= 0], [r.rate for r in pairs if r.toxic > 0])
    return lexicon


def middle_rate(clean: list[float], toxic: list[float]) -> float:
    """The rate that parts the sample with the fewest errors, from an eighth of the toxic median on; of several the geometric middle of the widest gap."""
    points = sorted({x for x in [*clean, *toxic] if x > 0})
    if not points or not toxic:
        return 0.01
    floor = float(np.median(toxic)) / 8
    points = [floor, *(x for x in points if x > floor)]
    clean_s, toxic_s = np.sort(clean), np.sort(toxic)
    best = (math.inf, 0.0, floor or 0.01)
    for lo, hi in zip(points[:-1], points[1:], strict=True):
        cut = math.sqrt(lo * hi)
        wrong = len(clean_s) - np.searchsorted(clean_s, cut) + np.searchsorted(toxic_s, cut)
        best = min(best, (wrong, -hi / lo, cut))
    return best[2]


def _mapped(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # as large as the labelled sample makes it
    have = [f for f in docs.schema if f.name in keep and f.name not in ("rate", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in parts(whole, "text"):
                rate = [own.rate(t) for t in batch.column("text").to_pylist()]
                made = [pa.array(rate, pa.float64()), pa.array([own.score(r) for r in rate], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in have), *made], [*(f.name for f in have), "rate", "score"])

    return docs.mapInArrow(run, schema_with(have, "rate double, score double"))


def rates(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    return _mapped(docs, lexicon, [c for c in docs.columns if c != "text"])


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """docs (columns ``keep``, all by default) with rate, score and predicted (1 from a score of 0.7). Null and empty texts have score 0; columns of those names are replaced."""
    keep = [c for c in (keep or docs.columns) if c != "predicted"]
    return _mapped(docs, lexicon, keep).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
