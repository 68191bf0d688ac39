"""Periodic runs in the words of whole texts, after Kolpakov and Kucherov.

A run is a stretch of words with smallest period q (words q apart are the same) of ``LEAST`` words or more, at least
two periods long, that no neighbouring word extends. The text is factorised (each factor is the longest stretch that
occurs before, or one new word) with a suffix automaton; Main's algorithm finds the runs that touch the border of a
factor by extending periods to both sides of it with Z functions; every other run lies strictly inside one factor and
is copied from the factor's earlier occurrence. All of it is linear in the number of words.

Before that a text is cut. A run has ``LEAST`` words or more and two periods, so each of its words is in a window of
``LEAST`` / 2 words that occurs again one period on or back: words outside of windows that repeat are in no run. Stretches
between them are worked on one by one; a hash collision makes a stretch longer, never shorter.

Scale: one pass over the texts, nothing is shuffled. Memory of a task is 16 bytes a word of the text at hand and, for stretches of
windows that repeat, some 80 bytes a word and 200 a branching state of the automaton.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import parts, schema_with, text_bytes
from .words import BLOCK, IS_WORD, covered, twice, windows, word_hashes

LEAST = 12

Run = tuple[int, int, int]  # start, length, period


def factors(s: array) -> list[tuple[int, int, int]]:
    """(begin, end, earlier begin or -1) of the factors of s. An earlier occurrence may overlap the factor.

    States up to len(s) are the prefixes; the step from a prefix to the next is not stored.
    """
    n = len(s)
    more: dict[int, dict[int, int]] = {}
    link, size, ends = array("i", bytes(4 * (n + 1))), array("i", range(n + 1)), array("i", range(n + 1))
    link[0] = -1
    for i, c in enumerate(s):
        p, q = link[i], -1
        while p >= 0:
            if p <= n and s[p] == c:
                q = p + 1
                break
            steps = more.get(p)
            if steps is None:
                more[p] = {c: i + 1}
            elif (q := steps.get(c, -1)) >= 0:
                break
            else:
                steps[c] = i + 1
            p = link[p]
        if p < 0:
            continue  # the link is the root
        if size[p] + 1 == size[q]:
            link[i + 1] = q
            continue
        clone = len(size)
        steps = dict(more.get(q, ()))
        if q <= n:
            steps[s[q]] = q + 1
        more[clone] = steps
        size.append(size[p] + 1)
        ends.append(ends[q])
        link.append(link[q])
        link[q] = link[i + 1] = clone
        while p >= 0 and (steps := more.get(p)) is not None and steps.get(c) == q:
            steps[c] = clone
            p = link[p]
    out, i = [], 0
    while i < n:
        state, j = 0, i
        while j < n:
            q = state + 1 if state <= n and s[state] == s[j] else more[state][s[j]]
            if ends[q] > j:  # here for the first time
                break
            state, j = q, j + 1
        out.append((i, j, ends[state] - (j - i)) if j > i else (i, i + 1, -1))
        i = max(j, i + 1)
    return out


def prefix_lengths(s: array) -> array:
    """How far s agrees with itself from each place on (Z function)."""
    n = len(s)
    z = array("i", bytes(4 * n))
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def touching(s: array, back: int, i: int, j: int, least: int) -> dict[tuple[int, int], int]:
    """Smallest period by (begin, end) of the runs that touch i, a border between the factors [back, i) and [i, j), end up to j, and begin after ``back`` if they end at i.

    Such a run begins less than twice the left factor and once the right one before i, for the left factor is the longest that occurs before.
    """
    a, b = i - back, j - i
    lo, hi = max(0, i - 2 * a - b), min(len(s), j + 1)
    right, left = s[i:hi], s[lo:i][::-1]
    gap, found = array("i", [-1]), {}

    def take(begin: int, end: int, period: int) -> None:
        if end - begin >= max(least, 2 * period) and end <= j and (end > i or begin > back):
            found[begin, end] = min(period, found.get((begin, end), period))

    ahead = prefix_lengths(right)  # s[i:] against s[i + p:]
    behind = prefix_lengths(left + gap + s[lo:hi][::-1])  # s[:i] against s[:k], at hi - k
    for p in range(1, b + 1):
        take(i - behind[len(left) + 1 + hi - i - p], i + p + (ahead[p] if p < len(right) else 0), p)
    ahead = prefix_lengths(right + gap + s[lo:hi])  # s[i:] against s[k:], at k - lo
    behind = prefix_lengths(left)
    for p in range(1, min(a + b, i - lo) + 1):
        take(i - p - (behind[p] if p < len(left) else 0), i + ahead[len(right) + 1 + i - p - lo], p)
    return found


def runs_of(s: array, least: int = LEAST) -> list[Run]:
    """All runs of s in order of their starts."""
    at: dict[int, list[tuple[int, int]]] = {}  # start -> (length, period)
    back = 0
    for i, j, earlier in [*factors(s), (len(s), len(s), -1)]:
        if 2 * (i - back) + 2 * (j - i) >= least:
            for (begin, end), period in touching(s, back, i, j, least).items():
                at.setdefault(begin, []).append((end - begin, period))
        if at and j - i > least:
            d = i - earlier
            for k in range(i + 1, j - least):
                if k - d in at:
                    copies = [x for x in at[k - d] if k + x[0] < j]
                    if copies:
                        at.setdefault(k, []).extend(copies)
        back = i
    return sorted((start, length, period) for start, found in at.items() for length, period in found)


def stretches(hashes: np.ndarray, counts: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(first word, end) rows of the stretches of windows that repeat in their text, of ``least`` words or more; none crosses a text's end. Uses up the hashes."""
    size = max(1, least // 2)
    valid = windows(hashes, counts, size)
    inside = covered(twice(hashes, valid), size)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(begins):  # cut where a text ends
        cuts = np.unique(np.cumsum(counts))
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        cuts = cuts[inside[cuts] & inside[cuts - 1]]
        begins, ends = np.sort(np.concatenate([begins, cuts])), np.sort(np.concatenate([ends, cuts]))
    long = ends - begins >= least
    return np.stack([begins[long], ends[long]], axis=1)


def numbered(raw: np.ndarray, starts: np.ndarray, first: int, end: int) -> array:
    """Words ``first`` to ``end`` as numbers: equal words, equal numbers."""
    ids: dict[bytes, int] = {}
    out = array("i")
    for lo in range(first, end, BLOCK >> 3):
        hi = min(end, lo + (BLOCK >> 3))
        to = int(starts[hi]) if hi < len(starts) else len(raw)
        out.extend(ids.setdefault(w, len(ids)) for w in raw[int(starts[lo]) : to].tobytes().split()[: hi - lo])
    return out


def collapsed(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray, dropped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the words of each text that are not dropped, with one space between. A text's first word is never dropped."""
    ends = np.cumsum(counts)
    leads = np.zeros(len(starts), bool)  # the first words of texts
    leads[(ends - counts)[counts > 0]] = True
    pieces, sizes = [], np.zeros(len(counts), np.int64)
    step = BLOCK >> 2
    for k in range(0, len(starts), step):
        to = min(k + step, len(starts))
        # a word's part begins with the byte before it (white space unless the word leads a text, which then is left out)
        lo = int(starts[k])
        hi = int(starts[to]) - 1 + int(leads[to]) if to < len(starts) else len(raw)
        part, own = raw[lo:hi], starts[k:to].astype(np.int64) - lo
        keep, text = IS_WORD[part], part
        space = own[1:][~leads[k + 1 : to]] - 1
        keep[space] = True
        text = np.where(IS_WORD[part], part, np.uint8(32))
        begin = own - 1
        begin[leads[k:to]] += 1
        begin[0] = 0
        if dropped[k:to].any():
            keep &= ~np.repeat(dropped[k:to], np.diff(begin, append=len(part)))
        lengths = np.add.reduceat(keep, begin, dtype=np.int64)
        if k and not leads[k] and not dropped[k]:
            pieces.append(np.full(1, 32, np.uint8))
            lengths[0] += 1
        pieces.append(text[keep])
        owner = np.searchsorted(ends, np.arange(k, to), side="right")
        sizes += np.bincount(owner, weights=lengths, minlength=len(counts)).astype(np.int64)
    return np.concatenate(pieces) if pieces else np.zeros(0, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with ``n_words``, ``runs`` (start, length, period by start and period; words are counted from 0) and ``collapsed``: the text's words but those that a run holds after its first period, with one space between.

    Columns of those names are replaced, all others pass through. A null text is an empty one: no words, no runs, an empty
    collapsed text. Repeated rows and null ids each give a row; an empty table gives none. Runs are found in whole texts of any length.
    """
    new = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    have = [f for f in docs.schema if f.name not in ("n_words", "runs", "collapsed")]
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole, "text", 2 << 20):
                raw, offsets = text_bytes(batch.column("text"))
                counts, starts, hashes = word_hashes(raw, offsets)
                ends = np.cumsum(counts)
                found: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
                owners: list[np.ndarray] = [np.zeros(0, np.int64)]
                dropped = np.zeros(len(starts) + 1, bool)
                for first, end in stretches(hashes, counts, least):
                    got = runs_of(numbered(raw, starts, int(first), int(end)), least)
                    if got:
                        rows = np.array(got, np.int64)
                        rows[:, 0] += first
                        drop = np.zeros(end - first + 1, np.int64)
                        np.add.at(drop, rows[:, 0] + rows[:, 2] - first, 1)
                        np.add.at(drop, rows[:, 0] + rows[:, 1] - first, -1)
                        dropped[first:end] = np.cumsum(drop)[:-1] > 0
                        owner = int(np.searchsorted(ends, first, side="right"))
                        rows[:, 0] -= ends[owner] - counts[owner]
                        found.append(rows)
                        owners.append(np.full(len(rows), owner))
                del hashes
                rows = np.concatenate(found)
                per = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(owners), minlength=len(counts)))])
                text, at = collapsed(raw, starts, counts, dropped[:-1])
                made = [
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(kind))),
                    pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text)]),
                ]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in have), *made], [*(f.name for f in have), "n_words", "runs", "collapsed"])

    return docs.mapInArrow(run, schema_with(have, new))
