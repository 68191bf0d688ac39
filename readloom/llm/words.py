"""Words of whole texts as arrays: hashes, windows of words and which of them repeat, in bounded memory.

A word is a run of bytes other than the space and the control characters 9 to 13. Texts come as one array of bytes with
offsets; all work goes block by block, so that a text of any length takes about 8 bytes a word beside itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20

IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on whole arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_starts(raw: np.ndarray, offsets: np.ndarray, block: int = BLOCK, is_word: np.ndarray = IS_WORD) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of a block, which of its bytes belong to words, which begin one), block by block. A text's first byte begins a word, whatever is before it."""
    begins = offsets[:-1][np.diff(offsets) > 0]
    inside = False
    for lo in range(0, len(raw), block):
        word = is_word[raw[lo : lo + block]]
        first = word.copy()
        first[1:] &= ~word[:-1]
        if inside:
            first[0] = False
        own = begins[np.searchsorted(begins, lo) : np.searchsorted(begins, lo + len(word))] - lo
        first[own] |= word[own]
        inside = bool(word[-1])
        yield lo, word, first


def word_hashes(raw: np.ndarray, offsets: np.ndarray, block: int = BLOCK, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, first bytes of all words, their 64-bit hashes).

    A word's hash sums its bytes, each mixed with its place in the word, so a word may reach over blocks.
    """
    counts = np.zeros(len(offsets) - 1, np.int64)
    for lo, _, first in word_starts(raw, offsets, block, is_word):
        at = np.flatnonzero(first) + lo
        counts += np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=len(counts))
    n = int(counts.sum())
    starts, hashes = np.empty(n, np.uint32), np.empty(n, np.uint64)
    last, begun, done = np.uint64(0), 0, 0  # sum and first byte of the word that is open, and words that began before
    for lo, word, first in word_starts(raw, offsets, block, is_word):
        at = np.flatnonzero(first)
        opened = np.concatenate([[begun], at + lo])
        within = np.arange(lo, lo + len(word)) - opened[np.cumsum(first, dtype=np.int32)]
        each = mixed((raw[lo : lo + len(word)].astype(np.uint64) << np.uint64(40)) ^ within.astype(np.uint64))
        each[~word] = 0
        with np.errstate(over="ignore"):
            last = last + each[: at[0] if len(at) else len(each)].sum(dtype=np.uint64)
        if done:
            hashes[done - 1] = last
        if len(at):
            hashes[done : done + len(at)] = np.add.reduceat(each, at)
            starts[done : done + len(at)] = at + lo
            done += len(at)
            last, begun = hashes[done - 1], int(at[-1]) + lo
    for lo in range(0, n, block):
        hashes[lo : lo + block] = mixed(hashes[lo : lo + block])
    return counts, starts, hashes


def windows(hashes: np.ndarray, counts: np.ndarray, size: int, block: int = BLOCK) -> np.ndarray:
    """Turns the hashes of words, in place, into hashes of the windows of ``size`` words that begin there; returns which windows lie in one text.

    Windows of different texts differ.
    """
    ends = np.cumsum(counts)
    valid = np.zeros(len(hashes), bool)
    for lo in range(0, len(hashes), block):
        hi = min(lo + block, len(hashes) - size + 1)
        if hi <= lo:
            break
        owner = np.searchsorted(ends, np.arange(lo, hi), side="right")
        valid[lo:hi] = np.arange(lo, hi) + size <= ends[owner]
        w = mixed(owner.astype(np.uint64) + np.uint64(1))
        for k in range(size):
            w = mixed(w + hashes[lo + k : hi + k])
        hashes[lo:hi] = w
    return valid


def twice(values: np.ndarray, valid: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Which of the valid values are there twice or more; sorts a share of the value space at a time."""
    out = np.zeros(len(values), bool)
    bits = min(16, max(0, (len(values) // block).bit_length()))
    shares = np.zeros(len(values), np.uint8 if bits <= 8 else np.uint16)
    for lo in range(0, len(values) if bits else 0, block):
        shares[lo : lo + block] = values[lo : lo + block] >> np.uint64(64 - bits)
    for share in range(1 << bits):
        at = np.flatnonzero(valid & (shares == share))
        mine = values[at]
        order = np.argsort(mine, kind="stable")
        mine = mine[order]
        same = mine[1:] == mine[:-1]
        out[at[order[1:][same]]] = True
        out[at[order[:-1][same]]] = True
    return out


def covered(begins: np.ndarray, size: int) -> np.ndarray:
    """Which places lie in a window of ``size`` that begins at a marked one."""
    out = begins.copy()
    for k in range(1, size):
        out[k:] |= begins[:-k]
    return out
