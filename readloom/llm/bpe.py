"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a block of texts go into a trie of bytes. A depth-first walk gives each node the
last token of the encoding of its prefix: the only vocabulary entry that ends there and may stand after
the last token of what is before it. Two tokens may stand side by side if merging their bytes gives the
two again. A prefix that many words share is so encoded once, and a word's ids follow from its last
token back to its beginning.

Spark partitions the work: texts are encoded where they are read, nothing is shuffled, and each task
keeps a bounded table of encoded words; its worker keeps the vocabulary only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, schema_with

#: Words of a generation; a task keeps this one and the one before.
KEPT = 100_000
BLOCK = 1 << 20

# Characters whose lower case, classes and NFC form are the same in every version of Unicode: texts of these alone need no library.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-įı-ſ–—‘’“”•…€]*")
LETTER, NUMBER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WordBpe:
    """A vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.library = spec["model"], Tokenizer.from_file(path)
        self.end = model["end_of_word_suffix"]
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.text_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        # order of merging: single letters first, then the merges as they are listed
        self.made_of, self.merged, order = {}, {}, {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = (rank, both)
            if both not in self.made_of:
                self.made_of[both] = (left, right)
                order[both] = rank
        self.order = order
        # entries by their bytes: inside a word, and at its end
        self.inside: dict[bytes, int] = {}
        self.closing: dict[bytes, int] = {}
        for t, i in vocab.items():
            closes = t.endswith(self.end)
            body = t[: len(t) - len(self.end)] if closes else t
            if body and all(c in self.byte_of for c in body):
                (self.closing if closes else self.inside)[bytes(self.byte_of[c] for c in body)] = i
        self.sound: dict[int, bool] = {}
        for table, closes in ((self.inside, False), (self.closing, True)):
            for body in [b for b, i in table.items() if self.merge(b, closes) != [i]]:
                del table[body]  # no text is ever encoded to it
        self.suffixes()
        self.jump: dict[int, int] = {}
        self.size_of = {i: len(b) for table in (self.inside, self.closing) for b, i in table.items()}
        self.known: dict[str, tuple[int, ...]] = {}  # ids only: what they say is in the vocabulary
        self.before: dict[str, tuple[int, ...]] = {}

    def suffixes(self) -> None:
        """States of an Aho-Corasick automaton over the entries' bytes; per state the entries that end there, longest first."""
        self.step, self.fall = [{}], [0]
        self.ends_inside: list[tuple] = [()]
        self.ends_closing: list[tuple] = [()]
        for table, ends in ((self.inside, self.ends_inside), (self.closing, self.ends_closing)):
            for body, i in table.items():
                at = 0
                for b in body:
                    if (to := self.step[at].get(b)) is None:
                        to = self.step[at][b] = len(self.step)
                        self.step.append({})
                        self.fall.append(0)
                        self.ends_inside.append(())
                        self.ends_closing.append(())
                    at = to
                ends[at] = ((len(body), i),)
        queue = list(self.step[0].values())
        for at in queue:  # breadth first: the shorter suffixes are complete before the longer ones
            for b, to in self.step[at].items():
                back = self.fall[at]
                while back and b not in self.step[back]:
                    back = self.fall[back]
                self.fall[to] = self.step[back].get(b, 0)
                queue.append(to)
            self.ends_inside[at] += self.ends_inside[self.fall[at]]
            self.ends_closing[at] += self.ends_closing[self.fall[at]]

    def advance(self, at: int, b: int) -> int:
        """State after one more byte; what is found out by falling back is kept as a step."""
        back = at
        while back and b not in self.step[back]:
            back = self.fall[back]
        to = self.step[back].get(b, 0)
        self.jump[at << 8 | b] = to
        return to

    def merge(self, body: bytes, closes: bool) -> list[int]:
        """Ids by merging from single letters, the lowest rank first: the definition, for vocabulary entries and tests."""
        ids = [self.inside.get(body[k : k + 1]) for k in range(len(body))]
        if closes and body:
            ids[-1] = self.closing.get(body[-1:])
        ids = [x for x in ids if x is not None]
        while len(ids) > 1:
            best = min(((self.merged[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merged), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merged[ids[k], ids[k + 1]][1]]
        return ids

    def beside(self, left: int, right: int) -> bool:
        """True if no merge would cross the border between two tokens.

        Undo the merges that made the two, the latest first: whatever then faces each other at the border
        was there while all earlier merges ran, and must not be a pair that one of those would take.
        """
        key = left << 32 | right
        if (known := self.sound.get(key)) is not None:
            return known
        ok, a, b, until = True, left, right, float("inf")
        while True:
            rank = self.merged.get((a, b), (None,))[0]
            if rank is not None and rank < until:
                ok = False
                break
            made_a, made_b = self.order.get(a, -1), self.order.get(b, -1)
            if made_a < 0 and made_b < 0:
                break
            if made_a > made_b:
                until, a = made_a, self.made_of[a][1]
            else:  # of two pairs of one rank the left one is taken first, so on a tie the right token came later
                until, b = made_b + 1, self.made_of[b][0]
        if len(self.sound) > 2_000_000:
            self.sound.clear()
        self.sound[key] = ok
        return ok

    def learn(self, words: set[str]) -> None:
        """Encode words into ``known`` by a depth-first walk through their trie.

        The words in the order of their bytes are that walk: what a word shares with the one before it is the path that
        stays, so the nodes need not be built.
        """
        known, beside, sound, size_of = self.known, self.beside, self.sound, self.size_of
        jump, ends_inside, ends_closing = self.jump, self.ends_inside, self.ends_closing
        last: list[int] = [-1]  # last token of the prefix of each length on the path
        states = [0]
        before = b""
        for word in sorted(words):  # the order of code points is that of their bytes
            body = word.encode("utf-8", "surrogatepass")
            end = 0
            for x, y in zip(before, body):
                if x != y:
                    break
                end += 1
            before, size_of_body = body, len(body)
            del states[end + 1 :]
            del last[end + 1 :]
            state = states[end]
            while True:
                if len(last) <= end:  # the node has children: what follows stands after its last token
                    token = -1
                    for size, t in ends_inside[state]:
                        at = end - size
                        if at == 0 or ((p := last[at]) >= 0 and (ok if (ok := sound.get(p << 32 | t)) is not None else beside(p, t))):
                            token = t
                            break
                    last.append(token)
                if end == size_of_body:
                    break
                byte = body[end]
                state = to if (to := jump.get(state << 8 | byte)) is not None else self.advance(state, byte)
                states.append(state)
                end += 1
                if end == size_of_body:
                    break
            for size, t in ends_closing[state]:
                at = end - size
                if at == 0 or ((p := last[at]) >= 0 and (ok if (ok := sound.get(p << 32 | t)) is not None else beside(p, t))):
                    ids = [t]
                    while at:
                        ids.append(last[at])
                        at -= size_of[last[at]]
                    ids.reverse()
                    known[word] = tuple(ids)
                    break

    def pieces(self, text: str) -> list[str]:
        """Words of a text, special tokens as they are."""
        out: list[str] = []
        for k, part in enumerate(self.split.split(text) if self.split and "<|" in text else [text]):
            if k % 2:
                out.append(part)
            elif part.isascii() and "\x1c" not in part and "\x1d" not in part and "\x1e" not in part and "\x1f" not in part or PLAIN.fullmatch(part):
                out += PIECES.findall(part.lower())
            elif part:
                lib = self.library
                spelt = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(part))
                out += [bytes(self.byte_of[c] for c in w).decode("utf-8", "surrogatepass") for w, _ in spelt]
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[tuple[int, ...], str]]]:
        """For each text its words' (ids, decoded)."""
        return [[(ids, self.decode(ids)) for ids in words] for words in self.ids(texts)]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings, one space between."""
        return " ".join(map(self.text_of.__getitem__, ids))

    def ids(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """For each text its words' ids."""
        cut = [self.pieces(t) for t in texts]
        if len(self.known) > KEPT:
            self.before, self.known = self.known, {}
            self.jump.clear()
        for content, i in self.special.items():
            self.known[content] = (i,)
        new = set().union(*cut) - self.known.keys()
        for w in new & self.before.keys():
            self.known[w] = self.before[w]
        new -= self.before.keys()
        if new:
            self.learn(new)
        return [list(map(self.known.__getitem__, x)) for x in cut]

    def release(self) -> None:
        """Forget the words: idle workers would hold them beside the tasks of later stages."""
        for table in (self.known, self.before, self.jump, self.sound):
            table.clear()


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The vocabulary of a file, once for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs with ``ids`` (array of ints) and ``decoded`` (the tokens' strings, one space between) instead of ``text``.

    Null texts are empty: no ids, empty decoded text. Texts are encoded whole; columns named ids or decoded are replaced.
    Repeated rows and null ids give a row each, an empty table none.
    """
    keep = [f for f in docs.schema if f.name not in ("text", "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        try:
            for whole in batches:
                for batch in parts(whole, "text", BLOCK):
                    made = [list(chain.from_iterable(words)) for words in own.ids([t or "" for t in batch.column("text").to_pylist()])]
                    flat = np.fromiter(chain.from_iterable(made), np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), pa.array(flat))
                    decoded = pa.array(map(own.decode, made), pa.string())
                    yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), ids, decoded], [*(f.name for f in keep), "ids", "decoded"])
        finally:
            own.release()
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema_with(keep, "ids array<int>, decoded string"))


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of what encode() returns; columns of those names are replaced."""
    made = ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        *[c for c in encoded.columns if c not in made],
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
