import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import runs, words
from readloom.llm.common import text_bytes
from readloom.llm.queries import op11_runs, table, with_periodic_tails
from tests.llm.helpers import SF, WORDS, docs, odd_texts


def brute(s, least=12):
    """Runs by comparing s with itself at every distance; of equal stretches the smallest period."""
    n, found = len(s), {}
    for p in range(1, n // 2 + 1):
        same = np.array([s[i] == s[i + p] for i in range(n - p)] + [False])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same]).astype(int)))
        for b, e in zip(edge[::2], edge[1::2], strict=True):
            if e + p - b >= max(least, 2 * p):
                found.setdefault((int(b), int(e + p)), p)
    return sorted((b, e - b, p) for (b, e), p in found.items())


def left(words, found):
    drop = {k for b, n, p in found for k in range(b + p, b + n)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


def planted(text, doc_id):
    w = re.findall(WORDS, text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


letters = st.lists(st.integers(0, 3), max_size=60)


@settings(max_examples=300, deadline=None)
@given(letters, st.integers(0, 60), st.integers(1, 15), st.integers(1, 5), st.sampled_from([2, 5, 12]))
def test_runs_of_any_words(s, at, period, times, least):
    s = s[:at] + s[at : at + period] * times + s[at:]
    assert runs.runs_of(array("i", s), least) == brute(s, least)


@settings(max_examples=100, deadline=None)
@given(letters)
def test_factors_are_the_longest_that_occur_before(s):
    at = 0
    for begin, end, earlier in runs.factors(array("i", s)):
        assert begin == at and end > begin
        at = end
        if earlier < 0:
            assert end == begin + 1 and s[begin] not in s[:begin]
            continue
        n = end - begin
        assert earlier < begin and s[earlier : earlier + n] == s[begin:end]
        assert end == len(s) or all(s[k : k + n + 1] != s[begin : end + 1] for k in range(begin))
    assert at == len(s)


@pytest.mark.parametrize("s", ["a" * 100, "ab" * 50, "abaab" * 30, "abcabcabd" * 20, "a" * 40 + "b" + "a" * 40 + "b" + "a" * 40])
def test_known_words(s):
    assert runs.runs_of(array("i", map(ord, s))) == brute(s)


def test_fibonacci_word():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    assert runs.runs_of(array("i", map(ord, b)), 2) == brute(b, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té😀", max_size=40)), min_size=1, max_size=5), st.integers(1, 7))
def test_words_do_not_hang_on_blocks(texts, block):
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    counts, starts, hashes = words.word_hashes(raw, offsets, block)
    want = [re.findall(WORDS, t or "") for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    flat = [w for x in want for w in x]
    assert [raw[k:].tobytes().split()[0].decode()[: len(w)] for k, w in zip(starts, flat, strict=True)] == flat
    by_hash = dict(zip(hashes.tolist(), flat, strict=True))
    assert len(by_hash) == len(set(flat)) and all(by_hash[h] == w for h, w in zip(hashes.tolist(), flat, strict=True))
    valid = words.windows(hashes, counts, 3, block)
    own = [(k, tuple(x[i : i + 3])) if i + 3 <= len(x) else None for k, x in enumerate(want) for i in range(len(x))]
    assert valid.tolist() == [x is not None for x in own]
    again = words.twice(hashes, valid, block)
    assert again.tolist() == [x is not None and own.count(x) > 1 for x in own]
    text, at = runs.collapsed(raw, starts, counts, np.zeros(len(starts), bool))
    assert [text[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)] == [" ".join(x) for x in want]


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in op11_runs(spark, SF).collect()}
    rows = table(spark, SF, "documents").collect()
    assert len(got) == len(rows)
    repeated = 0
    for r in rows:
        w = planted(r.text, r.doc_id)
        found = brute(w) if len(w) < 3000 else runs.runs_of(array("i", [w.index(x) for x in w]))
        g = got[r.doc_id]
        assert g.n_runs == len(found)
        assert g.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert g.collapsed_sha256 == hashlib.sha256(left(w, found).encode()).hexdigest()
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
        assert (g.start, g.length, g.period) == best
        assert g.exponent_milli == (1000 * best[1] // best[2] if found else None)
        repeated += bool(found)
    assert repeated > 10


def test_tails(spark):
    rows = [(k, f"a{k} b\tc\n d e f g h i j k l m n o"[: 3 + 2 * (k % 19)]) for k in range(300)] + [(None, "x y"), (7, None), (8, ""), (9, " ")]
    got = with_periodic_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r, (k, t) in zip(got, rows, strict=True):
        assert (r.text or "").split() == (planted(t, k) if k is not None else (t or "").split())


def test_odd_rows(spark):
    rows = [*odd_texts(), (9, "a b " * 40_000, "x"), (10, "a b c d e f " * 2, "x"), (11, "a b c d e f " * 2, "x"), (12, "nolongwhitespace" * 200_000, "x")]
    got = runs.find_runs(docs(spark, rows).selectExpr("*", "1 as n_words", "'x' as runs")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, t, _ in rows:
        w = re.findall(WORDS, t or "")
        assert by[k].n_words == len(w)
        assert k == 9 or by[k].collapsed == left(w, [tuple(x) for x in by[k].runs])
    assert [tuple(x) for x in by[9].runs] == [(0, 80_000, 2)] and by[9].collapsed == "a b"
    assert [tuple(x) for x in by[10].runs] == [(0, 12, 6)] and by[11].collapsed == "a b c d e f"
    assert runs.find_runs(docs(spark, [])).count() == 0


def test_neighbouring_texts_stay_apart(spark):
    rows = [(k, "a b c d e f", "x") for k in range(6)]
    assert all(not r.runs for r in runs.find_runs(docs(spark, rows).coalesce(1)).collect())
    rows = [(k, "a b c d e f " * 2, "x") for k in range(6)]
    assert all([tuple(x) for x in r.runs] == [(0, 12, 6)] for r in runs.find_runs(docs(spark, rows).coalesce(1)).collect())
