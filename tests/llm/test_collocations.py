import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import collocations
from readloom.llm.queries import op13_collocations, table
from tests.llm.helpers import SF, docs, odd_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, *w[k : k + n]) for n in range(1, longest + 1) for k in range(len(w) - n + 1))
    frequent = {p: a for p, a in counts.items() if a >= least and len(p) > 2}
    best = {}
    for (lang, *p), a in frequent.items():
        longer = [b for q, b in frequent.items() if q[0] == lang and len(q) - 1 > len(p) and any(list(q[1 + k : 1 + k + len(p)]) == p for k in range(len(q) - len(p)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(p)):
            x, y = counts[lang, *p[:k]], counts[lang, *p[k:]]
            cuts.append((1_000_000 * a * a // (x * y), k, x, y))
        score, _, x, y = min(cuts)
        best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), x, y))
    out = []
    for lang, found in best.items():
        for rank, (score, a, phrase, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, x, y, totals[lang], -score))
    return sorted(out)


def test_query_against_brute_force(spark):
    rows = [(r.lang, r.text) for r in table(spark, SF, "documents").collect()]
    got = sorted(map(tuple, op13_collocations(spark, SF).collect()))
    assert got == brute(rows) and len(got) > 100


def test_odd_rows(spark):
    said = "New York city, new york! NEW\tYORK\x0bnew  york; the new york"
    rows = [(r[1], "en") for r in odd_texts()] + [(said, None)] * 3 + [(said, "")] * 12 + [("x y z " * 3_000, "en"), ("é à é à é à", "de"), ("é à", "de")]
    table = spark.createDataFrame([(t, x, k) for k, (t, x) in enumerate(rows)], "text string, lang string, a long")
    for longest, least, top in ((3, 10, 2000), (2, 1, 4), (4, 2, 50)):
        got = sorted(map(tuple, collocations.collocations(table, longest, least, top).collect()))
        assert got == brute([(x, t) for t, x in rows], longest, least, top)
    assert collocations.collocations(docs(spark, [])).count() == 0


def test_large_counts_are_exact(spark):
    counts = spark.createDataFrame([("en", 1, "a", 10**13 + 7), ("en", 1, "b", 10**13 + 9), ("en", 2, "a b", 10**13 + 1)], "lang string, size int, phrase string, a long")
    (r,) = collocations.scored(counts).collect()
    assert r.score == 1_000_000 * (10**13 + 1) ** 2 // ((10**13 + 7) * (10**13 + 9))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é.\n\t!", max_size=60), min_size=1, max_size=4), st.integers(1, 12), st.integers(2, 4))
def test_segments_and_phrases_of_any_texts(texts, most, longest):
    """Whatever the segments, each phrase is counted once, under a key of its own."""
    parts = [("xy"[k % 2], part, carried) for k, t in enumerate(texts) for part, carried in collocations.segments(t.encode(), longest, most)]
    got, seen = Counter(), {}
    if parts:
        s = collocations.Slice(parts, longest)
        ends = s.counts.cumsum()
        for k, (lang, part, _) in enumerate(parts):
            words = part.translate(collocations.TO_SPACE).split()
            assert len(words) == s.counts[k]
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    at = ends[k] - s.counts[k] + i
                    if s.valid[size - 1][at]:
                        phrase = (lang, *(w.decode() for w in words[i : i + size]))
                        got[phrase] += 1
                        assert seen.setdefault(int(s.keys[size - 1][at]), phrase) == phrase
    want = Counter()
    for k, t in enumerate(texts):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t.translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update(("xy"[k % 2], *w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    assert got == want and len(seen) == len(want)


def test_filters(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    table = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3)
    for most in (collocations.MOST_BITS, 1 << 12):  # the second is too small: it passes more, and loses none
        known = collocations.filter_of(table, most)
        assert known.holds(keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**63, 5000).view(np.uint64)
    assert collocations.filter_of(table).holds(others).mean() < 0.05
    assert not collocations.filter_of(table.limit(0)).holds(others).any()


def test_a_filter_that_passes_all_changes_nothing(spark, monkeypatch):
    rows = docs(spark, [(k, f"the big cat. the big dog the {'x' * (k % 3)} end", "a") for k in range(40)])
    want = sorted(map(tuple, collocations.collocations(rows, least=5).collect()))
    monkeypatch.setattr(collocations, "filter_of", lambda keys: collocations.Filter(np.full(64, ~np.uint64(0))))
    assert want and sorted(map(tuple, collocations.collocations(rows, least=5).collect())) == want
