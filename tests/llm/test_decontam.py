import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import decontam
from readloom.llm.queries import op12_decontaminate, table
from tests.llm.helpers import SF, docs, odd_texts

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def windows(text, size=10):
    w = split(text)
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(texts, items, size=10):
    patterns = {}
    for i, t in items:
        for p in windows(t, size):
            patterns.setdefault(p, set()).add(i)
    out = []
    for t in texts:
        w, hit, named = split(t), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in patterns:
                    hit.update(range(k, k + n))
                    named |= patterns[p]
        out.append((len(w), sorted(hit), sorted(x for x in named if x is not None)))
    return out


def flat(row):
    return row.n_words, [k for s in row.spans for k in range(s.start, s.end)], row["items"]


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in op12_decontaminate(spark, SF).collect()}
    rows = table(spark, SF, "documents").collect()
    want = brute([r.text for r in rows], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    found = 0
    for r, (n, hit, items) in zip(rows, want, strict=True):
        g = got[r.doc_id]
        names = ",".join(sorted(map(str, items)))
        assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, len(hit), len(items), bool(hit))
        assert g.items_sha256 == hashlib.sha256(names.encode()).hexdigest()
        found += bool(hit)
    assert found


words = st.lists(st.sampled_from(["a", "B", "é", "the", "question", "Ünder", "x1", "…", "-", "\n"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(words, min_size=1, max_size=4), st.lists(words, min_size=1, max_size=5), st.integers(1, 4), st.sampled_from([3, 16, 1 << 20]), st.sampled_from([20, 1 << 20]))
def test_any_texts_in_any_pieces(texts, items, size, piece, scan):
    pieces, was = decontam.pieces, decontam.SCAN
    try:
        decontam.SCAN = scan
        decontam.pieces = lambda text, most=piece: pieces(text, most)
        rows = sorted({(" ".join(p), i) for i, t in enumerate(items) for p in windows(t, size)})
        found = decontam.Found(decontam.Search(rows), len(texts), size)
        for k, t in enumerate(texts):
            found.add(k, t.encode())
        found.scan()
    finally:
        decontam.pieces, decontam.SCAN = pieces, was
    for k, (n, hit, named) in enumerate(brute(texts, list(enumerate(items)), size)):
        assert found.words[k] == n
        assert [x for lo, hi in found.spans[k] for x in range(lo, hi)] == hit
        assert sorted(found.items[k]) == named


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(97 + x % 3 for x in b)), st.lists(st.binary(min_size=8, max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=6, unique=True), st.sampled_from([2, 4, 8]))
def test_shift_tables_lose_no_occurrence(text, patterns, block):
    text += patterns[0] + text[:7] + patterns[-1]
    got = sorted(decontam.Tables(patterns, block).occurrences(text))
    assert got == sorted((k, p) for p in patterns for k in range(len(text)) if text.startswith(p, k))


def test_odd_rows(spark):
    passage = " ".join(f"word{k}" for k in range(14))
    rows = [*odd_texts(), (20, f"Before. {passage.upper()}! after", "a"), (21, f"{passage} " * 30_000, "a"), (22, " ".join(f"word{k}" for k in range(9)), "a"), (23, "xSAME words-here", "a"), (24, "z" * 3_000_000 + " same words here", "a")]
    items = [(1, passage), (1, passage), (2, None), (3, ""), (4, "?!"), (5, "Same words HERE"), (None, "no id"), (6, " ".join(f"word{k}" for k in range(2, 13)))]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute([t for _, t, _ in rows], items)
    for shard in (decontam.SHARD, 200):
        got = decontam.mark(docs(spark, rows).selectExpr("*", "1 as spans", "'x' as items"), table, shard=shard).collect()
        assert [flat(r) for r in got] == want
    assert decontam.mark(docs(spark, []), table).count() == 0
    none = decontam.mark(docs(spark, rows), table.limit(0)).collect()
    assert [r.n_words for r in none] == [x[0] for x in want] and not any(r.spans or r["items"] for r in none)


def test_windows_of_items(spark):
    items = [(k, " ".join(f"w{i}" for i in range(n))) for k, n in enumerate((0, 1, 9, 10, 11, 30))]
    got = decontam.windows_of(spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.item_id, r.pattern) for r in got) == sorted((k, " ".join(p)) for k, t in items for p in windows(t))
