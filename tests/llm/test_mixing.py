import random
import re
from collections import Counter, defaultdict

from readloom.llm import mixing
from tests.llm.helpers import DOCS, SF, WORDS, docs, odd_texts


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshare by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, got, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while budget > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if got[s] + budget * weight[s] / total >= cap * sizes[s]}
        if not over:
            for s in open_:
                got[s] += budget * weight[s] / total
            break
        for s in over:
            budget -= cap * sizes[s] - got[s]
            got[s] = cap * sizes[s]
        open_ -= over
    return got


def sizes_of(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += len(re.findall(WORDS, r.text or ""))
    return out


def test_targets_and_taken(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    made = mixing.taken(mixing.mix(table)).collect()
    sizes = sizes_of(table.collect())
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in made:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.source_size == sizes[r.source]
    assert len(made) == table.count()
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1, t / 100)


def brute_taken(made):
    """Words taken of each row, word by word: a source's words in order of start, blocks of them, slots of blocks."""
    rows, sources = made.rows.collect(), {r.sid: r for r in made.sources.collect()}
    times = Counter((s.sid, s.block) for s in made.slots.collect())
    out = {}
    for sid, source in sources.items():
        at, own = 0, sorted((r for r in rows if r.sid == sid and r.size), key=lambda r: r.start)
        for r in own:
            assert r.start == at and r.length == source.length  # no gap, no overlap
            out[r.rid] = sum(times[sid, w // source.length] for w in range(at, at + r.size))
            at += r.size
        assert at == source.source_size
        assert sum(n for (k, _), n in times.items() if k == sid) == source.slots
    return out


def test_taken_of_every_document_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for rows in (table, docs(spark, odd_texts())):
        made = mixing.mix(rows)
        want = brute_taken(made)
        assert {r.rid: r.taken for r in mixing.taken(made).collect() if r.size} == want


def test_small_sources_come_near_their_targets(spark):
    rng = random.Random(6)
    for _ in range(4):
        sizes = {f"s{k}": rng.choice((1, 3, 10, 49, 130, 700, 5000)) for k in range(7)} | {None: 10}
        rows = []
        for name, n in sizes.items():
            while n > 0:
                m = min(n, rng.randint(1, 60))
                rows.append((len(rows), " ".join(f"w{k}" for k in range(m)), name))
                n -= m
        made = mixing.mix(docs(spark, rows))
        got, want = defaultdict(int), brute_targets(sizes)
        for r in mixing.taken(made).collect():
            got[r.source] += r.taken
            assert r.taken <= 2 * r.size
        assert all(abs(got[s] - t) <= max(1, t / 100) for s, t in want.items()), (dict(got), want)


def test_running_sums(spark):
    rows = [(shard, sid, shard * 7 % 5 + 1) for sid in range(3) for shard in range(0, 200, sid + 1)]
    got = {(r.sid, r.shard): r.upto for r in mixing.running(spark.createDataFrame(rows, "shard long, sid int, n long"), 16).collect()}
    assert got == {(sid, shard): sum(n for s, i, n in rows if i == sid and s <= shard) for shard, sid, _ in rows}


def test_many_shards_draw_the_same_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 3)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 1)
    made = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), shard=16)
    assert {r.rid: r.taken for r in mixing.taken(made).collect() if r.size} == brute_taken(made)
    drawn = made.slots.groupBy("shard").count().collect()
    assert len(drawn) > 100 and all(r["count"] <= 17 for r in drawn if r.shard >= 0)


def test_reruns_agree_on_any_partitions(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    one = mixing.taken(mixing.mix(table)).select("doc_id", "taken").collect()
    two = mixing.taken(mixing.mix(table.repartition(7))).select("doc_id", "taken").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_odd_rows_and_clashing_columns(spark):
    rows = docs(spark, odd_texts()).selectExpr("*", "1 as rid", "2 as taken", "'x' as sid")
    made = mixing.taken(mixing.mix(rows, block=16)).collect()
    assert len(made) == len(odd_texts())
    sizes = sizes_of(rows.collect())
    want = brute_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in made)
    assert sum(r.taken for r in made if r.size == 0) == 0


def test_empty_table(spark):
    empty = docs(spark, [])
    assert mixing.taken(mixing.mix(empty)).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_only_empty_texts(spark):
    made = mixing.taken(mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)]))).collect()
    assert [(r.target, r.taken) for r in made] == [(0.0, 0), (0.0, 0)]


def test_permutation(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), 11).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_mixed_documents_hold_the_taken_words(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns
    want = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(table)).collect()}
    got, texts = defaultdict(int), {r.doc_id: re.findall(WORDS, r.text or "") for r in table.collect()}
    for r in out.collect():
        words = re.findall(WORDS, r.text)
        got[r.doc_id] += len(words)
        at = iter(texts[r.doc_id])
        assert all(w in at for w in words)  # in order
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in want.items() if v} == dict(got)
    assert DOCS


def test_slots_are_not_taken_for_their_runs(spark):
    """Slots come of runs by an explode, which Spark's estimates know nothing of: no join behind it may broadcast them."""
    made = mixing.mix(docs(spark, odd_texts()))
    plan = made.slots._jdf.queryExecution().analyzed().toString().splitlines()
    exploded = next(k for k, line in enumerate(plan) if "Generate explode(sequence(first" in line)
    assert not any("Join" in line for line in plan[:exploded])
    assert "ResolvedHint (strategy=merge)" in mixing.taken(made)._jdf.queryExecution().analyzed().toString()
