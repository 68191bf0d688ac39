import random
import re

import numpy as np
import xxhash

from readloom.llm import components, simhash
from readloom.llm.queries import op8_simhash
from tests.llm.helpers import SF, WORDS, docs, odd_texts


def brute_print(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORDS, low)
    shingles = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(prints, threshold=4):
    """{id: smallest linked id} by comparing all pairs."""
    ids, bits = [i for i, _ in prints], np.array([p for _, p in prints], np.uint64)
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[k]) <= threshold):
            root[find(k)] = find(int(j))
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_query_against_brute_force(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash(spark, SF).collect()}
    table = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    groups = brute_groups(table)
    assert got == {i: (f"{p:016x}", groups[i]) for i, p in table}


def test_no_link_is_lost_among_random_flips(spark):
    rng = random.Random(4)
    prints = []
    for k in range(60):
        base = rng.getrandbits(64)
        prints.append((1000 - k, base))
        for _ in range(6):
            flipped = base
            for b in rng.sample(range(64), rng.randint(0, 6)):
                flipped ^= 1 << b
            prints.append((2000 + len(prints), flipped))
            base = flipped if rng.random() < 0.5 else base
    signed = [(i, int(np.uint64(p).view(np.int64))) for i, p in prints]
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    assert got == brute_groups(prints)


def test_split_anchors_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 20)
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = [(k, centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for k in range(150)]
    signed = [(i, int(np.uint64(p).view(np.int64))) for i, p in prints]
    got = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(signed, "doc_id long, fp long")).collect()}
    assert got == brute_groups(prints)


def test_every_neighbour_by_one_bit_meets(spark):
    tables = simhash.hamming15()
    rng = np.random.default_rng(0)
    fps = rng.integers(-(2**63), 2**63 - 1, 20, dtype=np.int64)
    for g, (shift, width) in enumerate(simhash.GROUPS):
        for b in range(width):
            other = (fps.view(np.uint64) ^ np.uint64(1 << (shift + b))).view(np.int64)
            for x, y in zip(fps, other, strict=True):
                key, _, home = simhash.anchor_rows(np.array([x]), tables)
                homes = set(key[home & (key >> 40 == g)].tolist())
                seen, _, _ = simhash.anchor_rows(np.array([y]), tables)
                assert homes & set(seen.tolist())


def test_odd_rows(spark):
    rows = docs(spark, odd_texts()).selectExpr("*", "1 as fp", "2 as component_id")
    prints = simhash.with_fingerprints(rows)
    got = simhash.groups(prints.select("doc_id", "fp", "component_id")).collect()
    assert len(got) == len(odd_texts())
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert simhash.groups(spark.createDataFrame([], "doc_id long, fp long")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}
