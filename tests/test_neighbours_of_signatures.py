"""Signatures that meet by bits (regions of few) and by parts (regions of many) are the same pairs."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import labelling

KINDS = {"few": 1000, "many": 5}


def _sets(seed: int, wide: bool) -> list[str]:
    """Signatures of up to nine positions; wide ones share bits, as their positions are more than 64 apart."""
    rng = random.Random(seed)
    at = lambda: sorted(rng.sample(range(0, 2000, 64), rng.randint(0, 9)) if wide else rng.sample(range(100, 114), rng.randint(0, 9)))
    return sorted({",".join(f"{x}:{rng.randint(0, 1)}" for x in at()) for _ in range(70)})


def _parts(s: str) -> set[str]:
    return set(s.split(",")) - {""}


def _apart(a: str, b: str) -> float:
    return 1 - len(_parts(a) & _parts(b)) / len(_parts(a) | _parts(b)) if _parts(a) | _parts(b) else 0.0


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("wide", [False, True])
def test_pairs_and_nearest(spark, monkeypatch, kind, wide):
    monkeypatch.setattr(labelling, "ALL_PAIRS", KINDS[kind])
    sets = _sets(3, wide)
    known, asked = sets[::2], sets[1::2]
    table = lambda xs: spark.createDataFrame([("r", x, [1, 2]) for x in xs] + [("q", x, [1, 2]) for x in xs[:4]], "name string, signature string, counts array<long>")
    got = {(r.name, r.signature, r.other): r.distance for r in labelling.near_pairs(table(sets), 0.6).collect()}
    assert got == {(n, a, b): _apart(a, b) for n, xs in (("r", sets), ("q", sets[:4])) for a in xs for b in xs if _apart(a, b) <= 0.6}
    want = {("r", a, b) for a in sets for b in sets if a and _parts(a) <= _parts(b)}
    assert {tuple(r) for r in labelling.supersets(table(sets)).filter("name = 'r'").collect()} == want
    near = labelling.nearest_signatures(table(asked).select("name", "signature"), table(known)).filter("name = 'r'")
    best = {a: min(_apart(a, m) for m in known) for a in asked}
    assert {(r.signature, r.other) for r in near.collect()} == {(a, m) for a in asked for m in known if _apart(a, m) == best[a] < 1}


@pytest.mark.parametrize("kind", KINDS)
def test_pooled_counts(spark, monkeypatch, kind):
    monkeypatch.setattr(labelling, "ALL_PAIRS", KINDS[kind])
    sets = _sets(4, False)
    n = {s: 1 + i % 7 for i, s in enumerate(sets)}
    table = spark.createDataFrame([("r", s, [n[s], 0]) for s in sets], "name string, signature string, counts array<long>")
    want = {}
    for s in sets:
        total = 0
        for _, o in sorted((_apart(s, o), o) for o in sets if _apart(s, o) <= 0.5):
            if total >= 12:
                break
            total += n[o]
        want[s] = [total, 0]
    assert {r.signature: r.counts for r in labelling.pooled_counts(table, 2, 12, 0.5).collect()} == want


def test_pairs_of_small_regions_are_not_shuffled(spark):
    """Counts are shuffled by region once for either side of the pairs, and nothing behind them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = spark.range(300).select((F.col("id") % 20).cast("string").alias("name"), F.concat(F.col("id").cast("string"), F.lit(":1")).alias("signature"), F.array(F.lit(1).cast("long")).alias("counts"))
        plan = labelling.pooled_counts(counts, 1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") <= 2 and "BroadcastExchange" not in plan
