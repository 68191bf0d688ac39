"""One pass for all baselines, held against plain Python over the same reads."""

import math
import random

import numpy as np
import pytest

from readloom.operators import baselines, intervals, mixtures
from readloom.operators import reads as read_ops

TYPES = 2
READ = "sample string, read_name string, chromosome string, read_start long, read_end long, methylation_ids string"


def made(seed=4, n=400):
    rng = random.Random(seed)
    places = [("chr1", 100 * k + 1, 100 * k + rng.choice([20, 60, 130]), f"r{k}") for k in range(8)]
    rows = []
    for i in range(n):
        start = rng.randrange(0, 900)
        pattern = "".join(rng.choice("0012") if (start + k) % 7 else "1" for k in range(rng.randint(4, 150)))
        rows.append((f"s{i % 3}", f"q{i}", "chr1", start, start + len(pattern) - 1, pattern))
    return rows, places


def cut(rows, places):
    """(sample, read, region, [(pos, state)]) by brute force."""
    for sample, name, _, start, end, pattern in rows:
        for _, lo, hi, region in places:
            if start < hi and end >= lo - 1:
                yield sample, name, region, [(p, int(c)) for k, c in enumerate(pattern) if c != "2" and lo - 1 <= (p := start + k) < hi]


def tables(spark, places):
    rng = random.Random(9)
    regions = spark.createDataFrame(places, "chr string, start long, end long, name string")
    reference = [(name, p, [rng.randint(0, 5), rng.randint(0, 5)]) for _, lo, hi, name in places for p in range(lo - 1, hi, 2)]
    reference = [(n, p, m, [x + rng.randint(0, 3) for x in m]) for n, p, m in reference]
    return regions, spark.createDataFrame(reference, "name string, pos long, ref_meth array<long>, ref_cov array<long>"), reference


def test_tagged_regions(spark):
    a = spark.createDataFrame([("chr1", 1, 5, "x"), ("chr1", 9, 12, "y"), (None, 1, 2, "z")], "chr string, start long, end long, name string")
    b = spark.createDataFrame([("chr1", 1, 5, "x"), ("chr1", 1, 5, "other"), ("chr1", 1, 5, "x")], "chr string, start long, end long, name string")
    got = baselines.tagged_regions({"one": a, "two": b}).orderBy("region").collect()
    assert [(r.name, r.consumers, r.region) for r in got] == [("other", ["two"], 0), ("x", ["one", "two"], 1), ("y", ["one"], 2)]


def test_states_and_positions_from_one_table(spark):
    rows, places = made()
    regions, _, _ = tables(spark, places)
    counts = baselines.signature_counts(read_ops.trim(intervals.overlap(spark.createDataFrame(rows, READ), baselines.tagged_regions({"u": regions, "c": regions.filter("name <> 'r0'")}))))
    states, positions = {}, {}
    for sample, _, region, known in cut(rows, places):
        if len(known) >= 4:
            rate = sum(s for _, s in known) / len(known)
            states.setdefault((sample, region), []).append("M" if rate >= 0.75 else "U" if rate <= 0.25 else "X")
        if region != "r0":
            for p, s in known:
                positions.setdefault((sample, region, p), []).append(s)
    got = {(r.sample, r.name): (r.M, r.U, r.X, r["count"], r.sf) for r in baselines.marker_states(baselines.of(counts, "u")).collect()}
    assert got == {k: (*(v.count(s) for s in "MUX"), len(v), v.count("U") / len(v)) for k, v in states.items()}
    got = {(r.sample, r.name, r.pos): (r.meth, r.cov) for r in baselines.position_counts(baselines.of(counts, "c")).collect()}
    assert got == {k: (sum(v), len(v)) for k, v in positions.items()}


def test_read_likelihoods_and_em_steps(spark):
    rows, places = made()
    regions, reference, plain = tables(spark, places)
    whole = baselines.Baseline("celfieish", regions, reference, steps=(1, 4))
    counts = baselines.one_pass(spark.createDataFrame(rows, READ), [whole])
    shift = lambda b: 1e-10 if b == 0 else 1 - 1e-10 if b == 1 else b
    betas = {(n, p): [shift(x / c) for x, c in zip(m, cov, strict=True)] for n, p, m, cov in plain if all(cov)}
    logs = {}
    for sample, _, region, known in cut(rows, places):
        if met := [(betas[region, p], s) for p, s in known if (region, p) in betas]:
            logs.setdefault(sample, []).append([sum(math.log(b[k] if s else 1 - b[k]) for b, s in met) for k in range(TYPES)])
    for sample, lls in list(logs.items()):
        alpha, table = np.full(TYPES, 1 / TYPES), np.array(lls)
        for step in range(1, 5):
            z = table + np.log(alpha)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            alpha = (z / z.sum(axis=1, keepdims=True)).mean(axis=0)
            if step in (1, 4):
                logs[sample, step] = alpha
    got = baselines.run(counts, [whole], TYPES).collect()
    assert len(got) == 3 * 2 * TYPES
    for r in got:
        assert abs(r.proportion - logs[r.sample, int(r.method.split("_")[1])][r.cell_type]) < 1e-9
    ended = {(r.sample, r.cell_type): r.proportion for r in baselines.run(counts, [baselines.Baseline("celfieish", regions, reference)], TYPES).collect()}
    assert all(abs(sum(ended[s, k] for k in range(TYPES)) - 1) < 1e-9 for s in ("s0", "s1", "s2"))


def test_drawn_reads_count_as_often_as_they_are_drawn(spark):
    rows, places = made(n=60)
    regions, reference, _ = tables(spark, places)
    times = {k: [(17 * k + 5 * i) % 4 for i in range(60)] for k in range(2)}
    drawn = spark.createDataFrame([(k, f"q{i}", times[k][i]) for k in times for i in range(60) if times[k][i]], "pb_index long, row_id string, times long")
    every = [(str(k), f"q{i}/{j}", *rows[i][2:]) for k in times for i in range(60) for j in range(times[k][i])]
    both = [baselines.Baseline(kind, regions, reference, **more) for kind, more in (("celfie", {"options": {"restarts": 0}, "steps": (1, 3)}), ("epidish", {"method": "cp"}), ("epidish", {"method": "cbs"}), ("celfieish", {}))]
    prepared = read_ops.trim(intervals.overlap(spark.createDataFrame(rows, READ).withColumnRenamed("read_name", "row_id"), baselines.tagged_regions({b.label(): regions for b in both})))
    got = {(str(r.sample), r.method, r.cell_type): r.proportion for r in baselines.run(baselines.mixture_counts(drawn, prepared), both, TYPES).collect()}
    want = {(r.sample, r.method, r.cell_type): r.proportion for r in baselines.run(baselines.one_pass(spark.createDataFrame(every, READ), both), both, TYPES).collect()}
    assert got.keys() == want.keys() and {m for _, m, _ in got} == {"celfie_1_steps", "celfie_3_steps", "epidish_cp", "epidish_cbs", "celfieish"}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_markers_find_the_mixture(spark):
    """Reads of two types that differ in every U marker: the share of U reads tells the mixture."""
    places = [("chr1", 100 * k + 1, 100 * k + 8, f"r{k}") for k in range(10)]
    regions = spark.createDataFrame(places, "chr string, start long, end long, name string")
    reads = [("s", f"q{k}{i}", "chr1", 100 * k, 100 * k + 7, ("0" if (i < 30) == (k % 2 == 0) else "1") * 8) for k in range(10) for i in range(100)]
    atlas = [(f"r{k}", d, t, float(t == k % 2) if d == "U" else 0.5) for k in range(10) for t in range(2) for d in "UM"]
    uxm = baselines.Baseline("uxm", regions, spark.createDataFrame(atlas, "name string, direction string, cell_type int, value double"))
    got = {r.cell_type: r.proportion for r in baselines.run(baselines.one_pass(spark.createDataFrame(reads, READ), [uxm]), [uxm], 2).collect()}
    assert abs(got[0] - 0.3) < 1e-9 and abs(got[1] - 0.7) < 1e-9


def test_names_and_empty_tables(spark):
    rows, places = made(n=20)
    regions, reference, _ = tables(spark, places)
    with pytest.raises(ValueError):
        baselines.Baseline("other", regions, reference)
    with pytest.raises(ValueError):
        baselines.unique_labels([baselines.Baseline("epidish", regions, reference)] * 2)
    assert baselines.unique_labels([baselines.Baseline("epidish", regions, reference, m) for m in ("rpc", "cp", "cbs")]) == ["epidish", "epidish_cp", "epidish_cbs"]
    empty = spark.createDataFrame([], READ)
    for b in (baselines.Baseline("celfie", regions, reference), baselines.Baseline("celfieish", regions, reference), baselines.Baseline("epidish", regions, reference)):
        assert baselines.run(baselines.one_pass(empty, [b]), [b], TYPES).count() == 0


def test_support_vectors_are_optimal():
    """The dual's conditions hold, and the shares of a known mixture come back."""
    rng = np.random.default_rng(2)
    a = rng.random((120, 4))
    p = np.array([0.5, 0.3, 0.2, 0.0])
    assert np.abs(mixtures.support_vectors(a, a @ p + rng.normal(0, 0.01, 120)) - p).max() < 0.02
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    for nu in (0.25, 0.5, 0.75):
        w = mixtures.nu_svr(x, y, nu)

        def loss(w, nu=nu):
            """Least of the primal over the width and the offset of the tube: both are order statistics of the residuals."""
            r = y - x @ w
            best = math.inf
            for e in np.unique(np.abs(np.subtract.outer(r, r))) / 2:
                for b in np.concatenate([r - e, r + e]):
                    best = min(best, nu * 60 * e + np.maximum(0, np.abs(r - b) - e).sum())
            return 0.5 * w @ w + best

        base = loss(w)
        assert all(loss(w + d) >= base - 1e-6 for d in rng.normal(0, 0.02, (4, 3)))


@pytest.mark.parametrize("longest", [10, 300, 100_000])
def test_reads_of_any_length_meet_regions(spark, longest):
    rng = random.Random(longest)
    reads = [(f"q{k}", f"chr{k % 2}", s := rng.randrange(0, 2 * longest), s + rng.randrange(0, longest) - (k % 11 == 0)) for k in range(300)]
    regions = [(f"r{k}", f"chr{k % 2}", s := rng.randrange(1, 2 * longest), s + rng.randrange(0, longest)) for k in range(60)]
    met = intervals.overlap(spark.createDataFrame(reads, "read_name string, chromosome string, read_start long, read_end long"), spark.createDataFrame(regions, "name string, chr string, start long, end long"))
    assert sorted((r.read_name, r.name) for r in met.collect()) == sorted((a, b) for a, c, s, e in reads for b, d, lo, hi in regions if c == d and s < hi and e >= lo - 1)


def test_a_read_is_one_row_of_the_join(spark):
    reads = spark.range(500).selectExpr("cast(id as string) as read_name", "'chr1' as chromosome", "id * 1000 as read_start", "id * 1000 + 99999 as read_end")
    regions = spark.createDataFrame([("r", "chr1", 100, 200)], "name string, chr string, start long, end long")
    assert intervals.overlap(reads, regions).count() == 1
    plan = intervals.overlap(reads, regions)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # of the regions
