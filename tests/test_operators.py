"""Semantics that the driver's tables do not reach."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import patterns, vectors
from readloom.operators import atlases, evaluation, intervals, labelers, labelling, predictions, ranks, simulation
from readloom.operators import reads as read_ops


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_interval_edges(spark):
    reads = spark.createDataFrame([("a", "chr1", 0, 9), ("b", "chr1", 20, 25), ("c", "chr2", 5, 6), ("long", "chr1", 0, 5000)], "read_name string, chromosome string, read_start long, read_end long")
    regions = spark.createDataFrame([("r1", "chr1", 11, 20), ("r2", "chr1", 10, 20), ("r3", "chr1", 26, 30), ("wide", "chr1", 1, 4000)], "name string, chr string, start long, end long")
    got = {(r.read_name, r.name) for r in intervals.overlap(reads, regions).collect()}
    want = {(a, n) for a, c, s, e in [("a", "chr1", 0, 9), ("b", "chr1", 20, 25), ("c", "chr2", 5, 6), ("long", "chr1", 0, 5000)] for n, rc, rs, re in [("r1", "chr1", 11, 20), ("r2", "chr1", 10, 20), ("r3", "chr1", 26, 30), ("wide", "chr1", 1, 4000)] if c == rc and s < re and e >= rs - 1}
    assert got == want
    assert intervals.overlap(reads, regions).count() == len(want)  # once each
    assert {(r.read_name, r.name) for r in intervals.overlap(reads, regions, (7, 49, 343)).collect()} == want


def test_many_regions_are_not_broadcast(spark):
    """The estimate of a narrow table of regions is small, whatever the bins make of it: no collecting at the driver."""
    regions = spark.range(60_000).select(F.lit("chr1").alias("chr"), (F.col("id") * 16 + 1).alias("start"), (F.col("id") * 16 + 8).alias("end"), F.col("id").cast("string").alias("name"))
    reads = spark.range(1000).select(F.col("id").alias("read_name"), F.lit("chr1").alias("chromosome"), (F.col("id") * 160).alias("read_start"), (F.col("id") * 160 + 7).alias("read_end"))
    both = intervals.overlap(reads, regions)
    assert "BroadcastExchange" not in both._jdf.queryExecution().sparkPlan().toString() and "BroadcastHashJoin" not in both._jdf.queryExecution().sparkPlan().toString()
    assert both.count() == 1000
    assert "BroadcastHashJoin" in intervals.overlap(reads, regions.limit(50))._jdf.queryExecution().sparkPlan().toString()


def test_split_long(spark):
    rows = spark.createDataFrame([("a", "ACGTA", "01201"), ("b", "AC", "22"), ("c", "", ""), ("d", None, None)], "read_name string, input_ids string, methylation_ids string")
    got = [tuple(r) for r in read_ops.split_long(rows, 2).collect()]
    assert got == [("a", "AC", "01", 2), ("a", "GT", "20", 1), ("a", "A", "1", 1), ("b", "AC", "22", 0), ("c", "", "", 0), ("d", None, None, 0)]


def test_trim(spark):
    row = spark.createDataFrame([("chr1", 5, 14, "ACGTACGTAC", "0120120120", 9, 12)], "chromosome string, read_start long, read_end long, input_ids string, methylation_ids string, region_start long, region_end long")
    r = read_ops.trim(row).first()
    assert (r.read_start, r.read_end, r.input_ids, r.methylation_ids) == (8, 11, "TACG", "0120")


def test_states(spark):
    rows = spark.createDataFrame([("1110",), ("0001",), ("0101",), ("2222",), ("",)], "p string")
    assert [r[0] for r in rows.select(patterns.read_state(F.col("p"))).collect()] == ["M", "U", "X", "X", "X"]


def test_nan_and_null_in_weighted_means(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0), (1, float("nan"), 1.0), (1, 3.0, 0.0), (2, 0.4, 6.0), (2, 0.6, 6.0), (None, 1.0, 1.0)], "g int, v double, w double")
    got = {r.g: r for r in predictions.aggregate(rows, ["g"], ["v"], "w").collect()}
    assert set(got) == {1, 2}
    assert got[1].v_avg == 2.0 and math.isnan(got[1].v_wavg) and got[1].n_reads == 3
    assert abs(got[2].v_wavg - 0.5) < 1e-12 and got[2].total_weight == 12.0
    raw = predictions.aggregate(rows, ["g"], ["v"], "w", raw_total=True).filter("g = 1").first()
    assert raw.total_weight == 3.0 < got[1].total_weight


def test_fill_strategies(spark):
    groups = spark.createDataFrame([(1, 0.9, 0.1, 5.0, 3, "x")], "k int, prediction_0_wavg double, prediction_1_wavg double, total_weight double, n_reads long, name string")
    dim = spark.createDataFrame([(1,), (2,)], "k int")
    cols = ["prediction_0_wavg", "prediction_1_wavg"]
    rows = {r.k: r for r in predictions.fill_missing(groups, dim, "k", cols, "zeroes", 1.0).collect()}
    assert (rows[2].prediction_0_wavg, rows[2].total_weight, rows[2].n_reads, rows[2].name, rows[2].label) == (0.0, 1.0, 0, "", -1)
    assert rows[1].label == 0
    assert predictions.fill_missing(groups, dim, "k", cols, "uniform_number", 1.0).filter("k = 2").first().prediction_0_wavg == 0.5
    with pytest.raises(ValueError):
        predictions.fill_missing(groups, dim, "k", cols, "other", 1.0)


def test_prediction_columns():
    assert predictions.prediction_columns(["prediction", "prediction_10", "prediction_2", "methylation_level", "prediction_x"]) == ["prediction_2", "prediction_10", "methylation_level"]


def test_deduplicate_sums_counts_and_groups_nulls(spark):
    rows = spark.createDataFrame([("a", None, 2), ("a", None, 3), ("b", 1, 1)], "k string, x int, read_count long")
    assert {(r.k, r.x): r.read_count for r in read_ops.deduplicate(rows, ["k", "x"]).collect()} == {("a", None): 5, ("b", 1): 1}


def planned_by_hand(sizes, shares=(("train", 0.7), ("valid", 0.15), ("test", 0.15))):
    """file -> split of three files or more."""
    quota, total = dict(shares), sum(sizes.values())
    got, files = {n: [] for n in quota}, sorted(sizes, key=lambda f: (-sizes[f], f))
    for k, f in enumerate(files):
        empty = [n for n in quota if not got[n]]
        lack = {n: total * quota[n] - sum(sizes[x] for x in got[n]) for n in quota}
        best = max(empty, key=quota.get) if len(empty) >= len(files) - k else max(lack, key=lack.get)
        got[best].append(f)
    return {f: n for n, fs in got.items() for f in fs}


def test_split_plans(spark):
    rng = random.Random(2)
    tables = {k: {f"f{j}": rng.choice((1, 5, 10, 100, 1000)) for j in range(rng.randint(3, 8))} for k in range(30)} | {90: {"a": 9, "b": 7}, 91: {"a": 100}, 92: {"a": 1000, "b": 1, "c": 1}}
    counts = spark.createDataFrame([(f, k, n) for k, t in tables.items() for f, n in t.items()], "file string, original_label int, n_reads long")
    plan = {(r.original_label, r.file): (r.split, r.train_share, r.valid_share) for r in read_ops.plan_splits(counts).collect()}
    for k, t in tables.items():
        if len(t) >= 3:
            assert {f: plan[k, f][0] for f in t} == planned_by_hand(t)
            assert {plan[k, f][0] for f in t} == {"train", "valid", "test"}
    assert plan[90, "a"] == ("train", None, None) and plan[90, "b"] == ("by_read", 0.0, 0.5)
    assert plan[91, "a"][0] == "by_read" and [round(x, 9) for x in plan[91, "a"][1:]] == [0.7, 0.15]


def test_splits_are_applied(spark):
    rows = [(k, "a" if k < 600 else "b", 0) for k in range(1000)] + [(k, "a", 1) for k in range(1000, 2000)]
    table = spark.createDataFrame(rows, "read_name long, file string, original_label int")
    plan = read_ops.plan_splits(read_ops.split_counts(table))
    one = {r.read_name: r.split for r in read_ops.apply_splits(table, plan, ["read_name"]).collect()}
    assert one == {r.read_name: r.split for r in read_ops.apply_splits(table.repartition(7), plan, ["read_name"]).collect()}
    assert len(one) == 2000 and all(one[k] == "train" for k in range(600))
    tail = [one[k] for k in range(600, 1000)]
    assert (tail.count("valid"), tail.count("test"), tail.count("train")) == (200, 200, 0)
    alone = [one[k] for k in range(1000, 2000)]
    assert (alone.count("train"), alone.count("valid"), alone.count("test")) == (700, 150, 150)


def test_mates(spark):
    rows = [("p", 10, 14, "01222"), ("p", 13, 17, "20111"), ("q", 1, 2, "01"), ("t", 1, 2, "01"), ("t", 1, 2, "01"), ("t", 5, 6, "11"), ("gap", 1, 2, "10"), ("gap", 5, 6, "01")]
    got = {(r.k, r.read_start): (r.read_end, r.methylation_ids) for r in read_ops.merge_mates(spark.createDataFrame(rows, "k string, read_start long, read_end long, methylation_ids string"), ["k"]).collect()}
    assert got["p", 10] == (17, "01220111")
    assert got["gap", 1] == (6, "102201")
    assert got["q", 1] == (2, "01") and len([k for k in got if k[0] == "t"]) == 2


def test_sequence_expressions(spark):
    r = one(
        spark,
        aligned=patterns.aligned_sequence(F.lit("ACGTACGT"), F.lit("2S3M1D1I2M2N")),
        mm=patterns.modification_calls(F.lit("C+h,9;C+m?,1,0,2;A+a,4;")),
        off=patterns.modification_offset(F.lit("C+h,9,8;C+m?,1,0,2;")),
        cpg=patterns.call_cpgs(F.lit("ACGTCGCG"), F.array(F.lit(200), F.lit(10))),
        both=patterns.add_modifications(F.array(F.lit(200), F.lit(3)), F.array(F.lit(100), F.lit(4))),
        fwd=patterns.call_bisulfite(F.lit("ACGCGT"), F.lit("ATGCGT"), False),
        rev=patterns.call_bisulfite(F.lit("ACGCGT"), F.lit("ACACGT"), True),
        enc=patterns.encode_positions(F.lit(5), F.array(F.lit(1), F.lit(3)), F.array(F.lit(1), F.lit(0))),
        codes=patterns.base_codes(F.lit("ATCGN"), F.lit("01020")),
        lists=patterns.merge_lists(F.lit("b,a"), F.lit("c,b")),
        short=patterns.kmers(F.lit("AC"), 3),
        starts=patterns.sliding_windows(F.lit(11), 4, 3),
        none=patterns.jaccard_distance(F.array().cast("array<int>"), F.array().cast("array<int>")),
    )
    assert r.aligned == "GTANGTNN"[:3] + "N" + "GT" + "NN"
    assert r.mm == [1, 0, 2] and r.off == 2
    assert r.cpg == [1, 0, 2] and r.both == [255, 7]
    assert r.fwd == "202122"[:1] + "0" + "2" + "1" + "22" and r.rev == "202122"[:1] + "0" + "2" + "1" + "22"
    assert r.enc == "21202" and r.codes == [1, 5, 3, 4, 0] and r.lists == "a,b,c"
    assert r.short == "" and r.starts == [0, 3, 6, 7] and r.none == 0.0


def test_vector_expressions(spark):
    r = one(spark, s=vectors.simplex(F.array(F.lit(0.2), F.lit(0.9), F.lit(-1.0))), z=vectors.normalised(F.array(F.lit(-1.0), F.lit(0.0))), u=vectors.normalised_or_uniform(F.array(F.lit(-1.0), F.lit(0.0))), t=vectors.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))), o=vectors.smoothed(F.lit(1), 2))
    assert [round(x, 9) for x in r.s] == [0.15, 0.85, 0.0]
    assert r.z == [0.0, 0.0] and r.u == [0.5, 0.5] and r.t == 1
    assert [round(x, 9) for x in r.o] == [0.05, 0.95]


def test_beta_identity(spark):
    rows = spark.createDataFrame([("x", "r", 2, 1)], "read_name string, name string, M int, U int")
    params = spark.createDataFrame([("r", 0, 4.0, 1.0), ("r", 1, 1.0, 4.0)], "name string, original_label int, eta double, rho double")
    priors = spark.createDataFrame([(0, 0.5), (1, 0.5)], "original_label int, prior double")
    beta = lambda a, b: math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
    like = [beta(1 + e, r) ** 2 * beta(e, 1 + r) / beta(e, r) ** 3 for e, r in ((4.0, 1.0), (1.0, 4.0))]
    got = labelling.beta_predict(rows, params, priors, 2).first().prediction
    assert [round(x, 9) for x in got] == [round(x / sum(like), 9) for x in like]


def test_lookup_sources(spark):
    model = spark.createDataFrame([("r", "1:0,2:1", [3, 1]), ("r", "1:0,2:0", [0, 4]), ("r", "9:1", [1, 1])], "name string, signature string, counts array<long>")
    reads = spark.createDataFrame([("a", "r", "1:0,2:1"), ("b", "r", "1:0"), ("c", "r", "7:1"), ("d", "other", "1:0")], "read_name string, name string, signature string")
    got = {r.read_name: (r.source, [round(x, 6) for x in r.prediction]) for r in labelling.lookup(reads, model, 2).collect()}
    assert got["a"] == ("exact", [0.75, 0.25])
    assert got["b"] == ("1nn", [0.375, 0.625])  # both at distance one half
    assert got["c"] == ("1nn", [0.4, 0.6])  # all of the region at distance 1
    assert got["d"] == ("none", [0.5, 0.5])


def test_atlas_order_and_ties(spark):
    rows = spark.createDataFrame([("t", 1, 0.5), ("t", 0, 0.5), ("t", 2, 0.9)], "target string, cluster int, mean double")
    assert {r.cluster: r["rank"] for r in atlases.cluster_ranks(rows).collect()} == {2: 0, 0: 1, 1: 2}


def test_calibration_bins(spark):
    rows = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.30000000000000004,), (1.0,)], "x double")
    assert [r[0] for r in rows.select(evaluation.bin_of(F.col("x"), 10)).collect()] == [0, 0, 2, 3, 9]


def test_empty_tables(spark):
    reads = spark.createDataFrame([], "read_name string, chromosome string, read_start long, read_end long, input_ids string, methylation_ids string, original_label int")
    regions = spark.createDataFrame([], "name string, chr string, start long, end long, target_label int, direction string")
    rows = read_ops.prepare(reads, regions)
    assert rows.count() == 0 and atlases.uxm_atlas(rows, 3).count() == 0 and labelling.class_weights(rows).count() == 0


def test_columns_are_resolved(spark):
    rows = spark.createDataFrame([("A", "1")], "seq string, methyl_seq string")
    assert read_ops.resolve(rows, "input_ids") == "seq" and read_ops.resolve(rows, "methylation_ids") == "methyl_seq"
    with pytest.raises(ValueError):
        read_ops.resolve(rows, "chromosome")


def pooled_by_brute_force(region, min_reads, most):
    """signature -> (counts, number of signatures) of one region, from the definition."""
    sets = {s: frozenset(s.split(",")) if s else frozenset() for s in region}
    apart = lambda a, b: 1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 0.0
    out = {}
    for own in region:
        taken = {s for s in region if sets[own] <= sets[s]}
        if sum(map(sum, (region[s] for s in taken))) < min_reads:
            near = sorted((apart(own, s), s) for s in region if s not in taken)
            for d, s in near:
                line = [(d, s), *sorted((apart(own, h), h) for h in region if sets[s] < sets[h] and h not in taken)]
                for far, member in line:
                    if far > most or sum(map(sum, (region[t] for t in taken))) >= min_reads:
                        break
                    taken.add(member)
                else:
                    continue
                break
        out[own] = ([sum(c) for c in zip(*(region[s] for s in taken))], len(taken))
    return out


def test_superset_pooling(spark):
    rng = random.Random(3)
    regions = {"r": {"a,b": [1, 0], "a,b,c": [0, 2], "a,b,c,d": [4, 0], "a,x": [8, 0], "z": [0, 16]}}
    for k in range(12):
        regions[f"q{k}"] = {",".join(sorted(rng.sample("abcdefgh", rng.randint(0, 5)))): [rng.randint(1, 3), rng.randint(0, 2)] for _ in range(40)}
    rows = [(name, s, c) for name, region in regions.items() for s, c in region.items()]
    counts = spark.createDataFrame(rows, "name string, signature string, counts array<long>")
    for least, most in ((8, 0.7), (12, 0.5), (30, 0.6)):
        got = {(r.name, r.signature): (r.counts, r.pooled) for r in labelling.superset_pooled_counts(counts, 2, least, most).collect()}
        assert got == {(name, s): v for name, region in regions.items() for s, v in pooled_by_brute_force(region, least, most).items()}


def test_near_pairs_and_supersets(spark):
    rng = random.Random(5)
    sets = sorted({",".join(sorted(rng.sample("abcdefghij", rng.randint(0, 6)))) for _ in range(80)})
    counts = spark.createDataFrame([("r", s, [1]) for s in sets], "name string, signature string, counts array<long>")
    parts = lambda s: set(s.split(",")) - {""}
    apart = lambda a, b: 1 - len(parts(a) & parts(b)) / len(parts(a) | parts(b)) if parts(a) | parts(b) else 0.0
    for most in (0.0, 0.41, 0.5, 0.8, 0.99):
        got = {(r.signature, r.other): r.distance for r in labelling.near_pairs(counts, most).collect()}
        want = {(a, b): apart(a, b) for a in sets for b in sets if apart(a, b) <= most}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert {(r.signature, r.other) for r in labelling.supersets(counts).collect()} == {(a, b) for a in sets for b in sets if a and parts(a) <= parts(b)}


def test_fitted_lookups(spark):
    rows = spark.createDataFrame([("r", "1:0", 0)] * 40 + [("r", "1:1", 1)] * 20 + [("r", "2:1", 0)] * 2 + [("r", "2:1", 1)], "name string, signature string, original_label int")
    model = labelling.fit_lookup(rows, 2)
    soft = {r.signature: (r.label, [round(x, 6) for x in r.counts]) for r in model.collect()}
    assert soft["1:0"] == ([1.0, 0.0], [30.0, 0.0])  # 40 x 31.5 / 42
    assert [round(x, 6) for x in soft["2:1"][0]] == [0.5, 0.5] and soft["2:1"][1] == [1.5, 1.5]  # 2 x 31.5 / 42, 1 x 31.5 / 21
    few = spark.createDataFrame([("r", "1:0", 0)] * 300 + [("r", "1:1", 1)] * 20 + [("r", "2:1", 0)] * 2, rows.schema)
    hard = labelling.fit_hard_lookup(few, 2)
    assert {r.signature: r.counts for r in hard.collect()} == {"1:0": [1.0, 0.0], "1:1": [0.0, 1.0], "2:1": [1.0, 0.0]}
    reads = spark.createDataFrame([("a", "r", "1:1"), ("b", "q", "1:1")], "read_name string, name string, signature string")
    assert {r.read_name: r.prediction for r in labelling.lookup(reads, hard, 2, hard=True).collect()} == {"a": [0.0, 1.0], "b": [0.0, 1.0]}


def test_hard_lookups_want_a_class_that_dominates_all_reads(spark):
    schema = "name string, signature string, original_label int"
    with pytest.raises(ValueError):
        labelling.fit_hard_lookup(spark.createDataFrame([("r", "1:0", 0)] * 50 + [("r", "1:1", 1)] * 50, schema), 2)
    mixed = [("r", "1:0", 0)] * 960 + [("r", "1:1", 1)] * 49 + [("r", "2:1", 0)] * 40 + [("r", "2:1", 1)]
    assert labelling.fit_hard_lookup(spark.createDataFrame(mixed, schema), 2).count() == 3  # one signature may be mixed


def test_the_nearest_pool_weighted_counts(spark):
    """Neighbours with 40 and 400 reads at one distance: the larger weighs ten times as much."""
    rows = [("r", "1:0,2:1", 0)] * 40 + [("r", "1:0,3:1", 1)] * 400 + [("q", "9:1", 0)] * 360
    model = labelling.fit_lookup(spark.createDataFrame(rows, "name string, signature string, original_label int"), 2)
    reads = spark.createDataFrame([("a", "r", "1:0"), ("b", "r", "1:0,2:1"), ("c", "r", "1:0,2:0,4:1,5:1")], "read_name string, name string, signature string")
    got = {r.read_name: (r.source, [round(x, 6) for x in r.prediction]) for r in labelling.lookup(reads, model, 2).collect()}
    assert got == {"a": ("1nn", [0.090909, 0.909091]), "b": ("exact", [1.0, 0.0]), "c": ("1nn", [0.090909, 0.909091])}


def test_nearest_signatures(spark):
    rng = random.Random(8)
    draw = lambda: ",".join(sorted(rng.sample("abcdefghijklmnop", rng.randint(0, 7))))
    model, asked = sorted({draw() for _ in range(60)}), sorted({draw() for _ in range(60)})
    asked = [s for s in asked if s not in model]
    parts = lambda s: set(s.split(",")) - {""}
    apart = lambda a, b: 1 - len(parts(a) & parts(b)) / len(parts(a) | parts(b))
    want = set()
    for a in asked:
        best = min(apart(a, m) for m in model)
        want |= {(a, m) for m in model if apart(a, m) == best and best < 1}
    table = lambda xs: spark.createDataFrame([("r", x) for x in xs], "name string, signature string")
    assert {(r.signature, r.other) for r in labelling.nearest_signatures(table(asked), table(model)).collect()} == want


def test_labels_of_reads_without_one(spark):
    rows = spark.createDataFrame([("a", "r", "x"), ("b", "r", "y")], "read_name string, name string, signature string")
    labels = spark.createDataFrame([("r", "x", [0.25, 0.75])], "name string, signature string, soft_label array<double>")
    priors = spark.createDataFrame([(0, 0.9), (1, 0.1)], "original_label int, prior double")
    got = lambda f: {r.read_name: r.soft_label for r in labelling.label_reads(rows, labels, 2, f).collect()}
    assert got(None) == {"a": [0.25, 0.75], "b": [0.5, 0.5]} and got(priors) == {"a": [0.25, 0.75], "b": [0.9, 0.1]}


def test_drawn_quotas(spark):
    from readloom.operators import simulation

    targets = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.8), (1, 1, 1.0)], "pb_index long, original_label int, target double")
    cells = [(0, g, 5) for g in range(250)] + [(1, g, 5 if g < 200 else 0) for g in range(250)]
    got = simulation.drawn_quotas(targets, spark.createDataFrame(cells, "original_label int, grg int, n_reads long"), 1000, 7).toPandas()
    sums = got.groupby(["pb_index", "original_label"]).quota.sum().to_dict()
    assert sums[0, 0] == 200  # fewer reads than groups: none is lost
    assert 800 - 200 < sums[0, 1] <= 800 and 1000 - 200 < sums[1, 1] <= 1000  # the remainder of empty groups' quota
    assert got[got.original_label == 1].grg.max() == 199
    assert got[got.original_label == 0].quota.nunique() > 2  # depth differs by group


def test_merged_intervals_over_bins(spark):
    rng = random.Random(8)
    rows = [(rng.choice(("a", "b", None)), s, s + rng.choice((0, 3, 10, 200))) for s in (rng.randint(0, 3000) for _ in range(400))]
    table = spark.createDataFrame(rows, "chromosome string, start long, end long")
    for gap in (0, 1, 7):
        want = []
        for key in ("a", "b", None):
            for _, s, e in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
                if want and want[-1][0] == key and s <= want[-1][2] + gap:
                    want[-1][2] = max(want[-1][2], e)
                else:
                    want.append([key, s, e])
        for width in (16, 100, 1 << 16):
            got = [list(r) for r in intervals.merge(table, ["chromosome"], gap=gap, width=width).collect()]
            assert sorted(got, key=str) == sorted(want, key=str), (gap, width)


def test_quantiles_are_exact_whatever_the_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(v)) for k in range(3) for v in [*rng.exponential(3.0, 200 + k), *[1.5] * 50, 1e6]] + [(3, 2.0), (4, None), (None, 1.0)]
    shares = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in ranks.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", shares).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[3] == [2.0] * 6
    for k in range(3):
        assert np.allclose(got[k], np.quantile([v for i, v in rows if i == k], shares))


def test_running_sums_over_ranges(spark):
    cells = spark.createDataFrame([("a", float(v), v) for v in range(100)] + [("b", 5.0, 1)], "k string, v double, n long")
    for n in (1, 7, 1024):
        got = ranks.running(cells, ["k"], "v", ["n"], n).collect()
        assert all(r.upto_n == (r.v * (r.v + 1) / 2 if r.k == "a" else 1) and r.all_n == (4950 if r.k == "a" else 1) for r in got)


def test_average_precision_by_hand(spark):
    rows = [(0, 1, 0.9, 1.0), (0, 0, 0.8, 1.0), (0, 1, 0.8, 1.0), (0, 0, 0.1, 1.0), (1, 1, 0.5, 1.0)]
    frame = spark.createDataFrame(rows, "label int, hit int, score double, weight double")
    assert abs(evaluation.average_precision(frame).first()[0] - (0.5 * 1 + 0.5 * 2 / 3)) < 1e-12  # label 1 has no other rows
    doubled = frame.withColumn("weight", F.when(F.col("hit") == 1, 2.0).otherwise(1.0))
    assert abs(evaluation.average_precision(doubled).first()[0] - (0.5 * 1 + 0.5 * 4 / 5)) < 1e-12
    assert evaluation.average_precision(frame.filter("label = 1")).first()[0] is None


def test_p_values_of_slopes(spark):
    rows = spark.createDataFrame([("t", (2.228139**2 / (2.228139**2 + 10)) ** 0.5, 12), ("zero", 0.0, 9), ("line", 1.0, 9), ("few", 0.5, 2), ("none", None, 5), ("two", -(1 / 3**0.5), 4)], "cell_type string, r double, n long")
    got = {r.cell_type: r.p for r in evaluation.slope_p_values(rows).collect()}
    assert abs(got["t"] - 0.05) < 1e-6 and got["zero"] == 1 and got["line"] == 0 and got["few"] is None and got["none"] is None
    assert abs(got["two"] - (1 - 1 / 3**0.5)) < 1e-9  # two degrees of freedom have a closed form


def test_background_and_order(spark):
    rows = spark.createDataFrame([([0.2, 0.6],), ([0.4, 0.4],), ([0.5, 0.5],), ([-100.0, -100.0],)], "v array<double>")
    assert [r[0] for r in rows.select(evaluation.with_background(F.col("v"))).collect()] == [1, 2, 0, -100]
    labels = spark.createDataFrame([(0, "x"), (1, "y")], "label int, cell_type string")
    found = spark.createDataFrame([("s", "y", 1.0), ("t", "x", 0.3), ("t", "y", 0.7)], "sample string, cell_type string, proportion double")
    assert sorted(map(tuple, evaluation.in_label_order(found, labels).collect())) == [("s", 0, 0.0), ("s", 1, 1.0), ("t", 0, 0.3), ("t", 1, 0.7)]


def test_grid_search_takes_the_best(spark):
    rows = spark.range(40).select("id", (F.col("id") % 4).cast("double").alias("y"))
    fit = lambda train, shift: train.agg(F.avg("y")).first()[0] + shift
    score = lambda model, held: held.agg(F.avg((F.col("y") - model) * (F.col("y") - model))).first()[0]
    best, means = evaluation.grid_search(rows, "id", [{"shift": 3.0}, {"shift": 0.0}], fit, score, folds=3)
    assert best == {"shift": 0.0} and means[1] < means[0]


def test_stored_groups(spark):
    groups = spark.createDataFrame([(1, 0.5, 0.5, 3)], "target_label int, prediction_1_wavg double, prediction_0_wavg double, n_reads long")
    assert predictions.target_columns(groups).columns == ["target_label", "prediction_0_wavg", "prediction_1_wavg", "n_reads"]
    assert predictions.require_predictions(groups, 2) == ["prediction_0_wavg", "prediction_1_wavg"]
    with pytest.raises(KeyError):
        predictions.require_predictions(groups, 3)
    rows = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 1)], "split string, original_label int, read_count int")
    first, again = (sorted(map(tuple, predictions.table_statistics(r).collect())) for r in (rows, rows.orderBy(F.desc("read_count")).repartition(3)))
    assert first == again and first[0][:5] == ("a", 5, 2, 2, 0)
    assert predictions.unpadded(spark.createDataFrame([(-100,), (1,), (None,)], "label int")).count() == 1
    assert predictions.known_predictions(spark.createDataFrame([(None,), (1.0,), (float("nan"),)], "p double"), ["p"]).count() == 1


def test_calls_are_complete(spark):
    rows = spark.createDataFrame([("ACGCG", [1, 2]), ("ACGCG", [1]), ("AA", [])], "s string, ml array<int>")
    assert [r[0] for r in rows.select(patterns.complete_calls(F.col("s"), F.col("ml"))).collect()] == [True, False, True]


def test_windows_of_least_entropy(spark):
    rows = spark.createDataFrame([(1, "0101" + "1111"), (2, "2222"), (3, "01")], "id int, p string")
    got = {r.id: (r.start, r.known, r.entropy) for r in patterns.lowest_entropy_window(rows, ["id"], "p", 4, 2, 2).collect()}
    assert got == {1: (4, 4, 0.0), 2: (0, 0, None), 3: (0, 2, 1.0)}


def test_labels_side_by_side(spark):
    rows = [("r1", 0, "01", 0, 0, "train"), ("r1", 0, "01", 1, 0, "train"), ("r1", 0, "11", 1, 0, "test"), ("r1", 0, "01", 0, 0, "test")]
    frame = spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "read_name string, name string, read_start long, methylation_ids string, original_label int, target_label int, split string").withColumn("soft_label", F.lit("own"))
    config = {"a": {"type": "data_driven_soft", "perform_pooling": False}, "b": {"type": "archetype"}, "c": {"type": "hard_binary"}, "d": {"type": "hard_with_background"}, "e": {"type": "smoothed_hard_with_background"}}
    got = {r.read_name: r for r in labelers.apply(frame, config, 2, ["train"]).collect()}
    assert len(got) == 4 and all(r.soft_label == "own" for r in got.values())
    assert [got[k].a for k in "0123"] == [[0.5, 0.5]] * 4 and got["2"].b == [0.5, 0.5]  # r1/11 is not among the training rows
    assert [got[k].c for k in "0123"] == [1, 0, 0, 1] and [got[k].d for k in "0123"] == [0, 2, 2, 0] and len(got["0"].e) == 3
    prior = spark.createDataFrame([(0, 0.9), (1, 0.1)], "original_label int, prior double")
    assert {r.read_name: r.a for r in labelers.apply(frame, {"a": config["a"]}, 2, ["train"], prior, "global_prior").collect()}["2"] == [0.9, 0.1]
    whole = {r.read_name: r.a for r in labelers.apply(frame, {"a": config["a"]}, 2).collect()}
    assert whole["2"] == [0.0, 1.0] and abs(sum(whole["0"]) - 1) < 1e-12
    for bad in ({}, {"a": {"type": "none"}}, {"a": {"type": "archetype", "distance_name": "edit"}}, {"a": {"type": "archetype", "ctype_prior_type": "inv_global_freq"}}):
        with pytest.raises(ValueError):
            labelers.apply(frame, bad, 2)


def test_token_numbers(spark):
    words = patterns.token_vocabulary(3)
    assert len(words) == 69 and words[5] == "AAA" and words[68] == "TTT"
    some = ["AAA", "ACG", "TTT", "ANA", "AC"]
    got = spark.createDataFrame([(some,)], "t array<string>").select(patterns.token_numbers(F.col("t"), 3)).first()[0]
    assert got == [words.index(w) if w in words else 1 for w in some]
    rows = spark.createDataFrame([(1, "NNNN", "2222"), (2, "AC", "01"), (3, "ACGT", "2012")], "id int, input_ids string, methylation_ids string")
    assert patterns.token_rows(rows, ["id"]).collect() == [(3, 0, ["ACG", "CGT"], "01", 2)]


def test_thinning_and_weights(spark):
    rows = spark.createDataFrame([(k, k % 4) for k in range(100)], "id int, read_count int")
    got = read_ops.thinned(rows, "id", 60).collect()
    assert sum(r.read_count for r in got) == 60 and all(1 <= r.read_count <= r.id % 4 for r in got)
    assert sum(r.read_count for r in read_ops.thinned(rows, "id", 1000).collect()) == 150
    assert sorted(map(tuple, got)) == sorted(map(tuple, read_ops.thinned(rows.repartition(7), "id", 60).collect()))
    assert abs(read_ops.mean_weights(rows).agg(F.avg("weight")).first()[0] - 1) < 1e-12


def test_codes_are_whole(spark):
    rows = spark.createDataFrame([(1, 2)], "original_label int, target_label int")
    assert read_ops.keep_labels(rows, spark.createDataFrame([(1, 0), (2, 1)], "old int, new int")).collect() == [(0, 1)]
    for bad in ([(1, 0), (2, 2)], [(1, 0), (2, 0)]):
        with pytest.raises(ValueError):
            read_ops.keep_labels(rows, spark.createDataFrame(bad, "old int, new int"))


def test_quantile_bins(spark):
    rows = spark.createDataFrame([(k / 100, k % 2) for k in range(1, 101)], "confidence double, correct int")
    table = sorted(map(tuple, evaluation.reliability(rows, 4, equal_counts=True).select("bin", "n").collect()))
    assert table == [(0, 25), (1, 25), (2, 25), (3, 25)]


def test_modification_values(spark):
    rows = spark.createDataFrame([("C+h,1,2;C+m,0,3,1;", [9, 8, 7, 6, 5]), ("C+m,0;", [4]), ("C+h,1;", [1]), ("C+m,1,1;", [3])], "tag string, ml array<int>")
    assert [r[0] for r in rows.select(patterns.modification_values(F.col("tag"), F.col("ml"))).collect()] == [[7, 6, 5], [4], [], [3]]


def test_group_numbers_and_priors(spark):
    rows = spark.createDataFrame([("liver",), ("7",)], "k string")
    assert [r.grg for r in simulation.group_index(rows, "k", {"liver": 3}).collect()] == [3, 7]
    prior = spark.createDataFrame([(0.5, 0.5)], "a double, b double")
    assert predictions.prior_matrix(prior, ["b"], 1).columns == ["b"]
    for columns, n in ((["c"], 1), (["a"], 2)):
        with pytest.raises(ValueError):
            predictions.prior_matrix(prior, columns, n)


def test_codes_of_missing_annotations(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")
    assert sorted((r.x or "", r.code) for r in atlases.annotation_codes(rows, "x").collect()) == [("", -1), ("a", 0), ("b", 1), ("b", 1)]


def test_pure_mixture_is_its_reads(spark):
    reads = spark.createDataFrame([(str(k), k % 2, 0, 1 + k % 3, float(k % 2), 2) for k in range(50)], "row_id string, original_label int, grg int, read_count int, p double, w int")
    targets = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (2, 0, 0.25), (2, 1, 0.75)], "pb_index long, original_label int, target double")
    got = {r.pb_index: r for r in simulation.pseudobulk(reads, targets, ["p"], "w", 400, 1).collect()}
    assert got[0].p_wavg == 0 and got[1].p_wavg == 1 and abs(got[2].p_wavg - 0.75) < 1e-9 and all(r.n_reads == 400 and r.total_weight == 800 for r in got.values())


def test_bisulfite_calls_of_many_cgs(spark):
    """Against the definition by position, with CGs at either end, none, and reads shorter than the reference."""
    rng = random.Random(3)
    rows = [("".join(rng.choice("ACG") for _ in range(rng.randint(0, 24))), "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 26)))) for _ in range(200)] + [("CGCG", "CACG"), (None, "CG"), ("ACG", None)]

    def want(ref, read, shift, yes, no):
        if ref is None:
            return None
        at = lambda k: read[k + shift : k + shift + 1] if read else ""
        return "".join(("1" if at(k) == yes else "0" if at(k) == no else "2") if ref[k : k + 2] == "CG" else "2" for k in range(len(ref))) or "2"

    table = spark.createDataFrame(rows, "a string, b string")
    got = table.select("a", "b", patterns.call_bisulfite(F.col("a"), F.col("b"), False).alias("f"), patterns.call_bisulfite(F.col("a"), F.col("b"), True).alias("r")).collect()
    assert all(r.f == want(r.a, r.b, 0, "C", "T") and r.r == want(r.a, r.b, 1, "G", "A") for r in got) and len(got) == 203
    step = patterns.call_bisulfite(F.col("a"), F.col("b"), False)
    assert "sequence(" not in table.select(step)._jdf.queryExecution().optimizedPlan().toString()  # no step by position


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_stay_rows_of_their_read(spark):
    """Best windows are found without a row a window, and numbers are combined by hash."""
    rng = random.Random(5)
    rows = [(k % 150, "".join(rng.choice("0122") for _ in range(rng.randint(0, 20)))) for k in range(300)] + [(900, "2222222222"), (901, None)]
    table = spark.createDataFrame(rows, "id int, p string")
    best = patterns.best_window(table, ["id"], "p", 4)
    want = {}
    for k, p in rows:
        for s in range(max(len(p or "") - 4, 0) + 1):
            n = sum(c != "2" for c in (p or "")[s : s + 4])
            if n and (k not in want or (-n, s) < want[k]):
                want[k] = (-n, s)
    assert {r.id: (-r.known, r.start) for r in best.collect()} == want
    assert "Generate" not in _plan(best) and "SortAggregate" not in _plan(best)
    low = patterns.lowest_entropy_window(table, ["id"], "p", 4, 2, 2)
    assert "Generate" not in _plan(low) and low.count() == 152


def test_kmers_of_a_read_are_made_once(spark):
    rows = spark.createDataFrame([(1, "ACGTNACGTAC", "01201201201"), (2, "NNN", "012"), (3, "AC", "01"), (4, "ACG", "0")], "id int, input_ids string, methylation_ids string")
    windows = patterns.token_rows(rows, ["id"], 3, 3, 2)
    got = sorted((r.id, r.start, " ".join(r.tokens), r.states, r.ncpgs_marked) for r in windows.collect())
    assert got == [(1, 0, "ACG CGT ACG", "120", 2), (1, 2, "ACG CGT GTA", "012", 2), (1, 3, "CGT GTA TAC", "120", 2), (4, 0, "ACG", "", 0)]
    assert windows._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == 1
