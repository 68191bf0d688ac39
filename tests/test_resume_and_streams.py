"""Runs that are stopped and go on; states of streams; intervals by resampling in Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.operators import labelling, mixtures, predictions, simulation
from readloom.plans import tasks
from readloom.sources import commits, files
from readloom.sources.tables import reads, regions
from readloom.streaming import aggregates

SF = "/root/testdata/sf0.001"


def test_a_stopped_simulation_goes_on(spark, tmp_path, monkeypatch):
    rows = [(k, k % 3, k % 4, 1 + k % 2) for k in range(400)]
    spark.createDataFrame(rows, "row_id long, original_label int, grg int, read_count int").write.parquet(f"{tmp_path}/reads")
    config = {"input": f"{tmp_path}/reads", "mixtures": 10, "reads_per_mixture": 200, "classes": 3, "batch": 3}
    whole = tasks.run(spark, "generate-pseudobulk", config | {"output_dir": f"{tmp_path}/whole"})
    real, calls = simulation.draw, []

    def failing(*args, **more):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return real(*args, **more)

    monkeypatch.setattr(simulation, "draw", failing)
    mine = config | {"output_dir": f"{tmp_path}/mine"}
    with pytest.raises(RuntimeError):
        tasks.run(spark, "generate-pseudobulk", mine)
    assert commits.read(spark, f"{tmp_path}/mine").select("pb_index").distinct().count() == 6
    (tmp_path / "mine" / "unfinished-1").mkdir()
    got = tasks.run(spark, "generate-pseudobulk", mine)
    assert len(calls) == 3 + 2  # the two ranges that were left
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and not (tmp_path / "mine" / "unfinished-1").exists()
    tasks.run(spark, "generate-pseudobulk", mine)
    assert len(calls) == 5
    with pytest.raises(ValueError):
        tasks.run(spark, "generate-pseudobulk", mine | {"reads_per_mixture": 300})
    unbroken = tasks.run(spark, "generate-pseudobulk", config | {"batch": 1000, "output_dir": f"{tmp_path}/one"})
    assert sorted(map(tuple, unbroken.collect())) == sorted(map(tuple, whole.collect()))


def test_commit_log(spark, tmp_path):
    assert commits.ranges(7, 3) == [(0, 3), (3, 6), (6, 7)] and commits.ranges(0, 3) == []
    with pytest.raises(ValueError):
        commits.ranges(3, 0)
    assert commits.parameter_hash({"a": 1, "b": 2}) == commits.parameter_hash({"b": 2, "a": 1}) != commits.parameter_hash({"a": 1})
    log = commits.CommitLog(spark, str(tmp_path / "t"), {"a": 1})
    with pytest.raises(FileNotFoundError):
        commits.read(spark, str(tmp_path / "t"))
    log.commit((0, 2), spark.range(2))
    log.commit((0, 2), spark.range(5))  # the first stays
    assert log.left([(0, 2), (2, 4)]) == [(2, 4)] and commits.read(spark, str(tmp_path / "t")).count() == 2
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("")
    with pytest.raises(ValueError):
        commits.CommitLog(spark, str(tmp_path / "other"), {"a": 1})


def parsed(spark, n=None):
    cols = ["read_name", "chromosome", "read_start", "read_end", "methylation_ids", "file"]
    rows = reads(spark, SF).select(*cols)
    return rows if n is None else rows.limit(n)


def test_stream_inference_equals_one_run(spark, tmp_path):
    places = regions(spark, SF)
    places.write.parquet(f"{tmp_path}/regions")
    places.select("name", F.explode(F.sequence("start", "end")).alias("pos")).select("name", "pos", F.array(F.col("pos") % 3, F.lit(2)).alias("ref_meth"), F.array(F.lit(2), F.lit(3)).cast("array<bigint>").alias("ref_cov")).write.parquet(f"{tmp_path}/atlas")
    from readloom.catalog import signed

    labelling.class_counts(signed(spark, SF), 7).write.parquet(f"{tmp_path}/model")
    for k in range(4):
        parsed(spark).filter(F.crc32("read_name") % 4 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    profiles = spark.range(7).select(F.explode(F.array(*[F.concat(F.col("id").cast("string"), F.lit(f"/prediction_{j}")) for j in range(7)])).alias("feature"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("cell_type"))
    profiles.withColumn("value", F.when(F.split("feature", "_")[1].cast("int") == F.col("cell_type"), 0.9).otherwise(0.02)).write.parquet(f"{tmp_path}/profiles")
    config = {"input": f"{tmp_path}/in", "regions": f"{tmp_path}/regions", "model": f"{tmp_path}/model", "profiles": f"{tmp_path}/profiles",
              "baselines": [{"model": "celfieish", "atlas": f"{tmp_path}/atlas", "regions": f"{tmp_path}/regions", "steps": [2]}]}
    config["classes"] = 7
    with pytest.raises(ValueError):
        tasks.run(spark, "inference", config | {"baselines": [{"model": "uxm"}], "output_dir": f"{tmp_path}/x"})
    config["baselines"] = []
    once = tasks.run(spark, "inference", config | {"output_dir": f"{tmp_path}/once"})
    more = {"state_dir": f"{tmp_path}/states", "checkpoint": f"{tmp_path}/log"}
    streamed = tasks.run(spark, "stream-inference", config | more | {"output_dir": f"{tmp_path}/streamed"})
    key = lambda r: (r.sample, r.cell_type, r.method)
    a, b = {key(r): r.proportion for r in once.collect()}, {key(r): r.proportion for r in streamed.collect()}
    assert a.keys() == b.keys() and len({s for s, _, _ in a}) == 9 and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    parsed(spark, 50).withColumn("file", F.lit("new")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    again = tasks.run(spark, "stream-inference", config | more | {"output_dir": f"{tmp_path}/again"})
    c = {key(r): r.proportion for r in again.collect()}
    assert all(abs(c[k] - b[k]) < 1e-9 for k in b) and {s for s, _, _ in c} == {s for s, _, _ in b} | {"new"}


def test_mates_of_one_name_are_told_apart(spark, tmp_path):
    model = spark.createDataFrame([("r", "100:0", [0, 4]), ("r", "100:1", [4, 0])], "name string, signature string, counts array<long>")
    rows = spark.createDataFrame([("q", "r", "100:0", 0, 1), ("q", "r", "100:1", 1, 0)], "read_name string, name string, signature string, M int, U int")
    assert {r.signature: r.prediction_0 for r in tasks.predicted(rows, model, "lookup", 2).collect()} == {"100:0": 0.0, "100:1": 1.0}


def test_repeated_batches_count_once(spark, tmp_path):
    spark.range(6).selectExpr("id", "1 as n").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: aggregates.read_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    aggregates.state_stream(stream(), lambda b: b, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    aggregates.state_stream(stream(), lambda b: b, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()  # the log is lost: the batch comes again
    assert aggregates.read_states(spark, f"{tmp_path}/out").count() == 6
    with pytest.raises(FileNotFoundError):
        aggregates.read_states(spark, f"{tmp_path}/nowhere")
    with pytest.raises(FileNotFoundError):
        aggregates.latest(spark, f"{tmp_path}/nowhere")


def test_parts_of_predictions_merge(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(k % 3, [0.1 * k, None, nan][k % 7 == 5 and 1 or k % 7 == 6 and 2 or 0], float(k % 4), 1 + k % 3) for k in range(40)] + [(None, 0.5, 1.0, 1)], "g int, p double, w double, n int")
    every = rows.select("g", "p", "w", F.explode(F.sequence(F.lit(1), "n")))
    want = {r.g: r for r in predictions.aggregate(every, ["g"], ["p"], "w").collect()}
    parts = predictions.partial(rows.filter("n < 3"), ["g"], ["p"], "w", "n").unionByName(predictions.partial(rows.filter("n = 3"), ["g"], ["p"], "w", "n"))
    for r in predictions.merged(parts, ["g"], ["p"]).collect():
        w = want[r.g]
        same = lambda a, b: (a != a and b != b) or abs(a - b) < 1e-9
        assert all(same(r[c], w[c]) for c in ("p_avg", "p_wavg", "total_weight", "n_reads"))


def test_buckets_are_ranges(spark, tmp_path):
    rows = spark.range(2000).selectExpr("cast(id % 2 as int) as region_bucket", "concat('n', id % 5) as name", "id as read_start")
    files.write_buckets(rows, f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b")
    assert back.count() == 2000 and back.filter("bucket <> region_bucket").count() == 0


def test_resamples_are_multinomial_and_do_not_hang_on_partitions(spark):
    rng = np.random.default_rng(3)
    values = [("a", float(v), 1.0, int(n)) for v, n in zip(rng.normal(2, 1, 300), rng.integers(1, 4, 300), strict=True)] + [("b", 1.0, 1.0, 5), ("b", 3.0, 1.0, 5)]
    cells = spark.createDataFrame(values, "method string, value double, _of double, n long")
    got = {(r.method, r.resample): (r.top, r.low) for r in mixtures.resampled_sums(cells, 400, 7, block_rows=16).collect()}
    again = {(r.method, r.resample): (r.top, r.low) for r in mixtures.resampled_sums(cells.repartition(7), 400, 7, block_rows=16).collect()}
    assert got.keys() == again.keys() and all(np.allclose(got[k], again[k]) for k in got)
    n = sum(x[3] for x in values if x[0] == "a")
    assert all(abs(got["a", k][1] - n) < 1e-9 and abs(got["b", k][1] - 10) < 1e-9 for k in range(400))
    means = np.array([got["a", k][0] / n for k in range(400)])
    all_a = np.repeat([x[1] for x in values if x[0] == "a"], [x[3] for x in values if x[0] == "a"])
    assert abs(means.mean() - all_a.mean()) < 4 * all_a.std() / np.sqrt(n * 400) and 0.85 < means.std() / (all_a.std() / np.sqrt(n)) < 1.15
    ones = np.array([(got["b", k][0] - 10) / 2 for k in range(400)])  # of ten draws those of the larger value
    assert np.allclose(ones, np.rint(ones)) and abs(ones.mean() - 5) < 0.35 and 1.3 < ones.std() < 1.9


def test_intervals_of_ties_and_nulls(spark):
    rows = spark.createDataFrame([("same", 1.5)] * 4 + [("one", 2.0), ("m", None)] + [("m", float(k % 5)) for k in range(200)], "method string, value double")
    got = {r.method: r for r in mixtures.bootstrap(rows, 600).collect()}
    assert (got["same"].low, got["same"].high) == (1.5, 1.5) and (got["one"].low, got["one"].high) == (2.0, 2.0)
    assert got["m"].mean == 2.0 and got["m"].low < 2.0 < got["m"].high and got["m"].high - got["m"].low < 0.6
    assert mixtures.bootstrap(rows.limit(0), 10).count() == 0
