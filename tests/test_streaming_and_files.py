import json
import os

import pytest
from pyspark.sql import functions as F

from readloom import cli
from readloom.operators import labelling, predictions
from readloom.plans import tasks
from readloom.sources import files
from readloom.sources.tables import reads, regions
from readloom.streaming import aggregates

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 7).alias("g"), (F.col("id") % 11 / 11).alias("v"), (F.col("id") % 5).cast("double").alias("w"))
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = aggregates.read_files(spark, f"{tmp_path}/in", rows.schema)
    aggregates.aggregate_stream(stream, ["g"], ["v"], "w", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    key = lambda df: sorted(tuple(round(x, 9) for x in r) for r in df.collect())
    assert key(aggregates.latest(spark, f"{tmp_path}/out")) == key(predictions.aggregate(rows, ["g"], ["v"], "w"))


def test_append_stream_keeps_its_schema(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "id * 2 as extra")
    rows.write.parquet(f"{tmp_path}/in")
    schema = spark.createDataFrame([], "id long, missing string").schema
    aggregates.append_stream(aggregates.read_files(spark, f"{tmp_path}/in", rows.schema), schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = aggregates.read_states(spark, f"{tmp_path}/out")
    assert got.columns == ["id", "missing"] and got.count() == 10


def test_windows_of_events(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = aggregates.windowed_values(events).agg(F.sum("n")).first()[0]
    assert got == events.count()


def test_recovered_reads_stay_strings(spark, tmp_path):
    (tmp_path / "s1").write_text("ref_name\tref_pos\toriginal_seq\tmethyl_seq\tctype\n" + "chr1\t100\tACGTACGTAC\t0101010101\tA\n" * 6)
    rows = files.recovered_reads(spark, str(tmp_path / "s1"))
    assert rows.first().methyl_seq == "0101010101" and rows.count() == 6


def test_layouts(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, "train"), ("b", 1, "test")], "name string, region_bucket int, split string")
    files.write_buckets(rows, f"{tmp_path}/c")
    assert files.layout(spark, f"{tmp_path}/c") == "columnar"
    assert [r.name for r in files.split_rows(spark, f"{tmp_path}/c", "test", ["name"]).collect()] == ["b"]
    rows.write.parquet(f"{tmp_path}/l/train.parquet")
    assert files.layout(spark, f"{tmp_path}/l") == "legacy"
    with pytest.raises(FileNotFoundError):
        files.layout(spark, f"{tmp_path}/none")


def test_publish_is_all_or_nothing(spark, tmp_path):
    rows = spark.range(5)
    files.publish(rows, f"{tmp_path}/x")
    with pytest.raises(FileExistsError):
        files.publish(rows, f"{tmp_path}/x")
    assert spark.read.parquet(f"{tmp_path}/x").count() == 5 and os.listdir(tmp_path) == ["x"]


def test_marker_tables_and_checks(spark):
    a = spark.createDataFrame([("1", 5, 9, "T", "r1", "hypo")], "`#chr` string, start long, end long, target string, region string, direction string")
    b = spark.createDataFrame([("chr1", 5, 9, "V", "r1", "M"), ("chr2", 1, 2, "V", "r2", "hyper")], "chr string, start long, end long, target string, name string, direction string")
    got = {r.name: (r.chr, r.target, r.direction) for r in files.marker_tables([a, b]).collect()}
    assert got == {"r1": ("chr1", "T", "U"), "r2": ("chr2", "V", "M")}
    with pytest.raises(ValueError):
        files.check_regions(b.withColumn("chr", F.lit("chrZ")))
    with pytest.raises(ValueError):
        files.check_regions(b.drop("target"))


def test_dense_predictions(spark):
    rows = spark.createDataFrame([(0, "a", 0.4), (0, "b", 0.6), (1, "a", 1.0)], "pb_index int, cell_type string, nnls double")
    assert files.dense_predictions(rows.filter("pb_index = 0")).first().asDict() == {"pb_index": 0, "a": 0.4, "b": 0.6}
    with pytest.raises(ValueError):
        files.dense_predictions(rows)
    with pytest.raises(ValueError):
        files.dense_predictions(rows.union(rows))


def test_tasks(spark, tmp_path):
    r, g = reads(spark, SF), regions(spark, SF)
    g.write.parquet(f"{tmp_path}/regions")
    spark.createDataFrame([("A", 0), ("B", 1)], "name string, code int").write.parquet(f"{tmp_path}/codes")
    named = r.select(F.col("chromosome").alias("ref_name"), F.col("read_start").alias("ref_pos"), F.col("input_ids").alias("original_seq"), F.col("methylation_ids").alias("methyl_seq"), F.when(F.col("original_label") == 0, "A").when(F.col("original_label") == 1, "B").otherwise("C").alias("ctype"))
    named.write.csv(f"{tmp_path}/raw", sep="\t", header=True)
    built = tasks.run(spark, "build-dataset", {"input": f"{tmp_path}/raw", "regions": f"{tmp_path}/regions", "codes": f"{tmp_path}/codes", "output_dir": f"{tmp_path}/built"})
    assert {x.split for x in built.select("split").distinct().collect()} == {"train", "valid", "test"}
    assert {x.original_label for x in built.select("original_label").distinct().collect()} == {0, 1}

    assert built.select("read_count").agg(F.sum("read_count")).first()[0] >= built.count()
    for kind in ("lookup", "beta"):
        tasks.run(spark, "classifier-fit", {"input": f"{tmp_path}/built", "model": kind, "classes": 2, "output_dir": f"{tmp_path}/fit_{kind}"})
        profiles = spark.read.parquet(f"{tmp_path}/fit_{kind}/profiles").collect()
        assert {x.cell_type for x in profiles} == {0, 1} and all(0 <= x.value <= 1 for x in profiles)
    with pytest.raises(ValueError):
        tasks.run(spark, "classifier-fit", {"input": f"{tmp_path}/built", "model": "other", "output_dir": f"{tmp_path}/x"})

    from readloom.catalog import signed

    labelling.class_counts(signed(spark, SF), 7).write.parquet(f"{tmp_path}/model")
    r.select("read_name", "chromosome", "read_start", F.col("input_ids").alias("seq"), F.col("methylation_ids").alias("methylation_encoding")).write.parquet(f"{tmp_path}/parsed")
    got = tasks.run(spark, "inference", {"sample": "all", "input": f"{tmp_path}/parsed", "regions": f"{tmp_path}/regions", "model": f"{tmp_path}/model", "output_dir": f"{tmp_path}/inferred"})
    assert got.count() == 7 and all(abs(sum(x[f"prediction_{k}_avg"] for k in range(7)) - 1) < 1e-9 for x in got.collect())
    solved = tasks.run(spark, "inference", {"sample": "all", "input": f"{tmp_path}/parsed", "regions": f"{tmp_path}/regions", "model": f"{tmp_path}/fit_lookup/model", "profiles": f"{tmp_path}/fit_lookup/profiles", "classes": 2, "output_dir": f"{tmp_path}/solved"}).collect()
    assert {(x["method"], x.cell_type) for x in solved} == {(m, k) for m in ("nnls", "psls") for k in (0, 1)}
    assert all(abs(sum(x.proportion for x in solved if x["method"] == m) - 1) < 1e-9 for m in ("nnls", "psls"))


def test_mixtures_are_replayed_and_solved(spark, tmp_path):
    """Reads that say their class outright: the proportions come back."""
    rows = [(k, k % 2, (k // 2) % 3, 1, 2.0, 0.9 - 0.8 * (k % 2), 0.1 + 0.8 * (k % 2)) for k in range(300)]
    reads_ = spark.createDataFrame(rows, "row_id long, original_label int, grg int, read_count int, weight double, prediction_0 double, prediction_1 double")
    reads_.write.parquet(f"{tmp_path}/reads")
    from readloom.operators import predictions

    predictions.pure_profiles(reads_, "grg", ["prediction_0", "prediction_1"], "weight", 2).write.parquet(f"{tmp_path}/profiles")
    tasks.run(spark, "generate-pseudobulk", {"input": f"{tmp_path}/reads", "mixtures": 4, "reads_per_mixture": 4000, "classes": 2, "output_dir": f"{tmp_path}/drawn"})
    got = tasks.run(spark, "deconvolute-pseudobulk", {"pseudobulk": f"{tmp_path}/drawn", "reads": f"{tmp_path}/reads", "profiles": f"{tmp_path}/profiles", "classes": 2, "output_dir": f"{tmp_path}/out"}).collect()
    assert len(got) == 4 * 2 * 2 and all(abs(x.proportion - x.actual) < 0.05 for x in got)


def test_command_line(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"estimates": "x"}))
    assert cli.main(["fit-calibration", str(path), "--dry-run"]) == 1
    assert cli.main(["fit-calibration", str(path), "--set", f"output_dir={tmp_path}/o", "--dry-run"]) == 0


def test_stores(spark, tmp_path):
    path = str(tmp_path / "store")
    tables = {"features": spark.createDataFrame([(1, 0.5)], "pb_index long, value double"), "counts": spark.createDataFrame([(1, 7)], "pb_index long, n long")}
    files.write_store(spark, path, tables, {"seed": 42})
    got, attributes = files.read_store(spark, path)
    assert attributes == {"seed": 42} and sorted(got) == ["counts", "features"] and got["counts"].collect() == [(1, 7)]
    with pytest.raises(FileExistsError):
        files.write_store(spark, path, tables)
    assert [p.name for p in tmp_path.iterdir()] == ["store"]
    (tmp_path / "old.h5").write_text("")
    for bad, error in (("old.h5", ValueError), ("nowhere", FileNotFoundError)):
        with pytest.raises(error):
            files.store_kind(spark, str(tmp_path / bad))
    spark.createDataFrame([(1, "x")], "pb_index long, value string").write.mode("overwrite").parquet(f"{path}/features")
    with pytest.raises(ValueError):
        files.read_store(spark, path)


def test_sheets_and_listed_files(spark, tmp_path):
    files.write_sheet(spark.createDataFrame([("b", 0.123456), ("a", None)], "sample string, p double"), str(tmp_path / "sheet"))
    assert spark.read.csv(str(tmp_path / "sheet"), header=True).collect() == [("a", None), ("b", "0.1235")]
    here, named = spark.createDataFrame([("x",), ("y",)], "file string"), spark.createDataFrame([("y", 1), ("z", 2)], "file string, grp int")
    assert [[r[0] for r in part.collect()] for part in files.listed_files(here, named)] == [["y"], ["x"], ["z"]]


def test_calibration_and_intervals_tasks(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    t = rng.dirichlet(np.ones(3), 30)
    p = np.abs(t + rng.normal(0, 0.03, t.shape))
    p /= p.sum(axis=1, keepdims=True)
    spark.createDataFrame([("m", s, k, float(t[s, k]), float(p[s, k])) for s in range(30) for k in range(3)], "method string, sample int, cell_type int, target double, predicted double").write.parquet(f"{tmp_path}/e")
    for kind in ("linear", "vector"):
        out = tasks.run(spark, "fit-calibration", {"estimates": f"{tmp_path}/e", "output_dir": f"{tmp_path}/{kind}", "kind": kind, "model_dir": f"{tmp_path}/{kind}_model"})
        sums = [r[0] for r in out.groupBy("sample").agg(F.sum("calibrated")).select("sum(calibrated)").collect()]
        assert len(sums) == 30 and max(abs(s - 1) for s in sums) < 1e-9
    assert spark.read.parquet(f"{tmp_path}/linear_model").filter("p < 0.01").count() == 3
    got = tasks.run(spark, "confidence-intervals", {"estimates": f"{tmp_path}/e", "output_dir": f"{tmp_path}/ci", "resamples": 500, "sheet_dir": f"{tmp_path}/ci_csv"})
    assert sorted(r.metric for r in got.collect()) == ["kl", "mae", "mse", "r2"] and got.filter("low <= mean and mean <= high").count() == 4


def test_readers_of_results(spark, tmp_path):
    (tmp_path / "atlas.tsv").write_text("CHROM\tSTART\tEND\tname\ta_METH\ta_COV\tb_METH\tb_COV\nchr1\t5\t6\tr1\t1\t2\t0\tNA\n")
    got = sorted(map(tuple, files.count_atlas(spark, str(tmp_path / "atlas.tsv"), ["a", "b"]).collect()))
    assert got == [("chr1", "r1", 5, 6, 0, 1, 2, 0.5), ("chr1", "r1", 5, 6, 1, 0, 0, None)]
    for name, rows in (("good", [(0, 0, 0.4), (0, 1, 0.6)]), ("bad", [(0, 0, 0.4)])):
        spark.createDataFrame(rows, "pb_index long, original_label int, target double").write.parquet(f"{tmp_path}/{name}")
    assert files.target_proportions(spark, f"{tmp_path}/good").count() == 2
    with pytest.raises(ValueError):
        files.target_proportions(spark, f"{tmp_path}/bad")
    with pytest.raises(ValueError):
        files.predicted_reads(spark, f"{tmp_path}/good")
    os.makedirs(tmp_path / "old")
    (tmp_path / "old" / "train.txt").write_text("name\tp\nr1\t01\n")
    assert files.split_rows(spark, str(tmp_path / "old"), "train").collect() == [("r1", "01")]
    with pytest.raises(FileNotFoundError):
        files.split_rows(spark, str(tmp_path / "old"), "test")
