"""The tasks that a user runs, each a plan over files named in a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import alignments, baselines, evaluation, intervals, labelling, mixtures, predictions, simulation
from ..operators import reads as read_ops
from ..session import settled
from ..sources import bam, commits, fasta, files
from ..streaming import aggregates

MODELS = ("lookup", "hard_lookup", "beta")

REQUIRED = {
    "parse-alignments": ["input", "output_dir"],
    "build-dataset": ["input", "regions", "codes", "output_dir"],
    "classifier-fit": ["input", "output_dir"],
    "inference": ["input", "regions", "model", "output_dir"],
    "stream-inference": ["input", "regions", "model", "output_dir", "state_dir", "checkpoint"],
    "deconvolute-pseudobulk": ["pseudobulk", "reads", "profiles", "output_dir"],
    "generate-pseudobulk": ["input", "output_dir", "mixtures", "reads_per_mixture"],
    "fit-deconvolution": ["pseudobulk", "output_dir"],
    "fit-calibration": ["estimates", "output_dir"],
    "confidence-intervals": ["estimates", "output_dir"],
}


def validate(task: str, config: dict) -> dict:
    if task not in REQUIRED:
        raise ValueError(f"unknown task {task!r}; known: {', '.join(sorted(REQUIRED))}")
    if missing := [k for k in REQUIRED[task] if k not in config]:
        raise ValueError(f"{task}: missing {', '.join(missing)}")
    return config


def build_dataset(spark: SparkSession, config: dict) -> DataFrame:
    """Recovered reads to labelled, split, bucketed Parquet: one plan, no loop over buckets.

    Reads are split before they meet regions, whole files where a label has enough of them, so neither a file nor a read that
    lies in two regions is in two splits. Equal reads of a region and split are one row with their number.
    """
    codes = spark.read.parquet(config["codes"])
    regions = intervals.buckets(spark.read.parquet(config["regions"]), int(config.get("buckets", 16)))
    raw = settled(read_ops.adapt(files.recovered_reads(spark, config["input"]), codes))
    split = read_ops.apply_splits(raw, read_ops.plan_splits(read_ops.split_counts(raw)), ["chromosome", "read_start", "methylation_ids", "input_ids"])
    rows = read_ops.prepare(split, regions).filter(F.col("NCPGS") >= int(config.get("min_cpgs", 1)))
    rows = read_ops.deduplicate(rows, [c for c in rows.columns if c != "file"])
    rows = rows.withColumn("label", read_ops.hard_binary(F.col("original_label"), F.col("target_label")))
    files.write_buckets(rows, config["output_dir"])
    return spark.read.parquet(config["output_dir"])


def parse_alignments(spark: SparkSession, config: dict) -> DataFrame:
    """BAM files to parsed reads, as inference takes them: flags and quality, calls by tags or against a reference.

    input: a file or folder; data_type: ont, wgbs, or auto. regions: only reads that meet one. reference: FASTA, for converted reads. If no
    read passes, flags are left out; if still none does, the task raises. bam_processing: parameters of operators.alignments.parsing.
    """
    rows = bam.scan(spark, config["input"], int(config.get("part_bytes", bam.PART_BYTES)))
    kind = config.get("data_type", "auto")
    p = alignments.parsing(alignments.detect(rows) if kind == "auto" else kind, config.get("bam_processing"), config.get("chromosomes", "all"))
    if "regions" in config:
        rows = alignments.overlapping(rows, spark.read.parquet(config["regions"]))
    if p.data_type == alignments.ONT:
        parse = alignments.long_read_calls
    else:
        if "reference" not in config:
            raise ValueError("parse-alignments: converted reads need a reference")
        longest = rows.agg(F.max(F.col("read_end") - F.col("read_start"))).first()[0] or 1
        size = max(4096, 1 << int(longest + 1).bit_length())
        chunked = fasta.chunks(spark, config["reference"], size, longest + 1)
        parse = lambda r, q: alignments.bisulfite_calls(r, chunked, size, q)
    found = alignments.with_fallback(rows, p, parse)
    if found is None:
        raise ValueError(f"{config['input']}: no read passes, with or without flags")
    files.publish(found, config["output_dir"])
    return spark.read.parquet(config["output_dir"])


def predicted(rows: DataFrame, model: DataFrame, kind: str, classes: int) -> DataFrame:
    """rows (name, signature, M, U, others) with prediction_0 ... of a model that classifier-fit wrote; rows without a prediction go.

    What a model says of a read hangs on its signature, or on M and U, alone: each is asked once a region, and joined back by it.
    """
    if kind == "beta":
        keys = ["name", "M", "U"]
        found = labelling.beta_predict(rows.select(*keys).distinct(), model, labelling.class_priors(model, classes, "uniform"), classes)
    else:
        keys = ["name", "signature"]
        found = labelling.lookup_signatures(rows.select(*keys).distinct(), model, classes, hard=kind == "hard_lookup").drop("source")
    both = rows.join(found, keys).filter("prediction is not null")
    return both.select("*", *[F.col("prediction")[k].alias(f"prediction_{k}") for k in range(classes)]).drop("prediction")


def classifier_fit(spark: SparkSession, config: dict) -> DataFrame:
    """Training rows of a built dataset to a model table (soft lookup, hard lookup or Beta) and the profiles of its classes for solvers."""
    kind, classes = config.get("model", "lookup"), int(config.get("classes", 7))
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind!r}; known: {', '.join(MODELS)}")
    required = ["name", "read_start", "methylation_ids", "original_label", "target_label"]
    rows = files.training_rows(spark, config["input"], config.get("split", "train"), required, int(config.get("min_cpgs", 1)))
    rows = settled(read_ops.annotate(labelling.with_signature(rows.drop("NCPGS"))))
    if kind == "beta":
        model = mixtures.beta_fit(labelling.beta_statistics(rows, times="read_count"))
    else:
        model = (labelling.fit_lookup if kind == "lookup" else labelling.fit_hard_lookup)(rows, classes)
    files.publish(model, f"{config['output_dir']}/model")
    wide = predicted(rows, spark.read.parquet(f"{config['output_dir']}/model"), kind, classes).withColumn("_w", F.col("NCPGS") * F.col("read_count"))
    files.publish(predictions.pure_profiles(wide, "target_label", _names(classes), "_w", classes), f"{config['output_dir']}/profiles")
    return spark.read.parquet(f"{config['output_dir']}/model")


def _names(classes: int) -> list[str]:
    return [f"prediction_{k}" for k in range(classes)]


def configured_baselines(spark: SparkSession, config: dict) -> list[baselines.Baseline]:
    """The baselines of a configuration: a list of {model, atlas, regions, method, name, steps, options}; atlas and regions are Parquet tables."""
    entries = []
    for entry in config.get("baselines", []):
        if missing := [k for k in ("model", "atlas", "regions") if k not in entry]:
            raise ValueError(f"baseline {entry.get('model', '?')}: missing {', '.join(missing)}")
        given = {k: entry[k] for k in ("method", "name", "options") if k in entry}
        entries.append(baselines.Baseline(entry["model"], spark.read.parquet(entry["regions"]), spark.read.parquet(entry["atlas"]), steps=tuple(entry.get("steps", ())), **given))
    baselines.unique_labels(entries)
    return entries


#: The consumer of the regions that reads are classified in.
OWN = "classifier"


def counted(reads: DataFrame, regions: DataFrame, entries: list[baselines.Baseline]) -> DataFrame:
    """signature counts of reads (sample, chromosome, read_start, read_end, methylation_ids) in the regions of the classifier and of all baselines: one overlap, one aggregate."""
    tagged = baselines.tagged_regions({OWN: regions, **{b.label(): b.regions for b in entries}})
    return baselines.signature_counts(read_ops.trim(intervals.overlap(reads.select("sample", "chromosome", "read_start", "read_end", "methylation_ids"), tagged)))


def group_predictions(counts: DataFrame, regions: DataFrame, model: DataFrame, kind: str, classes: int) -> DataFrame:
    """predictions.aggregate() by sample and target_label of the reads that counts stand for, weighted by their known positions. regions: name, target_label, a row a target."""
    targets = regions.select("name", "target_label").distinct()
    text = F.array_join(F.transform("signature", lambda p: F.concat(p["pos"].cast("string"), F.lit(":"), p["state"].cast("string"))), ",")
    known = lambda k: F.size(F.filter("signature", lambda p: p["state"] == k))
    mine = baselines.of(counts, OWN).withColumns({"M": known(1), "U": known(0)}).withColumn("NCPGS", F.col("M") + F.col("U")).withColumn("signature", text)
    wide = predicted(mine.select("sample", "name", "signature", "M", "U", "NCPGS", "n"), model, kind, classes).join(targets, "name")
    keys = ["sample", "target_label"]
    return predictions.merged(predictions.partial(wide, keys, _names(classes), "NCPGS", "n"), keys, _names(classes))


def inference(spark: SparkSession, config: dict) -> DataFrame:
    """Parsed reads of any number of files to proportions of each: overlap, classify, aggregate by group, and solve where profiles are given.

    A sample is a file, or all input where the configuration names a sample. model: a table of classifier-fit or of class counts. With profiles
    the result is (sample, cell_type, method, proportion), with those of the configured baselines, and the groups are stored beside it; without, it
    is the groups' predictions. Reads are scanned once for all.
    """
    reads = files.parsed_reads(spark, config["input"])
    reads = reads.withColumn("sample", F.lit(config["sample"]) if "sample" in config else F.col("file"))
    regions, entries = spark.read.parquet(config["regions"]), configured_baselines(spark, config)
    return concluded(spark, settled(counted(reads, regions, entries)), regions, entries, config)


def concluded(spark: SparkSession, counts: DataFrame, regions: DataFrame, entries: list[baselines.Baseline], config: dict) -> DataFrame:
    """What inference() makes of the signature counts."""
    classes = int(config.get("classes", 7))
    grouped = group_predictions(counts, regions, spark.read.parquet(config["model"]), config.get("kind", "lookup"), classes)
    if "profiles" not in config:
        files.publish(grouped, config["output_dir"])
        return spark.read.parquet(config["output_dir"])
    files.publish(grouped, f"{config['output_dir']}/groups")
    samples = predictions.group_features(spark.read.parquet(f"{config['output_dir']}/groups"), ["sample"], "target_label", _names(classes))
    found = solved(samples, spark.read.parquet(config["profiles"]), config).select("sample", F.col("cell_type").cast("int").alias("cell_type"), "method", "proportion")
    if entries:
        found = found.unionByName(baselines.run(counts, entries, classes))
    files.publish(found, f"{config['output_dir']}/proportions")
    return spark.read.parquet(f"{config['output_dir']}/proportions")


def stream_inference(spark: SparkSession, config: dict) -> DataFrame:
    """inference() over Parquet files of reads (with read_end and file) as they arrive, a number of files a batch.

    The state is the signature counts: a batch writes its own under its number, so one that is repeated counts once, and the
    result is that of one run over all files, whatever their order. ``state_dir`` and ``checkpoint`` go on where a stopped run ended.
    """
    regions, entries = spark.read.parquet(config["regions"]), configured_baselines(spark, config)
    schema = "read_name string, chromosome string, read_start long, read_end long, methylation_ids string, file string"
    stream = aggregates.read_files(spark, config["input"], StructType.fromDDL(schema), int(config.get("files_per_batch", 1)))
    sampled = stream.withColumn("sample", F.lit(config["sample"]) if "sample" in config else F.col("file"))
    aggregates.state_stream(sampled, lambda batch: counted(batch, regions, entries), config["state_dir"], config["checkpoint"]).awaitTermination()
    keys = ["sample", "region", "name", "consumers", "signature"]
    counts = settled(aggregates.read_states(spark, config["state_dir"]).groupBy(*keys).agg(F.sum("n").alias("n")))
    return concluded(spark, counts, regions, entries, config)


def solved(samples: DataFrame, profiles: DataFrame, config: dict) -> DataFrame:
    """(sample, cell_type, method, proportion) by each of the configured methods."""
    out = None
    methods = config.get("methods", ["nnls", "psls"])
    for method in [methods] if isinstance(methods, str) else methods:
        rows = mixtures.estimate(samples, profiles, method).withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out


def deconvolute_pseudobulk(spark: SparkSession, config: dict) -> DataFrame:
    """Stored mixtures replayed and solved: (pb_index, cell_type, method, proportion, actual).

    pseudobulk: what generate-pseudobulk wrote; reads: row_id, grg, weight and prediction_0 ... of the reads it drew from;
    profiles: of classifier-fit. A mixture's reads are found by row_id, each as often as it was drawn. With baselines the reads
    also have chromosome, read_start, read_end and methylation_ids, and signatures are counted by mixture from (row_id, times).
    """
    classes = int(config.get("classes", 7))
    drawn, reads = simulation.stored(spark, config["pseudobulk"]), spark.read.parquet(config["reads"])
    replayed = predictions.replayed(drawn, reads.select("row_id", "grg", "weight", *_names(classes))).withColumn("_w", F.col("weight") * F.col("times"))
    groups = predictions.aggregate(replayed, ["pb_index", "grg"], _names(classes), "_w")
    samples = predictions.group_features(groups, ["pb_index"], "grg", _names(classes)).withColumnRenamed("pb_index", "sample")
    found = solved(samples, spark.read.parquet(config["profiles"]), config).select("sample", F.col("cell_type").cast("int").alias("cell_type"), "method", "proportion")
    if entries := configured_baselines(spark, config):
        tagged = baselines.tagged_regions({b.label(): b.regions for b in entries})
        prepared = read_ops.trim(intervals.overlap(reads.select("row_id", "chromosome", "read_start", "read_end", "methylation_ids"), tagged))
        found = found.unionByName(baselines.run(settled(baselines.mixture_counts(drawn, prepared)), entries, classes))
    actual = simulation.actual_proportions(drawn).select("pb_index", F.col("original_label").cast("int").alias("cell_type"), "actual")
    found = found.withColumnRenamed("sample", "pb_index").join(actual, ["pb_index", "cell_type"], "left").na.fill(0.0, ["actual"])
    files.publish(found, config["output_dir"])
    return spark.read.parquet(config["output_dir"])


def generate_pseudobulk(spark: SparkSession, config: dict) -> DataFrame:
    """Mixtures of reads with known proportions: (pb_index, original_label, grg, row_id, times).

    Mixtures are drawn in ranges of ``batch`` and each finished range is logged. A run that was stopped goes on with the ranges that are
    left; one with other parameters raises. The mixtures do not hang on the ranges.
    """
    reads = spark.read.parquet(config["input"])
    classes, seed, mixtures_ = int(config.get("classes", 7)), int(config.get("seed", 42)), int(config["mixtures"])
    known = {"input": config["input"], "classes": classes, "seed": seed, "mixtures": mixtures_, "reads_per_mixture": int(config["reads_per_mixture"]), "batch": int(config.get("batch", 1000))}
    log = commits.CommitLog(spark, config["output_dir"], known)
    left = log.left(commits.ranges(mixtures_, known["batch"]))
    if left:
        targets = simulation.target_proportions(spark, mixtures_, classes, seed)
        groups = settled(reads.groupBy("original_label", "grg").agg(F.sum("read_count").alias("n_reads")))
        simulation.require_reads(targets, groups)
        striped = settled(simulation.stripes(reads))
    for first, end in left:
        mine = targets.filter((F.col("pb_index") >= first) & (F.col("pb_index") < end))
        wanted = simulation.drawn_quotas(mine, groups, known["reads_per_mixture"], seed)
        log.commit((first, end), simulation.draw(reads, wanted, seed, striped))
    return simulation.stored(spark, config["output_dir"])


def fit_deconvolution(spark: SparkSession, config: dict) -> DataFrame:
    """Proportions of stored samples by each method. pseudobulk: a folder with samples and reference tables; with targets (sample, cell_type, target) and sheet_dir also a summary as CSV."""
    samples, reference = (spark.read.parquet(f"{config['pseudobulk']}/{t}") for t in ("samples", "reference"))
    files.publish(solved(samples, reference, config), config["output_dir"])
    found = spark.read.parquet(config["output_dir"])
    if "sheet_dir" in config:
        targets = spark.read.parquet(f"{config['pseudobulk']}/targets")
        files.write_sheet(evaluation.summary(found.withColumnRenamed("proportion", "predicted").join(targets, ["sample", "cell_type"])).withColumnRenamed("method", "model"), config["sheet_dir"])
    return found


def fit_calibration(spark: SparkSession, config: dict) -> DataFrame:
    """Calibrated estimates: a line a cell type, or vector scaling (kind: vector). The lines, with errors and p, are written beside them; with sheet_dir a summary of estimates before and after as CSV."""
    found = calibrated(spark, config, spark.read.parquet(config["estimates"]))
    if "sheet_dir" in config:
        before = evaluation.summary(found).withColumn("calibration_method", F.lit("none"))
        after = evaluation.summary(found.withColumn("predicted", F.col("calibrated"))).withColumn("calibration_method", F.lit(config.get("kind", "linear")))
        files.write_sheet(before.unionByName(after).withColumnRenamed("method", "deconvolver"), config["sheet_dir"])
    return found


def calibrated(spark: SparkSession, config: dict, rows: DataFrame) -> DataFrame:
    if config.get("kind", "linear") == "vector":
        keys = ["method", "sample"]
        packed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("cell_type", c))), lambda x: x[c])
        whole = settled(rows.groupBy(*keys).agg(packed("predicted").alias("predicted"), packed("target").alias("target"), F.array_sort(F.collect_list("cell_type")).alias("types")))
        classes = whole.agg(F.max(F.size("types"))).first()[0] or 0
        delta, bias = mixtures.vector_scaling(whole, classes)
        out = whole.select(*keys, F.inline(F.arrays_zip(F.col("types").alias("cell_type"), mixtures.scaled(F.col("predicted"), delta, bias).alias("calibrated"))))
        files.publish(rows.join(out, [*keys, "cell_type"]), config["output_dir"])
        return spark.read.parquet(config["output_dir"])
    model = evaluation.slope_p_values(evaluation.linear_calibrator(rows))
    if "model_dir" in config:
        files.publish(model, config["model_dir"])
    files.publish(evaluation.calibrate(rows, model), config["output_dir"])
    return spark.read.parquet(config["output_dir"])


def confidence_intervals(spark: SparkSession, config: dict) -> DataFrame:
    """(method, mean, low, high, metric) for mse, mae, kl and r2; with sheet_dir also as CSV."""
    rows, resamples = spark.read.parquet(config["estimates"]), int(config.get("resamples", 10_000))
    each = evaluation.sample_metrics(rows)
    out = mixtures.bootstrap(evaluation.fit_parts(rows).withColumnRenamed("explained", "value"), resamples, of="total").withColumn("metric", F.lit("r2"))
    for metric in ("mse", "mae", "kl"):
        out = out.unionByName(mixtures.bootstrap(each.select("method", F.col(metric).alias("value")), resamples).withColumn("metric", F.lit(metric)))
    files.publish(out, config["output_dir"])
    found = spark.read.parquet(config["output_dir"])
    if "sheet_dir" in config:
        files.write_sheet(found, config["sheet_dir"])
    return found


TASKS = {
    "parse-alignments": parse_alignments,
    "build-dataset": build_dataset,
    "classifier-fit": classifier_fit,
    "inference": inference,
    "stream-inference": stream_inference,
    "deconvolute-pseudobulk": deconvolute_pseudobulk,
    "generate-pseudobulk": generate_pseudobulk,
    "fit-deconvolution": fit_deconvolution,
    "fit-calibration": fit_calibration,
    "confidence-intervals": confidence_intervals,
}


def run(spark: SparkSession, task: str, config: dict) -> DataFrame:
    return TASKS[task](spark, validate(task, config))


__all__ = ["TASKS", "run", "validate"]
