"""Metrics, calibration and reports over long tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from . import ranks


def deconvolution_metrics(rows: DataFrame) -> DataFrame:
    """One row: mae, mse, kl, max_error, r2 (variance-weighted), bias and limits of agreement, by method. rows: method, sample, cell_type, target, predicted."""
    d = F.col("predicted") - F.col("target")
    t, p = F.greatest("target", F.lit(1e-8)), F.greatest("predicted", F.lit(1e-8))
    means = rows.groupBy("method", "cell_type").agg(F.avg("target").alias("_m"))
    both = rows.join(means, ["method", "cell_type"])
    per = both.groupBy("method").agg(
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), (F.sum(t * F.log(t / p)) / F.countDistinct("sample")).alias("kl"), F.max(F.abs(d)).alias("max_error"),
        (1 - F.try_divide(F.sum(d * d), F.sum((F.col("target") - F.col("_m")) * (F.col("target") - F.col("_m"))))).alias("r2"),
        F.avg(d).alias("bias"), (F.avg(d) - 1.96 * F.stddev_samp(d)).alias("low"), (F.avg(d) + 1.96 * F.stddev_samp(d)).alias("high"),
    )
    return per


def sample_metrics(rows: DataFrame) -> DataFrame:
    """mae, mse, kl and cosine by method and sample."""
    d = F.col("predicted") - F.col("target")
    t, p = F.greatest("target", F.lit(1e-8)), F.greatest("predicted", F.lit(1e-8))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    return rows.groupBy("method", "sample").agg(
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sum(t * F.log(t / p)).alias("kl"),
        F.try_divide(F.sum(F.col("target") * F.col("predicted")), norm("target") * norm("predicted")).alias("cosine"),
    )


def worst_class(rows: DataFrame) -> DataFrame:
    """By method the cell type with the largest mean error."""
    per = rows.groupBy("method", "cell_type").agg(F.avg(F.abs(F.col("predicted") - F.col("target"))).alias("mae"))
    return per.groupBy("method").agg(F.max_by("cell_type", F.struct(F.col("mae"), -F.col("cell_type"))).alias("cell_type"), F.max("mae").alias("mae"))


def summary(rows: DataFrame) -> DataFrame:
    """By method r2, the limits of agreement, those of the cell type with the widest ones (the first of equals), mae, mse and kl: the rows of a result sheet.

    rows: as for deconvolution_metrics. A method of one sample has null limits by cell type.
    """
    d = F.col("predicted") - F.col("target")
    per = rows.groupBy("method", "cell_type").agg(F.avg(d).alias("_b"), F.stddev_samp(d).alias("_s"))
    widest = per.groupBy("method").agg(F.max(F.struct(F.col("_s"), -F.col("cell_type"), F.col("_b"))).alias("_w"))
    worst = widest.select("method", (F.col("_w._b") - 1.96 * F.col("_w._s")).alias("worst_class_loa_lower"), (F.col("_w._b") + 1.96 * F.col("_w._s")).alias("worst_class_loa_upper"))
    whole = deconvolution_metrics(rows).withColumnsRenamed({"low": "loa_lower", "high": "loa_upper"})
    return whole.join(worst, "method").select("method", "r2", "loa_lower", "loa_upper", "worst_class_loa_lower", "worst_class_loa_upper", "mae", "mse", "kl")


def confusion(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """(truth, predicted, n)."""
    return rows.groupBy("truth", "predicted").agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("n"))


def classifier_metrics(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """accuracy, macro precision, recall and F1, and Matthews' coefficient, from the confusion table."""
    c = confusion(rows, weight)
    truth = c.groupBy(F.col("truth").alias("k")).agg(F.sum("n").alias("t"))
    guess = c.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("p"))
    hit = c.filter("truth = predicted").select(F.col("truth").alias("k"), F.col("n").alias("h"))
    per = truth.join(guess, "k", "full").join(hit, "k", "left").na.fill(0.0)
    precision, recall = F.coalesce(F.try_divide("h", "p"), F.lit(0.0)), F.coalesce(F.try_divide("h", "t"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("h"), F.col("p") + F.col("t")), F.lit(0.0))
    s = per.agg(
        F.sum("t").alias("s"), F.sum("h").alias("c"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.avg(precision).alias("precision"), F.avg(recall).alias("recall"), F.avg(f1).alias("f1"),
    )
    spread = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return s.select((F.col("c") / F.col("s")).alias("accuracy"), "precision", "recall", "f1", F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), spread), F.lit(0.0)).alias("mcc"))


def bin_of(x: Column, bins: int) -> Column:
    """Equal-width bins (lo, hi] of [0, 1], 0 in the first: the number of inner edges below x, edges as they are computed."""
    return edges_below([F.lit(k / bins) for k in range(1, bins)], x)


def edges_below(edges: list[Column], x: Column) -> Column:
    """The number of edges below x, 0 where it is null."""
    return sum((F.when(e < x, 1).otherwise(0) for e in edges), F.lit(0))


def reliability(rows: DataFrame, bins: int = 10, equal_counts: bool = False) -> DataFrame:
    """(bin, n, confidence, accuracy). rows: confidence, correct (0 or 1). Bins are of equal width, or between quantiles of the confidences."""
    binned = rows.select("confidence", "correct", bin_of(F.col("confidence"), bins).alias("bin"))
    if equal_counts:
        one = rows.select("confidence", "correct", F.lit(1).alias("_one"))
        edges = ranks.quantiles(one, ["_one"], "confidence", [k / bins for k in range(1, bins)])
        binned = one.join(F.broadcast(edges), "_one").withColumn("bin", edges_below([F.col("q")[k] for k in range(bins - 1)], F.col("confidence")))  # one row
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"))


def calibration_errors(rows: DataFrame, bins: int = 10, least: int = 1, equal_counts: bool = False) -> DataFrame:
    """ece, mce (bins of ``least`` rows) and Brier score."""
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    table = reliability(rows, bins, equal_counts).withColumn("_one", F.lit(1))
    binned = table.groupBy("_one").agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(F.when(F.col("n") >= least, gap)).alias("mce"))
    brier = rows.agg(F.avg((F.col("confidence") - F.col("correct")) * (F.col("confidence") - F.col("correct"))).alias("brier")).withColumn("_one", F.lit(1))
    return binned.join(brier, "_one").select("ece", "mce", "brier")


def classwise_error(rows: DataFrame, bins: int = 10, equal_counts: bool = False) -> DataFrame:
    """One row: classwise_ece, the mean over labels of the calibration error of the label's own probability. rows: label, confidence, correct (0 or 1).

    Bins are of equal width, or between quantiles of a label's confidences (equal edges hold nothing between them). The edges, a
    row a label, are broadcast: dealt by label the rows would be as many tasks as there are labels.
    """
    if equal_counts:
        edges = ranks.quantiles(rows, ["label"], "confidence", [k / bins for k in range(1, bins)])
        binned = rows.join(F.broadcast(edges), "label").withColumn("bin", edges_below([F.col("q")[k] for k in range(bins - 1)], F.col("confidence")))
    else:
        binned = rows.withColumn("bin", bin_of(F.col("confidence"), bins))
    table = binned.groupBy("label", "bin").agg(F.count("*").alias("n"), F.abs(F.avg("confidence") - F.avg("correct")).alias("gap"))
    per = table.groupBy("label").agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))
    return per.agg(F.avg("ece").alias("classwise_ece"))


def average_precision(rows: DataFrame) -> DataFrame:
    """One row: average_precision, the mean over labels of the area under precision by recall. rows: label, hit (0 or 1), score, weight.

    Equal scores are one threshold. Labels that all rows or none have are left out; without any other label the result is null.
    """
    cells = rows.groupBy("label", (-F.col("score")).alias("_v")).agg(F.sum(F.col("hit") * F.col("weight")).alias("pos"), F.sum("weight").alias("w"))
    ranked = ranks.running(cells, ["label"], "_v", ["pos", "w"]).filter("all_pos > 0 and all_pos < all_w")
    per = ranked.groupBy("label").agg(F.sum(F.col("pos") / F.col("all_pos") * F.coalesce(F.try_divide("upto_pos", "upto_w"), F.lit(0.0))).alias("ap"))
    return per.agg(F.avg("ap").alias("average_precision"))


def with_background(values: Column, threshold: float = 0.5) -> Column:
    """Index of the first largest entry, or the number of entries if the largest is below the threshold; -100 (ignored) if the entries sum to less than 0."""
    most = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(total < 0, -100).when(most < threshold, F.size(values)).otherwise(F.array_position(values, most).cast("int") - 1)


def background_probability(values: Column) -> Column:
    """values with 1 - its largest entry behind them."""
    return F.concat(values, F.array(1 - F.array_max(values)))


def on_target_score(values: Column, region_label: Column, read_label: Column) -> Column:
    """The entry of the region's own label for reads of that label, else null."""
    return F.when(region_label == read_label, F.try_element_at(values, region_label + 1))


def linear_calibrator(rows: DataFrame) -> DataFrame:
    """slope, intercept, r and the slope's standard error of target on predicted, by cell type, with n. A constant predictor has null slope."""
    r, n = F.corr("target", "predicted"), F.count(F.col("target") + F.col("predicted"))
    spread = F.try_divide(F.regr_syy("target", "predicted"), F.regr_sxx("target", "predicted"))
    error = F.sqrt(F.try_divide(F.greatest(1 - r * r, F.lit(0.0)) * spread, (n - 2).cast("double")))
    return rows.groupBy("cell_type").agg(F.regr_slope("target", "predicted").alias("slope"), F.regr_intercept("target", "predicted").alias("intercept"), r.alias("r"), error.alias("stderr"), n.alias("n"))


def slope_p_values(model: DataFrame) -> DataFrame:
    """model (of linear_calibrator) with p, two-sided, that the slope is 0: the incomplete beta function of 1 - r^2. A row a cell type; null for fewer than three points."""

    def tail(x: float, a: float, b: float = 0.5) -> float:
        """I_x(a, b) by the continued fraction, evaluated from its far end."""
        if x <= 0 or x >= 1:
            return min(max(x, 0.0), 1.0)
        if x > (a + 1) / (a + b + 2):
            return 1 - tail(1 - x, b, a)
        f = 1.0
        for m in range(200, 0, -1):
            f = 1 + m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) / f
            f = 1 - (a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1)) / f
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
        return front / a / f

    def values(batches):
        for part in batches:
            known = (part["n"] > 2) & part["r"].notna()
            p = [tail(1 - r * r, (n - 2) / 2) if ok else None for r, n, ok in zip(part["r"], part["n"], known, strict=True)]
            yield part.assign(p=pd.Series(p, index=part.index, dtype="float64"))

    return model.mapInPandas(values, ", ".join(f"`{c}` {t}" for c, t in model.dtypes) + ", p double")


def fit_parts(rows: DataFrame) -> DataFrame:
    """(method, sample, explained, total): the squares that R2 is a ratio of, by sample, around each cell type's mean target."""
    means = rows.groupBy("method", "cell_type").agg(F.avg("target").alias("_m"))
    d, t = F.col("predicted") - F.col("target"), F.col("target") - F.col("_m")
    return rows.join(means, ["method", "cell_type"]).groupBy("method", "sample").agg((F.sum(t * t) - F.sum(d * d)).alias("explained"), F.sum(t * t).alias("total"))


def in_label_order(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(sample, label, proportion): a row for each sample and label, 0 where the sample lacks it. rows: sample, cell_type, proportion; labels: label, cell_type, some dozens."""
    grid = rows.select("sample").distinct().crossJoin(F.broadcast(labels.select("label", "cell_type")))
    return grid.join(rows.select("sample", "cell_type", "proportion"), ["sample", "cell_type"], "left").na.fill(0.0, ["proportion"]).select("sample", "label", "proportion")


def grid_search(rows: DataFrame, key: str, grid: list[dict], fit, score, folds: int = 5, seed: int = 42) -> tuple[dict, list[float]]:
    """(best setting, mean score of each): fit(train, **setting) and score(model, held) over folds dealt by a hash of the key; smaller is better, the first of equals."""
    dealt = settled(rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds))))
    means = []
    for setting in grid:
        found = [score(fit(dealt.filter(F.col("_fold") != k).drop("_fold"), **setting), dealt.filter(F.col("_fold") == k).drop("_fold")) for k in range(folds)]
        means.append(sum(found) / folds)
    return grid[min(range(len(grid)), key=means.__getitem__)], means


def calibrate(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with calibrated: slope x + intercept, negative as 0, divided by the sum over the sample (1e-12 at least)."""
    w = Window.partitionBy("method", "sample")
    raw = F.greatest(F.col("slope") * F.col("predicted") + F.col("intercept"), F.lit(0.0))
    return rows.join(model.select("cell_type", "slope", "intercept"), "cell_type").withColumn("_raw", raw).withColumn("calibrated", F.col("_raw") / F.greatest(F.sum("_raw").over(w), F.lit(1e-12))).drop("_raw", "slope", "intercept")


def report(rows: DataFrame) -> DataFrame:
    """By cell type over methods: median, mean, min, max, quartiles and the consensus rank by descending median. rows: cell_type, method, proportion; repeated (cell_type, method) are averaged."""
    per = rows.groupBy("cell_type", "method").agg(F.avg("proportion").alias("p"))
    table = per.groupBy("cell_type").agg(F.median("p").alias("median"), F.avg("p").alias("mean"), F.min("p").alias("min"), F.max("p").alias("max"), F.percentile("p", F.lit(0.25)).alias("q25"), F.percentile("p", F.lit(0.75)).alias("q75"))
    return table.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("median"), "cell_type")))


def divergence(rows: DataFrame) -> DataFrame:
    """By method the sum of distances from the median over methods."""
    per = rows.groupBy("cell_type", "method").agg(F.avg("proportion").alias("p"))
    middle = per.groupBy("cell_type").agg(F.median("p").alias("m"))
    return per.join(middle, "cell_type").groupBy("method").agg(F.sum(F.abs(F.col("p") - F.col("m"))).alias("divergence"))


def best_epoch(log: DataFrame) -> DataFrame:
    """By run and metric the best epoch: the smallest value of losses, the largest of others; the earliest of equals. log: run, metric, epoch, value."""
    signed = F.when(F.col("metric").endswith("loss"), F.col("value")).otherwise(-F.col("value"))
    return log.groupBy("run", "metric").agg(F.min_by("epoch", F.struct(signed, F.col("epoch"))).alias("epoch"), F.min_by("value", F.struct(signed, F.col("epoch"))).alias("value"))
