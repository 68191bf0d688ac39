"""Aggregating read-level predictions by region group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WEIGHT = 1e-10


def nan_as_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def weighted(values: str, weight: Column) -> Column:
    """Sum of w v over sum of w; NaN if a value is NaN or null."""
    v = F.col(values)
    broken = F.bool_or(v.isNull() | F.isnan(v))
    return F.when(broken, F.lit(float("nan"))).otherwise(F.sum(weight * v) / F.sum(weight))


def aggregate(rows: DataFrame, keys: list[str], columns: list[str], weight: str, raw_total: bool = False) -> DataFrame:
    """Per group and column: <c>_avg (NaN and null skipped) and <c>_wavg (NaN spreads); total_weight and n_reads. Rows with a null key go.

    Weights are clipped at 1e-10; total_weight sums the clipped ones, or the raw ones with raw_total.
    """
    w = F.greatest(F.col(weight).cast("double"), F.lit(LEAST_WEIGHT))
    known = rows.dropna(subset=keys)
    return known.groupBy(*keys).agg(
        *[F.avg(nan_as_null(F.col(c))).alias(f"{c}_avg") for c in columns],
        *[weighted(c, w).alias(f"{c}_wavg") for c in columns],
        F.sum(F.col(weight).cast("double") if raw_total else w).alias("total_weight"),
        F.count("*").alias("n_reads"),
    )


def partial(rows: DataFrame, keys: list[str], columns: list[str], weight: str, times: str | None = None) -> DataFrame:
    """What merged() needs of a part of the rows: sums by group. Parts may come in any order; a part that is there twice counts twice. Rows with a null key go.

    times: the column with the number of reads that a row stands for.
    """
    n = F.col(times).cast("long") if times else F.lit(1).cast("long")
    w = F.greatest(F.col(weight).cast("double"), F.lit(LEAST_WEIGHT)) * n
    each = []
    for c in columns:
        v = nan_as_null(F.col(c))
        each += [F.sum(v * n).alias(f"{c}_sum"), F.sum(F.when(v.isNotNull(), n)).alias(f"{c}_n"), F.sum(w * v).alias(f"{c}_wsum"), F.bool_or(v.isNull()).alias(f"{c}_broken")]
    return rows.dropna(subset=keys).groupBy(*keys).agg(*each, F.sum(w).alias("total_weight"), F.sum(F.col(weight).cast("double") * n).alias("raw_weight"), F.sum(n).alias("n_reads"))


def merged(states: DataFrame, keys: list[str], columns: list[str], raw_total: bool = False) -> DataFrame:
    """aggregate() of all rows from the partial() states of their parts."""
    total = F.sum("total_weight")
    return states.groupBy(*keys).agg(
        *[(F.sum(f"{c}_sum") / F.sum(f"{c}_n")).alias(f"{c}_avg") for c in columns],
        *[F.when(F.bool_or(f"{c}_broken"), F.lit(float("nan"))).otherwise(F.sum(f"{c}_wsum") / total).alias(f"{c}_wavg") for c in columns],
        (F.sum("raw_weight") if raw_total else total).alias("total_weight"),
        F.sum("n_reads").cast("long").alias("n_reads"),
    )


def fill_missing(groups: DataFrame, dimension: DataFrame, key: str, prediction_columns: list[str], strategy: str, weight: float) -> DataFrame:
    """All groups of the dimension: those without rows get 1/K ('uniform_number') or 0 ('zeroes') as predictions, label -1, the given total_weight and 0 elsewhere."""
    if strategy not in ("uniform_number", "zeroes"):
        raise ValueError(f"unknown strategy {strategy!r}")
    value = 1.0 / max(len({c.rsplit("_", 1)[0] for c in prediction_columns}), 1) if strategy == "uniform_number" else 0.0
    joined = dimension.select(key).distinct().join(groups.withColumn("_there", F.lit(True)), key, "left")
    missing = F.col("_there").isNull()
    out = []
    for name, kind in groups.dtypes:
        if name == key:
            out.append(F.col(key))
        elif name in prediction_columns:
            out.append(F.when(missing, F.lit(value)).otherwise(F.col(name)).alias(name))
        elif name == "total_weight":
            out.append(F.when(missing, F.lit(weight)).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.when(missing, F.lit("" if kind == "string" else 0).cast(kind)).otherwise(F.col(name)).alias(name))
    return joined.select(*out, F.when(missing, -1).otherwise(0).alias("label"))


def blend(groups: DataFrame, prior: DataFrame, key: str, columns: list[str], weight: float = 1.0, impute_only: bool = False) -> DataFrame:
    """n / (n + w) of the observed value and w / (n + w) of the prior, by group; or only groups without reads take the prior. prior: key and columns."""
    p = prior.select(key, *[F.col(c).alias(f"_p_{c}") for c in columns])
    rows = groups.join(p, key, "left")
    n = F.col("n_reads").cast("double")
    for c in columns:
        mixed = F.when(n == 0, F.col(f"_p_{c}")).otherwise(F.col(c)) if impute_only else F.when(n == 0, F.col(f"_p_{c}")).otherwise(n / (n + weight) * F.col(c) + weight / (n + weight) * F.col(f"_p_{c}"))
        rows = rows.withColumn(c, mixed)
    return rows.drop(*[f"_p_{c}" for c in columns])


def group_features(groups: DataFrame, sample: list[str], key: str, columns: list[str]) -> DataFrame:
    """(sample columns, feature, value): a row for each group and column of aggregate()'s weighted means; the feature is their name."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(f"{c}_wavg").alias("value")) for c in columns])
    long = groups.select(*sample, key, F.inline(pairs))
    return long.select(*sample, F.concat_ws("/", F.col(key).cast("string"), "_c").alias("feature"), "value")


def pure_profiles(rows: DataFrame, key: str, columns: list[str], weight: str, classes: int) -> DataFrame:
    """(feature, cell_type, value): the features of samples that hold one class each, for solvers; a group that a class has no reads of has 1 / classes."""
    seen = group_features(aggregate(rows, ["original_label", key], columns, weight), ["original_label"], key, columns)
    kinds = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("cell_type"))
    grid = seen.select("feature").distinct().crossJoin(F.broadcast(kinds))  # a row a class
    joined = grid.join(seen.withColumnRenamed("original_label", "cell_type"), ["feature", "cell_type"], "left")
    return joined.select("feature", "cell_type", F.coalesce(nan_as_null(F.col("value")), F.lit(1.0 / classes)).alias("value"))


def chunks_to_reads(rows: DataFrame, key: str, columns: list[str], weight: str) -> DataFrame:
    """Weighted mean of chunk predictions by read; 0 where the weights sum to 0."""
    w = F.col(weight).cast("double")
    return rows.groupBy(key).agg(*[F.coalesce(F.try_divide(F.sum(w * F.col(c)), F.sum(w)), F.lit(0.0)).alias(c) for c in columns])


def final_prediction(columns: list[str]) -> tuple[Column, Column]:
    """(index of the first largest, the largest)."""
    most = F.greatest(*columns)
    index = F.lit(None).cast("int")
    for k in reversed(range(len(columns))):
        index = F.when(F.col(columns[k]) == most, k).otherwise(index)
    return index, most


def annotated_predictions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows as read-level output: is_cell_informative_region (own label is the region's), prediction and confidence (first largest), total_marked_cpgs, direction U, and the trimmed coordinates where there are some.

    What needs a column that rows lack is left out; a chr column is called chromosome unless there is one.
    """
    have, out = set(rows.columns), rows
    if {"original_label", "target_label"} <= have:
        out = out.withColumn("is_cell_informative_region", F.col("original_label") == F.col("target_label"))
    if known := [c for c in columns if c in have]:
        index, most = final_prediction(known) if len(known) > 1 else (F.lit(0), F.col(known[0]))
        out = out.withColumns({"prediction": index, "confidence": most})
    if {"M", "U"} <= have:
        out = out.withColumn("total_marked_cpgs", F.col("M") + F.col("U"))
    for end in ("start", "end"):
        if f"trimmed_{end}" in have:
            out = out.withColumn(f"read_{end}", F.col(f"trimmed_{end}"))
    out = out.withColumn("direction", F.lit("U"))
    return out.withColumnRenamed("chr", "chromosome") if "chr" in have and "chromosome" not in have else out


def prediction_columns(names: list[str]) -> list[str]:
    """prediction_<digits> in numeric order, then methylation_level."""
    found = sorted((c for c in names if c.startswith("prediction_") and c.removeprefix("prediction_").isdigit()), key=lambda c: int(c.removeprefix("prediction_")))
    return found + (["methylation_level"] if "methylation_level" in names else [])


def known_predictions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or NaN prediction."""
    return rows.dropna(subset=columns)


def unpadded(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows whose label is not the mark of padding, -100; a null label is none."""
    return rows.filter(F.col(label) != -100)


def require_predictions(groups: DataFrame, classes: int) -> list[str]:
    """The weighted means of all classes, or KeyError naming the first that a table lacks."""
    names = [f"prediction_{k}_wavg" for k in range(classes)]
    for n in names:
        if n not in groups.columns:
            raise KeyError(n)
    return names


def target_columns(groups: DataFrame) -> DataFrame:
    """The columns that a mixture's groups are stored with, those that are there: region label and name, weighted means, total_weight, n_reads."""
    means = [f"{c}_wavg" for c in prediction_columns([n.removesuffix("_wavg") for n in groups.columns if n.endswith("_wavg")])]
    wanted = ["target_label", "target", *means, "total_weight", "n_reads"]
    return groups.select(*[c for c in wanted if c in groups.columns])


def uniform_prior(profiles: DataFrame) -> DataFrame:
    """(feature, value): the mean of pure profiles over the classes."""
    return profiles.groupBy("feature").agg(F.avg("value").alias("value"))


def replayed(drawn: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads of stored mixtures, one row a read and mixture with times. drawn: pb_index, row_id, times, as simulation.draw returns; reads: row_id and whatever is known of them."""
    return drawn.select("pb_index", "row_id", "times").join(reads, "row_id")


def table_statistics(rows: DataFrame, split: str = "split") -> DataFrame:
    """(split, n_reads, n_rows, n_unique_labels, n_unique_grg, watermark): the watermark is the same for the same rows in any order."""
    count = F.col("read_count") if "read_count" in rows.columns else F.lit(1)
    number = lambda c: F.countDistinct(c) if c in rows.columns else F.lit(0).cast("long")
    mark = F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(20,0)")).cast("string")
    return rows.groupBy(split).agg(F.sum(count).cast("long").alias("n_reads"), F.count("*").alias("n_rows"), number("original_label").alias("n_unique_labels"), number("target_label").alias("n_unique_grg"), mark.alias("watermark"))


def duplication_factor(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, n_in, n_out, duplication_factor): rows that came out for each that went in; 0 if none went in."""
    both = before.groupBy(key).agg(F.count("*").alias("n_in")).join(after.groupBy(key).agg(F.count("*").alias("n_out")), key, "full").na.fill(0, ["n_in", "n_out"])
    return both.withColumn("duplication_factor", F.coalesce(F.try_divide("n_out", "n_in"), F.lit(0.0)))


def prior_matrix(prior: DataFrame, columns: list[str], groups: int) -> DataFrame:
    """The configured columns of a prior, by name; missing ones, or a row number other than that of the groups, raise."""
    if missing := [c for c in columns if c not in prior.columns]:
        raise ValueError(f"the prior lacks {', '.join(missing)}")
    if (n := prior.count()) != groups:
        raise ValueError(f"the prior has {n} rows for {groups} groups")
    return prior.select(*columns)
