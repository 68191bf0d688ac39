"""Atlases from reads, baseline inputs and region statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_region
from . import ranks


def uxm_fractions(prepared: DataFrame, min_cpgs: int = 4) -> DataFrame:
    """(name, direction, original_label, matching, total, fraction): reads whose state is the region's direction, by region and cell type."""
    enough = prepared.filter(F.col("NCPGS") >= min_cpgs)
    return (
        enough.groupBy("name", "direction", "original_label")
        .agg(F.count_if(F.col("state") == F.col("direction")).alias("matching"), F.count("*").alias("total"))
        .withColumn("fraction", F.round(F.col("matching") / F.col("total"), 3))
    )


def uxm_atlas(prepared: DataFrame, classes: int, min_cpgs: int = 4) -> DataFrame:
    """One row a region, a column of fractions for each cell type; null where it has no reads."""
    wide = uxm_fractions(prepared, min_cpgs).groupBy("name", "direction").pivot("original_label", list(range(classes))).agg(F.first("fraction"))
    return wide.select("name", "direction", *[F.col(str(k)).alias(f"ct_{k}") for k in range(classes)])


def positions(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, state): a row for each known position."""
    each = rows.select(*keep, "read_start", F.posexplode(F.split("methylation_ids", "")).alias("_i", "_s")).filter("_s in ('0', '1')")
    return each.select(*keep, (F.col("read_start") + F.col("_i")).cast("long").alias("pos"), F.col("_s").cast("int").alias("state"))


def cpg_counts(prepared: DataFrame) -> DataFrame:
    """(chromosome, name, start, end, original_label, meth, cov), one row a position and cell type; end is start + 1."""
    long = positions(prepared, "chromosome", "name", "original_label").groupBy("chromosome", "name", "pos", "original_label").agg(F.sum("state").cast("long").alias("meth"), F.count("*").alias("cov"))
    return long.select("chromosome", "name", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "original_label", "meth", "cov")


def cpg_atlas(prepared: DataFrame, classes: int) -> DataFrame:
    """Wide form: <k>_meth and <k>_cov by cell type, 0 where nothing was read; one aggregate, so a position is shuffled as one row and not again to be laid out."""
    own = lambda k, v, c: F.sum(F.when(F.col("original_label") == k, v).otherwise(0)).cast("long").alias(f"{k}_{c}")
    each = [own(k, v, c) for k in range(classes) for v, c in ((F.col("state"), "meth"), (F.lit(1), "cov"))]
    wide = positions(prepared, "chromosome", "name", "original_label").groupBy("chromosome", "name", "pos").agg(*each)
    return wide.withColumns({"start": F.col("pos"), "end": F.col("pos") + 1}).select("chromosome", "name", "start", "end", *wide.columns[3:])


def atlas_regions(cpgs: DataFrame) -> DataFrame:
    """Regions of a count atlas: from the first start + 1 to the last end, with the number of positions."""
    return cpgs.groupBy("name").agg(F.min("chromosome").alias("chr"), (F.min("start") + 1).alias("start"), F.max("end").alias("end"), F.countDistinct("start").alias("n_cpgs"))


def sample_states(prepared: DataFrame, min_cpgs: int = 4) -> DataFrame:
    """Per region the numbers of M, U and X reads, all, and the share of U."""
    one = lambda s: F.count_if(F.col("state") == s)
    return prepared.filter(F.col("NCPGS") >= min_cpgs).groupBy("name").agg(one("M").alias("M"), one("U").alias("U"), one("X").alias("X"), F.count("*").alias("count"), (one("U") / F.count("*")).alias("sf"))


def sample_betas(sample: DataFrame, atlas: DataFrame) -> DataFrame:
    """(name, pos, meth, cov, beta) of a sample at the atlas positions; 0 counts and null beta where it has none. atlas: name, pos."""
    seen = positions(sample, "name").groupBy("name", "pos").agg(F.sum("state").cast("long").alias("meth"), F.count("*").alias("cov"))
    both = atlas.select("name", "pos").distinct().join(seen, ["name", "pos"], "left").na.fill(0, ["meth", "cov"])
    return both.withColumn("beta", F.try_divide(F.col("meth").cast("double"), F.col("cov").cast("double")))


def impute_by_target(rows: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Nulls become the median of the target, else the overall median. Medians are found by ranks, so no target is one task."""
    joined = rows.withColumn("_one", F.lit(1))
    for c in columns:
        own = ranks.quantiles(rows, [target], c, [0.5]).select(target, F.col("q")[0].alias(f"_m_{c}"))
        overall = ranks.quantiles(rows.withColumn("_one", F.lit(1)), ["_one"], c, [0.5]).select("_one", F.col("q")[0].alias(f"_g_{c}"))
        joined = joined.join(own, target, "left").join(overall, "_one", "left").withColumn(c, F.coalesce(c, f"_m_{c}", f"_g_{c}"))
    return joined.select(*rows.columns)


def region_sums(positions: DataFrame) -> DataFrame:
    """(keys, name, meth, cov): counts of positions summed by region, with whatever stands before name as keys. positions: of sample_betas or cpg_counts."""
    keys = [c for c in positions.columns if c in ("sample", "chromosome", "name", "original_label")]
    return positions.groupBy(*keys).agg(F.sum("meth").alias("meth"), F.sum("cov").alias("cov"))


def marker_samples(states: DataFrame, markers: DataFrame) -> DataFrame:
    """(sample, feature, value, weight) for the solvers: the share of reads in the marker's direction, weighted by the square of their number.

    states: sample, name, M, U, count; markers: name, direction. Markers that a sample has no reads of are not among its rows.
    """
    share = F.when(F.col("direction") == "U", F.col("U")).otherwise(F.col("M")) / F.col("count")
    known = states.join(by_region(markers.select("name", "direction").distinct()), "name").filter("count > 0")
    return known.select("sample", F.concat_ws("/", "name", "direction").alias("feature"), share.alias("value"), (F.col("count") * F.col("count")).cast("double").alias("weight"))


def marker_reference(fractions: DataFrame) -> DataFrame:
    """(feature, cell_type, value) of uxm_fractions; of a repeated marker and cell type the first by value. Features that a cell type lacks are left to the solver, which drops them."""
    named = fractions.select(F.concat_ws("/", "name", "direction").alias("feature"), F.col("original_label").alias("cell_type"), F.col("fraction").alias("value"))
    return named.groupBy("feature", "cell_type").agg(F.min("value").alias("value"))


def annotation_codes(rows: DataFrame, column: str) -> DataFrame:
    """rows with code: the place (from 0) of an annotation among its distinct values in order, -1 where it is null. Ranks are taken over the distinct values only."""
    codes = rows.select(column).dropna().distinct().withColumn("code", F.dense_rank().over(Window.orderBy(column)) - 1)
    return rows.join(codes, column, "left").na.fill(-1, ["code"])


def cluster_ranks(means: DataFrame) -> DataFrame:
    """Rank of a cluster in its target by descending mean, ties by number. means: target, cluster, mean."""
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("mean"), "cluster")) - 1)


def feature_ratios(long: DataFrame) -> DataFrame:
    """Largest over mean value by feature, a mean of 0 as 1e-12. long: grg, pred, cell_type, value."""
    mean = F.avg("value")
    return long.groupBy("grg", "pred").agg((F.max("value") / F.when(mean == 0, 1e-12).otherwise(mean)).alias("ratio"))


def feature_mask(ratios: DataFrame, cutoff: float = 1.1, diagonal: bool = True, columns: tuple[int, ...] = ()) -> DataFrame:
    """Features with a ratio above the cutoff, on the diagonal, or in listed columns."""
    keep = F.col("ratio") > cutoff
    if diagonal:
        keep = keep | (F.col("grg") == F.col("pred"))
    if columns:
        keep = keep | F.col("pred").isin(*columns)
    return ratios.filter(keep)


def mask_disagreement(masks: DataFrame) -> DataFrame:
    """(grg, pred, splits, kept, disagrees): in how many splits each feature is, and whether only in some of them. masks: split, grg, pred (kept features), a row each."""
    splits = masks.select("split").distinct().agg(F.count("*").alias("splits"))
    each = masks.select("split", "grg", "pred").distinct().groupBy("grg", "pred").agg(F.count("*").alias("kept"))
    return each.join(F.broadcast(splits), F.lit(True)).select("grg", "pred", "splits", "kept", (F.col("kept") < F.col("splits")).alias("disagrees"))


def top_features(ratios: DataFrame, n: int) -> DataFrame:
    """The n best features, those on the diagonal first."""
    order = Window.orderBy(F.desc((F.col("grg") == F.col("pred")).cast("int")), F.desc("ratio"), "grg", "pred")
    return ratios.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
