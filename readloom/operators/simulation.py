"""Simulated mixtures: group quotas and weighted draws of reads, by hashes so that any partitioning gives the same draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import predictions


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from a hash of the key, the same in every run and engine that has md5."""
    digits = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 32)


def target_proportions(spark, mixtures: int, classes: int, seed: int) -> DataFrame:
    """(pb_index, original_label, target): between 1 and all classes, uniform weights over their sum."""
    grid = spark.range(mixtures).select(F.col("id").alias("pb_index"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("original_label"))
    s = F.lit(seed)
    k = 1 + F.floor(uniform(s, F.lit("k"), "pb_index") * classes)
    place = F.row_number().over(Window.partitionBy("pb_index").orderBy(uniform(s, F.lit("o"), "pb_index", "original_label"), "original_label"))
    chosen = grid.withColumn("_p", place).withColumn("_k", k).filter("_p <= _k").withColumn("_w", uniform(s, F.lit("w"), "pb_index", "original_label") + 1e-9)
    return chosen.select("pb_index", "original_label", (F.col("_w") / F.sum("_w").over(Window.partitionBy("pb_index"))).alias("target"))


def quotas(targets: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    """(pb_index, original_label, grg, quota): int(n p) reads of a class in equal shares over its non-empty groups; the remainder is lost.

    groups: original_label, grg, n_reads. A class without reads raises when it is drawn: see ``require_reads``.
    """
    filled = groups.filter("n_reads > 0").withColumn("_g", F.count("*").over(Window.partitionBy("original_label")))
    per_class = targets.withColumn("_n", F.floor(F.col("target") * n))
    return per_class.join(filled, "original_label").select("pb_index", "original_label", "grg", F.floor(F.col("_n") / F.col("_g")).cast("long").alias("quota"))


def drawn_quotas(targets: DataFrame, groups: DataFrame, n: int, seed: int) -> DataFrame:
    """(pb_index, original_label, grg, quota): each of int(n p) reads of a class draws one of all groups, all as likely.

    What falls on groups where the class has no reads is spread in equal shares over those where it has; only the remainder
    of that is lost. groups: original_label, grg, n_reads.
    """
    every = groups.select("grg").distinct().select("grg", (F.row_number().over(Window.orderBy("grg")) - 1).cast("long").alias("_at"))  # as many rows as groups
    filled = groups.filter("n_reads > 0").select("original_label", "grg").distinct()
    reads = (
        targets.withColumn("_n", F.floor(F.col("target") * n).cast("long")).filter("_n > 0").crossJoin(F.broadcast(every.agg(F.count("*").alias("_all"))))
        .withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .withColumn("_at", F.floor(uniform(F.lit(seed), F.lit("g"), "pb_index", "original_label", "k") * F.col("_all")).cast("long"))
    )
    counts = reads.groupBy("pb_index", "original_label", "_at").agg(F.count("*").alias("_q")).join(every, "_at").drop("_at")
    own = counts.join(filled, ["original_label", "grg"], "left_semi").select("pb_index", "original_label", "grg", "_q")
    lost = counts.join(filled, ["original_label", "grg"], "left_anti").groupBy("pb_index", "original_label").agg(F.sum("_q").alias("_lost"))
    sizes = filled.groupBy("original_label").agg(F.count("*").alias("_g"))
    cells = targets.select("pb_index", "original_label").join(filled, "original_label").join(sizes, "original_label").join(own, ["pb_index", "original_label", "grg"], "left").join(lost, ["pb_index", "original_label"], "left")
    quota = F.coalesce("_q", F.lit(0)) + F.floor(F.coalesce("_lost", F.lit(0)) / F.col("_g"))
    return cells.select("pb_index", "original_label", "grg", quota.cast("long").alias("quota"))


def require_reads(targets: DataFrame, groups: DataFrame) -> DataFrame:
    missing = targets.join(groups.filter("n_reads > 0").select("original_label").distinct(), "original_label", "left_anti").select("original_label").distinct().take(5)
    if missing:
        raise ValueError(f"classes with a quota but without reads: {[r.original_label for r in missing]}")
    return targets


STRIPE = 256


def stripes(reads: DataFrame) -> DataFrame:
    """(original_label, grg, stripe, lo, hi, row_id): where each read lies in the running count of its group, a row for each stripe of it that it touches.

    reads: row_id, original_label, grg, read_count. The running count goes inside 256 hash ranges of a group, then over the ranges, so a
    large group is many tasks. Settle it where it serves several draws.
    """
    keys = ["original_label", "grg", "_range"]
    ranged = reads.select("row_id", "original_label", "grg", "read_count").withColumn("_range", F.substring(F.md5(F.col("row_id").cast("string")), 1, 2))
    before = Window.partitionBy("original_label", "grg").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys).agg(F.sum("read_count").alias("_n"))
    starts = starts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    w = Window.partitionBy(*keys).orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_upto", F.sum("read_count").over(w)).join(starts, keys).withColumn("hi", F.col("_start") + F.col("_upto")).withColumn("lo", F.col("hi") - F.col("read_count"))
    at = F.explode(F.sequence(F.floor(F.col("lo") / STRIPE), F.floor((F.col("hi") - 1) / STRIPE)))
    return placed.filter("read_count > 0").withColumn("stripe", at).select("original_label", "grg", "stripe", "lo", "hi", "row_id")


def draw(reads: DataFrame, wanted: DataFrame, seed: int, striped: DataFrame | None = None) -> DataFrame:
    """(pb_index, original_label, grg, row_id, times): draws with replacement, weighted by read_count.

    A draw is a number below its group's total count; it takes the read whose running count covers it. Draw and read meet by (class,
    group, stripe of the running count), so a large group is many stripes. striped: stripes() of the reads, if they are there already.
    """
    striped = stripes(reads) if striped is None else striped
    totals = reads.groupBy("original_label", "grg").agg(F.sum("read_count").alias("total"))
    draws = (
        wanted.filter("quota > 0").join(totals, ["original_label", "grg"])
        .withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))))
        .withColumn("u", F.floor(uniform(F.lit(seed), "pb_index", "original_label", "grg", "k") * F.col("total")))
        .withColumn("stripe", F.floor(F.col("u") / STRIPE))
    )
    hit = draws.join(striped, ["original_label", "grg", "stripe"]).filter("lo <= u and u < hi")
    return hit.groupBy("pb_index", "original_label", "grg", "row_id").agg(F.count("*").alias("times"))


def stored(spark, path: str) -> DataFrame:
    """The drawn mixtures of a folder, whether it has a log of ranges or is one table."""
    from ..sources import commits

    return commits.read(spark, path)


def count_draws(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """(row_id, times): n draws with replacement of rows (row_id, read_count), as likely as the reads they stand for."""
    one = rows.select("row_id", F.lit(0).alias("original_label"), F.lit(0).alias("grg"), "read_count")
    wanted = rows.sparkSession.createDataFrame([(0, 0, 0, n)], "pb_index long, original_label int, grg int, quota long")
    return draw(one, wanted, seed).select("row_id", "times")


def balanced_batches(rows: DataFrame, batch_size: int, background: float = 0.3, samples: int | None = None, seed: int = 42) -> DataFrame:
    """(batch, row_id, times): full batches of int(batch_size * background) background reads and else reads on target, drawn with replacement by their counts.

    rows: row_id, on_target, read_count. There are as many batches as the reads on target fill, or as ``samples`` draws need. No row on target, or none of the
    background where batches hold some, raises.
    """
    off = int(batch_size * background)
    sizes = {r.on_target: r.n for r in rows.groupBy("on_target").agg(F.sum("read_count").alias("n")).collect()}  # two rows
    if batch_size - off < 1 or not sizes.get(True):
        raise ValueError("balanced batches need reads on target in every batch")
    if off and not sizes.get(False):
        raise ValueError("balanced batches need background reads")
    n = -(-samples // batch_size) if samples else -(-sizes[True] // (batch_size - off))
    grouped = rows.select("row_id", F.col("on_target").cast("int").alias("original_label"), F.lit(0).alias("grg"), "read_count")
    kinds = F.explode(F.array(F.struct(F.lit(1).alias("original_label"), F.lit(batch_size - off).cast("long").alias("quota")), F.struct(F.lit(0).alias("original_label"), F.lit(off).cast("long").alias("quota"))))
    wanted = rows.sparkSession.range(n).select(F.col("id").alias("pb_index"), kinds.alias("_k")).select("pb_index", "_k.original_label", F.lit(0).alias("grg"), "_k.quota")
    return draw(grouped, wanted, seed).select(F.col("pb_index").alias("batch"), "row_id", "times")


def actual_proportions(drawn: DataFrame) -> DataFrame:
    n = drawn.groupBy("pb_index", "original_label").agg(F.sum("times").alias("n"))
    return n.select("pb_index", "original_label", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("pb_index"))).alias("actual"))


def pseudobulk(reads: DataFrame, targets: DataFrame, columns: list[str], weight: str, n: int, seed: int) -> DataFrame:
    """(pb_index, grg, <c>_wavg of columns, total_weight, n_reads): n reads of each mixture drawn and averaged by group.

    reads: row_id, original_label, grg, read_count, columns and the weight; targets: pb_index, original_label, target. A read drawn
    several times counts as often, in the means as in n_reads. Groups without a drawn read have no row: see predictions.fill_missing.
    """
    groups = reads.groupBy("original_label", "grg").agg(F.sum("read_count").alias("n_reads"))
    drawn = draw(reads, drawn_quotas(require_reads(targets, groups), groups, n, seed), seed)
    weighed = predictions.replayed(drawn, reads.select("row_id", "grg", weight, *columns)).withColumn("_w", F.col(weight) * F.col("times"))
    return weighed.groupBy("pb_index", "grg").agg(*[predictions.weighted(c, F.greatest(F.col("_w").cast("double"), F.lit(predictions.LEAST_WEIGHT))).alias(f"{c}_wavg") for c in columns], F.sum("_w").alias("total_weight"), F.sum("times").alias("n_reads"))


def group_index(rows: DataFrame, key: str, mapping: dict[str, int] | None = None) -> DataFrame:
    """rows with grg: the group's number by the mapping, else the key as a number; keys that are neither raise when they are read."""
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), F.col(key).cast("string")) if mapping else F.lit(None).cast("int")
    return rows.withColumn("grg", F.coalesce(named, F.col(key).cast("string").cast("int")))
