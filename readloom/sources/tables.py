"""Reads and regions as views of the driver's tables, and plain access to these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read a lineitem row: a position by part, a pattern and a sequence by hashes of the row's keys."""
    items = table(spark, sf_dir, "lineitem")
    name = F.concat_ws("|", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")))
    start = F.col("l_partkey") * 16 + F.col("l_linenumber")
    return items.select(
        name.alias("read_name"),
        F.concat(F.lit("chr"), (1 + F.col("l_suppkey") % 5).cast("string")).alias("chromosome"),
        start.alias("read_start"),
        (start + 31).alias("read_end"),
        F.translate(F.md5(F.concat(F.lit("q"), name)), "0123456789abcdef", "ACGTACGTACGTACGT").alias("input_ids"),
        F.translate(F.md5(name), "0123456789abcdef", "0000111122222222").alias("methylation_ids"),
        (F.col("l_suppkey") % 7).cast("int").alias("original_label"),
        F.concat(F.lit("f"), (F.col("l_orderkey") % 9).cast("string")).alias("file"),
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region a part, 1-based with both ends."""
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.concat(F.lit("chr"), (1 + F.col("p_partkey") % 5).cast("string")).alias("chr"),
        (F.col("p_partkey") * 16 + 1).alias("start"),
        (F.col("p_partkey") * 16 + 8 + F.col("p_size")).alias("end"),
        F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("name"),
        (F.col("p_size") % 7).cast("int").alias("target_label"),
        F.when(F.col("p_size") % 2 == 0, "U").otherwise("M").alias("direction"),
    )
