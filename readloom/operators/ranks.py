"""Running sums and exact quantiles in two levels: inside ranges of the value, then over the ranges.

No key is one task: equal values are combined first, a range holds a part of a key's distinct values, and the ranges of a key are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(cells: DataFrame, keys: list[str], value: str, sums: list[str], ranges: int = 1024) -> DataFrame:
    """cells with upto_<s> and all_<s> for each of sums: the sum over the key's cells whose value is not larger, and over all of them.

    cells: one row a (keys, value), none of them null. Ranges are of equal width between a key's smallest and largest value.
    """
    ends = cells.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), *[F.sum(s).alias(f"all_{s}") for s in sums])
    place = F.floor(F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * ranges)
    placed = cells.join(ends, keys).withColumn("_at", F.least(place, F.lit(ranges - 1))).drop("_lo", "_hi")
    parts = placed.groupBy(*keys, "_at").agg(*[F.sum(s).alias(f"_s_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_at", *[F.coalesce(F.sum(f"_s_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums])
    inside = Window.partitionBy(*keys, "_at").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = placed.select("*", *[F.sum(s).over(inside).alias(f"_i_{s}") for s in sums]).join(offsets, [*keys, "_at"])
    return both.select(*cells.columns, *[(F.col(f"_i_{s}") + F.col(f"_b_{s}")).alias(f"upto_{s}") for s in sums], *[f"all_{s}" for s in sums])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q): an array of the exact quantiles, between two values in a straight line. Null keys and values take no part."""
    cells = rows.dropna(subset=[*keys, value]).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("n"))
    ranked = running(cells, keys, "_v", ["n"])
    at = [F.lit(float(p)) * (F.col("all_n") - 1) for p in shares]
    pick = lambda k: F.min(F.when(F.col("upto_n") > k, F.col("_v")))
    found = ranked.groupBy(*keys).agg(*[c for k, a in enumerate(at) for c in (pick(F.floor(a)).alias(f"_l{k}"), pick(F.ceil(a)).alias(f"_h{k}"), F.max(a - F.floor(a)).alias(f"_f{k}"))])
    return found.select(*keys, F.array(*[F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * F.col(f"_f{k}") for k in range(len(shares))]).alias("q"))
