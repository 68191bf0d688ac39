"""Joins and merges of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of the bins: reads up to a width, and longer than the one before, lie on its bins.
WIDTHS = tuple(64 * 8**k for k in range(9))
#: Rows of regions on bins that Spark may broadcast; more are shuffled, with the reads, by their bins.
FEW = 500_000


def overlap(reads: DataFrame, regions: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """A row for each read and region with read_start < end and read_end >= start - 1 on one chromosome.

    reads: chromosome, read_start, read_end, others; regions: chr, start, end, name, others. A read of any length is one
    row: it lies on the bin of its start, of the least width that is not smaller than itself. A region is laid on the bins of every width
    where such reads may begin that reach it, so a read meets regions within a few of its own lengths, and each pair once. Reads
    and regions without a partner go.

    Up to FEW rows of regions on bins, Spark may broadcast them, and then reads are not shuffled at all. More meet the reads by
    (chromosome, width, bin), and a bin with very many reads is split by adaptive execution: the rows are counted for that, since
    Spark's estimate is that of the files, which knows nothing of the bins and would send millions of rows through the driver.
    """
    length = F.col("read_end") - F.col("read_start") + 1
    level = sum((F.when(length > w, 1).otherwise(0) for w in widths[:-1]), F.lit(0))
    width = F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), F.col("_level") + 1)
    placed = reads.withColumn("_level", level).withColumn("_bin", F.floor(F.col("read_start") / width))
    named = regions.withColumnsRenamed({"start": "region_start", "end": "region_end", "chr": "_chr"})
    # a read of the last width may be longer than it: all bins before the region's end are its own
    first = [F.floor((F.col("region_start") - w) / w) for w in widths[:-1]] + [F.lit(0).cast("long")]

    def spots(k: int) -> Column:
        return F.transform(F.sequence(first[k], F.floor((F.col("region_end") - 1) / widths[k])), lambda x: F.struct(F.lit(k).alias("_l"), x.alias("_b")))

    laid = named.withColumn("_at", F.explode(F.flatten(F.array(*[spots(k) for k in range(len(widths))])))).select("*", "_at._l", "_at._b").drop("_at")
    if not laid.isStreaming and laid.count() > FEW:
        laid = laid.hint("merge")
    both = placed.join(laid, (F.col("chromosome") == F.col("_chr")) & (F.col("_level") == F.col("_l")) & (F.col("_bin") == F.col("_b")))
    meets = (F.col("read_start") < F.col("region_end")) & (F.col("read_end") >= F.col("region_start") - 1)
    return both.filter(meets).drop("_level", "_bin", "_l", "_b", "_chr")


def merge(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: int = 0, width: int = 1 << 16) -> DataFrame:
    """Unions of intervals that overlap or are at most ``gap`` apart, by keys.

    Intervals are merged inside bins of their starts first, then the islands that are left over the bins: how far earlier bins
    reach, and how many islands begin in them, are sums over a table of one row a bin. So a chromosome is as many tasks as it has bins.
    """
    bins = [*keys, "_bin"]
    order = Window.partitionBy(*bins).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.select(*keys, start, end).withColumn("_bin", F.floor(F.col(start) / width)).withColumn("_fresh", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    inside = marked.withColumn("_island", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*bins, "_island").agg(F.min(start).alias(start), F.max(end).alias(end))
    over = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)

    def with_bins(table: DataFrame, value: Column, name: str) -> DataFrame:
        """table with what the window over its bins gives."""
        own = table.groupBy(*bins).agg(value.alias("_v")).withColumn(name, (F.max("_v") if name == "_reach" else F.sum("_v")).over(over)).drop("_v")
        own = own.withColumnsRenamed({c: f"_k_{c}" for c in bins})
        meets = F.lit(True)
        for c in bins:
            meets = meets & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        return table.join(own, meets).drop(*[f"_k_{c}" for c in bins])

    fresh = with_bins(inside, F.max(end), "_reach").withColumn("_fresh", F.when(F.col(start) <= F.col("_reach") + gap, 0).otherwise(1))
    numbered = with_bins(fresh, F.sum("_fresh"), "_base")
    island = F.coalesce("_base", F.lit(0)) + F.sum("_fresh").over(Window.partitionBy(*bins).orderBy(start).rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("_id", island).groupBy(*keys, "_id").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_id")


def covered(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Distinct positions of intervals with both ends, by keys."""
    return merge(rows, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).cast("long").alias("positions"))


def chunks(contigs: DataFrame, size: int) -> DataFrame:
    """(contig, start, end) of side-by-side chunks, half open. contigs: contig, length."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    return contigs.filter("length > 0").select("contig", "length", starts.alias("start")).select("contig", "start", F.least(F.col("start") + size, F.col("length")).alias("end"))


def buckets(regions: DataFrame, n: int) -> DataFrame:
    """regions with region_bucket: near-equal runs of the order (chr, start, end, name)."""
    order = Window.orderBy("chr", "start", "end", "name")
    size = regions.count()  # the region table has one row a region, some thousands
    return regions.withColumn("_at", F.row_number().over(order) - 1).withColumn("region_bucket", F.least(F.expr(f"_at * {n} div {max(size, 1)}"), F.lit(n - 1)).cast("int")).drop("_at")


def loci(regions: DataFrame, per_chunk: int) -> DataFrame:
    """regions with locus (number of the distinct place) and chunk (per_chunk loci each)."""
    place = F.dense_rank().over(Window.orderBy("chr", "start", "end")) - 1
    return regions.withColumn("locus", place).withColumn("chunk", F.expr(f"locus div {per_chunk}").cast("int"))
