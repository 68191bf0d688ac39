"""Aggregations over streams of prediction files: the same plans as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import predictions


def read_files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def aggregate_stream(stream: DataFrame, keys: list[str], columns: list[str], weight: str, sink: str, checkpoint: str):
    """Weighted predictions by group, rewritten as a whole after each batch (complete mode): latest() reads the last that is whole. Returns the query."""
    grouped = predictions.aggregate(stream, keys, columns, weight)

    def publish(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/version={k}")
        for old in _numbered(batch.sparkSession, sink, "version"):
            if old < k - 1:  # a reader may still be at the one before
                _remove(batch.sparkSession, f"{sink}/version={old}")

    return grouped.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()


def _numbered(spark: SparkSession, sink: str, name: str) -> list[int]:
    """Numbers of the whole folders <name>=<number> of a sink, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(sink)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    whole = [n for n in found if n.startswith(f"{name}=") and fs.exists(hadoop.Path(f"{sink}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix(f"{name}=")) for n in whole)


def _remove(spark: SparkSession, path: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def latest(spark: SparkSession, sink: str) -> DataFrame:
    """What aggregate_stream() wrote after the last batch that it finished."""
    versions = _numbered(spark, sink, "version")
    if not versions:
        raise FileNotFoundError(sink)
    return spark.read.parquet(f"{sink}/version={versions[-1]}")


def state_stream(stream: DataFrame, each: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):
    """The states that ``each`` makes of a batch, under the number of the batch: one that is repeated takes its own place. Returns the query."""

    def publish(batch: DataFrame, k: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{sink}/batch={k}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()


def read_states(spark: SparkSession, sink: str) -> DataFrame:
    """The states of all finished batches."""
    batches = _numbered(spark, sink, "batch")
    if not batches:
        raise FileNotFoundError(sink)
    return spark.read.parquet(*[f"{sink}/batch={k}" for k in batches])


def append_stream(stream: DataFrame, schema: StructType, sink: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] | None = None):
    """Append-only Parquet of a fixed schema: missing columns are null, further ones are dropped. A batch that is repeated takes its own place. read_states() reads it. Returns the query."""

    def fixed(batch: DataFrame) -> DataFrame:
        out = each(batch) if each else batch
        return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    return state_stream(stream, fixed, sink, checkpoint)


def windowed_values(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: sums and counts of events by tumbling window and type, with a watermark for late rows. events: ts, event_type, value."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
