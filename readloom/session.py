"""Session settings and join sides that operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


#: Rows of a table with a row a region that Spark may broadcast.
FEW = 100_000


def by_region(table: DataFrame) -> DataFrame:
    """table, with a row a region or so, as a side of a join: up to FEW rows Spark may broadcast it, more are shuffled with what they meet.

    The rows are counted for that: Spark's estimate is that of the files, which knows nothing of the strings that are made of them, and
    sends a million of regions through the driver.
    """
    return table if table.isStreaming or table.count() <= FEW else table.hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder of ``spark.checkpoint.dir``; a new folder only on a local master that names none (tests)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="readloom-checkpoint-"))
    return df.checkpoint()
