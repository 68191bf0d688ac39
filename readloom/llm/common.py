"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word: a run of characters other than the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def thinned(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """About ``most`` rows, a tenth more rather than less: those whose hash of the keys falls into a share that the number of rows sets.

    Taken before an order and a limit, so that each task passes on its part of the sample only, not a whole sample.
    """
    n = rows.count()
    share = 1.1 * most / n + 8 * most**0.5 / n if n else 1.0
    return rows if share >= 1 else rows.filter(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30)))


def schema_with(fields: list[StructField], new: str) -> StructType:
    """Given fields and new ones, the latter as DDL."""
    return StructType([*fields, *StructType.fromDDL(new).fields])


def n_words(text) -> "F.Column":
    """Number of words of a text column (null: 0), without building the words.

    Each word becomes one ``x`` and the white space goes; what is left has one character a word.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marked, SPACE, "")).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a new one only on a local master that names none (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        at = "file://" + tempfile.mkdtemp(prefix="readloom-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_FOLDERS: list[list[str]] = []


@contextmanager
def noted_folders() -> Iterator[list[str]]:
    """Paths of the tables that settle_wide() writes inside; whoever asks removes them when nothing reads them any more."""
    _FOLDERS.append([])
    try:
        yield _FOLDERS[-1]
    finally:
        _FOLDERS.pop()


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle_wide(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that carries texts: a compressed Parquet table in the shared folder."""
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/readloom-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if _FOLDERS:
        _FOLDERS[-1].append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def parts(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of one text column each; a longer row is a slice of its own."""
    col = batch.column(column)
    if len(col) == 0:
        return
    ends = np.cumsum(text_lengths(col))
    at = 0
    while at < len(col):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_lengths(col: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, nulls as 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets with one more entry than rows) of a text column, nulls as empty texts."""
    import pyarrow.compute as pc

    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of integer values over the segments that offsets delimit; empty segments are 0."""
    running = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return running[offsets[1:]] - running[offsets[:-1]]
