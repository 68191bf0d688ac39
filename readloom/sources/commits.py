"""Tables that are written in ranges, with a log: a run that was stopped goes on where it ended, and readers see finished ranges only.

Layout: ``parameters-<hash>.json`` says what the table is made of; ``range-<first>-<end>/`` are its parts. A part is written beside
its place and renamed, which is its entry in the log: it is there as a whole or not at all.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

Range = tuple[int, int]
_PART = re.compile(r"range-(\d+)-(\d+)")


def parameter_hash(parameters: dict) -> str:
    """16 digits that are the same for equal parameters, whatever their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]


def ranges(n: int, size: int) -> list[Range]:
    """Half-open ranges of ``size`` numbers at most that cover 0 .. n - 1."""
    if size < 1:
        raise ValueError("a range holds one number at least")
    return [(k, min(k + size, n)) for k in range(0, n, size)]


def _entries(spark: SparkSession, path: str) -> tuple:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, root, [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []


class CommitLog:
    """The log of one table. Opening it with other parameters than those it was begun with raises."""

    def __init__(self, spark: SparkSession, path: str, parameters: dict):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs, root, names = _entries(spark, path)
        mine = f"parameters-{parameter_hash(parameters)}.json"
        others = [n for n in names if n.startswith("parameters-") and n != mine]
        if others or (names and mine not in names):
            raise ValueError(f"{path} was begun with other parameters: {', '.join(others) or 'none are stored'}")
        if mine not in names:
            out = self._fs.create(spark._jvm.org.apache.hadoop.fs.Path(root, mine))
            out.write(bytearray(json.dumps(parameters, sort_keys=True).encode()))
            out.close()

    def done(self) -> set[Range]:
        found = (_PART.fullmatch(n) for n in _entries(self.spark, self.path)[2])
        return {(int(m[1]), int(m[2])) for m in found if m}

    def left(self, wanted: list[Range]) -> list[Range]:
        """The ranges that are not finished; parts that a stopped run left unfinished are removed."""
        _, root, names = _entries(self.spark, self.path)
        for n in names:
            if n.startswith("unfinished-"):
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(root, n), True)
        finished = self.done()
        return [r for r in wanted if r not in finished]

    def commit(self, part: Range, rows: DataFrame) -> None:
        """Write a range; if another run finished it meanwhile, that one stays."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        side, target = f"{self.path}/unfinished-{uuid.uuid4().hex}", path(f"{self.path}/range-{part[0]}-{part[1]}")
        rows.write.option("compression", "zstd").parquet(side)
        if self._fs.exists(target):
            self._fs.delete(path(side), True)
        elif not self._fs.rename(path(side), target):
            raise OSError(f"{side} could not be renamed to {target}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All finished ranges of a table with a log, or the Parquet table at path."""
    names = _entries(spark, path)[2]
    parts = sorted(n for n in names if _PART.fullmatch(n))
    if not any(n.startswith("parameters-") for n in names):
        return spark.read.parquet(path)
    if not parts:
        raise FileNotFoundError(f"no finished range at {path}")
    return spark.read.parquet(*[f"{path.rstrip('/')}/{n}" for n in parts])
