"""Reference sequences: FASTA files as fixed chunks of sequence, and what is counted in them.

Lines are read by Spark's text reader, so a chromosome is as many tasks as its file has splits. What a split begins with is told by
the splits before it: a small table (a row a split and header) says where each part of a record begins. Parts are put together
into chunks of ``size`` positions, which are joined, cut and counted like any table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns

SIZE = 1 << 16


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): lines in the order of the file within a split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _parts(batches: Iterator[pd.DataFrame], size: int, mask: bool) -> Iterator[pd.DataFrame]:
    """(file, split, part, header, at, text): runs of sequence of ``size`` at most of a split, with the number of headers before them in it and their place behind the last."""
    key, part, at, header, held, length = None, 0, 0, None, [], 0
    rows: list[tuple] = []

    def cut() -> None:
        nonlocal held, length, at, header
        if held or header is not None:
            text = "".join(held)
            rows.append((*key, part, header, at, text))
            at += len(text)
            held, length, header = [], 0, None

    for batch in batches:
        for file, split, value in zip(batch["file"], batch["split"], batch["value"], strict=True):
            if (file, split) != key:
                if key is not None:
                    cut()
                key, part, at, header = (file, split), 0, 0, None
            line = value.strip()
            if line.startswith(">"):
                cut()
                part, at, header = part + 1, 0, line[1:].strip()
            elif line:
                held.append("N" * len(line) if mask and "N" in line.upper() else line)
                length += len(line)
                if length >= size:
                    cut()
        if rows:
            yield pd.DataFrame(rows, columns=["file", "split", "part", "header", "at", "text"])
            rows.clear()
    if key is not None:
        cut()
    yield pd.DataFrame(rows, columns=["file", "split", "part", "header", "at", "text"])


def chunks(spark: SparkSession, path: str, size: int = SIZE, overlap: int = 0, mask_lines: bool = False) -> DataFrame:
    """(record, description, start, sequence): the sequences of FASTA files in upper case, ``size`` positions a row, from 0 on, each with ``overlap`` (``size`` at most) positions of what follows.

    record is the header up to its first space. Empty lines, empty records and sequence before the first header of a file give nothing; a
    name that is there twice gives chunks that make no sense. mask_lines: lines with an N are all N. Files may be compressed (then each is one task).
    """
    if not 0 <= overlap <= size:
        raise ValueError("the overlap is a part of a chunk")
    schema = "file string, split long, part int, header string, at long, text string"
    parts = _lines(spark, path).mapInPandas(lambda b: _parts(b, size, mask_lines), schema)
    # a row a split and header: how long each part of a record is, and which record it belongs to
    each = parts.groupBy("file", "split", "part").agg(F.max("header").alias("header"), F.sum(F.length("text")).alias("n"))
    order = Window.partitionBy("file").orderBy("split", "part")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    named = each.withColumn("_record", F.count("header").over(upto)).filter("_record > 0").withColumn("header", F.last("header", ignorenulls=True).over(upto))
    before = Window.partitionBy("file", "_record").orderBy("split", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "split", "part", F.col("header").alias("_h"), "_base")
    runs = parts.join(placed, ["file", "split", "part"]).filter("text <> ''").select(
        F.split("_h", r"\s")[0].alias("record"), F.regexp_extract("_h", r"^\S*\s*(.*)$", 1).alias("description"), (F.col("_base") + F.col("at")).alias("start"), F.upper("text").alias("text")
    )
    number = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.length("text") - 1) / size)))
    cut = runs.withColumn("chunk", number).withColumn("_lo", F.greatest(F.col("start"), F.col("chunk") * size))
    end = F.least(F.col("start") + F.length("text"), (F.col("chunk") + 1) * size)
    cut = cut.withColumn("text", F.substring("text", (F.col("_lo") - F.col("start") + 1).cast("int"), (end - F.col("_lo")).cast("int")))
    packed = F.array_sort(F.collect_list(F.struct("_lo", "text")))  # of one chunk
    whole = cut.groupBy("record", "chunk").agg(F.first("description").alias("description"), F.array_join(F.transform(packed, lambda x: x["text"]), "").alias("sequence"))
    if overlap:
        head = whole.select("record", (F.col("chunk") - 1).alias("chunk"), F.substring("sequence", 1, overlap).alias("_next"))
        whole = whole.join(head, ["record", "chunk"], "left").withColumn("sequence", F.concat("sequence", F.coalesce("_next", F.lit(""))))
    return whole.select("record", "description", (F.col("chunk") * size).alias("start"), "sequence")


def cg_counts(chunked: DataFrame, spans: DataFrame, size: int = SIZE) -> DataFrame:
    """spans (contig, start, end, others) with n_cpgs: how many CGs begin in start .. end, both from 0 and included. chunked: of chunks() with an overlap of 1 or more.

    A chunk holds the places of its CGs and their number in the chunks before it, so a span of any length meets two chunks. Contigs
    without a record have null; what lies outside of a record holds none.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cgs = [[m.start() for m in re.finditer("CG", text[: size + 1])] for text in batch["sequence"]]
            yield pd.DataFrame({"record": batch["record"], "_start": batch["start"], "_cgs": cgs})

    places = chunked.select("record", "start", "sequence").mapInPandas(found, "record string, _start long, _cgs array<int>")
    over = Window.partitionBy("record").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    table = places.withColumn("_before", F.coalesce(F.sum(F.size("_cgs")).over(over), F.lit(0))).withColumn("_chunk", (F.col("_start") / size).cast("long"))  # a row a chunk
    lengths = table.groupBy("record").agg(F.max("_chunk").alias("_last"), F.sum(F.size("_cgs")).alias("_all"))

    def below(rows: DataFrame, at: Column, name: str) -> DataFrame:
        """rows with the number of CGs that begin before a place."""
        asked = rows.withColumn("_at", F.greatest(at, F.lit(0))).withColumn("_chunk", F.floor(F.col("_at") / size))
        met = asked.join(table.select(F.col("record").alias("contig"), "_chunk", "_start", "_cgs", "_before"), ["contig", "_chunk"], "left")
        n = F.col("_before") + F.size(F.filter("_cgs", lambda x: x < F.col("_at") - F.col("_start")))
        return met.withColumn(name, F.when(F.col("_chunk") > F.col("_last"), F.col("_all")).otherwise(n)).drop("_at", "_chunk", "_start", "_cgs", "_before")

    known = spans.join(F.broadcast(lengths.withColumnRenamed("record", "contig")), "contig", "left")  # a row a record
    both = below(below(known, F.col("start"), "_a"), F.col("end") + 1, "_b")
    return both.withColumn("n_cpgs", F.when(F.col("_all").isNotNull(), F.greatest(F.col("_b") - F.col("_a"), F.lit(0)))).drop("_a", "_b", "_last", "_all")


def unknown_cpgs(n_cpgs: Column, methylated: Column, unmethylated: Column) -> Column:
    """CGs of a span that reads tell nothing of."""
    return F.greatest(n_cpgs - methylated - unmethylated, F.lit(0))


def sentences(chunked: DataFrame, k: int = 3, length: int = 510, size: int = SIZE, contigs: list[str] | None = None) -> DataFrame:
    """(record, start, sentence): overlapping k-mers of stretches of ``length`` positions side by side, from the beginning of each run without Ns; what is left of a run goes.

    chunked: of chunks() with an overlap of ``length`` or more. contigs: names that are taken, in any case; all by default. Where a run that
    reaches into a chunk began is told by the last N of the chunks before it (a number a chunk).
    """
    rows = chunked if contigs is None else chunked.filter(F.upper("record").isin([c.upper() for c in contigs]))
    own = F.substring("sequence", 1, size)
    last = F.col("start") + F.length(own) - F.locate("N", F.reverse(own))  # of the last N
    ends = rows.select("record", "start", F.when(own.contains("N"), last).alias("_n"))
    before = F.max("_n").over(Window.partitionBy("record").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    begun = ends.select("record", "start", F.coalesce(before + 1, F.lit(0)).alias("_run"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record, start, text, run in zip(batch["record"], batch["start"], batch["sequence"], batch["_run"], strict=True):
                for m in re.finditer("[^N]+", text):
                    began = int(run) if m.start() == 0 else start + m.start()
                    at = began + -(-(max(start, began) - began) // length) * length
                    while at < start + size and at + length <= start + m.end():
                        out.append((record, at, text[at - start : at - start + length]))
                        at += length
            yield pd.DataFrame(out, columns=["record", "start", "_s"])

    stretches = rows.join(begun, ["record", "start"]).select("record", "start", "sequence", "_run").mapInPandas(cut, "record string, start long, _s string")
    return stretches.select("record", "start", patterns.kmers(F.col("_s"), k).alias("sentence"))
