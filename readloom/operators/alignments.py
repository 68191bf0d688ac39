"""Aligned reads to parsed reads: what passes, what its tags or its bases say of each CG, and the common layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from . import intervals

ONT, WGBS = "ont", "wgbs"
CONTIGS = tuple([*(f"chr{k}" for k in range(1, 23)), "chrX", "chrY"])


@dataclass(frozen=True)
class Parsing:
    """How alignments are read. Calls above ``methylated`` are 1, up to ``unmethylated`` 0, between them unknown."""

    data_type: str
    contigs: tuple[str, ...] = CONTIGS
    methylated: int = 122
    unmethylated: int = 122
    combine: bool = False
    min_mapq: int = 10
    require: int = 3
    exclude: int = 1796
    min_cpgs: int = 1
    merge_pairs: bool = True


def parsing(data_type: str, config: dict | None = None, contigs: list[str] | str = "all") -> Parsing:
    """The parameters of a configuration block, with defaults by data type.

    Long reads need no flags and are never merged: records of one name are parts of one read, no mates. Flags that exclude stay. A lower threshold
    above the upper one raises; without it there is no unknown band.
    """
    config = config or {}
    if data_type not in (ONT, WGBS):
        raise ValueError(f"unknown kind of alignments {data_type!r}; known: {ONT}, {WGBS}")
    high = int(config.get("ont_methyl_tr", 122))
    low = config.get("ont_unmethyl_tr")
    low = high if low is None else int(low)
    if low > high:
        raise ValueError(f"ont_unmethyl_tr ({low}) is above ont_methyl_tr ({high})")
    long = data_type == ONT
    return Parsing(
        data_type, CONTIGS if contigs == "all" else tuple(contigs), high, low, bool(config.get("ont_combine_mods", False)), int(config.get("min_mapq", 10)),
        0 if long else int(config.get("require_flags", 3)), int(config.get("exclude_flags", 1796)), int(config.get("min_cpgs", 1)), not long and bool(config.get("merge_pairs", True)),
    )


def detect(alignments: DataFrame, most: int = 1000) -> str:
    """The data type: long reads if more than half of the first ``most`` mapped records have likelihoods of modifications. No mapped record raises."""
    first = alignments.filter("flag & 4 = 0").select(F.col("ml").isNotNull().alias("has")).limit(most)
    share = first.agg(F.avg(F.col("has").cast("double"))).first()[0]
    if share is None:
        raise ValueError("no mapped records")
    return ONT if share > 0.5 else WGBS


def passing(alignments: DataFrame, p: Parsing) -> DataFrame:
    """Records of the contigs (named with or without chr) whose flags and mapping quality pass; chromosome is the name that was asked for."""
    known = F.array(*[F.lit(c) for c in p.contigs])
    named = alignments.withColumn("chromosome", patterns.contig_alias(F.col("chromosome"), known)).filter("chromosome is not null and read_start is not null")
    return named.filter(patterns.passes_flags(F.col("flag"), F.col("mapping_quality"), p.require, p.exclude, p.min_mapq))


def overlapping(alignments: DataFrame, regions: DataFrame) -> DataFrame:
    """Records that meet a region (chr, start, end; from 1, both ends), each (name, start, flag) once."""
    places = regions.select("chr", "start", "end", F.lit("").alias("name")).distinct()
    inclusive = alignments.withColumn("_end", F.col("read_end")).withColumn("read_end", F.col("read_end") - 1)
    met = intervals.overlap(inclusive, places).withColumn("read_end", F.col("_end"))
    return met.select(*alignments.columns).dropDuplicates(["file", "read_name", "read_start", "flag"])


def _stated(rows: DataFrame, p: Parsing) -> DataFrame:
    """rows (seq, _at: places of CGs in it, _states) in the common layout, those with min_cpgs CGs."""
    positions = F.transform("_at", lambda x: F.col("read_start") + x)
    count = lambda s: F.size(F.filter("_states", lambda x: x == s))
    m, u = count(1), count(0)
    return rows.filter(F.size("_at") >= p.min_cpgs).select(
        "file", "read_name", "flag", "chromosome", "read_start", "read_end", (F.col("read_end") - F.col("read_start")).alias("read_length"), "seq",
        encoded(F.col("seq"), F.col("_states")).alias("methylation_encoding"), positions.alias("cpg_positions"), F.col("_states").alias("meth_states"),
        F.size("_at").alias("total_cpgs"), m.alias("methylated_cpgs"), u.alias("unmethylated_cpgs"), F.coalesce(F.try_divide(m.cast("double"), (m + u).cast("double")), F.lit(0.0)).alias("methylation_rate"),
        "mapping_quality", (F.col("flag").bitwiseAND(16) != 0).alias("is_reverse"), F.lit(p.data_type).alias("data_type"),
    )


def cg_sites(sequence: Column) -> Column:
    """Places (from 0) of the CGs of a sequence, by the lengths of what stands between them."""
    pieces = F.split(sequence, "CG")
    start = F.struct(F.lit(-2).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.length(piece) + 2
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), start, step, lambda acc: acc["out"])


def encoded(sequence: Column, states: Column) -> Column:
    """Pattern of a sequence: the state of each CG at its C, 2 elsewhere. In time linear in the sequence."""
    pieces = F.transform(F.split(sequence, "CG"), lambda x: F.repeat(F.lit("2"), F.length(x)))
    marks = F.zip_with(pieces, states, lambda p, s: F.concat(p, F.when(s.isNotNull(), F.concat(s.cast("string"), F.lit("2"))).otherwise("")))
    return F.array_join(marks, "")


def long_read_calls(alignments: DataFrame, p: Parsing) -> DataFrame:
    """Parsed reads of records with MM and ML tags, by the likelihoods of C+m, or with ``combine`` of C+m and C+h together.

    Records without the tags or the code go, as do those whose calls are not one for each CG of the read as it was sequenced.
    """
    forward = F.when(F.col("flag").bitwiseAND(16) != 0, F.reverse(F.translate("seq", "ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN"))).otherwise(F.col("seq"))
    tagged = alignments.filter("mm is not null and ml is not null and seq is not null").withColumn("seq", forward)
    called = tagged.withColumn("_m", patterns.modification_values(F.col("mm"), F.col("ml"), "C+m")).filter(F.size("_m") > 0).filter(patterns.complete_calls(F.col("seq"), F.col("_m")))
    if p.combine:
        called = called.withColumn("_m", patterns.add_modifications(F.col("_m"), patterns.modification_values(F.col("mm"), F.col("ml"), "C+h")))
    state = F.transform("_m", lambda x: F.when(x > p.methylated, 1).when(x <= p.unmethylated, 0).otherwise(2))
    return _stated(called.withColumn("_states", state).withColumn("_at", cg_sites(F.col("seq"))), p)


def bisulfite_calls(alignments: DataFrame, chunked: DataFrame, size: int, p: Parsing) -> DataFrame:
    """Parsed reads of converted reads, by their bases against the reference; seq is the reference's, with one base more if that ends a CG.

    chunked: of sources.fasta.chunks() with this size and an overlap that no read's span on the reference exceeds. Records whose contig the
    reference lacks go. A read meets the chunk that it starts in.
    """
    named = chunked.select(F.regexp_replace("record", "^chr", "").alias("_contig"), F.col("start").alias("_start"), "sequence")
    read = alignments.filter("cigar is not null and seq is not null").withColumn("_contig", F.regexp_replace("chromosome", "^chr", "")).withColumn("_start", F.floor(F.col("read_start") / size) * size)
    span = F.col("read_end") - F.col("read_start")
    met = read.join(named, ["_contig", "_start"]).withColumn("_ref", F.substring("sequence", (F.col("read_start") - F.col("_start") + 1).cast("int"), (span + 1).cast("int"))).drop("sequence")
    one_more = (F.length("_ref") > span) & F.col("_ref").endswith("CG")
    cut = met.withColumn("_ref", F.when(one_more, F.col("_ref")).otherwise(F.substring("_ref", F.lit(1), span.cast("int")))).withColumn("_bases", patterns.aligned_sequence(F.col("seq"), F.col("cigar")))
    back = patterns.strand_reversed(F.col("flag"))
    pattern = F.when(back, patterns.call_bisulfite(F.col("_ref"), F.col("_bases"), True)).otherwise(patterns.call_bisulfite(F.col("_ref"), F.col("_bases"), False))
    stated = cut.withColumn("_pattern", pattern).withColumn("_at", cg_sites(F.col("_ref"))).withColumn("seq", F.col("_ref"))
    return _stated(stated.withColumn("_states", F.transform("_at", lambda i: F.substring("_pattern", i + 1, F.lit(1)).cast("int"))), p)


def with_fallback(alignments: DataFrame, p: Parsing, parse) -> DataFrame | None:
    """parse(records that pass); if none comes out, once more without flags; None if still none does."""
    from dataclasses import replace

    for q in (p, replace(p, require=0, exclude=0)):
        rows = parse(passing(alignments, q), q)
        if rows.take(1):
            return rows
    return None


def recovered(parsed: DataFrame, kind: str) -> DataFrame:
    """Parsed reads in the layout of recovered reads: ref_name, ref_pos, original_seq, methyl_seq, ctype; ref_name begins with chr."""
    name = F.when(F.col("chromosome").startswith("chr"), F.col("chromosome")).otherwise(F.concat(F.lit("chr"), "chromosome"))
    return parsed.select(name.alias("ref_name"), F.col("read_start").alias("ref_pos"), F.col("seq").alias("original_seq"), F.col("methylation_encoding").alias("methyl_seq"), F.lit(kind).alias("ctype"))
