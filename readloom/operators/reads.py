"""Preparing reads: adapting, trimming, annotating, filtering, de-duplicating, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns, vectors
from . import intervals

# Names under which files hold the two columns.
ALIASES = {
    "input_ids": ("input_ids", "genome_sequence", "seq", "dna", "original_seq"),
    "methylation_ids": ("methylation_ids", "cpg_methylation_sequence", "pattern", "methyl_seq", "methylation_encoding"),
}


def resolve(df: DataFrame, name: str) -> str:
    """The column that holds a canonical one: the first alias that is there."""
    for alias in ALIASES.get(name, (name,)):
        if alias in df.columns:
            return alias
    raise ValueError(f"no column for {name}: {', '.join(df.columns)}")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def adapt(raw: DataFrame, codes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Recovered reads (ref_name, ref_pos, original_seq, methyl_seq, ctype) in the common form; read_end is the last position.

    codes: name, code; aliases: alias, name. Cell types without a code go. A column file stays.
    """
    require(raw, ["ref_name", "ref_pos", "original_seq", "methyl_seq", "ctype"])
    named = raw
    if aliases is not None:
        named = raw.join(aliases, raw.ctype == aliases.alias, "left").withColumn("ctype", F.coalesce("name", "ctype")).drop("alias", "name")
    return named.join(codes, named.ctype == codes.name).select(
        F.col("ref_name").alias("chromosome"), F.col("ref_pos").alias("read_start"), (F.col("ref_pos") + F.length("original_seq") - 1).alias("read_end"),
        F.col("original_seq").alias("input_ids"), F.col("methyl_seq").alias("methylation_ids"), F.col("code").cast("int").alias("original_label"),
        *[F.col(c) for c in ("file",) if c in raw.columns],
    )


def with_informative(rows: DataFrame) -> DataFrame:
    """rows with NCPGS, from the pattern where it is not there."""
    return rows if "NCPGS" in rows.columns else rows.withColumn("NCPGS", patterns.informative(F.col("methylation_ids")))


def trim(overlaps: DataFrame) -> DataFrame:
    """Reads cut to their region, coordinates and strings."""
    start = F.greatest("read_start", F.col("region_start") - 1)
    end = F.least("read_end", F.col("region_end") - 1)
    cut = overlaps.withColumn("_start", start).withColumn("_end", end)
    for c in ("input_ids", "methylation_ids"):
        if c in overlaps.columns:
            cut = cut.withColumn(c, patterns.slice_text(F.col(c), F.col("read_start"), F.col("_start"), F.col("_end")))
    return cut.withColumn("read_start", F.col("_start")).withColumn("read_end", F.col("_end")).drop("_start", "_end")


def prepare(reads: DataFrame, regions: DataFrame, trimmed: bool = True) -> DataFrame:
    """Overlap, trim, annotate: one row for each read, region name and target, with M, U, NCPGS, M_rate and state."""
    rows = intervals.overlap(reads, regions)
    return annotate(trim(rows) if trimmed else rows)


def annotate(rows: DataFrame) -> DataFrame:
    p = F.col("methylation_ids")
    return rows.select("*", patterns.count_of(p, "1").alias("M"), patterns.count_of(p, "0").alias("U"), patterns.informative(p).alias("NCPGS"), patterns.methylation_rate(p).alias("M_rate"), patterns.read_state(p).alias("state"))


def split_long(rows: DataFrame, width: int) -> DataFrame:
    """rows (input_ids, methylation_ids, others) with num_cpgs (known positions): reads longer than width as pieces side by side, a row each. Coordinates stay those of the read; empty and null patterns stay one row (null: no known positions)."""
    starts = F.when(F.length("methylation_ids") > width, patterns.windows(F.length("methylation_ids"), width)).otherwise(F.array(F.lit(0)))
    cut = rows.withColumn("_at", F.explode(starts))
    for c in ("input_ids", "methylation_ids"):
        whole = F.length("methylation_ids") > width
        cut = cut.withColumn(f"_{c}", F.when(whole, F.substring(F.col(c), F.col("_at") + 1, F.lit(width))).otherwise(F.col(c)))
    cut = cut.withColumns({c: F.col(f"_{c}") for c in ("input_ids", "methylation_ids")}).drop("_at", "_input_ids", "_methylation_ids")
    return cut.withColumn("num_cpgs", F.coalesce(patterns.informative(F.col("methylation_ids")), F.lit(0)))


def hard_binary(label: Column, target: Column) -> Column:
    return (label == target).cast("int")


def hard_with_background(label: Column, target: Column, classes: int) -> Column:
    """The label on target, else the background class."""
    return F.when(label == target, label).otherwise(classes)


def smoothed_with_background(label: Column, target: Column, classes: int, epsilon: float = 0.1) -> Column:
    return vectors.smoothed(hard_with_background(label, target, classes), classes + 1, epsilon)


def keep_labels(rows: DataFrame, remap: DataFrame) -> DataFrame:
    """Rows whose read label and target both survive, with new codes. remap: old, new; new codes other than 0 .. K - 1, once each, raise."""
    codes = sorted(r.new for r in remap.select("new").collect())  # a row a class
    if codes != list(range(len(codes))):
        raise ValueError(f"new codes are 0 to {len(codes) - 1}, not {codes}")
    a = remap.select(F.col("old").alias("_a"), F.col("new").alias("_na"))
    b = remap.select(F.col("old").alias("_b"), F.col("new").alias("_nb"))
    both = rows.join(a, rows.original_label == a._a).join(b, rows.target_label == b._b)
    return both.withColumn("original_label", F.col("_na")).withColumn("target_label", F.col("_nb")).drop("_a", "_b", "_na", "_nb")


def deduplicate(rows: DataFrame, keys: list[str], firsts: dict[str, str] | None = None) -> DataFrame:
    """One row a key with read_count (the sum of read_count where the input has it); nulls are a key like others.

    firsts: column -> column that orders it; the value of the smallest stays.
    """
    count = F.sum("read_count") if "read_count" in rows.columns else F.count("*")
    others = [F.min_by(F.col(c), F.col(by)).alias(c) for c, by in (firsts or {}).items()]
    return rows.groupBy(*keys).agg(count.cast("long").alias("read_count"), *others)


def split_counts(rows: DataFrame) -> DataFrame:
    """(file, original_label, n_reads)."""
    return rows.groupBy("file", "original_label").agg(F.count("*").alias("n_reads"))


def numbered(rows: DataFrame, keys: list[str], by: list[str], seed: str) -> DataFrame:
    """rows with _place (from 1, in a seeded order of each group) and _n (rows of the group).

    The order is that of a hash; a group is cut into 4,096 ranges of it, numbered inside a range and from the counts of the
    ranges before, so a group of any size is many tasks.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in by)))
    cut = rows.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    ranges = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_b")
    ranges = ranges.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_b").alias("_kb"), (F.sum("_c").over(before) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    inside = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *by)))
    meets = F.col("_b") == F.col("_kb")
    for n, k in enumerate(keys):
        meets = meets & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return inside.join(ranges, meets).withColumn("_place", F.col("_before") + F.col("_at")).drop("_h", "_b", "_kb", "_at", "_before", *[f"_k{n}" for n in range(len(keys))])


def read_level_split(rows: DataFrame, keys: list[str], by: list[str], train: float | Column = 0.7, valid: float | Column = 0.15, seed: str = "42") -> DataFrame:
    """rows with split: in each group a seeded order, cut at half-even rounded sizes."""
    first, second = (F.bround(F.col("_n") * share) for share in (train, valid))
    split = F.when(F.col("_place") <= first, "train").when(F.col("_place") <= first + second, "valid").otherwise("test")
    return numbered(rows, keys, by, seed).withColumn("split", split).drop("_place", "_n")


def plan_splits(counts: DataFrame, train: float = 0.7, valid: float = 0.15, test: float = 0.15) -> DataFrame:
    """(original_label, file, split, train_share, valid_share) of whole files, by label. counts: file, original_label, n_reads.

    Three files or more: the largest first, each to the split that lacks most of its quota; when no more files are left than
    splits without one, to the empty split with the largest quota, so that none stays empty. Two files: the larger one trains, the
    other is split by reads between valid and test. One file is split by reads ('by_read') three ways. Files of equal size follow
    by name. The state of the greedy choice is three sums and counts, folded over the label's files.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n_reads")).alias("k"), F.col("file").alias("f"))))
    files = counts.groupBy("original_label").agg(ordered.alias("files"), F.sum("n_reads").alias("all"))
    names, shares = ("train", "valid", "test"), {"train": train, "valid": valid, "test": test}

    def largest(of: dict[str, Column]) -> Column:
        most = F.greatest(*of.values())
        return F.when(of["train"] == most, "train").when(of["valid"] == most, "valid").otherwise("test")

    def step(acc: Column, x: Column) -> Column:
        empty = {n: acc[f"{n}_files"] == 0 for n in names}
        left = F.size("files") - acc["done"]
        pressed = sum((e.cast("int") for e in empty.values()), F.lit(0)) >= left
        to = F.when(pressed, largest({n: F.when(empty[n], shares[n]) for n in names})).otherwise(largest({n: F.col("all") * shares[n] - acc[n] for n in names}))
        sums = [(acc[n] + F.when(to == n, (-x["k"]).cast("double")).otherwise(0.0)).alias(n) for n in names]
        sizes = [(acc[f"{n}_files"] + (to == n).cast("int")).alias(f"{n}_files") for n in names]
        return F.struct(*sums, *sizes, (acc["done"] + 1).alias("done"), F.concat(acc["out"], F.array(entry(x["f"], to))).alias("out"))

    def entry(file: Column, split: Column, train_share: float | None = None, valid_share: float | None = None) -> Column:
        return F.struct(file.alias("file"), split.alias("split"), F.lit(train_share).cast("double").alias("train_share"), F.lit(valid_share).cast("double").alias("valid_share"))

    start = F.struct(*[F.lit(0.0).alias(n) for n in names], *[F.lit(0).alias(f"{n}_files") for n in names], F.lit(0).alias("done"), F.array().cast("array<struct<file:string,split:string,train_share:double,valid_share:double>>").alias("out"))
    several = F.aggregate("files", start, step, lambda acc: acc["out"])
    by_read = F.lit("by_read")
    rest = valid / (valid + test)
    two = F.transform("files", lambda x, i: F.when(i == 0, entry(x["f"], F.lit("train"))).otherwise(entry(x["f"], by_read, 0.0, rest)))
    one = F.transform("files", lambda x: entry(x["f"], by_read, train, rest * (1 - train)))
    chosen = F.when(F.size("files") >= 3, several).when(F.size("files") == 2, two).otherwise(one)
    return files.select("original_label", F.inline(chosen))


def apply_splits(rows: DataFrame, plan: DataFrame, by: list[str], seed: str = "42") -> DataFrame:
    """rows (file, original_label, others) with split: that of their file, or by reads where the plan says so. by: columns that tell reads apart."""
    placed = rows.join(plan, ["original_label", "file"])
    whole = placed.filter("split <> 'by_read'").drop("train_share", "valid_share")
    reads = placed.filter("split = 'by_read'").drop("split")
    return whole.unionByName(read_level_split(reads, ["original_label", "file"], by, F.col("train_share"), F.col("valid_share"), seed).drop("train_share", "valid_share"))


def merge_mates(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of exactly two rows a key become one read over both; other rows stay.

    reads: keys, read_start, read_end (inclusive), methylation_ids. Where the two overlap a known state wins over
    2, and two known states that differ give 2; a gap between them is 2.
    """
    order = Window.partitionBy(*keys).orderBy("read_start", "read_end", "methylation_ids")
    w = Window.partitionBy(*keys)
    rows = reads.select(*keys, "read_start", "read_end", "methylation_ids").withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(order))
    a = rows.filter("_n = 2 and _k = 1").drop("_n", "_k")
    b = rows.filter("_n = 2 and _k = 2").select(*keys, F.col("read_start").alias("s2"), F.col("read_end").alias("e2"), F.col("methylation_ids").alias("p2"))
    end = F.greatest("read_end", "e2")
    unknown = lambda n: F.repeat(F.lit("2"), n.cast("int"))
    first = F.concat("methylation_ids", unknown(end - F.col("read_end")))
    second = F.concat(unknown(F.col("s2") - F.col("read_start")), "p2", unknown(end - F.col("e2")))
    state = lambda x, y: F.when(x == y, x).when(x == "2", y).when(y == "2", x).otherwise("2")
    joined = a.join(b, keys).select(*keys, "read_start", end.alias("read_end"), F.array_join(F.zip_with(F.split(first, ""), F.split(second, ""), state), "").alias("methylation_ids"))
    return rows.filter("_n <> 2").drop("_n", "_k").unionByName(joined)


def mean_weights(rows: DataFrame) -> DataFrame:
    """rows with weight: their read_count over the mean read_count of all."""
    return rows.join(F.broadcast(rows.agg(F.avg("read_count").alias("_mean"))), F.lit(True)).withColumn("weight", F.col("read_count") / F.col("_mean")).drop("_mean")


def thinned(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n of the reads that rows stand for, without replacement, as rows with the read_count that is left; all of them if there are no more.

    Each of a row's read_count reads has a hash of (seed, key, number); the n smallest stay. Only the reads in a share of the hashes that
    holds n of them, and hardly more, are put in order.
    """
    each = rows.select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("read_count").cast("long"))).alias("_k"), "read_count").filter("read_count > 0")
    hashed = each.select(key, F.xxhash64(F.lit(seed), key, "_k").alias("_h"), "_k")
    total = rows.agg(F.sum(F.greatest(F.col("read_count"), F.lit(0)))).first()[0] or 0
    share = (n + 8 * n**0.5 + 8) / total if total else 1.0
    few = hashed if share >= 1 else hashed.filter(F.col("_h") < int(-(1 << 63) + share * (1 << 64)))
    if share < 1 and few.limit(n).count() < n:  # less likely than 10^-14
        few = hashed
    chosen = few.orderBy("_h", key, "_k").limit(n)
    return rows.drop("read_count").join(chosen.groupBy(key).agg(F.count("*").alias("read_count")), key)
