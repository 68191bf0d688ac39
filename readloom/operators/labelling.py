"""Soft labels, lookup and Beta classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns, vectors
from ..session import by_region, settled
from .atlases import positions

#: Signatures of a region up to which all of them are compared, by their bits; those of a larger region meet by the parts that they share.
ALL_PAIRS = 1000


def with_signature(rows: DataFrame) -> DataFrame:
    """rows with signature: known positions and states as sorted strings pos:state, comparable in any engine."""
    pairs = F.transform(patterns.signature(F.col("read_start"), F.col("methylation_ids")), lambda p: F.concat(p["pos"].cast("string"), F.lit(":"), p["state"].cast("string")))
    return rows.withColumn("signature", F.array_join(pairs, ","))


def class_counts(rows: DataFrame, classes: int, keys: tuple[str, ...] = ("name", "signature")) -> DataFrame:
    """keys and counts: an array with the number of reads of each class; a row stands for read_count reads where rows have it."""
    mine = lambda k: F.col("original_label") == k
    at = [F.sum(F.when(mine(k), F.col("read_count")).otherwise(0)).cast("long") if "read_count" in rows.columns else F.count_if(mine(k)) for k in range(classes)]
    return rows.groupBy(*keys).agg(F.array(*at).alias("counts"))


def by_name(rows: DataFrame, *others: str) -> DataFrame:
    """(others, name, read_start, methylation_ids), dealt by region and cut to the known positions, so that two rows of a region agree in both where they have one signature.

    Signatures are made of that where they are wanted, behind what is shuffled and written; what is done by region is not shuffled again.
    """
    start, pattern = patterns.known_span(F.col("read_start"), F.col("methylation_ids"))
    return rows.select(*others, "name", start.alias("read_start"), pattern.alias("methylation_ids")).repartition("name")


def signature_counts(rows: DataFrame, classes: int) -> DataFrame:
    """class_counts(), written once. rows: with their signature, or those of by_name(), which are counted and written by their patterns."""
    if "signature" in rows.columns:
        return settled(class_counts(rows, classes))
    return with_signature(settled(class_counts(rows, classes, ("name", "read_start", "methylation_ids")))).select("name", "signature", "counts")


def class_weights(rows: DataFrame) -> DataFrame:
    """(original_label, n, weight): median of the class totals over the own total."""
    totals = rows.groupBy("original_label").agg(F.count("*").alias("n"))
    middle = totals.agg(F.median("n").alias("_m"))
    return totals.join(F.broadcast(middle), F.lit(True)).select("original_label", "n", (F.col("_m") / (F.col("n") + 1e-9)).alias("weight"))


def counted_weights(counts: DataFrame, classes: int) -> DataFrame:
    """class_weights() from a table of counts."""
    totals = counts.agg(*[F.sum(F.col("counts")[k]).alias(f"n{k}") for k in range(classes)])
    long = totals.select(F.posexplode(F.array(*[F.col(f"n{k}") for k in range(classes)])).alias("original_label", "n")).filter("n > 0")
    middle = long.agg(F.median("n").alias("_m"))
    return long.join(F.broadcast(middle), F.lit(True)).select("original_label", "n", (F.col("_m") / (F.col("n") + 1e-9)).alias("weight"))


def class_priors(rows: DataFrame, classes: int, kind: str = "frequency") -> DataFrame:
    """(original_label, prior): uniform, frequency or inverse (0 for absent classes; uniform if all are)."""
    codes = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias("original_label"))
    n = codes.join(rows.groupBy("original_label").agg(F.count("*").alias("n")), "original_label", "left").na.fill(0, ["n"])
    value = {"uniform": F.lit(1.0), "frequency": F.col("n").cast("double"), "inverse": F.when(F.col("n") > 0, 1.0 / F.col("n")).otherwise(0.0)}[kind]
    weighed = n.withColumn("_v", value)
    total = weighed.agg(F.sum("_v").alias("_t"))
    return weighed.join(F.broadcast(total), F.lit(True)).select("original_label", F.when(F.col("_t") > 0, F.col("_v") / F.col("_t")).otherwise(1.0 / classes).alias("prior"))


def weighed(counts: DataFrame, weights: DataFrame, classes: int, keep: str | None = None) -> DataFrame:
    """counts with soft_label: weighted counts over their sum (all 0 if there are none); the weighted counts too, under the name ``keep``."""
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("original_label", "weight"))).alias("_w"))  # one row, an entry a class
    v = F.transform("counts", lambda c, k: c * F.coalesce(F.try_element_at(F.col("_w"), k), F.lit(0.0)))
    joined = counts.join(F.broadcast(table), F.lit(True)).withColumn("_v", v)
    total = vectors.total(F.col("_v"))
    found = joined.withColumn("soft_label", F.when(total > 0, F.transform("_v", lambda x: x / total)).otherwise(F.col("_v"))).drop("_w")
    return found.withColumnRenamed("_v", keep) if keep else found.drop("_v")


def soft_labels(rows: DataFrame, classes: int) -> DataFrame:
    """(name, signature, counts, soft_label) from the reads' own classes."""
    counts = settled(class_counts(rows, classes))
    return weighed(counts, counted_weights(counts, classes), classes)


def own_soft_labels(rows: DataFrame, weights: DataFrame, classes: int) -> DataFrame:
    """Distinct rows of by_name() with the soft_label of their signature among all of them, counted where the region is. weights: original_label, weight."""
    same = Window.partitionBy("name", "read_start", "methylation_ids")
    counted = rows.withColumns({f"_n{k}": F.sum(F.when(F.col("original_label") == k, 1).otherwise(0)).over(same).cast("long") for k in range(classes)}).distinct()
    return weighed(counted.select(*rows.columns, F.array(*[F.col(f"_n{k}") for k in range(classes)]).alias("counts")), weights, classes)


def label_reads(rows: DataFrame, labels: DataFrame, classes: int, fallback: DataFrame | None = None) -> DataFrame:
    """rows with the soft_label of their (name, signature); one that labels lack has the fallback: priors (original_label, prior), or a uniform vector."""
    joined = rows.join(labels.select("name", "signature", "soft_label"), ["name", "signature"], "left")
    if fallback is None:
        return joined.withColumn("soft_label", F.coalesce("soft_label", F.array_repeat(F.lit(1.0 / classes), classes)))
    given = F.broadcast(fallback.agg(F.map_from_entries(F.collect_list(F.struct("original_label", "prior"))).alias("_f")))  # one row, an entry a class
    vector = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.coalesce(F.try_element_at(F.col("_f"), k), F.lit(0.0)))
    return joined.join(given, F.lit(True)).withColumn("soft_label", F.coalesce("soft_label", vector)).drop("_f")


def _parts(rows: DataFrame, among: DataFrame) -> DataFrame:
    """(name, signature, size, part, place): a row a part of each signature, numbered from what is rarest in its region ``among`` on. Empty signatures have none."""
    words = lambda df: df.filter("signature <> ''").select("name", "signature", F.explode(F.split("signature", ",")).alias("part"))
    often = words(among).groupBy("name", "part").agg(F.count("*").alias("_n"))
    own = Window.partitionBy("name", "signature")
    ranked = words(rows).join(often, ["name", "part"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    return ranked.withColumn("place", F.row_number().over(own.orderBy("_n", "part"))).withColumn("size", F.count("*").over(own)).drop("_n")


def _size(signature: str) -> Column:
    """Number of parts of a signature."""
    return F.when(F.col(signature) == "", 0).otherwise(F.size(F.split(signature, ",")))


def _common(signature: str, other: str) -> Column:
    """Number of parts that two signatures share."""
    return F.size(F.array_intersect(F.split(signature, ","), F.split(other, ",")))


def _with_bits(rows: DataFrame) -> DataFrame:
    """rows with the number of parts of their signature and a set of 128 bits, a bit a part: within 64 positions none is shared by two."""
    number = lambda x: F.coalesce(F.replace(x, F.lit(":"), F.lit("")).try_cast("long"), F.hash(x).cast("long"))
    ones = F.transform(F.when(F.col("signature") == "", F.array().cast("array<string>")).otherwise(F.split("signature", ",")), lambda x: F.pmod(number(x), F.lit(128)).cast("int"))
    half = lambda low: F.aggregate("_ones", F.lit(0).cast("long"), lambda acc, x: F.when((x < 64) == low, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x % 64))).otherwise(acc))
    return rows.withColumn("_ones", ones).withColumns({"_a": half(True), "_b": half(False), "_s": _size("signature")}).drop("_ones")


def _side_by_side(asked: DataFrame, others: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """asked and others with bits, the columns of others under names of their own, and ``keep`` of theirs as it is."""
    mine = _with_bits(asked.select("name", "signature"))
    theirs = _with_bits(others.select("name", "signature", *keep)).withColumnsRenamed({"name": "_name", "signature": "other", "_a": "_oa", "_b": "_ob", "_s": "_os"})
    return mine, theirs


def _at_most_common() -> Column:
    """What two signatures may share by their bits: the bits of both, and the parts that share their bit with another of the same signature."""
    shared = F.bit_count(F.col("_a").bitwiseAND(F.col("_oa"))) + F.bit_count(F.col("_b").bitwiseAND(F.col("_ob")))
    return shared + F.least(F.col("_s") - F.bit_count("_a") - F.bit_count("_b"), F.col("_os") - F.bit_count("_oa") - F.bit_count("_ob"))


def _distance(where: Column | None = None) -> Column:
    """Jaccard distance of signature and other; two empty ones have 0. where: what the bits say, null otherwise; a filter may be moved before others, a branch is not entered."""
    common = _common("signature", "other")
    distance = F.when(F.col("signature") == F.col("other"), 0.0).otherwise(1 - common / (F.col("_s") + F.col("_os") - common))
    return distance if where is None else F.when(where, distance)


def _by_size(table: DataFrame, *more: DataFrame) -> list[list[DataFrame]]:
    """The tables (name, others), cut into regions that have up to ALL_PAIRS rows of the first one, and, if there are any, larger ones."""
    large = settled(table.groupBy("name").agg(F.count("*").alias("_n")).filter(F.col("_n") > ALL_PAIRS).select("name"))
    if not large.take(1):
        return [[table, *more]]
    large = by_region(large)
    return [[t.join(large, "name", how) for t in (table, *more)] for how in ("left_anti", "left_semi")]


def _near_of_few(asked: DataFrame, others: DataFrame, max_distance: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """near_pairs() of regions with few signatures: all of a region meet by their bits, and what may be near is compared whole. Rows stay where their region is."""
    like = 1.0 - max_distance
    mine, theirs = _side_by_side(asked, others, keep)
    near = _at_most_common() * (1 + like) >= (F.col("_s") + F.col("_os")) * like - 1e-9
    met = mine.join(theirs.hint("merge"), F.col("name") == F.col("_name"))
    return met.withColumn("distance", _distance(near)).filter(F.col("distance") <= max_distance).select("name", "signature", "other", "distance", *keep)


def _near_of_many(asked: DataFrame, others: DataFrame, max_distance: float) -> DataFrame:
    """near_pairs() of regions with many signatures, which meet by their rarest parts.

    Two sets that are so near share one of their rarest parts: of a set of n parts the n - ceil((1 - max_distance) n) + 1 rarest are enough
    to find it by, and sizes further apart than that ratio are not compared. Only what so meets is compared whole.
    """
    like = 1.0 - max_distance
    enough = F.col("place") <= F.col("size") - F.ceil(F.col("size") * like - 1e-9) + 1
    prefix = lambda rows: _parts(rows, others).filter(enough).select("name", "part", "signature", F.col("size").alias("_s"))
    met = prefix(asked).join(prefix(others).withColumnsRenamed({"signature": "other", "_s": "_os"}), ["name", "part"])
    met = met.filter((F.col("_os") >= F.col("_s") * like - 1e-9) & (F.col("_s") >= F.col("_os") * like - 1e-9)).drop("part").distinct()
    apart = met.withColumn("distance", _distance()).filter(F.col("distance") <= max_distance).select("name", "signature", "other", "distance")
    empty = lambda rows: rows.filter("signature = ''").select("name", "signature").distinct()
    return apart.unionByName(empty(asked).join(empty(others), ["name", "signature"], "left_semi").select("name", "signature", F.lit("").alias("other"), F.lit(0.0).alias("distance")))


def near_pairs(counts: DataFrame, max_distance: float, of: DataFrame | None = None) -> DataFrame:
    """(name, signature, other, distance): signatures of one region at a Jaccard distance of max_distance at most, itself included; two empty ones have distance 0.

    of: (name, signature) whose neighbours are wanted, all by default. Regions of up to ALL_PAIRS signatures compare bits of all; in larger ones only what shares a rare part is compared.
    """
    if max_distance >= 1:
        raise ValueError("neighbours are found by what they share: max_distance is below 1")
    few, *many = _by_size(counts.select("name", "signature"), counts if of is None else of)
    pairs = _near_of_few(few[1], few[0], max_distance)
    for others, asked in many:
        pairs = pairs.unionByName(_near_of_many(asked, others, max_distance))
    return pairs


def pooled_counts(counts: DataFrame, classes: int, min_reads: int = 30, max_distance: float = 0.5) -> DataFrame:
    """counts summed over a signature's neighbours in its region, nearest first (Jaccard, ties by signature), until min_reads are there; none beyond max_distance.

    In regions of few signatures, neighbours, their order and their sums are all found where the region's rows are: counts are shuffled, not pairs.
    """
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + x)

    def pooled(pairs: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("n").over(Window.partitionBy("name", "signature").orderBy("distance", "other").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        used = pairs.withColumn("n", n).withColumn("before", before).filter(F.col("before") < min_reads)
        return used.groupBy("name", "signature").agg(F.array(*[F.sum(F.col("counts")[k]) for k in range(classes)]).alias("counts"))

    if max_distance >= 1:
        raise ValueError("neighbours are found by what they share: max_distance is below 1")
    few, *many = _by_size(counts)
    asked = lambda rows: rows.filter(n < min_reads)  # noqa: E731  the others need no neighbours
    out = counts.filter(n >= min_reads).select("name", "signature", "counts").unionByName(pooled(_near_of_few(asked(few[0]), few[0], max_distance, ("counts",))))
    for (rows,) in many:
        pairs = _near_of_many(asked(rows).select("name", "signature"), rows, max_distance)
        out = out.unionByName(pooled(pairs.join(rows.select("name", F.col("signature").alias("other"), "counts"), ["name", "other"])))
    return out


def pooled_soft_labels(rows: DataFrame, classes: int, min_reads: int = 30, max_distance: float = 0.5) -> DataFrame:
    """soft_labels() with the counts pooled over near signatures; class weights are those of the reads."""
    counts = settled(class_counts(rows, classes))
    return weighed(pooled_counts(counts, classes, min_reads, max_distance), counted_weights(counts, classes), classes)


def fit_lookup(rows: DataFrame, classes: int, min_reads: int = 30, max_distance: float = 0.41) -> DataFrame:
    """(name, signature, counts, label): the model of a soft lookup. counts are pooled over near signatures and weighed by class; label is what a known signature is told, their shares."""
    base = signature_counts(rows, classes)
    pooled = weighed(pooled_counts(base, classes, min_reads, max_distance), counted_weights(base, classes), classes, keep="weighted")
    return pooled.select("name", "signature", F.col("weighted").alias("counts"), F.col("soft_label").alias("label"))


def with_labels(model: DataFrame) -> DataFrame:
    """A model (name, signature, counts) of fit_lookup() with the labels that its counts tell, so that they need not be written."""
    total = vectors.total(F.col("counts"))
    return model.select("name", "signature", "counts", F.when(total > 0, F.transform("counts", lambda x: x / total)).otherwise(F.col("counts")).alias("label"))


def fit_hard_lookup(rows: DataFrame, classes: int, least: float = 10.0) -> DataFrame:
    """(name, signature, counts, label): the model of a hard lookup: 1 for the class with the largest weighed count, shared by classes that tie exactly.

    Raises where, of all reads, the largest class has less than ``least`` times the reads of the next one: hard calls want a background that dominates.
    """
    base = signature_counts(rows, classes)
    totals = base.agg(*[F.sum(F.col("counts")[k]).alias(str(k)) for k in range(classes)]).first()
    order = sorted(((n or 0, k) for k, n in enumerate(totals)), reverse=True)
    if len(order) > 1 and order[0][0] < least * order[1][0]:
        (top, a), (next_one, b) = order[:2]
        raise ValueError(f"class {a} has {top} reads and class {b} has {next_one}: the largest class must have {least:g} times the reads of the next")
    soft = weighed(base, counted_weights(base, classes), classes, keep="weighted")
    most = F.array_max("weighted")
    ties = F.size(F.filter("weighted", lambda x: x == most))
    hard = soft.select("name", "signature", F.transform("weighted", lambda x: F.when(x == most, 1.0 / ties).otherwise(0.0)).alias("counts"))
    return hard.withColumn("label", F.col("counts"))


def archetype_models(rows: DataFrame, classes: int, epsilon: float = 1e-10) -> DataFrame:
    """(name, pos, mu): at each position of a region an array with the methylated share of every class.

    A class without reads in the region has 1, one without reads at a position its mean over the region's positions; all are
    clipped to [e, 1 - e]. A position is one row with all classes, so nothing is multiplied by their number.
    """
    own = lambda k: F.avg(F.when(F.col("original_label") == k, F.col("state")))
    seen = positions(rows, "name", "original_label").groupBy("name", "pos").agg(F.array(*[own(k) for k in range(classes)]).alias("own"))
    means = seen.groupBy("name").agg(F.array(*[F.avg(F.col("own")[k]) for k in range(classes)]).alias("mean"))
    clipped = lambda x: F.least(F.greatest(x, F.lit(epsilon)), F.lit(1 - epsilon))
    mu = F.zip_with("own", "mean", lambda a, b: clipped(F.coalesce(a, b, F.lit(1.0))))
    return seen.join(means.hint("merge"), "name").select("name", "pos", mu.alias("mu"))


def archetypes(rows: DataFrame, classes: int, epsilon: float = 1e-10) -> DataFrame:
    """(name, original_label, pos, mu): archetype_models() with a row a class."""
    return archetype_models(rows, classes, epsilon).select("name", F.posexplode("mu").alias("original_label", "mu"), "pos").select("name", "original_label", "pos", "mu")


def archetype_labels(rows: DataFrame, models: DataFrame, priors: DataFrame, classes: int) -> DataFrame:
    """(name, signature, probabilities) for distinct signatures: Bayes over classes with log-sum-exp. models: name, pos, mu; priors: original_label, prior (0 stays 0).

    A region's logs are one row (as many entries as it has positions), so a signature meets them whole and is not repeated for each of its positions.
    """
    logs = F.struct(F.transform("mu", lambda x: F.log(1 - x)).alias("l0"), F.transform("mu", lambda x: F.log(x)).alias("l1"))
    table = models.select("name", "pos", logs.alias("_e")).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("pos", "_e"))).alias("_t"))
    told = rows.select("name", "signature").distinct().filter("signature <> ''").join(table.hint("merge"), "name")
    entry = lambda x: F.struct((F.split_part(x, F.lit(":"), F.lit(2)) == "1").alias("one"), F.try_element_at("_t", F.split_part(x, F.lit(":"), F.lit(1)).cast("long")).alias("e"))
    met = F.filter(F.transform(F.split("signature", ","), entry), lambda x: x["e"].isNotNull())
    total = F.aggregate("_met", F.array_repeat(F.lit(0.0), classes), lambda acc, x: F.zip_with(acc, F.when(x["one"], x["e"]["l1"]).otherwise(x["e"]["l0"]), lambda a, v: a + v))
    summed = told.withColumn("_met", met).filter(F.size("_met") > 0).select("name", "signature", total.alias("_ll"))
    prior = F.broadcast(priors.agg(F.map_from_entries(F.collect_list(F.struct("original_label", "prior"))).alias("_prior")))  # one row, an entry a class
    post = F.transform("_ll", lambda x, k: F.when(F.coalesce(F.try_element_at(F.col("_prior"), k), F.lit(0.0)) > 0, x + F.log(F.try_element_at(F.col("_prior"), k))).otherwise(float("-inf")))
    return summed.join(prior, F.lit(True)).select("name", "signature", vectors.softmax(post).alias("probabilities"))


def nearest_signatures(misses: DataFrame, model: DataFrame, within: float = 0.5) -> DataFrame:
    """(name, signature, other) of misses (name, signature), and the counts of model where it has them: the model's nearest signatures of their region, all that tie, among those that share a part.

    In regions of up to ALL_PAIRS known signatures, bits tell what may share a part. In larger ones, neighbours up to ``within`` are found by the
    rarest parts; only what has none so near meets all that share any part.
    """
    keys, keep = ["name", "signature"], tuple(c for c in model.columns if c == "counts")
    few, *many = _by_size(model.select(*keys, *keep), misses.select(*keys))
    mine, theirs = _side_by_side(few[1], few[0], keep)
    met = mine.join(theirs.hint("merge"), F.col("name") == F.col("_name"))
    out = _closest(met.withColumn("distance", _distance(_at_most_common() > 0)).filter("distance < 1").select(*keys, "other", "distance", *keep))
    for known, asked in many:
        close = settled(_closest(_near_of_many(asked, known, within)))
        parts = lambda df, c: df.withColumn("part", F.explode(F.split(c, ","))).filter("part <> ''")
        rest = parts(asked.join(close.select(*keys).distinct(), keys, "left_anti"), "signature")
        met = rest.join(parts(known.select("name", F.col("signature").alias("other")), "other"), ["name", "part"]).groupBy(*keys, "other").agg(F.count("*").alias("common"))
        far = met.select(*keys, "other", (1 - F.col("common") / (_size("signature") + _size("other") - F.col("common"))).alias("distance"))
        found = close.unionByName(_closest(far))
        out = out.unionByName(found.join(known.withColumnRenamed("signature", "other"), ["name", "other"]).select(*out.columns) if keep else found)
    return out


def _closest(pairs: DataFrame) -> DataFrame:
    """pairs (name, signature, other, distance, others) at the least distance of their signature, without it."""
    return pairs.withColumn("_r", F.rank().over(Window.partitionBy("name", "signature").orderBy("distance"))).filter("_r = 1").drop("_r", "distance")


def lookup_signatures(signatures: DataFrame, model: DataFrame, classes: int, hard: bool = False) -> DataFrame:
    """(name, signature, source, prediction) of distinct signatures (name, signature).

    source: exact; 1nn: the counts of all nearest signatures of the region, summed (Jaccard; where none shares a part all of the region
    are at distance 1); none: the region is unseen, uniform, or the last class with ``hard``. model: name, signature, counts (numbers of reads, or
    what fit_lookup() and fit_hard_lookup() make of them), and label where a known signature has one of its own.
    """
    keys = ["name", "signature"]
    own = F.col("label") if "label" in model.columns else F.col("counts")
    first = signatures.select(*keys).distinct().join(model.select(*keys, own.cast("array<double>").alias("hit")), keys, "left")
    misses = settled(first.filter("hit is null").select(*keys))
    pool = F.array(*[F.sum(F.col("counts")[k].cast("double")) for k in range(classes)])
    near = nearest_signatures(misses, model).groupBy(*keys).agg(pool.alias("near"))
    region = model.groupBy("name").agg(pool.alias("all"))
    joined = first.join(near, keys, "left").join(region, "name", "left")
    even = F.array(*[F.lit(1.0)] * classes)
    unseen = F.array(*[F.lit(0.0 if hard and k < classes - 1 else 1.0) for k in range(classes)])
    chosen = F.coalesce("hit", "near", "all", unseen)
    source = F.when(F.col("hit").isNotNull(), "exact").when(F.col("all").isNotNull(), "1nn").otherwise("none")
    given = joined.withColumn("source", source).withColumn("_c", F.when(vectors.total(chosen) > 0, chosen).otherwise(even))
    total = vectors.total(F.col("_c"))
    return given.select(*keys, "source", F.transform("_c", lambda x: x / total).alias("prediction"))


def lookup(reads: DataFrame, model: DataFrame, classes: int, hard: bool = False) -> DataFrame:
    """(read_name, name, source, prediction) of reads (read_name, name, signature), one row each: see lookup_signatures()."""
    found = lookup_signatures(reads, model, classes, hard)
    return reads.select("read_name", "name", "signature").join(found, ["name", "signature"]).select("read_name", "name", "source", "prediction")


def beta_statistics(rows: DataFrame, clip: float = 0.01, times: str | None = None) -> DataFrame:
    """(name, original_label, n, ones, zeros, slog, slog1): what a Beta fit of the reads' rates needs, rates clipped for the logs. times: the column with the number of reads that a row stands for."""
    rate = F.least(F.greatest(F.col("M_rate"), F.lit(clip)), F.lit(1 - clip))
    known = rows.filter("NCPGS > 0")
    w = F.col(times) if times else F.lit(1)
    of = lambda c: F.sum(F.when(F.col("M_rate") == c, w).otherwise(0)).cast("long")
    return known.groupBy("name", "original_label").agg(
        F.sum(w).cast("long").alias("n"), of(1).alias("ones"), of(0).alias("zeros"), F.sum(F.col("NCPGS") * w).cast("long").alias("cpgs"), F.sum(F.log(rate) * w).alias("slog"), F.sum(F.log(1 - rate) * w).alias("slog1")
    )


def added_one_beta(rows: DataFrame) -> DataFrame:
    """(name, original_label, eta, rho): one more than the known positions of either state, a model without a fit."""
    grid = rows.groupBy("name", "original_label").agg(F.sum("M").alias("m"), F.sum("U").alias("u"))
    return grid.select("name", "original_label", (F.col("m") + 1.0).alias("eta"), (F.col("u") + 1.0).alias("rho"))


def beta_predict(rows: DataFrame, params: DataFrame, priors: DataFrame, classes: int) -> DataFrame:
    """rows (name, M, U, others) with prediction: posterior over classes of a read with M and U known positions; 0 for a class that a region's params lack. Rows of regions without params go.

    The Beta functions of the likelihood cancel to (eta / (eta + rho))^M (rho / (eta + rho))^U. params: name, original_label, eta, rho.
    """
    share = F.log(F.col("eta") / (F.col("eta") + F.col("rho"))), F.log(F.col("rho") / (F.col("eta") + F.col("rho")))
    table = params.join(priors, "original_label").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("original_label", share[0].alias("lm"), share[1].alias("lu"), F.log("prior").alias("lp")))).alias("classes"))
    joined = rows.join(table, "name")
    logs = F.transform("classes", lambda c: F.col("M") * c["lm"] + F.col("U") * c["lu"] + c["lp"])
    known = F.map_from_arrays(F.transform("classes", lambda c: c["original_label"].cast("int")), vectors.softmax(logs))
    every = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.coalesce(F.try_element_at(known, k), F.lit(0.0)))
    return joined.select(*rows.columns, every.alias("prediction"))


def supersets(counts: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(name, signature, other): signatures of the region that hold all of one, itself included. of: (name, signature) whose holders are wanted, all by default.

    In regions of up to ALL_PAIRS signatures, bits tell what may hold what. In larger ones, what holds a signature holds its rarest part, so each
    is met by that one part only. Empty signatures are left out.
    """
    few, *many = _by_size(counts.select("name", "signature"), counts if of is None else of)
    mine, theirs = _side_by_side(few[1].filter("signature <> ''"), few[0])
    holds = (F.col("_a").bitwiseAND(F.col("_oa")) == F.col("_a")) & (F.col("_b").bitwiseAND(F.col("_ob")) == F.col("_b")) & (F.col("_s") <= F.col("_os"))
    all_of = F.size(F.array_except(F.split("signature", ","), F.split("other", ","))) == 0
    met = mine.join(theirs.hint("merge"), F.col("name") == F.col("_name")).filter(F.when(holds, all_of)).select("name", "signature", "other")
    for rows, asked in many:
        first = _parts(asked, rows).filter("place = 1").select("name", "part", "signature")
        words = rows.select("name", F.col("signature").alias("other"), F.explode(F.split("signature", ",")).alias("part"))
        met = met.unionByName(first.join(words, ["name", "part"]).filter(all_of).select("name", "signature", "other"))
    return met


def label_vector(label: Column, classes: int) -> Column:
    return vectors.one_hot(label, classes)


def superset_pooled_counts(counts: DataFrame, classes: int, min_reads: int = 30, max_distance: float = 0.5) -> DataFrame:
    """(name, signature, counts, pooled): counts pooled first over all signatures that hold the own one, whatever their number.

    Where fewer than min_reads are so there, near signatures follow, the nearest first (Jaccard, ties by signature), each with
    the signatures that hold it, nearest first, right behind it. One that is there already is passed over; the first that is
    beyond max_distance ends the search, as do min_reads reads. Empty signatures are held by all of their region.

    Every signature has a read at least, so no more than min_reads of either list are ever needed: what is folded for a
    signature is bounded, whatever its region holds.
    """
    each = F.aggregate("counts", F.lit(0).cast("long"), lambda acc, x: acc + x)
    sized = settled(counts.select("name", "signature", "counts", each.alias("reads")).filter("reads > 0"))
    own = sized.select("name", F.col("signature").alias("other"), "counts", "reads")
    empty = sized.filter("signature = ''").select("name", "signature").join(own.select("name", "other"), "name")
    held = supersets(sized).unionByName(empty)
    summed = [F.sum(F.col("counts")[k]) for k in range(classes)]
    base = settled(held.join(own, ["name", "other"]).groupBy("name", "signature").agg(F.array(*summed).alias("counts"), F.sum("reads").alias("reads"), F.count("*").cast("int").alias("pooled")))
    few = base.filter(F.col("reads") < min_reads)  # these are held by fewer than min_reads signatures
    wanted = settled(held.join(few, ["name", "signature"], "left_semi").groupBy("name", "signature").agg(F.collect_list("other").alias("taken")))
    short = few.join(wanted, ["name", "signature"])

    # neighbours, and behind each of them what holds it: the first min_reads of either that are not taken yet
    near = near_pairs(sized, max_distance, wanted.select("name", "signature")).join(wanted, ["name", "signature"]).filter(~F.array_contains("taken", F.col("other")))
    order = Window.partitionBy("name", "signature").orderBy("distance", "other")
    near = settled(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= min_reads))
    above = supersets(sized, near.select("name", F.col("other").alias("signature")).distinct()).filter("signature <> other").select("name", F.col("signature").alias("other"), F.col("other").alias("holder"))
    common = F.size(F.array_intersect(F.split("signature", ","), F.split("holder", ",")))
    union = F.size(F.split("signature", ",")) + F.size(F.split("holder", ",")) - common
    behind = near.join(above, ["name", "other"]).filter(~F.array_contains("taken", F.col("holder"))).withColumn("apart", 1 - common / union)
    behind = behind.withColumn("after", F.row_number().over(Window.partitionBy("name", "signature", "place").orderBy("apart", "holder"))).filter(F.col("after") <= min_reads)
    line = near.select("name", "signature", "place", F.lit(0).alias("after"), "distance", "other").unionByName(behind.select("name", "signature", "place", "after", F.col("apart").alias("distance"), F.col("holder").alias("other")))
    queue = line.join(own, ["name", "other"]).groupBy("name", "signature").agg(F.array_sort(F.collect_list(F.struct("place", "after", "distance", "other", "reads", "counts"))).alias("queue"))

    def step(acc: Column, x: Column) -> Column:
        ends = acc["done"] | (x["distance"] > max_distance)
        skip = ends | F.array_contains(acc["taken"], x["other"])
        reads = F.when(skip, acc["reads"]).otherwise(acc["reads"] + x["reads"])
        return F.struct(
            F.when(skip, acc["counts"]).otherwise(F.zip_with(acc["counts"], x["counts"], lambda a, b: a + b)).alias("counts"), reads.alias("reads"),
            F.when(skip, acc["pooled"]).otherwise(acc["pooled"] + 1).alias("pooled"), F.when(skip, acc["taken"]).otherwise(F.concat(acc["taken"], F.array(x["other"]))).alias("taken"), (ends | (reads >= min_reads)).alias("done"),
        )

    start = F.struct("counts", "reads", "pooled", "taken", F.lit(False).alias("done"))
    folded = short.join(queue, ["name", "signature"], "left").withColumn("_f", F.aggregate(F.coalesce("queue", F.array().cast(queue.schema["queue"].dataType)), start, step))
    more = folded.select("name", "signature", F.col("_f.counts").alias("counts"), F.col("_f.pooled").alias("pooled"))
    return base.filter(F.col("reads") >= min_reads).select("name", "signature", "counts", "pooled").unionByName(more)


def annotate_regions(reads: DataFrame, regions: DataFrame, codes: DataFrame, aliases: dict[str, str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """reads with target, target_matched, target_label and extra columns of their region; reads whose region or target has no code go.

    regions: name, target and extra; codes: label, cell_type. Columns of these names that reads already have are replaced. aliases: other names of cell types.
    """
    extra = extra or []
    if missing := [c for c in extra if c not in regions.columns]:
        raise ValueError(f"regions lack {', '.join(missing)}")
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    matched = F.coalesce(F.try_element_at(known, F.col("target")), "target") if aliases else F.col("target")
    named = regions.select("name", "target", *extra).withColumn("target_matched", matched)
    coded = named.join(codes.select(F.col("cell_type").alias("target_matched"), F.col("label").cast("int").alias("target_label")), "target_matched")
    return reads.drop("target", "target_matched", "target_label", *extra).join(by_region(coded), "name")
