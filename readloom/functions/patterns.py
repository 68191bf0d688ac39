"""Expressions over methylation patterns (strings of 0, 1 and 2) and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_of(text: Column, char: str) -> Column:
    """Occurrences of one character."""
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("int")


def informative(pattern: Column) -> Column:
    """Positions whose state is known."""
    return count_of(pattern, "0") + count_of(pattern, "1")


def methylation_rate(pattern: Column) -> Column:
    """Methylated share of the known positions, null if none is known."""
    return F.try_divide(count_of(pattern, "1").cast("double"), informative(pattern).cast("double"))


def read_state(pattern: Column, low: float = 0.25, high: float = 0.75) -> Column:
    """M from the upper threshold on, U up to the lower one, else X; X where nothing is known."""
    rate = methylation_rate(pattern)
    return F.when(rate >= high, "M").when(rate <= low, "U").otherwise("X")


def signature(start: Column, pattern: Column) -> Column:
    """array<struct<pos,state>> of the known positions."""
    chars = F.split(pattern, "")
    pairs = F.transform(chars, lambda x, i: F.struct((start + i).cast("long").alias("pos"), F.when(x.isin("0", "1"), x.cast("int")).alias("state")))
    return F.filter(pairs, lambda p: p["state"].isNotNull())


def known_span(start: Column, pattern: Column) -> tuple[Column, Column]:
    """(place, pattern) from the first known position to the last, unknown states as 2; (0, "") where none is known. As good as signature(), in a tenth of its bytes."""
    known = F.regexp_replace(pattern, "[^01]", "2")
    led = F.ltrim(known, F.lit("2"))
    return F.when(led == "", 0).otherwise(start + F.length(pattern) - F.length(led)).cast("long"), F.rtrim(led, F.lit("2"))


def slice_text(text: Column, old_start: Column, new_start: Column, new_end: Column) -> Column:
    """Part of a text that begins at old_start which covers new_start .. new_end, both included."""
    return F.substring(text, (new_start - old_start + 1).cast("int"), (new_end - new_start + 1).cast("int"))


def complement(text: Column) -> Column:
    return F.translate(text, "ATCG", "TAGC")


def kmers(text: Column, k: int) -> Column:
    """Overlapping k-mers, one space between; empty if the text is shorter."""
    last = F.length(text) - k + 1
    return F.when(last >= 1, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(k))), " ")).otherwise("")


def collapse(states: Column) -> Column:
    """One state for several: 1 if any is 1, else 0 if any is 0, else 2."""
    return F.when(F.exists(states, lambda x: x == 1), 1).when(F.exists(states, lambda x: x == 0), 0).otherwise(2)


def encode_positions(length: Column, positions: Column, states: Column) -> Column:
    """A pattern of the given length: 2 but for the positions (from 0) listed, which have their state."""
    known = F.map_from_arrays(positions, states)
    return F.when(length > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(2)).cast("string")), "")).otherwise("")


def call_cpgs(sequence: Column, likelihoods: Column, high: int = 128, low: int = 128) -> Column:
    """States of a read's CG sites in order from modification likelihoods: above high 1, up to low 0, else 2; missing 2."""
    sites = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(sequence) - 1, F.lit(1))), lambda i: F.when(F.substring(sequence, i, F.lit(2)) == "CG", i)), lambda i: i.isNotNull())
    return F.transform(sites, lambda _, k: F.when(F.try_element_at(likelihoods, k + 1).isNull(), 2).when(F.try_element_at(likelihoods, k + 1) > high, 1).when(F.try_element_at(likelihoods, k + 1) <= low, 0).otherwise(2))


def call_bisulfite(reference: Column, read: Column, reverse: bool) -> Column:
    """Pattern of a converted read against its reference: at CG, C is 1 and T is 0; on the reverse strand the next base, G is 1 and A is 0.

    The reference is cut at its CGs, so a step is a stretch between two of them, not a position. An empty reference is one unknown position.
    """
    yes, no = ("G", "A") if reverse else ("C", "T")
    unknown = lambda n: F.repeat(F.lit("2"), n)

    def step(acc: Column, part: Column) -> Column:
        at = F.length(acc) + 1  # where the CG before this part is
        base = F.substring(read, at + 1 if reverse else at, F.lit(1))
        return F.concat(acc, F.when(base == yes, "12").when(base == no, "02").otherwise("22"), unknown(F.length(part)))

    parts = F.split(reference, "CG")
    called = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), unknown(F.length(F.element_at(parts, 1))), step)
    return F.when(F.length(reference) == 0, "2").otherwise(called)


def aligned_sequence(sequence: Column, cigar: Column) -> Column:
    """Read bases on the reference: M, = and X copy, I and S skip, D and N give Ns, H and P nothing."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHPX=])"), 1)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, op: Column) -> Column:
        n, kind = F.regexp_extract(op, r"(\d+)", 1).cast("int"), F.right(op, F.lit(1))
        copied = F.when(kind.isin("M", "=", "X"), F.substring(sequence, acc["at"], n)).when(kind.isin("D", "N"), F.repeat(F.lit("N"), n)).otherwise("")
        return F.struct(F.concat(acc["out"], copied).alias("out"), (acc["at"] + F.when(kind.isin("M", "=", "X", "I", "S"), n).otherwise(0)).alias("at"))

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def strand_reversed(flag: Column) -> Column:
    """True if the read stems from the reverse strand: reversed, or not, for the second of a pair."""
    bit = lambda k: flag.bitwiseAND(k) != 0
    return bit(16) != (bit(1) & bit(128))


def passes_flags(flag: Column, mapq: Column, require: int = 3, exclude: int = 1796, least: int = 10) -> Column:
    return (flag.bitwiseAND(require) == require) & (flag.bitwiseAND(exclude) == 0) & (mapq >= least)


def contig_alias(name: Column, known: Column) -> Column:
    """The contig as the file names it: as it is, with or without chr, else null."""
    other = F.when(name.startswith("chr"), F.substring(name, 4, 1 << 20)).otherwise(F.concat(F.lit("chr"), name))
    return F.when(F.array_contains(known, name), name).when(F.array_contains(known, other), other)


def add_modifications(m: Column, h: Column) -> Column:
    """Sum of two likelihood arrays, 255 at most; the first alone if lengths differ."""
    return F.when(F.size(m) == F.size(h), F.zip_with(m, h, lambda a, b: F.least(a + b, F.lit(255)))).otherwise(m)


def modification_calls(tag: Column, code: str = "C+m") -> Column:
    """Skip counts of one modification in an MM-like tag ``C+m?,1,0;C+h,2;``; the last entry of the code wins."""
    entries = F.filter(F.split(tag, ";"), lambda x: x.startswith(code))
    body = F.try_element_at(entries, F.lit(-1))
    return F.coalesce(F.transform(F.filter(F.split(body, ","), lambda x, i: i > 0), lambda x: x.cast("int")), F.array().cast("array<int>"))


def modification_offset(tag: Column, code: str = "C+m") -> Column:
    """Likelihoods that stand before those of the code's last entry."""
    entries = F.filter(F.split(tag, ";"), lambda x: x != "")
    last = F.array_max(F.transform(entries, lambda x, i: F.when(x.startswith(code), i)))
    return F.aggregate(F.slice(entries, 1, F.greatest(last, F.lit(0))), F.lit(0), lambda n, x: n + F.size(F.split(x, ",")) - 1)


def modification_values(tag: Column, likelihoods: Column, code: str = "C+m") -> Column:
    """Likelihoods of the code's last entry, in order; fewer if the array ends before, none without the code."""
    first, n = modification_offset(tag, code), F.size(modification_calls(tag, code))
    return F.when(n > 0, F.slice(likelihoods, first + 1, n)).otherwise(F.slice(likelihoods, 1, 0))


def windows(length: Column, width: int) -> Column:
    """Starts (from 0) of windows side by side."""
    return F.when(length > 0, F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(width))).otherwise(F.array().cast("array<int>"))


def sliding_windows(length: Column, width: int, step: int) -> Column:
    """Starts of windows that overlap; if the last does not end at the end, one more that does."""
    tail = F.greatest(length - width, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), tail, F.lit(step)), F.array(tail)))


def merge_lists(a: Column, b: Column) -> Column:
    """Sorted union of two comma lists."""
    both = F.array_union(F.split(a, ","), F.split(b, ","))
    return F.array_join(F.array_sort(F.filter(both, lambda x: x != "")), ",")


def base_codes(sequence: Column, pattern: Column) -> Column:
    """Codes of bases: A, T, C, G are 1 to 4, methylated ones 5, others 0."""
    plain = F.split(F.translate(F.regexp_replace(sequence, "[^ATCG]", "0"), "ATCG", "1234"), "")
    return F.zip_with(plain, F.split(pattern, ""), lambda b, m: F.when(m == "1", 5).otherwise(b.cast("int")))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - common / all of two arrays; two empty ones have distance 0."""
    together = F.size(F.array_union(a, b))
    return F.when(together == 0, 0.0).otherwise(1 - F.size(F.array_intersect(a, b)) / together)


def contains_all(whole: Column, part: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def best_window(rows: DataFrame, keys: list[str], pattern: str, width: int) -> DataFrame:
    """(keys, start, known): the window with most known positions, the first of equals; rows without a known position go.

    A row stays one row: its windows are numbers of known positions and starts, the largest is kept, and numbers are combined by hash, not sorted.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(pattern) - width, F.lit(0)))
    known = lambda s: F.length(F.replace(F.substring(F.col(pattern), s + 1, F.lit(width)), F.lit("2"), F.lit(""))).cast("long")
    last = (1 << 32) - 1
    own = F.array_max(F.transform(starts, lambda s: known(s) * (last + 1) + (last - s)))  # more known positions first, then the smaller start
    best = rows.select(*keys, own.alias("_b")).groupBy(*keys).agg(F.max("_b").alias("_b")).filter(F.col("_b") > last)
    return best.select(*keys, (last - F.col("_b").bitwiseAND(last)).cast("int").alias("start"), F.shiftright("_b", 32).cast("int").alias("known"))


def lowest_entropy_window(rows: DataFrame, keys: list[str], pattern: str, width: int, least: int = 5, stride: int = 50, factor: float = 0.1) -> DataFrame:
    """(keys, start, known, entropy): the window whose states have least entropy (bits) plus factor / known, the first of equals.

    Only windows with ``least`` known positions count; a read without one has start and known 0 and entropy null. Reads are
    shuffled as they are, and what is sorted by key is a row a read, not one a window.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(pattern) - width, F.lit(0)), F.lit(stride))
    own = [c for c in (pattern,) if c not in keys]

    def counted(s: Column) -> Column:
        part = F.substring(F.col(pattern), s + 1, F.lit(width))
        return F.struct(s.alias("start"), count_of(part, "0").alias("no"), count_of(part, "1").alias("yes"))

    def scored(w: Column) -> Column:
        known = w["no"] + w["yes"]

        def bits(n: Column) -> Column:
            p = F.try_divide(n.cast("double"), known.cast("double"))  # a share of counts, so that windows of mirrored states are equal
            return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

        entropy = bits(w["yes"]) + bits(w["no"])
        return F.when(known >= least, F.struct((entropy + factor / known).alias("score"), w["start"].alias("start"), known.alias("known"), entropy.alias("entropy")))

    score = F.array_min(F.transform(F.transform(starts, counted), scored))
    best = rows.select(*keys, *own).repartition(*keys).groupBy(*keys).agg(F.min(score).alias("_b"))
    return best.select(*keys, F.coalesce("_b.start", F.lit(0)).alias("start"), F.coalesce("_b.known", F.lit(0)).alias("known"), "_b.entropy")


def complete_calls(sequence: Column, likelihoods: Column) -> Column:
    """True if a read has one likelihood for each CG of its forward sequence."""
    return F.size(likelihoods) == F.regexp_count(sequence, F.lit("CG"))


def token_vocabulary(k: int) -> list[str]:
    """Five special entries, then all k-mers in order; an entry's place is its number."""
    words = [""]
    for _ in range(k):
        words = [w + b for w in words for b in "ACGT"]
    return ["<pad>", "<unk>", "<eos>", "<sos>", "<mask>", *words]


def token_numbers(tokens: Column, k: int) -> Column:
    """Places in token_vocabulary(k), computed from the letters; 1 for what is no k-mer of A, C, G and T."""
    place = lambda t: F.aggregate(F.split(F.translate(t, "ACGT", "0123"), ""), F.lit(0), lambda n, c: n * 4 + c.cast("int")) + 5
    return F.transform(tokens, lambda t: F.when(t.rlike(f"^[ACGT]{{{k}}}$"), place(t)).otherwise(1))


def token_rows(rows: DataFrame, keys: list[str], k: int = 3, width: int = 150, step: int = 75) -> DataFrame:
    """(keys, start, tokens, states, ncpgs_marked): overlapping windows of a read's k-mers, each with the state of its middle base.

    rows: keys, input_ids, methylation_ids. K-mers with an N are left out before windows are laid; reads without any other go.

    A read's k-mers and states are made once, bound to a lambda's variable, and its windows are slices of them: as plain columns the optimizer
    would copy their expressions into whatever filter or window uses them.
    """
    ids, own = F.col("input_ids"), F.col("methylation_ids")
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(ids) - (k - 1), F.lit(1))), lambda i: ~F.contains(F.substring(ids, i, F.lit(k)), F.lit("N")) & (F.length(ids) >= k))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def made(places: Column) -> Column:
        tokens = F.transform(places, lambda i: F.substring(ids, i, F.lit(k)))
        states = F.transform(places, lambda i: F.substring(own, i + k // 2, F.lit(1)))
        return F.struct(tokens.alias("t"), states.alias("m"))

    def laid(read: Column) -> Column:
        cut = lambda c, s: F.slice(read[c], s + 1, F.lit(width))
        starts = F.when(F.size(read["t"]) > 0, sliding_windows(F.size(read["t"]), width, step))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), cut("t", s).alias("tokens"), F.array_join(cut("m", s), "").alias("states")))

    # outer, so that no filter on the windows is inferred, which would make them twice
    rows = rows.select(*keys, F.explode_outer(once(once(at, made), laid)).alias("_w")).filter("_w is not null")
    return rows.select(*keys, "_w.start", "_w.tokens", "_w.states", informative(F.col("_w.states")).alias("ncpgs_marked"))


def cg_weight(sequence: Column) -> Column:
    """CGs of a sequence, 1 at least: the weight of a window among those of its read."""
    return F.greatest(F.regexp_count(sequence, F.lit("CG")), F.lit(1))
