"""Mixing sources to target weights, in DataFrame operations only.

Each source's words are packed into blocks of one length (the last one may be shorter): ``block`` words, or
for a source with a small target the part ``FINENESS`` of it, one word at least, so that whole blocks come
within 1 % or one word of any target. The target is turned into a quota of slots, one block each. Output shards of ``shard`` slots draw their source
counts from the multinomial of the quotas: every slot draws by a hash of its number. Draws that exceed a
source's quota are handed to sources that fell short, so the totals meet the quotas exactly. The k-th slot
of a source takes block ``p(k mod blocks)``, where p is a pseudorandom permutation of the source's block
indices (swap-or-not rounds keyed by hashes), and slots join the blocks' documents by index. A quota never
exceeds twice the number of blocks, so no block is taken more than twice.

Scale: a source's words are numbered by chunk (hash classes of each source, ``CHUNKS`` or more: one for each
``CHUNK_ROWS`` rows of the table) and then inside the chunk, so a source that holds most rows is spread over
all tasks; so are the running sums over a source's shards, by runs of ``RUN`` shards. Draws are counted before
they are shuffled; a document meets only its own blocks. The sources themselves are a table of one row each. Every choice hangs on hashes of ids, texts, sources and
the seed, not on partitions: reruns agree. Rows that agree in id, text and source are interchangeable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, n_words, settle, settle_wide

WEIGHTS = (3, 1, 2)
BLOCK = 128
FINENESS = 1 / 250
SHARD = 4096
CHUNKS = 512
CHUNK_ROWS = 1 << 17
RUN = 4096
CELLS = 1024
ROUNDS = 16
INTERNAL = ("text", "rid", "size", "th", "chunk", "upto", "start", "sid", "length", "block", "source_size", "target", "taken", "pieces")
FINE = 1 << 30


@dataclass
class Mix:
    """rows: rid, the rows' columns without text, size, sid, start, length (of the source's blocks); sources: one row each; slots: shard, sid, epoch, block."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sources (source, source_size) with sid, weight and target.

    Water filling: with sources in order of cap over weight, a level is the budget that the capped ones
    leave, per weight of the rest; the first level that its own source can take holds for all from there.
    The table has one row a source.
    """
    by_name, by_ratio = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("ratio", "sid")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("sid") % len(weights) + 1).cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every)["level"])
        .withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
        .select("sid", "source", "source_size", "weight", "target")
    )


def permuted(x: Column, n: Column, key: Column, seed: int) -> Column:
    """A permutation of 0 .. n - 1 for each key: in each round x and its mirror image (k - x mod n) swap or not by a hash of the larger one."""

    def step(at: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r, F.lit(seed)), n) - at, n)
        return F.when(F.xxhash64(key, r, F.greatest(at, mirror), F.lit(~seed)) % 2 == 0, mirror).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block: int = BLOCK, shard: int = SHARD, seed: int = 11) -> Mix:
    """The mix of docs (doc_id, text, source, others).

    Null texts have size 0, null is a source of its own (the last), and repeated rows each count. Sources
    without words and empty tables give no slots. Columns of docs with the names of the mix's own are left out.
    A text of any length is one row; its words lie in as many blocks as they fill.
    """
    other = [c for c in docs.columns if c not in INTERNAL]
    sized = settle(docs.select(*other, n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th")).withColumn("rid", F.monotonically_increasing_id()))
    return _mix(sized, weights, share, cap, block, shard, seed)


def _mix(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float, block: int, shard: int, seed: int) -> Mix:
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") * F.lit(FINENESS)))).cast("long")
    sources = sources.withColumn("length", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("length")).cast("long")).withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = settle(sources.coalesce(1))

    # where each document's words begin in its source's stream
    spread = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size", "th"), F.lit(max(CHUNKS, sized.count() // CHUNK_ROWS))).cast("int"))
    first = Window.partitionBy("source").orderBy("chunk")
    chunks = spread.groupBy("source", "chunk").agg(F.sum("size").alias("words")).withColumn("base", F.sum("words").over(first) - F.col("words"))
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", "th", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    a, b = spread.withColumn("upto", F.sum("size").over(inside)).alias("a"), chunks.alias("b")
    rows = (
        a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.chunk") == F.col("b.chunk")))
        .select("a.*", (F.col("b.base") + F.col("a.upto") - F.col("a.size")).alias("start")).drop("chunk", "upto").alias("r")
        .join(sources.select("sid", "source", "length").alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("r.*", "s.sid", "s.length")
    )
    return Mix(rows, sources, slots(sources, shard, seed))


def running(counts: DataFrame, run: int = RUN) -> DataFrame:
    """counts (shard, sid, n) with ``upto``: the sum of n over a source's shards up to this one, by runs of shards and then inside each."""
    marked = counts.withColumn("run", F.expr(f"shard div {run}"))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    bases = marked.groupBy("sid", "run").agg(F.sum("n").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    inside = Window.partitionBy("sid", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = marked.withColumn("own", F.sum("n").over(inside))
    return own.join(bases, ["sid", "run"]).select("shard", "sid", "n", (F.col("base") + F.col("own")).alias("upto"))


def slots(sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, sid, epoch, block) of every slot of the output."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    ordered = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = sources.filter("slots > 0").withColumn("hi", F.sum("slots").over(ordered)).withColumn("lo", F.col("hi") - F.col("slots"))
    # ranges of the sources on a fine grid, cut at the cells of a coarse one: a draw looks up its cell by equality
    scale = lambda c: F.floor(F.col(c) * F.lit(float(FINE)) / F.lit(float(max(total, 1))))
    wide = FINE // CELLS
    grid = (
        grid.select("sid", scale("lo").alias("lo"), F.when(F.col("hi") == total, F.lit(FINE)).otherwise(scale("hi")).alias("hi"))
        .filter("lo < hi")
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / wide), F.floor((F.col("hi") - 1) / wide))))
    )
    drawn = (
        spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total >> 22))
        .select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(FINE)).alias("u"))
        .withColumn("cell", F.expr(f"u div {wide}"))
        .join(grid, "cell")
        .filter("lo <= u and u < hi")
        .groupBy("shard", "sid").agg(F.count("*").alias("n"))
    )
    drawn = settle(running(settle(drawn)))
    quota = sources.select("sid", F.col("slots").alias("quota"))
    held = drawn.join(quota, "sid").withColumn("first", F.col("upto") - F.col("n")).withColumn("keep", F.least("n", F.greatest(F.lit(0), F.col("quota") - F.col("first"))))
    kept = held.filter("keep > 0").select("shard", "sid", "first", "keep")
    # what exceeds a quota goes, one by one, to the sources that fell short: about the square root of the slots
    excess = held.filter("keep < n").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("keep")))).select("shard", F.row_number().over(Window.orderBy("shard", "sid", "i")).alias("e"))
    got = drawn.groupBy("sid").agg(F.sum("n").alias("got"))
    short = (
        quota.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < quota")
        .withColumn("k", F.explode(F.sequence(F.col("got"), F.col("quota") - 1)))
        .select("sid", "k", F.row_number().over(Window.orderBy(F.xxhash64("sid", "k", F.lit(seed)), "sid", "k")).alias("e"))
    )
    late = excess.join(short, "e").select("shard", "sid", F.col("k").alias("first"), F.lit(1).cast("long").alias("keep"))
    # dealt by shard before the runs become slots: otherwise a source's slots all come from the task of its window; joined before it, too,
    # since Spark takes the slots to be as few as the runs and would send them through the driver
    return (
        kept.unionByName(late)
        .join(sources.select("sid", "blocks"), "sid")
        .repartition(max(spark.sparkContext.defaultParallelism, total >> 20), "shard")
        .withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("keep") - 1)))
        .select("shard", "sid", F.expr("k div blocks").alias("epoch"), permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.col("sid"), seed).alias("block"))
    )


def spans(made: Mix) -> DataFrame:
    """(rid, sid, block, at, length) of every piece of a document in a block: words at .. at + length - 1."""
    b = F.col("length")
    return (
        made.rows.filter("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr("start div length"), F.expr("(start + size - 1) div length"))))
        .withColumn("at", F.greatest(F.lit(0), F.col("block") * b - F.col("start")))
        .select("rid", "sid", "block", "at", (F.least(F.col("size"), (F.col("block") + 1) * b - F.col("start")) - F.col("at")).alias("length"))
    )


def taken(made: Mix) -> DataFrame:
    """rows with source_size, target and taken: the words that the mix takes of each, repeats counted."""
    times = made.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    per_row = spans(made).join(times.hint("merge"), ["sid", "block"]).groupBy("rid").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))
    return (
        made.rows.join(per_row, "rid", "left")
        .join(made.sources.select("sid", "source_size", "target"), "sid")
        .withColumn("taken", F.coalesce("taken", F.lit(0)))
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: for each epoch a row of each document that the mix takes words of, with the taken words.

    A document that an epoch takes whole keeps its text; of others the taken words stay, in order, one
    space between. Columns are those of docs but the mix's own; n_chars, if there, is set anew. Null, empty and
    blank texts have no words and give no rows; repeated rows and null ids each count; an empty table gives none.
    """
    names = [c for c in docs.columns if c == "text" or c not in INTERNAL]
    docs = docs.select(*names)
    numbered = settle_wide(docs.withColumn("rid", F.monotonically_increasing_id()))
    sized = settle(numbered.select("rid", "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("th")))
    made = _mix(sized, **({"weights": WEIGHTS, "share": 1.5, "cap": 2.0, "block": BLOCK, "shard": SHARD, "seed": 11} | how))
    pieces = (
        spans(made).join(made.slots.hint("merge"), ["sid", "block"])  # slots look as few as their runs
        .groupBy("rid", "epoch").agg(F.array_sort(F.collect_list(F.struct("at", "length"))).alias("pieces"), F.sum("length").alias("words"))
    )
    pieces = pieces.join(made.rows.select("rid", "size"), "rid").withColumn("pieces", F.when(F.col("words") < F.col("size"), F.col("pieces")))
    # a text starts with white space or not; without it the split has no empty first word
    split = F.array(F.split(F.regexp_replace("text", f"^{SPACE}", ""), SPACE))  # one array of words: a lambda's variable, so a text is split once
    chosen = F.transform(split, lambda words: F.flatten(F.transform("pieces", lambda p: F.slice(words, (p["at"] + 1).cast("int"), p["length"].cast("int")))))
    cut = F.array_join(chosen[0], " ")
    out = numbered.join(pieces.select("rid", "pieces"), "rid").withColumn("text", F.when(F.col("pieces").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*names)
