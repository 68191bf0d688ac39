"""All queries of the read-level operators and the SQL that they are held against.

The queries run over whole tables: reads are a view of lineitem, regions one of part (sources.tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import patterns, vectors
from .operators import atlases, evaluation, intervals, labelling, mixtures, predictions, simulation
from .operators import reads as read_ops
from .session import by_region, settled
from .sources.tables import CLASSES, reads, regions, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

READS = """
reads AS (
  SELECT *, concat('chr', (1 + l_suppkey % 5)::VARCHAR) AS chromosome, l_partkey * 16 + l_linenumber AS read_start, l_partkey * 16 + l_linenumber + 31 AS read_end,
         translate(md5(concat('q', read_name)), '0123456789abcdef', 'ACGTACGTACGTACGT') AS input_ids,
         translate(md5(read_name), '0123456789abcdef', '0000111122222222') AS methylation_ids,
         (l_suppkey % 7)::INT AS original_label, concat('f', (l_orderkey % 9)::VARCHAR) AS file
  FROM (SELECT *, concat_ws('|', l_orderkey::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_linenumber::VARCHAR) AS read_name FROM lineitem)
), regions AS (
  SELECT concat('chr', (1 + p_partkey % 5)::VARCHAR) AS chr, p_partkey * 16 + 1 AS start_, p_partkey * 16 + 8 + p_size AS end_, concat('r', p_partkey::VARCHAR) AS name,
         (p_size % 7)::INT AS target_label, CASE WHEN p_size % 2 = 0 THEN 'U' ELSE 'M' END AS direction
  FROM part
)"""
PREPARED = READS + """, met AS (
  SELECT r.*, g.* FROM reads r JOIN regions g ON r.chromosome = g.chr AND r.read_start < g.end_ AND r.read_end >= g.start_ - 1
), trimmed AS (
  SELECT read_name, chromosome, name, target_label, direction, original_label, file, greatest(read_start, start_ - 1) AS read_start, least(read_end, end_ - 1) AS read_end,
         substr(input_ids, (greatest(read_start, start_ - 1) - read_start + 1)::INT, (least(read_end, end_ - 1) - greatest(read_start, start_ - 1) + 1)::INT) AS input_ids,
         substr(methylation_ids, (greatest(read_start, start_ - 1) - read_start + 1)::INT, (least(read_end, end_ - 1) - greatest(read_start, start_ - 1) + 1)::INT) AS methylation_ids
  FROM met
), counted AS (
  SELECT *, length(methylation_ids) - length(replace(methylation_ids, '1', '')) AS M, length(methylation_ids) - length(replace(methylation_ids, '0', '')) AS U FROM trimmed
), prepared AS (
  SELECT *, M + U AS NCPGS, CASE WHEN M + U > 0 THEN M / (M + U)::DOUBLE END AS M_rate,
         CASE WHEN M + U > 0 AND M / (M + U)::DOUBLE >= 0.75 THEN 'M' WHEN M + U > 0 AND M / (M + U)::DOUBLE <= 0.25 THEN 'U' ELSE 'X' END AS state
  FROM counted
)"""
POSITIONS = PREPARED + """, chars AS (
  SELECT *, unnest(range(1, length(methylation_ids) + 1)) AS i FROM prepared
), positions AS (
  SELECT *, read_start + i - 1 AS pos, substr(methylation_ids, i::INT, 1)::INT AS state_ FROM chars WHERE substr(methylation_ids, i::INT, 1) IN ('0', '1')
)"""
SIGNED = POSITIONS + """, signed AS (
  SELECT read_name, name, target_label, original_label, M, U, NCPGS, read_start, methylation_ids, coalesce(sig, '') AS signature
  FROM (SELECT *, row_number() OVER () AS rid FROM prepared) p
  LEFT JOIN (SELECT read_start AS rs, methylation_ids AS mp, string_agg(pos::VARCHAR || ':' || state_::VARCHAR, ',' ORDER BY pos) AS sig
             FROM (SELECT DISTINCT read_start, methylation_ids, pos, state_ FROM positions) GROUP BY ALL) q
  ON p.read_start = q.rs AND p.methylation_ids = q.mp
)"""
PREDICTED = PREPARED + """, predicted AS (
  SELECT *, (M + 1) / (NCPGS + 3)::DOUBLE AS prediction_0, (U + 1) / (NCPGS + 3)::DOUBLE AS prediction_1, 1 / (NCPGS + 3)::DOUBLE AS prediction_2 FROM prepared
)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ops.prepare(reads(spark, sf_dir), regions(spark, sf_dir))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.with_signature(prepared(spark, sf_dir))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("NCPGS") + 3
    return prepared(spark, sf_dir).select("*", ((F.col("M") + 1) / n).alias("prediction_0"), ((F.col("U") + 1) / n).alias("prediction_1"), (1 / n).alias("prediction_2"))


# --- reads and regions -------------------------------------------------------------------------


@query(f"WITH {READS} SELECT read_name, M::INT AS M, U::INT AS U, (M + U)::INT AS NCPGS, round(CASE WHEN M + U > 0 THEN M / (M + U)::DOUBLE END, 6) AS M_rate, CASE WHEN M + U > 0 AND M / (M + U)::DOUBLE >= 0.75 THEN 'M' WHEN M + U > 0 AND M / (M + U)::DOUBLE <= 0.25 THEN 'U' ELSE 'X' END AS state FROM (SELECT read_name, length(methylation_ids) - length(replace(methylation_ids, '1', '')) AS M, length(methylation_ids) - length(replace(methylation_ids, '0', '')) AS U FROM reads)")
def pattern_states(spark, sf_dir):
    """Counts, rate and state of every read."""
    rows = read_ops.annotate(reads(spark, sf_dir))
    return rounded(rows.select("read_name", "M", "U", "NCPGS", "M_rate", "state"))


@query(f"WITH {PREPARED} SELECT read_name, name, start_ AS region_start, end_ AS region_end, original_label FROM met")
def read_region_overlap(spark, sf_dir):
    """Every pair of read and region that meet."""
    return intervals.overlap(reads(spark, sf_dir), regions(spark, sf_dir)).select("read_name", "name", "region_start", "region_end", "original_label")


@query(f"WITH {PREPARED} SELECT read_name, name, read_start, read_end, input_ids, methylation_ids FROM trimmed")
def trimmed_reads(spark, sf_dir):
    """Coordinates and strings cut to the region."""
    return read_ops.trim(intervals.overlap(reads(spark, sf_dir), regions(spark, sf_dir))).select("read_name", "name", "read_start", "read_end", "input_ids", "methylation_ids")


@query(f"WITH {PREPARED}, b AS (SELECT *, CASE WHEN original_label = target_label THEN original_label ELSE 7 END AS back FROM prepared) SELECT read_name, name, M::INT AS M, U::INT AS U, state, (original_label = target_label)::INT AS hard, back::INT AS with_background, {', '.join(f'round((back = {k})::INT * 0.9 + 0.0125, 6)::DOUBLE AS smoothed_{k}' for k in range(8))} FROM b")
def hard_labels(spark, sf_dir):
    """Prepared reads with hard, background and smoothed labels, whole vectors."""
    a, b = F.col("original_label"), F.col("target_label")
    rows = prepared(spark, sf_dir).withColumn("smoothed", read_ops.smoothed_with_background(a, b, CLASSES))
    return rounded(rows.select("read_name", "name", "M", "U", "state", read_ops.hard_binary(a, b).alias("hard"), read_ops.hard_with_background(a, b, CLASSES).cast("int").alias("with_background"), *[F.col("smoothed")[k].alias(f"smoothed_{k}") for k in range(CLASSES + 1)]))


@query(f"""WITH {PREPARED}, f AS (SELECT name, direction, original_label, round(count(*) FILTER (WHERE state = direction) / count(*)::DOUBLE, 3) AS x FROM prepared WHERE NCPGS >= 4 GROUP BY ALL)
SELECT name, direction, {', '.join(f'max(x) FILTER (WHERE original_label = {k}) AS ct_{k}' for k in range(CLASSES))} FROM f GROUP BY ALL""")
def uxm_atlas(spark, sf_dir):
    """AG9: fraction of reads in the region's direction by region and cell type."""
    return atlases.uxm_atlas(prepared(spark, sf_dir), CLASSES)


@query(f"WITH {PREPARED} SELECT name, direction, original_label, count(*) FILTER (WHERE state = direction) AS matching, count(*) AS total, round(count(*) FILTER (WHERE state = direction) / count(*)::DOUBLE, 3) AS fraction FROM prepared WHERE NCPGS >= 4 GROUP BY ALL")
def uxm_fractions(spark, sf_dir):
    """AG9, F5, J6: the long form of the atlas."""
    return atlases.uxm_fractions(prepared(spark, sf_dir))


@query(f"WITH {POSITIONS} SELECT chromosome, name, pos AS start, pos + 1 AS \"end\", original_label, sum(state_)::BIGINT AS meth, count(*) AS cov FROM positions GROUP BY ALL")
def cpg_counts(spark, sf_dir):
    """AG10, TV7: methylated and all reads by position and cell type."""
    return atlases.cpg_counts(prepared(spark, sf_dir))


@query(f"WITH {POSITIONS} SELECT chromosome, name, pos AS start, pos + 1 AS \"end\", {', '.join(f'coalesce(sum(state_) FILTER (WHERE original_label = {k}), 0)::BIGINT AS \"{k}_meth\", count(*) FILTER (WHERE original_label = {k}) AS \"{k}_cov\"' for k in range(CLASSES))} FROM positions GROUP BY ALL")
def cpg_atlas(spark, sf_dir):
    """AG10, J8: the wide count atlas."""
    return atlases.cpg_atlas(prepared(spark, sf_dir), CLASSES)


@query(f"WITH {POSITIONS} SELECT name, min(chromosome) AS chr, min(pos) + 1 AS start, max(pos) + 1 AS \"end\", count(DISTINCT pos) AS n_cpgs FROM positions GROUP BY name")
def atlas_regions(spark, sf_dir):
    """SC11: regions derived from a count atlas."""
    return atlases.atlas_regions(atlases.cpg_counts(prepared(spark, sf_dir)))


@query(f"WITH {PREPARED} SELECT name, count(*) FILTER (WHERE state = 'M') AS M, count(*) FILTER (WHERE state = 'U') AS U, count(*) FILTER (WHERE state = 'X') AS X, count(*) AS count, round(count(*) FILTER (WHERE state = 'U') / count(*)::DOUBLE, 6) AS sf FROM prepared WHERE NCPGS >= 4 GROUP BY name")
def sample_states(spark, sf_dir):
    """AG11: a sample's states by region."""
    return rounded(atlases.sample_states(prepared(spark, sf_dir)))


@query(f"""WITH {POSITIONS}, a AS (SELECT DISTINCT name, pos FROM positions), s AS (SELECT name, pos, sum(state_)::BIGINT AS meth, count(*) AS cov FROM positions WHERE file = 'f0' GROUP BY ALL)
SELECT name, pos, coalesce(meth, 0) AS meth, coalesce(cov, 0) AS cov, round(meth / cov::DOUBLE, 6) AS beta FROM a LEFT JOIN s USING (name, pos)""")
def sample_betas(spark, sf_dir):
    """AG12-AG14, J20: counts and betas of one sample at all atlas positions."""
    rows = prepared(spark, sf_dir)
    return rounded(atlases.sample_betas(rows.filter("file = 'f0'"), atlases.positions(rows, "name")))


@query(f"WITH {READS} SELECT chromosome, min(read_start) AS start, max(read_end) AS \"end\" FROM (SELECT *, sum(fresh) OVER (PARTITION BY chromosome ORDER BY read_start, read_end ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT chromosome, read_start, read_end, CASE WHEN read_start <= max(read_end) OVER (PARTITION BY chromosome ORDER BY read_start, read_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM reads)) GROUP BY chromosome, island")
def merged_reads(spark, sf_dir):
    """W10, TV8: unions of overlapping reads."""
    return intervals.merge(reads(spark, sf_dir).select("chromosome", F.col("read_start").alias("start"), F.col("read_end").alias("end")), ["chromosome"])


@query(f"WITH {READS}, p AS (SELECT DISTINCT chromosome, unnest(range(read_start, read_end + 1)) AS pos FROM reads) SELECT chromosome, count(*) AS positions FROM p GROUP BY chromosome")
def covered_positions(spark, sf_dir):
    """AG20: distinct covered positions."""
    return intervals.covered(reads(spark, sf_dir), ["chromosome"], "read_start", "read_end")


@query(f"WITH {READS} SELECT name, least(((row_number() OVER (ORDER BY chr, start_, end_, name) - 1) * 16) // (SELECT count(*) FROM regions), 15)::INT AS region_bucket FROM regions")
def region_buckets(spark, sf_dir):
    """Near-equal runs of regions."""
    return intervals.buckets(regions(spark, sf_dir), 16).select("name", "region_bucket")


@query(f"WITH {READS} SELECT name, (dense_rank() OVER (ORDER BY chr, start_, end_) - 1)::INT AS locus, ((dense_rank() OVER (ORDER BY chr, start_, end_) - 1) // 25)::INT AS chunk FROM regions")
def region_loci(spark, sf_dir):
    """W3, J24, TV10: numbered places, 25 a chunk."""
    return intervals.loci(regions(spark, sf_dir), 25).select("name", F.col("locus").cast("int"), "chunk")


@query("WITH c AS (SELECT 'chr' || n_nationkey::VARCHAR AS contig, n_nationkey * 350000 + 17 AS len FROM nation) SELECT contig, s AS start, least(s + 1000000, len) AS \"end\" FROM (SELECT contig, len, unnest(range(0, len, 1000000)) AS s FROM c)")
def genomic_chunks(spark, sf_dir):
    """TV9: chunks of a million positions."""
    contigs = table(spark, sf_dir, "nation").select(F.concat(F.lit("chr"), F.col("n_nationkey").cast("string")).alias("contig"), (F.col("n_nationkey") * 350000 + 17).cast("long").alias("length"))
    return intervals.chunks(contigs, 1_000_000)


@query(f"WITH {PREPARED} SELECT name, methylation_ids, original_label, count(*) AS read_count, min(read_name) AS read_name FROM prepared GROUP BY name, methylation_ids, original_label")
def deduplicated_reads(spark, sf_dir):
    """AG8, W1, U2: equal reads once, with their number."""
    return read_ops.deduplicate(prepared(spark, sf_dir), ["name", "methylation_ids", "original_label"], {"read_name": "read_name"})


@query("SELECT text, lang, count(*) AS read_count, min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def deduplicated_documents(spark, sf_dir):
    """AG8 on texts: nulls and long keys."""
    return read_ops.deduplicate(table(spark, sf_dir, "documents"), ["text", "lang"], {"doc_id": "doc_id"})


@query(f"WITH {READS} SELECT file, original_label, count(*) AS n_reads FROM reads GROUP BY ALL")
def split_counts(spark, sf_dir):
    """SK2, AG17: reads by file and label."""
    return read_ops.split_counts(reads(spark, sf_dir))


@query(f"WITH {READS} SELECT original_label, file, split, count(*) AS n FROM (SELECT *, CASE WHEN k <= round_even(n * 0.7, 0) THEN 'train' WHEN k <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'valid' ELSE 'test' END AS split FROM (SELECT original_label, file, row_number() OVER (PARTITION BY original_label ORDER BY md5('42|' || read_name), read_name) AS k, count(*) OVER (PARTITION BY original_label) AS n FROM reads)) GROUP BY ALL")
def read_level_split(spark, sf_dir):
    """Seeded split of reads with half-even sizes."""
    rows = read_ops.read_level_split(reads(spark, sf_dir), ["original_label"], ["read_name"])
    return rows.groupBy("original_label", "file", "split").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {READS}, c AS (SELECT original_label, file, count(*) AS n FROM reads WHERE original_label <> 2 OR file <= 'f1' GROUP BY ALL), few AS (SELECT * FROM c WHERE original_label <> 3 OR file = 'f4'),
f AS (SELECT *, row_number() OVER (PARTITION BY original_label ORDER BY n DESC, file) AS i, count(*) OVER (PARTITION BY original_label) AS m, (sum(n) OVER (PARTITION BY original_label))::DOUBLE AS total FROM few),
g AS (
  SELECT original_label, 0::BIGINT AS i, NULL::VARCHAR AS split, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS t, 0 AS ca, 0 AS cb, 0 AS ct FROM f WHERE i = 1 AND m >= 3
  UNION ALL
  SELECT original_label, i, s, a + CASE WHEN s = 'train' THEN n ELSE 0 END, b + CASE WHEN s = 'valid' THEN n ELSE 0 END, t + CASE WHEN s = 'test' THEN n ELSE 0 END, ca + (s = 'train')::INT, cb + (s = 'valid')::INT, ct + (s = 'test')::INT
  FROM (SELECT g.original_label, f.i, f.n, a, b, t, ca, cb, ct, CASE WHEN (ca = 0)::INT + (cb = 0)::INT + (ct = 0)::INT >= m - g.i THEN CASE WHEN ca = 0 THEN 'train' WHEN cb = 0 THEN 'valid' ELSE 'test' END
    WHEN total * 0.7 - a >= total * 0.15 - b AND total * 0.7 - a >= total * 0.15 - t THEN 'train' WHEN total * 0.15 - b >= total * 0.15 - t THEN 'valid' ELSE 'test' END AS s FROM g JOIN f ON f.original_label = g.original_label AND f.i = g.i + 1)
)
SELECT f.original_label, f.file, CASE WHEN m >= 3 THEN g.split WHEN m = 2 AND f.i = 1 THEN 'train' ELSE 'by_read' END AS split, CASE WHEN m = 1 THEN 0.7 WHEN m = 2 AND f.i = 2 THEN 0.0 END::DOUBLE AS train_share,
  round(CASE WHEN m = 1 THEN 0.15 WHEN m = 2 AND f.i = 2 THEN 0.5 END, 6)::DOUBLE AS valid_share
FROM f LEFT JOIN g ON f.original_label = g.original_label AND f.i = g.i""")
def split_plan(spark, sf_dir):
    """Split of files by label; one label has two files and one a single file."""
    counts = read_ops.split_counts(reads(spark, sf_dir).filter("(original_label <> 2 or file <= 'f1') and (original_label <> 3 or file = 'f4')"))
    return rounded(read_ops.plan_splits(counts))


@query(f"""WITH {READS}, remap AS (SELECT * FROM (VALUES (1, 0), (3, 1), (5, 2)) v(o, n))
SELECT read_name, name, a.n AS original_label, b.n AS target_label FROM ({'SELECT r.read_name, g.name, r.original_label, g.target_label FROM reads r JOIN regions g ON r.chromosome = g.chr AND r.read_start < g.end_ AND r.read_end >= g.start_ - 1'}) p JOIN remap a ON p.original_label = a.o JOIN remap b ON p.target_label = b.o""")
def label_subset(spark, sf_dir):
    """a subset of the labels with new codes."""
    remap = spark.createDataFrame([(1, 0), (3, 1), (5, 2)], "old int, new int")
    return read_ops.keep_labels(intervals.overlap(reads(spark, sf_dir), regions(spark, sf_dir)), remap).select("read_name", "name", "original_label", "target_label")


@query(f"WITH {PREPARED} SELECT read_name, name, NCPGS::INT AS NCPGS FROM prepared WHERE NCPGS >= 5 AND name IN (SELECT 'r' || p_partkey::VARCHAR FROM part WHERE p_size <= 20)")
def filtered_reads(spark, sf_dir):
    """F1, F2, F4, SC12: least pattern length and membership of a region list."""
    few = table(spark, sf_dir, "part").filter("p_size <= 20").select(F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("name"))
    return prepared(spark, sf_dir).filter("NCPGS >= 5").join(by_region(few), "name", "left_semi").select("read_name", "name", "NCPGS")


@query("""WITH pairs AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 1000) * 10 + l_linenumber * 8 AS s, substr(translate(md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR), '0123456789abcdef', '0000111122222222'), 1, 12) AS p FROM lineitem),
n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, p) AS k FROM pairs),
two AS (SELECT a.l_orderkey, a.s, a.p, b.s AS s2, b.p AS p2, unnest(range(a.s, greatest(a.s + 11, b.s + 11) + 1)) AS i FROM n a JOIN n b USING (l_orderkey) WHERE a.n = 2 AND a.k = 1 AND b.k = 2),
st AS (SELECT l_orderkey, s, i, CASE WHEN i <= s + 11 THEN substr(p, (i - s + 1)::INT, 1) ELSE '2' END AS x, CASE WHEN i >= s2 AND i <= s2 + 11 THEN substr(p2, (i - s2 + 1)::INT, 1) ELSE '2' END AS y FROM two)
SELECT l_orderkey, s AS read_start, s + 11 AS read_end, p AS methylation_ids FROM n WHERE n <> 2
UNION ALL SELECT l_orderkey, s, max(i), string_agg(CASE WHEN x = y THEN x WHEN x = '2' THEN y WHEN y = '2' THEN x ELSE '2' END, '' ORDER BY i) FROM st GROUP BY l_orderkey, s""")
def merged_mates(spark, sf_dir):
    """Pairs of reads as one."""
    items = table(spark, sf_dir, "lineitem")
    start = (F.col("l_orderkey") % 1000) * 10 + F.col("l_linenumber") * 8
    p = F.substring(F.translate(F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))), "0123456789abcdef", "0000111122222222"), 1, 12)
    mates = items.select("l_orderkey", start.alias("read_start"), (start + 11).alias("read_end"), p.alias("methylation_ids"))
    return read_ops.merge_mates(mates, ["l_orderkey"])


# --- expressions over patterns and sequences ---------------------------------------------------


@query(f"WITH {SIGNED} SELECT read_name, name, signature FROM signed")
def signatures(spark, sf_dir):
    """Positions and states of every prepared read."""
    return signed(spark, sf_dir).select("read_name", "name", "signature")


@query(f"WITH {READS} SELECT read_name, translate(input_ids, 'ATCG', 'TAGC') AS complement, list_aggregate([substr(input_ids, i, 3) FOR i IN range(1, length(input_ids) - 1)], 'string_agg', ' ') AS kmers, CASE WHEN contains(methylation_ids, '1') THEN 1 WHEN contains(methylation_ids, '0') THEN 0 ELSE 2 END AS state FROM reads")
def kmer_strings(spark, sf_dir):
    """K-mers, complement and one state for a list."""
    rows = reads(spark, sf_dir)
    states = F.transform(F.split("methylation_ids", ""), lambda x: x.cast("int"))
    return rows.select("read_name", patterns.complement(F.col("input_ids")).alias("complement"), patterns.kmers(F.col("input_ids"), 3).alias("kmers"), patterns.collapse(states).alias("state"))


@query(f"WITH {PREPARED}, w AS (SELECT read_name, name, read_start, input_ids, methylation_ids, unnest(CASE WHEN length(methylation_ids) > 10 THEN range(0, length(methylation_ids), 10) ELSE [0] END) AS s FROM prepared), c AS (SELECT read_name, name, read_start, substr(input_ids, (s + 1)::INT, 10) AS input_ids, substr(methylation_ids, (s + 1)::INT, 10) AS methylation_ids FROM w) SELECT *, (length(methylation_ids) - length(replace(replace(methylation_ids, '0', ''), '1', '')))::INT AS num_cpgs FROM c")
def split_reads(spark, sf_dir):
    """TV1: reads of more than ten positions in pieces, with their known positions; coordinates stay."""
    return read_ops.split_long(prepared(spark, sf_dir).select("read_name", "name", "read_start", "input_ids", "methylation_ids"), 10)


@query("WITH f AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, s AS start, substr(t, (s + 1)::INT, 300) AS part FROM (SELECT doc_id, t, unnest(range(0, length(t), 300)) AS s FROM f)")
def text_windows(spark, sf_dir):
    """TV1, TV2: windows side by side over whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    cut = docs.withColumn("start", F.explode(patterns.windows(F.length("t"), 300)))
    return cut.select("doc_id", F.col("start").cast("long").alias("start"), F.substring(F.col("t"), F.col("start") + 1, F.lit(300)).alias("part"))


@query(f"WITH {READS} SELECT read_name, s AS start, substr(input_ids, (s + 1)::INT, 12) AS part FROM (SELECT DISTINCT read_name, input_ids, unnest(list_concat(range(0, 21, 5), [20])) AS s FROM (SELECT DISTINCT read_name, input_ids FROM reads))")
def sliding_windows(spark, sf_dir):
    """TV3, TV4: overlapping windows and a last one that ends at the end."""
    rows = reads(spark, sf_dir).select("read_name", "input_ids").distinct()
    cut = rows.withColumn("start", F.explode(patterns.sliding_windows(F.length("input_ids"), 12, 5)))
    return cut.select("read_name", F.col("start").cast("long").alias("start"), F.substring(F.col("input_ids"), F.col("start") + 1, F.lit(12)).alias("part"))


@query(f"WITH {READS}, w AS (SELECT read_name, s, length(regexp_replace(substr(methylation_ids, (s + 1)::INT, 12), '2', '', 'g')) AS n FROM (SELECT DISTINCT read_name, methylation_ids, unnest(range(0, 21)) AS s FROM reads)) SELECT read_name, s AS start, n::INT AS known FROM (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY n DESC, s) AS k FROM w WHERE n > 0) WHERE k = 1")
def best_windows(spark, sf_dir):
    """TV5, TV6: the window with most known positions, the first of equals."""
    rows = reads(spark, sf_dir).select("read_name", "methylation_ids").distinct()
    best = patterns.best_window(rows, ["read_name", "methylation_ids"], "methylation_ids", 12)
    return best.select("read_name", F.col("start").cast("long").alias("start"), "known")


@query("WITH t AS (SELECT doc_id, crc FROM (SELECT doc_id, (doc_id * 7919) % 4096 AS crc FROM documents)) SELECT doc_id, ((crc & 3) = 3 AND (crc & 1796) = 0 AND doc_id % 60 >= 10) AS passes, (((crc & 16) <> 0) <> ((crc & 1) <> 0 AND (crc & 128) <> 0)) AS reversed, CASE WHEN doc_id % 3 = 0 THEN 'chr1' WHEN doc_id % 3 = 1 THEN '2' END AS contig FROM t")
def alignment_flags(spark, sf_dir):
    """Flags, strand of origin and contig names."""
    docs = table(spark, sf_dir, "documents")
    flag = ((F.col("doc_id") * 7919) % 4096).cast("int")
    name = F.when(F.col("doc_id") % 3 == 0, "1").when(F.col("doc_id") % 3 == 1, "chr2").otherwise("chr9")
    return docs.select("doc_id", patterns.passes_flags(flag, F.col("doc_id") % 60).alias("passes"), patterns.strand_reversed(flag).alias("reversed"), patterns.contig_alias(name, F.array(F.lit("chr1"), F.lit("2"))).alias("contig"))


@query(f"WITH {READS}, c AS (SELECT read_name, i, substr(input_ids, i::INT, 2) = 'CG' AS cg, substr(methylation_ids, i::INT, 1) AS here, substr(methylation_ids, i::INT + 1, 1) AS after FROM (SELECT DISTINCT read_name, input_ids, methylation_ids, unnest(range(1, 33)) AS i FROM reads)) SELECT read_name, string_agg(CASE WHEN cg AND here IN ('0', '1') THEN here ELSE '2' END, '' ORDER BY i) AS forward, string_agg(CASE WHEN cg AND after IN ('0', '1') THEN after ELSE '2' END, '' ORDER BY i) AS reverse FROM c GROUP BY read_name")
def bisulfite_calls(spark, sf_dir):
    """Calls of converted reads against a reference, on either strand."""
    rows = reads(spark, sf_dir).select("read_name", "input_ids", "methylation_ids").distinct()
    forward = patterns.call_bisulfite(F.col("input_ids"), F.translate("methylation_ids", "012", "TCN"), reverse=False)
    return rows.select("read_name", forward.alias("forward"), patterns.call_bisulfite(F.col("input_ids"), F.translate("methylation_ids", "012", "AGN"), reverse=True).alias("reverse"))



# --- predictions by region group ---------------------------------------------------------------

_WAVG = "sum(greatest(NCPGS::DOUBLE, 1e-10) * {c}) / sum(greatest(NCPGS::DOUBLE, 1e-10))"


@query(f"WITH {PREDICTED} SELECT target_label, {', '.join(f'round(avg({c}), 6) AS {c}_avg, round({_WAVG.format(c=c)}, 6) AS {c}_wavg' for c in ('prediction_0', 'prediction_1', 'prediction_2'))}, round(sum(greatest(NCPGS::DOUBLE, 1e-10)), 6) AS total_weight, count(*) AS n_reads FROM predicted GROUP BY target_label")
def weighted_predictions(spark, sf_dir):
    """AG1-AG3: means and weighted means of predictions by group."""
    return rounded(predictions.aggregate(predicted(spark, sf_dir), ["target_label"], ["prediction_0", "prediction_1", "prediction_2"], "NCPGS"))


@query(f"WITH {PREDICTED}, g AS (SELECT name, {_WAVG.format(c='prediction_0')} AS prediction_0_wavg, {_WAVG.format(c='prediction_1')} AS prediction_1_wavg, sum(greatest(NCPGS::DOUBLE, 1e-10)) AS total_weight, count(*) AS n_reads FROM predicted WHERE NCPGS >= 9 GROUP BY name) SELECT r.name, round(coalesce(prediction_0_wavg, 0.5), 6)::DOUBLE AS prediction_0_wavg, round(coalesce(prediction_1_wavg, 0.5), 6)::DOUBLE AS prediction_1_wavg, round(coalesce(total_weight, 1), 6)::DOUBLE AS total_weight, coalesce(n_reads, 0) AS n_reads, CASE WHEN n_reads IS NULL THEN -1 ELSE 0 END AS label FROM (SELECT DISTINCT name FROM regions) r LEFT JOIN g USING (name)")
def filled_groups(spark, sf_dir):
    """AG4, AG5, J17, J18, U6: groups without reads filled in."""
    rows = predictions.aggregate(predicted(spark, sf_dir).filter("NCPGS >= 9"), ["name"], ["prediction_0", "prediction_1"], "NCPGS")
    groups = rows.select("name", "prediction_0_wavg", "prediction_1_wavg", "total_weight", "n_reads")
    return rounded(predictions.fill_missing(groups, regions(spark, sf_dir), "name", ["prediction_0_wavg", "prediction_1_wavg"], "uniform_number", 1.0))


@query(f"WITH {PREDICTED}, g AS (SELECT name, target_label, {_WAVG.format(c='prediction_0')} AS p, count(*) AS n FROM predicted GROUP BY ALL), q AS (SELECT target_label, avg(prediction_0) AS prior FROM predicted GROUP BY ALL) SELECT name, target_label, round(n / (n + 2.0) * p + 2.0 / (n + 2.0) * prior, 6)::DOUBLE AS prediction_0_wavg, n AS n_reads FROM g JOIN q USING (target_label)")
def blended_groups(spark, sf_dir):
    """AG6, J19: observed values drawn to a prior."""
    rows = predicted(spark, sf_dir)
    groups = predictions.aggregate(rows, ["name", "target_label"], ["prediction_0"], "NCPGS").select("name", "target_label", "prediction_0_wavg", "n_reads")
    prior = rows.groupBy("target_label").agg(F.avg("prediction_0").alias("prediction_0_wavg"))
    return rounded(predictions.blend(groups, prior, "target_label", ["prediction_0_wavg"], 2.0))


@query(f"WITH {PREDICTED} SELECT read_name, round(coalesce(sum(NCPGS * prediction_0) / nullif(sum(NCPGS), 0), 0), 6)::DOUBLE AS prediction_0, round(coalesce(sum(NCPGS * prediction_1) / nullif(sum(NCPGS), 0), 0), 6)::DOUBLE AS prediction_1 FROM predicted GROUP BY read_name")
def chunks_to_reads(spark, sf_dir):
    """AG7, J12, C14: chunk predictions back to reads."""
    return rounded(predictions.chunks_to_reads(predicted(spark, sf_dir), "read_name", ["prediction_0", "prediction_1"], "NCPGS"))


@query(f"WITH {PREDICTED} SELECT read_name, name, CASE WHEN prediction_0 >= prediction_1 AND prediction_0 >= prediction_2 THEN 0 WHEN prediction_1 >= prediction_2 THEN 1 ELSE 2 END AS prediction, round(greatest(prediction_0, prediction_1, prediction_2), 6) AS confidence, original_label = target_label AS is_cell_informative_region, (M + U)::INT AS total_marked_cpgs, 'U' AS direction, read_start FROM predicted")
def final_predictions(spark, sf_dir):
    """Read-level output: first largest prediction and its value, on-target flag, known positions, trimmed start."""
    rows = predicted(spark, sf_dir).withColumn("trimmed_start", F.col("read_start")).drop("read_start")
    got = predictions.annotated_predictions(rows, ["prediction_0", "prediction_1", "prediction_2"])
    return rounded(got.select("read_name", "name", "prediction", "confidence", "is_cell_informative_region", "total_marked_cpgs", "direction", "read_start"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four numbers a customer, some negative."""
    x = lambda k: ((F.col("c_custkey") * k) % 1000) / 500.0 - 0.7
    return table(spark, sf_dir, "customer").select("c_custkey", F.array(*[x(k) for k in (37, 91, 53, 77)]).alias("v"))


_SCORES = "s AS (SELECT c_custkey, [((c_custkey * k) % 1000) / 500.0 - 0.7 FOR k IN [37, 91, 53, 77]]::DOUBLE[] AS v FROM customer)"


_KINDS = {
    "softmax": "e[{k}] / list_sum(e)", "normalised": "p[{k}] / greatest(list_sum(p), 1e-12)", "uniform": "CASE WHEN list_sum(p) > 0 THEN p[{k}] / list_sum(p) ELSE 0.25 END",
    "none": "c[{k}]", "clip_normalize": "p[{k}] / CASE WHEN list_sum(p) = 0 THEN 1 ELSE list_sum(p) END",
}


@query(f"WITH {_SCORES}, e AS (SELECT c_custkey, [exp(x - list_max(v)) FOR x IN v] AS e, [greatest(x, 0) FOR x IN v] AS p, [least(greatest(x, 0), 1) FOR x IN v] AS c, v FROM s) SELECT c_custkey, {', '.join(f'round({sql.format(k=k + 1)}, 6)::DOUBLE AS {name}_{k}' for name, sql in _KINDS.items() for k in range(4))}, (list_position(v, list_max(v)) - 1)::INT AS argmax FROM e")
def vector_transforms(spark, sf_dir):
    """Softmax, normalised outputs and every transform, whole vectors."""
    v = F.col("v")
    made = {"softmax": vectors.transformed(v, "softmax"), "normalised": vectors.normalised(v), "uniform": vectors.normalised_or_uniform(v), "none": vectors.transformed(v, "none"), "clip_normalize": vectors.transformed(v, "clip_normalize")}
    rows = _scores(spark, sf_dir).select("c_custkey", vectors.argmax(v).alias("argmax"), *[c.alias(name) for name, c in made.items()])
    return rounded(rows.select("c_custkey", "argmax", *[F.col(name)[k].alias(f"{name}_{k}") for name in made for k in range(4)]))


@query(f"WITH {_SCORES}, u AS (SELECT c_custkey, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY x DESC, i) AS k, sum(x) OVER (PARTITION BY c_custkey ORDER BY x DESC, i ROWS UNBOUNDED PRECEDING) AS c FROM u), t AS (SELECT c_custkey, max_by((c - 1) / k, k) AS shift FROM r WHERE x > (c - 1) / k GROUP BY c_custkey) SELECT c_custkey, i::INT AS i, round(greatest(x - shift, 0), 6)::DOUBLE AS x FROM u JOIN t USING (c_custkey)")
def simplex_points(spark, sf_dir):
    """Nearest points of the simplex."""
    points = _scores(spark, sf_dir).select("c_custkey", F.posexplode(vectors.simplex(F.col("v"))).alias("i", "x"))
    return rounded(points.select("c_custkey", (F.col("i") + 1).alias("i"), "x"))


# --- labels and classifiers --------------------------------------------------------------------


@query(f"WITH {SIGNED} SELECT name, signature, {', '.join(f'count(*) FILTER (WHERE original_label = {k}) AS n_{k}' for k in range(CLASSES))} FROM signed GROUP BY name, signature")
def signature_counts(spark, sf_dir):
    """AG15, X12: class counts by region and signature."""
    rows = labelling.class_counts(signed(spark, sf_dir), CLASSES)
    return rows.select("name", "signature", *[F.col("counts")[k].alias(f"n_{k}") for k in range(CLASSES)])


@query(f"WITH {PREPARED}, n AS (SELECT original_label, count(*) AS n FROM prepared GROUP BY ALL) SELECT original_label, n, round((SELECT median(n) FROM n) / (n + 1e-9), 6) AS weight FROM n")
def class_weights(spark, sf_dir):
    """AG16: median of the class totals over the own."""
    return rounded(labelling.class_weights(prepared(spark, sf_dir)))


@query(f"WITH {PREPARED}, n AS (SELECT k AS original_label, (SELECT count(*) FROM prepared p WHERE p.original_label = k) AS n FROM range(9) r(k)) SELECT kind, original_label::INT AS original_label, round(CASE kind WHEN 'uniform' THEN 1 / 9.0::DOUBLE WHEN 'frequency' THEN n / (SELECT sum(n) FROM n) ELSE CASE WHEN n > 0 THEN 1 / n::DOUBLE ELSE 0 END / (SELECT sum(1 / n::DOUBLE) FROM n WHERE n > 0) END, 6)::DOUBLE AS prior FROM n CROSS JOIN (VALUES ('uniform'), ('frequency'), ('inverse')) v(kind)")
def class_priors(spark, sf_dir):
    """AG19: uniform, by frequency and by its inverse, absent classes at 0 in the latter two."""
    rows = settled(prepared(spark, sf_dir).select("original_label"))
    out = [labelling.class_priors(rows, 9, kind).withColumn("kind", F.lit(kind)) for kind in ("uniform", "frequency", "inverse")]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]))


_WEIGHTS = "n AS (SELECT original_label, count(*) AS n FROM signed GROUP BY ALL), w AS (SELECT original_label, (SELECT median(n) FROM n) / (n + 1e-9) AS w FROM n)"
_CLASSES = range(CLASSES)


def _vector(column: str, prefix: str) -> list:
    return [F.col(column)[k].alias(f"{prefix}_{k}") for k in _CLASSES]


@query(f"""WITH {SIGNED}, {_WEIGHTS}, c AS (SELECT name, signature, original_label, count(*) * max(w) AS x FROM signed JOIN w USING (original_label) GROUP BY ALL),
p AS (SELECT name, signature, {', '.join(f'coalesce(max(x) FILTER (WHERE original_label = {k}), 0) / sum(x) AS s_{k}' for k in _CLASSES)} FROM c GROUP BY ALL)
SELECT s.read_name, s.name, s.original_label, {', '.join(f'round(s_{k}, 6)::DOUBLE AS s_{k}' for k in _CLASSES)} FROM (SELECT DISTINCT read_name, name, original_label, signature FROM signed) s JOIN p USING (name, signature)""")
def soft_labels(spark, sf_dir):
    """Soft labels joined back to reads."""
    rows = prepared(spark, sf_dir)
    weights = labelling.class_weights(rows.select("original_label"))  # an overlap of its own, of a few bytes a read: less than to write the rows
    got = labelling.own_soft_labels(labelling.by_name(rows, "read_name", "original_label"), weights, CLASSES)
    return rounded(got.select("read_name", "name", "original_label", *_vector("soft_label", "s")))


_POOLED = f"""c AS (SELECT name, signature, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE original_label = {k}) AS n{k}' for k in _CLASSES)}, string_split(signature, ',') AS parts FROM signed GROUP BY name, signature),
d AS (SELECT a.name, a.signature, b.signature AS other, b.n, {', '.join(f'b.n{k}' for k in _CLASSES)}, CASE WHEN a.signature = '' AND b.signature = '' THEN 0 WHEN a.signature = '' OR b.signature = '' THEN 1
  ELSE 1 - len(list_intersect(a.parts, b.parts)) / len(list_distinct(list_concat(a.parts, b.parts)))::DOUBLE END AS dist FROM c a JOIN c b USING (name)),
r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY name, signature ORDER BY dist, other ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d WHERE dist <= {{most}}),
pooled AS (SELECT name, signature, sum(n)::BIGINT AS n, {', '.join(f'sum(n{k})::BIGINT AS n_{k}' for k in _CLASSES)} FROM r WHERE before < 30 GROUP BY name, signature)"""


@query(f"WITH {SIGNED}, {_POOLED.format(most=0.5)} SELECT * FROM pooled")
def pooled_signatures(spark, sf_dir):
    """Counts pooled over near signatures."""
    counts = labelling.signature_counts(labelling.by_name(prepared(spark, sf_dir), "original_label"), CLASSES)
    rows = labelling.pooled_counts(counts, CLASSES)
    return rows.select("name", "signature", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), *_vector("counts", "n"))


@query(f"""WITH {SIGNED}, {_WEIGHTS}, {_POOLED.format(most=0.41)}, v AS (SELECT name, signature, {', '.join(f'n_{k} * coalesce((SELECT w FROM w WHERE original_label = {k}), 0) AS v{k}' for k in _CLASSES)} FROM pooled)
SELECT name, signature, {', '.join(f"round(v{k} / ({' + '.join(f'v{j}' for j in _CLASSES)}), 6)::DOUBLE AS s_{k}" for k in _CLASSES)} FROM v""")
def fitted_lookup(spark, sf_dir):
    """The table of a soft lookup, counts pooled over near signatures and weighed by class."""
    return rounded(labelling.fit_lookup(labelling.by_name(prepared(spark, sf_dir), "original_label"), CLASSES).select("name", "signature", *_vector("label", "s")))


@query()
def superset_pooled_signatures(spark, sf_dir):
    """L3: counts pooled over signatures that hold the own one, then over near ones."""
    rows = labelling.superset_pooled_counts(labelling.class_counts(signed(spark, sf_dir), CLASSES), CLASSES)
    return rows.select("name", "signature", "pooled", *_vector("counts", "n"))


@query(f"WITH {SIGNED}, c AS (SELECT DISTINCT name, signature, string_split(signature, ',') AS parts FROM signed WHERE signature <> '') SELECT a.name, a.signature, b.signature AS other FROM c a JOIN c b USING (name) WHERE list_has_all(b.parts, a.parts)")
def signature_supersets(spark, sf_dir):
    """Signatures that hold others of their region."""
    return labelling.supersets(settled(labelling.class_counts(signed(spark, sf_dir), CLASSES)))


@query(f"""WITH {SIGNED}, o AS (SELECT name, original_label, pos, avg(state_) AS own FROM positions GROUP BY ALL), m AS (SELECT name, original_label, avg(own) AS mean FROM o GROUP BY ALL),
g AS (SELECT name, pos, k::INT AS original_label FROM (SELECT DISTINCT name, pos FROM positions), range({CLASSES}) r(k)),
mu AS (SELECT g.name, g.pos, g.original_label, least(greatest(coalesce(own, mean, 1.0), 1e-10), 1 - 1e-10) AS mu FROM g LEFT JOIN o USING (name, pos, original_label) LEFT JOIN m USING (name, original_label)),
pr AS (SELECT original_label, count(*) / (SELECT count(*) FROM prepared)::DOUBLE AS prior FROM prepared GROUP BY ALL),
sp AS (SELECT DISTINCT s.name, s.signature, p.pos, p.state_ FROM signed s JOIN positions p ON s.read_start = p.read_start AND s.methylation_ids = p.methylation_ids AND s.name = p.name),
ll AS (SELECT name, signature, original_label, sum(ln(CASE WHEN state_ = 1 THEN mu ELSE 1 - mu END)) + max(ln(prior)) AS post FROM sp JOIN mu USING (name, pos) JOIN pr USING (original_label) GROUP BY ALL),
e AS (SELECT *, exp(post - max(post) OVER (PARTITION BY name, signature)) AS e FROM ll)
SELECT name, signature, original_label, round(e / sum(e) OVER (PARTITION BY name, signature), 6) AS probability FROM e""")
def archetype_labels(spark, sf_dir):
    """Posterior of each class for each signature."""
    rows = settled(labelling.by_name(prepared(spark, sf_dir), "original_label"))
    told = labelling.with_signature(rows.select("name", "read_start", "methylation_ids").distinct())
    got = labelling.archetype_labels(told, labelling.archetype_models(rows, CLASSES), labelling.class_priors(rows, CLASSES), CLASSES)
    return rounded(got.select("name", "signature", F.posexplode("probabilities").alias("original_label", "probability")))


@query(f"""WITH {SIGNED}, s AS (SELECT signed.*, p.file FROM (SELECT DISTINCT * FROM signed) signed JOIN (SELECT DISTINCT read_name, file FROM reads) p USING (read_name)),
m AS (SELECT name, signature AS other, string_split(signature, ',') AS parts, {', '.join(f'count(*) FILTER (WHERE original_label = {k}) AS c{k}' for k in range(CLASSES))} FROM s WHERE file <> 'f0' GROUP BY name, signature),
q AS (SELECT DISTINCT read_name, name, signature, string_split(signature, ',') AS parts FROM s WHERE file = 'f0'),
d AS (SELECT q.read_name, q.name, q.signature, m.*  EXCLUDE (name, parts), m.name IS NOT NULL AS known, CASE WHEN q.signature = other THEN 0 WHEN q.signature = '' OR other = '' THEN 1
  ELSE 1 - len(list_intersect(q.parts, m.parts)) / len(list_distinct(list_concat(q.parts, m.parts)))::DOUBLE END AS dist FROM q LEFT JOIN m ON q.name = m.name),
r AS (SELECT *, rank() OVER (PARTITION BY read_name, name, signature ORDER BY dist) AS k FROM d),
t AS (SELECT read_name, name, signature, CASE WHEN NOT bool_and(known) THEN 'none' WHEN min(dist) = 0 THEN 'exact' ELSE '1nn' END AS source, {', '.join(f'CASE WHEN bool_and(known) THEN sum(c{k}) ELSE 1 END::DOUBLE AS c{k}' for k in range(CLASSES))} FROM r WHERE k = 1 GROUP BY read_name, name, signature)
SELECT read_name, name, source, {', '.join(f'round(c{k} / ({" + ".join(f"c{j}" for j in range(CLASSES))}), 6) AS p_{k}' for k in range(CLASSES))} FROM t""")
def lookup_predictions(spark, sf_dir):
    """Reads of one file looked up among the others' signatures, nearest ones where unknown."""
    rows = settled(labelling.by_name(prepared(spark, sf_dir), "read_name", "original_label", "file"))
    model = labelling.signature_counts(rows.filter("file <> 'f0'"), CLASSES)
    found = labelling.lookup(labelling.with_signature(rows.filter("file = 'f0'")).select("read_name", "name", "signature").distinct(), model, CLASSES)
    return rounded(found.select("read_name", "name", "source", *[F.col("prediction")[k].alias(f"p_{k}") for k in range(CLASSES)]))


@query(f"WITH {PREPARED}, k AS (SELECT *, least(greatest(M_rate, 0.01), 0.99) AS r FROM prepared WHERE NCPGS > 0) SELECT name, original_label, count(*) AS n, count(*) FILTER (WHERE M_rate = 1) AS ones, count(*) FILTER (WHERE M_rate = 0) AS zeros, sum(NCPGS)::BIGINT AS cpgs, round(sum(ln(r)), 6) AS slog, round(sum(ln(1 - r)), 6) AS slog1 FROM k GROUP BY ALL")
def beta_statistics(spark, sf_dir):
    """C4: sufficient statistics of the Beta fits."""
    return rounded(labelling.beta_statistics(prepared(spark, sf_dir)))


@query(f"""WITH {PREPARED}, g AS (SELECT name, original_label, sum(M) + 1.0 AS eta, sum(U) + 1.0 AS rho FROM prepared GROUP BY ALL), pr AS (SELECT original_label, count(*) / (SELECT count(*) FROM prepared)::DOUBLE AS prior FROM prepared GROUP BY ALL),
j AS (SELECT p.read_name, p.name, M, U, g.original_label, M * ln(eta / (eta + rho)) + U * ln(rho / (eta + rho)) + ln(prior) AS l FROM (SELECT DISTINCT read_name, name, M, U FROM prepared) p JOIN g USING (name) JOIN pr USING (original_label)),
e AS (SELECT *, exp(l - max(l) OVER (PARTITION BY read_name, name, M, U)) AS e FROM j)
SELECT read_name, name, M, U, {', '.join(f'round(coalesce(max(e / s) FILTER (WHERE original_label = {k}), 0), 6)::DOUBLE AS p_{k}' for k in _CLASSES)} FROM (SELECT *, sum(e) OVER (PARTITION BY read_name, name, M, U) AS s FROM e) GROUP BY read_name, name, M, U""")
def beta_predictions(spark, sf_dir):
    """Posterior of the Beta model."""
    rows = settled(prepared(spark, sf_dir).select("read_name", "name", "original_label", "M", "U"))
    got = labelling.beta_predict(rows.select("read_name", "name", "M", "U").distinct(), labelling.added_one_beta(rows), labelling.class_priors(rows, CLASSES), CLASSES)
    return rounded(got.select("read_name", "name", "M", "U", *_vector("prediction", "p")))


# --- feature selection and imputation ----------------------------------------------------------

_LONG = "l AS (SELECT target_label AS grg, original_label AS pred, (l_linenumber % 4) AS cell_type, avg(x) AS value FROM (SELECT p_size % 7 AS target_label, l_suppkey % 7 AS original_label, l_linenumber, l_quantity AS x FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL)"


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(by_region(table(spark, sf_dir, "part").select("p_partkey", "p_size")), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy((F.col("p_size") % 7).alias("grg"), (F.col("l_suppkey") % 7).alias("pred"), (F.col("l_linenumber") % 4).alias("cell_type")).agg(F.avg("l_quantity").alias("value"))


@query(f"WITH {_LONG} SELECT grg::INT AS grg, pred::INT AS pred, round(max(value) / CASE WHEN avg(value) = 0 THEN 1e-12 ELSE avg(value) END, 6) AS ratio FROM l GROUP BY grg, pred HAVING max(value) / CASE WHEN avg(value) = 0 THEN 1e-12 ELSE avg(value) END > 1.01 OR grg = pred")
def feature_mask(spark, sf_dir):
    """AG21, AG22: features above the cutoff or on the diagonal."""
    got = atlases.feature_mask(atlases.feature_ratios(_features(spark, sf_dir)), 1.01)
    return rounded(got.select(F.col("grg").cast("int"), F.col("pred").cast("int"), "ratio"))


@query(f"WITH {_LONG}, r AS (SELECT grg::INT AS grg, pred::INT AS pred, max(value) / avg(value) AS ratio FROM l GROUP BY grg, pred) SELECT grg, pred, round(ratio, 6) AS ratio, rank::INT AS rank FROM (SELECT *, row_number() OVER (ORDER BY (grg = pred) DESC, ratio DESC, grg, pred) AS rank FROM r) WHERE rank <= 20")
def top_features(spark, sf_dir):
    """The best features, guaranteed ones first."""
    got = atlases.top_features(atlases.feature_ratios(_features(spark, sf_dir)), 20)
    return rounded(got.select(F.col("grg").cast("int"), F.col("pred").cast("int"), "ratio", "rank"))


@query("WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS x FROM customer) SELECT c_custkey, c_nationkey, round(coalesce(x, median(x) OVER (PARTITION BY c_nationkey), (SELECT median(x) FROM c)), 6) AS x FROM c")
def imputed_values(spark, sf_dir):
    """Medians of the group, then of all, for missing values."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("x"))
    return rounded(atlases.impute_by_target(rows, "c_nationkey", ["x"]))


@query("SELECT p_brand AS target, cluster, rank::INT AS rank FROM (SELECT p_brand, p_size % 5 AS cluster, row_number() OVER (PARTITION BY p_brand ORDER BY round(avg(p_retailprice), 6) DESC, p_size % 5) - 1 AS rank FROM part GROUP BY p_brand, p_size % 5)")
def cluster_ranks(spark, sf_dir):
    """Rank of clusters by their own mean."""
    means = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("target"), (F.col("p_size") % 5).alias("cluster")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean"))
    return atlases.cluster_ranks(means).select("target", "cluster", "rank")


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS code FROM part")
def region_annotations(spark, sf_dir):
    """SC13, W9: dense codes of an annotation, ranked on its distinct values and joined back."""
    return atlases.annotation_codes(table(spark, sf_dir, "part"), "p_brand").select("p_partkey", "code")



# --- evaluation --------------------------------------------------------------------------------


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of order value by status class as targets, those of the order count as predictions."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("sample"), (F.col("o_orderkey") % 5).alias("cell_type"), (F.col("o_orderkey") % 3).alias("method"), "o_totalprice")
    g = o.groupBy("method", "sample", "cell_type").agg(F.sum("o_totalprice").alias("a"), F.count("*").alias("b"))
    w = Window.partitionBy("method", "sample")
    return g.select("method", "sample", "cell_type", (F.col("a") / F.sum("a").over(w)).alias("target"), (F.col("b") / F.sum("b").over(w)).alias("predicted"))


_EST = """e0 AS (SELECT o_orderkey % 3 AS method, o_custkey % 200 AS sample, o_orderkey % 5 AS cell_type, sum(o_totalprice) AS a, count(*) AS b FROM orders GROUP BY ALL),
e AS (SELECT method, sample, cell_type, a / sum(a) OVER (PARTITION BY method, sample) AS target, b / (sum(b) OVER (PARTITION BY method, sample))::DOUBLE AS predicted FROM e0),
d AS (SELECT *, predicted - target AS d, greatest(target, 1e-8) AS t, greatest(predicted, 1e-8) AS p FROM e)"""


@query(f"WITH {_EST}, m AS (SELECT *, avg(target) OVER (PARTITION BY method, cell_type) AS m FROM d) SELECT method, round(avg(abs(d)), 6) AS mae, round(avg(d * d), 6) AS mse, round(sum(t * ln(t / p)) / count(DISTINCT sample), 6) AS kl, round(max(abs(d)), 6) AS max_error, round(1 - sum(d * d) / sum((target - m) * (target - m)), 6) AS r2, round(avg(d), 6) + 0.0 AS bias, round(avg(d) - 1.96 * stddev_samp(d), 6) AS low, round(avg(d) + 1.96 * stddev_samp(d), 6) AS high FROM m GROUP BY method")
def deconvolution_metrics(spark, sf_dir):
    """Errors of estimated proportions by method."""
    return rounded(evaluation.deconvolution_metrics(_estimates(spark, sf_dir))).withColumn("bias", F.col("bias") + 0.0)  # no negative zero


@query(f"WITH {_EST} SELECT method, sample, round(avg(abs(d)), 6) AS mae, round(avg(d * d), 6) AS mse, round(sum(t * ln(t / p)), 6) AS kl, round(sum(target * predicted) / (sqrt(sum(target * target)) * sqrt(sum(predicted * predicted))), 6) AS cosine FROM d GROUP BY method, sample")
def sample_metrics(spark, sf_dir):
    """E5: errors by sample."""
    return rounded(evaluation.sample_metrics(_estimates(spark, sf_dir)))


@query(f"WITH {_EST}, k AS (SELECT cell_type, regr_slope(target, predicted) AS slope, regr_intercept(target, predicted) AS intercept, corr(target, predicted) AS r, regr_syy(target, predicted) / regr_sxx(target, predicted) AS q, count(*) AS n FROM d GROUP BY cell_type) SELECT cell_type, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round(sqrt((1 - r * r) * q / (n - 2)), 6) AS stderr, n FROM k")
def linear_calibrators(spark, sf_dir):
    """K1: a line for each cell type, with its standard error (p is tested apart)."""
    return rounded(evaluation.linear_calibrator(_estimates(spark, sf_dir)))


@query(f"WITH {_EST}, k AS (SELECT cell_type, regr_slope(target, predicted) AS s, regr_intercept(target, predicted) AS i FROM d GROUP BY cell_type), c AS (SELECT d.*, greatest(s * predicted + i, 0) AS raw FROM d JOIN k USING (cell_type)) SELECT method, sample, cell_type, round(raw / greatest(sum(raw) OVER (PARTITION BY method, sample), 1e-12), 6) AS calibrated FROM c")
def calibrated_estimates(spark, sf_dir):
    """Calibrated proportions."""
    rows = _estimates(spark, sf_dir)
    return rounded(evaluation.calibrate(rows, evaluation.linear_calibrator(rows)).select("method", "sample", "cell_type", "calibrated"))


@query(f"WITH {_EST}, q AS (SELECT cell_type, method, avg(predicted) AS p FROM d GROUP BY ALL), t AS (SELECT cell_type, median(p) AS median, avg(p) AS mean, min(p) AS min, max(p) AS max, quantile_cont(p, 0.25) AS q25, quantile_cont(p, 0.75) AS q75 FROM q GROUP BY cell_type) SELECT cell_type, round(median, 6) AS median, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max, round(q25, 6) AS q25, round(q75, 6) AS q75, (row_number() OVER (ORDER BY median DESC, cell_type))::INT AS rank FROM t")
def method_report(spark, sf_dir):
    """AG18: the report over methods."""
    return rounded(evaluation.report(_estimates(spark, sf_dir).withColumnRenamed("predicted", "proportion")))


@query(f"WITH {_EST}, q AS (SELECT cell_type, method, avg(predicted) AS p FROM d GROUP BY ALL), m AS (SELECT *, median(p) OVER (PARTITION BY cell_type) AS m FROM q) SELECT method, round(sum(abs(p - m)), 6) AS divergence FROM m GROUP BY method")
def method_divergence(spark, sf_dir):
    """AG18: distance of each method from the consensus."""
    return rounded(evaluation.divergence(_estimates(spark, sf_dir).withColumnRenamed("predicted", "proportion")))


@query("WITH c AS (SELECT l_suppkey % 4 AS truth, l_partkey % 4 AS predicted, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), k AS (SELECT k, (SELECT sum(n) FROM c WHERE truth = k) AS t, (SELECT sum(n) FROM c WHERE predicted = k) AS p, (SELECT coalesce(sum(n), 0) FROM c WHERE truth = k AND predicted = k) AS h FROM range(4) r(k)), s AS (SELECT sum(t) AS s, sum(h) AS c, sum(t * p) AS tp, sum(t * t) AS tt, sum(p * p) AS pp, avg(h / p) AS precision, avg(h / t) AS recall, avg(2 * h / (p + t)) AS f1 FROM k) SELECT round(c / s, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round((c * s - tp) / sqrt((s * s - pp) * (s * s - tt)), 6) AS mcc FROM s")
def classifier_metrics(spark, sf_dir):
    """Metrics from the confusion table."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("truth"), (F.col("l_partkey") % 4).alias("predicted"))
    return rounded(evaluation.classifier_metrics(rows))


@query("WITH r AS (SELECT l_discount * 10 AS confidence, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS correct FROM lineitem), b AS (SELECT len(list_filter([k / 10.0::DOUBLE FOR k IN range(1, 10)], lambda e: e < confidence)) AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM r GROUP BY ALL) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece, round(max(abs(c - a)), 6) AS mce, (SELECT round(avg((confidence - correct) * (confidence - correct)), 6) FROM r) AS brier FROM b")
def calibration_errors(spark, sf_dir):
    """Calibration errors over equal bins."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("confidence"), F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("correct"))
    return rounded(evaluation.calibration_errors(rows))


@query("WITH l AS (SELECT user_id % 20 AS run, CASE WHEN event_type IN ('click', 'view') THEN 'val_loss' ELSE 'val_f1' END AS metric, event_id AS epoch, value FROM events) SELECT run, metric, CASE WHEN metric = 'val_loss' THEN arg_min(epoch, (value, epoch)) ELSE arg_min(epoch, (-value, epoch)) END AS epoch, round(CASE WHEN metric = 'val_loss' THEN min(value) ELSE max(value) END, 6) AS value FROM l GROUP BY run, metric")
def best_epochs(spark, sf_dir):
    """Best epochs of a log."""
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.when(F.col("event_type").isin("click", "view"), "val_loss").otherwise("val_f1").alias("metric"), F.col("event_id").alias("epoch"), "value")
    return rounded(evaluation.best_epoch(log))


_BY_LABEL = """r AS (SELECT k AS label, CASE WHEN l_partkey % 4 = k THEN 1 ELSE 0 END AS correct, ((l_quantity::INT * (k + 3) + l_linenumber * 7) % 101) / 101.0::DOUBLE AS confidence, (1 + l_linenumber % 3)::DOUBLE AS weight FROM lineitem, range(4) q(k))"""


def _by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rows a line: whether a label is its own, and a made probability of it."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("label"))
    chance = ((F.col("q") * (F.col("label") + 3) + F.col("l_linenumber") * 7) % 101) / F.lit(101.0)
    return rows.select("label", F.when(F.col("l_partkey") % 4 == F.col("label"), 1).otherwise(0).alias("correct"), chance.alias("confidence"), (1 + F.col("l_linenumber") % 3).cast("double").alias("weight"))


@query(f"WITH {_BY_LABEL}, c AS (SELECT label, confidence, sum(correct * weight) AS p, sum(weight) AS w FROM r GROUP BY ALL), s AS (SELECT label, p, sum(p) OVER a AS tp, sum(w) OVER a AS n, sum(p) OVER (PARTITION BY label) AS total FROM c WINDOW a AS (PARTITION BY label ORDER BY confidence DESC)), l AS (SELECT label, sum(p / total * tp / n) AS ap FROM s GROUP BY label) SELECT round(avg(ap), 6) AS average_precision FROM l")
def average_precisions(spark, sf_dir):
    """Macro average precision, weighted."""
    return rounded(evaluation.average_precision(_by_label(spark, sf_dir).withColumnRenamed("correct", "hit").withColumnRenamed("confidence", "score")))


@query(f"WITH {_BY_LABEL}, e AS (SELECT label, quantile_cont(confidence, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM r GROUP BY label), b AS (SELECT label, bins, bin, count(*) AS n, abs(avg(confidence) - avg(correct)) AS gap FROM (SELECT label, 'equal' AS bins, confidence, correct, len(list_filter([k / 10.0::DOUBLE FOR k IN range(1, 10)], lambda x: x < confidence)) AS bin FROM r UNION ALL SELECT label, 'quantile', confidence, correct, len(list_filter(edges, lambda x: x < confidence)) FROM r JOIN e USING (label)) GROUP BY ALL), l AS (SELECT bins, label, sum(n * gap) / sum(n) AS ece FROM b GROUP BY ALL) SELECT bins, round(avg(ece), 6) AS classwise_ece FROM l GROUP BY bins")
def classwise_errors(spark, sf_dir):
    """Mean calibration error by label, over equal bins and between quantiles."""
    rows = _by_label(spark, sf_dir).drop("weight")
    both = evaluation.classwise_error(rows).withColumn("bins", F.lit("equal")).unionByName(evaluation.classwise_error(rows, equal_counts=True).withColumn("bins", F.lit("quantile")))
    return rounded(both)


@query(f"WITH {PREDICTED}, v AS (SELECT read_name, name, original_label, target_label, [prediction_0, prediction_1, prediction_2] AS p FROM predicted) SELECT read_name, name, (CASE WHEN list_max(p) < 0.5 THEN 3 ELSE list_position(p, list_max(p)) - 1 END)::INT AS prediction, round(1 - list_max(p), 6) AS background, round(CASE WHEN original_label = target_label AND target_label < 3 THEN p[target_label + 1] END, 6) AS on_target FROM v")
def background_predictions(spark, sf_dir):
    """Predictions with a background class, and the score of on-target reads."""
    v = F.array("prediction_0", "prediction_1", "prediction_2")
    return rounded(predicted(spark, sf_dir).select("read_name", "name", evaluation.with_background(v).alias("prediction"), F.element_at(evaluation.background_probability(v), -1).alias("background"), evaluation.on_target_score(v, F.col("target_label"), F.col("original_label")).alias("on_target")))


@query(f"WITH {_EST}, g AS (SELECT DISTINCT method * 1000 + sample AS sample FROM e) SELECT g.sample, label::INT AS label, round(coalesce(p, 0), 4) AS proportion FROM g CROSS JOIN range(7) l(label) LEFT JOIN (SELECT method * 1000 + sample AS sample, cell_type, predicted AS p FROM e) x ON x.sample = g.sample AND x.cell_type = (label + 3) % 7")
def ordered_proportions(spark, sf_dir):
    """Proportions in the order of labels, rounded for output."""
    labels = spark.range(7).select(F.col("id").cast("int").alias("label"), ((F.col("id") + 3) % 7).alias("cell_type"))
    rows = _estimates(spark, sf_dir).select((F.col("method") * 1000 + F.col("sample")).alias("sample"), "cell_type", F.col("predicted").alias("proportion"))
    return rounded(evaluation.in_label_order(rows, labels), 4)


# --- solvers on cases with a closed form, baseline inputs --------------------------------------


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty samples of at most twelve features: mean order values."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy((F.col("o_custkey") % 40).alias("sample"), (F.col("o_orderkey") % 12).alias("feature")).agg((F.avg("o_totalprice") / 300000).alias("value"))


_MIXED = "b AS (SELECT o_custkey % 40 AS sample, o_orderkey % 12 AS feature, avg(o_totalprice) / 300000 AS value FROM orders GROUP BY ALL)"


@query(f"WITH {_MIXED}, x AS (SELECT sample, feature % 3 AS cell_type, sum((1 + feature / 10.0::DOUBLE) * value) / sum((1 + feature / 10.0::DOUBLE) * (1 + feature / 10.0::DOUBLE)) AS x FROM b GROUP BY ALL) SELECT sample, k AS cell_type, round(coalesce(x, 0) / sum(coalesce(x, 0)) OVER (PARTITION BY sample), 6) AS proportion FROM (SELECT DISTINCT sample FROM b) CROSS JOIN range(3) q(k) LEFT JOIN x USING (sample) WHERE x.cell_type = k")
def separate_estimates(spark, sf_dir):
    """Non-negative least squares where each feature belongs to one cell type, so that each is solved alone."""
    grid = spark.range(12).select(F.col("id").alias("feature"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("cell_type"))
    reference = grid.withColumn("value", F.when(F.col("feature") % 3 == F.col("cell_type"), 1 + F.col("feature") / 10).otherwise(0.0))
    return rounded(mixtures.estimate(_mixed(spark, sf_dir), reference, "nnls").filter("proportion > 0"))


@query(f"WITH {_MIXED}, a AS (SELECT feature, (feature % 5) / 5.0::DOUBLE + 0.1 AS a0, (feature * 3 % 7) / 7.0::DOUBLE + 0.2 AS a1 FROM range(12) f(feature)), x AS (SELECT sample, least(1, greatest(0, sum((a0 - a1) * (value - a1)) / sum((a0 - a1) * (a0 - a1)))) AS x FROM b JOIN a USING (feature) GROUP BY sample) SELECT sample, k AS cell_type, round(CASE WHEN k = 0 THEN x ELSE 1 - x END, 5) AS proportion FROM x, range(2) q(k)")
def two_type_estimates(spark, sf_dir):
    """Least squares on the simplex of two cell types, a clipped projection on a line."""
    f = F.col("feature")
    features = spark.range(12).select(F.col("id").alias("feature"))
    first, second = features.select(f, F.lit(0).cast("long").alias("cell_type"), ((f % 5) / 5 + 0.1).alias("value")), features.select(f, F.lit(1).cast("long").alias("cell_type"), ((f * 3 % 7) / 7 + 0.2).alias("value"))
    return rounded(mixtures.estimate(_mixed(spark, sf_dir), first.union(second), "psls"), 5)


@query(f"WITH {PREPARED}, s AS (SELECT file AS sample, name, count_if(state = 'M') AS m, count_if(state = 'U') AS u, count(*) AS n FROM prepared WHERE NCPGS >= 4 GROUP BY ALL) SELECT sample, name || '/' || direction AS feature, round(CASE WHEN direction = 'U' THEN u ELSE m END / n::DOUBLE, 6) AS value, (n * n)::DOUBLE AS weight FROM s JOIN regions USING (name)")
def marker_samples(spark, sf_dir):
    """A sample's shares of marker reads joined to the markers, with the weights of its reads."""
    rows = prepared(spark, sf_dir).filter("NCPGS >= 4")
    one = lambda s: F.count_if(F.col("state") == s)
    states = rows.groupBy(F.col("file").alias("sample"), "name").agg(one("M").alias("M"), one("U").alias("U"), F.count("*").alias("count"))
    return rounded(atlases.marker_samples(states, regions(spark, sf_dir)))


@query(f"WITH {POSITIONS} SELECT chromosome, name, original_label, sum(state_)::BIGINT AS meth, count(*) AS cov FROM positions GROUP BY ALL")
def region_counts(spark, sf_dir):
    """AG12: counts of positions summed by region."""
    return atlases.region_sums(atlases.cpg_counts(prepared(spark, sf_dir)))


@query(f"WITH {PREPARED} SELECT read_name, prepared.name, p_brand AS target, CASE WHEN p_brand = 'Brand#11' THEN 'Brand#12' ELSE p_brand END AS target_matched, c.label::INT AS target_label, p_type FROM prepared JOIN part ON prepared.name = 'r' || p_partkey::VARCHAR JOIN (SELECT p_brand AS cell_type, row_number() OVER (ORDER BY p_brand) - 1 AS label FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#13')) c ON c.cell_type = CASE WHEN p_brand = 'Brand#11' THEN 'Brand#12' ELSE p_brand END")
def annotated_reads(spark, sf_dir):
    """Names, codes and annotations of regions on their reads."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), "p_partkey").alias("name"), F.col("p_brand").alias("target"), "p_type")
    brands = parts.filter("target <> 'Brand#13'").select(F.col("target").alias("cell_type")).distinct()  # some dozens
    codes = brands.withColumn("label", F.row_number().over(Window.orderBy("cell_type")) - 1)
    got = labelling.annotate_regions(prepared(spark, sf_dir), parts, codes, {"Brand#11": "Brand#12"}, ["p_type"])
    return got.select("read_name", "name", "target", "target_matched", "target_label", "p_type")


@query(f"WITH {READS}, w AS (SELECT read_name, s AS start, substr(methylation_ids, s::INT + 1, 12) AS t FROM reads, range(0, 21, 4) q(s)), c AS (SELECT read_name, start, length(t) - length(replace(replace(t, '0', ''), '1', '')) AS known, (length(t) - length(replace(t, '1', ''))) AS ones FROM w), e AS (SELECT *, CASE WHEN ones IN (0, known) THEN 0 ELSE -(ones / known::DOUBLE) * log2(ones / known::DOUBLE) - (1 - ones / known::DOUBLE) * log2(1 - ones / known::DOUBLE) END AS entropy FROM c WHERE known >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY read_name ORDER BY round(entropy + 0.1 / known, 9), start) AS k FROM e) SELECT read_name, coalesce(start, 0)::INT AS start, coalesce(known, 0)::INT AS known, round(entropy, 6) AS entropy FROM (SELECT DISTINCT read_name FROM reads) LEFT JOIN (SELECT * FROM r WHERE k = 1) USING (read_name)")
def entropy_windows(spark, sf_dir):
    """TV5: windows of least entropy."""
    return rounded(patterns.lowest_entropy_window(reads(spark, sf_dir), ["read_name"], "methylation_ids", 12, 5, 4))


@query(f"WITH {PREPARED} SELECT file AS split, count(*)::BIGINT AS n_reads, count(*) AS n_rows, count(DISTINCT original_label) AS n_unique_labels, count(DISTINCT target_label) AS n_unique_grg FROM prepared GROUP BY file")
def split_statistics(spark, sf_dir):
    """AG24: numbers of a table by split (the watermark is tested apart)."""
    return predictions.table_statistics(prepared(spark, sf_dir), "file").withColumnRenamed("file", "split").drop("watermark")


@query(f"WITH {PREPARED}, i AS (SELECT file, count(*) AS n_in FROM reads GROUP BY file), o AS (SELECT file, count(*) AS n_out FROM prepared GROUP BY file) SELECT file, n_in, coalesce(n_out, 0) AS n_out, round(coalesce(n_out, 0) / n_in::DOUBLE, 6) AS duplication_factor FROM i LEFT JOIN o USING (file)")
def duplication_factors(spark, sf_dir):
    """AG25: rows after the overlap for each read."""
    return rounded(predictions.duplication_factor(reads(spark, sf_dir), prepared(spark, sf_dir), "file"))


@query(f"WITH {PREDICTED}, g AS (SELECT original_label, target_label, sum(greatest(NCPGS, 1e-10) * prediction_0) / sum(greatest(NCPGS, 1e-10)) AS p0, sum(greatest(NCPGS, 1e-10) * prediction_1) / sum(greatest(NCPGS, 1e-10)) AS p1 FROM predicted GROUP BY ALL), f AS (SELECT target_label::VARCHAR || '/prediction_0' AS feature, p0 AS v FROM g UNION ALL SELECT target_label::VARCHAR || '/prediction_1', p1 FROM g) SELECT feature, round((sum(v) + (7 - count(*)) / 7.0::DOUBLE) / 7, 6) AS value FROM f GROUP BY feature")
def uniform_priors(spark, sf_dir):
    """AG23, G7: pure profiles of the classes, and their mean."""
    return rounded(predictions.uniform_prior(predictions.pure_profiles(predicted(spark, sf_dir), "target_label", ["prediction_0", "prediction_1"], "NCPGS", CLASSES)))


@query(f"WITH {READS}, t AS (SELECT read_name, list_filter([{{'t': substr(replace(input_ids, 'TT', 'NN'), i, 3), 'm': substr(methylation_ids, i + 1, 1)}} FOR i IN range(1, 31)], lambda x: NOT contains(x.t, 'N')) AS k FROM reads), w AS (SELECT read_name, k, unnest(list_distinct(list_concat(range(0, greatest(len(k) - 12, 0) + 1, 6), [greatest(len(k) - 12, 0)]))) AS start FROM t WHERE len(k) > 0), c AS (SELECT read_name, start, [x.t FOR x IN k[start + 1 : start + 12]] AS t, array_to_string([x.m FOR x IN k[start + 1 : start + 12]], '') AS states FROM w) SELECT read_name, start::INT AS start, array_to_string(t, ' ') AS dna, states, (length(states) - length(replace(replace(states, '0', ''), '1', '')))::INT AS ncpgs_marked FROM c")
def token_windows(spark, sf_dir):
    """TV4, P26: windows of k-mers without Ns, with the state of each middle base."""
    rows = reads(spark, sf_dir).withColumn("input_ids", F.replace(F.col("input_ids"), F.lit("TT"), F.lit("NN")))
    return patterns.token_rows(rows, ["read_name"], 3, 12, 6).select("read_name", "start", F.array_join("tokens", " ").alias("dna"), "states", "ncpgs_marked")


# --- simulation --------------------------------------------------------------------------------


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).groupBy("original_label", F.col("target_label").alias("grg")).agg(F.count("*").alias("n_reads"))


@query(f"WITH {PREPARED}, g AS (SELECT original_label, target_label AS grg, count(*) AS n_reads FROM prepared GROUP BY ALL), t AS (SELECT pb AS pb_index, k AS original_label, (1 + (pb * 31 + k * 17) % 10) / (SELECT sum(1 + (pb * 31 + j * 17) % 10) FROM range(7) q(j))::DOUBLE AS target FROM range(10) a(pb), range(7) b(k)) SELECT pb_index, original_label::INT AS original_label, grg, floor(floor(target * 5000) / n)::BIGINT AS quota FROM t JOIN (SELECT *, count(*) OVER (PARTITION BY original_label) AS n FROM g) USING (original_label)")
def group_quotas(spark, sf_dir):
    """Equal shares of the quota over non-empty groups (G3, the draw over groups, is in simulated_mixtures)."""
    grid = spark.range(10).select(F.col("id").alias("pb_index"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("original_label"))
    weight = 1 + (F.col("pb_index") * 31 + F.col("original_label") * 17) % 10
    targets = grid.withColumn("target", weight / F.sum(weight).over(Window.partitionBy("pb_index")))
    return simulation.quotas(targets, _groups(spark, sf_dir), 5000)


def _uniform(*key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'({k})::VARCHAR' for k in key)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query(f"""WITH {PREDICTED}, un AS (SELECT concat_ws('/', read_name, name, original_label::VARCHAR) AS row_id, original_label, target_label AS grg, count(*) AS read_count, min(prediction_0) AS p, min(NCPGS) AS c FROM predicted GROUP BY ALL),
gr AS (SELECT original_label, grg, sum(read_count)::BIGINT AS total FROM un GROUP BY ALL), ev AS (SELECT grg, row_number() OVER (ORDER BY grg) - 1 AS place FROM (SELECT DISTINCT grg FROM gr)),
gd AS (SELECT pb, k, row_number() OVER (PARTITION BY pb ORDER BY {_uniform('42', "'o'", 'pb', 'k')}, k) AS place, 1 + floor({_uniform('42', "'k'", 'pb')} * {CLASSES}) AS many FROM range(10) a(pb), range({CLASSES}) b(k)),
ch AS (SELECT pb, k, {_uniform('42', "'w'", 'pb', 'k')} + 1e-9 AS w FROM gd WHERE place <= many), ta AS (SELECT pb, k AS original_label, floor(w / sum(w) OVER (PARTITION BY pb) * 5000)::BIGINT AS n FROM ch),
dr AS (SELECT pb, original_label, floor({_uniform('42', "'g'", 'pb', 'original_label', 'j')} * (SELECT count(*) FROM ev))::BIGINT AS place FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM ta)),
dc AS (SELECT pb, original_label, grg, count(*) AS q FROM dr JOIN ev USING (place) GROUP BY ALL),
lo AS (SELECT pb, original_label, sum(q) AS lost FROM dc ANTI JOIN gr USING (original_label, grg) GROUP BY ALL), gs AS (SELECT original_label, count(*) AS many FROM gr GROUP BY ALL),
qu AS (SELECT ta.pb, ta.original_label, gr.grg, total, coalesce(q, 0) + floor(coalesce(lost, 0) / many)::BIGINT AS quota FROM ta JOIN gr USING (original_label) JOIN gs USING (original_label) LEFT JOIN dc USING (pb, original_label, grg) LEFT JOIN lo USING (pb, original_label)),
du AS (SELECT pb, original_label, grg, floor({_uniform('42', 'pb', 'original_label', 'grg', 'j')} * total)::BIGINT AS u FROM (SELECT *, unnest(range(1, quota + 1)) AS j FROM qu)),
ru AS (SELECT *, sum(read_count) OVER (PARTITION BY original_label, grg ORDER BY substr(md5(row_id), 1, 2), row_id) AS hi FROM un),
hi AS (SELECT pb, original_label, grg, p, c, count(*) AS times FROM du JOIN ru USING (original_label, grg) WHERE u < hi AND u >= hi - read_count GROUP BY pb, original_label, grg, row_id, p, c)
SELECT pb AS pb_index, grg, round(sum(greatest(c * times, 1e-10) * p) / sum(greatest(c * times, 1e-10)), 6) AS prediction_0_wavg, sum(times)::BIGINT AS n_reads FROM hi GROUP BY pb, grg""")
def simulated_mixtures(spark, sf_dir):
    """Ten mixtures drawn from the reads, their weighted predictions by group."""
    rows = predicted(spark, sf_dir).withColumn("row_id", F.concat_ws("/", "read_name", "name", "original_label")).withColumnRenamed("target_label", "grg")
    unique = settled(rows.groupBy("row_id", "original_label", "grg").agg(F.count("*").alias("read_count"), F.min("prediction_0").alias("prediction_0"), F.min("NCPGS").alias("NCPGS")))
    targets = simulation.target_proportions(spark, 10, CLASSES, 42)
    return rounded(simulation.pseudobulk(unique, targets, ["prediction_0"], "NCPGS", 5000, 42).select("pb_index", "grg", "prediction_0_wavg", "n_reads"))


from . import catalog_baselines  # noqa: E402, F401  (registers further queries)
