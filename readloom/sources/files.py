"""Readers and writers of read, region and result files. Schemas are always given, never inferred."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import predictions
from ..operators import reads as read_ops

RECOVERED = "ref_name string, ref_pos long, original_seq string, methyl_seq string, ctype string"
PARSED = "read_name string, chromosome string, read_start long, seq string, methylation_encoding string"
REGION = ["chr", "start", "end", "target", "name"]
CHROMOSOMES = frozenset([*(f"chr{k}" for k in range(1, 23)), "chrX", "chrY"])


def recovered_reads(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated reads with the name of their file; patterns stay strings though they look like numbers."""
    return spark.read.csv(path, sep="\t", header=True, schema=RECOVERED).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def parsed_reads(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or tab-separated parsed reads in the common form, with the name of their file where they have none; without a name a read is named by a digest of its row."""
    raw = spark.read.csv(path, sep="\t", header=True, schema=PARSED) if ".csv" in path or path.endswith((".tsv", ".txt")) else spark.read.parquet(path)
    if "read_name" not in raw.columns:
        raw = raw.withColumn("read_name", F.md5(F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"})))
    if "file" not in raw.columns:
        raw = raw.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    named = raw.withColumnsRenamed({"seq": "input_ids", "methylation_encoding": "methylation_ids"})
    if "read_end" not in named.columns:
        named = named.withColumn("read_end", F.col("read_start") + F.length("input_ids") - 1)
    return named if "original_label" in named.columns else named.withColumn("original_label", F.lit(0))


def layout(spark: SparkSession, path: str) -> str:
    """'columnar' (region_bucket partitions or a split column) or 'legacy' (a file a split)."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(path)
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    if any(n.startswith("region_bucket=") for n in names):
        return "columnar"
    if any(n.startswith("train.") for n in names):
        return "legacy"
    if "split" in spark.read.parquet(path).columns:
        return "columnar"
    raise ValueError(f"no known layout at {path}")


def _legacy(spark: SparkSession, stem: str) -> DataFrame:
    """The first of stem.parquet, stem.csv and stem.txt (tab-separated) that is there. Text columns of text files stay strings."""
    for end, sep in (("parquet", None), ("csv", ","), ("txt", "\t")):
        fs, file = _paths(spark, f"{stem}.{end}")
        if fs.exists(file):
            return spark.read.csv(f"{stem}.{end}", sep=sep, header=True) if sep else spark.read.parquet(f"{stem}.{end}")
    raise FileNotFoundError(stem)


def predicted_reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads with predictions: Parquet with prediction_<k>, at least one."""
    rows = spark.read.parquet(path)
    if not predictions.prediction_columns(rows.columns):
        raise ValueError(f"no predictions in {path}")
    return rows


def target_proportions(spark: SparkSession, path: str) -> DataFrame:
    """(pb_index, original_label, target): stored targets; negative ones, or mixtures that do not sum to 1, raise."""
    rows = spark.read.schema("pb_index long, original_label int, target double").parquet(path)
    bad = rows.groupBy("pb_index").agg(F.sum("target").alias("s"), F.min("target").alias("least")).filter("abs(s - 1) > 1e-6 or least < 0").take(1)
    if bad:
        raise ValueError(f"mixture {bad[0].pb_index} is no set of proportions")
    return rows


def calibrated_predictions(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    """(method, sample, cell_type, target, predicted, calibrated) of one deconvolver or all; the filter reaches the scan."""
    rows = spark.read.parquet(path).select("method", "sample", "cell_type", "target", "predicted", "calibrated")
    return rows.filter(F.col("method") == method) if method is not None else rows


def count_atlas(spark: SparkSession, path: str, cell_types: list[str]) -> DataFrame:
    """(chromosome, name, start, end, original_label, meth, cov, beta) of a wide tab-separated atlas with <cell type>_METH and _COV; the label is the place in cell_types, beta null without coverage."""
    fixed = "CHROM string, START long, END long, name string" + "".join(f", `{c}_METH` long, `{c}_COV` long" for c in cell_types)
    wide = spark.read.csv(path, sep="\t", header=True, schema=fixed, nullValue="NA")
    each = F.array(*[F.struct(F.lit(k).alias("original_label"), F.coalesce(f"{c}_METH", F.lit(0)).alias("meth"), F.coalesce(f"{c}_COV", F.lit(0)).alias("cov")) for k, c in enumerate(cell_types)])
    long = wide.select(F.col("CHROM").alias("chromosome"), "name", F.col("START").alias("start"), F.col("END").alias("end"), F.inline(each))
    return long.withColumn("beta", F.try_divide(F.col("meth").cast("double"), F.col("cov").cast("double")))


def split_rows(spark: SparkSession, path: str, split: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of one split; the filter and the columns reach the scan."""
    if layout(spark, path) == "columnar":
        rows = spark.read.parquet(path).filter(F.col("split") == split)
    else:
        rows = _legacy(spark, f"{path}/{split}")
    return rows.select(*columns) if columns else rows


def training_rows(spark: SparkSession, path: str, split: str, required: list[str], min_cpgs: int = 0, distinct: bool = True) -> DataFrame:
    """Rows of a split for a fit: required columns tested, NCPGS derived where it is missing, reads with fewer than min_cpgs known positions gone, equal ones as one with read_count."""
    rows = read_ops.with_informative(read_ops.require(split_rows(spark, path, split), required)).filter(F.col("NCPGS") >= min_cpgs)
    if not rows.take(1):
        raise FileNotFoundError(f"no rows of split {split!r} at {path}")
    return read_ops.deduplicate(rows, [*dict.fromkeys([*required, "NCPGS"])]) if distinct else rows


def atlas(spark: SparkSession, path: str, cell_types: list[str], include: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """A region table: tab-separated, regions of known chromosomes whose target is a cell type, minus ignored targets."""
    fixed = "chr string, start long, end long, startCpG long, endCpG long, target string, name string, direction string"
    rows = spark.read.csv(path, sep="\t", header=True, schema=fixed + "".join(f", `{c}` double" for c in cell_types), nullValue="NA", enforceSchema=False)
    check_regions(rows)
    rows = rows.filter(F.col("target").isin(*(include or cell_types)))
    return rows.filter(~F.col("target").isin(*ignore)) if ignore else rows


def check_regions(rows: DataFrame) -> DataFrame:
    """Raise for missing columns, unknown chromosomes and directions other than U and M."""
    if missing := [c for c in REGION if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    bad = rows.filter(~F.col("chr").isin(*CHROMOSOMES)).select("chr").distinct().take(5)
    if bad:
        raise ValueError(f"unknown chromosomes: {', '.join(str(r.chr) for r in bad)}")
    if "direction" in rows.columns and rows.filter(~F.col("direction").isin("U", "M")).take(1):
        raise ValueError("directions are U and M")
    return rows


def marker_tables(tables: list[DataFrame]) -> DataFrame:
    """One region table of several marker tables: '#chr' and 'region' renamed, hypo and hyper as U and M, of equal names the first table's row."""
    out = None
    for k, t in enumerate(tables):
        named = t.withColumnsRenamed({"#chr": "chr", "region": "name"})
        named = named.withColumn("chr", F.when(F.col("chr").startswith("chr"), F.col("chr")).otherwise(F.concat(F.lit("chr"), "chr")))
        if "direction" in named.columns:
            named = named.withColumn("direction", F.when(F.lower("direction") == "hypo", "U").when(F.lower("direction") == "hyper", "M").otherwise(F.col("direction")))
        named = named.withColumn("_table", F.lit(k))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("name").orderBy("_table", "chr", "start", "end"))
    return out.withColumn("_k", first).filter("_k = 1").drop("_k", "_table")


def write_buckets(rows: DataFrame, path: str) -> None:
    """Parquet by region_bucket, rows sorted by name within a file; the key stays a column too.

    Files are ranges of (bucket, name, start), so a bucket, or a name with most of the rows, is as many tasks and files as it needs.
    """
    order = ["region_bucket", "name", *(c for c in ("read_start",) if c in rows.columns)]
    rows.withColumn("bucket", F.col("region_bucket")).repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("region_bucket").parquet(path)


def _paths(spark: SparkSession, *paths: str) -> tuple:
    """The file system of the first path, and all as its paths."""
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), *found


def _moved(spark: SparkSession, side: str, path: str) -> None:
    fs, source, target = _paths(spark, side, path)
    if fs.exists(target):
        fs.delete(source, True)
        raise FileExistsError(path)
    if not fs.rename(source, target):
        raise OSError(f"{side} could not be renamed to {path}")


def publish(rows: DataFrame, path: str, **options: str) -> None:
    """Write beside the target and rename, so that readers see all or nothing."""
    side = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.options(**{"compression": "zstd", **options}).parquet(side)
    _moved(rows.sparkSession, side, path)


def write_store(spark: SparkSession, path: str, tables: dict[str, DataFrame], attributes: dict | None = None) -> None:
    """A store: one Parquet folder a table (zstd at level 9) and a manifest.json with schemas, row numbers and attributes; all appear at once."""
    side = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    listed = {}
    for name, rows in sorted(tables.items()):
        rows.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}).parquet(f"{side}/{name}")
        listed[name] = {"columns": dict(rows.dtypes), "rows": spark.read.parquet(f"{side}/{name}").count()}
    fs, file = _paths(spark, f"{side}/manifest.json")
    out = fs.create(file)
    out.write(bytearray(json.dumps({"tables": listed, "attributes": attributes or {}}, sort_keys=True).encode()))
    out.close()
    _moved(spark, side, path)


def store_kind(spark: SparkSession, path: str) -> str:
    """'columnar' for a folder with a manifest; ValueError for HDF5 files, which no reader here takes, and for all else."""
    fs, root, manifest = _paths(spark, path, f"{path.rstrip('/')}/manifest.json")
    if not fs.exists(root):
        raise FileNotFoundError(path)
    if fs.exists(manifest):
        return "columnar"
    raise ValueError(f"HDF5 stores are not read: {path}" if path.endswith((".h5", ".hdf5")) else f"no store at {path}")


def read_store(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """(tables by name, attributes); a table whose columns differ from the manifest raises."""
    store_kind(spark, path)
    manifest = json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])
    tables = {}
    for name, want in manifest["tables"].items():
        tables[name] = spark.read.parquet(f"{path}/{name}")
        if dict(tables[name].dtypes) != want["columns"]:
            raise ValueError(f"{path}/{name} is not as its manifest says")
    return tables, manifest["attributes"]


def write_sheet(rows: DataFrame, path: str, places: int = 4) -> None:
    """Results as CSV with a header, numbers rounded, ordered by their keys (columns that are no decimals); nulls are empty."""
    rounded = [F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*rounded).orderBy(*[c for c, t in rows.dtypes if t not in ("double", "float")]).write.csv(path, header=True)


def proportions_sheet(rows: DataFrame, names: DataFrame, classifier: str, calibrator: str | None = None) -> DataFrame:
    """(FileName, CellType, Classifier, Deconvolver, Calibrator, PredictedProportion) of proportions (sample, cell_type, method, proportion); names: label, cell_type. A calibrator column of rows stands before the argument."""
    called = names.select(F.col("label").alias("cell_type"), F.col("cell_type").alias("CellType"))
    kind = F.col("calibrator") if "calibrator" in rows.columns else F.lit(calibrator)
    return rows.join(F.broadcast(called), "cell_type").select(
        F.col("sample").cast("string").alias("FileName"), "CellType", F.lit(classifier).alias("Classifier"), F.col("method").alias("Deconvolver"), kind.cast("string").alias("Calibrator"), F.col("proportion").alias("PredictedProportion")
    )  # a row a cell type is broadcast


def listed_files(files: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files that groups list, files that it does not, listed ones that are not there), by file."""
    named = groups.select("file").distinct()
    return files.join(named, "file", "left_semi"), files.join(named, "file", "left_anti"), named.join(files, "file", "left_anti")


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated with NA for null."""
    rows.write.csv(path, sep="\t", header=True, nullValue="NA")


def write_results(rows: DataFrame, path: str) -> None:
    """Results by model and split."""
    rows.write.partitionBy("model", "split").parquet(path)


def dense_predictions(rows: DataFrame, keys: tuple[str, str] = ("pb_index", "cell_type")) -> DataFrame:
    """Stored predictions checked: no key twice, every cell type for every mixture; returned wide."""
    if rows.groupBy(*keys).count().filter("count > 1").take(1):
        raise ValueError("a mixture has a cell type twice")
    values = [c for c in rows.columns if c not in (*keys, "target_proportion", "split")]
    if len(values) != 1:
        raise ValueError(f"one prediction column is expected, not {values}")
    types = [r[0] for r in rows.select(keys[1]).distinct().orderBy(keys[1]).collect()]
    wide = rows.groupBy(keys[0]).pivot(keys[1], types).agg(F.first(values[0]))
    if wide.filter(" or ".join(f"`{t}` is null" for t in types)).take(1):
        raise ValueError("a mixture lacks a cell type")
    return wide
