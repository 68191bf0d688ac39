"""From raw documents to encoded training rows: five stages, each written and read again by the next.

Counted as part of the subpackage readloom.llm. All stages but the last return the columns of documents; other
columns, whatever their names, are left out. Texts of any length are read whole. An empty table gives an empty table
at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm import bpe, mixing, quality, simhash, toxicity
from readloom.llm.common import noted_folders, remove_folders, settle, settle_wide
from readloom.llm.queries import table, word_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram ratio keep.

    Null and empty texts have no words and go, as all with fewer than 50. Repeated rows and null ids are each judged;
    a null id is never a trusted one. Without trusted labels the ratio is 0 and the base rules decide alone.
    """
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), weights).filter("kept").select(*COLUMNS)


def toxic_words(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon does not call toxic.

    Null and empty texts have score 0 and stay. Repeated rows and null ids are each judged; a score at the border, 0.7,
    is toxic. Without labels of both kinds every score is 0 and all stay.
    """
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), lexicon).filter("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest doc_id (of repeated ids, one; null ids lose against any other).

    Null, empty and blank texts have fingerprint 0 and are linked like any other, so one of them stays at most.
    """
    numbered = settle_wide(docs.select(*COLUMNS).withColumn("rid", F.monotonically_increasing_id()))
    prints = settle(simhash.with_fingerprints(numbered.select("rid", "doc_id", "text")))
    grouped = simhash.groups(prints)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid"))
    kept = grouped.groupBy("root").agg(first.alias("first")).select("first.rid")
    return numbered.join(kept, "rid", "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents as often, and with the words, as it takes them.

    Texts without words (null, empty, blank) are never taken. A null source is a source, the last. Repeated rows and null
    ids each count; rows that agree in id, text and source are interchangeable.
    """
    return mixing.mixed_documents(docs.select(*COLUMNS))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text, beside the other columns of documents.

    Null and empty texts have no ids and the digests of the empty string. Repeated rows and null ids each give a row.
    """
    encoded = bpe.encode(docs.select(*COLUMNS), word_bpe())
    return bpe.digests(encoded.withColumn("token_ids", F.col("ids")))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_words),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written as Parquet in the shared folder and read as the next one's docs.

    What a stage read and wrote on its way is removed when its result is written; the result of the last but one, which the last one
    reads, stays.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with noted_folders() as made:
            docs = settle_wide(stage(spark, docs, sf_dir))
        remove_folders(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs
