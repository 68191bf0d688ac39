"""Small tables for the tests of the training-data operators."""

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = r"[^\x20\x09-\x0D]+"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def odd_texts():
    """Null, empty, blank, ties, repeats, and a long one."""
    long = " ".join(f"w{k % 977}" for k in range(40_000))
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "same words here", "b"), (4, "same words here", "b"), (5, "same words here", "b"), (None, "no id at all", "c"), (6, long, "c"), (7, "ein Wört für dich 😀 \x0b x", "a"), (8, "x", "")]


def sample_docs(n=200):
    return duckdb.sql(f"select doc_id, text, lang, source, n_chars from '{SF}/documents.parquet' order by doc_id limit {n}").fetchall()
