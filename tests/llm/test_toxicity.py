import random
import zlib

import duckdb

from readloom.llm import toxicity
from readloom.llm.queries import op7_toxicity
from tests.llm.helpers import SF as SMALL
from tests.llm.helpers import docs, odd_texts

SF = "/root/testdata/sf0.01"


def test_folding():
    assert toxicity.folded("1D10T") == toxicity.folded("idiot") == toxicity.folded("іdіоt")
    assert toxicity.folded("L0$er!!") == toxicity.folded("loser")
    assert toxicity.folded(None) == toxicity.folded(" .. ") == " "


def test_rates_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.folded("clown"): 2.0, toxicity.folded("trash")[:5]: 1.0})
    assert lexicon.rate("you clown there now") == 2.0 / 4
    assert lexicon.rate("a clown fish here") == 0.0
    assert lexicon.rate("trashy talk") == 1.0 / 2
    assert lexicon.rate("") == lexicon.rate(None) == 0.0
    assert lexicon.score(0.0) == 0.0 and lexicon.score(lexicon.middle) == toxicity.CUT
    once = lexicon.rate("clown " + "word " * 99)
    assert lexicon.rate("clown " * 50 + "word " * 50) <= 4 * once


def brute_rate(text, weights, exceptions):
    """The rate by looking at every word for every term and phrase."""
    words = toxicity.folded(text).split()
    hit = [max((w for t, w in weights.items() if (t == f" {x} " if t.endswith(" ") else x.startswith(t[1:]))), default=None) for x in words]
    for phrase in exceptions:
        said = toxicity.folded(phrase).split()
        for k in range(len(words) - len(said) + 1):
            if words[k : k + len(said)] == said:
                hit[k : k + len(said)] = [None] * len(said)
    total, n, seen, passage = 0.0, len(words), set(), []
    for x, w in zip(words, hit, strict=True):
        passage.append(x)
        if w is not None:
            key = tuple(passage)
            if key in seen:
                n -= len(passage)
            else:
                seen.add(key)
                total += w
            passage = []
    return total / max(1, n)


def test_rates_against_brute_force():
    rng = random.Random(7)
    words = ["clown", "clowns", "fish", "trash", "trashy", "can", "idiot", "1d10t", "a", "b", "CLOWN!", "pond", "scum", "so-and-so", "x" * 40]
    weights = {toxicity.folded(t): w for t, w in (("clown", 2.0), ("idiot", 1.5), ("b", 0.5), ("x" * 40, 3.0))} | {" tras": 1.0, " ciow": 0.25, " scum": 0.75}
    lexicon = toxicity.Lexicon(weights, exceptions=("clown fish", "trash can", "pond scum", "a b a"))
    for _ in range(2000):
        text = "".join(rng.choice(words) + rng.choice((" ", ", ", "\n", ". ")) for _ in range(rng.randint(0, 14)))
        assert abs(lexicon.rate(text) - brute_rate(text, weights, lexicon.exceptions)) < 1e-12, text


def test_the_query_against_brute_force(spark):
    table, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    lexicon = toxicity.fit(table, labels)
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in op7_toxicity(spark, SMALL).collect()}
    rows = table.collect()
    assert len(got) == len(rows)
    for r in rows:
        rate = brute_rate(r.text, lexicon.weights, lexicon.exceptions)
        score = 0.0 if not rate else 0.7 * rate**2 / (0.7 * rate**2 + 0.3 * lexicon.middle**2)
        assert abs(got[r.doc_id][0] - score) < 1e-9 and got[r.doc_id][1:] == (int(got[r.doc_id][0] >= 0.7), zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_exceptions_are_learned(spark):
    rows, labels = [], []
    for k in range(1500):
        bad, fish = k % 10 == 0, k % 10 == 5
        said = "you grunkler go" if bad else "the grunkler fish swims" if fish and k % 20 == 5 else ""
        rows.append((k, " ".join([*(f"word{(k * 7 + j * j) % 211}" for j in range(10)), said, *(f"word{(k * 3 + j) % 97}" for j in range(10))]), "a"))
        labels.append((k, 1, int(bad)))
    lexicon = toxicity.fit(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), exceptions=())
    assert toxicity.folded("grunkler fish") in lexicon.exceptions
    assert not any("you" in x or " go " in x for x in lexicon.exceptions)
    assert lexicon.rate("a grunkler fish here") == 0.0 < lexicon.rate("you grunkler")


def test_terms_of_any_length():
    long = "w" * 60
    assert {" a ", " ox ", f" {long} ", " wwww"} <= toxicity.terms(f"a ox {long}")


def test_repeated_abuse_is_toxic():
    lexicon = toxicity.Lexicon({toxicity.folded("clown"): 2.0, toxicity.folded("moron"): 1.0}, middle=0.1)
    for said in ("clown ", "you are a clown. ", "you clown, you utter moron! "):
        once = lexicon.rate(said)
        for n in (2, 100, 1000, 20_000):
            assert lexicon.rate(said * n) == once and lexicon.score(lexicon.rate(said * n)) >= toxicity.CUT, (said, n)
    assert lexicon.rate("you clown and what a clown") == 2 * 2.0 / 6  # other words before it: said twice
    long = "word " * 400
    rates = [lexicon.rate(long + "clown " * n) for n in (1, 3, 30, 3000)]
    assert rates == sorted(rates)
    assert lexicon.rate("".join(f"n{k} clown " for k in range(100))) == 1.0


def test_held_out_accuracy(spark):
    rows = op7_toxicity(spark, SF).toPandas()
    labels = duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").df()
    held = rows[rows.held_out].merge(labels, on="doc_id")
    hit = held[(held.toxic == 1)].predicted.mean()
    false = held[(held.toxic == 0)].predicted.mean()
    assert hit >= 0.7 and false <= 0.02
    assert rows.score.between(0, 1).all()


def test_labels_of_the_held_out_third_are_not_read(spark):
    from pyspark.sql import functions as F

    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(d, labels).weights == toxicity.fit(d, flipped).weights


def test_fit_at_low_prevalence_with_flipped_labels(spark, caplog):
    slurs = ["grunkler", "vostenpuk", "dramfitzer", "quolbeast"]
    rows, labels = [], []
    for k in range(3000):
        bad = k % 100 == 0  # 1 %
        said = [slurs[(k // 100) % 3], slurs[(k // 100 + 1) % 3], *([slurs[3]] if k % 900 == 0 else [])] if bad else []
        rows.append((k, " ".join([*(f"word{(k * 7 + j * j) % 211}" for j in range(20)), *said]), "a"))
        labels.append((k, 1, int(bad != (k % 700 == 0 or k % 997 == 5))))  # some of either kind are labelled wrong
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table = docs(spark, rows)
    lexicon = toxicity.fit(table, frame)
    assert all(toxicity.folded(x) in lexicon.weights for x in slurs)
    got = {r.doc_id: r.predicted for r in toxicity.score(table, lexicon).collect()}
    assert sum(got[k] for k in range(0, 3000, 100)) == 30 and sum(got.values()) <= 35
    assert not caplog.records
    assert toxicity.fit(table, frame.withColumn("toxic", (frame.doc_id % 2).cast("int"))).weights == {} and "every score is 0" in caplog.text


def test_odd_rows(spark):
    rows = docs(spark, odd_texts()).selectExpr("*", "1 as score", "2 as rate", "3 as predicted")
    labels = spark.createDataFrame([(6, 1, 0), (7, 1, 1), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(rows, labels)
    got = toxicity.score(rows, lexicon).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    empty = toxicity.fit(docs(spark, []), labels.limit(0))
    assert empty.weights == {} and toxicity.score(docs(spark, []), empty).count() == 0


def test_counts_passed_on_in_parts_are_the_same(spark):
    rows = spark.createDataFrame([(f"word{k % 7} other{k % 3} {t}", k % 2) for k, t in enumerate("abcdefgh" * 4)] + [(None, 1), ("", 0)], "text string, toxic int").coalesce(1)
    whole = {tuple(r) for r in toxicity.counted(rows, toxicity.terms, ["term"]).collect()}
    assert whole and {tuple(r) for r in toxicity.counted(rows, toxicity.terms, ["term"], most=5).collect()} == whole
