import hashlib

import corpus_pipeline as p
from readloom.llm import quality, toxicity
from readloom.llm.queries import table
from tests.llm.helpers import DOCS, SF, docs, odd_texts
from tests.llm.test_bpe import bpe, word_bpe
from tests.llm.test_mixing import brute_targets, sizes_of
from tests.llm.test_quality import brute
from tests.llm.test_simhash import brute_groups, brute_print


def test_stages_against_brute_force(spark):
    rows = table(spark, SF, "documents")
    first = p.quality_rules(spark, rows, SF).cache()
    weights = quality.fit(rows, table(spark, SF, "labels"))
    llr = {r.doc_id: r.llr for r in quality.score(rows, weights).collect()}
    want = {r.doc_id for r in rows.collect() if (b := brute(r.text))[0] >= 50 and 100 * b[4] <= 50 * b[0] and llr[r.doc_id] >= quality.THRESHOLD}
    assert {r.doc_id for r in first.collect()} == want

    second = p.toxic_words(spark, first, SF).cache()
    lexicon = toxicity.fit(first, table(spark, SF, "labels"))
    assert {r.doc_id for r in second.collect()} == {r.doc_id for r in first.collect() if lexicon.score(lexicon.rate(r.text)) < 0.7}

    third = p.near_duplicates(spark, second, SF).cache()
    groups = brute_groups([(r.doc_id, brute_print(r.text)) for r in second.collect()])
    assert sorted(r.doc_id for r in third.collect()) == sorted(set(groups.values()))

    fourth = p.mix_sources(spark, third, SF).cache()
    assert first.columns == second.columns == third.columns == fourth.columns == p.COLUMNS
    want, got = brute_targets(sizes_of(third.collect())), sizes_of(fourth.collect())
    assert all(abs(got[s] - t) <= 128 for s, t in want.items())

    last = p.encode_texts(spark, fourth, SF).collect()
    own = bpe.WordBpe(word_bpe())
    texts = [r.text for r in fourth.collect()]
    assert sorted(tuple(r.token_ids) for r in last) == sorted(tuple(i for w in words for i in w[0]) for words in own.encode(texts))


def test_odd_documents_pass_every_stage(spark):
    rows = docs(spark, [*odd_texts(), (9, " ".join(f"word{k} and" for k in range(90)), None), (9, " ".join(f"word{k} and" for k in range(90)), None)]).selectExpr("*", "1 as rid", "2 as fp", "3 as score")
    for _, stage in p.STAGES:
        assert stage(spark, rows, SF).count() >= 0
    empty = spark.createDataFrame([], DOCS)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_what_odd_documents_become(spark):
    plain = " ".join(f"word{k} and" for k in range(90))
    rows = docs(spark, [*odd_texts(), (9, plain, None), (9, plain, None), (None, plain, "d")]).selectExpr("*", "1 as rid", "2 as fp", "3 as score", "4 as kept", "5 as root", "6 as length")
    ids = lambda df: sorted((str(r.doc_id), len((r.text or "").split())) for r in df.collect())
    kept = {(i, n) for i, n in ids(p.quality_rules(spark, rows, SF))}
    assert kept <= {("9", 180), ("None", 180)}  # all others have fewer than 50 words, or repeat themselves
    assert len(ids(p.toxic_words(spark, rows, SF))) == rows.count()
    assert [x for x in ids(p.near_duplicates(spark, rows, SF)) if x[0] in "123459None"] == [("1", 0), ("4", 3), ("9", 180), ("None", 4)]
    mixed = p.mix_sources(spark, rows, SF).collect()
    assert mixed and not any(r.doc_id in (1, 2, 3) for r in mixed) and {r.source for r in mixed} >= {None, "a", "b", "c", "d"}
    coded = p.encode_texts(spark, rows, SF).collect()
    assert len(coded) == rows.count()
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256, r.token_ids) == (0, nothing, nothing, []) for r in coded if r.doc_id in (1, 2, 3))


def test_one_of_each_group_stays(spark):
    same = [(3, "a b c d e", "x"), (2, "a b c d e", "x"), (2, "a b c d e", "x"), (None, "a b c d e", "x"), (None, "only this one", "y"), (None, "only this one", "y")]
    got = p.near_duplicates(spark, docs(spark, same), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("2", "a b c d e"), ("None", "only this one")]


def test_a_run_leaves_the_last_stage_input_only(spark):
    """The stages one by one, each written and read again, give what run() gives; of what was written on the way one table is left."""
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.glob("readloom-*"))
    got = p.run(spark, SF)
    left = set(folder.glob("readloom-*")) - before
    rows = sorted((r.doc_id, r.ids_sha256) for r in got.collect())
    assert len(left) == 1 and rows
    docs_ = table(spark, SF, "documents")
    for _, stage in p.STAGES:
        docs_ = p.settle_wide(stage(spark, docs_, SF))
    assert sorted((r.doc_id, r.ids_sha256) for r in docs_.collect()) == rows
