import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import bpe
from readloom.llm.queries import word_bpe
from tests.llm.helpers import docs, odd_texts, sample_docs


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe())


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(word_bpe())


def same(own, library, texts):
    for text, words, enc in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert [i for w in words for i in w[0]] == enc.ids, text[:80]
        assert " ".join(w[1] for w in words) == library.decode(enc.ids, skip_special_tokens=False)


def test_table_texts(own, library):
    same(own, library, [r[1] or "" for r in sample_docs()])


def test_odd_texts(own, library):
    same(own, library, ["", " ", "<|startoftext|>A<|endoftext|> <|Endoftext|>", "ΑΣ Σ ΟΔΟΣ", "it's DON'T", "a\x1cb\x85c", "é ﬁ", "日本語 😀", "İ ǅ", "a" * 5000, "!" * 999, "\x00", "२३½²", "ſȺ"])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(own, library, text):
    same(own, library, [text])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcehlnorst'", min_size=1, max_size=14), max_size=30))
def test_letters(own, library, words):
    same(own, library, [" ".join(words)])


def test_two_generations_of_words(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    for _ in range(4):
        same(own, library, ["some words that come again", "and others again", "some more words"])


def test_query_columns(spark, library):
    rows = docs(spark, odd_texts()).selectExpr("*", "1 as ids", "'x' as decoded", "2 as n_tokens", "'y' as ids_sha256", "'z' as decoded_sha256")
    got = bpe.digests(bpe.encode(rows.drop("lang", "source", "n_chars"), word_bpe())).collect()
    want = []
    for i, text, _ in odd_texts():
        ids = library.encode(text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.digests(bpe.encode(docs(spark, []).select("doc_id", "text"), word_bpe())).count() == 0


def test_workers_keep_the_vocabulary_only(spark):
    """What a task has learned is gone when it ends, so that later stages of a pipeline have the memory."""
    import pyarrow as pa

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t) for w in bpe._LOADED.values() for t in (w.known, w.before, w.jump, w.sound))])], ["n"])

    assert bpe.encode(docs(spark, odd_texts()).repartition(4), word_bpe()).count() == len(odd_texts())
    bpe.encode(docs(spark, odd_texts()).repartition(4), word_bpe()).write.format("noop").mode("overwrite").save()
    assert {r.n for r in spark.range(0, 64, 1, 4).mapInArrow(held, "n long").collect()} <= {0}


def test_words_are_learned_without_a_built_trie(own):
    """The walk goes over sorted words, so what learning holds beside its results is a path and the words' order, no nodes (op2 failed at 949 CPU seconds a GB)."""
    import random
    import tracemalloc

    draw = random.Random(3)
    words = {"".join(draw.choices("abcdehilnorst", k=9)) for _ in range(20000)}
    own.learn(words)  # pairs of tokens and steps are known from here on
    own.known.clear()
    tracemalloc.start()
    own.learn(words)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(own.known) == len(words)
    assert peak - held < 20 * len(words)


def test_a_known_word_is_its_ids_only(own):
    """What tokens say is in the vocabulary, so a table of words holds no texts beside them (pipeline was stopped at 3,000 MB of an executor)."""
    (words,) = own.encode(["some words, some <|endoftext|> more"])
    assert all(type(i) is int for ids in own.known.values() for i in ids)
    assert all(said == " ".join(own.text_of[i] for i in ids) for ids, said in words)
