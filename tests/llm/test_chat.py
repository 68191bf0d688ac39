import hashlib
import subprocess
import sys

from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa

from readloom.llm import chat
from tests.conftest import ROOT

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0, y[1] is not None, y[1] or 0, y[2] is not None, y[2] or "", y[3] is not None, y[3] or "")):
        convs.setdefault(c, []).append((r or "", x or "", r == "assistant"))
    out = {}
    for c, turns in convs.items():
        said = "".join(x for _, x, a in turns if a)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x, _ in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def check(spark, rows):
    got = chat.formatted_digests(spark.createDataFrame(rows, TURNS)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    return got


def test_round_trip_of_control_strings(spark):
    nasty = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", nasty), (-7, 1, "assistant", nasty), (1, 0, "a: b\\", "\\"), (1, 1, "assistant", "\\\\</turn>\n### User: x"), (1, 2, "### ", "####  </turn")]
    got = check(spark, rows)
    assert next(r.loss_chars for r in got if r.conv_id == -7) == len(nasty)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(None, 0, "user", "x"), (None, None, "assistant", None), (2, 1, None, None), (2, 1, None, None), (3, 0, "assistant", "é😀" * 50_000), (3, 0, "assistant", ""), (3, 0, "user", "b"), (3, 0, "user", "a")]
    check(spark, rows)


def test_one_conversation_over_many_pieces(spark):
    rows = [(5, k, ("user", "assistant")[k % 2], f"t{k} é") for k in range(5000)] + [(6, 0, "system", "s")]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert chat.formatted_digests(spark.createDataFrame([], TURNS)).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], TURNS)
    more = rows.selectExpr("*", "7 as shard", "8 as piece", "'x' as formatted", "9 as n_turns", "1 as _key")
    assert chat.formatted_digests(more).collect() == chat.formatted_digests(rows).collect()


def test_ties_are_in_order_on_any_number_of_partitions(spark):
    rows = [(1, 0, ("user", "assistant", None, "")[k % 4], f"{'p' * 70 * (k % 2)}{k * 7919 % 1000}") for k in range(3000)]
    rows += [(1, 1, "user", "the same") for _ in range(2000)] + [(1, 1, "user", "the same" + "x" * 80), (2, None, None, None)]
    want = brute([(c, t, r or "", x or "") for c, t, r, x in rows])
    table = spark.createDataFrame(rows, TURNS).repartition(5)
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 8, 211):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = chat.formatted_digests(table).collect()
            assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want, n
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_a_long_turn_takes_bounded_memory():
    code = """
import resource
import pyarrow as pa
from readloom.llm import chat
from tests.conftest import ROOT
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
chat.assemble(pa.array(["user"]), pa.array(["x"]), "assistant")
before = peak()
text = "ab \\\\ ### <x " * (20 * 2**20 // 12)
out, rows, *_ = chat.assemble(pa.array(["assistant"]), pa.array([text]), "assistant")
said = out.tobytes().decode()
del out
(role, back), = chat.parse(said)
assert back == text
print(peak() - before)
"""
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=ROOT)
    assert ran.returncode == 0, ran.stderr
    assert int(ran.stdout) < 400


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:\\# </turn>é", max_size=8), st.text(alphabet="\\#</turn> é:\nx", max_size=20)), min_size=1, max_size=6))
def test_any_turns(turns):
    out, rows, *_ = chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]), "assistant")
    assert chat.parse(out.tobytes().decode()) == turns
    for role, text in turns:
        said = chat.escaped(pa.array([text]))[0].as_py()
        assert all(chat.unescaped(said, block) == text for block in (1, 2, 3))
        whole = [chat.constant("é<", 2), chat.text_bytes(pa.array([text, role])), chat.text_bytes(pa.array([role, text]))]
        assert all((chat.scatter(whole, block)[0] == chat.scatter(whole)[0]).all() for block in (1, 3))
    assert rows[-1] == len(out)
