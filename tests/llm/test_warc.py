import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from readloom.llm import warc

PAGES = "page_id long, url string, html string"


def back(spark, rows):
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGES))
    return manifest, warc.read_archives(manifest)


def brute(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == best.get(h or "") else "revisit", None if i == best.get(h or "") else best.get(h or "")))
    return out


def test_types_digests_and_payloads(spark):
    rows = [(1, "http://a/\r\nx%", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "é😀\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 300_000), (7, "u", "same")]
    _, chunks = back(spark, rows)
    last = chunks.filter("last").collect()
    got = [(r.page_id, r.bytes_so_far, r.digest_so_far, r.record_type, r.refers_to) for r in last]
    assert sorted(got) == sorted(brute(rows))
    joined = chunks.filter("record_type = 'response'").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("c")).collect()
    texts = {r.page_id: b"".join(c["chunk"] for c in r.c).decode() for r in joined}
    assert texts == {4: "", 5: rows[4][2], 6: rows[5][2], 7: "same"}
    assert max(len(r.chunk) for r in chunks.collect()) <= warc.CHUNK


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "u", "b"), (None, "u", "a")]
    _, chunks = back(spark, rows)
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in chunks.filter("last").collect())
    assert got == sorted([("1", "response", "None"), ("1", "revisit", "1"), ("None", "response", "None"), ("None", "revisit", "1")])


def test_small_payloads_stay_responses(spark):
    manifest = warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES), least=3)
    got = {r.page_id: r.record_type for r in warc.read_archives(manifest).filter("last").collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archives_are_plain_gzip_members(spark):
    manifest, _ = back(spark, [(1, "http://x/", "hello"), (2, "http://y/", "hello")])
    raw = b"".join(gzip.open(r.file.removeprefix("file://")).read() for r in manifest.collect())
    assert raw.count(b"WARC/1.1\r\n") == 2
    assert b"WARC-Type: revisit" in raw and b"WARC-Target-URI: http://x/" in raw


def test_a_changed_payload_is_found():
    out = io.BytesIO()
    digest = base64.b32encode(hashlib.sha1(b"other").digest()).decode()
    record = warc.Record(out, 1, "u", digest, 5, None, False)
    record.add(b"hel")
    record.add(b"lo")
    with pytest.raises(ValueError):
        record.end()


def test_empty_table_and_clashing_columns(spark):
    _, chunks = back(spark, [])
    assert chunks.count() == 0
    rows = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, None, None)], PAGES).selectExpr("*", "1 as digest", "'x' as chunk", "2 as row", "3 as key", "4 as winner")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(rows)).filter("last").collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None)}


def test_chunk_rows(spark):
    texts = [None, "", "abc", "é😀" * 5, "x" * 12, "y" * 13]
    rows = spark.createDataFrame([(k, "u", t) for k, t in enumerate(texts)], PAGES)
    got = {}
    for r in sorted(warc.chunk_rows(rows, 4).collect(), key=lambda r: (r.page_id, r.chunk_no)):
        got.setdefault(r.page_id, []).append(bytes(r.chunk))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        assert got[k] == ([raw[i : i + 4] for i in range(0, len(raw), 4)] or [b""])


def test_hot_digests_and_identifiers(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    rows = [(k if k % 5 else None, "u", ("", None, "same", f"own{k}")[k % 4]) for k in range(60)]
    manifest, chunks = back(spark, rows)
    got = sorted(((r.page_id, r.bytes_so_far, r.digest_so_far, r.record_type, r.refers_to) for r in chunks.filter("last").collect()), key=str)
    nulls = {h for i, _, h in rows if i is None} - {h for i, _, h in rows if i is not None}
    want = [(i, n, d, "response" if i is None and h in nulls else t, r) for (i, n, d, t, r), (_, _, h) in zip(brute(rows), rows, strict=True)]
    assert got == sorted(want, key=str)
    raw = b"".join(gzip.open(r.file.removeprefix("file://")).read() for r in manifest.collect()).decode()
    names = [line.split(": ", 1)[1] for line in raw.split("\r\n") if line.startswith("WARC-Record-ID")]
    assert len(set(names)) == len(names) == len(rows)
    assert {line.split(": ", 1)[1] for line in raw.split("\r\n") if line.startswith("WARC-Refers-To")} <= set(names)
