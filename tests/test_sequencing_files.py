"""BAM and FASTA files that the tests write themselves."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from readloom.operators import alignments
from readloom.plans import tasks
from readloom.sources import bam, fasta

CONTIGS = [("chr1", 100_000), ("2", 5_000)]
CODES = {c: k for k, c in enumerate("=ACMGRSVTWYHKDBN")}
OPS = {c: k for k, c in enumerate("MIDNSHP=X")}


def record(name, flag, contig, pos, mapq, cigar, seq, mm=None, ml=None, extra=b""):
    ops = b"".join(struct.pack("<I", n << 4 | OPS[c]) for n, c in cigar)
    nibbles = [CODES[c] for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(nibbles[::2], nibbles[1::2], strict=True))
    tags = extra + (b"MMZ" + mm.encode() + b"\0" if mm is not None else b"") + (b"MLBC" + struct.pack("<i", len(ml)) + bytes(ml) if ml is not None else b"")
    body = struct.pack("<iiBBHHHiiii", contig, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(path, records, cut=None, rng=None):
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(CONTIGS))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in CONTIGS)
    data, out, at = head + b"".join(records), b"", 0
    while at < len(data):  # blocks end anywhere, inside of records too
        n = cut or rng.randint(1, 3000)
        out += block(data[at : at + n])
        at += n
    path.write_bytes(out + block(b""))


def made(n, seed=1, longest=300):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, longest)))
        cigar = [(len(seq), "M")] if seq else []
        contig = rng.choice([0, 0, 1, -1])
        out.append((f"read{k}", rng.choice([0, 16, 99, 147, 4, 1024]), contig, rng.randrange(4000) if contig >= 0 else -1, rng.randrange(60), cigar, seq, "C+m?,0,1;" if k % 3 else None, [k % 256, 7] if k % 3 else None))
    return out


@pytest.mark.parametrize("part,longest", [(500, 300), (5000, 300), (1 << 26, 300), (3000, 20_000)])
def test_every_record_once_whatever_the_ranges(spark, tmp_path, part, longest):
    rows = made(400 if longest < 1000 else 60, longest=longest)
    write_bam(tmp_path / "a.bam", [record(*r) for r in rows], rng=random.Random(2))
    got = bam.scan(spark, str(tmp_path / "a.bam"), part)
    names = [c[0] for c in CONTIGS]
    want = sorted((r[0], r[1], names[r[2]] if r[2] >= 0 else None, r[3] if r[3] >= 0 else None, r[3] + len(r[6]) if r[3] >= 0 else None, r[4], f"{len(r[6])}M" if r[6] else None, r[6] or None, r[7], r[8]) for r in rows)
    assert sorted(tuple(r)[1:] for r in got.collect()) == want
    assert got.rdd.getNumPartitions() == -(-(tmp_path / "a.bam").stat().st_size // part)


def test_folders_tags_and_broken_files(spark, tmp_path):
    extra = b"NMC\x05XAZabc\0XBBS" + struct.pack("<iHH", 2, 1, 2) + b"XFf\0\0\0\0"
    (tmp_path / "d").mkdir()
    for k in range(2):
        write_bam(tmp_path / "d" / f"{k}.bam", [record(f"r{k}", 0, 0, 10, 60, [(2, "S"), (3, "M"), (1, "I"), (2, "D"), (4, "M"), (5, "N"), (1, "X"), (3, "H")], "ACGTACGTACG", "C+m,0;", [9], extra)], cut=40)
    write_bam(tmp_path / "d" / "none.bam", [], cut=40)
    got = bam.scan(spark, str(tmp_path / "d")).orderBy("file").collect()
    assert [(r.file, r.read_name, r.read_end, r.cigar, r.mm, r.ml) for r in got] == [(f"{k}.bam", f"r{k}", 25, "2S3M1I2D4M5N1X3H", "C+m,0;", [9]) for k in range(2)]
    whole = (tmp_path / "d" / "0.bam").read_bytes()
    (tmp_path / "cut.bam").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "text.bam").write_bytes(block(b"no such thing at all"))
    for name in ("cut", "text"):
        with pytest.raises(ValueError):
            list(bam.records(str(tmp_path / f"{name}.bam"), 0, 1 << 20))
    with pytest.raises(FileNotFoundError):
        bam.listed(str(tmp_path / "nowhere"))


def test_parameters():
    assert alignments.parsing("ont", {"require_flags": 3, "merge_pairs": True}) == alignments.Parsing("ont", require=0, merge_pairs=False)
    assert alignments.parsing("wgbs").require == 3 and alignments.parsing("wgbs", {}, ["chr1"]).contigs == ("chr1",)
    assert alignments.parsing("ont", {"ont_methyl_tr": 200, "ont_unmethyl_tr": 50}).unmethylated == 50
    for bad in (("ont", {"ont_methyl_tr": 50, "ont_unmethyl_tr": 60}), ("other", {})):
        with pytest.raises(ValueError):
            alignments.parsing(*bad)


def test_long_reads(spark, tmp_path):
    def read(name, seq, ml, mm=None, flag=0, mapq=60):
        return record(name, flag, 0, 100, mapq, [(len(seq), "M")], seq, mm or "C+m?," + ",".join("0" for _ in ml) + ";", ml)

    rows = [read("a", "ACGTCGNACG", [200, 100, 20]), read("b", "ACGTTCGA", [200, 1], flag=16), read("short", "ACGACG", [5]), read("low", "ACG", [9], mapq=3), record("bare", 0, 0, 5, 60, [(3, "M")], "ACG"),
            read("both", "ACGACG", [100, 10, 100, 200], "C+m?,0,0;C+h?,0,0;"), read("alt", "ACG", [255], flag=256)]
    write_bam(tmp_path / "x.bam", rows, cut=100)
    raw = bam.scan(spark, str(tmp_path / "x.bam"))
    assert alignments.detect(raw) == "ont"
    p = alignments.parsing("ont", {"ont_methyl_tr": 150, "ont_unmethyl_tr": 50})
    got = {r.read_name: r for r in alignments.long_read_calls(alignments.passing(raw, p), p).collect()}
    assert {k: (r.seq, r.methylation_encoding, r.cpg_positions, r.meth_states) for k, r in got.items()} == {
        "a": ("ACGTCGNACG", "2122222202"[:1] + "1" + "22" + "2" + "2" + "22" + "0" + "2", [101, 104, 108], [1, 2, 0]),
        "b": ("TCGAACGT", "21222022", [101, 105], [1, 0]),
        "both": ("ACGACG", "222202", [101, 104], [2, 0]),
    }
    assert (got["a"].total_cpgs, got["a"].methylated_cpgs, got["a"].unmethylated_cpgs, got["a"].methylation_rate, got["b"].is_reverse) == (3, 1, 1, 0.5, True)
    q = alignments.parsing("ont", {"ont_methyl_tr": 150, "ont_unmethyl_tr": 50, "ont_combine_mods": True})
    assert {r.read_name: r.meth_states for r in alignments.long_read_calls(alignments.passing(raw, q), q).collect()}["both"] == [1, 1]
    with pytest.raises(ValueError):
        alignments.detect(raw.filter("flag = 4"))


def brute_calls(reference, start, bases, back):
    ref = reference[start : start + len(bases) + 1]
    ref = ref if len(ref) > len(bases) and ref.endswith("CG") else ref[: len(bases)]
    states = []
    for i in range(len(ref) - 1):
        if ref[i : i + 2] == "CG":
            base = bases[i + back : i + back + 1]
            states.append(1 if base == "CG"[back] else 0 if base == "TA"[back] else 2)
    return ref, states


def test_converted_reads_of_a_file(spark, tmp_path):
    rng = random.Random(5)
    reference = "".join(rng.choice("ACGCG") for _ in range(30_000))
    (tmp_path / "ref.fa").write_text(">chr1 first\n" + "\n".join(reference[k : k + 70] for k in range(0, 30_000, 70)) + "\n>chrOther\nACGT\n")
    rows, want = [], {}
    for k in range(200):
        start, n = rng.choice([rng.randrange(29_700), 4096 - rng.randrange(60)]), rng.randint(20, 150)
        bases = "".join({"C": rng.choice("CT"), "G": rng.choice("GA")}.get(c, c) for c in reference[start : start + n])
        flag = rng.choice([99, 147, 83, 163])
        rows.append(record(f"r{k}", flag, 0, start, 60, [(n, "M")], bases))
        ref, states = brute_calls(reference, start, bases, int(bool(flag & 16) != bool(flag & 128)))
        if states:
            want[f"r{k}"] = (ref, states)
    rows.append(record("unpaired", 0, 0, 50, 60, [(20, "M")], reference[50:70]))
    write_bam(tmp_path / "w.bam", rows, rng=rng)
    out = tasks.run(spark, "parse-alignments", {"input": str(tmp_path / "w.bam"), "reference": str(tmp_path / "ref.fa"), "output_dir": str(tmp_path / "out"), "part_bytes": 4000}).collect()
    assert {r.read_name: (r.seq, r.meth_states) for r in out} == want and {r.data_type for r in out} == {"wgbs"}
    for r in out:
        assert len(r.methylation_encoding) == len(r.seq) and [k for k, c in enumerate(r.seq[:-1]) if r.seq[k : k + 2] == "CG"] == [x - r.read_start for x in r.cpg_positions]
        assert [int(r.methylation_encoding[x - r.read_start]) for x in r.cpg_positions] == r.meth_states
    spark.createDataFrame([("chr1", 1, 2000)], "chr string, start long, end long").write.parquet(f"{tmp_path}/regions")
    some = tasks.run(spark, "parse-alignments", {"input": str(tmp_path / "w.bam"), "reference": str(tmp_path / "ref.fa"), "regions": f"{tmp_path}/regions", "output_dir": str(tmp_path / "some")}).collect()
    assert {r.read_name for r in some} == {r.read_name for r in out if r.read_start < 2000}
    write_bam(tmp_path / "single.bam", [rows[-1]], cut=50)  # no read is paired: once more without flags
    once = tasks.run(spark, "parse-alignments", {"input": str(tmp_path / "single.bam"), "data_type": "wgbs", "reference": str(tmp_path / "ref.fa"), "output_dir": str(tmp_path / "once")})
    assert [r.read_name for r in once.collect()] == ["unpaired"]
    with pytest.raises(ValueError):
        tasks.run(spark, "parse-alignments", {"input": str(tmp_path / "single.bam"), "chromosomes": ["chr2"], "reference": str(tmp_path / "ref.fa"), "data_type": "wgbs", "output_dir": str(tmp_path / "none")})
    assert alignments.recovered(once, "B cell").first().asDict() | {} == {"ref_name": "chr1", "ref_pos": 50, "original_seq": once.first().seq, "methyl_seq": once.first().methylation_encoding, "ctype": "B cell"}


def write_fasta(path, records, width=61):
    path.write_text("".join(f">{name}\n" + "".join(seq[k : k + width] + "\n" for k in range(0, len(seq), width)) for name, seq in records))


@pytest.mark.parametrize("split", ["200", "1000", "100000"])
def test_chunks_of_any_splits(spark, tmp_path, split):
    rng = random.Random(7)
    records = [(f"c{k} note {k}", "".join(rng.choice("acgtN") for _ in range(n))) for k, n in enumerate((0, 1, 99, 100, 101, 2500))]
    write_fasta(tmp_path / "x.fa", records)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        for overlap in (0, 7, 100):
            got = fasta.chunks(spark, str(tmp_path / "x.fa"), 100, overlap).collect()
            want = {(h.split()[0], k): (h.split(" ", 1)[1], s.upper()[k : k + 100 + overlap]) for h, s in records for k in range(0, len(s), 100)}
            assert {(r.record, r.start): (r.description, r.sequence) for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_cgs_of_spans(spark, tmp_path):
    rng = random.Random(3)
    seqs = {f"c{k}": "".join(rng.choice("ACGCG") for _ in range(n)) for k, n in enumerate((350, 100, 99))}
    write_fasta(tmp_path / "x.fa", list(seqs.items()))
    spans = [(rng.choice([*seqs, "none"]), a := rng.randrange(-5, 400), a + rng.randrange(-1, 300), k) for k in range(300)]
    table = spark.createDataFrame(spans, "contig string, start long, end long, k int")
    got = {r.k: r.n_cpgs for r in fasta.cg_counts(fasta.chunks(spark, str(tmp_path / "x.fa"), 100, 1), table, 100).collect()}
    want = {k: None if c == "none" else sum(seqs[c][i : i + 2] == "CG" for i in range(max(a, 0), max(min(b + 1, len(seqs[c])), 0))) for c, a, b, k in spans}
    assert got == want
    assert spark.range(1).select(fasta.unknown_cpgs(F.lit(5), F.lit(4), F.lit(3)).alias("x")).first().x == 0


def test_sentences(spark, tmp_path):
    rng = random.Random(4)
    records = [("chr1", "".join(rng.choice("ACGT") for _ in range(900))), ("chr9_alt", "ACGT" * 50)]
    lines = [records[0][1][k : k + 60] for k in range(0, 900, 60)]
    lines[4] = lines[4][:30] + "NNN" + lines[4][33:]
    records[0] = ("chr1", "".join(lines))
    write_fasta(tmp_path / "x.fa", records, 60)
    want, run, at = [], "", 0
    for k, line in enumerate(lines):  # a line with an N ends the run
        if "N" in line:
            run = ""
        else:
            at = at if run else 60 * k
            run += line
            while len(run) >= 50:
                want.append((at, " ".join(run[i : i + 3] for i in range(48))))
                run, at = run[50:], at + 50
    got = fasta.sentences(fasta.chunks(spark, str(tmp_path / "x.fa"), 128, 50, mask_lines=True), 3, 50, 128, ["CHR1"]).collect()
    assert sorted((r.start, r.sentence) for r in got) == want
