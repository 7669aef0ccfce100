"""Alignment files, paths, the command line and the streaming forms."""

import ast
import json
import logging
import os
import random

import pytest
from pyspark.sql import Row

from quillon import cli
from quillon.operators.pairing import confirmed
from quillon.plans.merge import merge
from quillon.plans.sinks import classified
from quillon.schema import READS, MergeParams, SinksParams
from quillon.sources import alignments, paths
from quillon.streaming.merge import RunningMerge
from quillon.streaming.pairing import confirmed_stream
from tests.test_flows import APER, CAG, GATA, reads


@pytest.fixture(scope="module")
def some_reads(spark):
    r, rows = random.Random(2), []
    for i in range(3000):
        s = r.choice((CAG, GATA, APER, "", "ACGTN" * 20))
        cigar = r.choice((f"{len(s)}M", "*", "5S10M2D3I8M")) if s else "*"
        end = {"*": 0, "5S10M2D3I8M": 20}.get(cigar, len(s))
        pos = r.randint(0, 9000)
        qual = bytearray(r.choice((5, 40, 0)) for _ in s)
        rows.append(("x", i, f"read{r.randint(0, 1500)}", r.choice((65, 129, 73, 4, 257)), r.choice((0, 1)), pos, r.choice((0, 10, 40, 45, 60)), cigar, r.choice((-1, 0, 1)), r.randint(-1, 9000), s, qual, pos + end))
    return spark.createDataFrame(rows, READS)


@pytest.fixture(scope="module")
def two_contigs(spark):
    return spark.createDataFrame([(0, "chr1", 10000), (1, "chr2", 20000)], "tid int, name string, length long")


VALUES = [c for c in READS.names if c not in ("file_id", "ord")]


def plain(rows):
    return [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in rows]


@pytest.mark.parametrize("kind", ["bam", "sam"])
def test_round_trip_in_splits(spark, some_reads, two_contigs, tmp_path, kind):
    path = str(tmp_path / f"a.{kind}")
    getattr(alignments, f"write_{kind}")(some_reads, two_contigs, path)
    want = plain(some_reads.orderBy("tid", "pos", "ord").select(*VALUES).collect())
    for split in (1 << 30, 20_000, 3_000):
        got = alignments.read_alignments(spark, path, split_bytes=split)
        assert got.rdd.getNumPartitions() > 1 or split == 1 << 30
        rows = plain(got.orderBy("ord").select(*VALUES).collect())
        if kind == "sam":  # an empty read has no qualities to tell
            rows = [(*r[:9], r[9], r[10]) for r in rows]
        assert rows == want
    assert alignments.header_text(path) == "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:10000\n@SQ\tSN:chr2\tLN:20000\n"
    assert [tuple(r) for r in alignments.contigs_of(spark, path).collect()] == [(0, "chr1", 10000), (1, "chr2", 20000)]


@pytest.mark.parametrize("sizes", [(100, 300), (100, 120_000), (500_000,), (100, 70_000, 500_000, 0)])
def test_long_reads_in_splits(tmp_path, sizes):
    """Records longer than a block, and than a split: the splits give each once, whatever their size."""
    r = random.Random(len(sizes) + sizes[-1])
    rows = []
    for i in range(60 if max(sizes) < 500_000 else 14):
        n = r.choice(sizes)
        seq = "".join(r.choices("ACGT", k=n))
        qual = bytearray(r.choices((0, 2, 30, 40, 255), k=n))
        rows.append(Row(qname=f"read{i}", flag=1, tid=i % 2, pos=r.randint(0, 9000), mapq=9, cigar=f"{n}M" if n else "*", mtid=-1, mpos=-1, seq=seq, qual=qual))
    path = str(tmp_path / "long.bam")
    head = b"BAM\x01" + b"\0" * 4 + (2).to_bytes(4, "little")
    for name in (b"chr1\0", b"chr2\0"):
        head += len(name).to_bytes(4, "little") + name + (10_000).to_bytes(4, "little")
    data = head + b"".join(map(alignments.encode, rows))
    with open(path, "wb") as file:
        for at in range(0, len(data), 0xFF00):
            file.write(alignments._compressed(data[at : at + 0xFF00]))
        file.write(alignments._EOF)
    size = os.path.getsize(path)
    for split in (size, size // 2, size // 4 + 1, size // 9 + 1, 30_001, 7_000):
        if size // split > 300:
            continue
        got = [x for a in range(0, size, split) for x in alignments.bam_records(path, a, min(a + split, size))]
        assert [(x[2], x[10], x[11]) for x in got] == [(x.qname, x.seq, bytes(x.qual)) for x in rows]
        assert [x[1] for x in got] == sorted({x[1] for x in got})


def test_bins():
    for start, end, bin_ in ((0, 1, 4681), (0, 1 << 14, 4681), (0, (1 << 14) + 1, 585), ((1 << 17) - 1, (1 << 17) + 1, 73), (0, 1 << 29, 0), (1 << 28, (1 << 28) + 5, 4681 + (1 << 14))):
        assert alignments.bin_of(start, end) == bin_ and bin_ in alignments.bins_over(start, end)


def test_regions_by_index(spark, tmp_path):
    """With an index a few regions cost a few blocks, and no record that overlaps them is lost."""
    r = random.Random(4)
    rows = []
    for i in range(4000):
        n = r.choice((60, 100, 0))
        seq, gap = "".join(r.choices("ACGT", k=n)), r.choice((0, 0, 0, 40_000))
        tid, pos = r.choice((-1, 0, 0, 1)), r.randint(0, 3_000_000)
        tid, pos = (tid, pos) if tid >= 0 else (-1, -1)
        cigar = (f"{n // 2}M{gap}N{n - n // 2}M" if gap else f"{n}M") if n else "*"
        rows.append(("x", i, f"q{i}", 1, tid, pos, 5, cigar, -1, -1, seq, bytearray([30] * n), pos + n + (gap if n else 0)))
    contigs = spark.createDataFrame([(0, "chr1", 4_000_000), (1, "chr2", 4_000_000)], "tid int, name string, length long")
    path = str(tmp_path / "r.bam")
    alignments.write_bam(spark.createDataFrame(rows, READS).orderBy("ord"), contigs, path)
    wanted = [(0, 100, 20_000), (0, 1_000_000, 1_000_400), (0, 2_999_000, 3_100_000), (1, 500_000, 500_001), (1, 3_900_000, 3_950_000)]
    regions = spark.createDataFrame(wanted, "tid int, start long, end long")
    hit = lambda x: any(x[4] == t and x[5] < e and s < max(x[12], x[5] + 1) for t, s, e in wanted)
    want = sorted(x[2] for x in rows if hit(x))
    read = lambda: [tuple(x) for x in alignments.read_alignments(spark, path, split_bytes=5000, regions=regions).collect()]
    assert len(read()) == len(rows)  # no index yet
    with pytest.raises(FileNotFoundError):
        alignments.write_index(path + ".none")
    alignments.write_index(path)
    got = read()
    assert sorted(x[2] for x in got if hit(x)) == want and len({x[1] for x in got}) == len(got) < len(rows) / 3
    chunks = alignments.indexed_chunks(path + ".bai", wanted)
    assert sum((b >> 16) - (a >> 16) for a, b in chunks) < os.path.getsize(path) / 3
    assert all(a[1] < b[0] for a, b in zip(chunks, chunks[1:]))
    assert alignments.indexed_chunks(path + ".bai", []) == []


def test_paths():
    assert [paths.is_cram_path(p) for p in ("a.cram", "A.CRAM?x#y", "a.bam", "s3://b/c.cram#f", "a.cram.crai")] == [True, True, False, True, False]
    assert [paths.output_format(*a) for a in (("x.cram",), ("x.CrAm",), ("x",), ("x.sam",), ("x.cram", "bam"))] == ["cram", "cram", "bam", "bam", "bam"]
    with pytest.raises(ValueError, match="--reference"):
        paths.check_reference(None, cram=True)
    paths.check_reference("x.fa", cram=True)
    paths.check_reference(None, cram=False)


def test_command_line(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "chr1", 10000)], "tid int, name string, length long")
    rows = reads(spark, [("a", 60, 10, 65, 0, 3000, CAG), ("a", 3000, 60, 129, 0, 60, APER), ("b", 65, 10, 65, 0, 3005, CAG), ("b", 3005, 60, 129, 0, 65, APER)])
    at = lambda n: str(tmp_path / n)
    alignments.write_bam(rows, contigs, at("r.bam"))
    run = lambda *a: cli.main(list(a), spark)
    assert run("sinks", "-i", at("r.bam"), "-o", at("s.bed")) == 0
    assert open(at("s.bed")).read() == "chr1\t60\t125\tAGC\t2\n"
    assert run("profile", "--sink-bed", at("s.bed"), "-i", at("r.bam"), "--summary", at("p.json"), "-o", at("c.bam")) == 0
    assert json.load(open(at("p.json"))) == [{"chrom": "chr1", "start": 3000, "end": 3155, "irr_count": 2, "motifs": {"AGC": 2}}]
    assert alignments.read_alignments(spark, at("c.bam")).count() == 2
    alignments.write_index(at("r.bam"))  # the same by index
    assert run("profile", "--sink-bed", at("s.bed"), "-i", at("r.bam"), "--summary", at("q.json"), "-o", at("d.bam")) == 0
    assert open(at("q.json")).read() == open(at("p.json")).read() and open(at("d.bam"), "rb").read() == open(at("c.bam"), "rb").read()
    assert alignments.header_text(at("c.bam")) == alignments.header_text(at("r.bam"))
    # CRAM in and out: the same results, and a reference is asked for
    (tmp_path / "x.fa").write_text(">chr1\n" + "ACGT" * 2500 + "\n")
    alignments.write_cram(rows, contigs, at("r.cram"))
    assert run("sinks", "-i", at("r.cram"), "-o", at("t.bed"), "-r", at("x.fa")) == 0 and open(at("t.bed")).read() == open(at("s.bed")).read()
    assert run("sinks", "-i", at("r.cram"), "-o", at("t.bed")) == 1
    assert run("profile", "--sink-bed", at("s.bed"), "-i", at("r.cram"), "--summary", at("u.json"), "-o", at("c.cram"), "-r", at("x.fa")) == 0
    assert open(at("u.json")).read() == open(at("p.json")).read()
    same = [plain(alignments.read_alignments(spark, at(n), at("x.fa")).orderBy("ord").select(*VALUES).collect()) for n in ("c.bam", "c.cram")]
    assert same[0] == same[1] and len(same[0]) == 2
    assert run("profile", "--sink-bed", at("s.bed"), "-i", at("r.bam"), "--summary", at("u.json"), "-o", at("e.cram")) == 1
    assert run("profile", "--sink-bed", at("s.bed"), "-i", at("r.bam"), "--summary", at("u.json"), "-o", at("e.out"), "--output-format", "cram", "-r", at("x.fa")) == 0
    assert open(at("e.out"), "rb").read(4) == b"CRAM"
    (tmp_path / "m.tsv").write_text(f"A\t{at('p.json')}\nB\t{at('p.json')}\n")
    (tmp_path / "d.tsv").write_text("A\t20\nB\t10\n")
    assert run("merge", "--manifest", at("m.tsv"), "--output", at("m.json"), "--depths", at("d.tsv")) == 0
    assert json.load(open(at("m.json")))[0]["irr_count"] == {"A": 3.0, "B": 6.0}
    (tmp_path / "l.txt").write_text("id\n" + "".join(f"r{i}\n" for i in range(500)))
    assert run("sample", "-i", at("l.txt"), "-o", at("o.txt"), "-c", "0.9", "-p", "0.05") == 0
    got = open(at("o.txt")).read().split("\n")
    assert got[0] == "id" and len(got) == 47 and got[1:-1] == sorted(got[1:-1], key=lambda x: int(x[1:]))
    assert run("sinks", "-i", "a.cram", "-o", at("x")) == 1
    assert run("sample", "-i", at("l.txt"), "-o", at("none.txt"), "-c", "0.999999", "-p", "0.0001") == 1
    assert not (tmp_path / "none.txt").exists()


def test_counts_in_the_log(spark, tmp_path, caplog):
    """-v reports each command's counts."""
    contigs = spark.createDataFrame([(0, "chr1", 10000)], "tid int, name string, length long")
    rows = reads(spark, [("a", 60, 10, 65, 0, 3000, CAG), ("a", 3000, 60, 129, 0, 60, APER), ("b", 65, 10, 73, -1, -1, CAG)])
    at = lambda n: str(tmp_path / n)
    alignments.write_bam(rows, contigs, at("r.bam"))
    (tmp_path / "s.bed").write_text("chr1\t50\t70\nchr1\t60\t150\n")
    (tmp_path / "l.txt").write_text("".join(f"r{i}\n" for i in range(100)))
    logging.getLogger().setLevel(logging.INFO)

    def counts(*args):
        caplog.clear()
        with caplog.at_level(logging.INFO, "quillon"):
            assert cli.main(["-v", *args], spark) == 0
        return ast.literal_eval(caplog.records[-1].getMessage().split(": ", 1)[1])

    got = counts("profile", "--sink-bed", at("s.bed"), "-i", at("r.bam"), "--summary", at("p.json"), "-o", at("c.bam"))
    assert got == {"bed_regions": 2, "fetches": 1, "pass_count": 2, "distinct": 2, "anchored": 1, "unanchored": 1, "clusters": 1, "sink_excluded": 0, "written": 2}
    assert counts("sinks", "-i", at("r.bam"), "-o", at("t.bed")) == {"scanned": 3, "anchored": 1, "paired": 0, "unresolved": 1, "rows": 1}
    (tmp_path / "m.tsv").write_text(f"A\t{at('p.json')}\nB\t{at('p.json')}\n")
    assert counts("merge", "--manifest", at("m.tsv"), "--output", at("m.json"), "--batch-size", "1") == {"samples": 2, "batches": 2, "loci": 2, "clusters": 1}
    assert counts("sample", "-i", at("l.txt"), "-o", at("o.txt"), "-c", "0.9", "-p", "0.1", "--no-header", "--seed", "5") == {"drawn": 22, "seen": 100, "n": 22, "confidence": 0.9, "probability": 0.1, "seed": 5}


def test_streamed_pairing(spark, some_reads, tmp_path):
    rows = classified(some_reads, SinksParams())
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    want = sorted((r.qname, r.ord, r.outcome) for r in confirmed(rows.selectExpr("*", "struct(file_id, qname) as name"), "name").collect())
    for i, (a, b) in enumerate(((0, 1000), (1000, 2000), (2000, 3000))):
        rows.where(f"ord >= {a} and ord < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    query = confirmed_stream(stream).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
    query.awaitTermination(120)
    assert sorted((r.qname, r.ord, r.outcome) for r in spark.read.parquet(out).collect()) == want


def test_running_merge(spark, tmp_path):
    rows = [(i, f"s{i % 3}", 0, "chr1", 1000 + 400 * i, 1100 + 400 * i, i + 1, {"CAG": i + 1}) for i in range(6)]
    schema = "line_no long, sample_id string, locus_no long, chrom string, start long, end long, irr_count long, motifs map<string,long>"
    whole = merge(spark.createDataFrame(rows, schema), params=MergeParams(merge_distance=350)).collect()
    running = RunningMerge(spark, str(tmp_path / "state"), 350)
    for v, part in enumerate((rows[::2], rows[1::2])):
        running.add(spark.createDataFrame(part, schema), v)
    running.add(spark.createDataFrame(rows[1::2], schema), 1)  # a batch that runs again counts once
    got = merge(running.state(), params=MergeParams(merge_distance=350)).collect()
    assert got == whole and len(whole) == 1


@pytest.mark.parametrize("kind", ["bam", "sam"])
def test_a_header_of_many_contigs_is_read_once(spark, some_reads, tmp_path, kind, monkeypatch):
    """Splits share the header, however many there are, and tasks make the file's parts side by side."""
    path = str(tmp_path / f"many.{kind}")
    contigs = spark.range(200_000).selectExpr("cast(id as int) as tid", "concat('chr', id) as name", "1000000L as length")
    assert getattr(alignments, f"write_{kind}")(some_reads, contigs, path) == some_reads.count()
    read = []
    for name in ("read_header", "sam_contigs"):
        plainly = getattr(alignments, name)
        monkeypatch.setattr(alignments, name, lambda x, f=plainly: read.append(1) or f(x))
    size = os.path.getsize(path)
    split = size // 20
    got = [x for a in range(0, size, split) for x in getattr(alignments, f"{kind}_records")(path, a, min(a + split, size))]
    assert len(got) == some_reads.count() and len(read) == 1
    want = plain(some_reads.orderBy("tid", "pos", "ord").select(*VALUES).collect())
    assert [x[2:] for x in got] == want


def test_lines_and_records_of_odd_reads():
    for seq in ("", "A", "acgtN=", "ACéGTX", "ACGTMRWSYKVHDBN"):
        row = Row(qname="q", flag=1, tid=0, pos=3, mapq=9, cigar="*", mtid=-1, mpos=-1, seq=seq, qual=bytes(range(len(seq))))
        assert alignments.decode("x", 0, alignments.encode(row)[4:])[10:12] == ("".join(c if c in alignments.BASES else "N" for c in seq.upper()), row.qual)
    for qual in (b"\0\x5d", b"\x5e\xff", b"\xff\xff", b"\x28\x05"):
        row = Row(qname="q", flag=1, tid="c", pos=3, mapq=9, cigar="2M", mtid="*", mpos=-1, seq="AC", qual=qual)
        printed = alignments.sam_line(row).decode().rstrip("\n").split("\t")[10]
        assert printed == ("*" if qual == b"\xff\xff" else "".join(chr(q + 33) for q in qual))
        assert printed == "*" or alignments._qualities(printed) == qual
