"""profile, sinks, merge and sample on the fixtures."""

import json

import pytest
from pyspark.errors import PySparkException

from quillon.plans import merge as merge_plan, sample as sample_plan
from quillon.plans.profile import profile
from quillon.plans.sinks import sinks
from quillon.schema import READS, MergeParams, ProfileParams, SinksParams
from quillon.sources import text, writers

CAG, GATA = "CAG" * 20, "GATA" * 15
APER = "ACGTTGCAACGGTTCAGTAGCTAGCATCGATCGTAGCTAGGCTAGCATCGTAGCTAGCA"
A20G = ("A" * 20 + "G") * 16


def reads(spark, rows):
    """rows: (qname, pos, mapq, flag, mtid, mpos, seq)"""
    out = [("f", i, q, flag, 0, pos, mapq, f"{len(s)}M", mt, mp, s, bytearray([40] * len(s)), pos + len(s)) for i, (q, pos, mapq, flag, mt, mp, s) in enumerate(rows)]
    return spark.createDataFrame(out, READS)


@pytest.fixture()
def contigs(spark):
    return spark.createDataFrame([(0, "chr1", 10000)], "tid int, name string, length long")


def regions(spark, *rows):
    return spark.createDataFrame([(0, a, b) for a, b in rows], "tid int, start long, end long")


def loci(rows):
    return [(r.chrom, r.start, r.end, r.irr_count, dict(r.motifs)) for r in rows.collect()]


def test_profile_basic(spark, contigs):
    r = reads(
        spark,
        [
            ("irrIn", 100, 10, 65, 0, 5000, CAG),
            ("irrUnmappedMate", 105, 12, 73, -1, -1, CAG),
            ("highMapq", 120, 60, 65, 0, 6000, CAG),
            ("nonRepetitive", 140, 8, 65, 0, 7000, APER),
            ("outsideRegion", 9000, 5, 65, 0, 9500, CAG),
            ("unpaired", 110, 5, 0, -1, -1, CAG),
        ],
    )
    r = r.union(r.where("qname = 'irrIn'"))
    found = profile(r, contigs, regions(spark, (50, 150)))
    assert loci(found.summary) == [("chr1", 5000, 5150, 1, {"AGC": 1})]
    assert sorted(x.qname for x in found.candidates.collect()) == ["irrIn", "irrUnmappedMate", "unpaired"]
    m = found.metrics.collect()[0]
    assert (m.pass_count, m["distinct"], m.anchored, m.unanchored, m.clusters, m.sink_excluded) == (4, 3, 1, 2, 1, 0)


def clusters(spark):
    return reads(spark, [("motifA_1", 60, 10, 65, 0, 3000, CAG), ("motifA_2", 65, 10, 65, 0, 3005, CAG), ("motifB_1", 70, 10, 65, 0, 3010, GATA), ("farCluster_1", 75, 10, 65, 0, 4160, CAG)])


def test_profile_clusters_and_exclusion(spark, contigs):
    sinks_ = regions(spark, (50, 150))
    near = ("chr1", 3000, 3160, 3, {"AGC": 2, "AGAT": 1})
    far = ("chr1", 4160, 4310, 1, {"AGC": 1})
    assert loci(profile(clusters(spark), contigs, sinks_).summary) == [near, far]
    wide = profile(clusters(spark), contigs, sinks_, params=ProfileParams(anchor_merge_distance=3000)).summary
    assert loci(wide) == [("chr1", 3000, 4310, 4, {"AGC": 3, "AGAT": 1})]
    assert loci(profile(clusters(spark), contigs, sinks_, regions(spark, (4000, 4400))).summary) == [near]
    assert loci(profile(clusters(spark), contigs, sinks_, regions(spark, (4260, 4400))).summary) == [near, far]


def test_profile_own_sinks_exclude(spark, contigs):
    r = reads(spark, [("irrSelfOverlap", 60, 10, 65, 0, 70, CAG)])
    assert loci(profile(r, contigs, regions(spark, (50, 150)), params=ProfileParams(read_length=50)).summary) == []


def test_profile_many_motifs(spark, contigs):
    r = reads(spark, [("multiMotif", 60, 10, 65, 0, 5000, A20G)])
    got = loci(profile(r, contigs, regions(spark, (50, 446)), params=ProfileParams(motif_min_len=1, motif_max_len=30)).summary)
    assert got == [("chr1", 5000, 5150, 1, {"A": 1, "A" * 20 + "G": 1})]


def test_sinks_main(spark, contigs):
    rows, anchor = [], lambda q, p: (q, p, 60, 129, -1, -1, APER)
    for i, (q, p, s) in enumerate([("cagNear1", 100, CAG), ("cagNear2", 105, CAG), ("cagFar", 5000, CAG), ("gataSameSpot", 100, GATA)]):
        rows += [(q, p, 10, 65, -1, -1, s), anchor(q, 8000 + 10 * i)]
    rows += [("highMapq", 200, 60, 1, -1, -1, CAG), ("nonRepetitive", 300, 8, 1, -1, -1, APER), ("unmapped", 400, 10, 5, -1, -1, CAG), ("secondary", 500, 10, 257, -1, -1, CAG), ("supplementary", 600, 10, 2049, -1, -1, CAG)]
    found = sinks(reads(spark, rows), contigs)
    lines = [r.value for r in writers.bed_lines(found.regions).collect()]
    assert lines == ["chr1\t100\t160\tAGAT\t1", "chr1\t100\t165\tAGC\t2", "chr1\t5000\t5060\tAGC\t1"]
    assert found.metrics.collect()[0].scanned == 13
    wide = sinks(reads(spark, rows), contigs, SinksParams(merge_distance=5000))
    assert [(r.start, r.end, r.irr_count) for r in wide.regions.where("motif = 'AGC'").collect()] == [(100, 5060, 3)]


def test_sinks_pairing(spark):
    rows = [
        ("anchoredIrr", 2000, 10, 65, -1, -1, CAG), ("anchoredIrr", 9000, 60, 129, -1, -1, APER),
        ("pairedIrr", 3000, 10, 65, -1, -1, CAG), ("pairedIrr", 3050, 10, 129, -1, -1, CAG),
        ("droppedLowMapqMate", 4000, 10, 65, -1, -1, CAG), ("droppedLowMapqMate", 9100, 30, 129, -1, -1, APER),
        ("droppedNoMateInFile", 5000, 10, 73, -1, -1, CAG),
        ("unmappedMatePair", 6000, 10, 65, -1, -1, CAG), ("unmappedMatePair", 6000, 0, 133, -1, -1, CAG),
        ("third", 7000, 10, 65, -1, -1, CAG), ("third", 7100, 10, 65, -1, -1, CAG), ("third", 7200, 10, 65, -1, -1, CAG),
    ]
    found = sinks(reads(spark, rows))
    assert sum(r.irr_count for r in found.regions.collect()) == 6
    m = found.metrics.collect()[0]
    assert (m.anchored, m.paired, m.unresolved) == (1, 5, 3)


def test_sinks_best_motif(spark):
    r = reads(spark, [("multiMotif", 100, 10, 65, -1, -1, A20G), ("multiMotif", 8000, 60, 129, -1, -1, APER)])
    got = sinks(r, params=SinksParams(motif_min_len=1, motif_max_len=30)).regions.collect()
    assert [(x.motif, x.irr_count) for x in got] == [("A" * 20 + "G", 1)]


def merged(spark, files, depths=None, **params):
    rows = [(i, s, json.dumps([{"chrom": c, "start": a, "end": b, "irr_count": n, "motifs": m} for c, a, b, n, m in l])) for i, (s, l) in enumerate(files)]
    parsed = text.parse_summaries(spark.createDataFrame(rows, "line_no long, sample_id string, value string"))
    d = spark.createDataFrame(depths, "sample_id string, depth double") if depths else None
    return [(r.chrom, r.start, r.end, r.irr_count, r.motifs) for r in merge_plan.merge(parsed, d, MergeParams(**params)).collect()]


def test_merge_combines(spark):
    got = merged(spark, [("A", [("chr1", 1000, 1100, 5, {"CAG": 5})]), ("B", [("chr1", 1090, 1200, 3, {"CAG": 2, "GATA": 1})])])
    assert got == [("chr1", 1000, 1200, {"A": 5.0, "B": 3.0}, {"CAG": {"A": 5.0, "B": 2.0}, "GATA": {"B": 1.0}})]


def test_merge_distant_contigs_and_order(spark):
    assert len(merged(spark, [("A", [("chr1", 1000, 1100, 1, {"CAG": 1})]), ("B", [("chr1", 5000, 5100, 1, {"CAG": 1})])])) == 2
    got = merged(spark, [("A", [("chr9", 1000, 1100, 1, {})]), ("B", [("chr2", 1050, 1150, 1, {"CAG": 1})])])
    assert [g[0] for g in got] == ["chr9", "chr2"] and got[0][4] == {}


@pytest.mark.parametrize("batch", [1, 2, 100])
def test_merge_chain(spark, batch):
    files = [("A", [("chr1", 1000, 1100, 1, {"CAG": 1})]), ("B", [("chr1", 1600, 1700, 2, {"CAG": 2})]), ("C", [("chr1", 2200, 2300, 4, {"CAG": 4})])]
    assert merged(spark, files, batch_size=batch) == [("chr1", 1000, 2300, {"A": 1.0, "B": 2.0, "C": 4.0}, {"CAG": {"A": 1.0, "B": 2.0, "C": 4.0}})]


def test_merge_bridge_and_repeated_sample(spark):
    files = [("sampleA", [("chr1", 1000, 1100, 1, {"CAG": 1}), ("chr1", 2200, 2300, 4, {"CAG": 4})]), ("sampleB", [("chr1", 1600, 1700, 2, {"GATA": 2})])]
    (got,) = merged(spark, files)
    assert got[1:4] == (1000, 2300, {"sampleA": 5.0, "sampleB": 2.0})


def test_merge_depths(spark):
    files = [("A", [("chr1", 1000, 1100, 10, {"CAG": 10})]), ("B", [("chr1", 1090, 1200, 6, {"CAG": 6})])]
    assert merged(spark, files, [("A", 20.0), ("B", 10.0)])[0][3] == {"A": 15.0, "B": 18.0}
    assert merged(spark, files[:1], [("A", 5.0)], target_depth=50.0)[0][3] == {"A": 100.0}
    with pytest.raises(PySparkException, match="no depth for sample A"):
        merged(spark, files[:1], [("someOtherSample", 20.0)])
    with pytest.raises(PySparkException, match="must be positive"):
        merged(spark, files[:1], [("A", 0.0)])
    assert merged(spark, [("A", [])], [("B", 1.0)]) == []


def test_summary_errors(spark):
    for bad in ('[{"chrom": "c", "start": 1, "end": 2, "motifs": {}}]', '[{"chrom": "c", "start": 1, "end": 2, "irr_count": -1, "motifs": {}}]', '[{"chrom": "c", "start": 1, "end": 2, "irr_count": 1, "motifs": {"A": -1}}]'):
        frame = spark.createDataFrame([(0, "A", bad)], "line_no long, sample_id string, value string")
        with pytest.raises(PySparkException):
            text.parse_summaries(frame).collect()
    with pytest.raises(ValueError):
        MergeParams(batch_size=0)


def lines(spark, n):
    return spark.createDataFrame([(i, f"row{i}\t{i}") for i in range(n)], "line_no long, value string")


def test_sample(spark):
    data = lines(spark, 1000)
    got = [r.line_no for r in sample_plan.sample(data, 0.95, 0.01).collect()]
    assert len(got) == 299 and got == sorted(got)
    data = lines(spark, 500).repartition(7)
    first, again, other = ([r.value for r in sample_plan.sample(data, 0.9, 0.05, s).collect()] for s in (42, 42, 7))
    assert len(first) == 45 and first == again != other
    with pytest.raises(ValueError, match="not enough"):
        sample_plan.sample(lines(spark, 3), 0.95, 0.5)
    for c, p in ((1.0, 0.5), (0.9, 0.0), (-0.1, 0.5), (0.9, 1.0)):
        with pytest.raises(ValueError):
            sample_plan.sample(data, c, p)
    assert sample_plan.sample(data, 0.0, 0.5).count() == 0


def test_text_sources(spark, tmp_path, contigs):
    two = contigs.union(spark.createDataFrame([(1, "chr2", 5)], contigs.schema))
    bed = lambda s: (tmp_path / "x.bed").write_text(s) and text.read_bed(spark, str(tmp_path / "x.bed"), two)
    assert [tuple(r) for r in bed("track x\n#c\nchr1\t10\t20\textra\n\n  chr2\t0\t5 \r\nbrowser\n").collect()] == [(0, 10, 20), (1, 0, 5)]
    for wrong, word in (("chr9\t1\t2\n", "chr9"), ("\nchr1\t5\t2\n", "line 2"), ("chr1\t5\n", "line 1"), ("chr1 5 6\n", "line 1")):
        with pytest.raises(PySparkException, match=word):
            bed(wrong).collect()
    (tmp_path / "m.tsv").write_text("A\tp\tq.json\n\nB\tx.json\n")
    assert [(r.sample_id, r.path) for r in text.read_manifest(spark, str(tmp_path / "m.tsv")).orderBy("line_no").collect()] == [("A", "p\tq.json"), ("B", "x.json")]
    (tmp_path / "d.tsv").write_text("A\t20\nB\t 10 \nA\t5\n")
    assert {r.sample_id: r.depth for r in text.read_depths(spark, str(tmp_path / "d.tsv")).collect()} == {"A": 5.0, "B": 10.0}
    (tmp_path / "e.txt").write_text("")
    with pytest.raises(ValueError, match="--no-header"):
        text.data_lines(spark, str(tmp_path / "e.txt"))


def test_json_writer(spark, tmp_path, contigs):
    out = str(tmp_path / "s.json")
    writers.write_json(profile(clusters(spark), contigs, regions(spark, (50, 150))).summary, out)
    got = json.load(open(out))
    assert [g["irr_count"] for g in got] == [3, 1] and list(got[0]["motifs"]) == ["AGAT", "AGC"]
    manifest = spark.createDataFrame([(0, "A", out), (1, "B", out)], "line_no long, sample_id string, path string")
    both = merge_plan.merge(text.read_summaries(spark, manifest)).collect()
    assert both[0].irr_count == {"A": 3.0, "B": 3.0}
    writers.write_json(spark.createDataFrame([], "a int"), out)
    assert open(out).read() == "[]"
