"""Driver queries that go through files: the rows are written in a format, read back, and held against SQL.

Files stand in the folder of spark.checkpoint.dir, or in a temporary one on a single machine.
"""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions.motif import detect
from quillon.functions.sampling import sample_size
from quillon.operators.pairing import confirmed
from quillon.plans import driver_tables as d, merge as merge_plan
from quillon.plans.driver_tables import _AN, _CA, _CM, _LO, _OV, _PAIRED, _RC, _RD, _SK, _islands
from quillon.plans.profile import profile
from quillon.plans.sample import sample
from quillon.plans.sinks import classified, sinks
from quillon.schema import MergeParams, SinksParams
from quillon.sources import alignments, text, writers
from quillon.streaming.merge import RunningMerge

_local: list[str] = []


def _scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that this process writes."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None or "://" in folder:
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="quillon-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        folder = _local[0]
    folder = os.path.join(folder.removeprefix("file:"), "quillon-files")
    os.makedirs(folder, exist_ok=True)
    return os.path.join(folder, f"{uuid.uuid4().hex}-{name}")


def _read_back(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    path = _scratch(spark, f"reads.{kind}")
    getattr(alignments, f"write_{kind}")(d._reads(spark, sf), d._contigs(spark, sf), path)
    rows = alignments.read_alignments(spark, path, split_bytes=1 << 19)
    return rows.join(alignments.contigs_of(spark, path).select("tid", F.col("name").alias("chrom")), "tid").select(
        "qname", "flag", "chrom", "pos", "mapq", "cigar", "mtid", "mpos", "seq", F.hex("qual").alias("qual"), "end_pos"
    )


def bam_records(spark, sf):
    """The reads as one BAM file, read in splits."""
    return _read_back(spark, sf, "bam")


def sam_records(spark, sf):
    return _read_back(spark, sf, "sam")


def motif_scores(spark, sf):
    """Every accepted motif of the reads, by rank of discovery, with its score."""
    rows = d._reads(spark, sf).select("seq", "qual").distinct()

    def run(batches):
        import pandas as pd

        for frame in batches:
            found = detect([s.encode() for s in frame["seq"]], [None if q is None else bytes(q) for q in frame["qual"]])
            out = [(s, i, m, round(v, 6)) for s, ms in zip(frame["seq"], found) for i, (m, v) in enumerate(ms)]
            yield pd.DataFrame(out, columns=["seq", "rank", "motif", "score"])

    return rows.mapInPandas(run, "seq string, rank long, motif string, score double")


def _lines(spark, sf):
    key = F.col("o_orderkey")
    return d._table(spark, sf, "orders").select(key.alias("line_no"), F.concat(F.when(key % 7 == 0, F.lit("  ")).otherwise(F.lit("")), F.concat_ws("\t", F.concat(F.lit("s"), key), "o_orderpriority", F.when(key % 3 == 0, F.col("o_orderstatus")))).alias("value"))


def manifest_lines(spark, sf):
    return text.parse_manifest(_lines(spark, sf).unionByName(spark.createDataFrame([(-1, "  ")], "line_no long, value string")))


def _summary_files(spark, sf):
    """The loci of each sample as a JSON text."""
    locus = F.struct("locus_no", "chrom", "start", "end", "irr_count", "motifs")
    by_number = lambda a, b: F.sign(a["locus_no"] - b["locus_no"]).cast("int")
    items = F.transform(F.array_sort(F.collect_list(locus), by_number), lambda x: F.struct(x["chrom"].alias("chrom"), x["start"].alias("start"), x["end"].alias("end"), x["irr_count"].alias("irr_count"), x["motifs"].alias("motifs")))
    return d._loci(spark, sf).groupBy("line_no", "sample_id").agg(F.to_json(items).alias("value"))


def summary_files(spark, sf):
    """The samples' summaries as files, named by a manifest and read back."""
    paths = []
    for r in _summary_files(spark, sf).toLocalIterator():  # a row for each sample
        path = _scratch(spark, f"{r.sample_id}.json")
        with open(path, "w") as file:
            file.write(r.value)
        paths.append((r.line_no, r.sample_id, path))
    manifest = spark.createDataFrame(paths, "line_no long, sample_id string, path string")
    rows = text.read_summaries(spark, manifest)
    return rows.select("line_no", "sample_id", "locus_no", "chrom", "start", "end", "irr_count", F.explode("motifs").alias("motif", "n"))


def sinks_file(spark, sf):
    """The lines of the BED file that sinks writes, with their numbers."""
    path = _scratch(spark, "sinks.bed")
    writers.write_bed(sinks(d._reads(spark, sf), d._contigs(spark, sf), SinksParams()).regions, path)
    return text.numbered_lines(spark, path)


def _json_rows(spark, path, fields):
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.from_json("value", f"array<struct<{fields}>>")).alias("place", "l")).select(F.col("place").cast("long").alias("place"), "l.*")


_LOCUS = "chrom:string,start:long,end:long"


def _profile_rows(spark, sf, exclude):
    path = _scratch(spark, "profile.json")
    found = profile(d._reads(spark, sf), d._contigs(spark, sf), d._sinks(spark, sf), exclude, d._profile_params())
    writers.write_json(found.summary, path)
    rows = _json_rows(spark, path, f"{_LOCUS},irr_count:long,motifs:map<string,long>")
    return rows.select("place", "chrom", "start", "end", "irr_count", F.explode("motifs").alias("motif", "n"))


def profile_file(spark, sf):
    """The loci of the JSON file that profile writes, with their places in it."""
    return _profile_rows(spark, sf, None)


def profile_excluded(spark, sf):
    """The same with a second file of regions to exclude: long ones on each third contig."""
    return _profile_rows(spark, sf, d._intervals(spark, sf).where("tid % 3 = 0").select("tid", "start", (F.col("start") + 300).alias("end")))


def profile_metrics(spark, sf):
    found = profile(d._reads(spark, sf), d._contigs(spark, sf), d._sinks(spark, sf), None, d._profile_params())
    return found.metrics.select(*[F.col(c).cast("long").alias(c) for c in ("pass_count", "distinct", "anchored", "unanchored", "clusters", "sink_excluded")])


def sinks_metrics(spark, sf):
    return sinks(d._reads(spark, sf), None, SinksParams()).metrics.select(*[F.col(c).cast("long").alias(c) for c in ("scanned", "anchored", "paired", "unresolved")])


def sinks_pairs(spark, sf):
    """Every confirmed repeat read, with what confirmed it."""
    rows = classified(d._reads(spark, sf), SinksParams()).withColumn("name", F.struct("file_id", "qname"))
    return confirmed(rows, "name").select("qname", "ord", "motif", "tid", "start", "end", "outcome")


def merge_file(spark, sf):
    """The loci of the JSON file that merge writes, with their places in it."""
    path = _scratch(spark, "merge.json")
    writers.write_json(merge_plan.merge(d._loci(spark, sf), d._depths(spark, sf), MergeParams(merge_distance=d.LOCUS_DISTANCE)), path)
    rows = _json_rows(spark, path, f"{_LOCUS},irr_count:map<string,double>,motifs:map<string,map<string,double>>")
    whole = rows.select("place", "chrom", "start", "end", F.lit("").alias("motif"), F.explode("irr_count").alias("sample_id", "value"))
    parts = rows.select("place", "chrom", "start", "end", F.explode("motifs").alias("motif", "by_sample"))
    return whole.unionByName(parts.select("place", "chrom", "start", "end", "motif", F.explode("by_sample").alias("sample_id", "value")))


def running_merge(spark, sf):
    """The loci of all samples, merged as batches of samples arrive, one of them twice."""
    loci = d._loci(spark, sf)
    running = RunningMerge(spark, _scratch(spark, "state"), d.LOCUS_DISTANCE)
    for version, part in enumerate((0, 1, 2, 2)):
        running.add(loci.where(F.col("line_no") % 3 == part), min(version, 2))
    return merge_plan.merged_counts(running.state(), d.LOCUS_DISTANCE)[1]


def sample_file(spark, sf):
    """Lines drawn from a file with a header, as the file that sample writes, with line numbers."""
    path, out = _scratch(spark, "lines.txt"), _scratch(spark, "sample.txt")
    orders = d._table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("line_no"), F.concat_ws("\t", "o_orderkey", "o_orderpriority").alias("value"))
    writers.write_lines("key\tclerk", orders, path)
    header, lines = text.data_lines(spark, path)
    writers.write_lines(header, sample(lines, 0.95, 0.01), out)
    return text.numbered_lines(spark, out)


def exit_status(spark, sf):
    """What the command line returns for runs that must fail, without a file left behind, and for one that works."""
    from quillon import cli

    at, none = _scratch(spark, "none.txt"), _scratch(spark, "lines.txt")
    writers.write_lines("h", spark.createDataFrame([(i, str(i)) for i in range(40)], "line_no long, value string"), none)
    runs = {
        "CRAM without a reference": ["sinks", "-i", "a.cram", "-o", at],
        "no such file": ["sinks", "-i", at + ".bam", "-o", at],
        "too few lines": ["sample", "-i", none, "-o", at, "-c", "0.99", "-p", "0.01"],
        "bad confidence": ["sample", "-i", none, "-o", at, "-c", "1", "-p", "0.1"],
        "bad batch size": ["merge", "--manifest", none, "--output", at, "--batch-size", "0"],
        "bad manifest": ["merge", "--manifest", none, "--output", at],
        "no header in an empty file": ["sample", "-i", os.devnull, "-o", at, "-c", "0.5", "-p", "0.5"],
        "sample": ["sample", "-i", none, "-o", at + ".out", "-c", "0.9", "-p", "0.1"],
    }
    level = logging.getLogger("quillon").level
    logging.getLogger("quillon").setLevel(logging.CRITICAL)
    try:
        rows = [(name, cli.main(args, spark), os.path.exists(at)) for name, args in runs.items()]
    finally:
        logging.getLogger("quillon").setLevel(level)
    return spark.createDataFrame(rows, "run string, status long, left boolean")


QUERIES = {
    f.__name__: f
    for f in (
        bam_records, sam_records, motif_scores, manifest_lines, summary_files, sinks_file, profile_file, profile_excluded, profile_metrics,
        sinks_metrics, sinks_pairs, merge_file, running_merge, sample_file, exit_status,
    )
}


# --- SQL twins -----------------------------------------------------------------------------------

_RECORDS = f"""with {_SK}, {_RD} select qname, flag, 'chr' || tid as chrom, pos, mapq, length(seq) || 'M' as cigar, mtid, mpos, seq,
    repeat(case qual when 'missing' then 'FF' when 'low' then '05' else '28' end, length(seq)) as qual, end_pos from mo"""
_CLASSIFIED = f"""{_SK}, {_RD}, rr as (select qname, ord, case when motif is not null and ((flag & 4) <> 0 or mapq <= 40) then 'IRR' when (flag & 4) = 0 and mapq > 40 and mapq >= 50 then 'ANCHOR' end as role, motif, tid,
        case when (flag & 4) = 0 then pos end as "start", case when (flag & 4) = 0 then end_pos end as "end" from mo where (flag & 256) = 0), r2 as (select * from rr where role is not null), {_PAIRED.format("r2")}"""
_REGIONS = f"""em as (select motif, tid, "start", "end" from pc where n = 2 and role = 'IRR' and "start" is not null), rg as ({_islands("em", "motif, tid", 0)})"""
_SUMMARY = f"""{_RD}, {_CA}, {_AN}, {_CM.format(5, "an")}, mg as (select tid, s as "start", e as "end", count(*) as irr_count from cm group by all), {_OV},
    mm as (select tid, s as "start", e as "end", motif, count(*) as n from (select tid, s, e, unnest(motifs) as motif from cm) group by all),
    kept as (select *, row_number() over (order by tid, "start", "end") - 1 as place from ov where overlap / ("end" - "start") <= 0.8)"""
_PROFILE = f"""{_SUMMARY} select place, 'chr' || tid as chrom, "start", "end", irr_count, motif, n from mg join mm using (tid, "start", "end") join kept using (tid, "start", "end")"""
_MORE = f"""iv as (select cast(l_partkey as int) as tid, {d._DAY.format("l_shipdate")} as "start", {d._DAY.format("l_shipdate")} + 300 as "end" from lineitem where l_partkey % 3 = 0),
    uni as (select * from sk0 union all select * from iv), cover as (select tid, "start", "end" from ({_islands("uni", "tid", 0)}))"""
_VALUE = "cast(n as double) * 30.0::double / depth"

ORACLE_SQL = {
    "bam_records": _RECORDS,
    "sam_records": _RECORDS,
    "motif_scores": f"""with {_SK}, {_RD}, ms as (select distinct seq, qual, motifs from mo), mm as (select seq, qual, unnest(range(0, len(motifs))) as rank, unnest(motifs) as m from ms),
        t as (select *, unnest(range(0, 2 * length(m))) as i from mm), b as (select *, case when i < length(m) then seq else {_RC.format("seq")} end as strand, case qual when 'low' then 0.5 else -1.0 end as miss from t),
        v as (select *, list_sum(list_transform(range(1, length(seq) + 1), lambda k: case when strand[k] = m[(i + k - 1) % length(m) + 1] then 1.0 else miss end)) as score from b)
        select seq, rank, m as motif, round(cast(arg_min(score, i) as double) / length(seq), 6) as score from v where score >= 0.9 * length(seq) group by seq, qual, rank, m""",
    "manifest_lines": """select o_orderkey as line_no, 's' || o_orderkey as sample_id, o_orderpriority || case when o_orderkey % 3 = 0 then chr(9) || o_orderstatus else '' end as path from orders""",
    "summary_files": f"""with {_LO}, x as (select *, row_number() over (partition by line_no order by locus_no) - 1 as place from lo)
        select line_no, sample_id, place as locus_no, chrom, "start", "end", n as irr_count, m as motif, v as n from (select *, unnest([motif, 'ALL']) as m, unnest([n, 1]) as v from x)""",
    "sinks_file": f"""with {_CLASSIFIED}, {_REGIONS} select row_number() over (order by tid, "start", "end", motif) - 1 as line_no, concat_ws(chr(9), 'chr' || tid, "start", "end", motif, n) as value from rg""",
    "profile_file": f"with {_SK}, {_PROFILE}",
    "profile_excluded": f"with {_SK}, {_MORE}, {_PROFILE.replace('left join sk on sk.tid', 'left join cover sk on sk.tid')}",
    "profile_metrics": f"""with {_SK}, {_SUMMARY} select (select cast(sum(n_fetched) as bigint) from ca) as pass_count, (select count(*) from ca) as distinct, (select count(*) from an) as anchored,
        (select count(*) from ca) - (select count(*) from an) as unanchored, (select count(*) from mg) as clusters, (select count(*) from mg) - (select count(*) from kept) as sink_excluded""",
    "sinks_metrics": f"""with {_CLASSIFIED}, em as (select * from pc where n = 2 and role = 'IRR' and "start" is not null)
        select (select count(*) from lineitem) as scanned, (select count(*) from em where n_irr = 1) as anchored, (select count(*) from em where n_irr = 2) as paired, (select count(*) from pc where n = 1) as unresolved""",
    "sinks_pairs": f"""with {_CLASSIFIED} select qname, ord, motif, tid, "start", "end", case when n_irr = 2 then 'paired' else 'anchored' end as outcome from pc where n = 2 and role = 'IRR' and "start" is not null""",
    "merge_file": f"""with {_LO}, ct as (select chrom, min(cast(line_no as bigint) * 1000000000 + locus_no) as contig from lo group by chrom), lc as (select distinct chrom, "start", "end" from ls),
        pl as (select chrom, "start", "end", row_number() over (order by contig, "start", "end") - 1 as place from lc join ct using (chrom)),
        v as (select chrom, "start", "end", '' as motif, sample_id, {_VALUE} as value from ls join dp using (sample_id) union all select chrom, "start", "end", motif, sample_id, {_VALUE} as value from lm join dp using (sample_id))
        select place, chrom, "start", "end", motif, sample_id, value from v join pl using (chrom, "start", "end")""",
    "running_merge": f"""with {_LO} select * from lm""",
    "sample_file": f"""with s as (select o_orderkey, o_orderkey || chr(9) || o_orderpriority as value, row_number() over (order by o_orderkey) - 1 as place from orders),
        t as (select * from s order by md5('42:' || place), place limit {sample_size(0.95, 0.01)})
        select 0 as line_no, 'key' || chr(9) || 'clerk' as value union all select row_number() over (order by place) as line_no, value from t""",
    "exit_status": """select run, cast(status as bigint) as status, false as "left" from (values ('CRAM without a reference', 1), ('no such file', 1), ('too few lines', 1), ('bad confidence', 1), ('bad batch size', 1), ('bad manifest', 1), ('no header in an empty file', 1), ('sample', 0)) t(run, status)""",
}
