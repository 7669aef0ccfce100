"""The driver's tables seen as intervals, points, reads and loci, and one query for each operator over them.

Every projection is written once for Spark and once, in ORACLE_SQL, for DuckDB.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions import sequence
from quillon.functions.motif import consensus, with_motifs
from quillon.functions.sampling import sample_size
from quillon.operators import intervals, pairing
from quillon.plans import merge as merge_plan
from quillon.plans.profile import anchors, candidates, count_anchors, eligible, profile
from quillon.plans.sample import sample_n
from quillon.plans.sinks import sinks
from quillon.schema import MergeParams, ProfileParams, SinksParams
from quillon.sources.paths import is_cram_path
from quillon.sources.text import parse_bed, parse_depths

#: letters in a read, and places at which a read of kind 3, or of kinds 4 and 5, holds another letter than its repeat
READ, FEW, MANY = 120, (17, 58, 101), (3, 19, 36, 50, 71, 82, 97, 113)
#: coordinates here are days, so bins are small
BIN = 64


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _days(column: str):
    return F.datediff(F.col(column), F.lit("1992-01-01").cast("date")).cast("long")


def _parts(spark: SparkSession, sf: str) -> int:
    return _table(spark, sf, "part").count()


def _intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("int").alias("tid"), _days("l_shipdate").alias("start"), F.col("l_quantity").cast("long").alias("n"), F.concat("l_returnflag", "l_linestatus").alias("motif")
    )
    return rows.select("tid", "start", (F.col("start") + F.col("n")).alias("end"), "motif")


def _sinks(spark: SparkSession, sf: str) -> DataFrame:
    start = _days("o_orderdate")
    return _table(spark, sf, "orders").select((F.col("o_orderkey") % _parts(spark, sf)).cast("int").alias("tid"), start.alias("start"), (start + 20 + F.col("o_orderkey") % 60).alias("end"))


def _merged_sinks(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.merge_within(_sinks(spark, sf), 0, bin_size=1 << 9).drop("n")


def _unit(key):
    return F.substring(F.translate(F.md5(key.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), (2 + key % 7).cast("int"))


def _swapped(seq, places):
    """seq with the letters at places complemented."""
    ends = [0, *[p + 1 for p in places]]
    parts = [F.concat(F.substring(seq, a + 1, p - a), F.translate(F.substring(seq, p + 1, 1), "ACGT", "TGCA")) for a, p in zip(ends, places)]
    return F.concat(*parts, F.substring(seq, ends[-1] + 1, READ))


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as reads, mates on the next contig. The supplier gives the kind of read.

    0: no repeat. 1, 2: repeats of a unit that hangs on the part, of high or missing quality. 3: with few other
    letters, which is still a repeat. 4 and 5: with many, which is none if their quality is high, and one if it is
    low. 6: two motifs, of two letters and of those nine times and one change. 7: a repeat on the reverse strand.
    Units of one letter have no other letters in them, since these would make longer repeats.
    """
    parts = _parts(spark, sf)
    part, line, supp = F.col("l_partkey"), F.col("l_linenumber").cast("long"), F.col("l_suppkey")
    day, unit = _days("l_shipdate"), _unit(F.col("l_partkey"))
    flag = (
        F.lit(1)
        + F.when(F.col("l_returnflag") == "A", 64).when(F.col("l_returnflag") == "N", 128).otherwise(0)
        + F.when((part + line) % 11 == 0, 4).otherwise(0)
        + F.when(supp % 9 == 0, 8).otherwise(0)
        + F.when((line == 7) & (F.col("l_linestatus") == "O"), 256).otherwise(0)
    )
    repeats = F.substring(F.repeat(unit, F.lit(READ // 2)), F.lit(1), F.lit(READ))
    plain = F.replace(unit, F.substring(unit, 1, 1), F.lit("")) == ""
    kind = supp % 8
    kind = F.when((kind >= 3) & (kind <= 5) & plain, F.lit(2)).otherwise(kind)
    none = F.substring(F.translate(F.concat(*[F.md5(F.concat(F.lit(f"{i}:"), part)) for i in range(4)]), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, READ)
    pair = F.element_at(F.array(*map(F.lit, ("CT", "GT", "AT"))), (part % 3 + 1).cast("int"))
    double = F.repeat(F.concat(F.repeat(pair, F.lit(9)), F.substring(pair, 1, 1), F.lit("A")), F.lit(READ // 20))
    high, low = F.unhex(F.lit("28" * READ)), F.unhex(F.lit("05" * READ))
    rows = _table(spark, sf, "lineitem").select(
        F.lit("lineitem").alias("file_id"),
        (((line * (1 << 24) + part) * (1 << 14) + supp) * (1 << 12) + day).alias("ord"),
        F.col("l_orderkey").cast("string").alias("qname"),
        flag.cast("int").alias("flag"),
        (part % parts).cast("int").alias("tid"),
        day.alias("pos"),
        ((part * 7 + line * 13) % 61).cast("int").alias("mapq"),
        ((part + 1) % parts).cast("int").alias("mtid"),
        (day + 20 * line).alias("mpos"),
        F.when(kind == 0, none)
        .when(kind <= 2, repeats)
        .when(kind == 3, _swapped(repeats, FEW))
        .when(kind <= 5, _swapped(repeats, MANY))
        .when(kind == 6, double)
        .otherwise(sequence.reverse_complement(repeats))
        .alias("seq"),
        F.when(kind == 5, low).when(kind != 2, high).alias("qual"),
    )
    return rows.withColumn("cigar", F.concat(F.length("seq"), F.lit("M"))).withColumn("end_pos", F.col("pos") + F.length("seq"))


def _contigs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(_parts(spark, sf)).select(F.col("id").cast("int").alias("tid"), F.concat(F.lit("chr"), F.col("id")).alias("name"), F.lit(1 << 30).cast("long").alias("length"))


def _loci(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as loci of samples: the customer's nation is the sample, the priority the contig, the status the motif."""
    orders, customer = _table(spark, sf, "orders"), _table(spark, sf, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey)
    start = _days("o_orderdate") * 40 + F.col("o_orderkey") % 40
    n = 1 + F.col("o_orderkey") % 9
    return rows.select(
        F.col("c_nationkey").cast("long").alias("line_no"),
        F.concat(F.lit("sample"), F.col("c_nationkey")).alias("sample_id"),
        F.col("o_orderkey").alias("locus_no"),
        F.col("o_orderpriority").alias("chrom"),
        start.alias("start"),
        (start + 1 + F.col("o_orderkey") % 7).alias("end"),
        n.alias("irr_count"),
        F.create_map(F.col("o_orderstatus"), n, F.lit("ALL"), F.lit(1).cast("long")).alias("motifs"),
    )


def _depths(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "nation").select(F.concat(F.lit("sample"), F.col("n_nationkey")).alias("sample_id"), (10.0 + F.col("n_nationkey")).alias("depth"))


LOCUS_DISTANCE = 3
DISTANCE = 10


# --- queries -------------------------------------------------------------------------------------


def merge_regions(spark, sf):
    return intervals.merge_regions(_intervals(spark, sf).drop("motif"))


def merge_within_d(spark, sf):
    return intervals.merge_within(_intervals(spark, sf).drop("motif"), DISTANCE, bin_size=1 << 9)


def merge_by_motif(spark, sf):
    return intervals.merge_within(_intervals(spark, sf), 0, ("motif", "tid"), bin_size=1 << 9)


def locate_points(spark, sf):
    points = _table(spark, sf, "lineitem").select(F.col("l_partkey").cast("int").alias("tid"), _days("l_shipdate").alias("pos"), "l_orderkey")
    return intervals.locate(points, _merged_sinks(spark, sf), BIN)


def overlap_length(spark, sf):
    return intervals.overlap_length(merge_regions(spark, sf), _merged_sinks(spark, sf), BIN)


def sink_exclusion(spark, sf):
    return intervals.exclude_covered(merge_regions(spark, sf), _merged_sinks(spark, sf), 0.8, BIN)


def region_semi_join(spark, sf):
    rows = eligible(_reads(spark, sf), 40)
    return intervals.overlapping_pairs(rows, _merged_sinks(spark, sf), bin_size=BIN).select("ord", "qname", "tid", "pos", "flag").distinct()


def distinct_candidates(spark, sf):
    return _reads(spark, sf).select("tid", "pos", "qname", "flag").distinct()


def mate_pairs(spark, sf):
    """Roles by mapping quality alone: low is a repeat, high an anchor."""
    role = F.when(F.col("mapq") <= 40, "IRR").when(F.col("mapq") >= 50, "ANCHOR")
    rows = _reads(spark, sf).where(F.col("flag").bitwiseAND(256 + 2048) == 0).withColumn("role", role).where("role is not null")
    return pairing.pairs(rows, "qname").select("qname", "ord", "role", "pair", F.col("n").cast("long").alias("n"), F.col("n_irr").cast("long").alias("n_irr"))


def _anchor_counts(spark, sf):
    rows = _intervals(spark, sf).select("tid", "start", "end", F.array("motif", F.substring("motif", 1, 1)).alias("motifs"))
    return count_anchors(rows, DISTANCE)


def cluster_counts(spark, sf):
    return _anchor_counts(spark, sf).drop("motifs")


def cluster_motif_counts(spark, sf):
    return _anchor_counts(spark, sf).select("tid", "start", "end", F.explode("motifs").alias("motif", "n"))


def locus_sample_sum(spark, sf):
    return merge_plan.merged_counts(_loci(spark, sf), LOCUS_DISTANCE)[0]


def depth_normalise(spark, sf):
    return merge_plan.normalised(locus_sample_sum(spark, sf), _depths(spark, sf), 30.0).drop("n")


def locus_pivot(spark, sf):
    rows = merge_plan.merge(_loci(spark, sf), _depths(spark, sf), MergeParams(merge_distance=LOCUS_DISTANCE))
    rows = rows.select("chrom", "start", "end", F.explode("motifs").alias("motif", "by_sample"))
    return rows.select("chrom", "start", "end", "motif", F.explode("by_sample").alias("sample_id", "value"))


def first_seen_contig_rank(spark, sf):
    return merge_plan.contig_ids(_loci(spark, sf))


def _units(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", _unit(F.col("p_partkey")).alias("unit"))


def revcomp(spark, sf):
    return _units(spark, sf).select("p_partkey", sequence.reverse_complement("unit").alias("rc"))


def min_rotation(spark, sf):
    return _units(spark, sf).select("p_partkey", sequence.min_rotation("unit").alias("rotation"))


def canonical_unit(spark, sf):
    return _units(spark, sf).select("p_partkey", sequence.canonical_unit("unit").alias("canonical"))


def _letters(spark, sf):
    """All letters A, C, G and T of each document."""
    return _table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))


def match_frequency(spark, sf):
    """Matches at each period of documents' letters; in numpy, as SQL reads a string from its start for each letter."""
    periods = range(2, 21)

    def count(batches):
        for batch in batches:
            rows = []
            for doc_id, seq in zip(batch.column(0).to_pylist(), batch.column(1)):
                bases = np.frombuffer((seq.as_py() or "").encode(), np.uint8)
                for period in periods:
                    same = int((bases[:-period] == bases[period:]).sum()) if period <= len(bases) // 2 else 0
                    rows.append((doc_id, period, same, same / (len(bases) - period) if same else 0.0))
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "period", "matches", "frequency"])

    return _letters(spark, sf).mapInArrow(count, "doc_id long, period long, matches long, frequency double")


def consensus_unit(spark, sf):
    """Majority letter at each phase of period 3 of documents' letters, the larger in a tie."""

    def vote(batches):
        for batch in batches:
            units = [consensus(np.frombuffer(seq.as_py().encode(), np.uint8)[None], 3)[0].tobytes().decode() for seq in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.string())], names=["doc_id", "unit"])

    return _letters(spark, sf).where("length(seq) >= 6").mapInArrow(vote, "doc_id long, unit string")


def motif_candidates(spark, sf):
    rows = _reads(spark, sf).select("tid", "seq", "qual").distinct()
    return with_motifs(rows).select("tid", "seq", F.explode("motifs").alias("motif"))


def best_motif(spark, sf):
    rows = _reads(spark, sf).select("tid", "seq", "qual").distinct()
    return with_motifs(rows).select("tid", "seq", "best")


def sample_n_(spark, sf):
    rows = [(c, p, sample_size(c, p)) for c, p in ((0.95, 0.01), (0.9, 0.05), (0.95, 0.5), (0.0, 0.5))]
    return spark.createDataFrame(rows, "confidence double, probability double, n long")


def sample_lines(spark, sf):
    lines = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_no"), F.concat_ws("\t", "o_orderkey", "o_orderstatus").alias("value"))
    return sample_n(lines, sample_size(0.95, 0.01))


def _profile_params():
    return ProfileParams(anchor_merge_distance=5)


def profile_summary(spark, sf):
    found = profile(_reads(spark, sf), _contigs(spark, sf), _sinks(spark, sf), params=_profile_params()).summary
    return found.select("chrom", "start", "end", "irr_count", F.explode("motifs").alias("motif", "n"))


def profile_candidates(spark, sf):
    found = candidates(_reads(spark, sf), _merged_sinks(spark, sf), _profile_params())
    return found.select("ord", "tid", "pos", "qname", "flag", "n_fetched", F.array_join("motifs", ",").alias("motifs"))


def profile_anchors(spark, sf):
    found = anchors(candidates(_reads(spark, sf), _merged_sinks(spark, sf), _profile_params()), _profile_params())
    return found.groupBy("tid", "start", "end").agg(F.count("*").alias("n"))


def sinks_bed(spark, sf):
    return sinks(_reads(spark, sf), _contigs(spark, sf), SinksParams()).regions.drop("tid")


def cram_path(spark, sf):
    """The CRAM test of paths made of part names."""
    endings = F.element_at(F.array(*map(F.lit, (".cram", ".CRAM?x=1", ".bam", ".cram.crai", "#.cram", ".cRaM#a"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = _table(spark, sf, "part").select("p_partkey", F.concat(F.regexp_replace("p_name", " ", "/"), endings).alias("path"))

    @F.pandas_udf("boolean")
    def is_cram(found: pd.Series) -> pd.Series:
        return found.map(is_cram_path)

    return rows.withColumn("is_cram", is_cram("path"))


def bed_parse(spark, sf):
    contigs = _contigs(spark, sf)
    start = _days("o_orderdate")
    text = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("o_orderkey") % _parts(spark, sf)), start, start + 20 + F.col("o_orderkey") % 60, "o_orderpriority")
    lines = _table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_no"), F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("# "), text)).otherwise(text).alias("value"))
    return parse_bed(lines, contigs)


def depth_last(spark, sf):
    """Of a sample's depths the last line counts."""
    value = F.concat(F.lit("sample"), F.col("o_custkey") % 50, F.lit("\t"), F.col("o_totalprice"))
    return parse_depths(_table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_no"), value.alias("value")))


QUERIES = {
    f.__name__.rstrip("_"): f
    for f in (
        merge_regions, merge_within_d, merge_by_motif, locate_points, overlap_length, sink_exclusion, region_semi_join, distinct_candidates,
        mate_pairs, cluster_counts, cluster_motif_counts, locus_sample_sum, depth_normalise, locus_pivot, first_seen_contig_rank, revcomp,
        min_rotation, canonical_unit, match_frequency, consensus_unit, motif_candidates, best_motif, sample_n_, sample_lines,
        profile_candidates, profile_anchors, profile_summary, sinks_bed, cram_path, bed_parse, depth_last,
    )
}


# --- SQL twins -----------------------------------------------------------------------------------

_DAY = "cast(datediff('day', timestamp '1992-01-01', {}) as bigint)"
_UNIT = "substr(translate(md5(cast({0} as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 2 + {0} % 7)"
_RC = "translate(reverse({}), 'ACGTN', 'TGCAN')"
_ROTATIONS = "list_min(list_transform(range(1, length({0}) + 1), lambda i: substr({0} || {0}, i, length({0}))))"


def _rotated(x: str) -> str:
    return _ROTATIONS.format(x)


def _canonical(x: str) -> str:
    return f"least({_rotated(x)}, {_rotated('(' + _RC.format(x) + ')')})"


def _islands(source: str, by: str, distance: int, more: str = "count(*) as n") -> str:
    """Islands of a table with by, start, end."""
    return f"""select {by}, min("start") as "start", max("end") as "end", {more} from (
        select *, sum(new) over (partition by {by} order by "start", "end" rows unbounded preceding) as island from (
        select *, case when "start" <= max("end") over (partition by {by} order by "start", "end" rows between unbounded preceding and 1 preceding) + {distance} then 0 else 1 end as new from {source}))
        group by {by}, island"""


_IV = f"""iv as (select cast(l_partkey as int) as tid, {_DAY.format("l_shipdate")} as "start", {_DAY.format("l_shipdate")} + cast(l_quantity as bigint) as "end", l_returnflag || l_linestatus as motif from lineitem)"""
_SK = f"""p as (select count(*) as n from part), sk0 as (select cast(o_orderkey % p.n as int) as tid, {_DAY.format("o_orderdate")} as "start", {_DAY.format("o_orderdate")} + 20 + o_orderkey % 60 as "end" from orders, p),
    sk as (select tid, "start", "end" from ({_islands("sk0", "tid", 0)}))"""
_MG = f"""mg as (select tid, "start", "end" from ({_islands("iv", "tid", 0)}))"""
_OV = """ov as (select mg.tid, mg."start", mg."end", cast(sum(case when sk.tid is null then 0 else least(sk."end", mg."end") - greatest(sk."start", mg."start") end) as bigint) as overlap
    from mg left join sk on sk.tid = mg.tid and sk."start" < mg."end" and mg."start" < sk."end" group by 1, 2, 3)"""
_LINE = "cast(l_linenumber as bigint)"
_ROOT = "(select list_min(list_filter(range(1, length(unit) + 1), lambda d: length(unit) % d = 0 and repeat(substr(unit, 1, d), cast(length(unit) / d as int)) = unit)))"
_NONE = " || ".join(f"md5('{i}:' || l_partkey)" for i in range(4))
_PAIR = "(['CT', 'GT', 'AT'])[l_partkey % 3 + 1]"


def _swapped_sql(places) -> str:
    ends = [0, *[p + 1 for p in places]]
    parts = [f"substr(repeats, {a + 1}, {p - a}) || translate(substr(repeats, {p + 1}, 1), 'ACGT', 'TGCA')" for a, p in zip(ends, places)]
    return " || ".join([*parts, f"substr(repeats, {ends[-1] + 1}, {READ})"])


_RD = f"""rd0 as (select {_DAY.format("l_shipdate")} as pos, *, {_UNIT.format("l_partkey")} as unit, substr(repeat({_UNIT.format("l_partkey")}, {READ // 2}), 1, {READ}) as repeats from lineitem),
    rd1 as (select *, case when l_suppkey % 8 between 3 and 5 and replace(unit, unit[1], '') = '' then 2 else l_suppkey % 8 end as kind, repeat({_PAIR}, 9) || {_PAIR}[1] || 'A' as double from rd0),
    rd as (select ((({_LINE} * 16777216 + l_partkey) * 16384 + l_suppkey) * 4096 + pos) as ord, cast(l_orderkey as varchar) as qname,
        1 + case l_returnflag when 'A' then 64 when 'N' then 128 else 0 end + case when (l_partkey + l_linenumber) % 11 = 0 then 4 else 0 end + case when l_suppkey % 9 = 0 then 8 else 0 end
            + case when l_linenumber = 7 and l_linestatus = 'O' then 256 else 0 end as flag,
        cast(l_partkey % p.n as int) as tid, pos, (l_partkey * 7 + l_linenumber * 13) % 61 as mapq, cast((l_partkey + 1) % p.n as int) as mtid, pos + 20 * {_LINE} as mpos,
        case when kind = 0 then substr(translate({_NONE}, '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, {READ}) when kind <= 2 then repeats when kind = 3 then {_swapped_sql(FEW)}
            when kind <= 5 then {_swapped_sql(MANY)} when kind = 6 then repeat(double, {READ // 20}) else {_RC.format("repeats")} end as seq,
        case kind when 2 then 'missing' when 5 then 'low' else 'high' end as qual, kind,
        case when kind in (1, 2, 3, 5, 7) then substr(unit, 1, {_ROOT}) end as root, case when kind = 6 then {_PAIR} end as two, double from rd1, p),
    mo as (select *, motifs[-1] as motif from (select *, pos + length(seq) as end_pos,
        case when length(root) >= 2 then [{_canonical("root")}] when kind = 6 then [{_canonical("two")}, {_canonical("double")}] else [] end as motifs from rd))"""
_CA = """met as (select mo.ord, mo.tid, mo.pos, qname, flag, mtid, mpos, motifs from mo join sk on sk.tid = mo.tid and pos < sk."end" and sk."start" < end_pos where (flag & 260) = 0 and mapq <= 40 and motif is not null),
    ca as (select min(ord) as ord, tid, pos, qname, flag, count(*) as n_fetched, arg_min(motifs, ord) as motifs, arg_min(mtid, ord) as mtid, arg_min(mpos, ord) as mpos from met group by tid, pos, qname, flag)"""
_AN = """an as (select mtid as tid, mpos as "start", mpos + 150 as "end", motifs from ca where (flag & 8) = 0)"""
_LO = f"""lo as (select c_nationkey as line_no, 'sample' || c_nationkey as sample_id, o_orderkey as locus_no, o_orderpriority as chrom, {_DAY.format("o_orderdate")} * 40 + o_orderkey % 40 as "start",
        {_DAY.format("o_orderdate")} * 40 + o_orderkey % 40 + 1 + o_orderkey % 7 as "end", 1 + o_orderkey % 9 as n, o_orderstatus as motif from orders join customer on o_custkey = c_custkey),
    li as (select *, sum(new) over (partition by chrom order by "start", "end" rows unbounded preceding) as island from (
        select *, case when "start" <= max("end") over (partition by chrom order by "start", "end" rows between unbounded preceding and 1 preceding) + {LOCUS_DISTANCE} then 0 else 1 end as new from lo)),
    lh as (select *, min("start") over (partition by chrom, island) as s, max("end") over (partition by chrom, island) as e from li),
    ls as (select chrom, s as "start", e as "end", sample_id, cast(sum(n) as bigint) as n from lh group by all),
    lm as (select chrom, s as "start", e as "end", motif, sample_id, cast(sum(n) as bigint) as n from (select chrom, s, e, motif, sample_id, n from lh union all select chrom, s, e, 'ALL', sample_id, 1 from lh) group by all),
    dp as (select 'sample' || n_nationkey as sample_id, cast(10.0 + n_nationkey as double) as depth from nation)"""
_PAIRED = """pr as (select *, (row_number() over (partition by qname order by ord) - 1) // 2 as pair from {}),
    pc as (select *, count(*) over (partition by qname, pair) as n, count(*) filter (role = 'IRR') over (partition by qname, pair) as n_irr from pr)"""
_SEQ = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"
_SAMPLE = sample_size(0.95, 0.01)
_CM = f"""cm as (select *, min("start") over (partition by tid, island) as s, max("end") over (partition by tid, island) as e from (
    select *, sum(new) over (partition by tid order by "start", "end" rows unbounded preceding) as island from (
    select *, case when "start" <= max("end") over (partition by tid order by "start", "end" rows between unbounded preceding and 1 preceding) + {{0}} then 0 else 1 end as new from {{1}})))"""

ORACLE_SQL = {
    "merge_regions": f"with {_IV}, {_MG} select * from mg",
    "merge_within_d": f"with {_IV} {_islands('iv', 'tid', DISTANCE)}",
    "merge_by_motif": f"with {_IV} {_islands('iv', 'motif, tid', 0)}",
    "locate_points": f"""with {_SK}, pt as (select cast(l_partkey as int) as tid, {_DAY.format("l_shipdate")} as pos, l_orderkey from lineitem)
        select pt.tid, pos, l_orderkey, sk."start" as region_start, sk."end" as region_end from pt left join sk on sk.tid = pt.tid and pos >= sk."start" and pos < sk."end" """,
    "overlap_length": f"with {_IV}, {_MG}, {_SK}, {_OV} select * from ov",
    "sink_exclusion": f"""with {_IV}, {_MG}, {_SK}, {_OV} select * from ov where overlap / ("end" - "start") <= 0.8""",
    "region_semi_join": f"""with {_SK}, {_RD} select ord, qname, tid, pos, flag from mo where (flag & 260) = 0 and mapq <= 40 and exists (select 1 from sk where sk.tid = mo.tid and pos < sk."end" and sk."start" < end_pos)""",
    "distinct_candidates": f"with {_SK}, {_RD} select distinct tid, pos, qname, flag from rd",
    "mate_pairs": f"""with {_SK}, {_RD}, rl as (select qname, ord, case when mapq <= 40 then 'IRR' when mapq >= 50 then 'ANCHOR' end as role from rd where (flag & 256) = 0), rr as (select * from rl where role is not null),
        {_PAIRED.format("rr")} select qname, ord, role, pair, n, n_irr from pc""",
    "cluster_counts": f"with {_IV} {_islands('iv', 'tid', DISTANCE, 'count(*) as irr_count')}",
    "cluster_motif_counts": f"""with {_IV}, {_CM.format(DISTANCE, "iv")} select tid, s as "start", e as "end", m as motif, count(*) as n from (select tid, s, e, motif as m from cm union all select tid, s, e, substr(motif, 1, 1) from cm) group by all""",
    "locus_sample_sum": f"with {_LO} select * from ls",
    "depth_normalise": f"""with {_LO} select chrom, "start", "end", sample_id, cast(n as double) * 30.0::double / depth as value from ls join dp using (sample_id)""",
    "locus_pivot": f"""with {_LO} select chrom, "start", "end", motif, sample_id, cast(n as double) * 30.0::double / depth as value from lm join dp using (sample_id)""",
    "first_seen_contig_rank": f"with {_LO} select chrom, cast(row_number() over (order by line_no, locus_no) - 1 as int) as tid from (select chrom, unnest(min(row(line_no, locus_no)), recursive := true) from (select chrom, line_no, locus_no from lo) group by chrom) t(chrom, line_no, locus_no)",
    "revcomp": f"select p_partkey, {_RC.format(_UNIT.format('p_partkey'))} as rc from part",
    "min_rotation": f"select p_partkey, {_rotated('unit')} as rotation from (select p_partkey, {_UNIT.format('p_partkey')} as unit from part)",
    "canonical_unit": f"select p_partkey, {_canonical('unit')} as canonical from (select p_partkey, {_UNIT.format('p_partkey')} as unit from part)",
    "match_frequency": f"""with s as (select doc_id, string_split(coalesce({_SEQ}, ''), '') as l, length(coalesce({_SEQ}, '')) as n from documents), q as (select *, unnest(range(2, 21)) as period from s),
        m as (select doc_id, period, n, case when period <= n // 2 then len(list_filter(list_zip(l[1:n - period], l[period + 1:n]), lambda x: x[1] = x[2])) else 0 end as matches from q)
        select doc_id, period, cast(matches as bigint) as matches, case when period <= n // 2 then matches / (n - period) else 0.0::double end as frequency from m""",
    "consensus_unit": f"""with s as (select doc_id, {_SEQ} as seq from documents where length({_SEQ}) >= 6), b as (select doc_id, unnest(range(0, length(seq))) as i, unnest(string_split(seq, '')) as base from s),
        v as (select doc_id, i % 3 as phase, base, count(*) as n from b group by all), w as (select *, row_number() over (partition by doc_id, phase order by n desc, base desc) as r from v)
        select doc_id, string_agg(base, '' order by phase) as unit from w where r = 1 group by doc_id""",
    "motif_candidates": f"with {_SK}, {_RD} select tid, seq, unnest(motifs) as motif from (select distinct tid, seq, qual, motifs from mo)",
    "best_motif": f"with {_SK}, {_RD} select tid, seq, motif as best from (select distinct tid, seq, qual, motif from mo)",
    "sample_n": "select c as confidence, p as probability, cast(ceil(ln(1 - c) / ln(1 - p)) as bigint) as n from (values (0.95::double, 0.01::double), (0.9, 0.05), (0.95, 0.5), (0.0, 0.5)) t(c, p)",
    "sample_lines": f"select o_orderkey as line_no, o_orderkey || chr(9) || o_orderstatus as value from orders order by md5('42:' || o_orderkey), o_orderkey limit {_SAMPLE}",
    "profile_candidates": f"with {_SK}, {_RD}, {_CA} select ord, tid, pos, qname, flag, n_fetched, array_to_string(motifs, ',') as motifs from ca",
    "profile_anchors": f"""with {_SK}, {_RD}, {_CA}, {_AN} select tid, "start", "end", count(*) as n from an group by all""",
    "profile_summary": f"""with {_SK}, {_RD}, {_CA}, {_AN}, {_CM.format(5, "an")}, mg as (select tid, s as "start", e as "end", count(*) as irr_count from cm group by all), {_OV},
        mm as (select tid, s as "start", e as "end", motif, count(*) as n from (select tid, s, e, unnest(motifs) as motif from cm) group by all)
        select 'chr' || tid as chrom, "start", "end", irr_count, motif, n from mg join mm using (tid, "start", "end") join ov using (tid, "start", "end") where overlap / ("end" - "start") <= 0.8""",
    "sinks_bed": f"""with {_SK}, {_RD}, rr as (select qname, ord, case when motif is not null and ((flag & 4) <> 0 or mapq <= 40) then 'IRR' when (flag & 4) = 0 and mapq > 40 and mapq >= 50 then 'ANCHOR' end as role, motif, tid,
            case when (flag & 4) = 0 then pos end as "start", case when (flag & 4) = 0 then end_pos end as "end" from mo where (flag & 256) = 0), r2 as (select * from rr where role is not null), {_PAIRED.format("r2")},
        em as (select motif, tid, "start", "end" from pc where n = 2 and role = 'IRR' and "start" is not null)
        select 'chr' || tid as chrom, "start", "end", motif, n as irr_count from ({_islands("em", "motif, tid", 0)})""",
    "cram_path": """select p_partkey, path, regexp_matches(lower(regexp_replace(path, '[?#].*$', '')), '\\.cram$') as is_cram
        from (select p_partkey, replace(p_name, ' ', '/') || (['.cram', '.CRAM?x=1', '.bam', '.cram.crai', '#.cram', '.cRaM#a'])[p_partkey % 6 + 1] as path from part)""",
    "bed_parse": f"""with {_SK} select sk0.* from (select cast(o_orderkey % p.n as int) as tid, {_DAY.format("o_orderdate")} as "start", {_DAY.format("o_orderdate")} + 20 + o_orderkey % 60 as "end" from orders, p where o_orderkey % 10 <> 0) sk0""",
    "depth_last": "select 'sample' || (o_custkey % 50) as sample_id, arg_max(o_totalprice, o_orderkey) as depth from orders group by 1",
}
