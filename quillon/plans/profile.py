"""profile: reads in repeat regions whose sequence is a repeat, located by their mates and counted by motif."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quillon.functions.motif import with_motifs
from quillon.operators.intervals import exclude_covered, join_hulls, local_islands, merge_regions, merge_within, overlapping_pairs
from quillon.schema import MATE_UNMAPPED, SECONDARY, SUPPLEMENTARY, UNMAPPED, ProfileParams

KEY = ("file_id", "tid", "pos", "qname", "flag")


@dataclass(frozen=True)
class Profile:
    """candidates: the distinct repeat reads with motifs and n_fetched. summary: the anchor regions. metrics: one row."""

    candidates: DataFrame
    summary: DataFrame
    metrics: DataFrame


def eligible(reads: DataFrame, max_mapq: int) -> DataFrame:
    """Mapped primary reads of low mapping quality; duplicates and reads that fail quality control stay."""
    return reads.where((F.col("flag").bitwiseAND(UNMAPPED + SECONDARY + SUPPLEMENTARY) == 0) & (F.col("mapq") <= max_mapq))


def candidates(reads: DataFrame, regions: DataFrame, params: ProfileParams) -> DataFrame:
    """Distinct repeat reads that overlap a region, with motifs, and n_fetched: the regions that each overlaps.

    Of reads equal in file, place, name and flags the first in the file counts. regions must be merged.
    """
    rows = eligible(reads, params.max_irr_mapq).withColumn("end_pos", F.greatest("end_pos", F.col("pos") + 1))
    met = overlapping_pairs(rows, regions)
    value = [c for c in reads.columns if c not in KEY]
    once = met.groupBy(*KEY).agg(F.min_by(F.struct(*value), "ord").alias("_row"), F.count("*").alias("n_fetched"))
    rows = once.select(*KEY, "_row.*", "n_fetched")
    found = with_motifs(rows, params.motif_min_len, params.motif_max_len)
    return found.where(F.size("motifs") > 0).drop("best")


def anchors(found: DataFrame, params: ProfileParams) -> DataFrame:
    """Where the mates of candidates lie, one read long; candidates whose mate is not placed have none."""
    placed = found.where((F.col("flag").bitwiseAND(MATE_UNMAPPED) == 0) & (F.col("mtid") >= 0))
    return placed.select(F.col("mtid").alias("tid"), F.col("mpos").alias("start"), (F.col("mpos") + params.read_length).alias("end"), "motifs")


def count_anchors(found: DataFrame, distance: int, covered: DataFrame | None = None, fraction: float = 1.0) -> DataFrame:
    """(tid, start, end, irr_count, motifs): anchors (tid, start, end, motifs) clustered and counted.

    A read counts once in irr_count and once for each of its motifs. Clusters of which covered (merged regions)
    covers more than a fraction are left out.
    """
    local = local_islands(found, distance)
    own = ["tid", "_bin", "_local"]
    hulls = local.groupBy(*own).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    hulls = join_hulls(hulls, distance)
    by_motif = local.select(*own, F.explode(F.array_distinct("motifs")).alias("motif")).groupBy(*own, "motif").agg(F.count("*").alias("n"))
    island = ["tid", "island"]
    counts = hulls.groupBy(*island).agg(F.min("island_start").alias("start"), F.max("island_end").alias("end"), F.sum("n").alias("irr_count"))
    if covered is not None:
        counts = exclude_covered(counts, covered, fraction)
    motifs = hulls.select(*own, "island").join(by_motif, own).groupBy(*island, "motif").agg(F.sum("n").alias("n"))
    maps = motifs.groupBy(*island).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("motif", "n")))).alias("motifs"))
    return counts.join(maps, island, "left").select("tid", "start", "end", "irr_count", F.coalesce("motifs", F.create_map().cast("map<string,bigint>")).alias("motifs"))


def _candidate_counts() -> list:
    placed = (F.col("flag").bitwiseAND(MATE_UNMAPPED) == 0) & (F.col("mtid") >= 0)
    fetched = F.coalesce(F.sum("n_fetched"), F.lit(0)).alias("pass_count")
    return [fetched, F.count("*").alias("distinct"), F.count_if(placed).alias("anchored"), F.count_if(~placed).alias("unanchored")]


def profile(
    reads: DataFrame, contigs: DataFrame, sinks: DataFrame, exclude: DataFrame | None = None, params: ProfileParams = ProfileParams(), store: Callable[[DataFrame], DataFrame] | None = None
) -> Profile:
    """reads: READS; contigs (tid, name, length); sinks and exclude: regions (tid, start, end), merged here.

    store, for instance DataFrame.persist, is given the candidates, which several results read.
    """
    regions = merge_regions(sinks)
    found = candidates(reads, regions, params)
    if store is not None:
        found = store(found)
    where = anchors(found, params)
    covered = merge_regions(sinks.unionByName(exclude)) if exclude is not None else regions
    kept = count_anchors(where, params.anchor_merge_distance, covered, params.exclude_overlap_fraction)
    named = kept.join(contigs.select("tid", F.col("name").alias("chrom")), "tid")
    summary = named.select("tid", "chrom", "start", "end", "irr_count", "motifs").orderBy("tid", "start", "end").drop("tid")
    clusters = merge_within(where.select("tid", "start", "end"), params.anchor_merge_distance)
    left = exclude_covered(clusters, covered, params.exclude_overlap_fraction)
    one = lambda rows, name: rows.agg(F.count("*").alias(name))
    metrics = one(sinks, "bed_regions").crossJoin(one(regions, "fetches")).crossJoin(found.agg(*_candidate_counts()))
    metrics = metrics.crossJoin(one(clusters, "clusters")).crossJoin(one(left, "kept_clusters"))  # one row each
    return Profile(found, summary, metrics.withColumn("sink_excluded", F.col("clusters") - F.col("kept_clusters")))
