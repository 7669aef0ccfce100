"""sinks: repeat reads confirmed by their mates, clustered by motif."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quillon.functions.motif import with_motifs
from quillon.operators.intervals import merge_within
from quillon.operators.pairing import confirmed, pairs
from quillon.schema import SECONDARY, SUPPLEMENTARY, UNMAPPED, SinksParams


@dataclass(frozen=True)
class Sinks:
    """regions: (tid, start, end, motif, irr_count) in output order. metrics: one row."""

    regions: DataFrame
    metrics: DataFrame


def classified(reads: DataFrame, params: SinksParams) -> DataFrame:
    """(file_id, qname, ord, role, motif, tid, start, end): reads that are IRR or ANCHOR; others are left out.

    An unplaced IRR has no start. Only sequences of reads that may be IRR go through the motif finder.
    """
    rows = reads.where(F.col("flag").bitwiseAND(SECONDARY + SUPPLEMENTARY) == 0)
    unmapped = F.col("flag").bitwiseAND(UNMAPPED) != 0
    maybe = unmapped | (F.col("mapq") <= params.max_irr_mapq)
    span = F.when(~unmapped, F.col("pos")).alias("start"), F.when(~unmapped, F.col("end_pos")).alias("end")
    own = ["file_id", "qname", "ord"]
    irr = with_motifs(rows.where(maybe), params.motif_min_len, params.motif_max_len).where(F.col("best").isNotNull())
    irr = irr.select(*own, F.lit("IRR").alias("role"), F.col("best").alias("motif"), "tid", *span)
    anchor = rows.where(~maybe & (F.col("mapq") >= params.min_anchor_mapq))
    anchor = anchor.select(*own, F.lit("ANCHOR").alias("role"), F.lit(None).cast("string").alias("motif"), "tid", *span)
    return irr.unionByName(anchor)


def sinks(reads: DataFrame, contigs: DataFrame | None = None, params: SinksParams = SinksParams()) -> Sinks:
    """reads: READS. Names pair inside a file. With contigs the regions have chrom, too."""
    rows = classified(reads, params).withColumn("name", F.struct("file_id", "qname"))
    regions = merge_within(confirmed(rows, "name").select("motif", "tid", "start", "end"), params.merge_distance, ("motif", "tid"))
    regions = regions.select("tid", "start", "end", "motif", F.col("n").alias("irr_count"))
    if contigs is not None:
        regions = regions.join(contigs.select("tid", F.col("name").alias("chrom")), "tid").select("tid", "chrom", "start", "end", "motif", "irr_count")
    paired = pairs(rows, "name")
    emitted = (F.col("n") == 2) & (F.col("role") == "IRR") & F.col("start").isNotNull()
    metrics = paired.agg(
        F.count_if(emitted & (F.col("n_irr") == 1)).alias("anchored"), F.count_if(emitted & (F.col("n_irr") == 2)).alias("paired"), F.count_if(F.col("n") == 1).alias("unresolved")
    )
    metrics = metrics.crossJoin(reads.agg(F.count("*").alias("scanned"))).crossJoin(regions.agg(F.count("*").alias("rows")))  # one row each
    return Sinks(regions.orderBy("tid", "start", "end", "motif"), metrics)
