"""merge: loci of many samples clustered, summed by sample and motif, scaled to one depth, and pivoted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quillon.operators.intervals import checked, join_hulls, local_islands
from quillon.schema import MergeParams


def contig_ids(loci: DataFrame) -> DataFrame:
    """(chrom, tid): contigs numbered by first appearance in the manifest, then in the file."""
    first = loci.groupBy("chrom").agg(F.min(F.struct("line_no", "locus_no")).alias("first"))
    return first.select("chrom", (F.dense_rank().over(Window.orderBy("first", "chrom")) - 1).cast("int").alias("tid"))  # a row for each contig


def merged_counts(loci: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """Sums by locus and sample, and by locus, motif and sample, of loci (sample_id, chrom, start, end, irr_count, motifs).

    Both carry chrom, start, end of the merged locus. Rows of a sample that meet in a locus are added up.
    """
    local = local_islands(checked(loci), distance, ("chrom",))
    own = ["chrom", "_bin", "_local"]
    hulls = join_hulls(local.groupBy(*own).agg(F.min("start").alias("start"), F.max("end").alias("end")), distance, ("chrom",))
    to = hulls.select(*own, F.col("island_start").alias("start"), F.col("island_end").alias("end"))
    locus = ["chrom", "start", "end"]
    by_sample = local.groupBy(*own, "sample_id").agg(F.sum("irr_count").alias("n"))
    by_sample = by_sample.join(to, own).groupBy(*locus, "sample_id").agg(F.sum("n").alias("n"))
    by_motif = local.select(*own, "sample_id", F.explode("motifs").alias("motif", "n")).groupBy(*own, "motif", "sample_id").agg(F.sum("n").alias("n"))
    by_motif = by_motif.join(to, own).groupBy(*locus, "motif", "sample_id").agg(F.sum("n").alias("n"))
    return by_sample, by_motif


def normalised(counts: DataFrame, depths: DataFrame | None, target: float) -> DataFrame:
    """counts with value: n * target / depth, or n itself without depths. A sample without a usable depth is an error."""
    if depths is None:
        return counts.withColumn("value", F.col("n").cast("double"))
    rows = counts.join(depths.select("sample_id", "depth"), "sample_id", "left")
    lacking = F.raise_error(F.format_string("no depth for sample %s", F.col("sample_id"))).cast("double")
    useless = F.raise_error(F.format_string("the depth of sample %s must be positive and finite, not %s", F.col("sample_id"), F.col("depth").cast("string"))).cast("double")
    usable = (F.col("depth") > 0) & (F.col("depth") < float("inf"))
    depth = F.when(F.col("depth").isNull(), lacking).when(usable, F.col("depth")).otherwise(useless)
    return rows.withColumn("value", F.col("n").cast("double") * F.lit(float(target)) / depth).drop("depth")


def _entries(key: str, value: str):
    return F.array_sort(F.collect_list(F.struct(key, value)))


def merge(loci: DataFrame, depths: DataFrame | None = None, params: MergeParams = MergeParams()) -> DataFrame:
    """(chrom, start, end, irr_count map<sample, value>, motifs map<motif, map<sample, value>>) in contig order.

    loci: (line_no, sample_id, locus_no, chrom, start, end, irr_count, motifs), as the summary reader gives.
    batch_size is checked but has no effect: the clusters don't depend on batches.
    """
    by_sample, by_motif = merged_counts(loci, params.merge_distance)
    locus = ["chrom", "start", "end"]
    counts = normalised(by_sample, depths, params.target_depth).groupBy(*locus).agg(F.map_from_entries(_entries("sample_id", "value")).alias("irr_count"))
    motifs = normalised(by_motif, depths, params.target_depth).groupBy(*locus, "motif").agg(_entries("sample_id", "value").alias("by_sample"))
    nested = F.transform(_entries("motif", "by_sample"), lambda e: F.struct(e["motif"], F.map_from_entries(e["by_sample"])))
    motifs = motifs.groupBy(*locus).agg(F.map_from_entries(nested).alias("motifs"))
    none = F.create_map().cast("map<string,map<string,double>>")
    out = counts.join(motifs, locus, "left").join(contig_ids(loci), "chrom")
    return out.select("tid", *locus, "irr_count", F.coalesce("motifs", none).alias("motifs")).orderBy("tid", "start", "end").drop("tid")
