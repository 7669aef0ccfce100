"""Merging summaries as they arrive: running sums by locus in a table, rewritten with each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.plans.merge import merged_counts

_LOCI = "line_no long, sample_id string, locus_no long, chrom string, start long, end long, irr_count long, motifs map<string,long>"


class RunningMerge:
    """Loci of all batches so far, as rows that merge() takes; a batch of the stream adds to them.

    Each version is a table of its own in folder, and the newest complete one counts, so a batch that is
    run again after a failure starts from the same state. Merging merged loci with new ones gives the same
    clusters as merging all at once, since a cluster is only known by its hull.
    """

    def __init__(self, spark: SparkSession, folder: str, distance: int):
        self.spark, self.folder, self.distance = spark, folder.rstrip("/"), distance

    def _path(self, version: int) -> str:
        return f"{self.folder}/v{version:012d}"

    def state(self, before: int | None = None) -> DataFrame:
        """The newest complete state, or that of versions under before."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        system = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        versions = []
        if system.exists(at):
            for s in system.listStatus(at):
                name = s.getPath().getName()
                if name.startswith("v") and system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                    versions.append(int(name[1:]))
        found = [v for v in versions if before is None or v < before]
        return self.spark.read.schema(_LOCI).parquet(self._path(max(found))) if found else self.spark.createDataFrame([], _LOCI)

    def add(self, batch: DataFrame, version: int) -> None:
        """For foreachBatch: loci (line_no, sample_id, locus_no, chrom, start, end, irr_count, motifs)."""
        rows = self.state(before=version).unionByName(batch.select(*[c.split(" ")[0] for c in _LOCI.split(", ")]))
        locus = ["chrom", "start", "end"]
        counts, motifs = merged_counts(rows, self.distance)
        maps = motifs.groupBy(*locus, "sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("motif", "n")))).alias("motifs"))
        first = rows.groupBy("chrom").agg(F.min(F.struct("line_no", "locus_no")).alias("first"))
        out = counts.join(maps, [*locus, "sample_id"], "left").join(first, "chrom")
        out = out.select("first.line_no", "sample_id", "first.locus_no", *locus, F.col("n").alias("irr_count"), F.coalesce("motifs", F.create_map().cast("map<string,bigint>")).alias("motifs"))
        out.write.mode("overwrite").parquet(self._path(version))
