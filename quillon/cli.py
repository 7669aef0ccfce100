"""Command line: profile, sinks, merge and sample, each a file-to-file run of the flow of that name."""

from __future__ import annotations

import argparse
import logging
import sys

from quillon.schema import MergeParams, ProfileParams, SinksParams

log = logging.getLogger("quillon")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillon", description="Tandem-repeat screening of short reads")
    top.add_argument("-v", "--verbose", action="count", default=0)
    commands = top.add_subparsers(dest="command", required=True)

    p = commands.add_parser("profile", help="locate repeat reads by their mates")
    p.add_argument("--sink-bed", required=True)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--summary", required=True)
    p.add_argument("-o", "--output")
    p.add_argument("--exclude-bed")
    p.add_argument("-r", "--reference")
    p.add_argument("--output-format", choices=("bam", "cram"))
    p.add_argument("--max-irr-mapq", type=int, default=40)
    p.add_argument("--motif-min-len", type=int, default=2)
    p.add_argument("--motif-max-len", type=int, default=20)
    p.add_argument("--anchor-merge-distance", type=int, default=500)
    p.add_argument("--read-length", type=int, default=150)
    p.add_argument("--exclude-overlap-fraction", type=float, default=0.8)
    p.add_argument("--threads", type=int, default=1, help="accepted; Spark sets the parallelism")

    p = commands.add_parser("sinks", help="regions that attract repeat reads")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--max-irr-mapq", type=int, default=40)
    p.add_argument("--min-anchor-mapq", type=int, default=50)
    p.add_argument("--motif-min-len", type=int, default=2)
    p.add_argument("--motif-max-len", type=int, default=20)
    p.add_argument("--merge-distance", type=int, default=0)
    p.add_argument("-r", "--reference")
    p.add_argument("--threads", type=int, default=1, help="accepted; Spark sets the parallelism")

    p = commands.add_parser("merge", help="combine the summaries of many samples")
    p.add_argument("--manifest", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--merge-distance", type=int, default=500)
    p.add_argument("--batch-size", type=int, default=100)
    p.add_argument("--depths")
    p.add_argument("--target-depth", type=float, default=30.0)

    p = commands.add_parser("sample", help="draw lines, as many as a confidence asks for")
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-c", "--confidence", type=float, required=True)
    p.add_argument("-p", "--probability", type=float, required=True)
    p.add_argument("--no-header", action="store_true")
    p.add_argument("--seed", type=int, default=42)
    return top


def _report(command: str, metrics) -> None:
    """Log a run's counts; they are only made up if someone reads them."""
    if log.isEnabledFor(logging.INFO):
        log.info("%s: %s", command, metrics())


def run_profile(spark, args) -> None:
    from pyspark.sql import DataFrame

    from quillon.operators.intervals import merge_regions
    from quillon.plans.profile import profile
    from quillon.sources import alignments, paths, text, writers

    out = paths.output_format(args.output, args.output_format) if args.output else None
    paths.check_reference(args.reference, cram=paths.is_cram_path(args.input) or out == "cram")
    params = ProfileParams(args.motif_min_len, args.motif_max_len, args.max_irr_mapq, args.anchor_merge_distance, args.read_length, args.exclude_overlap_fraction)
    contigs = alignments.contigs_of(spark, args.input)
    sinks = text.read_bed(spark, args.sink_bed, contigs)
    exclude = text.read_bed(spark, args.exclude_bed, contigs) if args.exclude_bed else None
    if sinks.isEmpty():
        log.warning("%s holds no regions", args.sink_bed)
    reads = alignments.read_alignments(spark, args.input, args.reference, regions=merge_regions(sinks))
    found = profile(reads, contigs, sinks, exclude, params, DataFrame.persist)  # the reads are scanned once
    writers.write_json(found.summary, args.summary)
    written = 0
    if args.output:
        write = alignments.write_cram if out == "cram" else alignments.write_bam
        written = write(found.candidates, contigs, args.output, alignments.header_text(args.input))
        if out == "bam":
            alignments.write_index(args.output)
    _report("profile", lambda: found.metrics.drop("kept_clusters").collect()[0].asDict() | {"written": written})
    found.candidates.unpersist()


def run_sinks(spark, args) -> None:
    from quillon.plans.sinks import sinks
    from quillon.sources import alignments, paths, writers

    paths.check_reference(args.reference, cram=paths.is_cram_path(args.input))
    params = SinksParams(args.motif_min_len, args.motif_max_len, args.max_irr_mapq, args.min_anchor_mapq, args.merge_distance)
    found = sinks(alignments.read_alignments(spark, args.input, args.reference), alignments.contigs_of(spark, args.input), params)
    rows = writers.write_bed(found.regions, args.output)
    _report("sinks", lambda: found.metrics.collect()[0].asDict() | {"rows": rows})


def run_merge(spark, args) -> None:
    from quillon.plans.merge import merge
    from quillon.sources import text, writers

    params = MergeParams(args.merge_distance, args.batch_size, args.target_depth)
    manifest = text.read_manifest(spark, args.manifest)
    depths = text.read_depths(spark, args.depths) if args.depths else None
    if depths is None:
        log.warning("no depths: counts are not scaled")
    if manifest.isEmpty():
        log.warning("%s names no samples", args.manifest)
    loci = text.read_summaries(spark, manifest).persist()
    written = writers.write_json(merge(loci, depths, params), args.output)
    _report("merge", lambda: {"samples": (n := manifest.count()), "batches": -(-n // params.batch_size), "loci": loci.count(), "clusters": written})
    loci.unpersist()


def run_sample(spark, args) -> None:
    from quillon.functions.sampling import sample_size
    from quillon.plans.sample import sample
    from quillon.sources import text, writers

    n = sample_size(args.confidence, args.probability)
    header, lines = text.data_lines(spark, args.input, not args.no_header)
    drawn = writers.write_lines(header, sample(lines, args.confidence, args.probability, args.seed), args.output)
    _report("sample", lambda: {"drawn": drawn, "seen": lines.count(), "n": n, "confidence": args.confidence, "probability": args.probability, "seed": args.seed})


def main(argv: list[str] | None = None, spark=None) -> int:
    """Run a command; 1 if it fails, with the error in the log."""
    args = parser().parse_args(argv)
    logging.basicConfig(level=max(logging.WARNING - 10 * args.verbose, logging.DEBUG))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(f"quillon {args.command}").getOrCreate()
    from quillon.plans.ship import ship

    ship(spark)
    try:
        {"profile": run_profile, "sinks": run_sinks, "merge": run_merge, "sample": run_sample}[args.command](spark, args)
    except Exception as error:
        log.error("%s failed: %s", args.command, error, exc_info=args.verbose > 0)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
