"""Text sources: numbered lines, BED regions, manifests, depths, profile summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon.schema import SUMMARY


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a file from 0, without line ends.

    A line's number is its place in its part of the file plus the lines of the parts before, of which there is one row each.
    """
    rows = spark.read.text(path, lineSep="\n").withColumn("at", F.monotonically_increasing_id())
    rows = rows.select("value", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("first"))
    lines = rows.join(F.broadcast(starts), "part")
    return lines.select((F.col("first") + F.col("place")).alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def data_lines(spark: SparkSession, path: str, header: bool = True) -> tuple[str | None, DataFrame]:
    """The header, if one is expected, and the lines after it, numbered from 0."""
    lines = numbered_lines(spark, path)
    if not header:
        return None, lines
    first = lines.where("line_no = 0").collect()
    if not first:
        raise ValueError(f"{path} is empty but a header is expected; use --no-header if it has none")
    return first[0].value, lines.where("line_no > 0").withColumn("line_no", F.col("line_no") - 1)


def _fail(text: str, *columns):
    return F.raise_error(F.format_string(text, *columns))


def parse_bed(lines: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions (tid, start, end) of BED lines (line_no, value); blank lines and headers are skipped.

    A line that is too short, has no number or an empty interval, or names no known contig is an error with its number.
    """
    rows = lines.select((F.col("line_no") + 1).alias("line_no"), F.trim("value").alias("value"))
    rows = rows.where("value <> '' and not startswith(value, '#') and not startswith(value, 'track') and not startswith(value, 'browser')")
    f = F.split("value", "\t")
    rows = rows.select("line_no", f[0].alias("name"), F.get(f, F.lit(1)).alias("s"), F.get(f, F.lit(2)).alias("e"))
    rows = rows.select("line_no", "name", F.expr("try_cast(s as bigint)").alias("start"), F.expr("try_cast(e as bigint)").alias("end"))
    joined = rows.join(contigs.select("name", "tid"), "name", "left")
    at = F.col("line_no").cast("string")
    tid = (
        F.when(F.col("start").isNull() | F.col("end").isNull(), _fail("BED line %s: three columns are needed, with numbers in the last two", at).cast("int"))
        .when(F.col("end") <= F.col("start"), _fail("BED line %s: the end must be greater than the start", at).cast("int"))
        .when(F.col("tid").isNull(), _fail("BED line %s: unknown contig %s", at, F.col("name")).cast("int"))
        .otherwise(F.col("tid"))
    )
    return joined.select(tid.alias("tid"), "start", "end")


def read_bed(spark: SparkSession, path: str, contigs: DataFrame) -> DataFrame:
    return parse_bed(numbered_lines(spark, path), contigs)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(numbered_lines(spark, path))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(line_no, sample_id, path) of lines (line_no, value) of sample, TAB, path; a path may hold TABs; blank lines are skipped."""
    rows = lines.select("line_no", F.trim("value").alias("value")).where("value <> ''")
    f = F.split("value", "\t", 2)
    bad = _fail("manifest line %s: sample, TAB and path are needed", (F.col("line_no") + 1).cast("string"))
    return rows.select("line_no", f[0].alias("sample_id"), F.when(F.size(f) == 2, F.get(f, F.lit(1))).otherwise(bad.cast("string")).alias("path"))


def read_depths(spark: SparkSession, path: str) -> DataFrame:
    return parse_depths(numbered_lines(spark, path))


def parse_depths(lines: DataFrame) -> DataFrame:
    """(sample_id, depth) of lines (line_no, value) of sample, TAB, number; of a repeated sample the last line counts."""
    rows = lines.select("line_no", F.trim("value").alias("value")).where("value <> ''")
    f = F.split("value", "\t", 2)
    rows = rows.select("line_no", f[0].alias("sample_id"), F.trim(F.get(f, F.lit(1))).alias("text"))
    depth = F.expr("try_cast(text as double)")
    bad = _fail("depths line %s: sample, TAB and a number are needed", (F.col("line_no") + 1).cast("string"))
    rows = rows.withColumn("depth", F.when(depth.isNull(), bad.cast("double")).otherwise(depth))
    return rows.groupBy("sample_id").agg(F.max_by("depth", "line_no").alias("depth"))


def parse_summaries(files: DataFrame) -> DataFrame:
    """(line_no, sample_id, locus_no, chrom, start, end, irr_count, motifs) of whole files (line_no, sample_id, value).

    Each holds an array of loci; a missing field or a negative count is an error.
    """
    options = {"mode": "FAILFAST"}
    rows = files.select("line_no", "sample_id", F.posexplode(F.from_json("value", f"array<struct<{SUMMARY.replace(' long', ':long').replace(' string', ':string').replace(' map', ':map')}>>", options)).alias("locus_no", "l"))
    rows = rows.select("line_no", "sample_id", F.col("locus_no").cast("long").alias("locus_no"), "l.*")
    lacking = F.col("chrom").isNull() | F.col("start").isNull() | F.col("end").isNull() | F.col("irr_count").isNull() | F.col("motifs").isNull()
    negative = (F.col("irr_count") < 0) | F.exists(F.map_values("motifs"), lambda n: n.isNull() | (n < 0))
    bad = _fail("summary of sample %s, locus %s: a field is missing or a count is negative", F.col("sample_id"), F.col("locus_no").cast("string"))
    return rows.withColumn("chrom", F.when(lacking | negative, bad.cast("string")).otherwise(F.col("chrom")))


def read_summaries(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Loci of all files that a manifest (line_no, sample_id, path) names, as parse_summaries().

    A path named twice is read once and counts twice.
    """
    rows = manifest.collect()  # a row for each sample; paths must be known to be read
    if not rows:
        return spark.createDataFrame([], f"line_no long, sample_id string, locus_no long, {SUMMARY}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def full(path: str) -> str:
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(conf).makeQualified(at).toUri().getPath()

    named = spark.createDataFrame([(r.line_no, r.sample_id, full(r.path)) for r in rows], "line_no long, sample_id string, file string")
    texts = spark.read.text(sorted({r.path for r in rows}), wholetext=True).select("value", F.col("_metadata.file_path").alias("uri"))
    where = F.url_decode(F.regexp_replace(F.regexp_replace("uri", r"\+", "%2B"), "^[a-z0-9]+:(//[^/]*)?", ""))
    return parse_summaries(texts.withColumn("file", where).join(named, "file").select("line_no", "sample_id", "value"))
