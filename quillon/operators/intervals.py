"""Interval algebra on DataFrames of half-open regions.

Merging is gaps-and-islands on the running maximum of the ends. It runs in two levels: first inside bins
of coordinates, which spreads one contig over many tasks, then from bin to bin, of which only the largest end
is carried on: what starts within reach of it belongs to the last island that began before the bin. So no
task holds more than a bin, or one row for each bin of a contig.

Overlaps are joins on (contig, bin): both sides are listed in the bins they touch, so a contig with a third
of all rows is spread too. Nothing is broadcast unless Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MERGE_BIN = 1 << 20
JOIN_BIN = 1 << 14


def checked(regions: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """regions, or an error when one is empty or reversed."""
    bad = F.raise_error(F.format_string("empty interval [%s, %s)", F.col(start).cast("string"), F.col(end).cast("string")))
    return regions.withColumn(end, F.when(F.col(end) > F.col(start), F.col(end)).otherwise(bad.cast("long")))


def _bin(column: Column | str, size: int) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column / F.lit(size)).cast("long")


def _islands(rows: DataFrame, by: list[str], distance: int, name: str) -> DataFrame:
    """rows with an island number, counted from the first by start inside each group of by."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + F.lit(distance)), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def local_islands(regions: DataFrame, distance: int = 0, by: tuple[str, ...] = ("tid",), bin_size: int = MERGE_BIN) -> DataFrame:
    """regions with _bin and _local: the islands among those that start in the same bin."""
    if distance < 0:
        raise ValueError("a merge distance must not be negative")
    return _islands(regions.withColumn("_bin", _bin("start", bin_size)), [*by, "_bin"], distance, "_local")


def _across(hulls: DataFrame, distance: int, by: tuple[str, ...]) -> DataFrame:
    """Local islands' hulls (by, _bin, _local, start, end, ...) with the number of the island that each belongs to."""
    own = [*by, "_bin"]
    bins = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    number = (F.col("_bin") * F.lit(1 << 32) + F.col("_local")).alias("island")
    reach = hulls.groupBy(*own).agg(F.max("_raw" if "_raw" in hulls.columns else "end").alias("_top")).select(*own, F.max("_top").over(bins).alias("_reach"))
    rows = hulls.join(reach, own).withColumn("_head", F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + F.lit(distance)))
    last = rows.groupBy(*own).agg(F.max(F.when(F.col("_head"), number)).alias("_last"))
    before = last.select(*own, F.last("_last", ignorenulls=True).over(bins).alias("_before"))
    rows = rows.join(before, own).withColumn("island", F.when(F.col("_head"), number).otherwise(F.col("_before")))
    return rows.drop("_reach", "_head", "_before")


def join_hulls(hulls: DataFrame, distance: int = 0, by: tuple[str, ...] = ("tid",)) -> DataFrame:
    """Local islands' hulls (by, _bin, _local, start, end) with island, island_start and island_end."""
    rows = _across(hulls, distance, by)
    whole = rows.groupBy(*by, "island").agg(F.min("start").alias("island_start"), F.max("end").alias("island_end"))
    return rows.join(whole, [*by, "island"])


def merge_within(regions: DataFrame, distance: int = 0, by: tuple[str, ...] = ("tid",), bin_size: int = MERGE_BIN) -> DataFrame:
    """(by, start, end, n): clusters of regions at most distance apart, with the number of regions in each."""
    # only the branch that gives the ends checks them: where two stages fail at once, Spark reports that and not the error
    local = checked(local_islands(regions.withColumn("_raw", F.col("end")), distance, by, bin_size))
    hulls = local.groupBy(*by, "_bin", "_local").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("_raw").alias("_raw"), F.count("*").alias("n"))
    joined = _across(hulls, distance, by)
    found = joined.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("island")
    return found.where("end is not null")  # it never is: so that the ends are checked even if only rows are counted


def merge_regions(regions: DataFrame, by: tuple[str, ...] = ("tid",)) -> DataFrame:
    """Overlapping and touching regions as one."""
    return merge_within(regions, 0, by).drop("n")


def with_islands(regions: DataFrame, distance: int = 0, by: tuple[str, ...] = ("tid",), bin_size: int = MERGE_BIN) -> tuple[DataFrame, DataFrame]:
    """regions with _bin and _local, and the islands by (by, _bin, _local), to which counts can be joined."""
    local = local_islands(checked(regions), distance, by, bin_size)
    hulls = local.groupBy(*by, "_bin", "_local").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return local, join_hulls(hulls, distance, by).drop("start", "end")


def _listed(rows: DataFrame, start: str, end: str, size: int) -> DataFrame:
    return rows.withColumn("_bin", F.explode(F.sequence(_bin(start, size), _bin(F.col(end) - 1, size))))


def overlap_length(left: DataFrame, right: DataFrame, bin_size: int = JOIN_BIN) -> DataFrame:
    """left (tid, start, end, ...) with overlap: how much of each the regions of right (merged) cover.

    Rows of left that are equal in all columns count as one. Each bin adds the part that lies in it, and a
    row without a partner adds nothing.
    """
    keys = left.columns
    a = _listed(left, "start", "end", bin_size)
    b = _listed(right.select("tid", F.col("start").alias("_s"), F.col("end").alias("_e")), "_s", "_e", bin_size)
    low = F.greatest("start", "_s", F.col("_bin") * bin_size)
    high = F.least("end", "_e", (F.col("_bin") + 1) * bin_size)
    part = F.when(F.col("_s").isNotNull() & (high > low), high - low).otherwise(F.lit(0))
    return a.join(b, ["tid", "_bin"], "left").groupBy(*keys).agg(F.sum(part).cast("long").alias("overlap"))


def exclude_covered(regions: DataFrame, sinks: DataFrame, fraction: float, bin_size: int = JOIN_BIN) -> DataFrame:
    """regions of which at most fraction is covered by sinks (merged)."""
    found = overlap_length(regions, sinks, bin_size)
    return found.where(F.col("overlap") / (F.col("end") - F.col("start")) <= F.lit(float(fraction)))


def locate(points: DataFrame, regions: DataFrame, bin_size: int = JOIN_BIN) -> DataFrame:
    """points (tid, pos, ...) with region_start and region_end of the merged region that holds each, or null."""
    b = _listed(regions.select("tid", F.col("start").alias("region_start"), F.col("end").alias("region_end")), "region_start", "region_end", bin_size)
    a = points.withColumn("_bin", _bin("pos", bin_size)).alias("a")
    hit = (F.col("a.tid") == F.col("b.tid")) & (F.col("a._bin") == F.col("b._bin")) & (F.col("pos") >= F.col("region_start")) & (F.col("pos") < F.col("region_end"))
    return a.join(b.alias("b"), hit, "left").select(*[F.col(f"a.{c}") for c in points.columns], "region_start", "region_end")


def overlapping_pairs(rows: DataFrame, regions: DataFrame, start: str = "pos", end: str = "end_pos", bin_size: int = JOIN_BIN) -> DataFrame:
    """rows once for each region that they overlap, with region_start and region_end.

    A pair that meets in several bins counts in the first only.
    """
    b = _listed(regions.select("tid", F.col("start").alias("region_start"), F.col("end").alias("region_end")), "region_start", "region_end", bin_size)
    a = _listed(rows, start, end, bin_size)
    meet = (F.col(start) < F.col("region_end")) & (F.col("region_start") < F.col(end))
    first = F.col("_bin") == F.greatest(_bin(start, bin_size), _bin("region_start", bin_size))
    return a.join(b, ["tid", "_bin"]).where(meet & first).drop("_bin")
