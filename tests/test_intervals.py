"""Interval operators: facts, and SQL-free brute force on random regions."""

import random

import pytest
from pyspark.errors import PySparkException

from quillon.operators import intervals as iv

REGIONS = "tid int, start long, end long"


def merged(spark, rows, d, **more):
    found = iv.merge_within(spark.createDataFrame(rows, REGIONS), d, **more)
    return sorted(tuple(r) for r in found.select("tid", "start", "end", "n").collect())


def brute(rows, d):
    out = []
    for t, s, e in sorted(rows):
        if out and out[-1][0] == t and s <= out[-1][2] + d:
            out[-1] = (t, out[-1][1], max(out[-1][2], e), out[-1][3] + 1)
        else:
            out.append((t, s, e, 1))
    return out


def test_merge_facts(spark):
    rows = [(0, 20, 30), (0, 35, 40)]
    assert len(merged(spark, rows, 5)) == 1 and len(merged(spark, rows, 4)) == 2
    assert merged(spark, [(0, 0, 100), (0, 10, 20), (0, 90, 95), (0, 100, 110)], 0) == [(0, 0, 110, 4)]
    assert merged(spark, [], 0) == []


@pytest.mark.parametrize("bin_size", [8, 64, 1 << 20])
def test_merge_in_two_levels(spark, bin_size):
    r = random.Random(bin_size)
    rows = [(r.randint(0, 2), s := r.randint(0, 400), s + r.choice((1, 3, 9, 80))) for _ in range(150)]
    for d in (0, 2, 10):
        assert merged(spark, rows, d, bin_size=bin_size) == brute(rows, d)


def test_bad_input(spark):
    with pytest.raises(ValueError):
        merged(spark, [(0, 1, 2)], -1)
    with pytest.raises(PySparkException):
        merged(spark, [(0, 5, 5)], 0)


def test_an_empty_interval_is_one_error(spark):
    """Each time: two stages that fail at once would be reported as such, and not as the error that both met."""
    rows = spark.createDataFrame([(0, 1, 2), (0, 5, 5)], REGIONS)
    for _ in range(8):
        with pytest.raises(PySparkException, match="empty interval"):
            iv.merge_within(rows, 0).collect()
    with pytest.raises(PySparkException, match="empty interval"):
        iv.merge_within(rows, 0).count()


def test_overlap_facts(spark):
    right = spark.createDataFrame([(0, 10, 20), (0, 30, 50)], REGIONS)
    left = spark.createDataFrame([(0, 15, 25), (0, 25, 60), (0, 0, 60), (0, 60, 70), (1, 0, 60)], REGIONS)
    for size in (4, 16, 1 << 14):
        got = {(r.tid, r.start): r.overlap for r in iv.overlap_length(left, right, size).collect()}
        assert got == {(0, 15): 5, (0, 25): 20, (0, 0): 30, (0, 60): 0, (1, 0): 0}
    kept = iv.exclude_covered(left, right, 0.5).collect()
    assert sorted((r.tid, r.start) for r in kept) == [(0, 0), (0, 15), (0, 60), (1, 0)]


def test_locate_and_pairs(spark):
    regions = spark.createDataFrame([(0, 10, 20), (0, 30, 50)], REGIONS)
    points = spark.createDataFrame([(0, p) for p in (9, 10, 19, 20, 30, 49, 50)] + [(1, 10), (None, 3)], "tid int, pos long")
    got = {(r.tid, r.pos): r.region_start for r in iv.locate(points, regions, 8).collect()}
    assert got == {(0, 9): None, (0, 10): 10, (0, 19): 10, (0, 20): None, (0, 30): 30, (0, 49): 30, (0, 50): None, (1, 10): None, (None, 3): None}
    rows = spark.createDataFrame([(0, 0, 11), (0, 15, 35), (0, 20, 30), (0, 0, 100)], "tid int, pos long, end_pos long")
    got = sorted((r.pos, r.end_pos, r.region_start) for r in iv.overlapping_pairs(rows, regions, bin_size=8).collect())
    assert got == [(0, 11, 10), (0, 100, 10), (0, 100, 30), (15, 35, 10), (15, 35, 30)]
