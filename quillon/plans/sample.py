"""Uniform sample of lines without replacement, of a size set by confidence and probability."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillon.functions.sampling import sample_key, sample_size


def sample_n(lines: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n of the lines (line_no, ...) in their order; fewer if there are fewer.

    The n least keys are found with bounded memory in each task, since Spark plans a limit after an order
    as a top-n.
    """
    key = sample_key(F.col("line_no"), seed)
    drawn = lines.withColumn("_key", key).orderBy("_key", "line_no").limit(n)
    return drawn.drop("_key").orderBy("line_no")


def sample(lines: DataFrame, confidence: float, probability: float, seed: int = 42) -> DataFrame:
    """As many lines as the confidence asks for; ValueError if there are not enough."""
    n = sample_size(confidence, probability)
    have = lines.count()
    if have < n:
        raise ValueError(f"not enough lines: {n} are needed for confidence {confidence} and probability {probability}, there are {have}")
    return sample_n(lines, n, seed)
