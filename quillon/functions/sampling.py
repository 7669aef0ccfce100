"""How large a sample must be, and how it is drawn."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def sample_size(confidence: float, probability: float) -> int:
    """Rows needed to see, with the confidence, at least one case of something of the probability."""
    if not 0 <= confidence < 1:
        raise ValueError(f"confidence must be in [0, 1), not {confidence}")
    if not 0 < probability < 1:
        raise ValueError(f"probability must be in (0, 1), not {probability}")
    return math.ceil(math.log1p(-confidence) / math.log1p(-probability))


def sample_key(line_no: Column, seed: int) -> Column:
    """A key whose order is random but depends on nothing but seed and line."""
    return F.md5(F.concat(F.lit(f"{seed}:"), line_no.cast("string")))
