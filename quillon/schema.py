"""Schemas, flag bits and checked parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

# SAM flag bits.
PAIRED, UNMAPPED, MATE_UNMAPPED, READ1, READ2, SECONDARY, SUPPLEMENTARY = 1, 4, 8, 64, 128, 256, 2048

READS = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("tid", T.IntegerType()),
        T.StructField("pos", T.LongType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("mtid", T.IntegerType()),
        T.StructField("mpos", T.LongType()),
        T.StructField("seq", T.StringType()),
        T.StructField("qual", T.BinaryType()),
        T.StructField("end_pos", T.LongType()),
    ]
)
CONTIGS = "tid int, name string, length long"
REGIONS = "tid int, start long, end long"
SUMMARY = "chrom string, start long, end long, irr_count long, motifs map<string,long>"


def _at_least(name: str, value, least) -> None:
    if value < least:
        raise ValueError(f"{name} must be at least {least}, not {value}")


@dataclass(frozen=True)
class MotifParams:
    """Bounds on the length of a motif."""

    motif_min_len: int = 2
    motif_max_len: int = 20

    def __post_init__(self):
        _at_least("motif_min_len", self.motif_min_len, 0)
        _at_least("motif_max_len", self.motif_max_len, 0)


@dataclass(frozen=True)
class ProfileParams(MotifParams):
    max_irr_mapq: int = 40
    anchor_merge_distance: int = 500
    read_length: int = 150
    exclude_overlap_fraction: float = 0.8

    def __post_init__(self):
        super().__post_init__()
        _at_least("anchor_merge_distance", self.anchor_merge_distance, 0)
        _at_least("read_length", self.read_length, 1)


@dataclass(frozen=True)
class SinksParams(MotifParams):
    max_irr_mapq: int = 40
    min_anchor_mapq: int = 50
    merge_distance: int = 0

    def __post_init__(self):
        super().__post_init__()
        _at_least("merge_distance", self.merge_distance, 0)


@dataclass(frozen=True)
class MergeParams:
    merge_distance: int = 500
    batch_size: int = 100
    target_depth: float = 30.0

    def __post_init__(self):
        _at_least("merge_distance", self.merge_distance, 0)
        _at_least("batch_size", self.batch_size, 1)
        if not (math.isfinite(self.target_depth) and self.target_depth > 0):
            raise ValueError(f"target_depth must be positive, not {self.target_depth}")
