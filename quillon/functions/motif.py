"""Tandem-repeat motifs of reads, vectorised over reads of equal length.

For each period the share of letters that recur one period on is computed for all reads at once. Only
reads with a share of at least MIN_FREQUENCY go on: their consensus units are voted for at once, the distinct
ones are reduced and made canonical at once, and all reads with a motif of one length are scored at once,
rotation by rotation, leaving out a read as soon as it passes. A read's score for a motif is therefore that of the first
rotation that passes, which decides between motifs of one read as the definition asks.

Letters other than A to Z, and '=', count as N; lower case as upper. Missing qualities count as high. A null
or empty read has no motif.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the definition.
MIN_FREQUENCY, MIN_SCORE, LOW_QUALITY = 0.8, 0.90, 20
MATCH, LOW_MISMATCH, MISMATCH = 1.0, 0.5, -1.0
REDUCE_MAX = 20

_CLEAN = np.full(256, ord("N"), np.uint8)
_CLEAN[65:91] = np.arange(65, 91)
_CLEAN[97:123] = np.arange(65, 91)
_COMPLEMENT = np.full(256, ord("N"), np.uint8)
for _a, _b in zip(b"ATCG", b"TAGC"):
    _COMPLEMENT[_a] = _b


def frequency(bases: np.ndarray, offset: int) -> np.ndarray:
    """Share of letters equal to the one offset on, for rows of letters; 0 beyond half their length."""
    n = bases.shape[-1]
    if offset > n // 2 or offset < 1:
        return np.zeros(bases.shape[:-1])
    return (bases[..., :-offset] == bases[..., offset:]).sum(axis=-1) / (n - offset)


def consensus(bases: np.ndarray, period: int) -> np.ndarray:
    """The most frequent letter at each phase of each row, the larger letter in a tie."""
    k, n = bases.shape
    padded = np.zeros((k, -(-n // period) * period), np.uint8)
    padded[:, :n] = bases
    phases = padded.reshape(k, -1, period)
    unit, most = np.zeros((k, period), np.uint8), np.zeros((k, period), np.int64)
    for letter in np.unique(bases)[::-1]:
        votes = (phases == letter).sum(axis=1)
        unit[votes > most] = letter
        np.maximum(most, votes, out=most)
    return unit


def _strings(rows: np.ndarray) -> np.ndarray:
    """Rows of letters as strings of bytes, which numpy can compare."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0]


def _least_rotations(units: np.ndarray) -> np.ndarray:
    """The least rotation in byte order of each row."""
    best = _strings(units)
    for turn in range(1, units.shape[1]):
        other = _strings(np.roll(units, -turn, axis=1))
        best = np.where(other < best, other, best)
    return best


def canonicals(units: np.ndarray) -> np.ndarray:
    """For each row of letters the lesser of the least rotations of it and of its reverse complement."""
    own, other = _least_rotations(units), _least_rotations(_COMPLEMENT[units[:, ::-1]])
    return np.where(other < own, other, own)


def canonical(unit: bytes) -> bytes:
    return canonicals(np.frombuffer(unit, np.uint8)[None])[0] if unit else unit


def perfect_period(unit: bytes, most: int = REDUCE_MAX, least: float = 1.0) -> int | None:
    """The smallest period of 1..most that attains the highest frequency of at least least, if any does."""
    row = np.frombuffer(unit, np.uint8)
    best = [(frequency(row, p), -p) for p in range(1, min(most, len(unit) // 2 + 1) + 1)]
    found = max((b for b in best if b[0] >= least), default=None)
    return -found[1] if found else None


def _perfect_periods(units: np.ndarray, most: int = REDUCE_MAX) -> np.ndarray:
    """The smallest period of 1..most at which all letters of a row recur, 0 if there is none."""
    k, n = units.shape
    found = np.zeros(k, np.int64)
    for period in range(min(most, n // 2), 0, -1):
        found[(units[:, :-period] == units[:, period:]).all(axis=1)] = period
    return found


def motifs_of(units: np.ndarray, shortest: int, longest: int) -> list[bytes | None]:
    """The canonical motif that each consensus unit stands for, None if its length is out of bounds or it is N."""
    found: list[bytes | None] = [None] * len(units)
    periods = _perfect_periods(units)
    for period in np.unique(periods).tolist():
        size = period or units.shape[1]
        if shortest <= size <= longest:
            at = np.flatnonzero(periods == period)
            reduced = consensus(units[at], period) if period else units[at]
            for i, motif in zip(at.tolist(), canonicals(reduced).tolist()):
                found[i] = None if motif in (b"", b"N") else motif
    return found


def _rotation_scores(bases: np.ndarray, low: np.ndarray, units: np.ndarray, enough: float) -> np.ndarray:
    """Each row's best score over rotations, in order, of its own unit, up to the first that is enough."""
    k, n = bases.shape
    miss = np.where(low, np.float32(LOW_MISMATCH), np.float32(MISMATCH))  # sums of halves are exact
    best, rest, place = np.full(k, -np.inf), np.arange(k), np.arange(n)
    size = units.shape[1]
    for turn in range(size):
        tiled = units[rest][:, (place + turn) % size]
        score = np.where(bases[rest] == tiled, np.float32(MATCH), miss[rest]).sum(axis=1, dtype=np.float64)
        best[rest] = np.maximum(best[rest], score)
        rest = rest[best[rest] < enough]
        if not len(rest):
            break
    return best


def _equal_length(bases: np.ndarray, quals: np.ndarray, shortest: int, longest: int) -> list[list[tuple[bytes, float]]]:
    """Accepted (motif, score) of each row in order of discovery."""
    k, n = bases.shape
    found: list[list[tuple[bytes, float]]] = [[] for _ in range(k)]
    tried: list[set] = [set() for _ in range(k)]
    low, enough = quals < LOW_QUALITY, MIN_SCORE * n
    for period in range(max(shortest, 1), min(longest, n // 2) + 1):
        rows = np.flatnonzero(frequency(bases, period) >= MIN_FREQUENCY)
        if not len(rows):
            continue
        units, back = np.unique(_strings(consensus(bases[rows], period)), return_inverse=True)
        named = motifs_of(units.view(np.uint8).reshape(-1, period), shortest, longest)
        by_size: dict[int, list[tuple[int, bytes]]] = {}
        for row, i in zip(rows.tolist(), back.tolist()):
            motif = named[i]
            if motif is not None and motif not in tried[row]:
                tried[row].add(motif)  # scored again it would fare the same
                by_size.setdefault(len(motif), []).append((row, motif))
        for size, mine in by_size.items():
            at = np.array([row for row, _ in mine])
            turns = np.frombuffer(b"".join(motif for _, motif in mine), np.uint8).reshape(-1, size)
            score = _rotation_scores(bases[at], low[at], turns, enough)
            late = np.flatnonzero(score < enough)
            if len(late):
                turned = _COMPLEMENT[bases[at[late], ::-1]]
                score[late] = np.maximum(score[late], _rotation_scores(turned, low[at[late], ::-1], turns[late], enough))
            for (row, motif), s in zip(mine, score / n):
                if s >= MIN_SCORE:
                    found[row].append((motif, float(s)))
    return found


def detect(seqs: list[bytes], quals: list[bytes | None], shortest: int = 2, longest: int = 20) -> list[list[tuple[str, float]]]:
    """Accepted (motif, score) of each read in order of discovery."""
    out: list[list[tuple[str, float]]] = [[] for _ in seqs]
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(seqs):
        if s:
            by_length.setdefault(len(s), []).append(i)
    for n, rows in by_length.items():
        bases = _CLEAN[np.frombuffer(b"".join(seqs[i] for i in rows), np.uint8).reshape(-1, n)]
        high = b"\xff" * n
        quality = np.frombuffer(b"".join(((quals[i] or b"") + high)[:n] for i in rows), np.uint8).reshape(-1, n)
        for i, motifs in zip(rows, _equal_length(bases, quality, shortest, longest)):
            out[i] = [(m.decode(), s) for m, s in motifs]
    return out


def identify_repeat_motifs(bases: bytes, quals: bytes, shortest: int = 2, longest: int = 20) -> list[str]:
    """All motifs of one read."""
    return [m for m, _ in detect([bases], [quals], shortest, longest)[0]]


def best_repeat_motif(bases: bytes, quals: bytes, shortest: int = 2, longest: int = 20) -> str | None:
    """The motif of the highest score of one read, the first found in a tie."""
    return best_of(detect([bases], [quals], shortest, longest)[0])


def best_of(found: list[tuple[str, float]]) -> str | None:
    return max(found, key=lambda f: f[1])[0] if found else None


def motifs(seq: Column | str, qual: Column | str, shortest: int = 2, longest: int = 20) -> Column:
    """struct(motifs, best) of reads, by an Arrow-batched UDF.

    It is marked as not deterministic, though it is, so that Spark runs it once where a filter and a
    projection both use its result.
    """

    @F.pandas_udf("motifs array<string>, best string")
    def of(seqs: pd.Series, quals: pd.Series) -> pd.DataFrame:
        found = detect([(s or "").encode("latin-1", "replace") for s in seqs], [None if q is None else bytes(q) for q in quals], shortest, longest)
        return pd.DataFrame({"motifs": [[m for m, _ in f] for f in found], "best": [best_of(f) for f in found]})

    return of.asNondeterministic()(seq, qual)


def with_motifs(reads: DataFrame, shortest: int = 2, longest: int = 20) -> DataFrame:
    """reads (seq, qual, ...) with motifs, of which there may be none, and best."""
    found = reads.withColumn("_found", motifs("seq", "qual", shortest, longest))
    return found.select(*reads.columns, "_found.motifs", "_found.best")
