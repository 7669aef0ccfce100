"""The motif finder: facts, and the vectorised form against a plain one."""

import random

import numpy as np
import pytest

from quillon.functions import motif as m

A20G = "A" * 20 + "G"


def row(text):
    return np.frombuffer(text.encode(), np.uint8)


def high(text, q=40):
    return bytes([q]) * len(text)


def ids(text, lo=1, hi=20, q=40):
    return m.identify_repeat_motifs(text.encode(), high(text, q), lo, hi)


def test_frequency():
    got = [float(m.frequency(row("GGCCCCGGCCCC"), p)) for p in range(1, 7)]
    assert got == pytest.approx([0.73, 0.40, 0.33, 0.25, 0.57, 1.00], abs=0.01)
    assert float(m.frequency(row("ATGATCATGTTGATG"), 3)) == pytest.approx(8 / 12)
    assert float(m.frequency(row("ATGATC"), 4)) == 0.0


@pytest.mark.parametrize("text, want", [("GGCCCCGGCCCC", 6), ("ATGATCATGATGATGATGATG", 6), ("ATCGGCTA", None)])
def test_smallest_period(text, want):
    assert m.perfect_period(text.encode(), 20, 0.85) == want


def test_consensus_and_canonical():
    assert m.consensus(row("CGGCGGCGG")[None], 3)[0].tobytes() == b"CGG"
    assert m.consensus(row("CGGATTATTATTCGG")[None], 3)[0].tobytes() == b"ATT"
    assert m._least_rotations(row("GGC")[None]).tolist() == [b"CGG"]
    assert m.canonicals(np.stack([row("CGG"), row("GCC"), row("AAA")])).tolist() == [b"CCG", b"CCG", b"AAA"]
    assert [m.canonical(u) for u in (b"CGG", b"GCC", b"GATA")] == [b"CCG", b"CCG", b"AGAT"]


def test_reads():
    assert ids("CAG" * 20) == ["AGC"]
    assert ids("N" * 60) == [] and ids("") == []
    assert ids("ACGTTGCAACGGTTCAGTAGCTAGCATCGATCGTAGCTAGGCTAGCATCGTAGCTAGCA") == []
    assert set(ids(A20G * 16, 1, 30)) == {"A", A20G}
    assert m.best_repeat_motif((A20G * 16).encode(), high(A20G * 16), 1, 30) == A20G
    assert ids("A" * 60, 2) == []


def test_first_passing_rotation_decides():
    read = ("G" + "A" * 19) * 8
    assert m.best_repeat_motif(read.encode(), high(read, 10), 1, 20) == "A"


def test_phase_decides_whether_a_reduced_unit_is_found():
    assert ids("ATATA" * 20, 2, 9) == [] and ids("AATAT" * 20, 2, 9) == ["AATAT"]
    assert ids("ATATA" * 20, 2, 20) == ["AATAT"]


def plain(bases, quals, lo, hi):
    """One read at a time, straight from the definition."""
    n = len(bases)

    def freq(s, p):
        return 0.0 if len(s) // 2 + 1 <= p else sum(a == b for a, b in zip(s, s[p:])) / (len(s) - p)

    def unit_of(s, p):
        return "".join(max(((s[i::p].count(c), c) for c in set(s[i::p])))[1] for i in range(p))

    def rc(s):
        return "".join({"A": "T", "T": "A", "C": "G", "G": "C"}.get(c, "N") for c in reversed(s))

    def turn(s):
        return min((s[i:] + s[:i] for i in range(len(s))), default=s)

    def score(motif, s, q):
        best = float("-inf")
        for i in range(len(motif)):
            u = motif[i:] + motif[:i]
            best = max(best, sum(1 if s[k] == u[k % len(u)] else 0.5 if q[k] < 20 else -1 for k in range(n)))
            if best >= 0.9 * n:
                break
        return best

    found = []
    for p in range(max(lo, 1), min(hi, n // 2 + 1) + 1):
        if freq(bases, p) < 0.8:
            continue
        unit = unit_of(bases, p)
        reduced, top = None, 1.0
        for r in range(min(20, len(unit) // 2 + 1), 0, -1):
            if freq(unit, r) >= top:
                reduced = r
        if reduced is not None and reduced != p:
            unit = unit_of(unit, reduced)
        if not lo <= len(unit) <= hi:
            continue
        motif = min(turn(unit), turn(rc(unit)))
        if motif in ("", "N") or motif in [f[0] for f in found]:
            continue
        s = score(motif, bases, quals)
        if s < 0.9 * n:
            s = max(s, score(motif, rc(bases), quals[::-1]))
        if s / n >= 0.9:
            found.append((motif, s / n))
    return found


def test_against_the_plain_form():
    r = random.Random(5)
    reads = []
    for _ in range(1200):
        unit = "".join(r.choice("ACGT") for _ in range(r.randint(1, 12)))
        n = r.randint(1, 90)
        s = list((unit * n)[r.randint(0, 5) :][:n] or "A")
        for _ in range(r.choice((0, 0, 1, 3, 8))):
            s[r.randrange(len(s))] = r.choice("ACGTN")
        reads.append(("".join(s), bytes(r.choice((5, 19, 20, 40)) for _ in s)))
    for lo, hi in ((1, 20), (2, 20), (2, 7), (1, 30)):
        got = m.detect([s.encode() for s, _ in reads], [q for _, q in reads], lo, hi)
        assert got == [plain(s, q, lo, hi) for s, q in reads]


def test_odd_reads():
    assert ids("cag" * 20) == ["AGC"]
    assert m.detect([b"=" * 40, None, b""], [None, None, b""], 1, 20) == [[], [], []]
    assert m.detect([b"CAG" * 20], [None], 1, 20)[0][0][0] == "AGC"


@pytest.mark.parametrize("filtered", ["size(motifs) > 0", "best is not null"])
def test_the_finder_runs_once(spark, tmp_path, filtered):
    """A filter on the finder's result and a projection of it share one run."""
    rows = [("CAG" * 20, None), ("ACGTTGCAACGGTTCAGTAGCTAGCATCGATCGTAGCTAGGCTAGCATCGTAGCTAGCA", None), (None, None)]
    spark.createDataFrame(rows, "seq string, qual binary").write.parquet(str(tmp_path / "r"))
    found = m.with_motifs(spark.read.parquet(str(tmp_path / "r"))).where(filtered).select("seq", "motifs")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [r.motifs for r in found.collect()] == [["AGC"]]
