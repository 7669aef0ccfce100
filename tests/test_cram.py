"""CRAM: numbers, codecs against encoders of the test, features with a reference, and round trips."""

import io
import random
import struct
from collections import Counter, namedtuple

import pytest

from quillon.schema import READS
from quillon.sources import alignments, cram
from tests.test_files import VALUES, plain

Read = namedtuple("Read", "qname flag tid pos mapq cigar mtid mpos seq qual")


def test_numbers():
    r = random.Random(1)
    for value in [0, 1, -1, 127, 128, 1 << 14, (1 << 28) - 1, 1 << 28, (1 << 31) - 1, -(1 << 31), *(r.randint(-(1 << 31), (1 << 31) - 1) >> r.randint(0, 31) for _ in range(500))]:
        assert cram.Cursor(cram.itf8(value)).itf8() == value
    for value in [0, 127, 128, (1 << 49) - 1, 1 << 49, 1 << 56, (1 << 63) - 1, *(r.getrandbits(63) >> r.randint(0, 62) for _ in range(500))]:
        assert cram.Cursor(cram.ltf8(value)).ltf8() == value


def scaled(counts):
    """Frequencies that add up to 4096."""
    total = sum(counts.values())
    freq = {s: max(1, n * 4096 // total) for s, n in counts.items()}
    while (more := 4096 - sum(freq.values())) != 0:
        top = max(freq, key=freq.get)
        freq[top] += more if more > 0 else max(more, 1 - freq[top])
    return freq


def table(freq):
    """Symbols in order, runs of neighbours in short."""
    out, symbols = bytearray(), sorted(freq)
    run = 0
    for i, s in enumerate(symbols):
        if run:
            run -= 1
        else:
            out.append(s)
            if i and symbols[i - 1] == s - 1:
                while i + run + 1 < len(symbols) and symbols[i + run + 1] == s + run + 1:
                    run += 1
                out.append(run)
        f = freq[s]
        f = f if not isinstance(f, bytes) else f
        out += f if isinstance(f, bytes) else bytes((f,)) if f < 128 else bytes((0x80 | f >> 8, f & 0xFF))
    return bytes(out) + b"\0"


def rans(data, order):
    """An encoder: symbols last to first, each into the state that decodes it."""
    part = len(data) // 4
    if order == 0:
        freqs = {0: scaled(Counter(data))}
        steps = [(i & 3, 0, x) for i, x in enumerate(data)]
        head = table(freqs[0])
    else:
        steps, last, pairs = [], [0] * 4, {}
        places = [(k, k * part + i) for i in range(part) for k in range(4)] + [(3, i) for i in range(4 * part, len(data))]
        for k, at in places:
            steps.append((k, last[k], data[at]))
            pairs.setdefault(last[k], Counter())[data[at]] += 1
            last[k] = data[at]
        freqs = {c: scaled(n) for c, n in pairs.items()}
        head = table({c: table(f) for c, f in freqs.items()})
    starts = {}
    for c, f in freqs.items():
        at = 0
        for s in sorted(f):
            starts[c, s] = at
            at += f[s]
    states, out = [1 << 23] * 4, bytearray()
    for k, c, x in reversed(steps):
        f = freqs[c][x]
        while states[k] >= (1 << 19) * f:
            out.append(states[k] & 0xFF)
            states[k] >>= 8
        states[k] = (states[k] // f << 12) + states[k] % f + starts[c, x]
    body = head + struct.pack("<4I", *states) + bytes(reversed(out))
    return struct.pack("<BII", order, len(body), len(data)) + body


@pytest.mark.parametrize("order", [0, 1])
def test_rans(order):
    r = random.Random(order)
    for data in (b"A", b"ABCD", b"\0\0\0\0\0", bytes(range(256)) * 3, bytes(r.choices(b"ACGTN", (9, 5, 5, 9, 1), k=5001)), bytes(r.choices(range(30, 45), k=3003))):
        assert cram.rans(rans(data, order)) == data


def test_bits():
    core = cram.Bits(bytes((0b10110010, 0b01110000)))
    codes = cram._huffman([7, 3, 9], [1, 2, 2], core)
    assert [codes() for _ in range(5)] == [9 if b == "11" else 3 if b == "10" else 7 for b in ("10", "11", "0", "0", "10")]
    assert cram._huffman([5], [0], core)() == 5


def some(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.random()
        size = r.randint(30, 150)
        seq = "".join(r.choices("ACGTN", (9, 9, 9, 9, 1), k=size))
        cigar = r.choice((f"{size}M", f"5S{size - 9}M4I", f"3H{size - 10}M6D10M", f"{size - 20}M900N20M2H", f"{size - 8}M2P8M"))
        flag = r.choice((65, 129, 97, 145, 81, 2113, 1024 + 65))
        tid, pos, mapq = r.randint(0, 1), r.randint(0, 9000), r.randint(0, 60)
        if kind < 0.1:
            flag, tid, pos, mapq, cigar = 77, -1, -1, 0, "*"
        elif kind < 0.2:
            flag, mapq, cigar = 69, 0, "*"
        elif kind < 0.25:
            seq = ""
        qual = bytes(r.choices(range(2, 42), k=len(seq))) if kind < 0.9 else b"\xff" * len(seq)
        rows.append(Read(f"r{i}", flag, tid, pos, mapq, cigar, r.randint(-1, 1), r.randint(-1, 9000), seq, qual))
    return rows


def reference_end(row):
    n, at = 0, row.pos
    for c in row.cigar if row.cigar != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            at, n = at + (n if c in "MDN=X" else 0), 0
    return at


def test_slices():
    rows = some(800, 3)
    blocks, ids, records, bases = cram.encode_slice(rows)
    file = io.BytesIO(cram.file_start("@HD\tVN:1.6\n") + cram.slice_container(blocks, ids, records, bases, 40) + cram.file_end())
    assert cram.header_text(file)[0] == "@HD\tVN:1.6\n"
    ((place, size, counter),) = cram.containers(file)
    file.seek(place)
    got = list(cram.container_records(file.read(size), counter, None))
    assert [g[0] for g in got] == [*range(40, 840)] and records == 800
    assert [g[1:11] for g in got] == [tuple(r) for r in rows] and [g[11] for g in got] == [reference_end(r) for r in rows]
    broken = bytearray(file.getvalue()[place : place + size])
    broken[40] ^= 1
    with pytest.raises(ValueError):
        list(cram.container_records(bytes(broken), 0, None))


def test_features_of_a_reference():
    """Substitutions, gaps and mates that a file leaves to the reference and to the next record of the template."""
    letters = "ACGTACGTACGTTTGACCATGCAACGTAGG"
    series = {k: [] for k in "BF CF RL AP RG RN NF TL FN FC FP BS IN DL MQ QS".split()}
    # first: 4M, a substitution, an insertion of two, 3M, a deletion of two, 4M; its mate is the next record, which matches throughout
    for name, values in {"BF": [65, 145], "CF": [4, 0], "RL": [14, 6], "AP": [3, 10], "RG": [-1, -1], "NF": [0], "TL": [0, 0], "FN": [3, 0], "FP": [5, 1, 5], "DL": [2], "MQ": [30, 40]}.items():
        series[name] = b"".join(map(cram.itf8, values))
    series |= {"RN": b"pair\0pair\0", "FC": b"XID", "BS": b"\x02", "IN": b"GG\0", "QS": b""}
    ids = {name: i + 1 for i, name in enumerate(series)}
    external = lambda i: cram.itf8(1) + cram.itf8(1) + cram.itf8(i)
    stop = lambda i: cram.itf8(5) + cram.itf8(2) + b"\0" + cram.itf8(i)
    sized = lambda entries: (lambda body: cram.itf8(len(body)) + body)(cram.itf8(len(entries)) + b"".join(entries))
    head = sized([b"RN\x01", b"AP\x01", b"RR\x01", b"SM" + b"\x1b" * 5, b"TD" + cram.itf8(1) + b"\0"])
    head += sized([n.encode() + (stop if n in ("RN", "IN") else external)(i) for n, i in ids.items()]) + sized([])
    slice_ = b"".join(map(cram.itf8, (0, 0, 30, 2))) + cram.ltf8(0) + cram.itf8(len(ids) + 1) + cram.itf8(len(ids) + 1) + cram.itf8(0) + b"".join(map(cram.itf8, ids.values())) + cram.itf8(-1) + bytes(16)
    body = cram.write_block(cram._COMPRESSION, 0, head) + cram.write_block(cram._SLICE, 0, slice_) + cram.write_block(cram._CORE, 0, b"")
    body += b"".join(cram.write_block(cram._EXTERNAL, ids[n], series[n]) for n in ids)
    first, second = cram.container_records(body, 0, lambda tid, a, b: letters[a:b])
    at = 2
    base = [b for b in "ACGTN" if b != letters[at + 4]][2]
    want = letters[at : at + 4] + base + "GG" + letters[at + 5 : at + 8] + letters[at + 10 : at + 14]
    assert first[1:10] == ("pair", 97, 0, 2, 30, "5M2I3M2D4M", 0, 12, want) and first[11] == 16
    assert second[1:10] == ("pair", 145, 0, 12, 40, "6M", 0, 2, letters[12:18]) and second[11] == 18


def test_fasta(tmp_path):
    (tmp_path / "x.fa").write_text(">a first\nACGT\nacgt\n>b\nGG\nTT")
    fasta = cram.Fasta(lambda: open(tmp_path / "x.fa", "rb"), ["a", "b", "c"])
    assert fasta(0, 2, 6) == "GTAC" and fasta(1, 1, 4) == "GTT"
    for bad in ((1, 2, 9), (2, 0, 1)):
        with pytest.raises(ValueError):
            fasta(*bad)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignments, "SLICE_READS", 150)
    rows = [("x", i, *r[:9], bytearray(r.qual), reference_end(r)) for i, r in enumerate(some(1200, 9))]
    frame = spark.createDataFrame(rows, READS)
    contigs = spark.createDataFrame([(0, "chr1", 20000), (1, "chr2", 20000)], "tid int, name string, length long")
    path = str(tmp_path / "a.cram")
    assert alignments.write_cram(frame, contigs, path) == 1200
    want = plain(frame.orderBy("tid", "pos", "ord").select(*VALUES).collect())
    for split in (1 << 30, 4000):
        got = alignments.read_alignments(spark, path, "none.fa", split_bytes=split)
        assert (got.rdd.getNumPartitions() > 3) == (split == 4000)
        assert plain(got.orderBy("ord").select(*VALUES).collect()) == want
    assert [tuple(r) for r in alignments.contigs_of(spark, path).collect()] == [(0, "chr1", 20000), (1, "chr2", 20000)]
