"""CRAM 3.0 in plain Python: containers read one by one, and written without a need for the reference.

Blocks may be raw, gzip, bzip2, lzma or rANS 4x8; codecs of 3.1 are refused with an error. Written files hold all
bases (nothing is left to the reference), one slice for each container, gzip blocks and detached mates; = and X become
M, as always in CRAM, and a placed read without operations gets M for its letters. Decoding is far slower than BAM's.
"""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections import defaultdict

# Fixed values of the format.
_MAGIC, _VERSION = b"CRAM", (3, 0)
_EOF = bytes.fromhex("0f000000ffffffff0fe0454f4600000000010005bdd94f0001000606010001000100ee63014b")
_FILE_HEADER, _COMPRESSION, _SLICE, _EXTERNAL, _CORE = 0, 1, 2, 4, 5
_BASES = "ACGTN"
_BYTE_SERIES = frozenset(("FC", "BA", "QS", "BS"))
_ARRAY_SERIES = frozenset(("RN", "IN", "SC", "BB", "QQ"))
_QUALITIES, _DETACHED, _MATE_NEXT, _NO_BASES = 1, 2, 4, 8
_UNMAPPED, _MATE_UNMAPPED, _MATE_REVERSED, _REVERSED = 4, 8, 32, 16


# --- numbers and blocks --------------------------------------------------------------------------


class Cursor:
    """Bytes with a place."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("a CRAM block ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def until(self, stop: int) -> bytes:
        end = self.data.index(stop, self.at)
        out, self.at = self.data[self.at : end], end + 1
        return out

    def itf8(self) -> int:
        """A number of 32 bits: as many leading ones in the first byte as bytes follow, four at most."""
        first = self.byte()
        more = 0 if first < 0x80 else 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        if more < 4:
            value = first & (0xFF >> (more + 1))
            for _ in range(more):
                value = value << 8 | self.byte()
        else:
            value = first & 0x0F
            for _ in range(3):
                value = value << 8 | self.byte()
            value = value << 4 | self.byte() & 0x0F
        return value - (1 << 32) if value >= 1 << 31 else value

    def ltf8(self) -> int:
        """A number of 64 bits in the same manner, up to eight more bytes."""
        first = self.byte()
        more = next((i for i in range(8) if not first & 0x80 >> i), 8)
        value = first & (0x7F >> more) if more < 7 else 0
        for _ in range(more):
            value = value << 8 | self.byte()
        return value - (1 << 64) if value >= 1 << 63 else value

    def numbers(self) -> list[int]:
        return [self.itf8() for _ in range(self.itf8())]


def itf8(value: int) -> bytes:
    value &= 0xFFFFFFFF
    for more, limit in enumerate((1 << 7, 1 << 14, 1 << 21, 1 << 28)):
        if value < limit:
            lead = (0xFF00 >> more) & 0xFF
            return (value | lead << (8 * more)).to_bytes(more + 1, "big")
    return bytes((0xF0 | value >> 28, value >> 20 & 0xFF, value >> 12 & 0xFF, value >> 4 & 0xFF, value & 0x0F))


def ltf8(value: int) -> bytes:
    for more in range(8):
        if value < 1 << (7 * (more + 1)):
            lead = (0xFF00 >> more) & 0xFF
            return (value | lead << (8 * more)).to_bytes(more + 1, "big")
    return b"\xff" + value.to_bytes(8, "big")


def _frequencies(c: Cursor, whole: bool) -> tuple[list[int], list[int], bytes]:
    """Frequency and start of each symbol, and the symbol of each of 4096 slots."""
    freq, start, slots = [0] * 256, [0] * 256, bytearray()
    symbol, run = c.byte(), 0
    while True:
        f = c.byte()
        if f >= 0x80:
            f = (f & 0x7F) << 8 | c.byte()
        f = 4096 if whole and f == 0 else f
        freq[symbol], start[symbol] = f, len(slots)
        slots += bytes((symbol,)) * f
        if not run and c.data[c.at] == symbol + 1:
            symbol, run = c.byte(), c.byte()
        elif run:
            run, symbol = run - 1, symbol + 1
        else:
            symbol = c.byte()
        if not symbol:
            return freq, start, bytes(slots.ljust(4096, b"\0"))


def rans(data: bytes) -> bytes:
    """Decode rANS 4x8 of order 0 or 1: four states in turn, 12-bit frequencies."""
    order, _, size = struct.unpack_from("<BII", data)
    c, out = Cursor(data, 9), bytearray(size)
    if not size:
        return b""
    tables: dict[int, tuple] = {}
    if order == 0:
        tables[0] = _frequencies(c, False)
    else:
        context, run = c.byte(), 0
        while True:
            tables[context] = _frequencies(c, True)
            if not run and c.data[c.at] == context + 1:
                context, run = c.byte(), c.byte()
            elif run:
                run, context = run - 1, context + 1
            else:
                context = c.byte()
            if not context:
                break
    states = list(struct.unpack("<4I", c.take(16)))
    at, last = c.at, [0] * 4
    part = size // 4

    def step(k: int, context: int) -> int:
        nonlocal at
        freq, start, slots = tables[context]
        state = states[k]
        slot = state & 4095
        symbol = slots[slot]
        state = freq[symbol] * (state >> 12) + slot - start[symbol]
        while state < 1 << 23 and at < len(data):
            state = state << 8 | data[at]
            at += 1
        states[k] = state
        return symbol

    if order == 0:
        for i in range(size):
            out[i] = step(i & 3, 0)
        return bytes(out)
    for i in range(part):
        for k in range(4):
            out[k * part + i] = last[k] = step(k, last[k])
    for i in range(4 * part, size):
        out[i] = last[3] = step(3, last[3])
    return bytes(out)


def read_block(c: Cursor) -> tuple[int, int, bytes]:
    """(content type, content id, data) of the block at the cursor."""
    begin = c.at
    method, kind, number, size, raw = c.byte(), c.byte(), c.itf8(), c.itf8(), c.itf8()
    data = c.take(size)
    if zlib.crc32(c.data[begin : c.at]) != struct.unpack("<I", c.take(4))[0]:
        raise ValueError("a CRAM block does not fit its checksum")
    if method == 0:
        out = data
    elif method == 1:
        out = zlib.decompress(data, wbits=31)
    elif method == 2:
        out = bz2.decompress(data)
    elif method == 3:
        out = lzma.decompress(data)
    elif method == 4:
        out = rans(data)
    else:
        raise ValueError(f"CRAM block compression {method} is not known; only that of CRAM 3.0 is")
    if len(out) != raw:
        raise ValueError("a CRAM block does not have its declared size")
    return kind, number, out


def write_block(kind: int, number: int, data: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    small = packed.compress(data) + packed.flush()
    method, body = (1, small) if kind == _EXTERNAL and len(small) < len(data) else (0, data)
    block = bytes((method, kind)) + itf8(number) + itf8(len(body)) + itf8(len(data)) + body
    return block + struct.pack("<I", zlib.crc32(block))


# --- containers ----------------------------------------------------------------------------------


def read_container_header(file, at: int) -> tuple[int, int, int, int] | None:
    """(place of the blocks, their size, number of records, record counter) of the container at a place; None at the end of the file."""
    file.seek(at)
    data = file.read(4096)
    if not data:
        return None
    if len(data) < 4:
        raise ValueError("the CRAM file ends in a container header")
    c = Cursor(data, 4)
    size = struct.unpack_from("<i", data)[0]
    c.itf8(), c.itf8(), c.itf8()
    records, counter = c.itf8(), c.ltf8()
    c.ltf8(), c.itf8()
    n = c.itf8()
    if n > 600:  # many landmarks: read on
        file.seek(at)
        c = Cursor(file.read(4096 + 5 * n), c.at)
    for _ in range(n):
        c.itf8()
    return at + c.at + 4, size, records, counter


def write_container(body: bytes, blocks: int, landmarks: list[int], ref: int = 0, records: int = 0, counter: int = 0, bases: int = 0) -> bytes:
    head = struct.pack("<i", len(body)) + itf8(ref) + itf8(0) + itf8(0) + itf8(records) + ltf8(counter) + ltf8(bases) + itf8(blocks)
    head += itf8(len(landmarks)) + b"".join(map(itf8, landmarks))
    return head + struct.pack("<I", zlib.crc32(head)) + body


def header_text(file) -> tuple[str, int]:
    """The SAM header and the place of the first container after it."""
    file.seek(0)
    head = file.read(26)
    if head[:4] != _MAGIC:
        raise ValueError("not a CRAM file")
    if head[4] != _VERSION[0]:
        raise ValueError(f"CRAM {head[4]}.{head[5]} is not known; only 3.0 is")
    at, size, _, _ = read_container_header(file, 26)
    file.seek(at)
    _, _, data = read_block(Cursor(file.read(size)))
    n = struct.unpack_from("<i", data)[0]
    return data[4 : 4 + n].decode(), at + size


def containers(file) -> list[tuple[int, int, int]]:
    """(place of the blocks, their size, record counter) of all containers with records."""
    at, out = header_text(file)[1], []
    while (found := read_container_header(file, at)) is not None:
        place, size, records, counter = found
        if records:
            out.append((place, size, counter))
        at = place + size
    return out


# --- encodings -----------------------------------------------------------------------------------


class Bits:
    """Bits of the core block, the first of a byte being the highest."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> int:
        value = 0
        for _ in range(n):
            value = value << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return value

    def ones(self) -> int:
        n = 0
        while self.take(1):
            n += 1
        return n

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def reader(c: Cursor, blocks: dict[int, Cursor], core: Bits, byte: bool):
    """A function that reads the next value of the encoding at the cursor."""
    codec, size = c.itf8(), c.itf8()
    end = c.at + size
    try:
        if codec == 1:
            source = blocks.get(c.itf8(), Cursor(b""))
            return source.byte if byte else source.itf8
        if codec == 3:
            values, lengths = c.numbers(), c.numbers()
            return _huffman(values, lengths, core)
        if codec == 4:
            length, value = reader(c, blocks, core, False), reader(c, blocks, core, True)
            return lambda: bytes(value() for _ in range(length()))
        if codec == 5:
            stop, source = c.byte(), blocks.get(c.itf8(), Cursor(b""))
            return lambda: source.until(stop)
        if codec == 6:
            offset, n = c.itf8(), c.itf8()
            return lambda: core.take(n) - offset
        if codec == 7:
            offset, k = c.itf8(), c.itf8()

            def subexponential():
                n = core.ones()
                return (core.take(k) if n == 0 else 1 << (n + k - 1) | core.take(n + k - 1)) - offset

            return subexponential
        if codec == 9:
            offset = c.itf8()

            def gamma():
                n = core.zeros()
                return (1 << n | core.take(n)) - offset

            return gamma
        raise ValueError(f"CRAM encoding {codec} is not known")
    finally:
        c.at = end


def _huffman(values: list[int], lengths: list[int], core: Bits):
    """Canonical codes in the order of length and value."""
    if len(values) == 1 and not lengths[0]:
        return lambda: values[0]
    codes, code, before = {}, 0, 0
    for n, value in sorted(zip(lengths, values)):
        code <<= n - before
        codes[n, code] = value
        code, before = code + 1, n

    def read():
        n, code = 0, 0
        while (n, code) not in codes:
            n, code = n + 1, code << 1 | core.take(1)
            if n > 32:
                raise ValueError("a CRAM Huffman code is not known")
        return codes[n, code]

    return read


class Compression:
    """What a container's compression header says."""

    def __init__(self, data: bytes):
        c = Cursor(data)
        end = c.itf8() + c.at
        self.names, self.delta, self.matrix, lines = True, True, b"\x1b" * 5, b"\0"
        for _ in range(c.itf8()):
            key = c.take(2)
            if key in (b"RN", b"AP", b"RR"):
                flag = bool(c.byte())
                self.names = flag if key == b"RN" else self.names
                self.delta = flag if key == b"AP" else self.delta
            elif key == b"SM":
                self.matrix = c.take(5)
            elif key == b"TD":
                lines = c.take(c.itf8())
        c.at = end
        self.lines = [[line[i : i + 3] for i in range(0, len(line), 3)] for line in lines.split(b"\0")[:-1]]
        self.data = c
        end = c.itf8() + c.at
        self.series = {}
        for _ in range(c.itf8()):
            key = c.take(2).decode()
            self.series[key] = c.at
            self._skip()
        c.at = end
        c.itf8()
        self.tags = {}
        for _ in range(c.itf8()):
            key = c.itf8() & 0xFFFFFF
            self.tags[key.to_bytes(3, "big")] = c.at
            self._skip()
        self.substitutes = {}
        for base, packed in zip(_BASES, self.matrix):
            for i, other in enumerate(b for b in _BASES if b != base):
                self.substitutes[base, packed >> (6 - 2 * i) & 3] = other

    def _skip(self) -> None:
        self.data.itf8()
        n = self.data.itf8()
        self.data.at += n

    def readers(self, blocks: dict[int, Cursor], core: Bits) -> tuple[dict, dict]:
        at = lambda place, byte: reader(Cursor(self.data.data, place), blocks, core, byte)
        return {k: at(p, k in _BYTE_SERIES) for k, p in self.series.items()}, {k: at(p, True) for k, p in self.tags.items()}


# --- records -------------------------------------------------------------------------------------


def container_records(data: bytes, counter: int, fetch):
    """(number, qname, flag, tid, pos, mapq, cigar, mtid, mpos, seq, qual, end_pos) of a container's blocks.

    fetch(tid, start, end) gives letters of the reference, which only files that leave bases to it need.
    """
    c = Cursor(data)
    header = Compression(read_block(c)[2])
    while c.at < len(data):
        kind, _, slice_ = read_block(c)
        if kind != _SLICE:
            raise ValueError("a CRAM slice header is missing")
        s = Cursor(slice_)
        ref, start = s.itf8(), s.itf8()
        s.itf8()
        records = s.itf8()
        s.ltf8()
        n_blocks = s.itf8()
        s.numbers()
        embedded = s.itf8()
        blocks, core = {}, Bits(b"")
        for _ in range(n_blocks):
            kind, number, content = read_block(c)
            if kind == _CORE:
                core = Bits(content)
            else:
                blocks[number] = Cursor(content)
        letters = fetch
        if embedded >= 0:
            own = blocks[embedded].data.decode()
            letters = lambda tid, a, b, own=own, first=start - 1: own[a - first : b - first]
        yield from _slice_records(header, blocks, core, ref, start, records, counter, letters)
        counter += records


def _slice_records(header: Compression, blocks, core, ref: int, start: int, records: int, counter: int, fetch):
    read, tags = header.readers(blocks, core)
    rows, place = [], start
    for i in range(records):
        flag, own = read["BF"](), read["CF"]()
        tid = read["RI"]() if ref == -2 else ref
        length = read["RL"]()
        pos = read["AP"]()
        if header.delta:
            pos = place = place + pos
        read["RG"]()
        name = read["RN"]().decode() if header.names else None
        mtid, mpos, ahead = -1, -1, None
        if own & _DETACHED:
            mate = read["MF"]()
            if not header.names:
                name = read["RN"]().decode()
            mtid, mpos = read["NS"](), read["NP"]() - 1
            read["TS"]()
            flag |= (_MATE_REVERSED if mate & 1 else 0) | (_MATE_UNMAPPED if mate & 2 else 0)
        elif own & _MATE_NEXT:
            ahead = i + read["NF"]() + 1
        for tag in header.lines[read["TL"]()]:
            tags[tag]()
        cigar, end, quals = "*", pos - 1, None
        if not flag & _UNMAPPED:
            seq, cigar, end, quals = _aligned(read, header, tid, pos - 1, length, fetch, bool(own & _NO_BASES))
            mapq = read["MQ"]()
        else:
            seq, mapq = "" if own & _NO_BASES else bytes(read["BA"]() for _ in range(length)).decode(), 0
        if own & _QUALITIES:
            quals = bytes(read["QS"]() for _ in range(length))
        elif quals is not None:
            quals = bytes(quals.get(j, 255) for j in range(length))
        qual = quals[: len(seq)] if quals is not None else b"\xff" * len(seq)
        rows.append([counter + i, name, flag, tid, pos - 1, mapq, cigar, mtid, mpos, seq, qual, end])
        rows[-1].append(ahead)
    _join_mates(rows)
    yield from (tuple(r[:-1]) for r in rows)


def _join_mates(rows: list[list]) -> None:
    """Names, flags and places of mates that are in the same slice: each names the next of its template, the last goes with the first."""
    seen = set()
    for i, row in enumerate(rows):
        if i in seen:
            continue
        chain = [i]
        while rows[chain[-1]][-1] is not None:
            chain.append(rows[chain[-1]][-1])
        seen.update(chain)
        for j, k in zip(chain, [*chain[1:], chain[0]]):
            if rows[j][1] is None:
                rows[j][1] = rows[i][1] or str(row[0])
            if len(chain) > 1:
                mate = rows[k]
                rows[j][7], rows[j][8] = mate[3], mate[4]
                rows[j][2] |= (_MATE_REVERSED if mate[2] & _REVERSED else 0) | (_MATE_UNMAPPED if mate[2] & _UNMAPPED else 0)


def _aligned(read, header: Compression, tid: int, pos: int, length: int, fetch, hidden: bool):
    """Letters, operations, end and single qualities of a placed read, from its features."""
    letters, ops, at, ref, quals = [], [], 0, pos, {}

    def op(n: int, kind: str) -> None:
        if ops and ops[-1][1] == kind:
            ops[-1][0] += n
        elif n:
            ops.append([n, kind])

    def match(n: int, text: str | None = None) -> None:
        nonlocal at, ref
        if n > 0:
            letters.append(text if text is not None else "" if hidden else fetch(tid, ref, ref + n))
            op(n, "M")
            at, ref = at + n, ref + n

    place = 0
    for _ in range(read["FN"]()):
        code = chr(read["FC"]())
        place += read["FP"]()
        match(place - 1 - at)
        if code == "b":
            text = read["BB"]().decode()
            match(len(text), text)
        elif code == "B":
            text, quals[at] = chr(read["BA"]()), read["QS"]()
            match(1, text)
        elif code == "X":
            match(1, header.substitutes[fetch(tid, ref, ref + 1).upper(), read["BS"]()])
        elif code in "IiS":
            text = chr(read["BA"]()) if code == "i" else read["IN" if code == "I" else "SC"]().decode()
            letters.append(text)
            op(len(text), "S" if code == "S" else "I")
            at += len(text)
        elif code in "DN":
            n = read["DL" if code == "D" else "RS"]()
            op(n, code)
            ref += n
        elif code in "PH":
            op(read["PD" if code == "P" else "HC"](), code)
        elif code == "Q":
            quals[place - 1] = read["QS"]()
        elif code == "q":
            quals |= dict(enumerate(read["QQ"](), place - 1))
        else:
            raise ValueError(f"CRAM feature {code!r} is not known")
    match(length - at)
    return "" if hidden else "".join(letters), "".join(f"{n}{k}" for n, k in ops) or "*", ref, quals or None


# --- writing -------------------------------------------------------------------------------------

_WRITTEN = "BF CF RI RL AP RG RN MF NS NP TS TL FN FC FP MQ BB IN SC DL RS PD HC QS BA".split()
_NUMBER = {name: i + 1 for i, name in enumerate(_WRITTEN)}


def _encoding(name: str) -> bytes:
    external = lambda n: itf8(1) + itf8(len(itf8(n))) + itf8(n)
    if name == "BB":
        inner = external(_NUMBER[name] + 100) + external(_NUMBER[name])
        return itf8(4) + itf8(len(inner)) + inner
    if name in _ARRAY_SERIES:
        return itf8(5) + itf8(1 + len(itf8(_NUMBER[name]))) + b"\0" + itf8(_NUMBER[name])
    return external(_NUMBER[name])


def _compression_header() -> bytes:
    sized = lambda entries: (lambda body: itf8(len(body)) + body)(itf8(len(entries)) + b"".join(entries))
    preservation = [b"RN\x01", b"AP\x00", b"RR\x00", b"SM" + b"\x1b" * 5, b"TD" + itf8(1) + b"\0"]
    return sized(preservation) + sized([name.encode() + _encoding(name) for name in _WRITTEN]) + sized([])


def encode_slice(rows) -> tuple[bytes, list[int], int, int]:
    """Blocks of a slice of rows (qname, flag, tid, pos, mapq, cigar, mtid, mpos, seq, qual), their content ids, records and bases."""
    out: dict[int, bytearray] = defaultdict(bytearray)
    number = lambda name, value: out[_NUMBER[name]].extend(itf8(value))
    records = bases = 0
    for r in rows:
        seq, qual, flag = r.seq or "", r.qual, r.flag
        known = qual is not None and len(qual) == len(seq) and any(q != 255 for q in qual)
        features = [] if flag & _UNMAPPED else _features(r.cigar, seq)
        length = len(seq) or sum(n for n, k, _ in features if k in "bIS")
        number("BF", flag & ~(_MATE_REVERSED | _MATE_UNMAPPED))
        number("CF", _DETACHED | (_QUALITIES if known else 0) | (0 if seq else _NO_BASES))
        for name, value in (("RI", r.tid), ("RL", length), ("AP", r.pos + 1), ("RG", -1)):
            number(name, value)
        out[_NUMBER["RN"]] += r.qname.encode() + b"\0"
        number("MF", (1 if flag & _MATE_REVERSED else 0) | (2 if flag & _MATE_UNMAPPED else 0))
        for name, value in (("NS", r.mtid), ("NP", r.mpos + 1), ("TS", 0), ("TL", 0)):
            number(name, value)
        if not flag & _UNMAPPED:
            _write_features(out, number, features if seq else [f for f in features if f[1] != "b"], features)
            number("MQ", r.mapq)
        else:
            out[_NUMBER["BA"]] += seq.encode()
        if known:
            out[_NUMBER["QS"]] += bytes(qual)
        records, bases = records + 1, bases + length
    ids = sorted(out)
    return write_block(_CORE, 0, b"") + b"".join(write_block(_EXTERNAL, i, bytes(out[i])) for i in ids), ids, records, bases


def _features(cigar: str | None, seq: str) -> list[tuple[int, str, str]]:
    """(length, code, letters) of each operation; without operations the letters match."""
    if cigar in (None, "", "*"):
        return [(len(seq), "b", seq)] if seq else []
    out, n, at = [], 0, 0
    for c in cigar:
        if c.isdigit():
            n = 10 * n + int(c)
            continue
        code = "b" if c in "M=X" else c
        out.append((n, code, (seq[at : at + n] or "N" * n) if code in "bIS" else ""))
        at, n = at + (n if code in "bIS" else 0), 0
    return out


def _write_features(out, number, features, whole) -> None:
    """The features at their places in the read; those of a read without letters leave the matches out."""
    number("FN", len(features))
    at, before = 1, 0
    kept = iter(features)
    following = next(kept, None)
    for feature in whole:
        n, code, text = feature
        if feature is following:
            out[_NUMBER["FC"]] += code.encode()
            number("FP", at - before)
            before = at
            if code == "b":
                out[_NUMBER["BB"] + 100] += itf8(n)
                out[_NUMBER["BB"]] += text.encode()
            elif code in "IS":
                out[_NUMBER["IN" if code == "I" else "SC"]] += text.encode() + b"\0"
            else:
                number({"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[code], n)
            following = next(kept, None)
        at += n if code in "bIS" else 0


def slice_container(blocks: bytes, ids: list[int], records: int, bases: int, counter: int) -> bytes:
    """A container of one slice that encode_slice() made."""
    head = itf8(-2) + itf8(0) + itf8(0) + itf8(records) + ltf8(counter) + itf8(len(ids) + 1) + itf8(len(ids) + 1)
    head += itf8(0) + b"".join(map(itf8, ids)) + itf8(-1) + bytes(16)
    first = write_block(_COMPRESSION, 0, _compression_header())
    body = first + write_block(_SLICE, 0, head) + blocks
    return write_container(body, len(ids) + 3, [len(first)], -2, records, counter, bases)


def file_start(text: str) -> bytes:
    data = text.encode()
    block = write_block(_FILE_HEADER, 0, struct.pack("<i", len(data)) + data)
    return _MAGIC + bytes(_VERSION) + b"quillon".ljust(20, b"\0") + write_container(block, 1, [0])


def file_end() -> bytes:
    return _EOF


# --- the reference -------------------------------------------------------------------------------


class Fasta:
    """Letters of a reference: the contigs' places come from one pass over the file, and one contig is held at a time."""

    def __init__(self, opened, names: list[str]):
        self.open, self.names, self.held = opened, names, (-1, "")

    def __call__(self, tid: int, start: int, end: int) -> str:
        if self.held[0] != tid:
            self.held = tid, self._contig(self.names[tid])
        if end > len(self.held[1]):
            raise ValueError(f"the reference's {self.names[tid]} ends before {end}")
        return self.held[1][start:end]

    def _contig(self, name: str) -> str:
        parts, inside = [], False
        with self.open() as file:
            rest = b""
            while chunk := file.read(1 << 20):
                lines = (rest + chunk).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if line.startswith(b">"):
                        if inside:
                            return "".join(parts)
                        inside = line[1:].split()[0].decode() == name
                    elif inside:
                        parts.append(line.strip().decode().upper())
            if inside:
                parts.append(rest.strip().decode().upper())
        if not inside:
            raise ValueError(f"the reference has no contig {name}")
        return "".join(parts)
