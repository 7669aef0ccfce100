"""Alignment files as a Spark data source: SAM text and BAM, split by bytes, and CRAM, by containers; and writers for them.

    spark.dataSource.register(AlignmentSource)
    spark.read.format("alignments").load("reads.bam")

With regions, and an index beside the file (reads.bam.bai or reads.bai), only the chunks that the index names
for the regions are read, which hold all records that overlap them and some others.

A BAM split begins at the first compressed block in its range and, from there on, at the first place from which a
chain of records can be read, in whatever block that is; it ends with the last record that begins in its range. ord is a record's
virtual offset (block offset and place in the block), in SAM the line's byte offset, so the order of
records in a file is known whatever the splits. in CRAM, whose paths end in .cram, it is the record's number.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.schema import READS
from quillon.sources import cram
from quillon.sources.paths import check_reference, is_cram_path
from quillon.sources.writers import file_system

SPLIT_BYTES = 32 << 20
# Fixed values of the formats.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_ON_REFERENCE = frozenset("MDN=X")
#: the letter of a hexadecimal digit, and the digit of a letter (15 for unknown ones)
_LETTERS = bytes(ord(BASES[int(chr(b), 16)]) if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_DIGITS = bytes(ord(f"{BASES.find(chr(b)) if chr(b) in BASES else 15:x}") for b in range(256))
#: qualities as printed in SAM: bytes up to 93, and all others letter by letter
_PRINT, _UNPRINT, _PRINTABLE = bytes((b + 33) % 256 for b in range(256)), bytes((b - 33) % 256 for b in range(256)), bytes(range(94))
_BLOCK = b"\x1f\x8b\x08\x04"
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_FIXED = struct.Struct("<iiBBHHHiiii")
_SCHEMA = pa.schema(
    [("file_id", pa.string()), ("ord", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("tid", pa.int32()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()),
     ("mtid", pa.int32()), ("mpos", pa.int64()), ("seq", pa.string()), ("qual", pa.binary()), ("end_pos", pa.int64())]
)


def _open(path: str):
    """A seekable file of a local path or of any URI that the file systems of Arrow know."""
    system, inner = file_system(path)
    return system.open_input_file(inner)


# --- BAM -----------------------------------------------------------------------------------------


class Blocks:
    """Decompressed blocks of a BGZF file from an offset on."""

    def __init__(self, file, at: int):
        self.file, self.at, self.size = file, at, file.size()

    def next(self) -> tuple[int, bytes] | None:
        """(offset, data) of the next block, None at the end."""
        if self.at >= self.size:
            return None
        self.file.seek(self.at)
        head = self.file.read(12)
        if len(head) < 12 or head[:4] != _BLOCK:
            raise ValueError(f"no BGZF block at byte {self.at}")
        extra_len = struct.unpack_from("<H", head, 10)[0]
        extra = self.file.read(extra_len)
        length = _block_size(extra)
        if length is None:
            raise ValueError(f"a BGZF block without its size at byte {self.at}")
        body = self.file.read(length + 1 - 12 - extra_len)
        start, self.at = self.at, self.at + length + 1
        return start, zlib.decompress(body[:-8], wbits=-15)


def _block_size(extra: bytes) -> int | None:
    at = 0
    while at + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and n == 2:
            return struct.unpack_from("<H", extra, at + 4)[0]
        at += 4 + n
    return None


def _first_block(file, at: int, stop: int) -> int | None:
    """The first offset in at..stop-1 where a block begins and another, or the end, follows."""
    while at < stop:
        file.seek(at)
        chunk = file.read(min(1 << 17, file.size() - at))
        found = chunk.find(_BLOCK)
        if found < 0:
            at += max(len(chunk) - 3, 1)
            if len(chunk) < 4:
                return None
            continue
        at += found
        if at >= stop:
            return None
        try:
            blocks = Blocks(file, at)
            blocks.next()
            if blocks.at == blocks.size or file_begins(file, blocks.at):
                return at
        except (ValueError, zlib.error, struct.error):
            pass
        at += 1
    return None


def file_begins(file, at: int) -> bool:
    file.seek(at)
    return file.read(4) == _BLOCK


def _version(path: str) -> tuple:
    """What tells a file from one that stood at its path before."""
    system, inner = file_system(path)
    info = system.get_file_info(inner)
    return info.size, info.mtime_ns


class Stream:
    """Bytes of consecutive blocks, with the virtual offset of each place."""

    @classmethod
    def from_virtual(cls, file, at: int) -> Stream:
        """A stream at a virtual offset."""
        stream = cls(Blocks(file, at >> 16))
        stream.need(at & 0xFFFF)
        stream.at = at & 0xFFFF
        return stream

    def __init__(self, blocks: Blocks):
        self.blocks, self.data, self.starts = blocks, b"", []  # starts: (place in data, block offset)
        self.at, self.keep = 0, False

    def more(self) -> bool:
        block = self.blocks.next()
        if block is None:
            return False
        if self.at > 1 << 20 and not self.keep:  # forget what was read
            self.data, cut = self.data[self.at :], self.at
            self.starts = [(p - cut, o) for p, o in self.starts]
            self.starts = self.starts[max((i for i, (p, _) in enumerate(self.starts) if p <= 0), default=0) :]
            self.at = 0
        self.starts.append((len(self.data), block[0]))
        self.data += block[1]
        return True

    def need(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError("the BAM file ends in the middle of a record")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def virtual(self) -> int:
        place, offset = next((p, o) for p, o in reversed(self.starts) if p <= self.at)
        return offset << 16 | (self.at - place)


def read_header(stream: Stream) -> tuple[str, list[tuple[str, int]]]:
    if stream.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = stream.take(struct.unpack("<i", stream.take(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", stream.take(4))[0]))
    return text, contigs


@functools.lru_cache(4)
def _bam_start(path: str, version: tuple) -> tuple[int, int]:
    """The number of contigs and the virtual offset of the first record; a worker reads a file's header once for all its splits."""
    with _open(path) as file:
        head = Stream(Blocks(file, 0))
        contigs = read_header(head)[1]
        return len(contigs), head.virtual()


def _may_begin(data: bytes, first: int, last: int, contigs: int) -> np.ndarray:
    """Places first..last-1 whose first 36 bytes can open a record."""
    last = min(last, len(data) - 35)
    if last <= first:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)
    at = np.arange(first, last)
    number = lambda k: np.lib.stride_tricks.sliding_window_view(raw, 4)[at + k].copy().view("<i4")[:, 0]
    good = (number(4) >= -1) & (number(4) < contigs) & (raw[at + 12] > 0)
    at = at[good]
    size, n_seq = number(0).astype(np.int64), number(20).astype(np.int64)
    least = 32 + raw[at + 12].astype(np.int64) + 4 * (raw[at + 16].astype(np.int64) + 256 * raw[at + 17].astype(np.int64)) + (n_seq + 1) // 2 + n_seq
    good = (n_seq >= 0) & (size >= least) & (size < 1 << 28) & (number(24) >= -1) & (number(24) < contigs) & (number(8) >= -1) & (number(28) >= -1)
    return at[good]


def _plausible(body: bytes) -> bool:
    """Whether the bytes after a record's size, of which _may_begin() holds, can open a record: its name can be printed and its operations are known."""
    _, _, name_len, _, _, n_cigar, _, _, _, _, _ = _FIXED.unpack_from(body)
    name = body[32 : 32 + name_len]
    if name[-1] != 0 or any(not 33 <= c <= 126 for c in name[:-1]):
        return False
    return all(c & 15 < len(OPS) for c in struct.unpack_from(f"<{n_cigar}I", body, 32 + name_len))


def _chained(stream: Stream, contigs: int, links: int = 4) -> bool:
    """Whether records follow one another from the stream's place on, for some links or to the end of the file; the place stays.

    A record may be longer than any block: what is missing is read.
    """
    at = stream.at
    try:
        for _ in range(links):
            if not stream.need(36):
                return len(stream.data) == stream.at
            if not len(_may_begin(stream.data, stream.at, stream.at + 1, contigs)):
                return False
            size = struct.unpack_from("<i", stream.data, stream.at)[0]
            head = 36 + stream.data[stream.at + 12] + 4 * struct.unpack_from("<H", stream.data, stream.at + 16)[0]
            if not stream.need(head) or not _plausible(stream.data[stream.at + 4 : stream.at + head]) or not stream.need(4 + size):
                return False
            stream.at += 4 + size
        return True
    finally:
        stream.at = at


def _first_record(stream: Stream, contigs: int, stop: int) -> bool:
    """Move to the first place, in a block before stop, from which records follow one another; False if there is none."""
    stream.keep, first = True, 0
    while True:
        beyond = next((p for p, o in stream.starts if o >= stop), None)
        last = min(len(stream.data) if beyond is None else beyond, len(stream.data) - 35)
        for at in _may_begin(stream.data, first, last, contigs).tolist():
            stream.at = at
            if _chained(stream, contigs):
                stream.keep = False
                return True
        stream.at, first = 0, max(first, last)
        if beyond is not None and first >= beyond or first >= len(stream.data) - 35 and not stream.more():
            return False


@functools.lru_cache(1 << 12)
def _operations(packed: bytes) -> tuple[str, int]:
    """The text of a record's operations, and how many places of the contig they take."""
    cigar = [(c >> 4, OPS[c & 15]) for c in struct.unpack(f"<{len(packed) // 4}I", packed)]
    return "".join(f"{n}{op}" for n, op in cigar) or "*", sum(n for n, op in cigar if op in _ON_REFERENCE)


def decode(file_id: str, ord_: int, body: bytes) -> tuple:
    """A row of READS of a BAM record without its size."""
    tid, pos, name_len, mapq, _, n_cigar, flag, n_seq, mtid, mpos, _ = _FIXED.unpack_from(body)
    at = 32
    name = body[at : at + name_len - 1].decode()
    at += name_len
    cigar, length = _operations(body[at : at + 4 * n_cigar])
    at += 4 * n_cigar
    seq = body[at : at + (n_seq + 1) // 2].hex().encode().translate(_LETTERS)[:n_seq].decode()
    at += (n_seq + 1) // 2
    return (file_id, ord_, name, flag, tid, pos, mapq, cigar, mtid, mpos, seq, body[at : at + n_seq], pos + length)


def bam_records(path: str, start: int, stop: int):
    """Rows of the records that begin in the blocks of start..stop-1."""
    contigs, begin = _bam_start(path, _version(path))
    with _open(path) as file:
        if start == 0:
            stream = Stream.from_virtual(file, begin)
        else:
            first = _first_block(file, start, stop)
            if first is None:
                return
            if first <= begin >> 16:  # still in the header
                if not start <= begin >> 16 < stop:
                    return
                stream = Stream.from_virtual(file, begin)
            else:
                stream = Stream(Blocks(file, first))
                if not _first_record(stream, contigs, stop):
                    return
        while stream.need(4):
            if len(stream.data) == stream.at:
                return
            at = stream.virtual()
            if at >> 16 >= stop:
                return
            if start and at >> 16 < start:
                stream.take(struct.unpack("<i", stream.take(4))[0])
                continue
            yield decode(path, at, stream.take(struct.unpack("<i", stream.take(4))[0]))


def bam_chunk(path: str, begin: int, end: int):
    """Rows of the records whose virtual offsets are in begin..end-1."""
    with _open(path) as file:
        stream = Stream.from_virtual(file, begin)
        while stream.need(4) and (at := stream.virtual()) < end:
            yield decode(path, at, stream.take(struct.unpack("<i", stream.take(4))[0]))


# --- the index of a BAM file ---------------------------------------------------------------------

# Fixed values of the format: bins of 512 Mb, 64 Mb, 8 Mb, 1 Mb, 128 kb and 16 kb, numbered in this order, and windows of 16 kb.
_BIN_SHIFTS, _WINDOW_SHIFT, _NO_BIN = (29, 26, 23, 20, 17, 14), 14, 37450


def bins_over(start: int, end: int) -> list[int]:
    """All bins that overlap start..end-1."""
    out, first = [], 0
    for level, shift in enumerate(_BIN_SHIFTS):
        out += range(first + (start >> shift), first + ((max(end, start + 1) - 1) >> shift) + 1)
        first += 1 << (3 * level)
    return out


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds start..end-1."""
    last, first = max(end, start + 1) - 1, sum(1 << (3 * level) for level in range(len(_BIN_SHIFTS)))
    for level in range(len(_BIN_SHIFTS) - 1, -1, -1):
        first -= 1 << (3 * level)
        if start >> _BIN_SHIFTS[level] == last >> _BIN_SHIFTS[level]:
            return first + (start >> _BIN_SHIFTS[level])
    return 0


def write_index(path: str) -> str:
    """Index a BAM file in the order of contig and place: path.bai, which other tools read, too. One pass on the driver."""
    system, inner = file_system(path)
    with _open(path) as file:
        stream = Stream(Blocks(file, 0))
        contigs = read_header(stream)[1]
        chunks: list[dict[int, list[list[int]]]] = [{} for _ in contigs]
        windows: list[dict[int, int]] = [{} for _ in contigs]
        last, loose = (-1, -1), 0
        while stream.need(4):
            begin = stream.virtual()
            row = decode(path, begin, stream.take(struct.unpack("<i", stream.take(4))[0]))
            stream.need(1)
            end, tid, pos, stop = stream.virtual(), row[4], row[5], max(row[12], row[5] + 1)
            if tid < 0 or pos < 0:
                loose += 1
                continue
            if (tid, pos) < last:
                raise ValueError(f"{path} is not in the order of contig and place")
            last = tid, pos
            held = chunks[tid].setdefault(bin_of(pos, stop), [])
            if held and held[-1][1] == begin:
                held[-1][1] = end
            else:
                held.append([begin, end])
            for w in range(pos >> _WINDOW_SHIFT, (stop - 1 >> _WINDOW_SHIFT) + 1):
                windows[tid].setdefault(w, begin)
    out = [b"BAI\x01", struct.pack("<i", len(contigs))]
    for bins, offsets in zip(chunks, windows):
        out.append(struct.pack("<i", len(bins)))
        for number, held in bins.items():
            out.append(struct.pack("<Ii", number, len(held)) + b"".join(struct.pack("<QQ", *c) for c in held))
        linear, before = [], 0
        for w in range(max(offsets, default=-1) + 1):
            before = offsets.get(w, before)
            linear.append(before)
        out.append(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))
    with system.open_output_stream(inner + ".bai") as file:
        file.write(b"".join([*out, struct.pack("<Q", loose)]))
    return path + ".bai"


def find_index(path: str) -> str | None:
    """The path of a BAM file's index, if there is one beside it."""
    for name in (path + ".bai", path.removesuffix(".bam") + ".bai"):
        system, inner = file_system(name)
        if system.get_file_info(inner).is_file:
            return name
    return None


def indexed_chunks(index: str, regions: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges of virtual offsets, in order and apart, that hold all records that overlap the regions (tid, start, end)."""
    with _open(index) as file:
        data = file.read()
    if data[:4] != b"BAI\x01":
        raise ValueError(f"{index} is not an index of a BAM file")
    wanted: dict[int, list[tuple[int, int]]] = {}
    for tid, start, end in regions:
        wanted.setdefault(tid, []).append((start, end))
    at, found = 8, []
    for tid in range(struct.unpack_from("<i", data, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        at += 4
        for _ in range(struct.unpack_from("<i", data, at - 4)[0]):
            number, n = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * n}Q", data, at + 8)
            bins[number] = [*zip(flat[::2], flat[1::2])]
            at += 8 + 16 * n
        n = struct.unpack_from("<i", data, at)[0]
        linear = struct.unpack_from(f"<{n}Q", data, at + 4)
        at += 4 + 8 * n
        bins.pop(_NO_BIN, None)  # counts, not records
        for start, end in wanted.get(tid, ()):
            window = start >> _WINDOW_SHIFT
            least = linear[window] if window < n else linear[-1] if n else 0
            found += [(max(a, least), b) for number in bins_over(start, end) for a, b in bins.get(number, ()) if b > least]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


# --- SAM -----------------------------------------------------------------------------------------


def sam_contigs(path: str) -> list[tuple[str, int]]:
    contigs = []
    with _open(path) as file:
        for line in _lines(file, 0):
            if not line[1].startswith(b"@"):
                break
            if line[1].startswith(b"@SQ"):
                tags = dict(f.split(":", 1) for f in line[1].decode().split("\t")[1:])
                contigs.append((tags["SN"], int(tags["LN"])))
    return contigs


def _lines(file, at: int):
    """(offset, line) from a line's start on."""
    file.seek(at)
    rest = b""
    while chunk := file.read(1 << 20):
        parts = (rest + chunk).split(b"\n")
        rest = parts.pop()
        for part in parts:
            yield at, part.rstrip(b"\r")
            at += len(part) + 1
    if rest:
        yield at, rest.rstrip(b"\r")


@functools.lru_cache(4)
def _sam_ids(path: str, version: tuple) -> dict[str, int]:
    """Contigs' numbers by name; a worker reads a file's header once for all its splits."""
    return {name: i for i, (name, _) in enumerate(sam_contigs(path))}


@functools.lru_cache(1 << 12)
def _places(cigar: str) -> int:
    """How many places of the contig the operations take."""
    length, n = 0, 0
    for c in cigar if cigar != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            length, n = length + (n if c in _ON_REFERENCE else 0), 0
    return length


def _qualities(printed: str) -> bytes:
    if printed.isascii() and "!" <= min(printed, default="!"):
        return printed.encode().translate(_UNPRINT)
    return bytes(ord(c) - 33 for c in printed)


def sam_records(path: str, start: int, stop: int):
    """Rows of the lines that begin in start..stop-1."""
    tid = _sam_ids(path, _version(path))
    with _open(path) as file:
        lines = _lines(file, max(start - 1, 0))
        if start:
            next(lines, None)  # ends the line that the split before began
        for at, line in lines:
            if at >= stop:
                return
            if not line or line.startswith(b"@"):
                continue
            f = line.decode().split("\t")
            if len(f) < 11:
                raise ValueError(f"a SAM line of {len(f)} fields at byte {at} of {path}")
            own, mate = ((-1 if x == "*" else tid[x]) for x in (f[2], f[2] if f[6] == "=" else f[6]))
            pos, seq = int(f[3]) - 1, "" if f[9] == "*" else f[9]
            qual = b"\xff" * len(seq) if f[10] == "*" else _qualities(f[10])
            yield (path, at, f[0], int(f[1]), own, pos, int(f[4]), f[5], mate, int(f[7]) - 1, seq, qual, pos + _places(f[5]))


# --- the data source -------------------------------------------------------------------------------


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))


class Chunks(InputPartition):
    def __init__(self, path: str, chunks: list[tuple[int, int]]):
        super().__init__((path, chunks))


class Containers(InputPartition):
    def __init__(self, path: str, held: list[tuple[int, int, int]]):
        super().__init__((path, held))


def cram_records(path: str, held: list[tuple[int, int, int]], reference: str | None):
    """Rows of the records of containers (place, size, number of the first record)."""
    with _open(path) as file:
        names = [name for name, _ in _contigs_of_text(cram.header_text(file)[0])]
        fetch = cram.Fasta(lambda: _open(reference), names) if reference else None
        for place, size, counter in held:
            file.seek(place)
            for number, *row in cram.container_records(file.read(size), counter, fetch):
                yield (path, number, *row)


class AlignmentReader(DataSourceReader):
    def __init__(self, options):
        self.reference = options.get("reference") or None
        self.paths = [p for p in options["path"].split(",") if p]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        regions = options.get("regions")
        self.regions = None if regions is None else [tuple(map(int, r.split(":"))) for r in regions.split(",") if r]

    def _chunks(self, path: str, index: str):
        """The index's chunks for the regions, so many to a task as make up a split."""
        held, size = [], 0
        for a, b in indexed_chunks(index, self.regions):
            held.append((a, b))
            size += (b >> 16) - (a >> 16) + (1 << 16)
            if size >= self.split:
                yield Chunks(path, held)
                held, size = [], 0
        if held:
            yield Chunks(path, held)

    def _containers(self, path: str):
        held, size = [], 0
        with _open(path) as file:
            for found in cram.containers(file):
                held.append(found)
                size += found[1]
                if size >= self.split:
                    yield Containers(path, held)
                    held, size = [], 0
        if held:
            yield Containers(path, held)

    def partitions(self):
        out = []
        for path in self.paths:
            if is_cram_path(path):
                out += self._containers(path)
                continue
            index = find_index(path) if self.regions is not None and is_bam(path) else None
            if index is not None:
                out += self._chunks(path, index)
                continue
            with _open(path) as file:
                size = file.size()
            out += [Range(path, a, min(a + self.split, size)) for a in range(0, max(size, 1), self.split)]
        return out

    def read(self, partition):
        if isinstance(partition, Chunks):
            path, chunks = partition.value
            rows = (row for a, b in chunks for row in bam_chunk(path, a, b))
        elif isinstance(partition, Containers):
            rows = cram_records(*partition.value, self.reference)
        else:
            path, start, stop = partition.value
            rows = (bam_records if is_bam(path) else sam_records)(path, start, stop)
        kept = []
        for row in rows:
            kept.append(row)
            if len(kept) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), _SCHEMA.types)], schema=_SCHEMA)
                kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), _SCHEMA.types)], schema=_SCHEMA)


class AlignmentSource(DataSource):
    """Option path: files with commas between; splitBytes; reference (for CRAM); regions: tid:start:end with commas between."""

    @classmethod
    def name(cls):
        return "alignments"

    def schema(self):
        return READS

    def reader(self, schema):
        if any(is_cram_path(p) for p in self.options["path"].split(",")):
            check_reference(self.options.get("reference"), cram=True)
        return AlignmentReader(self.options)


def is_bam(path: str) -> bool:
    with _open(path) as file:
        return file.read(2) == b"\x1f\x8b"


def _contigs_of_text(text: str) -> list[tuple[str, int]]:
    tags = [dict(f.split(":", 1) for f in line.split("\t")[1:]) for line in text.split("\n") if line.startswith("@SQ\t")]
    return [(t["SN"], int(t["LN"])) for t in tags]


def contigs_of(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, length) in the header's order."""
    if is_cram_path(path):
        found = _contigs_of_text(header_text(path))
    elif is_bam(path):
        with _open(path) as file:
            found = read_header(Stream(Blocks(file, 0)))[1]
    else:
        found = sam_contigs(path)
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(found)], "tid int, name string, length long")


def header_text(path: str) -> str:
    """The header lines of a file."""
    with _open(path) as file:
        if is_cram_path(path):
            return cram.header_text(file)[0]
        if file.read(2) == b"\x1f\x8b":
            return read_header(Stream(Blocks(file, 0)))[0]
        lines = []
        for _, line in _lines(file, 0):
            if not line.startswith(b"@"):
                break
            lines.append(line.decode() + "\n")
        return "".join(lines)


#: regions that are looked up in an index; with more all records are read
MOST_REGIONS = 100_000


def read_alignments(spark: SparkSession, path: str, reference: str | None = None, split_bytes: int = SPLIT_BYTES, regions: DataFrame | None = None) -> DataFrame:
    """Rows of READS. With regions (tid, start, end) and an index at least the records that overlap these, without one all."""
    spark.dataSource.register(AlignmentSource)
    options = {"splitBytes": str(split_bytes)} | ({"reference": reference} if reference is not None else {})
    if regions is not None:
        wanted = regions.select("tid", "start", "end").limit(MOST_REGIONS + 1).collect()
        if len(wanted) <= MOST_REGIONS:
            options["regions"] = ",".join(f"{r.tid}:{r.start}:{r.end}" for r in wanted)
    return spark.read.format("alignments").options(**options).load(path)


# --- writers ---------------------------------------------------------------------------------------


def _compressed(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return _BLOCK + struct.pack("<IBBH", 0, 0, 0xFF, 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


@functools.lru_cache(1 << 12)
def _packed_operations(cigar: str | None) -> bytes:
    ops, n = [], 0
    for c in "" if cigar in (None, "*") else cigar:
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            ops.append(n << 4 | OPS.index(c))
            n = 0
    return struct.pack(f"<{len(ops)}I", *ops)


def encode(row) -> bytes:
    """A BAM record of a row of READS."""
    seq = row.seq or ""
    packed = bytes.fromhex((seq.encode("latin-1", "replace").upper().translate(_DIGITS) + b"0" * (len(seq) % 2)).decode())
    ops = _packed_operations(row.cigar)
    name = row.qname.encode() + b"\0"
    qual = bytes(row.qual) if row.qual is not None and len(row.qual) == len(seq) else b"\xff" * len(seq)
    body = _FIXED.pack(row.tid, row.pos, len(name), row.mapq, 4680, len(ops) // 4, row.flag, len(seq), row.mtid, row.mpos, 0)
    body += name + ops + packed + qual
    return struct.pack("<i", len(body)) + body


def _made_header(named: list[tuple[str, int]]) -> str:
    return "@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{size}\n" for n, size in named)


def _string_together(blobs: DataFrame, head: bytes, tail: bytes, path: str) -> int:
    """Write head, the blobs (data, n) in their order and tail as one file; the sum of n.

    All tasks make their blobs at once and keep them on their disks, since the driver takes them one task after another.
    """
    kept = blobs.persist(StorageLevel.DISK_ONLY)
    try:
        count = kept.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        system, inner = file_system(path)
        with system.open_output_stream(inner) as file:
            file.write(head)
            for r in kept.select("data").toLocalIterator(prefetchPartitions=True):
                file.write(r.data)
            file.write(tail)
    finally:
        kept.unpersist()
    return count


def write_bam(rows: DataFrame, contigs: DataFrame, path: str, header: str | None = None) -> int:
    """Rows of READS, in the order of contig, place and ord, as one BAM file, which tasks encode and the driver strings together; the number of rows.

    Each task compresses its part of the order into blocks of its own; the driver only passes these on.
    """
    named = [(r.name, r.length) for r in contigs.orderBy("tid").collect()]
    text = _made_header(named) if header is None else header
    head = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(named))
    head += b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in named)

    def blocks(batches):
        held, size, n = [], 0, 0
        for batch in batches:
            for row in map(_Read._make, zip(*(c.to_pylist() for c in batch.columns))):
                held.append(encode(row))
                size, n = size + len(held[-1]), n + 1
                if size >= _BLOCK_BYTES:
                    data = b"".join(held)
                    cut = size // _BLOCK_BYTES * _BLOCK_BYTES
                    yield _blob(data[:cut], n)
                    held, size, n = [data[cut:]], size - cut, 0
        if size:
            yield _blob(b"".join(held), n)

    ordered = rows.select(*_Read._fields, "file_id", "ord").orderBy("tid", "pos", "file_id", "ord").select(*_Read._fields)
    return _string_together(ordered.mapInArrow(blocks, "data binary, n long"), _blocks_of(head), _EOF, path)


#: reads in a container of CRAM
SLICE_READS = 5000


def write_cram(rows: DataFrame, contigs: DataFrame, path: str, header: str | None = None) -> int:
    """Rows of READS, in the order of contig, place and ord, as one CRAM file that needs no reference; the number of rows.

    Tasks encode slices; the driver numbers their records and strings them together.
    """
    text = _made_header([(r.name, r.length) for r in contigs.orderBy("tid").collect()]) if header is None else header

    def slices(batches):
        held = []
        for batch in batches:
            for row in map(_Read._make, zip(*(c.to_pylist() for c in batch.columns))):
                held.append(row)
                if len(held) >= SLICE_READS:
                    yield _slice_batch(held)
                    held = []
        if held:
            yield _slice_batch(held)

    ordered = rows.select(*_Read._fields, "file_id", "ord").orderBy("tid", "pos", "file_id", "ord").select(*_Read._fields)
    system, inner = file_system(path)
    count = 0
    with system.open_output_stream(inner) as file:
        file.write(cram.file_start(text))
        for r in ordered.mapInArrow(slices, "blocks binary, ids array<int>, records long, bases long").toLocalIterator():
            file.write(cram.slice_container(bytes(r.blocks), r.ids, r.records, r.bases, count))
            count += r.records
        file.write(cram.file_end())
    return count


def _slice_batch(held: list) -> pa.RecordBatch:
    blocks, ids, records, bases = cram.encode_slice(held)
    columns = [pa.array([blocks], pa.binary()), pa.array([ids], pa.list_(pa.int32())), pa.array([records], pa.int64()), pa.array([bases], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["blocks", "ids", "records", "bases"])


_BLOCK_BYTES = 0xFF00
_Read = namedtuple("_Read", "qname flag tid pos mapq cigar mtid mpos seq qual")


def _blocks_of(data: bytes) -> bytes:
    return b"".join(_compressed(data[at : at + _BLOCK_BYTES]) for at in range(0, len(data), _BLOCK_BYTES))


def _blob(data: bytes, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_blocks_of(data)], pa.binary()), pa.array([n], pa.int64())], names=["data", "n"])


def write_sam(rows: DataFrame, contigs: DataFrame, path: str, header: str | None = None) -> int:
    """Rows of READS, in the order of contig, place and ord, as one SAM file; the number of rows."""
    text = _made_header([(r.name, r.length) for r in contigs.orderBy("tid").collect()]) if header is None else header

    def named(column: str):
        return F.when(F.col(column) < 0, "*").otherwise(F.coalesce(F.col(f"{column}_name"), F.raise_error(F.format_string("no contig %s", F.col(column))))).alias(column)

    def lines(batches):
        held, size = [], 0
        for batch in batches:
            for row in map(_Read._make, zip(*(c.to_pylist() for c in batch.columns))):
                held.append(sam_line(row))
                size += len(held[-1])
                if size >= _SAM_BYTES:
                    yield _text_blob(held)
                    held, size = [], 0
        if held:
            yield _text_blob(held)

    for column in ("tid", "mtid"):
        rows = rows.join(contigs.select(F.col("tid").alias("_tid"), F.col("name").alias(f"{column}_name")), F.col(column) == F.col("_tid"), "left").drop("_tid")
    ordered = rows.select(*_Read._fields, "file_id", "ord", "tid_name", "mtid_name").orderBy("tid", "pos", "file_id", "ord")
    ordered = ordered.select(*[named(c) if c in ("tid", "mtid") else c for c in _Read._fields])
    return _string_together(ordered.mapInArrow(lines, "data binary, n long"), text.encode(), b"", path)


#: bytes of lines that are passed on at once
_SAM_BYTES = 1 << 20


def _text_blob(lines: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b"".join(lines)], pa.binary()), pa.array([len(lines)], pa.int64())], names=["data", "n"])


def sam_line(row) -> bytes:
    """The line of a row of READS whose tid and mtid are names."""
    qual = b"" if row.qual is None else bytes(row.qual)
    if not qual or len(qual) != len(row.seq or "") or not qual.strip(b"\xff"):
        printed = "*"
    elif qual.translate(None, _PRINTABLE):
        printed = "".join(chr(q + 33) for q in qual)
    else:
        printed = qual.translate(_PRINT).decode()
    return f"{row.qname}\t{row.flag}\t{row.tid}\t{row.pos + 1}\t{row.mapq}\t{row.cigar or '*'}\t{row.mtid}\t{row.mpos + 1}\t0\t{row.seq or '*'}\t{printed}\n".encode()
