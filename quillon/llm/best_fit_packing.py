"""Sequence packing by bounded-space online best-fit.

Documents become token ids and a closing id; only those longer than a sequence are cut, into full
pieces but for the first. Pieces are dealt out to blocks of about BLOCK_PIECES. In a block they arrive in
hashed order, which says nothing of their lengths, and each is placed at once: into the open bin with the
least free space that holds it, which a bitset keyed by free space finds in one step. At most OPEN_BINS bins
are open; when another is needed the fullest closes. What is open at the end of a block closes then: no two
of these would fit into one, since the younger was opened when its first piece did not fit into the older.

Cases: null and empty texts are one closing id; repeated rows each give pieces; a null doc_id is passed
on; an empty table gives an empty result; extra columns are ignored; ties in free space go to the bin
touched last. Sequence numbers are any, without a gap inside a block.
"""

from __future__ import annotations

import base64
import math
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import arrow_batches, materialize, project, table

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
LENGTH, CLOSING_ID = 2048, 0
OPEN_BINS, BLOCK_PIECES = 256, 40_000


class Encoder:
    """Ids as the tokenizer file gives them; plain Latin text goes through the same ranks in a faster library."""

    def __init__(self, path: str, ranks_path: str):
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.beyond = regex.compile(r"<\||[^\x00-ɏ -⁯₠-₿]|\s{1000}")

    def ids(self, text: str) -> list[int]:
        if self.beyond.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=1)
def encoder(path: str, ranks_path: str) -> Encoder:
    return Encoder(path, ranks_path)


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first takes what full pieces leave."""
    if n <= length:
        return [(0, n)]
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document."""
    import public_tokenizers

    path, ranks_path = public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)
    rows = project(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        tool = encoder(path, ranks_path)
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, text in enumerate(batch.column(1)):
                ids = array("I", tool.ids(text.as_py()))
                ids.append(CLOSING_ID)
                data = ids.tobytes()
                for piece, (start, n) in enumerate(cuts(len(ids), length)):
                    at.append(i)
                    out.append((piece, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])))
            if out:
                piece, start, n, crc = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Open bins in a bitset keyed by free space; add() and rest() return the bins that close, as lists of (size, content)."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits, self.open = 0, 0
        self.free: dict[int, list[list]] = defaultdict(list)

    def _take(self, space: int) -> list:
        stack = self.free[space]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << space)
        self.open -= 1
        return found

    def add(self, size: int, content) -> list[list]:
        closed = []
        room = self.bits >> size
        if room:
            space = size + (room & -room).bit_length() - 1
            held = self._take(space)
        else:
            space, held = self.length, []
            if self.open >= self.most and size < self.length:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))  # the fullest
        held.append((size, content))
        if space == size:
            closed.append(held)
        else:
            self.free[space - size].append(held)
            self.bits |= 1 << (space - size)
            self.open += 1
        return closed

    def rest(self) -> list[list]:
        left = [held for space in sorted(self.free) for held in self.free[space]]
        self.free.clear()
        self.bits, self.open = 0, 0
        return left


def pack_block(items, length: int = LENGTH, most: int = OPEN_BINS):
    """Bins of the items (size, content) as they arrive: lists of (size, content) of at most length in all."""
    bins = BestFit(length, most)
    for size, content in items:
        yield from bins.add(size, content)
    yield from bins.rest()


def pack(found: DataFrame, length: int = LENGTH, most: int = OPEN_BINS, block: int = BLOCK_PIECES) -> DataFrame:
    """Rows of pieces(), with sequence_id and offset. found must be a stored table, since it is read twice."""
    n = max(1, math.ceil(found.count() / block))
    order = F.xxhash64("doc_id", "piece", "length", "ids_crc32")
    dealt = found.repartition(n).sortWithinPartitions(order, "doc_id", "piece")
    kind = found.schema["doc_id"].dataType.simpleString()

    def packed(batches):
        number = TaskContext.get().partitionId() << 32
        kinds: dict = {}

        def items():
            for batch in batches:
                kinds["doc_id"] = batch.schema.field("doc_id").type
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    yield row[3], row

        def rows():
            nonlocal number
            for held in pack_block(items(), length, most):
                offset = 0
                for size, row in held:
                    yield (*row, number, offset)
                    offset += size
                number += 1

        first = iter(rows())
        for head in first:
            i64 = pa.int64()
            columns = {"doc_id": kinds["doc_id"], "piece": pa.int32(), "start": i64, "length": i64, "ids_crc32": i64, "sequence_id": i64, "offset": i64}
            yield from arrow_batches(_chain(head, first), columns)

    return dealt.mapInArrow(packed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _chain(head, rest):
    yield head
    yield from rest


def pack_documents(spark: SparkSession, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return pack(materialize(spark, pieces(docs, length=length), "pieces"), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"))
