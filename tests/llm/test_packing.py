"""op7: ids, cuts, places, and how full the sequences are."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import best_fit_packing as bp


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bp.TOKENIZER))


def test_ids(library):
    tool = bp.Encoder(public_tokenizers.path(bp.TOKENIZER), public_tokenizers.path(bp.RANKS))
    r = random.Random(2)
    texts = ["", "a  b\n c", "x<|endoftext|>y", "日本 語", "it's  I'LL\t\n", " " * 5000, "  a", "“quoted” – €5", "½ ² ª", "a" * 20_000]
    for _ in range(1500):
        texts.append("".join(chr(r.choice((r.randint(1, 0x24F), r.randint(0x2000, 0x20BF), r.randint(0x300, 0x3000), 32, 32, 10, 39, 115, r.randint(0xE000, 0x1FFFF)))) for _ in range(r.randint(1, 30))))
    assert [list(tool.ids(t)) for t in texts] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def check(rows, docs, library, length):
    """Pieces make up the documents, sequences have no gap and are not too long; gives the sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert len(mine) == max(1, -(-len(ids) // length)) and all(r.length == length for r in mine[1:])
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return by_sequence


def test_pack(spark, library):
    r = random.Random(1)
    docs = [(i, "word " * r.choice((0, 1, 5, 40, 63, 64, 65, 127, 128, 300))) for i in range(300)] + [(900, None), (901, ""), (902, "x y " * 3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length", "2 as piece")
    rows = bp.pack(bp.materialize(spark, bp.pieces(frame, length=64), "t"), 64, 50, 1 << 20).collect()
    sequences = check(rows, docs, library, 64)
    least = -(-sum(r.length for r in rows) // 64)
    assert len(sequences) <= 1.03 * least + 1
    many = bp.pack(bp.materialize(spark, bp.pieces(frame, length=64), "t"), 64, 3, 40).collect()  # few bins, many blocks
    check(many, docs, library, 64)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = bp.pack_documents(spark, docs).collect()
    assert sorted((r.doc_id or 0, r.length, r.offset) for r in rows) and len(rows) == 3
    assert {r.sequence_id for r in rows} == {rows[0].sequence_id}
    assert bp.pack_documents(spark, docs.limit(0)).count() == 0


def test_best_fit_takes_the_least_room_and_closes_the_fullest():
    bins = bp.BestFit(10, 2)
    assert bins.add(6, "a") == [] and bins.add(7, "b") == []
    assert bins.add(3, "c") == [[(7, "b"), (3, "c")]]  # room 3 of b fits closer than room 4 of a
    assert bins.add(8, "d") == []
    assert bins.add(9, "e") == [[(8, "d")]]  # the fullest makes room
    assert bins.rest() == [[(9, "e")], [(6, "a")]]
    r = random.Random(4)
    items = [(r.randint(1, 100), i) for i in range(5000)]
    held = list(bp.pack_block(items, 100, 64))
    assert sorted(x for b in held for x in b) == sorted(items) and all(sum(n for n, _ in b) <= 100 for b in held)
    assert len(held) <= 1.03 * sum(n for n, _ in items) / 100


def test_the_bound_acts_in_the_registered_setting():
    """Pieces in arrival order: never more than OPEN_BINS bins are open, most close for lack of bins, and little room is lost."""
    r = random.Random(8)
    sizes = [min(bp.LENGTH, int(r.lognormvariate(6, 1)) + 1) for _ in range(bp.BLOCK_PIECES)]
    bins, closed, forced = bp.BestFit(bp.LENGTH, bp.OPEN_BINS), 0, 0
    for i, n in enumerate(sizes):
        for held in bins.add(n, i):
            closed += 1
            forced += sum(x for x, _ in held) < bp.LENGTH
        assert bins.open <= bp.OPEN_BINS
    left = bins.rest()
    assert forced > closed / 4 and len(left) <= bp.OPEN_BINS
    assert closed + len(left) <= 1.03 * sum(sizes) / bp.LENGTH
    rooms = sorted(sum(n for n, _ in held) for held in left)
    assert len(rooms) < 2 or rooms[0] + rooms[1] > bp.LENGTH  # what is left could not be merged
