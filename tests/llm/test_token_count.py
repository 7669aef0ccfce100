"""op2 against the library whose vocabulary it reads."""

import random

import pytest
from tokenizers import Tokenizer

from quillon.llm import token_count as tc


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tc.vocabulary_path())


def test_odd_texts(library):
    tool = tc.MergeCounter(tc.vocabulary_path())
    texts = ["", "  ", "A<|endoftext|>b <|startoftext|>x", "ΑΣ ΣΑΣ", "İstanbul", "ﬁ ½ x́", "a" * 3000, "日本語 漢字", "👍🏽 zero​width", "it's I'LL don'T", "\x1c\x85\xa0 x", "<|endoftext|", "ſtop K", "١٢٣ ⅷ a_b", "\x00"]
    r = random.Random(1)
    for _ in range(1500):
        texts.append("".join(chr(r.choice((r.randint(1, 0x2FF), r.randint(0x300, 0x3000), r.randint(0xE000, 0x1FFFF), 32, 39, 115))) for _ in range(r.randint(1, 30))))
    assert [tool.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 5)
    tool = tc.MergeCounter(tc.vocabulary_path())
    assert tool.count(" ".join(f"w{i}" for i in range(100))) > 100 and len(tool.known) <= 5


def test_rows(spark, library):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "y"), (None, None, "z"), (3, "", "w"), (4, "word " * 2048, "v"), (5, "word " * 2049, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tc.count_tokens(docs).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert tc.count_tokens(docs.limit(0)).count() == 0
