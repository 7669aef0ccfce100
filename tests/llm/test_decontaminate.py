"""op5 against brute force, with planted passages, short items and copies."""

import random
import re

import numpy as np

from quillon.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= ids
        out.append((doc, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as rid", "'x' as prints")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as print")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in dc.decontaminate(spark, d, i).collect()), key=str)


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = ["the", "a", "of", "Été", "x1", "日本", "zebra", "run", "go", "2024"]
    text = lambda n: r.choice((" ", ", ", "\n")).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice((10, 11, 14, 40, 3, 9, 1)) + (5 if i else 0))) for i in range(12)] + [(20, "zebra zebra zebra run"), (21, "Go GO go"), (22, ""), (23, None), (None, text(15)), (0, text(12)), (1, text(12))]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)]
    for i in range(60, 120):
        source = words(r.choice([t for _, t in items if t]))
        a = r.randint(0, max(0, len(source) - 10))
        docs.append((i, " ".join([text(r.randint(0, 20)), " ".join(source[a : a + r.choice((9, 10, 13, 60))]).upper(), text(r.randint(0, 20))])))
    docs += [docs[70], docs[70], (None, docs[71][1]), (500, None), (501, ""), (502, "word " * 30_000 + " ".join(words(items[0][1])))]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert 20 < sum(g[2] > 0 for g in got) < len(got)  # hits and misses


def test_empty_tables(spark):
    assert run(spark, [(1, "a b c")], []) == [(1, 3, 0, [])]
    assert run(spark, [], [(1, "a b c")]) == []


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    passage = " ".join(f"w{i}" for i in range(14))
    assert run(spark, [(1, f"x {passage} y"), (2, "none")], [(7, passage)]) == [(1, 16, 14, ["7"]), (2, 1, 0, [])]


def test_every_shared_span_has_a_common_print():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (r.integers(0, 6, 40).astype(np.uint64) for _ in range(2))
        b[7:17] = a[20:30]
        ends = np.array([0, 40])
        pa, va = dc.picks(a, ends, 10)
        pb, vb = dc.picks(b, ends, 10)
        assert {int(v) for p, v in zip(pa, va) if 20 <= p <= 25} & {int(v) for p, v in zip(pb, vb) if 7 <= p <= 12}
