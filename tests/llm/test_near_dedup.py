"""op9 against brute force: links on exact sets, components, signatures."""

import os
import random
import re

import numpy as np

from quillon.llm import near_dedup as nd
from quillon.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(docs, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in docs]
    ids = sorted({i for i, _ in docs if i is not None})
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else root(i), None if i is None else root(i) == i) for i, s in sets), key=str)


def run(spark, docs, k):
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as KEY", "2 as label")
    return sorted((tuple(r) for r in nd.groups(spark, frame, k).collect()), key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, base = [], []
    for i in range(n):
        if base and r.random() < 0.6:
            w = list(r.choice(base))
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = [r.choice(vocabulary) for _ in range(r.choice((1, 3, 4, 30, 80, 200)))]
        base.append(w)
        docs.append((1000 - i, r.choice((" ", "\n", "\t ")).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return docs


def test_against_brute_force(spark):
    docs = corpus(1)
    docs += [docs[0], docs[0], (None, docs[0][1]), (None, None), (5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (3, docs[5][1]), (11, "word " * 40_000), (12, "word " * 39_000)]
    assert run(spark, docs, 4) == brute(docs, 4)
    assert run(spark, docs, 5) == brute(docs, 5)
    assert nd.groups(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_chain_of_near_misses(spark, monkeypatch):
    """A large group of edited copies, of which many are alike only through others, in small blocks, few links a round."""
    monkeypatch.setattr(nd, "BLOCK", 20_000)
    monkeypatch.setattr(nd, "CHUNK", 2)
    monkeypatch.setattr(nd, "LINKS", 1)
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 10_000)}"
        docs.append((i, " ".join(w)))
    got, want = run(spark, docs, 4), brute(docs, 4)
    assert got == want and len({g[2] for g in got}) > 1


def bucket_of(spark, n, likely):
    """n nodes of labels of their own in one bucket: all likely pairs, or none."""
    r = np.random.default_rng(n)
    sigs = np.zeros((n, nd.SLOTS), np.uint8) if likely else r.integers(0, 256, (n, nd.SLOTS)).astype(np.uint8)
    n_blocks = -(-n * (nd.SLOTS + 32) // nd.BLOCK)
    rows = [(1, i, i, 50, s.tobytes(), i > 0, n_blocks, n_blocks) for i, s in enumerate(sigs)]
    frame = spark.createDataFrame(rows, "group long, node long, label long, size long, sig binary, own boolean, n_all int, n_own int")
    return nd.materialize(spark, frame, "bucket")


def test_rows_are_linear_in_the_members(spark, monkeypatch):
    """Each doubling of a bucket gives at most LINKS + 1 rows for each own node, in blocks far smaller than the bucket."""
    monkeypatch.setattr(nd, "BLOCK", 20_000)
    for n in (500, 1000, 2000, 4000):
        more, again = nd.linked_in_blocks(spark, bucket_of(spark, n, True), 80)
        links = more.collect()
        assert len(links) <= nd.LINKS * n and again.count() <= n
        up = Merged(range(n))
        for a, b in links:
            up.join(a, b)
        left = {up.root(i) for i in range(n)} - {up.root(x.node) for x in again.collect()}
        assert len(left) <= 1  # all are connected, but for those that come again
    more, again = nd.linked_in_blocks(spark, bucket_of(spark, 500, False), 80)
    assert more.isEmpty() and again.isEmpty()


class Merged(list):
    def root(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def test_texts_of_one_id_link_their_groups(spark):
    """A doc_id with texts of two groups joins them, also where it is the smallest of neither."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = [(3, a), (5, a), (5, b), (4, b), (9, b), (7, "other words stand here"), (6, None)]
    assert {(g[0], g[2]) for g in run(spark, docs, 4)} == {(3, 3), (4, 3), (5, 3), (9, 3), (7, 7), (6, 6)}


def test_signatures():
    r = np.random.default_rng(0)
    for n in (1, 2, 7, 60, 400, 3000):
        e = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        s = nd.superminhash(e)
        assert (s < np.uint64(nd.SLOTS << 32)).all()
        assert (nd.superminhash(r.permutation(e)) == s).all()
        if n <= 60:  # without the early stop every rank is tried: the least in each slot is the same
            assert (plain(e) == s).all()
    errors = []
    for _ in range(60):
        e = r.integers(0, 1 << 63, 500).astype(np.uint64)
        a, b = nd.superminhash(e[:450]), nd.superminhash(e[50:])
        errors.append((a == b).mean() - 0.8)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.035


def plain(elements):
    best = [1 << 64] * nd.SLOTS
    for e in elements.tolist():
        order = list(range(nd.SLOTS))
        for j in range(nd.SLOTS):
            draw = int(nd.mix(np.array([(e + (j + 1) * nd._GOLDEN) & ((1 << 64) - 1)], np.uint64))[0])
            k = j + ((draw & 0xFFFFFFFF) * (nd.SLOTS - j) >> 32)
            order[j], order[k] = order[k], order[j]
            best[order[j]] = min(best[order[j]], (draw >> 32) + (j << 32))
    return np.array(best, np.uint64)


def test_components(spark):
    r = random.Random(6)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(600, 600), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_joins_with_labels_grow_with_the_nodes(spark, monkeypatch):
    """A node of many buckets is joined with its label once in a round, not once for each bucket."""
    r = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):  # a walk: near texts are alike, far ones aren't
        words = [w if r.random() > 0.04 else f"x{i}_{j}" for j, w in enumerate(words)]
        docs.append((i, " ".join(words)))
    seen = []
    labelled = nd._labelled

    def counted(members, labels, again):
        seen.append((members.count(), members.select("node").distinct().count()))
        return labelled(members, labels, again)

    monkeypatch.setattr(nd, "_labelled", counted)
    assert run(spark, docs, 2) == brute(docs, 2)
    assert seen and all(rows == nodes for rows, nodes in seen)


def test_components_on_the_driver_and_in_rounds(spark):
    r = random.Random(4)
    links = [(i + 1, i) for i in range(50, 90)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (None, 3), (4, None), (-5, 2**62)]
    frame = spark.createDataFrame(links, "a long, b long")
    here, rounds = (sorted(map(tuple, components(spark, frame, most).collect())) for most in (10**6, 0))
    assert here == rounds and dict(here)[90] == 50 and dict(here)[2**62] == -5


def test_stored_tables_have_no_checksum_files(spark):
    """Each would be another chmod process of an executor."""
    stored = nd.materialize(spark, spark.range(100).repartition(3), "plain")
    folder = os.path.dirname(stored.inputFiles()[0].removeprefix("file://"))
    assert stored.count() == 100 and not [f for f in os.listdir(folder) if f.endswith(".parquet.crc")]
