"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

1. Each text's set of distinct k-word shingles (hashes) gets a SuperMinHash signature: an element gives
   slot p[j] the value j + u, where p is a random permutation of its own and u uniform, and each slot
   keeps the least value. Ranks j are tried in turn for all elements at once; as soon as every slot
   holds less than j + 1, later ranks can't lower any and the loop stops.
2. Texts with equal sets make a class; its smallest doc_id is its node. From here on only nodes count.
3. Bands of ROWS slots give bucket keys. Every node is paired with the smallest node of each of its
   buckets, the pivots: first with the least of them, then with those that it isn't connected to. Pairs with a hopeless estimate (ESTIMATE of the slots equal, five standard deviations under
   the threshold) are dropped, the others are verified on the full sets.
4. The links' components are made. Where a bucket still holds nodes of several components besides its
   pivot, its minor nodes, those outside its largest component, are held against all its nodes: blocks of
   bounded bytes stream past each block of minor nodes. A node passes on at most LINKS links that connect
   what its block doesn't know as connected; one that would need more is held against all again in the next
   round, when what was found is contracted. So a round gives at most LINKS + 1 rows for each node of a
   bucket, and buckets with the same members count once. First this is done with likely pairs, which makes
   clusters; then in each cluster with pairs verified on full sets. No pair that shares a bucket is left
   out unless it is connected already.

A pair at similarity 0.8 misses all of the 40 bands of 5 slots with probability 1.2e-7.

Cases: null and empty texts and texts without words have no shingles and link with nothing; a text of
fewer than k words has its whole sequence as its one shingle; rows with one doc_id are one document,
which links the groups of all its texts; a row without doc_id joins no group and its component_id and kept are
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import NOT_SPACE, arrow_batches, blocks, grams, joined, materialize, mix, project, small, table, text_bytes, words
from quillon.llm.components import components

SLOTS, ROWS = 200, 5
BANDS = SLOTS // ROWS
ESTIMATE = 0.65
PERCENT = 80
#: bytes of signatures and sets that are held against one another at once, about; and blocks that one task holds a block against
BLOCK, CHUNK = 1 << 20, 64
#: links that a node passes on in a round at most
LINKS = 4
#: sets that a set is held against at once
STEP = 64
#: ids that are broadcast at most; more are joined by shuffling
BROADCAST_IDS = 500_000
_U = np.uint64
_GOLDEN = 0x9E3779B97F4A7C15
_BAND_WEIGHTS = mix(np.arange(1, ROWS + 1, dtype=_U) * _U(_GOLDEN)) | _U(1)
_BAND_SEEDS = mix(np.arange(1, BANDS + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of a text's words."""
    if len(h) >= k:
        return np.unique(grams(h, k))
    return grams(h, len(h)) + _U(len(h)) if len(h) else h


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The signature of a non-empty set of hashes: in each slot the least rank (high half) and fraction (low half)."""
    n = len(elements)
    best = np.full(slots, np.iinfo(np.uint64).max, dtype=_U)
    order = None
    for j in range(slots):
        draw = mix(elements + _U(((j + 1) * _GOLDEN) & 0xFFFFFFFFFFFFFFFF))
        fraction, pick = draw >> _U(32), (((draw & _U(0xFFFFFFFF)) * _U(slots - j)) >> _U(32)).astype(np.int64) + j
        if j == 0:
            slot = pick
        else:
            if order is None:  # what the first rank's swaps left
                order = np.tile(np.arange(slots, dtype=np.uint16), (n, 1))
                order[rows, first_pick] = 0  # noqa: F821
                order[:, 0] = first_pick  # noqa: F821
            slot = order[rows, pick]  # noqa: F821
            order[rows, pick] = order[:, j]  # noqa: F821
            order[:, j] = slot
        np.minimum.at(best, slot, fraction + _U(j << 32))
        if j == 0:
            rows, first_pick = np.arange(n), pick
        if best.max() < _U((j + 1) << 32):
            break
    return best


def bands(signature: np.ndarray) -> np.ndarray:
    """A bucket key for each band."""
    return mix((signature.reshape(BANDS, ROWS) * _BAND_WEIGHTS).sum(axis=1, dtype=_U) + _BAND_SEEDS)


def slot_bytes(signature: np.ndarray) -> bytes:
    """One byte for each slot, for estimates."""
    return (mix(signature) >> _U(56)).astype(np.uint8).tobytes()


def set_key(elements: np.ndarray) -> bytes:
    """128 bits that equal sets share, of the elements in order."""
    return blake2b(elements.astype("<u8").tobytes(), digest_size=16).digest()


def _sets(column: pa.Array, k: int):
    """Each text's shingle set, in order."""
    at, raw = text_bytes(column)
    for first, last in blocks(at):
        h, ends = words(raw[at[first] : at[last]], at[first : last + 1] - at[first], NOT_SPACE)
        for i in range(last - first):
            yield shingle_set(h[ends[i] : ends[i + 1]], k)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text) to (rid, doc_id, n_shingles, key, sig, bands); the last three are null without shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            n, keys, sigs, buckets = [], [], [], []
            for s in _sets(batch.column(2), k):
                n.append(len(s))
                if len(s):
                    signature = superminhash(s)
                    keys.append(set_key(s))
                    sigs.append(slot_bytes(signature))
                    buckets.append(bands(signature).view(np.int64))
                else:
                    keys.append(None)
                    sigs.append(None)
                    buckets.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["rid", "doc_id", "n_shingles", "key", "sig", "bands"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return rows.mapInArrow(sketch, f"rid long, doc_id {kind}, n_shingles long, key binary, sig binary, bands array<long>")


def likely(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose signatures (node, sig) agree in ESTIMATE of the slots."""
    of = lambda x: signatures.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sig_a", "sig_b")

    def estimate(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SLOTS) for i in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= ESTIMATE * SLOTS)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(estimate, "a long, b long")


def full_sets(spark: SparkSession, ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, members) of the ids (node): the hashes of a document's whole shingle set, in order; a row for each of its texts."""
    ids = materialize(spark, ids.select(F.col("node").alias("doc_id")).distinct(), "need")
    texts = docs.join(small(ids, BROADCAST_IDS), "doc_id", "left_semi").withColumn("hash", F.xxhash64("text")).dropDuplicates(["doc_id", "hash"])

    def full(batches):
        for batch in batches:
            sets = [s.astype("<u8").tobytes() for s in _sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "members"])

    return materialize(spark, texts.select("doc_id", "text").mapInArrow(full, "node long, members binary"), "sets")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union holds for two sets."""
    few, many = sorted((len(x), len(y)))
    if not few or 100 * few < percent * many:
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (few + many - shared)


def alike_to(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """alike(x, y, percent) for each y of others, all sets being in order and not empty."""
    sizes = np.array([len(y) for y in others])
    flat = np.concatenate(others)
    found = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    shared = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * shared >= percent * (len(x) + sizes - shared)


def verify(spark: SparkSession, pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) whose full sets are alike."""
    sets = full_sets(spark, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, k)
    of = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"set_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "set_a", "set_b")

    def linked(batches):
        for batch in batches:
            keep = pa.array([alike(*(np.frombuffer(v.as_buffer(), "<u8") for v in two), percent) for two in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(linked, "a long, b long").distinct()


class Block:
    """Minor nodes of a group, that are held against the group's other blocks."""

    def __init__(self, held: pa.StructArray):
        self.node, self.label, self.size, self.sig, self.sets = columns_of(held)
        self.code, self.connected = {}, np.zeros(0, np.int64)
        self.own = self._codes(self.label)
        self.given, self.more = np.zeros(len(self.node), np.int64), np.zeros(len(self.node), bool)

    def _codes(self, labels: np.ndarray) -> np.ndarray:
        """Each label's place in connected, which says what links so far connect."""
        codes = np.array([self.code.setdefault(x, len(self.code)) for x in labels.tolist()], np.int64)
        self.connected = np.concatenate([self.connected, np.arange(len(self.connected), len(self.code))])
        return codes

    def links(self, held: pa.StructArray, percent: int):
        """(node, other) of links that connect more; likely ones if there are no sets, else verified ones."""
        node, label, size, sig, sets = columns_of(held)
        codes = self._codes(label)
        for i in np.flatnonzero(~self.more):
            few, many = np.minimum(size, self.size[i]), np.maximum(size, self.size[i])
            at = np.flatnonzero((self.connected[codes] != self.connected[self.own[i]]) & (100 * few >= percent * many))
            if len(at):
                at = at[(sig[at] == self.sig[i]).sum(axis=1) >= ESTIMATE * SLOTS]
            while len(at):
                now, at = at[:STEP], at[STEP:]
                if sets is not None:
                    now = now[alike_to(self.sets[i], [sets[j] for j in now], percent)]
                while len(now) and not self.more[i]:
                    if self.given[i] == LINKS:
                        self.more[i], at = True, at[:0]
                        break
                    self.given[i] += 1
                    self.connected[self.connected == self.connected[codes[now[0]]]] = self.connected[self.own[i]]
                    yield int(self.node[i]), int(node[now[0]])
                    now, at = (x[self.connected[codes[x]] != self.connected[self.own[i]]] for x in (now, at))


def columns_of(held: pa.StructArray):
    """node, label, size, signatures as rows of bytes, and sets if there are any."""
    node, label, size = (held.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    sig = np.frombuffer(b"".join(held.field(3).to_pylist()), np.uint8).reshape(-1, SLOTS)
    sets = [np.frombuffer(x, "<u8") for x in held.field(4).to_pylist()] if held.type.num_fields > 4 else None
    return node, label, size, sig, sets


def linked_in_blocks(spark: SparkSession, placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between nodes of different labels that share a group, and the nodes that must be held against all again.

    placed has (group, node, label, size, sig, own, n_all, n_own) and, for verified links, members: the set; n_all and
    n_own are the blocks of a group's nodes and of its own nodes. Pairs of an own node with any node are looked
    at; a pair that is left out is connected by links of its block, or its node is among those to come again.
    """
    payload = [c for c in ("members",) if c in placed.columns]
    held = F.collect_list(F.struct("node", "label", "size", "sig", *payload)).alias("held")  # a block of bounded size
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int").alias("block")
    own = placed.where("own").groupBy("group", block(F.col("n_own")), "n_all").agg(held)
    chunks = F.sequence(F.lit(0), F.ceil(F.col("n_all") / CHUNK).cast("int") - 1)
    own = own.select("group", "block", F.explode(chunks).alias("chunk"), F.lit(0).alias("role"), "held")
    others = placed.groupBy("group", block(F.col("n_all")), "n_own").agg(held)
    chunk = F.floor(F.col("block") / CHUNK).cast("int").alias("chunk")
    others = others.select("group", chunk, F.explode(F.sequence(F.lit(0), F.col("n_own") - 1)).alias("block"), F.lit(1).alias("role"), "held")
    met = own.unionByName(others).repartition("group", "block", "chunk").sortWithinPartitions("group", "block", "chunk", "role")

    def compare(batches):
        def rows():
            mine = None
            for batch in batches:
                role, held = batch.column(3).to_pylist(), batch.column(4)
                for i, r in enumerate(role):
                    if r == 0:
                        if mine is not None:
                            yield from ((int(x), None) for x in mine.node[mine.more])
                        mine = Block(held[i].values)
                    else:
                        yield from mine.links(held[i].values, percent)
            if mine is not None:
                yield from ((int(x), None) for x in mine.node[mine.more])

        yield from arrow_batches(rows(), {"a": pa.int64(), "b": pa.int64()})

    found = materialize(spark, met.mapInArrow(compare, "a long, b long").distinct(), "block-links")
    return found.where("b is not null"), found.where("b is null").select(F.col("a").alias("node"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that labels (node, label) doesn't show as connected."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _of_one_id(spark: SparkSession, known: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Links between the classes that hold a text of one doc_id, if any doc_id has texts of several classes."""
    repeated = known.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("doc_id")
    repeated = materialize(spark, repeated, "repeated")
    if repeated.isEmpty():
        return None
    held = known.select("doc_id", "key").join(repeated, "doc_id").join(nodes, "key").select("doc_id", "node").distinct()
    return materialize(spark, held.join(held.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")), "one-id")


def _grown(spark: SparkSession, links: DataFrame | None, pairs: DataFrame, signatures: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links so far with those that likely pairs verify, and their components."""
    pairs = materialize(spark, likely(pairs, signatures), "pairs")
    found = materialize(spark, verify(spark, pairs, docs, k, percent), "verified")
    links = found if links is None else links.union(found)
    return links, components(spark, links)


def _labelled(members: DataFrame, labels: DataFrame, again: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """members (node, groups, ...) once for each group, with their labels and whether each is own, and the groups to look at: those of several labels.

    A node has one row in members, so the joins grow with the nodes and not with their groups. Own are the nodes of again,
    or without it those outside their group's largest label. The groups have major, the largest label, and the
    numbers of blocks that linked_in_blocks() needs.
    """
    weight = sum((F.octet_length(c) for c in ("sig", "members") if c in members.columns), F.lit(32)).cast("long")
    rows = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if again is not None:
        rows = rows.join(again.select("node", F.lit(True).alias("own")), "node", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    rows = rows.withColumn("weight", weight).withColumn("group", F.explode("groups")).drop("groups")
    own = F.sum(F.when(F.col("own"), F.col("weight"))) if again is not None else F.lit(0).cast("long")
    by_label = rows.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes"), own.alias("own_bytes"))
    largest = F.max_by(F.struct("label", "bytes"), F.struct("n", "label")).alias("major")
    groups = by_label.groupBy("group").agg(largest, F.count("*").alias("labels"), F.sum("bytes").alias("bytes"), F.sum("own_bytes").alias("own_bytes")).where("labels > 1")
    n_blocks = lambda size, name: F.ceil(size / BLOCK).cast("int").alias(name)
    own_bytes = F.col("own_bytes") if again is not None else F.col("bytes") - F.col("major.bytes")
    groups = groups.where(own_bytes > 0).select("group", F.col("major.label").alias("major"), n_blocks(F.col("bytes"), "n_all"), n_blocks(own_bytes, "n_own"))
    return rows.drop("weight"), groups


def _all_linked(spark: SparkSession, links: DataFrame, labels: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """links with those that linked_in_blocks() finds in round after round, and their components."""
    again = None
    while True:
        rows, groups = _labelled(members, labels, again)
        rows = joined(rows, materialize(spark, groups, "groups"), "group")
        if again is None:
            rows = rows.withColumn("own", F.col("label") != F.col("major"))
        more, again = linked_in_blocks(spark, materialize(spark, rows.drop("major"), "labelled"), percent)
        if more.isEmpty():
            return links, labels
        links = links.union(more)
        labels = components(spark, links)
        if again.isEmpty():
            return links, labels


def _completed(spark: SparkSession, links: DataFrame, labels: DataFrame, members: DataFrame, signatures: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """labels after all likely pairs of different labels that share a bucket were verified, in clusters of likely pairs."""
    rest = members.where("n > 2 and node <> pivot").groupBy("node").agg(F.collect_list("bucket").alias("buckets"))  # BANDS at most
    rest = rest.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.explode("buckets").alias("bucket"))
    rest = materialize(spark, rest, "rest")
    print_of = [F.sum(F.pmod(F.xxhash64(F.lit(i), "node"), F.lit((1 << 31) - 1))).alias(f"h{i}") for i in range(3)]
    mixed = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), *print_of).where("lo < hi")
    mixed = materialize(spark, mixed.groupBy("n", "h0", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket"), "buckets")
    rest = materialize(spark, joined(rest.drop("label"), mixed, "bucket").groupBy("node").agg(F.collect_list("bucket").alias("groups")), "rest")
    if rest.isEmpty():
        return labels
    near, cluster = _all_linked(spark, links, labels, materialize(spark, rest.join(signatures, "node"), "signed"), percent)
    if near is links:
        return labels
    taking = rest.select("node").join(cluster.withColumnRenamed("label", "group"), "node")
    mixed = taking.join(labels, "node", "left").groupBy("group").agg(F.min(F.coalesce("label", "node")).alias("lo"), F.max(F.coalesce("label", "node")).alias("hi")).where("lo < hi")
    taking = materialize(spark, joined(taking, materialize(spark, mixed.select("group"), "mixed"), "group"), "taking")
    sets = full_sets(spark, taking.select("node"), docs, k)
    taking = taking.select("node", F.array("group").alias("groups"))
    return _all_linked(spark, links, labels, materialize(spark, taking.join(signatures, "node").join(sets, "node"), "with-sets"), percent)[1]


def groups(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs. doc_id must be an integer."""
    docs = project(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = materialize(spark, sketches(docs, k), "sketches")
    known = rows.where("doc_id is not null and key is not null")
    nodes = materialize(spark, known.groupBy("key").agg(F.min("doc_id").alias("node"), F.min_by("rid", "doc_id").alias("rid")), "nodes")
    classes = known.select("key", "rid", F.col("n_shingles").alias("size"), "sig", "bands").join(nodes, ["key", "rid"])
    classes = materialize(spark, classes.select("node", "size", "sig", "bands"), "classes")
    signatures = classes.select("node", "size", "sig")
    placed = classes.select("node", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1")
    members = materialize(spark, placed.join(shared, "bucket"), "members")

    # each node with the least of its buckets' pivots, then with the others that it isn't connected to
    pivots = members.where("node > pivot")
    pairs = pivots.groupBy("node").agg(F.min("pivot").alias("a")).select("a", F.col("node").alias("b"))
    links, labels = _grown(spark, _of_one_id(spark, known, nodes), pairs, signatures, docs, k, percent)
    pairs = pivots.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links, labels = _grown(spark, links, _apart(pairs, labels), signatures, docs, k, percent)

    labels = _completed(spark, links, labels, members, signatures, docs, k, percent)

    to = nodes.select("key", "node").join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("component_id"))
    own = rows.select("doc_id", "n_shingles", F.coalesce("key", F.col("rid").cast("string").cast("binary")).alias("key"))
    out = own.join(to, "key", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), (F.col("doc_id") == found).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, table(spark, sf_dir, "documents"), k=4)


ORACLE_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
    s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from w),
    x as (select doc_id, len(s) as n, unnest(list_transform(s, lambda g: hash(g))) as g from s),
    p as (select a.doc_id as a, b.doc_id as b, a.n as m, b.n as n, count(*) as shared from x a join x b on a.g = b.g and a.doc_id < b.doc_id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n group by all),
    l as (select a, b from p where 100 * shared >= 80 * (m + n - shared)),
    e as (select a, b from l union all select b, a from l),
    r as (select doc_id as a, doc_id as c from documents union select e.b as a, r.c from r join e on e.a = r.a),
    m as (select a, min(c) as c from r group by a)
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.c as component_id, s.doc_id = m.c as kept from s join m on m.a = s.doc_id"""
