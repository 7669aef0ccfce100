"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item. Of each window of W successive K-gram hashes
the least is a fingerprint, with K + W - 1 = WINDOW; so documents and items that share a window share a
fingerprint in it. Fingerprints are joined by hash, and each hit is extended word by word to both
sides: a run of WINDOW words or more around the K-gram is a hit of all its words. An item of fewer words
is one window; for each such length T the same holds with K = T and W = 1.

Documents keep only fingerprints whose bit is set in a bitmap of fixed size (BITS bits) made of the
benchmark's; it can only let too many through. The benchmark's fingerprints are broadcast if they are at
most BROADCAST_ROWS, else the join shuffles.

Cases: a null or empty text has no words, an item without words no window; a null item_id counts in the
hits but not among the items; repeated rows each give a row, repeated item_ids count once; a null doc_id
is passed on; with an empty benchmark nothing is hit; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import ALNUM, arrow_batches, blocks, grams, materialize, project, small, table, text_bytes, text_key, words

WINDOW, K = 10, 5
BITS = 23
BROADCAST_ROWS = 200_000
_U = np.uint64


def scheme(length: int) -> tuple[int, int]:
    """K and W for shared spans of a length."""
    return (K, WINDOW - K + 1) if length >= WINDOW else (length, 1)


def picks(h: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the fingerprints for spans of a length; text i has the words h[ends[i]:ends[i+1]]."""
    k, w = scheme(length)
    g = grams(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    least = np.lib.stride_tricks.sliding_window_view(g, w).argmin(axis=1) if w > 1 else np.zeros(n, np.int64)
    text = np.searchsorted(ends, np.arange(n), side="right") - 1
    inside = np.arange(n) + (k + w - 1) <= ends[text + 1]
    place = np.unique((np.arange(n) + least)[inside])
    return place, g[place] + _U(length)


def contexts(h: np.ndarray, begin: int, end: int, place: np.ndarray, length: int) -> list[bytes]:
    """The words around each place that one window with it can hold, 0 beyond the text begin:end."""
    k, _ = scheme(length)
    side = min(length, WINDOW) - k
    at = place[:, None] + np.arange(-side, k + side)
    out = np.where((at >= begin) & (at < end), h[np.clip(at, 0, len(h) - 1)], _U(0))
    return [row.tobytes() for row in np.ascontiguousarray(out, dtype="<u8")]


def _texts(column: pa.Array):
    """(word hashes of a block, ends, number of texts) for each block of a column."""
    at, raw = text_bytes(column)
    for first, last in blocks(at):
        h, ends = words(raw[at[first] : at[last]], at[first : last + 1] - at[first], ALNUM)
        yield h, ends, last - first


def item_prints(items: DataFrame) -> DataFrame:
    """(length, print, context, item_id) of all windows of the items (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def prints(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()

            def rows():
                row = 0
                for h, ends, n in _texts(batch.column(1)):
                    for i in range(n):
                        own = h[ends[i] : ends[i + 1]]
                        length = min(len(own), WINDOW)
                        if length:
                            place, value = picks(own, np.array([0, len(own)]), length)
                            yield from ((length, int(v), c, ids[row + i]) for v, c in zip(value.view(np.int64), contexts(own, 0, len(own), place, length)))
                    row += n

            yield from arrow_batches(rows(), {"length": pa.int32(), "print": pa.int64(), "context": pa.binary(), "item_id": batch.schema.field(0).type})

    return items.mapInArrow(prints, f"length int, print long, context binary, item_id {kind}")


def bitmap(prints: DataFrame) -> bytes:
    """Bit (print >> (64 - BITS)) is set for every print; partitions give a map each, of a fixed size."""

    def local(batches):
        bits = np.zeros(1 << BITS, dtype=bool)
        for batch in batches:
            bits[(batch.column(0).to_numpy().view(_U) >> _U(64 - BITS)).astype(np.int64)] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    total = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for row in prints.select("print").mapInArrow(local, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return total.tobytes()


def document_prints(docs: DataFrame, lengths: list[int], bits: bytes) -> DataFrame:
    """docs (rid, doc_id, t1, t2, text) to (rid, doc_id, t1, t2, n_words, prints): the prints that the bitmap lets through."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(bits)
    entry = pa.list_(pa.struct([("length", pa.int32()), ("print", pa.int64()), ("pos", pa.int32()), ("context", pa.binary())]))

    def prints(batches):
        known = np.unpackbits(np.frombuffer(held.value, np.uint8)).astype(bool)
        for batch in batches:
            n_words, found = [], []
            for h, ends, n in _texts(batch.column(4)):
                n_words.append(np.diff(ends))
                mine: list[list] = [[] for _ in range(n)]
                for length in lengths:
                    place, value = picks(h, ends, length)
                    keep = known[(value >> _U(64 - BITS)).astype(np.int64)]
                    place, value = place[keep], value[keep]
                    text = np.searchsorted(ends, place, side="right") - 1
                    for i in np.unique(text):
                        at, v = place[text == i], value[text == i].view(np.int64)
                        around = contexts(h, ends[i], ends[i + 1], at, length)
                        mine[i] += [{"length": length, "print": int(x), "pos": int(p - ends[i]), "context": c} for x, p, c in zip(v, at, around)]
                found += mine
            n_words = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n_words, pa.int64()), pa.array(found, entry)], names=["rid", "doc_id", "t1", "t2", "n_words", "prints"])

    return docs.mapInArrow(prints, f"rid long, doc_id {kind}, t1 long, t2 long, n_words long, prints array<struct<length:int,print:long,pos:int,context:binary>>")


def extended(joined: DataFrame, kind: str) -> DataFrame:
    """Joined prints (rid, length, pos, context, other, item_id) to runs (rid, start, end, item_id) of whole windows."""

    def extend(batches):
        for batch in batches:
            keep_row, start, end = [], [], []
            length = batch.column(1).to_numpy()
            for t in np.unique(length):
                at = np.flatnonzero(length == t)
                k, _ = scheme(int(t))
                side = int(t) - k
                x, y = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), "<u8").reshape(len(at), -1) for c in (3, 4))
                same = (x == y) & (x != 0)
                whole = same[:, side : side + k].all(axis=1)
                left = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
                right = np.cumprod(same[:, side + k :], axis=1).sum(axis=1)
                good = whole & (left + k + right >= t)
                pos = batch.column(2).to_numpy()[at]
                keep_row.append(at[good])
                start.append((pos - left)[good])
                end.append((pos + k + right)[good])
            if keep_row:
                rows = pa.array(np.concatenate(keep_row))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate(start), pa.int32()), pa.array(np.concatenate(end), pa.int32()), batch.column(5).take(rows)], names=["rid", "start", "end", "item_id"])

    return joined.select("rid", "length", "pos", "context", "other", "item_id").mapInArrow(extend, f"rid long, start int, end int, item_id {kind}")


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings) of every row, and t1, t2: two hashes of its text."""
    docs = project(docs, doc_id=id_col, text=text_col)
    t1, t2 = text_key("text")
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", t1.alias("t1"), t2.alias("t2"), "text")
    items = project(items, item_id="item_id", text="text")
    kind = items.schema["item_id"].dataType.simpleString()
    known = materialize(spark, item_prints(items).distinct(), "item-prints")
    lengths = sorted(r.length for r in known.select("length").distinct().collect())  # at most WINDOW
    rows = materialize(spark, document_prints(docs, lengths, bitmap(known)), "document-prints")
    mine = rows.select("rid", F.explode("prints").alias("p")).select("rid", "p.*")
    theirs = small(known.withColumnRenamed("context", "other"), BROADCAST_ROWS)
    joined = mine.join(theirs, ["length", "print"])
    runs = extended(joined, kind).distinct()
    own = runs.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))

    def join(state, r):  # words under the runs so far, and where the last ends
        return F.struct((state["n"] + F.greatest(r["end"] - F.greatest(r["start"], state["at"]), F.lit(0))).alias("n"), F.greatest(state["at"], r["end"]).alias("at"))

    n_hit = F.aggregate("runs", F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), join, lambda s: s["n"].cast("long"))
    out = rows.drop("prints").join(own.select("rid", n_hit.alias("n_hit"), "item_ids"), "rid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "t1", "t2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    i as (select distinct item_id, least(len(w), 10) as t, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as g from b where len(w) > 0),
    t as (select distinct t from i),
    g as (select row, t, unnest(range(1, cast(len(w) - t + 2 as bigint))) as p, unnest(list_transform(range(1, cast(len(w) - t + 2 as bigint)), lambda i: array_to_string(w[i:i + t - 1], ' '))) as g from d, t where len(w) >= t),
    h as (select row, item_id, p, t from g join i using (t, g)),
    n as (select row, count(distinct p) as n from (select row, unnest(range(p, cast(p + t as bigint))) as p from h) group by row),
    m as (select row, count(*) as n, string_agg(x, ',' order by x) as s from (select distinct row, cast(item_id as varchar) as x from h where item_id is not null) group by row)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n.n, 0) as n_hit, coalesce(m.n, 0) as n_items, sha256(coalesce(m.s, '')) as items_sha256, coalesce(n.n, 0) > 0 as contaminated
    from d left join n using (row) left join m using (row)"""
