"""Media columns: chroma fingerprints of recordings, and their alignment.

A recording's frames become twelve pitch-class energies. Filters that compare sums of areas, taken from
an integral image of pitch class by frame, give a two-bit Gray code each; sixteen of them make one packed
integer for each frame. To align recordings, both 16-bit halves of a query's integers are indexed by
value; equal halves vote for an offset, the offset with the most votes is chosen, and the bit errors of the
integers that overlap there decide. Recordings of equal integers count once, among the queries and among
all. Both are packed into blocks of about BLOCK bytes of integers, and each block of recordings meets each block
of queries, which is indexed there; the votes of about STEP postings are counted at once. Every alignment that
passes is in the result, by the smallest id of the queries that share its integers and their number.

Cases: a null or unreadable medium has no frames, one shorter than WIDEST frames no integers, and both match
nothing; silence gives integers of its own and aligns with silence; repeated rows each give a row; a null
id is passed on and is no query; an empty table gives an empty result; extra columns are ignored; ties in
votes go to the least offset in size, then the negative one; ties between queries go to the fewest errors a
bit, then the longest overlap, then the smallest id. PCM of 8, 16, 24 and 32 bits can be read.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.llm.common import joined, materialize, project, table

FRAME, HOP = 1024, 341
LOWEST, HIGHEST = 100.0, 1800.0
WIDEST = 16
#: filter kind, first pitch class, pitch classes, frames. Kinds: 0 area against all, 1 upper against lower half,
#: 2 earlier against later half, 3 diagonal quarters, 4 middle against outer pitch classes, 5 middle against outer frames.
FILTERS = (
    (1, 0, 12, 4), (2, 2, 4, 8), (3, 0, 12, 6), (4, 0, 12, 4),
    (1, 0, 6, 8), (1, 6, 6, 8), (2, 0, 4, 12), (2, 4, 4, 12),
    (2, 8, 4, 12), (3, 0, 6, 16), (3, 6, 6, 16), (5, 3, 5, 9),
    (0, 0, 3, 8), (0, 3, 3, 8), (0, 6, 3, 8), (0, 9, 3, 8),
)
STEPS = (-0.2, 0.0, 0.2)
GRAY = np.array([0, 1, 3, 2], np.uint32)
MIN_VOTES, MIN_OVERLAP, MAX_ERRORS = 3, 30, 0.2
#: bytes of integers that meet at once on each side, about, and postings whose votes are counted at once
BLOCK, STEP = 256_000, 4_000_000


# --- fingerprints --------------------------------------------------------------------------------


def read_wave(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 and their rate, of PCM; nothing if the medium can't be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as file:
            width, channels, rate = file.getsampwidth(), file.getnchannels(), file.getframerate()
            raw = np.frombuffer(file.readframes(file.getnframes()), np.uint8)
    except (wave.Error, EOFError):
        return np.zeros(0), 0
    raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
    if width == 1:
        flat = (raw[:, 0].astype(float) - 128) / 128
    else:  # little-endian integers, moved to the upper bytes of 32 bits
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 4 - min(width, 4) :] = raw[:, -4:]
        flat = wide.view("<i4")[:, 0] / 2.0**31
    return flat.reshape(-1, channels).mean(axis=1), rate


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Frames by twelve pitch-class energies, smoothed over five frames and scaled to length one (silence: zeros)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0 or rate <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    bins = np.flatnonzero((freq >= LOWEST) & (freq <= HIGHEST))
    pitch = np.round(12 * np.log2(freq[bins] / 440.0)).astype(int) % 12
    to = np.zeros((len(bins), 12))
    to[np.arange(len(bins)), pitch] = 1
    energy = power[:, bins] @ to
    sums = np.cumsum(np.pad(energy, ((3, 2), (0, 0))), axis=0)
    energy = (sums[5:] - sums[:-5]) / 5
    size = np.sqrt((energy**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-6, energy / np.maximum(size, 1e-6), 0.0)


def fingerprint(image: np.ndarray) -> np.ndarray:
    """A packed integer for each frame at which the widest filter fits."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.pad(np.cumsum(np.cumsum(image, axis=0), axis=1), ((1, 0), (1, 0)))
    at = np.arange(n)

    def area(x: int, y: int, w: int, h: int) -> np.ndarray:
        return integral[at + x + w, y + h] - integral[at + x, y + h] - integral[at + x + w, y] + integral[at + x, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        whole = area(0, y, w, h)
        if kind == 0:
            part, rest = whole / h, (area(0, 0, w, 12) - whole) / (12 - h)
        else:
            if kind == 1:
                part = area(0, y, w, h // 2)
            elif kind == 2:
                part = area(0, y, w // 2, h)
            elif kind == 3:
                part = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            elif kind == 4:
                part = area(0, y + h // 4, w, h // 2)
            else:
                part = 2 * area(w // 3, y, w // 3, h)
            rest = whole - part if kind != 5 else whole - part / 2
        value = (part - rest) / (part + rest + 1e-9)
        out = (out << np.uint32(2)) | GRAY[np.searchsorted(STEPS, value, side="right")]
    return out


# --- alignment -----------------------------------------------------------------------------------


def halves(prints: np.ndarray) -> np.ndarray:
    """Index keys: the upper and the lower half of each integer, told apart by bit 16."""
    return np.concatenate([prints >> np.uint32(16), (prints & np.uint32(0xFFFF)) | np.uint32(0x10000)]).astype(np.int64)


def errors_at(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Overlapping integers of a and b where a's place is b's plus offset, and their bit errors."""
    a, b = a[max(offset, 0) :], b[max(-offset, 0) :]
    n = min(len(a), len(b))
    return n, int(np.bitwise_count(a[:n] ^ b[:n]).sum())


class QueryIndex:
    """Postings of a block of queries: their key halves in order, with query and place."""

    def __init__(self, ids: list[int], prints: list[np.ndarray]):
        self.ids, self.prints = ids, prints
        keys = [halves(p) for p in prints]
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        query = np.repeat(np.arange(len(prints)), [len(k) for k in keys])
        place = np.concatenate([np.tile(np.arange(len(p)), 2) for p in prints]) if prints else flat
        order = np.argsort(flat, kind="stable")
        self.keys, self.query, self.place = flat[order], query[order], place[order]
        self.span = max([len(p) for p in prints], default=0) + 1

    def votes(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of (query, offset) in order, and how many equal halves vote for each; STEP postings at a time."""
        keys, n = halves(prints), len(prints)
        lo = np.searchsorted(self.keys, keys, "left")
        count = np.searchsorted(self.keys, keys, "right") - lo
        place, width = np.tile(np.arange(n), 2), self.span + n + 1
        code, votes, first = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        ends = np.cumsum(count)
        while first < len(keys):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP, "right")))
            some, many = lo[first:last], count[first:last]
            posting = np.repeat(some - np.cumsum(many) + many, many) + np.arange(many.sum())
            mine = np.repeat(place[first:last], many)
            more, n_more = np.unique(self.query[posting] * width + (self.place[posting] - mine + n), return_counts=True)
            code, back = np.unique(np.concatenate([code, more]), return_inverse=True)
            votes = np.bincount(back, np.concatenate([votes, n_more]), len(code)).astype(np.int64)
            first = last
        return code, votes

    def matches(self, prints: np.ndarray):
        """(query id, offset, overlap, bit errors) of the queries that align: the query's place is the recording's plus offset."""
        n = len(prints)
        width = self.span + n + 1
        code, votes = self.votes(prints)
        if not len(code):
            return
        query, offset = code // width, code % width - n
        order = np.lexsort((offset, np.abs(offset), -votes, query))
        first = order[np.unique(query[order], return_index=True)[1]]
        for i in first[votes[first] >= MIN_VOTES]:
            q = int(query[i])
            overlap, bits = errors_at(self.prints[q], prints, int(offset[i]))
            if overlap >= MIN_OVERLAP and bits <= MAX_ERRORS * 32 * overlap:
                yield self.ids[q], int(offset[i]), overlap, bits


def fingerprints(media: DataFrame, decode, id_col: str, media_col: str) -> DataFrame:
    """(id, n_frames, prints) of a media column; decode turns a value into samples and rate."""
    rows = project(media, id=id_col, medium=media_col).withColumn("id", F.col("id").cast("long"))

    def run(batches):
        for batch in batches:
            frames, prints = [], []
            for value in batch.column(1):
                image = chroma(*decode(value.as_py()))
                frames.append(len(image))
                prints.append(fingerprint(image).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(frames, pa.int64()), pa.array(prints, pa.binary())], names=["id", "n_frames", "prints"])

    return rows.mapInArrow(run, "id long, n_frames long, prints binary")


def _in_blocks(rows: DataFrame, *columns: str) -> tuple[DataFrame, int]:
    """Stored rows with prints as (block, held): arrays of rows of about BLOCK bytes of prints; and the number of blocks."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("prints") + 16), F.lit(0)).alias("n")).collect()[0].n
    n = max(1, -(-size // BLOCK))
    block = F.pmod(F.xxhash64("prints"), F.lit(n)).alias("block")
    return rows.groupBy(block).agg(F.collect_list(F.struct(*columns, "prints")).alias("held")), n  # a block of bounded size


def alignments(spark: SparkSession, known: DataFrame, queries: DataFrame) -> DataFrame:
    """(key, matches) of the prints of known (id, prints) that align with prints of queries (id, prints): a row for each key and block of queries.

    key is a hash of the prints; matches are (query, offset, overlap, errors), query being the smallest id that has its prints.
    """
    key = F.sha2(F.col("prints"), 256).alias("key")
    enough = F.octet_length("prints") >= 4 * MIN_OVERLAP
    mine = materialize(spark, known.where(enough).select("prints").distinct(), "distinct-prints")
    theirs = materialize(spark, queries.where(enough & F.col("id").isNotNull()).groupBy("prints").agg(F.min("id").alias("id")), "query-prints")
    rows, n_rows = _in_blocks(mine.select(key, "prints"), "key")
    asked, n_asked = _in_blocks(theirs, "id")
    number = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    met = rows.withColumnRenamed("held", "rows").withColumn("asked", F.explode(number(n_asked)))
    other = asked.select(F.col("block").alias("asked"), "held").withColumn("block", F.explode(number(n_rows)))
    met = met.join(other.hint("shuffle_merge"), ["block", "asked"]).select("rows", "held")

    def run(batches):
        for batch in batches:
            for mine, held in zip(batch.column(0), batch.column(1)):
                read = lambda x: [np.frombuffer(p, "<u4") for p in x.values.field(1).to_pylist()]
                index = QueryIndex(held.values.field(0).to_pylist(), read(held))
                found = [(k, list(index.matches(p))) for k, p in zip(mine.values.field(0).to_pylist(), read(mine))]
                found = [(k, [dict(zip(("query", "offset", "overlap", "errors"), m)) for m in ms]) for k, ms in found if ms]
                kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("query", "offset", "overlap", "errors")]))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([ms for _, ms in found], kind)], names=["key", "matches"])

    return met.mapInArrow(run, "key string, matches array<struct<query:long,offset:long,overlap:long,errors:long>>")


def align(spark: SparkSession, known: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row of the stored table known (id, n_frames, prints) with all queries that align with it.

    queries has columns id and prints too. The columns added: matches, an array of (query, n, offset, overlap,
    errors) by query: the smallest id other than the row's own of n queries of the same prints; n_matches, the
    number of queries; and the best match. A recording is not held against itself.
    """
    queries = materialize(spark, queries.where("id is not null").select("id", "prints").distinct(), "queries")
    key = F.sha2(F.col("prints"), 256)
    low = queries.groupBy("prints").agg(F.min("id").alias("query"), F.count("*").alias("n"))
    second = queries.join(low, "prints").where("id <> query").groupBy("query").agg(F.min("id").alias("second"))
    shared = materialize(spark, low.select("query", "n", key.alias("own_key")).join(second, "query", "left"), "query-groups")
    found = materialize(spark, alignments(spark, known, queries), "alignments")
    entry = joined(found.select("key", F.explode("matches").alias("m")).select("key", "m.*"), shared, "query")
    plain = F.struct("query", "n", "offset", "overlap", "errors", "second", (F.col("own_key") == F.col("key")).alias("same"))
    by_key = entry.groupBy("key").agg(F.array_sort(F.collect_list(plain)).alias("all"))  # the distinct queries of one recording: what was asked for
    by_key = materialize(spark, by_key, "matches")
    is_query = materialize(spark, queries.select("id").distinct().withColumn("is_query", F.lit(True)), "query-ids")
    rows = joined(known.withColumn("key", key), is_query, "id", how="left")
    rows = joined(rows, by_key, "key", how="left")

    def others(m):
        itself = m["same"] & F.coalesce(F.col("is_query"), F.lit(False))
        n = m["n"] - F.when(itself, F.lit(1)).otherwise(F.lit(0)).cast("long")
        query = F.when(itself & (m["query"] == F.col("id")), m["second"]).otherwise(m["query"])
        return F.struct(query.alias("query"), n.alias("n"), m["offset"].alias("offset"), m["overlap"].alias("overlap"), m["errors"].alias("errors"))

    matches = F.coalesce(F.filter(F.transform("all", others), lambda m: m["n"] > 0), F.array().cast("array<struct<query:long,n:long,offset:long,overlap:long,errors:long>>"))
    rows = rows.withColumn("matches", matches)
    rank = lambda m: F.struct(m["errors"] / (32 * m["overlap"]), -m["overlap"], m["query"], m["offset"], m["errors"])
    best = F.array_min(F.transform("matches", rank))
    names = ("best_query", "best_offset", "best_overlap", "best_errors")
    values = (best["query"], best["offset"], -best["col2"], best["errors"])
    n_matches = F.aggregate("matches", F.lit(0).cast("long"), lambda n, m: n + m["n"])
    return rows.select("id", "n_frames", "prints", n_matches.alias("n_matches"), *[v.alias(x) for v, x in zip(values, names)], "matches")


# --- the query's recordings ------------------------------------------------------------------------

RATE, NOTE = 4000, 500


def recording(vector: list[float] | None) -> bytes | None:
    """A vector played as a melody: a note of two partials for each component, higher for larger values; 16-bit PCM."""
    if not vector:
        return None
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector]))
    size = np.sqrt((v**2).mean()) or 1.0
    steps = np.clip(np.round(3 * v / size), -12, 12)
    pitch = np.repeat(440.0 * 2 ** (steps / 12), NOTE)
    phase = np.cumsum(pitch) * (2 * np.pi / RATE)
    samples = 0.6 * np.sin(phase) + 0.2 * np.sin(2 * phase)
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(RATE)
        file.writeframes((samples * 32767 * 0.9).astype("<i2").tobytes())
    return buffer.getvalue()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding, played, fingerprinted, and held against those whose vec_id is divisible by 100."""
    media = table(spark, sf_dir, "embeddings")
    known = materialize(spark, fingerprints(media, lambda v: read_wave(recording(v)), "vec_id", "embedding"), "prints")
    found = align(spark, known, known.where("id % 100 = 0"))
    digest = F.sha2(F.col("prints"), 256).alias("prints_sha256")
    listed = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["query"], m["n"], m["offset"], m["overlap"], m["errors"])), ",")
    return found.select(F.col("id").alias("vec_id"), "n_frames", (F.octet_length("prints") / 4).cast("long").alias("n_prints"), digest, *found.columns[3:-1], listed.alias("matches"))
