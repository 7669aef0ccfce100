"""What the pipeline operators share: tables, the shared folder, column projection, word hashes.

All hashing is vectorised over the UTF-8 bytes of a block of texts. A block holds about BLOCK_BYTES,
or one longer text, which bounds a Python worker's memory by a few dozen times that.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import AtomicType

BLOCK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project(df: DataFrame, **columns: str) -> DataFrame:
    """Select columns by exact name (new name = old name).

    Other columns are dropped, so extra columns cannot clash with an operator's own, whatever their
    names, and names that differ only in case or hold dots are no trouble.
    """
    at = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    missing = [old for old in columns.values() if old not in at]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[old]}").alias(new) for new, old in columns.items()])


#: tables of this process stand in a folder of this name, which clear() deletes
RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set it is in the warehouse, or a temporary one on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/quillon-tables"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This process's folder in the shared one."""
    return f"{shared_dir(spark)}/quillon/{RUN}"


#: a shared folder on a local disk: Hadoop's default starts chmod three times for each file (its task's folder, the file, its
#: checksum), and until it has begun chmod counts as another executor's memory; plain files have no checksum. Other stores are not concerned.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends, a lost executor loses nothing."""
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.options(**PLAIN_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Batches of about BATCH_BYTES at most between Spark and its Python workers, while a job runs."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, path) -> None:
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this process stored; results that were not read or written yet are lost with them."""
    _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark)))


@atexit.register
def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and spark.conf.get("spark.checkpoint.dir", None):
        clear(spark)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in frames:
        for name in df.inputFiles()[:1]:
            _delete(spark, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent())


def small(df: DataFrame, most: int) -> DataFrame:
    """A stored table, to be broadcast in a join if it has at most so many rows; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= most else df


def salted(rows: DataFrame, few: DataFrame, salts: int, *key: str, without: str = "text") -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on key with a column salt to join on as well.

    Rows equal in key are spread by what their other plain columns hold, but for one of long texts; each
    share meets all of few.
    """
    others = [F.col(f"`{f.name}`") for f in rows.schema if f.name not in (*key, without) and isinstance(f.dataType, AtomicType)]
    spread = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(0), *others), F.lit(salts)))
    return spread, few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))


#: rows of a small side that are broadcast at most; beyond that both sides are salted
BROADCAST_ROWS, SALTS = 500_000, 16


def joined(rows: DataFrame, few: DataFrame, *key: str, how: str = "inner") -> DataFrame:
    """rows with the stored table few, of which a key has one row but rows may have many."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), [*key], how)
    rows, few = salted(rows, few, SALTS, *key)
    return rows.join(few, [*key, "salt"], how).drop("salt")


def text_key(column) -> tuple:
    """Two 64-bit hashes that together stand for a text; a null has its own."""
    text = F.col(column)
    return F.xxhash64(text, text.isNull()), F.xxhash64(F.lit(7), text, text.isNull())


# --- words and hashes over bytes -------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: words of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, dtype=_U)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def blocks(offsets: np.ndarray):
    """Ranges of rows of about BLOCK_BYTES; a longer text makes a block of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of consecutive texts, and each text's range in them.

    raw holds the texts' bytes; offsets (n+1) delimit them, starting at 0.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    low = LOWER[raw]
    inside = kind[low]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum((low.astype(_U) + _U(1)) * powers(_BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, n)[starts]
    return mix(h ^ ((ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))), np.searchsorted(starts, offsets)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that begin at each of the first len(h)-k+1 words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _U(0x9FB21C651E98DF25)
        out += h[j : j + n]
    return mix(out)


def arrow_batches(rows, columns: dict, size: int = 4096):
    """Record batches of about size rows from tuples; columns: name to Arrow type."""
    schema = pa.schema(list(columns.items()))
    kept: list = []
    for row in rows:
        kept.append(row)
        if len(kept) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
            kept = []
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), schema.types)], schema=schema)
