"""Helpers that the corpus operators share: scratch tables, range buckets and hashing over Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"
_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a temporary one where that is unset and all run in one process."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ratefield-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables and files of one run, in a folder of its own below the shared one. `made` lists those of this process that are left."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/ratefield/{name}-{uuid.uuid4().hex}"
        Scratch.made.append(self)

    def table(self, df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
        """Write df as Parquet and read it back: this cuts the lineage and survives the loss of executors.

        narrow: rows are few bytes each, so two files a core are enough.
        """
        path = f"{self.path}/{name}"
        if narrow:
            df = df.coalesce(2 * self.spark.sparkContext.defaultParallelism)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if not name and self in Scratch.made:
            Scratch.made.remove(self)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as texts can be long, and let Python workers find this library."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if _HOME not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([_HOME, *filter(None, paths)])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: What a worker keeps for the next task of the same kind, by kind; a task of another kind drops it.
KEPT: dict[str, object] = {}


def task(run, keeps: str = ""):
    """A mapInArrow function that leaves a worker as small as it found it: a worker serves many tasks, and what a task leaves would add up."""

    def whole(batches):
        _begin(keeps)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


# Functions of the module, so that workers use the module's own KEPT and library.


def _begin(keeps: str) -> None:
    for kind in [k for k in KEPT if k != keeps]:
        del KEPT[kind]


def give_back() -> None:
    """Return free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        found = ctypes.CDLL("libc.so.6")
    except OSError:
        return None
    return found if hasattr(found, "malloc_trim") else None


_LIBC = _libc()


#: Ranges at most (a megabyte of bounds).
MOST_RANGES = 1 << 17


def range_bounds(df: DataFrame, key: str, buckets: int) -> list[int]:
    """Lower bounds of `buckets` ranges of an integral key with about as many rows each; found by one scan of that column."""
    buckets = max(1, min(buckets, MOST_RANGES))
    at = [i / buckets for i in range(1, buckets)]
    if not at:
        return []
    found = df.agg(F.percentile_approx(key, numbers(at, "double"), max(20_000, 20 * buckets))).first()[0]
    return sorted(set(found or []))


def numbers(values: list, kind: str = "bigint") -> Column:
    """An array of constants as one literal, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below key (null: 0), by a binary search in the JVM."""
    if not bounds:
        return F.lit(0)
    top = 2 ** max(1, (len(bounds)).bit_length())
    held = numbers(bounds + [2**63 - 1] * (top - len(bounds)))
    steps = [top >> i for i in range(1, top.bit_length())]
    found = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(held, low + step - 1) <= key, low + step).otherwise(low)
    )
    return F.coalesce(F.least(found, F.lit(len(bounds))), F.lit(0))


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row that can be hashed (maps can't): equal rows have equal ones."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))])


def word_count(text: Column) -> Column:
    """Words of a text (null: 0): places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# Hashing of words over the bytes of an Arrow column.

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_codes(fold: bool) -> np.ndarray:
    codes = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    if fold:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {fold: _byte_codes(fold) for fold in (False, True)}
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[32, *range(9, 14)]] = True
#: Bytes that part the words of letters and digits: [\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased.
IS_SIGN = np.zeros(256, bool)
IS_SIGN[:128] = True
for _a, _z in (b"09", b"az", b"AZ"):
    IS_SIGN[_a : _z + 1] = False
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, _U)
_INVERSE = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, 1 << 16)
        _POWERS, _INVERSE = (np.full(size, base & (2**64 - 1), _U) for base in (_BASE, pow(_BASE, -1, 2**64)))
        _POWERS[0] = _INVERSE[0] = 1
        np.cumprod(_POWERS, out=_POWERS)
        np.cumprod(_INVERSE, out=_INVERSE)
    return _POWERS, _INVERSE


class Words:
    """The words of a few texts: where each begins and ends in the bytes, its document and its 64-bit hash.

    The hash is a polynomial over random byte codes modulo 2**64, made final by splitmix64; with fold, A-Z count as a-z.
    parting: which of the 256 bytes part words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True, parting: np.ndarray = _IS_BLANK):
        self.docs, self.data, self.offsets = len(offsets) - 1, data, offsets
        blank = parting[data]
        inside = ~blank
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= blank[:-1] | edge[1:-1]
            last[:-1] &= blank[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        powers, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, _U)
        np.cumsum(_CODES[fold][data] * powers[: len(data)], out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(_U))
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=self.docs)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of every window of n words that lies in one document, in order."""
        if len(self.hash) < n:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        m = len(self.hash) - n + 1
        h = np.zeros(m, _U)
        for i in range(n):
            h = h * _U(0x2545F4914F6CDD1D | 1) + self.hash[i : i + m]
        same = self.doc[:m] == self.doc[n - 1 :]
        return mix64(h[same]), self.doc[:m][same]

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of n words; a document with one to n-1 words gives all of them as a single shingle."""
        h, doc = self.windows(n)
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        if not len(short):
            return h, doc
        begin = np.concatenate([[0], np.cumsum(self.counts)])
        whole = np.zeros(len(short), _U)
        for i in range(n - 1):
            has = self.counts[short] > i
            whole[has] = whole[has] * _U(0x2545F4914F6CDD1D | 1) + self.hash[begin[short[has]] + i]
        whole = mix64(whole ^ mix64(self.counts[short].astype(_U)))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        return h[order], doc[order]


def distinct_by_doc(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document in rising order, and the offset of each document's first."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(docs + 1))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each have about `most` bytes, or are a single one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def _sum_arrays(batches):
    total = None
    for batch in batches:
        for data in batch.column("counts").to_pylist():
            one = np.frombuffer(data, np.int64)
            total = one.copy() if total is None else total + one
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])


def added_arrays(rows: DataFrame, fan: int = 32) -> np.ndarray | None:
    """The sum of the int64 arrays of equal length in `counts`, one a task: in steps of `fan` tasks, so that a task and the driver get `fan` rows at most. None without rows."""
    parts = rows.rdd.getNumPartitions()
    while parts > fan:
        parts = -(-parts // fan)
        rows = rows.repartition(parts).mapInArrow(task(_sum_arrays), "counts binary")
    found = [np.frombuffer(x, np.int64) for x in rows.toArrow()["counts"].to_pylist()]
    return sum(found) if found else None
