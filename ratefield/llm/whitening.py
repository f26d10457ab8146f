"""Whitening of embeddings from an exact scatter matrix: modular products over several primes, put together by the Chinese remainder theorem."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratefield.llm.common import added_arrays, small_batches, task

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Entries are held within this, so that they and their differences are longs.
MOST = 2**61
#: Residues lie within half a prime of 0; so many rows of products of two, each under 2**40, add up below 2**53: doubles are exact.
PRIME_BITS, ROWS = 21, 4096


def primes(count: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS."""
    found, n = [], 2**PRIME_BITS - 1
    while len(found) < count:
        if all(n % d for d in range(3, math.isqrt(n) + 1, 2)):
            found.append(n)
        n -= 2
    return found


def integers(values: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1,000,000; where 64 c is beyond MOST it counts as MOST, with its sign."""
    return np.clip(np.floor(values * float(SCALE)), -float(MOST), float(MOST)).astype(np.int64) + SHIFT


def usable(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has `dims` entries, all finite, and these as doubles."""
    column = batch.column("vector")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dims)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    fine = np.isfinite(flat).all(1)
    return rows[fine], flat[fine]


def _look(batches):
    """How many usable rows there are by number of entries, and their largest entry."""
    found: dict[int, list] = {}
    for batch in batches:
        size = np.unique(np.asarray(batch.column("vector").value_lengths().fill_null(0)))
        for dims in size[size > 0].tolist():
            values = usable(batch, dims)[1]
            if len(values):
                n, most = found.get(dims, (0, 0.0))
                found[dims] = [n + len(values), max(most, float(np.abs(values).max()))]
    if found:
        yield pa.record_batch([pa.array(list(found)), pa.array([x[0] for x in found.values()]), pa.array([x[1] for x in found.values()], pa.float64())], ["dims", "n", "most"])


def _scatter(dims: int, moduli: list[int]):
    """One row a task: modulo each prime, the products of all pairs of columns of (x, 1), added up over rows."""

    def run(batches):
        total = np.zeros((len(moduli), dims + 1, dims + 1), np.int64)
        for batch in batches:
            x = integers(usable(batch, dims)[1])
            for a in range(0, len(x), ROWS):
                part = np.column_stack([x[a : a + ROWS], np.ones(len(x[a : a + ROWS]), np.int64)])
                for k, p in enumerate(moduli):
                    half = p // 2
                    r = ((part + half) % p - half).astype(float)
                    total[k] += (r.T @ r).astype(np.int64) % p
                total %= np.array(moduli)[:, None, None]
        if total.any():
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return run


def reconstruct(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """The integers (within half the product of the primes of 0) that have these residues, as Python integers."""
    product = math.prod(moduli)
    total = np.zeros(residues.shape[1:], object)
    for r, p in zip(residues, moduli, strict=True):
        rest = product // p
        total = total + (r % p).astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


class Whitener:
    """Fitted on n vectors with exact sums and scatter n * sum(x x') - sum(x) sum(x)'; components by falling variance."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, components: int):
        self.n, dims = n, len(sums)
        #: S / n as a whole number and a rest over n.
        self.whole, self.rest = (np.array(x, object) for x in zip(*(divmod(s, n) for s in sums), strict=True))
        scatter = products * n - np.outer(np.array(sums, object), np.array(sums, object))
        square = n * n
        # a quotient of Python integers is rounded once
        self.covariance = np.array([[int(v) / square for v in row] for row in scatter], float).reshape(dims, dims)
        self.trace = sum(int(scatter[i, i]) for i in range(dims)) / square
        # scaled by a power of two, which is exact, so that nothing overflows
        scale = 2.0 ** math.frexp(self.trace)[1] if self.trace > 0 else 1.0
        values, vectors = np.linalg.eigh(self.covariance / scale)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order] * scale, vectors[:, order]
        #: Components of no variance, but for rounding, can't be whitened.
        self.fit = self.values > self.trace * 1e-14
        with np.errstate(divide="ignore", invalid="ignore"):
            self.project = np.where(self.fit, self.vectors / np.sqrt(np.where(self.fit, self.values, 1.0)), 0.0)
        self.explained = self.values.clip(0) / self.trace if self.trace > 0 else np.zeros(len(order))
        self.small = all(abs(int(w)) < MOST for w in self.whole)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the difference of whole numbers is exact, then the rest is taken off."""
        return (x - self.whole.astype(np.int64)).astype(float) - self.rest.astype(float) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.project

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; null where a long can't hold it."""
        d = x - self.whole.astype(np.int64)
        bound = self.n * (float(np.abs(d).max(initial=0)) + 1)
        if bound * bound * max(1, d.shape[1]) < 2**62:
            e = d * self.n - self.rest.astype(np.int64)
            return (e * e).sum(1).tolist()
        e = d.astype(object) * self.n - self.rest
        return [v if v < 2**63 else None for v in (e * e).sum(1).tolist()]


def _gram(shared, dims: int):
    """One row a task: sums and products of whitened vectors, as doubles."""

    def run(batches):
        w, total = shared.value, None
        for batch in batches:
            x = integers(usable(batch, dims)[1])
            y = np.column_stack([w.whiten(x), np.ones(len(x))])
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _add_doubles(batches):
    total = None
    for batch in batches:
        for data in batch.column("sums").to_pylist():
            total = np.frombuffer(data) if total is None else total + np.frombuffer(data)
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sums"])


def measured_error(vectors: DataFrame, shared, dims: int, fit: np.ndarray, fan: int = 32) -> float:
    """The largest absolute entry of the whitened rows' covariance (of components with variance) minus the identity."""
    rows = vectors.mapInArrow(task(_gram(shared, dims)), "sums binary")
    parts = rows.rdd.getNumPartitions()
    while parts > fan:
        parts = -(-parts // fan)
        rows = rows.repartition(parts).mapInArrow(task(_add_doubles), "sums binary")
    total = sum(np.frombuffer(x) for x in rows.toArrow()["sums"].to_pylist()).reshape(len(fit) + 1, -1)
    n, mean = total[-1, -1], total[:-1, -1] / total[-1, -1]
    cov = (total[:-1, :-1] / n - np.outer(mean, mean))[np.ix_(fit, fit)]
    return float(np.abs(cov - np.eye(len(cov))).max(initial=0.0))


def _apply(shared, dims: int, error: float):
    def run(batches):
        w = shared.value
        k = len(w.values)
        for batch in batches:
            rows, values = usable(batch, dims)
            x = integers(values)
            white = w.whiten(x)
            each = lambda column: pa.array(np.repeat(np.arange(len(rows)), k)) if column is None else column.take(pa.array(np.repeat(rows, k)))
            m = len(rows)
            deviation = pa.array(w.deviation(x), pa.int64()).take(each(None))
            yield pa.record_batch(
                [each(batch.column("vec_id")), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)), deviation]
                + [pa.array(white.ravel(), mask=np.tile(~w.fit, m)), pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitener | None, int]:
    """A whitener of all usable rows of `vector`, and the number of entries; None without any.

    The number of entries is the one that most rows have (of equal ones the larger); rows with another can't be used.
    A first look finds it with the count and the largest entry, which bound the sums: as many primes are taken as the
    bound needs. Each task multiplies residues in blocks of 4,096 rows and sends a matrix a prime; matrices are added in
    steps, so that no task and not the driver gets more than 32.
    """
    small_batches(vectors.sparkSession, ROWS)
    seen = vectors.select("vector").mapInArrow(task(_look), "dims long, n long, most double").groupBy("dims").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    first = seen.orderBy(F.desc("n"), F.desc("dims")).first()
    if first is None:
        return None, 0
    dims, largest = first["dims"], min(int(min(first["most"], 1e30) * SCALE) + 1, MOST) + SHIFT
    bound = 2 * first["n"] * largest * largest + 1
    moduli = primes(max(2, -(-bound.bit_length() // (PRIME_BITS - 1))))
    residues = added_arrays(vectors.mapInArrow(task(_scatter(dims, moduli)), "counts binary")).reshape(len(moduli), dims + 1, dims + 1)
    exact = reconstruct(residues, moduli)
    return Whitener(int(exact[-1, -1]), [int(v) for v in exact[-1, :-1]], exact[:-1, :-1], min(components, dims)), dims


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Each vector's projections on the principal components of all, over the square root of their variances.

    Entries c become x = floor(64 c) + 1,000,000 as longs. n, sums and the scatter of x are exact integers, found by
    matrix products modulo several primes in each partition; the covariance is rounded once and decomposed in doubles.
    Returns vec_id, component (1 to `components`, by falling variance), n, deviation (sum of (n x - S)^2), whitened,
    explained and identity_error (measured on the whitened rows). Columns of df may have any name; others than the two
    don't matter.

    Vectors that are null, empty, hold a null or a number that isn't finite, or have another number of entries than most,
    are left out. A null or repeated id stays as it is, equal rows count each. A component without variance (fewer
    vectors than entries, constant entries) has whitened null and doesn't enter identity_error. Entries beyond 2**61 / 64
    count as that; a deviation that a long can't hold is null. Without rows left there is no row.
    """
    spark = df.sparkSession
    vectors = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    schema = f"vec_id {df.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted, dims = fit(vectors, components)
    if fitted is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(fitted)
    error = measured_error(vectors, shared, dims, fitted.fit)
    return vectors.mapInArrow(task(_apply(shared, dims, error)), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
