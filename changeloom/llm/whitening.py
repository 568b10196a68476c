"""Whitening of embeddings by their leading principal components.

Spark sums the vectors, then the products of the centred ones, as one matrix a partition added up in a tree. Intervals of the
spectrum are cut on the driver by inertia counts; each is one task's contour integration (see feast). The matrix, the
components and the sums have the vectors' length, whatever the number of rows, and are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm import feast
from changeloom.llm.shared import partitions

SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 44
FAN_IN = 8
DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whole(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """floor(64 c) + 1000000 of a batch's vectors; entries that would lose digits raise."""
    c = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * SCALE
    if len(c) and np.abs(c).max() >= MOST:
        raise OverflowError(f"an entry of {np.abs(c).max() / SCALE} is too large to be counted exactly")
    return np.floor(c).astype(np.int64) + SHIFT


class Centre:
    """n vectors with exact sums S by dimension: what one is apart from their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.quotient = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """x - S / n"""
        return (x - self.quotient) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exactly."""
        d = x - self.quotient
        most = (int(np.abs(d).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            t = d * self.n - self.rest
            return (t * t).sum(1).tolist()
        return [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in d]


def _gram(vectors: DataFrame, size: int, rows: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """M'M of all rows: a matrix a partition, then sums of FAN_IN each until one is left, which the driver gets."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            m = rows(b)
            total += m.T @ m
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_buffer(), float).reshape(size, size)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    out, n = vectors.mapInArrow(own, "m binary"), partitions(vectors.sparkSession)
    while n > 1:
        n = -(-n // FAN_IN)
        out = out.repartition(n).mapInArrow(add, "m binary")
    return sum(np.frombuffer(r[0], float).reshape(size, size) for r in out.toLocalIterator())


def _sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * size
        for b in batches:
            n += b.num_rows
            total = [s + int(x) for s, x in zip(total, _whole(b, size).sum(0), strict=True)]
        yield pa.record_batch([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(list(map(str, total)))], names=["i", "n", "s"])

    got = vectors.mapInArrow(own, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r.i: r for r in got}
    return (by[0].n, [int(by[i].s) for i in range(size)]) if by else (0, [])


def leading(spark, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, that rounding tells from zero, and their unit vectors as columns, with the largest entry positive. A task for each interval of the spectrum."""
    size = len(matrix)
    floor = 8 * size * np.finfo(float).eps * max(np.trace(matrix), 0.0)
    parts = feast.slices(matrix, k, floor)
    if not parts:
        return np.zeros(0), np.zeros((size, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                e, v = feast.eigenpairs(matrix, *parts[i])
                yield pa.record_batch([pa.array(e), pa.array(v.T.tolist(), pa.list_(pa.float64()))], names=["e", "v"])

    rows = spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "e double, v array<double>").collect()
    rows = sorted(rows, key=lambda r: (-r.e, r.v))[:k]
    vectors = np.array([r.v for r in rows]).T
    most = np.abs(vectors).argmax(0)
    return np.array([r.e for r in rows]), vectors * np.sign(vectors[most, np.arange(len(rows))])


def usable(table: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """vec_id and the vectors, as doubles, without null or non-finite entries; and their length, the greatest there is. Shorter vectors lack entries and are left out like those with null ones."""
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = v.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size = fine.agg(F.max(F.size("v"))).first()[0] or 0
    return fine.where(F.size("v") == size), size


def whiten(table: DataFrame, k: int = 32, vector: str = "embedding") -> DataFrame:
    """vec_id, component (1 to k by falling variance), n, deviation, whitened, explained, identity_error for each usable vector of (vec_id, embedding).

    A vector's entries become whole numbers x = floor(64 c) + 1000000. deviation is its squared distance from the mean, times n^2,
    in whole numbers; whitened its part along the component over the component's standard deviation; explained the component's
    share of the variance; identity_error the largest entry by which the covariance of all whitened vectors departs from the
    identity. Components of no variance beyond rounding are not returned: equal vectors, or a single one, give no rows. Rows that repeat a
    vec_id, or have none, are vectors each; with no usable vector, or empty ones, there are no rows; other columns are ignored. Entries from 2^38 on, and
    deviations beyond 64 bits, raise. Where variances are equal to rounding, the choice among their components is arbitrary, the same for all rows.
    """
    spark = table.sparkSession
    vectors, size = usable(table, vector)
    none = spark.createDataFrame([], DDL)
    if not size:
        return none
    n, sums = _sums(vectors, size)
    centre = Centre(n, sums)
    # a last column of ones gives the sums of the centred vectors, which rounding leaves a little beside zero
    both = _gram(vectors, size + 1, lambda b: np.column_stack([centre.apart(_whole(b, size)), np.ones(b.num_rows)]))
    matrix = (both + both.T)[:size, :size] / 2 / n
    e, p = leading(spark, matrix, k)
    if not len(e):
        return none
    turn = p / np.sqrt(e)
    mean = both[size, :size] / n @ turn
    again = _gram(vectors, len(e), lambda b: centre.apart(_whole(b, size)) @ turn - mean) / n
    error = float(np.abs(again - np.eye(len(e))).max())
    explained = e / np.trace(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _whole(b, size)
            times = lambda a: np.repeat(np.asarray(a), len(e))
            deviation = centre.deviation(x)
            if max(deviation, default=0) >= 1 << 63:
                raise OverflowError("a deviation is beyond 64 bits")
            names = b.column(0).take(pa.array(times(np.arange(len(x)))))
            cols = [names, pa.array(np.tile(np.arange(1, len(e) + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * len(e), n)), pa.array(times(np.array(deviation, np.int64)))]
            cols += [pa.array((centre.apart(x) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * len(e), error))]
            yield pa.record_batch(cols, names=[c.split()[0] for c in DDL.split(", ")])

    return vectors.mapInArrow(run, DDL)
