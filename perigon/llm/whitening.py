"""Whitening of embeddings by LOBPCG, the locally optimal block preconditioned conjugate gradient method.

Vectors become whole numbers, x = floor(SCALE c) + SHIFT, so that sums are exact and centring loses nothing: a
centred entry is (n (x - r) - (S - n r)) / n with r the whole number nearest to the mean, and only the division rounds.

The covariance is never formed from the rows. A round multiplies it with a block of at most 3 x (components
+ SPARE) columns: each task adds up C' (C B) over its centred rows C, the sums are added by Spark. Rayleigh-Ritz on
the span of the iterate, its residuals and the previous directions gives the next iterate. When the residuals
are small, a product with the iterate itself certifies them (TOLERANCE times the largest eigenvalue);
otherwise rounds go on. Where the dimension is at most that of the span, one round reaches every component.

The driver and each task hold blocks of `dimension` rows, whatever the number of vectors; a task sees a batch of vectors at a time.

Edge cases: vectors that are null or have null, NaN or infinite entries are dropped, and so are entries of 2^40 and
more (no whole number that sums exactly) and vectors that are shorter than the longest. Repeated rows and null
ids stay. No vectors, or vectors without any variance, give no components and so no rows. Fewer components
than asked for are found where the covariance has fewer eigenvalues above RANK times the largest one.
A deviation beyond 64 bits is null. Of equal eigenvalues any orthonormal vectors are taken. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigon.llm import common

COMPONENTS = 32
#: Further columns of the iterate: the last components converge by the distance to the eigenvalues beyond them.
SPARE = 8
SCALE = 64
SHIFT = 1_000_000
LARGEST = float(1 << 40)
TOLERANCE = 1e-12
RANK = 1e-11
ROUNDS = 500


@dataclass
class Whitening:
    """Counts and sums of the fit list, its trace, and unit eigenvectors (columns) by falling eigenvalue with their certified residuals."""

    n: int
    sums: list[int]
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    rounds: int


def whole_numbers(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, x) of the vectors that take part, written."""
    spark = rows.sparkSession
    c = F.col(f"`{vector}`").cast("array<double>")
    good = rows.select(F.col(f"`{id}`").alias("id"), c.alias("c")).filter(F.col("c").isNotNull() & F.forall("c", lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False))))
    longest = good.agg(F.max(F.size("c"))).first()[0] or 0
    x = F.transform("c", lambda v: F.floor(v * SCALE).cast("bigint") + SHIFT)
    return common.written(good.filter((F.size("c") == longest) & (F.size("c") > 0)).select("id", x.alias("x")), spark, "whitening-fit")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                for i in range(0, len(x), 8192):  # below 2^47 each
                    own = x[i : i + 8192].sum(axis=0).astype(object)
                    total = own if total is None else total + own
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(total))], pa.int32()), pa.array([Decimal(n), *[Decimal(int(v)) for v in total]], pa.decimal128(38, 0))], names=["dim", "total"])

    found = dict(fit.select("x").mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect())  # a row for each dimension
    return int(found.get(-1, 0)), [int(found[k]) for k in sorted(found) if k >= 0]


class Centre:
    """Centring of whole-number vectors by the sums of n of them."""

    def __init__(self, n: int, total: list[int]):
        self.n = n
        near = [round(s / n) if abs(s) < 1 << 50 else (2 * s + n) // (2 * n) for s in total]
        self.near = np.array(near, np.int64)
        self.rest = np.array([s - n * r for s, r in zip(total, near)], np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64 where that is wide enough, else Python's numbers."""
        off = x - self.near
        if self.n * (int(np.abs(off).max(initial=0)) + 1) < 1 << 62:
            return off * self.n - self.rest
        return off.astype(object) * self.n - self.rest.astype(object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(self.scaled(x) / self.n, np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2 by row, null beyond 64 bits."""
        u = self.scaled(x)
        if u.dtype != object and int(np.abs(u).max(initial=0)) ** 2 * u.shape[1] < 1 << 63:
            return (u * u).sum(axis=1).tolist()
        found = [sum(v * v for v in row) for row in u.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def _summed(rows: DataFrame, part, width: int, shape: tuple[int, int]) -> np.ndarray:
    """A matrix that is the sum of what part(batches) gives in each task; only its cells reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = part(batches)
        if own is not None:
            offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(own.ravel()))], names=["row", "cells"])

    cells = rows.mapInArrow(run, "row int, cells array<double>").select("row", F.posexplode("cells").alias("at", "cell"))
    out = np.zeros(shape)
    for row, at, cell in cells.groupBy("row", "at").agg(F.sum("cell")).collect():
        out[row, at] = cell
    return out


def product(fit: DataFrame, centre: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times a block of columns, and the covariance's trace."""
    spark = fit.sparkSession
    shared = spark.sparkContext.broadcast(block)
    d, k = block.shape

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.zeros((0, d), np.int64)
            for i in range(0, len(x), 4096):
                rows = centre.rows(x[i : i + 4096])
                own = np.concatenate([rows.T @ (rows @ shared.value), (rows * rows).sum(axis=0)[:, None]], axis=1)
                total = own if total is None else total + own
        return total

    found = _summed(fit.select("x"), part, k + 1, (d, k + 1)) / centre.n
    shared.destroy()
    return found[:, :k], float(found[:, k].sum())


def _span(*blocks: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span the blocks' columns, each of which counts whatever its length."""
    scaled = []
    for b in blocks:
        length = np.linalg.norm(b, axis=0)
        scaled.append(b[:, length > 0] / length[length > 0])
    left, size, _ = np.linalg.svd(np.concatenate(scaled, axis=1), full_matrices=False)
    return left[:, size > 1e-10 * size[0]]


def lobpcg(fit: DataFrame, centre: Centre, components: int, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, int]:
    """Eigenvectors (columns), eigenvalues, certified residual norms, trace and rounds."""
    d = len(centre.near)
    m = min(d, components + SPARE)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    x = direction = np.zeros((d, 0))
    best, stalled = np.inf, 0
    for turn in range(1, rounds + 1):
        image, trace = product(fit, centre, basis)
        small = basis.T @ image
        value, mix = np.linalg.eigh((small + small.T) / 2)
        value, mix = value[::-1][:m], mix[:, ::-1][:, :m]
        old, x, image = x, basis @ mix, image @ mix
        keep = min(components, x.shape[1])
        residual = image - x * value
        largest = float(np.linalg.norm(residual[:, :keep], axis=0).max(initial=0))
        stalled = 0 if largest < best / 2 else stalled + 1
        best = min(best, largest)
        # the residuals of the iterate are a little off where rounds have mixed products; a product of its own tells
        if largest <= tolerance * value[0] or stalled > 20 and largest <= 1e3 * tolerance * value[0]:
            image, trace = product(fit, centre, x)
            residual = image - x * value
            if np.linalg.norm(residual[:, :keep], axis=0).max(initial=0) <= 1e3 * tolerance * max(value[0], 0):
                some = slice(0, int((value[:keep] > RANK * max(value[0], 0)).sum()))
                return x[:, some], value[some], np.linalg.norm(residual, axis=0)[some], trace, turn
        direction = x - old @ (old.T @ x) if old.shape[1] else direction
        inside = residual - x @ (x.T @ residual)
        basis = _span(x, inside, direction)
    raise RuntimeError(f"residuals of {best:g} after {rounds} rounds, {tolerance * value[0]:g} is asked for")


def fitted(fit: DataFrame, components: int = COMPONENTS, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> Whitening | None:
    """The whitening of a table of `whole_numbers`; None without vectors."""
    common.sent_to_workers(fit.sparkSession)
    n, total = sums(fit)
    if not n:
        return None
    vectors, values, residuals, trace, turns = lobpcg(fit, Centre(n, total), components, tolerance, rounds)
    return Whitening(n, total, trace, vectors, values, residuals, turns)


def projected(fit: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation and z, the whitened vector, of each row of the fit table."""
    shared = fit.sparkSession.sparkContext.broadcast(model.vectors / np.sqrt(model.values))
    centre, k = Centre(model.n, model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                z = centre.rows(x) @ shared.value
                offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centre.deviations(x), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=["id", "deviation", "z"])

    kind = fit.schema["id"].dataType.simpleString()
    return fit.select("id", "x").mapInArrow(run, f"id {kind}, deviation bigint, z array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of z less the identity."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = np.asarray(batch.column(0).flatten()).reshape(-1, k)
                own = np.concatenate([z.T @ z, z.sum(axis=0)[:, None]], axis=1)
                total = own if total is None else total + own
        return total

    found = _summed(whitened.select("z"), part, k + 1, (k, k + 1)) / n
    return float(np.abs(found[:, :k] - np.outer(found[:, k], found[:, k]) - np.eye(k)).max())


def whitened(spark: SparkSession, rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each component: n, deviation, whitened, explained, identity_error."""
    common.sent_to_workers(spark)
    fit = whole_numbers(rows, id, vector)
    model = fitted(fit, components)
    kind = rows.schema[id].dataType.simpleString()
    if model is None or not len(model.values):
        common.removed(fit)
        return spark.createDataFrame([], f"`{id}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    z = common.written(projected(fit, model), spark, "whitening-rows")
    error = identity_error(z, model.n, len(model.values))
    common.removed(fit)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return z.select(F.col("id").alias(id), "deviation", F.posexplode("z").alias("at", "whitened")).select(
        id, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )


def report(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return whitened(spark, embeddings)
