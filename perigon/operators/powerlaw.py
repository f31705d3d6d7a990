"""Discrete power-law fits of count distributions.

The lower bound is given, or it is the distinct value (all but the largest) with the smallest
Kolmogorov-Smirnov distance; alpha is the approximate maximum-likelihood estimate for discrete data.
Everything is computed from the frequency table, which has one row for each distinct value.

V distinct counts of things of which there are N have V^2 <= 2 N, so a sorted pass over the table and a copy of it in each task are
small (450,000 rows for 10^11 things). The search for the lower bound does not look at the V^2 / 2 pairs of candidates and
values: candidates are dealt out, and a task bounds the distances of its candidates from below by a grid of GRID values. It
takes them in the order of these bounds until they pass the smallest distance that it has found. A
distance is found by halving intervals of values: model and data both fall, so their ends bound the gap inside, and only
intervals that could hold a larger gap than the largest so far are halved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigon import workers

HEAD = 20
GRID = 64
#: Candidates whose bounds a task works out at a time.
BLOCK = 512


def zeta(s: Column, q: Column, unit: Column) -> Column:
    """Hurwitz zeta of (s, q) times unit^s: HEAD terms of the sum and an Euler-Maclaurin tail.

    The scale keeps it from underflowing: with unit <= q all terms are at most 1, and for q = unit the first is 1.
    """
    total = F.lit(0.0)
    for k in range(HEAD):
        total = total + F.pow((q + k) / unit, -s)
    a = q + HEAD
    rest = a / (s - 1) + 0.5 + s / (12 * a) - s * (s + 1) * (s + 2) / (720 * F.pow(a, F.lit(3.0))) + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) / (30240 * F.pow(a, F.lit(5.0)))
    return total + F.pow(a / unit, -s) * rest


def zetas(s: np.ndarray, q: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The same for arrays."""
    total = np.zeros(np.broadcast(s, q, unit).shape)
    for k in range(HEAD):
        total += ((q + k) / unit) ** -s
    a = q + HEAD
    rest = a / (s - 1) + 0.5 + s / (12 * a) - s * (s + 1) * (s + 2) / (720 * a**3) + s * (s + 1) * (s + 2) * (s + 3) * (s + 4) / (30240 * a**5)
    return total + (a / unit) ** -s * rest


def frequencies(counts: DataFrame, column: str = "n") -> DataFrame:
    return counts.filter(F.col(column) >= 1).groupBy(F.col(column).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("c"))


class Tails:
    """Distinct values, rising, with how many things have at least each, and the fits of the tails that begin there."""

    def __init__(self, v: np.ndarray, n: np.ndarray, logs: np.ndarray):
        self.v, self.n = v.astype(float), n.astype(float)
        # ln v > ln (xmin - 1/2) for every v from xmin on, so the sum is above 0
        self.alpha = 1 + self.n / (logs - self.n * np.log(self.v - 0.5))
        self.whole = zetas(self.alpha, self.v, self.v)

    def model(self, candidate, at) -> np.ndarray:
        """Share of the fitted law from the values `at` on."""
        share = zetas(self.alpha[candidate], self.v[at], self.v[candidate]) / self.whole[candidate]
        return np.where(at == candidate, 1.0, share)

    def data(self, candidate, at) -> np.ndarray:
        return self.n[at] / self.n[candidate]

    def bounds(self, candidates: np.ndarray) -> np.ndarray:
        """Distances of the candidates at a grid of values only."""
        grid = np.unique(np.linspace(0, len(self.v) - 1, GRID).astype(np.int64))
        at = np.maximum(grid[None, :], candidates[:, None])
        own = candidates[:, None]
        return np.abs(self.model(own, at) - self.data(own, at)).max(axis=1)

    def distance(self, candidate: int, enough: float = np.inf) -> tuple[float, int]:
        """The candidate's distance, or some gap above `enough`; and how many values were looked at."""
        at = np.unique(np.linspace(candidate, len(self.v) - 1, GRID).astype(np.int64))
        model, looked = self.model(candidate, at), len(at)
        found = float(np.abs(model - self.data(candidate, at)).max())
        a, b, high, low = at[:-1], at[1:], model[:-1], model[1:]
        while True:
            inside = b - a > 1
            # of the values between a and b the model is at most high and at least low, the data between its own ends
            most = np.maximum(high - self.data(candidate, np.maximum(b - 1, 0)), self.data(candidate, np.minimum(a + 1, len(self.v) - 1)) - low)
            open_ = inside & (most > found)
            if found > enough or not open_.any():
                return found, looked
            a, b, high, low = a[open_], b[open_], high[open_], low[open_]
            middle = (a + b) // 2
            share = self.model(candidate, middle)
            looked += len(middle)
            found = max(found, float(np.abs(share - self.data(candidate, middle)).max()))
            a, b, high, low = np.concatenate([a, middle]), np.concatenate([middle, b]), np.concatenate([high, share]), np.concatenate([share, low])


def _tails(table: DataFrame) -> Tails | None:
    """From one sorted pass over the frequency table."""
    falling = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = table.select("v", F.sum("c").over(falling).alias("n"), F.sum(F.col("c") * F.log("v")).over(falling).alias("logs"))
    found = sums.toArrow()
    if not found.num_rows:
        return None
    v, n, logs = (np.asarray(found.column(c)) for c in ("v", "n", "logs"))
    order = np.argsort(v)
    return Tails(v[order], n[order], logs[order])


def _searched(table: DataFrame, only_best: bool) -> DataFrame:
    """xmin, n, alpha, sigma and ks of every candidate, or of the best of each task."""
    spark = table.sparkSession
    workers.send(spark)
    tails = _tails(table)
    most = len(tails.v) - 1 if tails is not None else 0
    shared = spark.sparkContext.broadcast(tails)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        rows: list[tuple[float, int]] = []
        for batch in batches:
            candidates = np.asarray(batch.column(0))
            for i in range(0, len(candidates), BLOCK):
                some = candidates[i : i + BLOCK]
                bounds = own.bounds(some)
                for k in np.lexsort((some, bounds)):
                    enough = rows[0][0] if only_best and rows else np.inf
                    if bounds[k] > enough:
                        break
                    ks, _ = own.distance(int(some[k]), enough)
                    if only_best:
                        rows = [min([*rows, (ks, int(some[k]))])]
                    else:
                        rows.append((ks, int(some[k])))
        if rows:
            at = np.array([k for _, k in rows])
            n, alpha = own.n[at], own.alpha[at]
            columns = [pa.array(own.v[at].astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(alpha), pa.array((alpha - 1) / np.sqrt(n)), pa.array([ks for ks, _ in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["xmin", "n", "alpha", "sigma", "ks"])

    # small candidates have longer tails: they are dealt out evenly
    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, most // 64 + 1))
    return spark.range(most).repartition(parts).mapInArrow(run, "xmin bigint, n bigint, alpha double, sigma double, ks double")


def fits(table: DataFrame, xmin: int | None = None) -> DataFrame:
    """xmin, n, alpha, sigma and ks for the given lower bound, or for every candidate."""
    if xmin is None:
        return _searched(table, only_best=False)
    every = Window.partitionBy()
    tail = table.filter(F.col("v") >= xmin).withColumns({"n": F.sum("c").over(every), "logs": F.sum(F.col("c") * F.log("v")).over(every), "from_here": F.sum("c").over(Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    tail = tail.withColumn("alpha", 1 + F.col("n") / (F.col("logs") - F.col("n") * F.log(F.lit(xmin - 0.5))))
    unit = F.lit(float(xmin))
    model = F.when(F.col("v") == xmin, 1.0).otherwise(zeta(F.col("alpha"), F.col("v").cast("double"), unit) / zeta(F.col("alpha"), unit, unit))
    one = tail.groupBy("n", "alpha").agg(F.max(F.abs(model - F.col("from_here") / F.col("n"))).alias("ks"))
    return one.select(F.lit(xmin).cast("bigint").alias("xmin"), F.col("n").cast("bigint").alias("n"), "alpha", ((F.col("alpha") - 1) / F.sqrt("n")).alias("sigma"), "ks")


def fit(counts: DataFrame, xmin: int | None = None, column: str = "n") -> DataFrame:
    """One row: the fit at xmin, or the best one (ties: the smallest xmin)."""
    table = frequencies(counts, column)
    found = _searched(table, only_best=True) if xmin is None else fits(table, xmin)
    best = F.min_by(F.struct("xmin", "n", "alpha", "sigma", "ks"), F.struct("ks", "xmin")).alias("b")
    return found.agg(best).filter("b is not null").select("b.*")


#: Newton steps of the lognormal fit at most, and where they end.
STEPS = 200
CLOSE = 1e-9


def _log_tail(z: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution's upper tail: by erfc, and far out by the continued fraction of Mills' ratio."""
    out = np.empty_like(z)
    near = z < 4
    out[near] = np.log(0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in z[near]]))
    far = z[~near]
    fraction = far.copy()
    for k in range(60, 0, -1):
        fraction = far + k / fraction
    out[~near] = -far * far / 2 - 0.5 * math.log(2 * math.pi) - np.log(fraction)
    return out


def lognormal_logs(v: np.ndarray, xmin: float, mu: float, sigma: float) -> np.ndarray:
    """Log probability of each whole number v >= xmin: the normal law of ln x between v - 1/2 and v + 1/2, given that it is above xmin - 1/2."""
    low, high = (np.log(v - 0.5) - mu) / sigma, (np.log(v + 0.5) - mu) / sigma
    # on the side where tails are small
    left = low + high < 0
    low, high = np.where(left, -high, low), np.where(left, -low, high)
    a, b = _log_tail(low), _log_tail(high)
    return a + np.log(-np.expm1(b - a)) - _log_tail(np.array([(math.log(xmin - 0.5) - mu) / sigma]))[0]


def lognormal_fit(v: np.ndarray, c: np.ndarray, xmin: float) -> tuple[float, float]:
    """mu and sigma of largest likelihood, by Newton steps on (mu, ln sigma) that are halved until they gain, along the gradient where Newton's do not rise.

    Tails like a power law have no such point: their likelihood goes on rising, ever less, with mu; then the steps end where they gain CLOSE of it.
    """
    share, logs = c / c.sum(), np.log(v)
    mu = float((share * logs).sum())
    at = np.array([mu, 0.5 * math.log(max(float((share * (logs - mu) ** 2).sum()), 1e-4))])

    def value(p: np.ndarray) -> float:
        with np.errstate(all="ignore"):
            found = float((share * lognormal_logs(v, xmin, p[0], math.exp(p[1]))).sum())
        return found if math.isfinite(found) else -math.inf

    best, h = value(at), 1e-4
    for _ in range(STEPS):
        e = np.eye(2) * h
        up, down = [value(at + e[k]) for k in (0, 1)], [value(at - e[k]) for k in (0, 1)]
        slope = np.array([(u - d) / (2 * h) for u, d in zip(up, down)])
        mixed = (value(at + e[0] + e[1]) - value(at + e[0] - e[1]) - value(at - e[0] + e[1]) + value(at - e[0] - e[1])) / (4 * h * h)
        bend = np.array([[(up[0] - 2 * best + down[0]) / h**2, mixed], [mixed, (up[1] - 2 * best + down[1]) / h**2]])
        step = slope
        if np.isfinite(bend).all() and bend[0, 0] < 0 and np.linalg.det(bend) > 0:
            step = -np.linalg.solve(bend, slope)
        step = step / max(1.0, float(np.abs(step).max()))
        while (new := value(at + step)) <= best and np.abs(step).max() > 1e-12:
            step = step / 2
        if new - best <= CLOSE * abs(best):
            break
        at, best = at + step, new
    return float(at[0]), float(math.exp(at[1]))


def vuong(own: np.ndarray, other: np.ndarray, c: np.ndarray) -> tuple[float, float, float]:
    """Log likelihood ratio of two laws, the same over its standard deviation, and the probability of one as far from 0 by chance."""
    n, gap = c.sum(), own - other
    ratio = float((c * gap).sum())
    spread = float((c * (gap - ratio / n) ** 2).sum())
    z = ratio / math.sqrt(spread) if spread > 0 else 0.0
    return ratio, z, math.erfc(abs(z) / math.sqrt(2))


def compared(counts: DataFrame, xmin: int | None = None, column: str = "n") -> DataFrame:
    """alternative, xmin, ratio, z and p: the power law against an exponential and a lognormal law of the same tail.

    ratio > 0 speaks for the power law; p is large where neither is better. Without a fit there are no rows. Everything comes from the
    frequency table of the tail.
    """
    spark = counts.sparkSession
    schema = "alternative string, xmin bigint, ratio double, z double, p double"
    table = frequencies(counts, column)
    best = fit(counts, xmin, column).first()
    if best is None:
        return spark.createDataFrame([], schema)
    tail = table.filter(F.col("v") >= best["xmin"]).orderBy("v").toArrow()
    v, c, low = np.asarray(tail.column("v"), float), np.asarray(tail.column("c"), float), float(best["xmin"])
    own = -best["alpha"] * np.log(v / low) - np.log(zetas(np.array(best["alpha"]), np.array(low), np.array(low)))
    beyond = float((c * (v - low)).sum() / c.sum())
    rate = math.log1p(1 / beyond) if beyond > 0 else 0.0
    exponential = math.log(-math.expm1(-rate)) - rate * (v - low) if beyond > 0 else np.zeros(len(v))  # all values equal: certain
    laws = [("exponential", exponential), ("lognormal", lognormal_logs(v, low, *lognormal_fit(v, c, low)))]
    return spark.createDataFrame([(name, int(low), *vuong(own, logs, c)) for name, logs in laws], schema)
