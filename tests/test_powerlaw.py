import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigon.operators import powerlaw


def zeta(s, q, terms=200_000):
    return sum((q + k) ** -s for k in range(terms)) + (q + terms) ** (1 - s) / (s - 1) + 0.5 * (q + terms) ** -s


def brute(values, xmin):
    tail = sorted(v for v in values if v >= xmin)
    n = len(tail)
    alpha = 1 + n / sum(math.log(v / (xmin - 0.5)) for v in tail)
    whole = zeta(alpha, xmin)
    ks = max(abs(sum(x < v for x in tail) / n - (1 - zeta(alpha, v) / whole)) for v in set(tail))
    return n, alpha, (alpha - 1) / math.sqrt(n), ks


@pytest.mark.parametrize("xmin", [1, 2, None])
def test_against_the_definitions(spark, xmin):
    values = [1] * 60 + [2] * 25 + [3] * 11 + [4] * 9 + [6] * 4 + [9] * 3 + [15] * 2 + [40]
    got = powerlaw.fit(spark.createDataFrame([(v,) for v in values], "n bigint"), xmin).first()
    best = xmin if xmin else min(sorted(set(values))[:-1], key=lambda x: (round(brute(values, x)[3], 12), x))
    assert got.xmin == best
    assert (got.n, got.alpha, got.sigma, got.ks) == pytest.approx(brute(values, best), abs=1e-8)


def test_nothing_to_fit(spark):
    assert powerlaw.fit(spark.createDataFrame([(3,)], "n bigint")).count() == 0
    assert powerlaw.fit(spark.createDataFrame([], "n bigint")).count() == 0


def test_large_narrow_counts(spark):
    """alpha is large here, so that powers of the counts themselves underflow."""
    values = [1000] * 100 + [1001] + [998] * 3 + [1002, 1003, 1010]
    got = powerlaw.fits(powerlaw.frequencies(spark.createDataFrame([(v,) for v in values], "n bigint"))).collect()
    assert sorted(r.xmin for r in got) == [998, 1000, 1001, 1002, 1003]

    def ratio(s, v, xmin):
        return sum(((v + k) / xmin) ** -s for k in range(100_000)) / sum(((xmin + k) / xmin) ** -s for k in range(100_000))

    for r in got:
        tail = [v for v in values if v >= r.xmin]
        alpha = 1 + len(tail) / sum(math.log(v / (r.xmin - 0.5)) for v in tail)
        ks = max(abs(sum(x >= v for x in tail) / len(tail) - ratio(alpha, v, r.xmin)) for v in set(tail))
        assert (r.n, r.alpha, r.ks) == pytest.approx((len(tail), alpha, ks), rel=1e-6)


def power_law(rng, n, alpha=2.3, most=10**6):
    return [min(most, int(rng.random() ** (-1 / (alpha - 1)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_finds_what_all_pairs_find(spark, seed):
    """Bounds drop no candidate that is best, and halved intervals miss no gap."""
    rng = random.Random(seed)
    values = power_law(rng, 20_000) + [rng.randrange(50, 400) for _ in range(300 * seed)]
    table = powerlaw.frequencies(spark.createDataFrame([(v,) for v in values], "n bigint"))
    tails = powerlaw._tails(table)
    every = np.arange(len(tails.v))
    exact = []
    for k in every[:-1]:
        gap = np.abs(tails.model(k, every[k:]) - tails.data(k, every[k:])).max()
        found, looked = tails.distance(int(k))
        assert found == pytest.approx(gap, abs=1e-12) and tails.bounds(np.array([k]))[0] <= gap + 1e-12
        exact.append((gap, k))
    best = min(exact)[1]
    got = powerlaw.fit(spark.createDataFrame([(v,) for v in values], "n bigint")).first()
    assert got.xmin == tails.v[best] and got.ks == pytest.approx(min(exact)[0], abs=1e-12)


def test_very_many_distinct_counts(spark):
    table = spark.range(1, 100_001).select(F.col("id").alias("v"), F.greatest(F.lit(1), (1e9 / F.pow("id", F.lit(2.0))).cast("bigint")).alias("c"))
    tails = powerlaw._tails(table)
    began = time.perf_counter()
    found = powerlaw._searched(table, only_best=True).collect()
    assert time.perf_counter() - began < 60
    best = min(found, key=lambda r: (r.ks, r.xmin))
    at = int(np.searchsorted(tails.v, best.xmin))
    assert best.ks == pytest.approx(np.abs(tails.model(at, np.arange(at, 100_000)) - tails.data(at, np.arange(at, 100_000))).max(), abs=1e-12)
    assert (tails.bounds(np.arange(0, 99_999, 97)) >= 0).all() and tails.distance(at)[1] < 100_000


def test_no_pairs_in_the_plan(spark):
    counts = spark.createDataFrame([(v,) for v in [1] * 60 + [2] * 25 + [3] * 11 + [9]], "n bigint")
    for xmin in (None, 2):
        plan = powerlaw.fit(counts, xmin)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan


def normal_between(a, b):
    """Probability of the standard normal law between a and b, by fine steps."""
    x = np.linspace(a, b, 200_001)
    y = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return float((y[1:] + y[:-1]).sum() / 2 * (x[1] - x[0]))


def test_lognormal_probabilities():
    for mu, sigma, xmin in ((1.0, 0.8, 1), (3.0, 0.5, 5), (-2.0, 2.0, 3)):
        v = np.array([xmin, xmin + 1, xmin + 7, xmin + 60], float)
        z = lambda x: (math.log(x) - mu) / sigma  # noqa: B023, E731
        whole = normal_between(z(xmin - 0.5), z(xmin - 0.5) + 30)
        want = [math.log(normal_between(z(x - 0.5), z(x + 0.5)) / whole) for x in v]
        assert powerlaw.lognormal_logs(v, xmin, mu, sigma) == pytest.approx(want, abs=1e-5)
        every = np.arange(xmin, 400_000, dtype=float)
        assert np.exp(powerlaw.lognormal_logs(every, xmin, mu, sigma)).sum() == pytest.approx(1, abs=1e-3)
    far = powerlaw._log_tail(np.array([3.999999, 4.0, 4.000001, 50.0]))
    assert far[0] > far[1] > far[2] and abs(far[0] - far[2]) < 1e-4 and far[3] == pytest.approx(-1254.8313611, abs=1e-6)


def test_lognormal_fit_is_the_best_of_a_grid():
    rng = random.Random(3)
    values = [v for v in (round(math.exp(rng.gauss(2.5, 0.7))) for _ in range(4000)) if v >= 4]
    v, c = np.unique(values, return_counts=True)
    mu, sigma = powerlaw.lognormal_fit(v.astype(float), c.astype(float), 4)
    assert abs(mu - 2.5) < 0.1 and abs(sigma - 0.7) < 0.07
    found = (c * powerlaw.lognormal_logs(v.astype(float), 4, mu, sigma)).sum()
    for dm in (-0.05, -0.01, -0.001, 0, 0.001, 0.01, 0.05):
        for ds in (-0.05, -0.01, -0.001, 0, 0.001, 0.01, 0.05):
            assert (c * powerlaw.lognormal_logs(v.astype(float), 4, mu + dm, sigma + ds)).sum() <= found + 1e-6


def test_which_law_is_better(spark):
    rng = random.Random(9)

    def rows(values, xmin):
        return {r.alternative: r for r in powerlaw.compared(spark.createDataFrame([(v,) for v in values], "n bigint"), xmin).collect()}

    power = rows(power_law(rng, 5000), 1)
    assert power["exponential"].ratio > 0 and power["exponential"].p < 1e-3
    short = rows([1 + int(rng.expovariate(0.15)) for _ in range(5000)], 1)
    assert short["exponential"].ratio < 0 and short["exponential"].p < 1e-3 and short["lognormal"].ratio < 0
    normal = rows([max(1, round(math.exp(rng.gauss(3, 0.5)))) for _ in range(5000)], 1)
    assert normal["lognormal"].ratio < 0 and normal["lognormal"].p < 1e-3
    # ratio, z and p by their definitions
    values = [1] * 60 + [2] * 25 + [3] * 11 + [9]
    got = rows(values, 1)["exponential"]
    n, alpha, _, _ = brute(values, 1)
    rate = math.log(1 + n / sum(v - 1 for v in values))
    gaps = [-alpha * math.log(v) - math.log(zeta(alpha, 1)) - (math.log(1 - math.exp(-rate)) - rate * (v - 1)) for v in values]
    mean = sum(gaps) / n
    spread = math.sqrt(sum((g - mean) ** 2 for g in gaps))
    assert (got.ratio, got.z, got.p) == pytest.approx((sum(gaps), sum(gaps) / spread, math.erfc(abs(sum(gaps)) / spread / math.sqrt(2))), rel=1e-6)
    assert powerlaw.compared(spark.createDataFrame([(3,)], "n bigint")).count() == 0
    assert set(rows([2, 2, 2, 2], 2)) == {"exponential", "lognormal"}
