import math
from collections import defaultdict

import numpy as np
import pytest

from perigon.llm import queries, whitening as wh


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, "x") for k, v in vectors], "vec_id bigint, embedding array<float>, n string")


def brute(vectors, components=32):
    """n, exact deviations, eigenvalues and -vectors, trace and centred rows, from whole matrices."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    scaled = [[n * a - s for a, s in zip(row, sums)] for row in x]
    centred = np.array(scaled, dtype=object) / n
    centred = centred.astype(float)
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    return n, [sum(v * v for v in row) for row in scaled], value[::-1][:components], vector[:, ::-1][:, :components], value.sum(), centred


def gathered(df):
    rows = defaultdict(dict)
    for r in df.collect():
        rows[r.vec_id, r.deviation].setdefault(r.component, []).append(r)
    return rows


def compare(spark, vectors, components):
    n, deviations, value, vector, trace, centred = brute(vectors, components)
    got = wh.whitened(spark, frame(spark, vectors).repartition(3), components=components).collect()
    assert len(got) == n * components and {r.n for r in got} == {n}
    by = defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
    z = np.array([[by[k][c + 1].whitened for c in range(components)] for k, _ in vectors])
    want = centred @ vector / np.sqrt(value)
    sign = np.sign((z * want).sum(axis=0))
    assert np.abs(z * sign - want).max() < 1e-7
    assert [by[k][1].deviation for k, _ in vectors] == deviations
    assert np.allclose([by[vectors[0][0]][c + 1].explained for c in range(components)], value / trace, rtol=1e-9)
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert np.abs(z.T @ z / n - np.eye(components)).max() < 1e-9


def test_against_dense_eigenvectors(spark):
    rng = np.random.default_rng(3)
    spread = np.linspace(3, 0.5, 12)
    vectors = [(k, (rng.standard_normal(12) * spread + 5).tolist()) for k in range(400)]
    compare(spark, vectors, 7)


def test_many_dimensions_take_rounds_and_are_certified(spark):
    rng = np.random.default_rng(5)
    d, k = 200, 6
    turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
    data = rng.standard_normal((900, d)) * (8 * 0.97 ** np.arange(d)) @ turn
    vectors = [(i, v.tolist()) for i, v in enumerate(data)]
    fit = wh.whole_numbers(frame(spark, vectors), "vec_id", "embedding")
    model = wh.fitted(fit, k)
    assert model.rounds > 3 and (model.residuals <= 1e-9 * model.values[0]).all()
    compare(spark, vectors, k)


def test_rows_that_are_dropped_and_repeated(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.standard_normal(5).tolist()) for k in range(50)]
    odd = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [3e38, 0.0, 0.0, 0.0, 0.0])]
    got = wh.whitened(spark, frame(spark, good + odd + [(None, good[3][1]), good[3], good[3]])).collect()
    assert {r.vec_id for r in got} == {k for k, _ in good} | {None} and {r.n for r in got} == {53} and len(got) == 53 * 5
    third = [(r.component, r.whitened) for r in got if r.vec_id == 3]
    assert len(third) == 15 and len(set(third)) == 5


def test_nothing_to_whiten(spark):
    assert wh.whitened(spark, frame(spark, [(1, None)])).count() == 0
    assert wh.whitened(spark, frame(spark, [])).count() == 0
    assert wh.whitened(spark, frame(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).count() == 0


def test_fewer_components_than_dimensions(spark):
    rng = np.random.default_rng(8)
    vectors = [(k, [a, b, a, b, 1.0]) for k, (a, b) in enumerate(rng.integers(-90, 90, (60, 2)).tolist())]
    vectors = [(k, [float(c) for c in v]) for k, v in vectors]
    got = wh.whitened(spark, frame(spark, vectors)).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize("size", [1, 1 << 20, 1 << 40])
def test_centring_is_exact_for_large_numbers(size):
    rng = np.random.default_rng(4)
    x = rng.integers(-size, size + 1, (30, 3)) + (size << 4)
    total = [sum(c) for c in x.T.tolist()]
    centre = wh.Centre(30, total)
    scaled = [[30 * a - s for a, s in zip(row, total)] for row in x.tolist()]
    assert centre.scaled(x).tolist() == scaled
    want = [sum(v * v for v in row) for row in scaled]
    assert centre.deviations(x) == [v if v < 1 << 63 else None for v in want]


def test_query_on_the_whole_table(spark):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    table = pq.read_table(f"{sf}/embeddings.parquet").to_pydict()
    vectors = list(zip(table["vec_id"], table["embedding"]))
    n, deviations, value, vector, trace, _ = brute(vectors)
    got = queries.QUERIES["op13_whitening"](spark, sf).collect()
    assert len(got) == 32 * n
    first = {r.vec_id: r for r in got if r.component == 1}
    assert [first[k].deviation for k, _ in vectors] == deviations and abs(first[vectors[0][0]].explained - value[0] / trace) < 1e-9
