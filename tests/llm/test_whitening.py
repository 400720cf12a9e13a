import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from linecensus.llm import whitening
from linecensus.llm.whitening import op13_embedding_whitening, whiten

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(rows, count=16):
    """Rows `{(vec_id, place): (n, deviation, explained, whitened up to sign)}` by an eigendecomposition."""
    kept = [
        (i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v))
        for i, v in rows
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = np.array(sorted({x for _, x in kept}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov((fit - sums / n).T, bias=True).reshape(fit.shape[1], -1))
    order = np.argsort(-values)
    values, vectors = values[order], vectors[:, order]
    found = []
    for i, x in kept:
        deviation = sum(int(n * a - s) ** 2 for a, s in zip(x, sums))
        projected = (np.array(x) - sums / n) @ vectors[:, :count] / np.sqrt(values[:count])
        found += [(i, k + 1, n, deviation, projected[k], values[k] / values.sum()) for k in range(count)]
    return found


def assert_same(result, expected):
    rows = sorted((tuple(r) for r in result.select(*COLUMNS).collect()), key=lambda r: (r[0], r[3], r[1]))
    expected = sorted(expected, key=lambda r: (r[0], r[3], r[1]))
    assert [r[:4] for r in rows] == [r[:4] for r in expected]
    np.testing.assert_allclose([r[5] for r in rows], [r[5] for r in expected], rtol=1e-7)
    assert len({r[6] for r in rows}) == 1 and rows[0][6] < 1e-8
    signs = {}
    for got, want in zip(rows, expected):
        if abs(want[4]) > 1e-3:
            sign = signs.setdefault(got[1], math.copysign(1, got[4] * want[4]))
            assert got[4] * sign == pytest.approx(want[4], rel=1e-6, abs=1e-7)


def test_registered_query_against_eigendecomposition(spark):
    data = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert_same(op13_embedding_whitening(spark, data), brute(rows))


def test_ill_conditioned_and_awkward_rows(spark):
    chance = np.random.default_rng(3)
    base = chance.normal(size=(300, 5)) * [1000.0, 30.0, 1.0, 0.2, 0.05]
    mixed = base @ np.linalg.qr(chance.normal(size=(5, 5)))[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed)]
    rows += [(7, rows[7][1]), (900, rows[7][1])] * 40
    rows += [(901, None), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [1.0, math.nan, 2.0, 3.0, 4.0])]
    rows += [(904, [1.0, math.inf, 2.0, 3.0, 4.0]), (905, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    frame = frame.selectExpr("*", "'x' AS x", "1 AS component", "'n' AS n").repartition(7)
    assert_same(whiten(frame), brute(rows, 5))


def test_directions_without_variance_are_left_out(spark):
    chance = np.random.default_rng(4)
    plane = chance.integers(-400, 400, size=(200, 2))
    rows = [(i, [float(a), float(b), float(a + b), 5.0]) for i, (a, b) in enumerate(plane)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = whiten(frame).collect()
    assert {r["component"] for r in found} == {1, 2}
    assert found[0]["identity_error"] < 1e-9
    assert sum({r["component"]: r["explained"] for r in found}.values()) == pytest.approx(1)


def test_no_component(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        result = whiten(spark.createDataFrame(rows, schema))
        assert result.columns == COLUMNS and result.count() == 0


def test_null_identifiers_and_other_lengths(spark):
    rows = [(None, [1.0, 2.0]), (None, [3.0, 2.5]), (3, [0.0, 9.0]), (4, [0.0, 9.0, 1.0])]
    found = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == [(0, 1), (0, 1), (0, 2), (0, 2), (3, 1), (3, 2)]


def test_deviation_beyond_a_long_is_null():
    assert whitening._squares(np.array([[2**32, 1], [3, 4]])) == [None, 25]
    assert whitening._squares(np.array([[2**31, 2**31], [2**31, 2**31 - 1]])) == [None, 2**62 + (2**31 - 1) ** 2]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 12), st.integers(0, 2**32 - 1))
def test_triangular_solve(size, seed):
    chance = np.random.default_rng(seed)
    factor = np.triu(chance.normal(size=(size, size))) + 3 * np.eye(size)
    rows = chance.normal(size=(9, size))
    np.testing.assert_allclose(whitening.solved(rows @ factor, factor), rows, atol=1e-8)
