import math

import numpy as np
import pytest

from cuemill.llm import whitening as w


def scatter(x):
    c = x - x.mean(0)
    return c.T @ c


@pytest.mark.parametrize("width", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["plain", "copies", "flat", "grid"])
def test_incremental_spectrum(width, kind):
    """Rank-one updates and merged spectra give the scatter matrix, also with copies, constant entries and equal eigenvalues."""
    rng = np.random.default_rng(width)
    x = np.floor(rng.normal(size=(120, width)) * 20)
    if kind == "copies":
        x[::2] = x[0]
    if kind == "flat":
        x[:, : width // 2 + 1] = 3
    if kind == "grid":
        x = np.concatenate([np.eye(width), -np.eye(width)] * 3)
    whole = w.Spectrum.unpack(w.task_spectrum(iter([x[:50].astype(int), x[50:].astype(int)])))
    merged = w.Spectrum.unpack(w.merge_spectra([w.task_spectrum(iter([part.astype(int)])) for part in np.array_split(x, 5)]))
    want = scatter(x)
    size = max(want.max(), 1)
    for s in (whole, merged):
        assert s.count == len(x) and np.allclose(s.mean, x.mean(0), atol=1e-12)
        assert np.abs(s.vectors * s.values @ s.vectors.T - want).max() < 1e-11 * size
        assert np.abs(s.vectors.T @ s.vectors - np.eye(width)).max() < 1e-12


def test_secular_roots():
    poles, weights = np.array([0.0, 1e-9, 1.0, 1.5, 100.0]), np.array([1.0, 1e-12, 0.3, 2.0, 1e-3])
    roots, apart = w.secular_roots(poles, weights, 0.7)
    want = np.linalg.eigvalsh(np.diag(poles) + 0.7 * np.outer(np.sqrt(weights), np.sqrt(weights)))
    assert np.allclose(roots, want, rtol=1e-12, atol=1e-14)
    assert (apart[np.arange(5), np.arange(5)] > 0).all()


def rows_of(spark, vectors, parts=5):
    data = [(i, v, "x") for i, v in enumerate(vectors)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, _x string").repartition(parts)


def test_matches_numpy(spark):
    rng = np.random.default_rng(1)
    width, n = 40, 400
    turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
    vectors = (rng.normal(size=(n, width)) * np.linspace(1, 5, width) @ turn).astype(np.float32)
    vectors[::4] = vectors[1]
    given = [list(map(float, v)) for v in vectors]
    odd = [None, [None] + given[0][1:], [math.nan] + given[0][1:], [math.inf] + given[0][1:], [1e30] + given[0][1:], [1.0, 2.0], []]
    found = w.whitened_rows(rows_of(spark, given + odd)).collect()
    assert len(found) == n * 32 and {r.n for r in found} == {n}
    x = np.floor(np.array(given) * 64).astype(int) + 1_000_000
    exact = ((n * x.astype(object) - x.sum(0).astype(object)) ** 2).sum(1)
    values, components = np.linalg.eigh(scatter(x) / n)
    values, components = values[::-1], components[:, ::-1]
    want = (x - x.mean(0)) @ components / np.sqrt(values)
    got = np.full((n, 32), np.nan)
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == exact[r.vec_id]
        assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-10)
    sign = np.sign((got * want[:, :32]).sum(0))
    assert np.abs(got * sign - want[:, :32]).max() < 1e-8
    error = {r.identity_error for r in found}
    assert len(error) == 1 and math.isclose(error.pop(), np.abs(got.T @ got / n - np.eye(32)).max(), abs_tol=1e-13)


def test_exact_deviations_beyond_a_long():
    model = w.Whitening(10**6, [5 * 10**12, -3], np.ones(2), np.eye(2), 2.0)
    x = np.array([[5 * 10**6, 0], [5 * 10**6 + 1000, 0], [0, 0]])
    assert model.deviations(x) == [9, 10**18 + 9, None]


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0]], [[1.0, 2.0, 3.0]] * 9])
def test_no_variance(spark, vectors):
    found = w.whitened_rows(rows_of(spark, vectors, 2)).collect()
    assert len(found) == 3 * len(vectors)
    assert all((r.whitened, r.explained, r.identity_error, r.deviation) == (None, None, None, 0) for r in found)


def test_fewer_vectors_than_entries(spark):
    """Components beyond the rank are null and do not count for the error."""
    found = w.whitened_rows(rows_of(spark, [[0.0, 1.0, 0.0, 5.0], [2.0, 1.0, 0.0, 1.0]], 2)).collect()
    assert [r.whitened is None for r in sorted(found, key=lambda r: (r.vec_id, r.component))] == [False, True, True, True] * 2
    assert {round(abs(r.whitened), 12) for r in found if r.component == 1} == {1.0} and found[0].identity_error < 1e-12


@pytest.mark.parametrize("vectors", [[], [None], [[]]])
def test_nothing_usable(spark, vectors):
    found = w.whitened_rows(rows_of(spark, vectors, 1))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.collect() == []
