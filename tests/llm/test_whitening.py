import math

import numpy as np
import pytest

from equiflow.llm import whitening as W
from tests.conftest import SF_CHECK

SCHEMA = "vec_id long, embedding array<float>, label int, X string"


def brute(rows, components=16):
    """Rows by (id, component) as the contract states them, from numpy's own eigenvectors."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in good]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = ((fit * n - s).astype(float)) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (i, _), row in zip(good, x):
        away = [n * a - b for a, b in zip(row, s)]
        for k in range(min(components, len(values))):
            if values[k] > 1e-9 * values[0]:
                out.setdefault(i, []).append((k + 1, n, sum(a * a for a in away), float(np.array(away, float) / n @ vectors[:, k] / math.sqrt(values[k])), values[k] / values.sum()))
    return out


def held(got, want):
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append((r.component, r.n, r.deviation, r.whitened, r.explained))
        assert r.identity_error <= 1e-4
    assert by.keys() == want.keys()
    sign = {}
    for i, rows in by.items():
        assert len(rows) == len(want[i])
        for a, b in zip(sorted(rows), want[i]):
            assert a[:3] == b[:3] and abs(a[4] - b[4]) <= 1e-9
            if abs(b[3]) > 1e-6:
                assert sign.setdefault(a[0], math.copysign(1, a[3] * b[3])) == math.copysign(1, a[3] * b[3])
            assert abs(abs(a[3]) - abs(b[3])) <= 1e-9 * max(1, abs(b[3]))


def test_whole_table_against_numpy(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").collect()]
    held(W.op11_whitening(spark, SF_CHECK).collect(), brute(rows))


def test_nulls_copies_clashing_names_and_odd_lengths(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(c) for c in r.normal(size=5)], 1, "x") for k in range(60)]
    rows += [(100 + k, rows[0][1], None, None) for k in range(30)]  # copies count once in the fit
    odd = [(200, None, 0, ""), (201, [1.0, None, 2.0, 0.0, 1.0], 0, ""), (202, [float("nan")] * 5, 0, ""), (203, [float("inf")] * 5, 0, ""), (204, [], 0, ""), (205, [1.0, 2.0], 0, ""), (206, [1e30] * 5, 0, "")]
    got = W.whiten(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    held(got, brute([(a, b) for a, b, *_ in rows]))


def test_repeated_and_null_ids_come_back_row_by_row(spark):
    rows = [(None, [1.0, 0.0], 0, ""), (1, [0.0, 2.0], 0, ""), (1, [0.0, 2.0], 0, ""), (2, [3.0, 1.0], 0, "")]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 2, 1), (False, 2, 2), (True, 0, 1), (True, 0, 2)]
    assert {r.n for r in got} == {3}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0, "")], [(1, [0.5, 0.5], 0, ""), (2, [0.5, 0.5], 0, "")], [(1, None, 0, "")]])
def test_nothing_to_whiten(spark, rows):
    got = W.whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not got.count()


def test_dimensions_without_variance_give_no_component(spark):
    rows = [(k, [float(k), 7.0, 2.0 * k], 0, "") for k in range(9)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1} and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_large_deviations_are_exact_or_null():
    x, sums = np.array([[2**45, 5], [3, 4]], dtype=np.int64), (2**45 + 3, 9)
    assert W._deviations(x, 2, sums) == [None, None]
    x = np.array([[3 * 10**9, 5], [0, 4]], dtype=np.int64)
    assert W._deviations(x, 2, (3 * 10**9, 9)) == [9 * 10**18 + 1, 9 * 10**18 + 1]


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1], [1.0] * 6, [3, 3, 3, 1, 1, 0], [1e8, 1, 1, 1e-3, 0, 0, 0], list(np.linspace(1, 1.0001, 40)), [2.0, 2.0 + 1e-13, 1.0], [1e-20, 2e-20], [0, 0, 0], [7], [-3, -1, 0, 2, 9]])
def test_spectral_split_on_hard_spectra(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(len(values), len(values))))
    a = q * np.array(values, float) @ q.T
    a = (a + a.T) / 2
    e, v = W.spectral_split(a)
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(np.sort(e) - np.sort(values)).max() <= 1e-13 * size * len(values)
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ v - v * e).max() <= 1e-12 * size * len(values)
    assert list(e) == sorted(e, reverse=True) or np.abs(np.diff(np.sort(e))).min() < 1e-12 * size
