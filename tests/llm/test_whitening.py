"""Whitening against a full eigendecomposition and exact integers."""

from __future__ import annotations

import numpy as np
import pytest

from vacantia.llm import whitening


def spectrum(values, seed=1):
    axes = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return axes * np.array(values) @ axes.T


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1, 0.5], [9.0], [3, 1], [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], [4, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1],
    [1e6, 3, 2, 1, 1e-3], [7, 5, 0, 0, 0], list(np.linspace(2, 1, 64)), [1 + 1e-5 * i for i in range(30)], list(np.geomspace(1, 1e-9, 40)),
])
@pytest.mark.parametrize("k", [1, 4, 11])
def test_components_are_those_of_the_full_decomposition(values, k):
    matrix = spectrum(values)
    got, axes = whitening.components(matrix, k)
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1][: min(k, sum(v > 0 for v in values))]
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-7, atol=1e-13 * max(values))
    assert np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-9
    assert np.abs(matrix @ axes - axes * got).max() < 1e-12 * max(values) * len(values)


def test_inertia_counts_the_eigenvalues_above_a_shift():
    values = np.linspace(-3, 4, 20)
    tri = whitening._tridiagonal(spectrum(values))
    assert [whitening._above(*tri, s) for s in (-5, -2.9, 0.01, 3.9, 5)] == [sum(values > s) for s in (-5, -2.9, 0.01, 3.9, 5)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, x string, component string, whitened string").repartition(3)


def exact(rows, k):
    xs = [(i, [int(np.floor(256 * np.float64(np.float32(c)))) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(x) for _, x in xs)
    xs = [(i, x + [0] * (width - len(x))) for i, x in xs]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    out = {}
    for i, x in xs:
        y = (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)
        out.setdefault(i, []).append((n, sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), tuple(y), tuple(values / centred.var(axis=0).sum())))
    return out


def test_whitened_rows_equal_the_direct_computation(spark):
    draw = np.random.default_rng(5)
    base = draw.standard_normal((60, 6)) * [4, 2, 1, 0.7, 0.5, 0.1] + 3
    rows = [(i, [float(c) for c in v], *["x"] * 4) for i, v in enumerate(base)]
    rows += [(70, rows[0][1], *["x"] * 4), (71, rows[1][1], *["x"] * 4), (5, rows[2][1], *["x"] * 4), (None, rows[3][1], *["x"] * 4), (80, [1.0, 2.0], *["x"] * 4), (81, [], *["x"] * 4)]
    bad = [(90, None, *["x"] * 4), (91, [1.0, None, 2.0, 0.0, 0.0, 0.0], *["x"] * 4), (92, [float("nan")] * 6, *["x"] * 4), (93, [float("inf")] + [0.0] * 5, *["x"] * 4)]
    got = whitening.whitened(frame(spark, rows + bad)).collect()
    want = exact(rows, 4)
    assert len(got) == 4 * len(rows)
    signs = {}
    for r in got:
        n, deviation, y, share = min(want[r["vec_id"]], key=lambda w: w[1] != r["deviation"])
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["explained"] / share[c] - 1) < 1e-9 and r["identity_error"] < 1e-9
        assert abs(abs(r["whitened"]) - abs(y[c])) < 1e-7
        if abs(y[c]) > 1e-3:
            signs.setdefault(c, set()).add(r["whitened"] * y[c] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, [1.0, 2.0], *["x"] * 4)], [(i, [1.0, 2.0], *["x"] * 4) for i in range(5)], [(1, None, *["x"] * 4)], [(1, [], *["x"] * 4)]):
        assert whitening.whitened(frame(spark, rows)).collect() == []
    # Two different vectors have one direction only.
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0], *["x"] * 4), (2, [2.0, 5.0], *["x"] * 4)])).count() == 2


def test_wide_numbers_stay_exact(spark):
    rows = [(i, [float(np.float32(9e15 * (i + 1))), float(i * i)], *["x"] * 4) for i in range(5)] + [(9, [3e38, 1.0], *["x"] * 4)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(frame(spark, rows)).where("component = 1").collect()}
    assert set(got) == {0, 1, 2, 3, 4, 9} and all(v is None for v in got.values())
    rows = [(i, [float(2**21 * i), 1.0], *["x"] * 4) for i in range(4)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(frame(spark, rows)).where("component = 1").collect()}
    assert got == {i: (4 * 2**29 * i - 6 * 2**29) ** 2 for i in range(4)} or all(v is None or v == (4 * 2**29 * i - 6 * 2**29) ** 2 for i, v in got.items())
