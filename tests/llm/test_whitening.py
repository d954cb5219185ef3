import itertools
import math
from decimal import Decimal, localcontext

import numpy as np
import pytest

from hostwarden.llm import whitening


def plain_charpoly(matrix):
    """Sums of principal minors by Laplace expansion."""

    def det(m):
        return m[0][0] if len(m) == 1 else sum((-1) ** j * m[0][j] * det([r[:j] + r[j + 1 :] for r in m[1:]]) for j in range(len(m)))

    d = len(matrix)
    sums = [sum(det([[matrix[i][j] for j in pick] for i in pick]) for pick in itertools.combinations(range(d), k)) for k in range(1, d + 1)]
    return [(-1) ** (d - k) * s for k, s in zip(range(d), reversed(sums))] + [1]


def plain_whitening(vectors, most):
    """Everything with numpy's own eigenvectors; rows by (position, component)."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    far = fit - s / n
    values, axes = np.linalg.eigh(far.T @ far / n)
    keep = [k for k in np.argsort(-values)[:most] if values[k] > 1e-9 * values.max()]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    return n, deviation, (x - s / n) @ axes[:, keep] / np.sqrt(values[keep]), values[keep] / values.sum()


def test_charpoly_is_exact(spark):
    rng = np.random.default_rng(2)
    for d, big in ((1, 5), (2, 10**12), (5, 40), (6, 10**20)):
        a = [[int(x * big) for x in row] for row in rng.normal(size=(d, d))]
        m = [[sum(a[k][i] * a[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
        assert whitening.characteristic_polynomial(spark, m) == plain_charpoly(m)
    low_rank = [[2 * i * j for j in range(4)] for i in range(4)]
    assert whitening.characteristic_polynomial(spark, low_rank) == [0, 0, 0, -28, 1]
    zero = [[0, 0], [0, 0]]
    assert whitening.characteristic_polynomial(spark, zero) == [0, 0, 1]
    # Zeros under the diagonal and rows that must be swapped; signs as det(t I - m) has them.
    for m in ([[0, 0, 1], [0, 5, 0], [1, 0, 0]], [[1, 0, 2, 0], [0, 1, 0, 2], [2, 0, 1, 0], [0, 2, 0, 1]]):
        want = [c % 1_000_003 for c in plain_charpoly(m)]
        assert whitening.charpoly_mod(m, 1_000_003) == want


def test_roots_are_isolated_with_their_multiplicity():
    def poly(roots):
        out = [1]
        for r in roots:
            out = [a - r * b for a, b in zip([0] + out, out + [0])]
        return out

    roots = [10**15, 10**15 - 1, 7, 7, 7, 3, 1]
    for k, r in enumerate(roots, 1):
        low, places, place, many = whitening.isolate(poly(roots), k)
        assert low < r * 2**places <= low + 1 and low.bit_length() == whitening.ROOT_BITS
        assert (place, many) == ((k - 3, 3) if r == 7 else (0, 1))
    low, places, _, _ = whitening.isolate([2, -6, 1], 2)  # 3 - sqrt(7)
    with localcontext(prec=80):
        assert abs(Decimal(low) / Decimal(2) ** places - (3 - Decimal(7).sqrt())) < Decimal(10) ** -55


def test_components_of_close_and_equal_eigenvalues(spark):
    m = [[10**12, 1, 0, 0], [1, 10**12, 0, 0], [0, 0, 5, 0], [0, 0, 0, 5]]
    found = whitening.principal_components(spark, m)
    half = math.sqrt(0.5)
    assert np.allclose(found[0][1], [half, half, 0, 0], atol=1e-15) and np.allclose(np.abs(found[1][1]), [half, half, 0, 0], atol=1e-15)
    axes = np.array([v for _, v in found])
    assert np.allclose(axes @ axes.T, np.eye(4), atol=1e-15)
    assert [float(r) for r, _ in found] == pytest.approx([10**12 + 1, 10**12 - 1, 5, 5])


def test_exact_product_of_wide_numbers():
    a = np.array([[1 << 61, 3], [-5, 1 << 40], [7, -9]], np.int64)
    assert (whitening.exact_product(a) == a.astype(object).T @ a.astype(object)).all()
    assert whitening.squared_lengths(np.array([[1, 2], [3, 4]], np.int64)).to_pylist() == [5, 25]
    assert whitening.squared_lengths(np.array([[1 << 31, 1], [1 << 40, 0]], object)).to_pylist() == [(1 << 62) + 1, None]


def test_against_numpy(spark):
    rng = np.random.default_rng(5)
    good = [(k, [float(v) for v in rng.normal(size=6) * [9, 5, 3, 1, 0.5, 0.2]]) for k in range(80)]
    good += [(k, good[0][1]) for k in range(100, 140)] + [(0, good[0][1]), (None, good[3][1])]
    bad = [(300, None), (301, []), (302, [1.0] * 5 + [None]), (303, [float("nan")] * 6), (304, [float("-inf")] + [0.0] * 5), (305, [1.0, 2.0]), (306, [1e300] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2, [3]) for i, v in good + bad], "vec_id long, embedding array<double>, n int, component int, x array<int>").repartition(5)
    got = whitening.whiten(df, 4).toPandas()
    n, deviation, whitened, explained = plain_whitening([v for _, v in good], 4)
    assert n == 80 and (got["n"] == n).all() and len(got) == 4 * len(good) and not set(got["vec_id"].dropna()) & {i for i, _ in bad}
    assert sorted(got["deviation"]) == sorted(4 * deviation)
    for k in range(4):
        mine = got[got["component"] == k + 1]
        assert mine["explained"].iat[0] == pytest.approx(explained[k], rel=1e-9)
        by_id = mine.groupby("vec_id")["whitened"].first()
        want = dict(zip((i for i, _ in good), whitened[:, k]))
        sign = np.sign(by_id[5] * want[5])
        assert all(by_id[i] == pytest.approx(sign * want[i], abs=1e-9) for i in by_id.index)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iat[0] < 1e-9
    # The rows themselves: the covariance over the fit list is the identity.
    w = got.dropna(subset="vec_id").drop_duplicates(["deviation", "component"]).pivot(index="deviation", columns="component", values="whitened").to_numpy()
    assert np.allclose(w.T @ w / n, np.eye(4), atol=1e-9)


def test_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [3.0, 3.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["deviation"]) for r in line) == [(1, 1, 2 * 192**2), (2, 1, 0), (3, 1, 2 * 192**2)]
    assert all(r["explained"] == pytest.approx(1, rel=1e-12) and r["identity_error"] < 1e-12 for r in line)
    assert sorted(round(abs(r["whitened"]), 9) for r in line) == [0, round(math.sqrt(1.5), 9), round(math.sqrt(1.5), 9)]


def test_large_entries_stay_exact(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [-(2.0**40), 0.0]), (3, [0.0, 5.0])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    n, deviation, whitened, explained = plain_whitening([v for _, v in rows], 2)
    assert {k[0]: r["deviation"] for k, r in got.items()} == {i: None if d >= 1 << 63 else d for (i, _), d in zip(rows, deviation)}
    assert got[1, 1]["identity_error"] < 1e-9
