"""Whitening against a dense eigenvalue decomposition."""

import numpy as np
import pytest

from vicinal.llm import whitening as T

SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def brute(vectors):
    """n, S, variances, components of the distinct whole vectors."""
    x = np.unique([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], axis=0)
    y = x - x.sum(0) / len(x)
    e, v = np.linalg.eigh(y.T @ y / len(x))
    return len(x), x.sum(0), e[::-1], v[:, ::-1]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(24, 24)) * np.geomspace(20, 0.02, 24)
    out = [(i, [float(v) for v in rng.normal(size=24) @ mix], 1, "x") for i in range(400)]
    out += [(i, out[7][1], 1, "x") for i in range(400, 600)] + [(3, out[9][1], 1, "x"), (None, out[9][1], 1, "x")]
    return out


def test_against_eigenvectors(spark, rows):
    bad = [(700, None, 1, "x"), (701, [float("nan")] + [1.0] * 23, 1, "x"), (702, [None] * 24, 1, "x"), (703, [float("inf")] * 24, 1, "x"), (704, [1e30] * 24, 1, "x")]
    lone = [(800, [1.0, 2.0], 1, "x"), (801, [1.0, 2.0], 1, "x"), (802, [], 1, "x")]
    got = T.whitened(spark.createDataFrame(rows + bad + lone, SCHEMA).repartition(5)).toPandas()
    assert len(got) == len(rows) * 16 and set(got["component"]) == set(range(1, 17))
    n, s, e, v = brute([x for _, x, *_ in rows])
    assert set(got["n"]) == {n} and got["identity_error"].max() < 1e-9 and got["identity_error"].nunique() == 1
    for k in range(16):
        assert np.allclose(got.loc[got["component"] == k + 1, "explained"], e[k] / e.sum(), rtol=1e-9)
    signs = {}
    want = {i: np.array([int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in x]) for i, x, *_ in rows if i is not None and i != 3}
    for r in got[got["vec_id"].isin(list(want))].itertuples():
        x, k = want[r.vec_id], r.component - 1
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        y = (x - s / n) @ v[:, k] / np.sqrt(e[k])
        sign = signs.setdefault(k, 1 if y * r.whitened > 0 else -1)
        assert abs(sign * y - r.whitened) < 1e-6
    assert (got["vec_id"] == 3).sum() == 32 and got["vec_id"].isna().sum() == 16


def test_dependent_dimensions_and_empty(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(-50, 50, size=(60, 3))
    x = np.c_[a, a[:, :1], np.full(60, 7)] / 64.0  # a repeated and a constant dimension
    got = T.whitened(spark.createDataFrame([(i, [float(v) for v in r], 0, "") for i, r in enumerate(x)], SCHEMA)).toPandas()
    assert set(got["component"]) == {1, 2, 3} and got["identity_error"].max() < 1e-9
    assert abs(got.groupby("component")["explained"].first().sum() - 1) < 1e-12
    assert T.whitened(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ill_conditioned_factor():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 12)) * np.geomspace(1, 1e-9, 12)
    factors = []
    for _ in range(6):
        y = T.solved(x, factors)
        g = y.T @ y
        if factors and T.settled(g):
            break
        factors.append(T.factor(g, 0 if factors else len(x)))
    assert T.settled(g)
    r = np.eye(12)
    for f in reversed(factors):
        r = r @ f
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(x)[1], rtol=1e-6)


def test_deviations_beyond_a_long():
    x = np.array([[2**45, 0], [1, 1]])
    assert T.deviations(x, 1 << 20, np.array([0, 0], object)).tolist() == [2**63 - 1, 2**41]
