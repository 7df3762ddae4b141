"""Top-k search and near duplicates of vectors, against brute force."""

import math

import numpy as np
import pytest

from vicinal.llm import neardup, search
from vicinal.llm.graph import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(300):
        x = base[i % 12] + rng.normal(size=16) * (0.02 if i < 150 else 0.6)
        rows.append((i, [float(np.float32(v)) for v in x], int(i % 3), "x"))
    rows += [(400, None, 1, "x"), (450, [0.0] * 16, 1, "x"), (500, [float("nan")] + [1.0] * 15, 1, "x"), (550, [None] + [1.0] * 15, 1, "x"), (551, [float("inf")] * 16, 1, "x")]
    rows += [(552, rows[3][1], None, "x"), (553, rows[3][1], 0, "x"), (553, rows[3][1], 0, "x"), (600, [1.0, 2.0], 0, "x"), (601, [1.0, 2.0], 0, "x"), (None, rows[3][1], 0, "x")]
    return rows


def test_top_k(spark, vectors):
    got = {}
    for r in search.top_k(spark.createDataFrame(vectors, SCHEMA)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], -r["score"], r["vec_id"]))
    ok = [(i, [int(np.floor(256 * v)) for v in x]) for i, x, *_ in vectors if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    for q in {i for i, _ in ok if i % 50 == 0}:
        v = next(x for i, x in ok if i == q)
        want = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in ok if i != q and len(x) == len(v))[:5]
        assert [x[1:] for x in sorted(got.get(q, []))] == want
    assert search.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_components_stay_exact():
    q, c = np.array([[2.0**30, 3.0]]), np.array([[2.0**30, 1.0], [2.0**30, 2.0], [1.0, 1.0]])
    assert search.best(q, np.array([0]), c, np.array([1, 2, 3]), 2) == [(0, 2, 2**60 + 6), (0, 1, 2**60 + 3)]


def test_near_duplicates(spark, vectors):
    got = neardup.near_duplicates(spark.createDataFrame(vectors, SCHEMA)).collect()
    assert len(got) == len(vectors)
    links = [0] * len(vectors)
    root = list(range(len(vectors)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [x is not None and all(v is not None and np.isfinite(v) for v in x) and any(x) and lab is not None and i is not None for i, x, lab, _ in vectors]
    for a in range(len(vectors)):
        for b in range(a):
            (_, x, la, _), (_, y, lb, _) = vectors[a], vectors[b]
            if good[a] and good[b] and la == lb and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    group = {}
    for a, (i, *_) in enumerate(vectors):
        group.setdefault(find(a), []).append(-1 if i is None else i)
    want = sorted((-1 if i is None else i, links[a], min(group[find(a)])) for a, (i, *_) in enumerate(vectors))
    have = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"]) for r in got)
    assert have == want  # full recall here; none is false
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_links_beside_a_large_group(spark):
    """Nearly all links are copies: the pairs near the threshold are found all the same."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(3000, 64)))
    a = x[:60]
    y = rng.normal(size=a.shape)
    b = 0.935 * a + np.sqrt(1 - 0.935**2) * unit(y - (y * a).sum(1, keepdims=True) * a)
    rows = [(i, [float(v) for v in r], 0, "x") for i, r in enumerate([*x, *b, *[x[2999]] * 6000])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(60)] == [got[3000 + i] for i in range(60)] == [(1, i) for i in range(60)]
    assert all(got[i] == (0, i) for i in range(60, 2999))
    assert all(got[i] == (6000, 2999) for i in range(3060, 9060))


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    seen: dict[int, set] = {}
    for a, b in links:
        if a != b:
            both = seen.get(a, {a}) | seen.get(b, {b})
            for x in both:
                seen[x] = both
    assert got == {x: min(s) for x, s in seen.items()}


@pytest.mark.parametrize("largest", [0.9, 4e8, 3e38])
def test_top_k_of_any_finite_floats(spark, monkeypatch, largest):
    """Scores in unbounded integers, in many blocks; beyond a long the nearest long, in the exact order."""
    import random

    r = random.Random(5)
    monkeypatch.setattr(search, "CANDIDATES", 16)
    monkeypatch.setattr(search, "QUERIES", 2)
    f = lambda x: float(np.float32(x))
    vectors = {i: [f(r.uniform(-1, 1) * (largest if r.random() < 0.2 else 1)) for _ in range(9)] for i in range(70)}
    vectors |= {70: vectors[3], 71: vectors[3], 100: vectors[0], 150: [0.0] * 9}
    rows = [*vectors.items(), (200, None), (201, [1.0, None] + [0.0] * 7), (202, [float("nan")] * 9), (203, [float("inf")] * 9)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in search.top_k(df).collect()}
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors.items()}
    want = {}
    for q in (0, 50, 100, 150):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, k + 1): (i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, i) in enumerate(scores)}
    assert got == want


def test_equal_vectors_count_each(spark):
    """Copies of a vector, alone and near others: links and components are those of all rows."""
    base = [[1.0, 0.0, 0.0], [0.97, 0.2, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(i, base[i % 4] if i < 60 else base[2], i % 2) for i in range(100)] + [(7, base[3], 1), (500, base[0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted(tuple(r) for r in neardup.near_duplicates(df).collect())
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    near = [[j for j, y in enumerate(rows) if i != j and x[2] is not None and x[2] == y[2] and cos(x[1], y[1]) >= 0.93] for i, x in enumerate(rows)]
    want = []
    for i, x in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near[todo.pop()]) - seen
            seen |= new
            todo += new
        least = min(rows[j][0] for j in seen)
        want.append((x[0], len(near[i]), least, x[0] == least))
    assert got == sorted(want)


def test_traversal_is_ordered_and_complete():
    """Cells come nearest first, and all whose bounds leave room for a link; no other row's home is left out."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 10))
    v[200:] = v[:200] + rng.normal(size=(200, 10)) * 0.1
    v /= np.sqrt((v**2).sum(1, keepdims=True))
    index = neardup.Index({10: v[:300]}, 8)
    a, b = index.bounds(v)
    homes = index.homes(v)
    linked = v @ v.T >= 0.93
    for k, cells in enumerate(index.traversed(v, 0.93)):
        total = a[k][:, None] + b[k][None]
        sums = total.ravel()[cells]
        assert (np.diff(sums) >= 0).all() and set(cells.tolist()) == set(np.flatnonzero(total.ravel() <= 2 - 2 * 0.93 + 1e-9).tolist())
        assert set(homes[linked[k]].tolist()) <= set(cells.tolist())
    assert list(index.traversed(np.ones((2, 4)), 0.9)) == [None, None]
