"""Models with selection, predictions on trees, places in an order."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators import config, generator, model as M, ranks, results
from vicinal.operators.tmers import Shape
from vicinal.sources import readers


def dense(x: np.ndarray, t: float) -> np.ndarray:
    """exp(t x) by scaling, a Taylor series and squaring."""
    y, term = np.eye(len(x)), np.eye(len(x))
    for k in range(1, 30):
        term = term @ x * (t / 2**10) / k
        y = y + term
    for _ in range(10):
        y = y @ y
    return y


def by_hand(m: M.Model) -> np.ndarray:
    """The generator of a model with single-letter rules X -> O and O -> X, site by site."""
    pats = m.patterns()
    n, wrap = m.shape.longwin, m.boundary == "wrap"

    def energy(p):
        pairs = range(n) if wrap else range(n - 1)
        walls = sum(p[k] != p[(k + 1) % n] for k in pairs)
        return m.selcoef[0] * walls + m.selcoef[1] * 0.5 * p.count("X")

    g = np.zeros((len(pats), len(pats)))
    for i, p in enumerate(pats):
        for k in range(n):
            q = p[:k] + ("O" if p[k] == "X" else "X") + p[k + 1 :]
            g[i, pats.index(q)] = m.rates[0] / (1 + math.exp(-(energy(q) - energy(p))))
    return g - np.diag(g.sum(1))


def ising(boundary: str, longwin: int = 4) -> M.Model:
    walls = (("OX", 1.0), ("XO", 1.0))
    return M.Model("XO", ((("X", "O"), ("O", "X")),), (0.7,), Shape(longwin, 2, 1), selpats=(walls, (("X", 0.5),)), selcoef=(-0.8, 0.4), fixfn="ising", boundary=boundary, tlen=1.3)


@pytest.mark.parametrize("boundary", ["none", "wrap"])
def test_ising_against_dense_exponential(spark, boundary):
    m = ising(boundary)
    p = dense(by_hand(m), m.tlen)
    shorts = ["XX", "OX", "XO", "OO"]
    want = {(a, s): sum(p[i, j] for j, q in enumerate(m.patterns()) if q[1:3] == s) for i, a in enumerate(m.patterns()) for s in shorts}
    counts = spark.createDataFrame([(a, s, 3) for a in m.patterns()[:7] for s in shorts], "long string, short string, count long")
    got = {(r["long"], r["short"]): r["count"] for r in M.predicted(counts, m).collect()}
    assert got == pytest.approx({k: 12 * v for k, v in want.items() if k[0] in m.patterns()[:7]})
    shorter = {(r["long"], r["short"]): r["count"] for r in M.predicted(counts, m, Shape(4, 1, 2)).collect()}
    assert shorter == pytest.approx({(a, c): sum(got[a, s] for s in shorts if s[1] == c) for a in m.patterns()[:7] for c in "XO"})
    assert M.predicted(counts, m, Shape(3, 1, 1)).agg(F.sum("count")).first()[0] == pytest.approx(84)


def test_generator_table_and_model_agree(spark):
    m = ising("wrap")
    pats = spark.createDataFrame([(p,) for p in m.patterns()], "pattern string")
    rules = spark.createDataFrame([(0, 0, "X", "O"), (0, 1, "O", "X")], "rate_id int, rule_id int, `from` string, `to` string")
    sel = spark.createDataFrame([(k, q, w) for k, g in enumerate(m.selpats) for q, w in g], "sel_id int, selpat string, factor double")
    mut = generator.applied(pats, rules, "wrap")
    from vicinal.functions import fixation

    x = generator.generator(mut, generator.differences(mut, generator.selection(pats, sel, "wrap")), list(m.rates), list(m.selcoef), fixation.ising)
    g = m.entries()
    want = {}
    for i, j, v in zip(g.i, g.j, g.x, strict=True):
        key = m.patterns()[i], m.patterns()[j]
        want[key] = want.get(key, 0) + v
    assert {(r["i"], r["j"]): r["x"] for r in x.collect()} == pytest.approx(want)


@pytest.mark.parametrize("name,params", [("shape", {"Ne": 3.0}), ("popgen", {"Ne": 3.0}), ("ising", {}), ("null", {})])
def test_fixation_on_arrays(spark, name, params):
    from vicinal.functions import fixation

    ds = [0.0, 0.3, -0.4, 2.0]
    rows = spark.createDataFrame([(x,) for x in ds], "ds double").select(fixation.parse(name, params)(F.col("ds")).alias("f")).collect()
    assert fixation.parse(name, params, arrays=True)(np.array(ds)) == pytest.approx([r["f"] for r in rows])


def test_loglikelihood(spark):
    m = ising("none", 3)
    counts = spark.createDataFrame([(a, b, 1 + (k * j) % 5) for k, a in enumerate(m.patterns()) for j, b in enumerate(["XX", "OX", "XO"])], "long string, short string, count long")
    assert M.loglikelihood(counts, m).first()["loglik"] == pytest.approx(M.likelihood(counts, m)(m.rates))
    assert M.likelihood(counts, m)(m.rates, selcoef=(0.0, 0.0)) != pytest.approx(M.likelihood(counts, m)(m.rates))


def test_prediction_on_a_tree(spark):
    """Against sums over the states of all nodes."""
    rule = (("X", "O"),), (("O", "X"),)
    models = {n: M.Model("XO", rule, r, Shape(3, 1, 1)) for n, r in (("a", (0.3, 0.6)), ("b", (0.5, 0.2)), ("m", (0.4, 0.4)), ("c", (0.1, 0.9)))}
    edges = [("root", "m", 0.5), ("root", "c", 0.7), ("m", "a", 0.3), ("m", "b", 0.4)]
    pats = models["a"].patterns()
    full = {}
    for _, child, t in edges:
        g = models[child].entries()
        x = np.zeros((8, 8))
        np.add.at(x, (g.i, g.j), g.x)
        full[child] = dense(x - np.diag(x.sum(1)), t)
    pi = [math.prod({"X": 0.4, "O": 0.6}[c] for c in p) for p in pats]
    joint = {}
    for r, m, c, a, b in itertools.product(range(8), repeat=5):
        key = pats[a], pats[b][1], pats[c][1]
        joint[key] = joint.get(key, 0) + pi[r] * full["m"][r, m] * full["c"][r, c] * full["a"][m, a] * full["b"][m, b]
    counts = spark.createDataFrame([(p, "X", 10 * k + 5) for k, p in enumerate(pats)], "long string, short string, count long")
    got = {(r["long"], r["short1"], r["short2"]): r["count"] for r in M.predicted_tree(counts, edges, "a", ["b", "c"], models, {"X": 0.4, "O": 0.6}).collect()}
    total = {p: sum(v for k, v in joint.items() if k[0] == p) for p in pats}
    assert got == pytest.approx({k: (10 * pats.index(k[0]) + 5) * v / total[k[0]] for k, v in joint.items()})


def test_places_and_quantiles(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 7)
    values = [5.0, 1.0, 1.0, 3.0, None, 2.0, 1.0, 8.0, 9.0, -1.0] * 4
    df = spark.createDataFrame([(k % 3 or None, v, k) for k, v in enumerate(values)], "key int, value double, id int").repartition(5)
    got = sorted((r["id"], r["place"]) for r in ranks.ranked(df, [F.col("value"), F.col("id")]).collect())
    want = {k: p for p, (k, _) in enumerate(sorted(enumerate(values), key=lambda x: (x[1] is not None, x[1] or 0, x[0])), 1)}
    assert got == sorted(want.items())
    q = {r["key"]: r["q"] for r in ranks.quantiles(df, ["key"], "value", (0.0, 0.1, 0.5, 1.0)).collect()}
    for key in (None, 1, 2):
        mine = [v for k, v in enumerate(values) if (k % 3 or None) == key and v is not None]
        assert q[key] == pytest.approx(list(np.quantile(mine, [0.0, 0.1, 0.5, 1.0])))
    assert ranks.quantiles(df.limit(0), ["key"], "value", (0.5,)).count() == 0


def test_tables(spark):
    df = spark.createDataFrame([(1.0, 2, 3, 4), (float("nan"), 2, 3, 4), (float("inf"), 1, 1, 1), (None, 1, 1, 1)], "z double, rate2 int, other int, rate1 int")
    assert results.finite(df, "z").count() == 1
    assert results.reordered(df, "^rate").columns == ["rate1", "rate2", "z", "other"]


def test_trees_and_alignments(spark, tmp_path):
    edges = config.newick("((a:1,b:2)m:1,c:3)r;")
    assert config.parent(edges, "a") == "m" and config.parent(edges, "r") is None
    assert ("root", "c", 3.0) in config.renamed(edges, {"r": "root"})
    with pytest.raises(ValueError, match="one name"):
        config.renamed(edges, {"a": "b"})
    (tmp_path / "whole.phy").write_text(" 2 6\none ACG TAC\ntwo AC GTAG\n")
    assert {r["taxon"]: r["seq"] for r in readers.multiple_alignment(spark, str(tmp_path / "whole.phy")).collect()} == {"one": "ACGTAC", "two": "ACGTAG"}
    (tmp_path / "parts.phy").write_text(" 2 6\none ACG\ntwo ACG\n\nTAC\nTAG\n")
    assert {r["taxon"]: r["seq"] for r in readers.multiple_alignment(spark, str(tmp_path / "parts.phy")).collect()} == {"one": "ACGTAC", "two": "ACGTAG"}
    (tmp_path / "short.phy").write_text(" 2 6\none ACG\ntwo ACG\n\nTAC\n")
    with pytest.raises(Exception, match="sites"):
        readers.multiple_alignment(spark, str(tmp_path / "short.phy")).collect()
    (tmp_path / "few.phy").write_text(" 3 3\none ACG\ntwo ACG\n")
    with pytest.raises(ValueError, match="fewer taxa"):
        readers.multiple_alignment(spark, str(tmp_path / "few.phy"))


def test_series_equals_arrays(spark):
    from vicinal.operators import series
    from vicinal.operators.model import Model
    from vicinal.operators.tmers import Shape

    models = [
        Model("ACGT", ((("A", "C"),), (("C", "T"),), (("CG", "TG"), ("CG", "CA"))), (0.1, 0.2, 1.3), Shape(4, 2, 1), tlen=1.7),
        Model("XO", ((("X", "O"), ("O", "X")), (("XO", "OX"),)), (0.5, 0.25), Shape(5, 1, 2), selpats=((("OX", 1.0), ("XO", 1.0)), (("X", 0.5),)), selcoef=(-0.6, 0.3), fixfn="ising", boundary="wrap"),
        Model("XO", ((("X", "O"),),), (0.7,), Shape(3, 3, 0), gamma_shape=2.5, tlen=3.0),
        Model("XO", ((("X", "O"),),), (0.0,), Shape(3, 1, 0)),
    ]
    for m in models:
        want = m.transitions()
        got = np.zeros_like(want)
        for r in series.transitions(spark, m).collect():
            got[r["i"], r["first"] : r["first"] + len(r["p"])] = r["p"]
        assert np.abs(got - want).max() < 1e-11
    counts = spark.createDataFrame([("ACGT", "CG", 5), ("ACGT", "TG", 2), ("AAAA", "AA", 3), ("AANA", "AA", 3)], "long string, short string, count long")
    from vicinal.operators import model as M

    a, b = ({(r["long"], r["short"]): r["count"] for r in f(counts, models[0]).collect()} for f in (M.predicted, series.predicted))
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_gamma_series_of_large_shapes_and_extension():
    from vicinal.operators import linalg as A

    rng = np.random.default_rng(3)
    i, j = np.nonzero(~np.eye(6, dtype=bool))
    g = A.Sparse(i, j, rng.random(len(i)) * 1e4, 6)
    out = A.gamma_action(g, np.eye(6), 200.0, 1e-4)
    assert np.isfinite(out).all() and np.allclose(out.sum(1), 1)
    q = np.zeros((6, 6))
    q[i, j] = g.x
    np.fill_diagonal(q, -q.sum(1))
    w, v = np.linalg.eig(q)
    assert np.allclose(out, ((v * (1 - 1e-4 * w) ** -200.0) @ np.linalg.inv(v)).real, atol=1e-9)
    with pytest.raises(ValueError, match="terms"):
        A.gamma_action(g, np.eye(6), 200.0, 1.0)
    g = A.Sparse(i, j, rng.random(len(i)), 6)
    assert np.abs(A.extended_action(g, A.gamma_action(g, np.eye(6), 1.0, 0.7), 0.7, 2.9) - A.gamma_action(g, np.eye(6), 1.0, 2.9)).max() < 1e-10
    with pytest.raises(ValueError, match="longer"):
        A.extended_action(g, np.eye(6), 2.0, 1.0)
