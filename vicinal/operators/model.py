"""Likelihood, fitting, sampling and prediction.

Counts are DataFrames; what a model needs of them is their sum over the patterns of its window, a table of at
most K^L times K^w cells, whatever the size of the data.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.fixation import parse
from ..functions.patterns import pattern_list
from . import series
from .linalg import Sparse, exp_action, gamma_action, minimise, projection, root_distribution
from .tmers import Shape, projected

#: Most cells of a table of transitions, and the longest window whose table is broadcast (K^4 * K^4 rows at most); larger ones shuffle.
MOST_CELLS, MOST_BROADCAST = 1 << 22, 4


@dataclass(frozen=True)
class Model:
    """Rules with rates on the patterns of a window; rate i applies to every rule of group i.

    A change is slowed or sped up by the fixation function of its selection difference, the sum over groups of selcoef
    times the change in weighted matches of the group's patterns. selpats: groups of (pattern, factor). Without
    coefficients no function is applied. boundary wrap: patterns are circles.
    """

    bases: str
    mutpats: tuple
    rates: tuple
    shape: Shape
    tlen: float = 1.0
    gamma_shape: float | None = None
    scales: tuple = ()
    names: tuple = field(default=())
    selpats: tuple = ()
    selcoef: tuple = ()
    fixfn: str = "null"
    fixparams: tuple = ()
    boundary: str = "none"

    def __post_init__(self):
        for group in self.mutpats:
            for a, b in group:
                if len(a) != len(b) or len(a) > self.shape.longwin or set(a + b) - set(self.bases):
                    raise ValueError(f"no rule on windows of {self.shape.longwin} of {self.bases}: {a} -> {b}")
        if any(len(q) > self.shape.longwin or set(q) - set(self.bases) for group in self.selpats for q, _ in group):
            raise ValueError("a selected pattern does not fit the window")
        if len(self.rates) != len(self.mutpats) or len(self.selcoef) not in (0, len(self.selpats)):
            raise ValueError("as many rates and coefficients as groups are wanted")
        parse(self.fixfn, dict(self.fixparams))

    def patterns(self) -> list[str]:
        return pattern_list(self.shape.longwin, self.bases)

    def ways(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, rate) of each way to change a pattern: fixed for a model, so rates only re-weigh it."""
        k, n, out = len(self.bases), self.shape.longwin, []
        for r, group in enumerate(self.mutpats):
            for a, b in group:
                for s, at in self._places(a):
                    step = sum((self.bases.index(y) - self.bases.index(x)) * k ** ((s + m) % n) for m, (x, y) in enumerate(zip(a, b, strict=True)))
                    if step:
                        out.append((at, at + step, np.full(len(at), r)))
        return tuple(np.concatenate([x[c] for x in out] or [np.zeros(0, int)]) for c in range(3))

    def _places(self, q: str):
        """(start, numbers of the patterns in which q stands there) for each start; the first symbol of a pattern varies fastest."""
        k, n = len(self.bases), self.shape.longwin
        every = np.arange(k**n)
        for s in range(0 if len(q) > n else n if self.boundary == "wrap" else n - len(q) + 1):
            here = np.ones(len(every), bool)
            for m, c in enumerate(q):
                here &= every // k ** ((s + m) % n) % k == self.bases.index(c)
            yield s, every[here]

    def selection(self) -> np.ndarray:
        """Weighted matches of each group of selected patterns, a row for each pattern."""
        out = np.zeros((len(self.bases) ** self.shape.longwin, len(self.selpats)))
        for c, group in enumerate(self.selpats):
            for q, w in group:
                for _, at in self._places(q):
                    out[at, c] += w
        return out

    def entries(self, rates=None, selcoef=None, fixparams=None, ways=None) -> Sparse:
        """The generator: rates of all ways, times the fixation function of their selection differences."""
        i, j, r = ways or self.ways()
        x = np.asarray(self.rates if rates is None else rates, float)[r]
        coef = np.asarray(self.selcoef if selcoef is None else selcoef, float)
        if len(coef):
            s = self.selection() @ coef
            x = x * parse(self.fixfn, dict(self.fixparams if fixparams is None else fixparams), arrays=True)(s[j] - s[i])
        return Sparse(i, j, x, len(self.bases) ** self.shape.longwin)

    def transitions(self, rates=None, shortwin: int | None = None, ways=None, shape: Shape | None = None, **params) -> np.ndarray:
        """P(short | long) by the exponential acting on the projection only; shape: of other short patterns."""
        shape = shape or self.shape
        u = projection(self.patterns(), pattern_list(shortwin or shape.shortwin, self.bases), shape.leftwin)
        return self.moved(u, self.tlen, self.entries(rates, ways=ways, **params))

    def moved(self, v: np.ndarray, t: float, g: Sparse | None = None) -> np.ndarray:
        g = g or self.entries()
        return gamma_action(g, v, self.gamma_shape, t) if self.gamma_shape else exp_action(g, v, t)

    def with_rates(self, rates) -> "Model":
        return replace(self, rates=tuple(map(float, rates)))


def transition_frame(spark: SparkSession, model: Model, shape: Shape | None = None) -> DataFrame:
    """long, short, p of the model; K^L * K^w rows."""
    shape = shape or model.shape
    return _cells(spark, model.transitions(shape=shape), model.patterns(), {"short": pattern_list(shape.shortwin, model.bases)})


def _cells(spark: SparkSession, p: np.ndarray, longs: list[str], shorts: dict[str, list[str]]) -> DataFrame:
    """long, the columns of shorts, p."""
    if p.size > MOST_CELLS:
        raise ValueError("too many patterns for a table of transitions")
    import pandas as pd

    columns = {name: np.tile(values, len(longs)) for name, values in shorts.items()}
    return spark.createDataFrame(pd.DataFrame({"long": np.repeat(longs, p.shape[1]), **columns, "p": p.ravel()}))


def predicted(counts: DataFrame, model: Model, shape: Shape | None = None, cells: np.ndarray | None = None) -> DataFrame:
    """long, short, count: the totals of the long patterns times the model's transitions.

    shape: other than the model's. Short patterns may be any that lie in the model's window; a shorter window gets the
    prediction for the model's own, re-shaped. Where the table of transitions is too large for one task, it is worked out
    as a series of joins. cells: a table of transitions to use in place of the model's.
    """
    shape = shape or model.shape
    if shape.longwin > model.shape.longwin:
        raise ValueError("the model's window is shorter than that of the prediction")
    inner = replace(shape, longwin=model.shape.longwin)
    if cells is None and len(model.bases) ** (inner.longwin + inner.shortwin) > MOST_CELLS:
        out = series.predicted(counts, model, inner)
    else:
        totals = counts.groupBy("long").agg(F.sum("count").alias("total"))
        p = transition_frame(counts.sparkSession, model, inner) if cells is None else _cells(counts.sparkSession, cells, model.patterns(), {"short": pattern_list(inner.shortwin, model.bases)})
        p = F.broadcast(p) if model.shape.longwin <= MOST_BROADCAST else p
        out = totals.join(p, "long").select("long", "short", (F.col("total") * F.col("p")).alias("count"))
    return out if inner == shape else projected(out, inner, shape)


def predicted_tree(counts: DataFrame, edges: list, row: str, cols: list[str], models: dict, freqs: dict) -> DataFrame:
    """long, short1.., count at the tips cols of a tree, given the totals of the long patterns at `row`.

    models: by the node at the lower end of each edge (parent, child, length), all of one window.
    """
    first = next(iter(models.values()))
    shorts = pattern_list(first.shape.shortwin, first.bases)
    u = projection(first.patterns(), shorts, first.shape.leftwin)
    p = peel(edges, row, cols, {n: m.entries() for n, m in models.items()}, u, root_distribution(first.patterns(), freqs))
    names = ["short"] if len(cols) == 1 else [f"short{k + 1}" for k in range(len(cols))]
    every = np.array(list(itertools.product(shorts, repeat=len(cols))))
    cells = _cells(counts.sparkSession, p, first.patterns(), {n: every[:, k] for k, n in enumerate(names)})
    totals = counts.groupBy("long").agg(F.sum("count").alias("total"))
    return totals.join(cells, "long").select("long", *names, (F.col("total") * F.col("p")).alias("count"))


def _matrix(counts: DataFrame, model: Model, shortwin: int) -> np.ndarray:
    longs = {p: k for k, p in enumerate(model.patterns())}
    shorts = {p: k for k, p in enumerate(pattern_list(shortwin, model.bases))}
    m = np.zeros((len(longs), len(shorts)))
    if m.size > MOST_CELLS:
        raise ValueError("too many patterns for a table of counts")
    # Patterns outside the model's alphabet say nothing on it. As many rows as cells, summed before.
    known = counts.filter(~(F.col("long").rlike(f"[^{model.bases}]") | F.col("short").rlike(f"[^{model.bases}]")))
    for r in known.groupBy("long", F.substring("short", 1, shortwin).alias("short")).agg(F.sum("count").alias("count")).collect():
        m[longs[r["long"]], shorts[r["short"]]] = r["count"]
    return m


def likelihood(counts: DataFrame, model: Model):
    """rates (and selcoef, fixparams by name) -> composite log-likelihood: of the short patterns less that of the ones shorter by a symbol."""
    w = model.shape.shortwin
    c, ways = _matrix(counts, model, w), model.ways()
    c0 = _matrix(counts, model, w - 1) if w > 1 else None

    def value(rates, **params) -> float:
        total = 0.0
        for m, k, sign in ((c, w, 1), (c0, w - 1, -1)):
            if m is not None:
                p = model.transitions(rates, k, ways, **params)
                seen = m > 0
                total += -np.inf if sign > 0 and (p[seen] <= 0).any() else sign * float((m[seen] * np.log(np.maximum(p[seen], 1e-300))).sum())
        return total

    return value


def loglikelihood(counts: DataFrame, model: Model) -> DataFrame:
    """loglik: the composite log-likelihood of the model as it is, one row."""
    shape, spark = model.shape, counts.sparkSession
    terms = [(1, shape)] + ([(-1, replace(shape, shortwin=shape.shortwin - 1))] if shape.shortwin > 1 else [])
    out = None
    for sign, s in terms:
        p = transition_frame(spark, model, s)
        c = counts.groupBy("long", F.substring("short", 1, s.shortwin).alias("short")).agg(F.sum("count").alias("count"))
        part = c.join(p, ["long", "short"]).select((sign * F.col("count") * F.log("p")).alias("x"))
        out = part if out is None else out.union(part)
    return out.agg(F.sum("x").alias("loglik"))


def fit(counts: DataFrame, model: Model, lowest: float = 1e-6) -> tuple[Model, float, bool]:
    """Maximum likelihood; rates with scale 0 stay as they are."""
    value = likelihood(counts, model)
    x0 = np.array(model.rates)
    free = np.array([s != 0 for s in model.scales]) if model.scales else np.ones(len(x0), bool)
    base = abs(value(x0)) or 1.0

    def f(x):
        y = x0.copy()
        y[free] = x
        return -value(y) / base

    best, fx, done = minimise(f, x0[free], np.full(free.sum(), lowest), np.full(free.sum(), np.inf))
    x = x0.copy()
    x[free] = best
    return model.with_rates(x), -fx * base, done


def fit_frame(counts: DataFrame, model: Model) -> DataFrame:
    got, value, done = fit(counts, model)
    rows = [(f"rate{i}", float(x), value, done) for i, x in enumerate(got.rates)]
    return counts.sparkSession.createDataFrame(rows, "name string, value double, loglik double, converged boolean")


def sample(counts: DataFrame, model: Model, steps: int, chains: int, prior_mean: float = 1.0, scale: float = 0.02, seed: int = 1) -> DataFrame:
    """chain, step, name, value, accepted: random-walk Metropolis with exponential priors, a task for each chain."""
    value = likelihood(counts, model)
    x0 = np.array(model.rates)

    def chain(pdf):
        import pandas as pd

        k = int(pdf["chain"].iloc[0])
        rng = np.random.default_rng([seed, k])
        at = lambda x: -np.inf if (x < 0).any() else value(x) - x.sum() / prior_mean
        x, fx, rows = x0.copy(), at(x0), []
        for step in range(steps):
            y = x + rng.normal(0, scale, len(x))
            fy = at(y)
            ok = np.log(rng.random()) < fy - fx
            if ok:
                x, fx = y, fy
            rows += [(k, step, f"rate{i}", float(v), bool(ok)) for i, v in enumerate(x)]
        return pd.DataFrame(rows, columns=["chain", "step", "name", "value", "accepted"])

    runs = counts.sparkSession.range(chains).withColumnRenamed("id", "chain")
    return runs.groupBy("chain").applyInPandas(chain, "chain long, step long, name string, value double, accepted boolean")


def surfaces(counts: DataFrame, model: Model, pairs: list[tuple[int, int]] | None = None, grid: int = 5, spread: float = 0.5) -> DataFrame:
    """a, b, x, y, loglik on a grid around the model's rates for each pair (a, b) of them (by default all pairs), points dealt out to tasks."""
    value, x0 = likelihood(counts, model), np.array(model.rates)
    spark, pairs = counts.sparkSession, pairs or list(itertools.combinations(range(len(model.rates)), 2))
    points = [(a, b, float(x0[a] * x), float(x0[b] * y)) for a, b in pairs for x in np.linspace(1 - spread, 1 + spread, grid) for y in np.linspace(1 - spread, 1 + spread, grid)]

    def run(batches):
        for p in batches:
            out = []
            for a, b, x, y in zip(p["a"], p["b"], p["x"], p["y"], strict=True):
                r = x0.copy()
                r[a], r[b] = x, y
                out.append(value(r))
            yield p.assign(loglik=out)

    d = spark.createDataFrame(points, "a int, b int, x double, y double")  # grid ** 2 points a pair
    return d.repartition(min(len(points), spark.sparkContext.defaultParallelism)).mapInPandas(run, "a int, b int, x double, y double, loglik double")


def surface(counts: DataFrame, model: Model, a: int, b: int, grid: int = 5, spread: float = 0.5) -> DataFrame:
    """x, y, loglik on a grid of two rates around the model's."""
    return surfaces(counts, model, [(a, b)], grid, spread).select("x", "y", "loglik")


def candidates(counts: DataFrame, model: Model, rules: list, steps: int = 12) -> DataFrame:
    """rule, rate, gain: the best rate of each rule added alone, and what it gains; a task takes some rules."""
    base = likelihood(counts, model)(model.rates)
    matrix = _matrix(counts, model, model.shape.shortwin)
    spark = counts.sparkSession
    rows = spark.createDataFrame([(k, f"{a}->{b}") for k, [(a, b)] in enumerate(rules)], "id int, rule string")
    w = model.shape.shortwin

    def run(batches):
        for p in batches:
            best = []
            for k in p["id"]:
                m = replace(model, mutpats=(*model.mutpats, rules[k]), rates=(*model.rates, 0.01))
                ways, seen = m.ways(), []
                for x in np.geomspace(1e-4, 0.5, steps):
                    total = 0.0
                    for c, n, sign in ((matrix, w, 1), (None if w == 1 else matrix.reshape(len(matrix), len(m.bases), -1).sum(1), w - 1, -1)):
                        if c is not None:
                            q = m.transitions((*model.rates, x), n, ways)
                            total += sign * float((c[c > 0] * np.log(np.maximum(q[c > 0], 1e-300))).sum())
                    seen.append((total - base, float(x)))
                best.append(max(seen))
            yield p[["rule"]].assign(rate=[b[1] for b in best], gain=[b[0] for b in best])

    return rows.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "rule string, rate double, gain double")


def peel(edges: list, row: str, cols: list[str], gens: dict, projections: np.ndarray, pi: np.ndarray, normalize: bool = True) -> np.ndarray:
    """P(short patterns at the tips cols | long pattern at the tip or root `row`) on a tree.

    Below a node, the table of its tips' short patterns is the row-wise product of those of its edges; from the
    root the way to `row` goes down again with the transposed exponential. Columns vary with the last tip fastest, tips in the order of cols.
    """
    kids: dict[str, list] = {}
    for p, c, t in edges:
        kids.setdefault(p, []).append((c, t))
    parent = {c: p for p, c, _ in edges}
    path, n = [row], row
    while n in parent:
        n = parent[n]
        path.append(n)

    def cross(a, b):
        return (a[0][:, :, None] * b[0][:, None, :]).reshape(len(a[0]), -1), a[1] + b[1]

    def up(node):
        """Table and tips below a node."""
        if node in cols and node not in kids:
            return projections, [node]
        out = None
        for c, t in kids[node]:
            below = up(c)
            moved = exp_action(gens[c], below[0], t), below[1]
            out = moved if out is None else cross(out, moved)
        return out

    table, tips = pi[:, None].copy(), []
    for k in range(len(path) - 1, 0, -1):  # down from the root, other edges joining on the way
        for c, t in kids[path[k]]:
            if c != path[k - 1]:
                below = up(c)
                table, tips = cross((table, tips), (exp_action(gens[c], below[0], t), below[1]))
        t = next(t for c, t in kids[path[k]] if c == path[k - 1])
        table = exp_action(gens[path[k - 1]].transposed(), table, t)
    if row in kids:
        below = up(row)
        table, tips = cross((table, tips), below)
    w = projections.shape[1]
    order = [tips.index(c) for c in cols]
    table = table.reshape(len(table), *[w] * len(tips)).transpose(0, *[1 + o for o in order]).reshape(len(table), -1)
    return table / table.sum(1, keepdims=True) if normalize else table
