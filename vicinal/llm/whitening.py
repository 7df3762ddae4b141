"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers, x = floor(64 c) + 1000000, and the fit list has each distinct x once. The components are
the right singular vectors of the centred fit list X. A pass over the list turns every row through the triangular solves
of all factors found so far and sums the Gram matrix of what comes out; the Cholesky factor of that matrix, shifted by
what rounding may take from its least eigenvalue, is the next factor. Passes go on until every eigenvalue of the Gram
matrix is 1 or, where the list has no extent, 0 (three passes, or four where dimensions nearly depend on each other). So
X = Q R with R the product of the factors; the singular values of R, at most 16 of them, and its right singular vectors
give the variances and components without ever squaring the condition of X.

A task holds a batch of rows and one matrix of DIMENSIONS ** 2 doubles at most; tasks send sums, which Spark adds up by
cell; the driver gets a matrix for each length of vectors. Counts, sums and deviations are exact.

Cases: vectors that are null or hold null or non-finite entries are dropped, and so are those with an entry of at least
2 ** 40, whose x or deviation doubles could not hold; vectors of each length are a fit of their own, and more than DIMENSIONS entries are an
error; components whose variance is not above 1e-20 of the greatest are left out, so a list of one vector, and vectors
without entries, give no rows; a deviation beyond a long is given as the nearest long; null and repeated vec_id are
kept, each row with rows of its own; an empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import returned, staged

COMPONENTS = 16
SCALE, OFFSET, MOST = 64, 1_000_000, 2.0**40
#: Most entries of a vector: a task and the driver hold matrices of their square.
DIMENSIONS = 2048
#: Most passes of the orthogonalisation, how near to 0 or 1 eigenvalues must be, and the least variance against the greatest.
PASSES, CLOSE, LEAST = 8, 1e-12, 1e-20
LONG = 2**63
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x of the vectors that take part."""
    ok = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(MOST)))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    return vectors.filter(F.coalesce(ok, F.lit(False))).select("vec_id", F.size("embedding").alias("dim"), x.alias("x"))


def _by_dim(batches):
    """(dim, record batch, x as whole numbers) of the rows of each length in a batch."""
    import pyarrow.compute as pc

    for b in returned(batches):
        for d in pc.unique(b.column("dim")).to_pylist():
            rows = b.filter(pc.equal(b.column("dim"), d))
            yield d, rows, rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, d)


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """rows times the inverse of the product of the upper triangular factors, one triangular solve after the other."""
    y = np.array(rows.T, order="C")  # by columns
    for r in factors:
        for j in range(len(r)):
            y[j] = (y[j] - r[:j, j] @ y[:j]) / r[j, j]
    return y.T


def cells(fit: DataFrame, turn) -> dict[int, np.ndarray]:
    """For each length the sum over the fit list of y' y, where turn(dim, x) gives the rows y of a batch."""

    def run(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for d, _, x in _by_dim(batches):
            y = turn(d, x)
            sums[d] = sums.get(d, 0.0) + y.T @ y
        for d, m in sums.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], ["dim", "i", "j", "v"])

    out: dict[int, np.ndarray] = {}
    got = fit.mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toPandas()  # DIMENSIONS ** 2 rows a length at most
    for d, g in got.groupby("dim"):
        k = int(g["j"].max()) + 1
        m = np.zeros((k, k))
        m[g["i"], g["j"]] = m[g["j"], g["i"]] = g["v"]
        out[int(d)] = m
    return out


def totals(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each length the number of rows of the fit list and their sums by dimension."""

    def run(batches):
        import pyarrow as pa

        sums: dict[int, list] = {}
        for d, _, x in _by_dim(batches):
            old = sums.get(d, [0, np.zeros(d, object)])
            sums[d] = [old[0] + len(x), old[1] + x.astype(object).sum(0) if int(np.abs(x).max(initial=0)) * len(x) >= LONG / 4 else old[1] + x.sum(0)]
        for d, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *s)])], ["dim", "i", "v"])

    got = fit.mapInArrow(run, "dim int, i int, v string").groupBy("dim", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in got:
        out.setdefault(r["dim"], {})[r["i"]] = int(r["v"])
    return {d: (v[-1], np.array([v[i] for i in range(d)], object)) for d, v in out.items() if d}


def narrow(x: np.ndarray, n: int, s: np.ndarray) -> bool:
    """Whether n x - s fits a long."""
    return max(n * (int(np.abs(x).max(initial=0)) + 1), *map(abs, s), 0) < LONG / 4


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - s / n, from exact differences."""
    if narrow(x, n, s):
        return (n * x - s.astype(np.int64)) / n
    return ((n * x.astype(object) - s) / n).astype(float)


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """Sums of (n x - s) ** 2, exact; the nearest long of those beyond it."""
    far = ((centred(x, n, s) * n) ** 2).sum(1)
    out = np.zeros(len(x), np.int64)
    small = far < LONG / 4
    kind = np.int64 if narrow(x, n, s) else object
    out[small] = ((n * x[small].astype(kind) - s.astype(kind)) ** 2).sum(1)
    for k in np.flatnonzero(~small):
        out[k] = min(LONG - 1, sum((n * v - t) ** 2 for v, t in zip(x[k].tolist(), s, strict=True)))
    return out


def factor(gram: np.ndarray, n: int) -> np.ndarray:
    """The upper triangular factor of a Gram matrix of n rows (0: of rows that an earlier factor has turned), shifted by the rounding of its sums and of the factor."""
    d = len(gram)
    shift = (11 * (d + 1 + min(n, 4096)) if n else 1) * d * np.finfo(float).eps * (np.trace(gram) or 1.0)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def settled(gram: np.ndarray) -> bool:
    e = np.linalg.eigvalsh(gram)
    return bool((np.minimum(np.abs(e), np.abs(e - 1)) < CLOSE * len(e)).all())


class Whitening:
    """Of vectors of one length: n, sums, the projection of a centred row (a column a component), explained."""

    def __init__(self, n: int, sums: np.ndarray, factors: list[np.ndarray], gram: np.ndarray, most: int = COMPONENTS):
        e, u = np.linalg.eigh(gram)  # the identity up to rounding, but for dimensions that depend on others
        r = (u * np.sqrt(np.maximum(e, 0))) @ u.T
        for f in reversed(factors):
            r = r @ f
        _, sigma, v = np.linalg.svd(r)
        variance = sigma**2 / n
        keep = np.flatnonzero(variance > max(LEAST * variance.max(initial=0), 0))[:most]
        self.n, self.sums, self.error = n, sums, 0.0
        self.projection = v[keep].T / np.sqrt(variance[keep])
        self.explained = variance[keep] / variance.sum() if len(keep) else variance[keep]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.projection


def fitted(fit: DataFrame, most: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each length of the distinct vectors x."""
    share = fit.sparkSession.sparkContext.broadcast
    facts = totals(fit)
    if max(facts, default=0) > DIMENSIONS:
        raise ValueError(f"vectors have at most {DIMENSIONS} entries")
    factors: dict[int, list[np.ndarray]] = {d: [] for d in facts}
    fit, grams = fit.filter("dim > 0"), {}
    for turn in range(PASSES):
        known = share((facts, factors))
        new = cells(fit.filter(F.col("dim").isin([d for d in facts if d not in grams])), lambda d, x, known=known: solved(centred(x, *known.value[0][d]), known.value[1][d]))
        for d, m in new.items():
            if turn + 1 == PASSES or turn and settled(m):
                grams[d] = m
                continue
            factors[d].append(factor(m, facts[d][0] if turn == 0 else 0))
        if len(grams) == len(facts):
            break
    out = {d: Whitening(*facts[d], factors[d], grams[d], most) for d in facts}
    found = share(out)
    for d, m in cells(fit, lambda d, x: found.value[d](x)).items():
        out[d].error = float(np.abs(m / out[d].n - np.eye(len(m))).max(initial=0))
    return out


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each of its first components; see RESULT."""
    rows = whole(vectors)
    shared = rows.sparkSession.sparkContext.broadcast(fitted(staged(rows.select("dim", "x").distinct(), "whitening-fit"), most))

    def run(batches):
        import pyarrow as pa

        for d, b, x in _by_dim(batches):
            w = shared.value.get(d)
            if not w or not (k := len(w.explained)):
                continue
            m, rows = len(x), pa.array(np.repeat(np.arange(len(x)), k))
            columns = (np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, w.n), np.repeat(deviations(x, w.n, w.sums), k), w(x).ravel(), np.tile(w.explained, m), np.full(m * k, w.error))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(rows), *map(pa.array, columns)], [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)


def op13(spark, sf_dir):
    from .common import table

    return whitened(table(spark, sf_dir, "embeddings"))
