"""Embedding near-duplicates through an inverted multi-index.

Two codebooks, one for each half of the unit vectors, span a grid of cells. Vectors at a cosine of t are at most
sqrt(2 - 2t) apart, and a vector is at least as far from a cell as the half-spaces that bound it in both halves. A vector
traverses the grid by both sequences of centres, in order of these bounds: pairs come in order of the sum, the nearest cell first, until
the sum says that no further cell can hold a link. So the target recall is 1, whatever the codebooks. Cosines
are computed in double precision and links are those at the threshold or above, so no false link is returned.

The rows of a label lie in blocks in the order of their cells; a large cell (a group of copies) takes several. A vector
goes to each block with a cell that it visits, and two blocks meet in one task, where a pair is counted once. A task
returns link counts and a spanning star for each of its groups, never its pairs. Equal vectors of a label are one
vector with a count. The bound cuts little where vectors are spread evenly in many dimensions; then nearly all pairs
of a label's different vectors are compared. The grid grows with the root of the rows up to MOST_CENTRES a half, which
bounds what a task holds of it; larger cells only take more blocks.

Cases: null, zero and non-finite vectors and rows with null label or vec_id link with nothing (component_id =
vec_id); vectors meet only vectors of their length and label; rows that repeat a vec_id are vectors of their
own, each with its row; an empty table gives an empty result. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import discard, small_side, staged
from .graph import components
from .search import finite

THRESHOLD = 0.93
#: Bounded sample for the codebooks; rows of a block, and of the part of it that is multiplied at once.
TRAIN_ROWS, BLOCK, SLICE = 20_000, 4096, 1024
MOST_CENTRES = 256


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means centres of the rows, from spread-out starts; fixed seed."""
    rng = np.random.default_rng(9)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        centres = np.stack([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(len(centres))])
    return centres


class Index:
    """Codebooks by the length of the vectors; a length that the sample lacks has one cell."""

    def __init__(self, sample: dict[int, np.ndarray], k: int):
        self.books = {d: (codebook(x[:, : d // 2], k), codebook(x[:, d // 2 :], k)) for d, x in sample.items() if d > 1}

    def halves(self, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half its centres and the squared distances of the rows from them, less the rows' own squares."""
        a, b = self.books[v.shape[1]]
        h = v.shape[1] // 2
        return [(c, (c**2).sum(1) - 2 * x @ c.T) for c, x in ((a, v[:, :h]), (b, v[:, h:]))]

    def homes(self, v: np.ndarray) -> np.ndarray:
        """The cell in which each row lies."""
        if v.shape[1] not in self.books:
            return np.zeros(len(v), int)
        (_, da), (b, db) = self.halves(v)
        return da.argmin(1) * len(b) + db.argmin(1)

    def bounds(self, v: np.ndarray) -> list[np.ndarray]:
        """For each half, rows x centres: the square of the least distance of a row from the half-spaces that bound the centre's cell."""
        far = []
        for c, d in self.halves(v):
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
            apart = np.where(apart > 1e-3, 2 * apart, np.inf)  # centres that nearly coincide bound nothing
            least = np.stack([((d[:, i, None] - d) / apart[i]).max(1) for i in range(len(c))], 1)
            far.append(np.maximum(least - 1e-6, 0) ** 2)  # less what rounding may add
        return far

    def traversed(self, v: np.ndarray, threshold: float):
        """For each row the cells that it visits, the nearest first: both sequences of centres in order of their bounds, and their pairs in order of the sum, up to where no link can lie (a recall of 1). None: all cells, as there is one."""
        if v.shape[1] not in self.books:
            yield from [None] * len(v)
            return
        limit = 2 - 2 * threshold + 1e-9
        orders, sums = zip(*((o := np.argsort(f, axis=1, kind="stable"), np.take_along_axis(f, o, 1)) for f in self.bounds(v)), strict=True)
        for a, b, x, y in zip(*orders, *sums, strict=True):
            ends = np.searchsorted(y, limit - x, "right")  # how far the second sequence goes beside each of the first
            ends = ends[: int(np.argmin(ends > 0)) if not ends.all() else len(ends)]
            first = np.repeat(np.arange(len(ends)), ends)
            second = np.arange(len(first)) - np.repeat(np.cumsum(ends) - ends, ends)
            order = np.argsort(x[first] + y[second], kind="stable")
            yield (a[first] * len(b) + b[second])[order]


def _stars(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the rows and columns of a link matrix: the least linked row."""
    rows, inf = np.where(m.any(1), np.arange(len(m)), len(m)), len(m)
    while True:
        cols = np.where(m, rows[:, None], inf).min(0, initial=inf)
        new = np.minimum(rows, np.where(m, cols[None], inf).min(1, initial=inf))
        if (new == rows).all():
            return rows, cols
        rows = new


def unit_rows(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, label, dim, v (a unit vector as doubles) of the rows that can link, written."""

    def run(batches):
        import pandas as pd

        for b in batches:
            for d, g in b.groupby(b["embedding"].map(len)):
                x = np.stack(g["embedding"]).astype(np.float64)
                x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
                x /= np.sqrt((x**2).sum(1, keepdims=True))
                yield pd.DataFrame({"vec_id": g["vec_id"], "label": g["label"], "dim": d, "v": [r.tobytes() for r in x + 0.0]})

    rows = finite(vectors).filter(F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)).select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    rows = rows.mapInPandas(run, "vec_id long, label string, dim int, v binary").withColumns({"uid": F.monotonically_increasing_id(), "same": F.md5("v")})
    return staged(rows, "neardup-rows")


def distinct(rows: DataFrame) -> DataFrame:
    """Written uid (the least), label, dim, v, same, m: one row for m equal vectors of a label."""
    found = rows.groupBy("label", "dim", "same").agg(F.min(F.struct("uid", "v")).alias("x"), F.count("*").alias("m"))
    return staged(found.select("x.uid", "label", "dim", "x.v", "same", "m"), "neardup-distinct")


def _matrix(column) -> np.ndarray:
    return np.stack([np.frombuffer(x) for x in column])


def build(rows: DataFrame, n: int) -> Index:
    ordered = rows.orderBy(F.xxhash64("uid")).select("dim", "v").limit(TRAIN_ROWS).toPandas()
    k = int(np.clip(2 ** np.round(np.log2(np.sqrt(max(1, n) / 200))), 4, MOST_CENTRES))
    return Index({d: _matrix(g["v"]) for d, g in ordered.groupby("dim")}, k)


def links(rows: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """Written rows (uid, n, root) of distinct vectors: n rows that uid links with between two blocks, root a vector that it is joined with there."""
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def housed(batches):
        for b in batches:
            for _, g in b.groupby("dim"):
                yield g.assign(cell=shared.value.homes(_matrix(g["v"])))[["uid", "label", "dim", "v", "m", "cell"]]

    d = staged(rows.select("uid", "label", "dim", "v", "m").mapInPandas(housed, "uid long, label string, dim int, v binary, m long, cell int"), "neardup-cells")
    before = W.partitionBy("label", "dim").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # as many rows as cells
    cells = d.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = small_side(cells, "neardup-sizes", 100_000)
    block = lambda place: F.floor(place / BLOCK).cast("int")
    d = d.join(cells, ["label", "dim", "cell"]).select("uid", "label", "dim", "v", "m", block(F.col("start") + F.pmod(F.xxhash64("uid"), F.col("n"))).alias("block"))
    spans = cells.select("label", "dim", "cell", block(F.col("start")).alias("first"), block(F.col("start") + F.col("n") - 1).alias("last"))
    grid = spans.groupBy("label", "dim").agg(F.sort_array(F.collect_list(F.struct("cell", "first", "last"))).alias("spans"))
    grid = grid.select("label", "dim", F.explode(F.sequence(F.lit(0), F.array_max("spans.last"))).alias("block"), *(F.col(f"spans.{c}").alias(c) for c in ("cell", "first", "last")))

    def routed(rows, grid):
        import pandas as pd

        if not len(rows):
            return pd.DataFrame({"uid": [], "label": [], "dim": [], "v": [], "m": [], "block": [], "visits": []})
        cell, first, last = (np.asarray(grid[c].iloc[0]) for c in ("cell", "first", "last"))
        place, visits = np.full(int(cell.max()) + 1, -1), []
        place[cell] = np.arange(len(cell))  # of the cells that hold rows
        for k in range(0, len(rows), SLICE):
            for cells in shared.value.traversed(_matrix(rows["v"].iloc[k : k + SLICE]), threshold):
                at = np.arange(len(cell)) if cells is None else place[cells[cells < len(place)]]
                at = at[at >= 0]
                begun = np.bincount(first[at], minlength=last[-1] + 2) - np.bincount(last[at] + 1, minlength=last[-1] + 2)
                visits.append(np.flatnonzero(np.cumsum(begun) > 0))
        return rows[["uid", "label", "dim", "v", "m", "block"]].assign(visits=visits)

    keys = ["label", "dim", "block"]
    sent = d.groupBy(*keys).cogroup(grid.groupBy(*keys)).applyInPandas(routed, "uid long, label string, dim int, v binary, m long, block int, visits array<int>")
    sent = sent.withColumn("to", F.explode("visits")).select("label", "dim", F.least("block", "to").alias("lo"), F.greatest("block", "to").alias("hi"), "block", "uid", "v", "m")

    def meet(rows):
        import pandas as pd

        lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
        g, h = ((x["uid"].to_numpy(), _matrix(x["v"]), x["m"].to_numpy()) if len(x := rows[rows["block"] == k]) else (np.zeros(0, int), None, None) for k in (lo, hi))
        uid, n, root = [], [], []
        for i in range(0, len(g[0]), SLICE):
            for j in range(i if lo == hi else 0, len(h[0]), SLICE):
                a, b = g[0][i : i + SLICE], h[0][j : j + SLICE]
                m = g[1][i : i + SLICE] @ h[1][j : j + SLICE].T >= threshold
                same = lo == hi and i == j
                if same:
                    m = np.triu(m, 1)
                    m |= m.T
                ga, hb = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
                if not len(ga):
                    continue
                m, a, b = m[np.ix_(ga, hb)], a[ga], b[hb]
                ra, rb = _stars(m)
                uid += [a, b]
                to_b = m @ h[2][j : j + SLICE][hb]
                n += [to_b, np.zeros(len(b), int) if same else g[2][i : i + SLICE][ga] @ m]
                root += [a[ra], a[rb]]
        if not uid:
            return pd.DataFrame({"uid": [], "n": [], "root": []}, dtype="int64")
        out = pd.DataFrame({"uid": np.concatenate(uid), "n": np.concatenate(n), "root": np.concatenate(root)})
        return out.groupby(["uid", "root"], as_index=False)["n"].sum()[["uid", "n", "root"]]

    return staged(sent.groupBy("label", "dim", "lo", "hi").applyInPandas(meet, "uid long, n long, root long"), "neardup-links")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of the input."""
    rows = unit_rows(vectors)
    one = distinct(rows)
    n = one.count()
    index = build(one, n) if n else Index({}, 4)
    found = links(one, index, threshold)
    counts = found.groupBy("uid").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "uid")
    one = one.select("uid", "label", "dim", "same", "m").join(counts, "uid", "left").join(roots, "uid", "left")
    one = one.select("label", "dim", "same", F.coalesce("root", "uid").alias("root"), (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    d = staged(rows.select("vec_id", "label", "dim", "same").join(one, ["label", "dim", "same"]), "neardup-joined")
    discard(rows)
    least = small_side(d.groupBy("root").agg(F.min("vec_id").alias("component_id")), "neardup-least", 1_000_000)
    linked = d.join(least, "root").select("vec_id", "n_links", "component_id")
    can = F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.col("vec_id").isNotNull()
    alone = vectors.filter(~F.coalesce(can, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS e, embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a
"""
