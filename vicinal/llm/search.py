"""Exact top-k search by columnar branch and bound.

Candidates and queries meet in blocks. In a block the candidates lie dimension by dimension; the inner
products are summed one block of dimensions after the other, and after each a candidate stays only if its sum
plus the most that the remaining dimensions can add (the product of the remaining norms) still reaches the
k-th best lower bound. What stays is compacted, so later dimensions touch few candidates. The k-th best score
that a query finds in the first block bounds it in all others. Bounds keep ties, and allow for what doubles may round
off; scores are exact: what is left after the last dimension is scored in doubles where these add up exactly,
else in unbounded integers.

Cases: vectors that are null or hold null or non-finite components, and rows with a null vec_id, take no part, nor
do doubles whose 256-fold is no double (floats have none); vectors meet only vectors of their length; rows that
share a query's vec_id are its own; a vec_id repeated among the queries counts once (its least vector); repeated
candidates are candidates each; ranks follow the exact scores, and a score beyond a long is given as the nearest
long; vectors without components score 0; an empty table gives an empty result. Only vec_id and embedding are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import staged

K, EVERY = 5, 50
#: Most rows of a block, and most components; rows and dimensions worked on at once.
CANDIDATES, QUERIES, COMPONENTS, TILE, DIMS = 8192, 32_768, 1 << 21, 128, 16
LONG = 2**63


def finite(df: DataFrame) -> DataFrame:
    """The rows whose vec_id is there and whose embedding is there with finite components only."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def beyond(score: int) -> str:
    """What orders scores that are given as the same long: greater for greater scores."""
    if -LONG <= score < LONG:
        return ""
    digits = f"{len(str(abs(score))):04d}{abs(score)}"
    return digits if score > 0 else digits.translate(str.maketrans("0123456789", "9876543210"))


def exact(q: np.ndarray, cands: np.ndarray) -> list[int]:
    """Inner products of whole numbers in unbounded integers; equal candidates are multiplied once."""
    rows, back = np.unique(cands, axis=0, return_inverse=True)
    q = [int(x) for x in q.tolist()]
    scores = [sum(x * int(y) for x, y in zip(q, row, strict=True)) for row in rows.tolist()]
    return [scores[i] for i in back.ravel()]


def best(queries: np.ndarray, own: np.ndarray, cands: np.ndarray, ids: np.ndarray, k: int = K, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(row of the query, id, score) of the k best candidates for each query; ties to smaller ids.

    own: the queries' ids. floors: candidates below are left out (a bound that k candidates elsewhere reach).
    """
    if not len(cands):
        return []
    order = np.argsort(ids, kind="stable")
    ids, cands = ids[order], cands[order]
    dims = cands.shape[1]
    top_q, top_c = (float(np.abs(m).max(initial=0)) for m in (queries, cands))
    whole = top_q * top_c * max(1, dims) < 2**53  # doubles add up exactly
    # Powers of two bring large numbers near 1, so that no product overflows.
    unit_q, unit_c = (1.0 if whole or not t else 2.0 ** -np.frexp(t)[1] for t in (top_q, top_c))
    columns = np.ascontiguousarray((cands * unit_c).T)
    slack = 0.0 if whole else (dims + 4) * 2.0**-52
    cuts = list(range(0, dims, DIMS)) + [dims]
    mass = [np.sqrt((columns[c:] ** 2).sum(0)) for c in cuts[1:]]
    norm = np.sqrt((columns**2).sum(0))
    out = []
    for t in range(0, len(queries), TILE):
        tile = queries[t : t + TILE] * unit_q
        first = tile[:, : cuts[1]] @ columns[: cuts[1]] if len(cuts) > 1 else np.zeros((len(tile), len(ids)))
        for i, q in enumerate(tile):
            at = np.flatnonzero(ids != own[t + i])
            sums, size = first[i][at], float(np.sqrt((q**2).sum()))
            floor = -np.inf if floors is None else floors[t + i] * unit_q * unit_c
            floor -= 1e-9 * abs(floor) if np.isfinite(floor) else 0.0
            for j in range(1, max(2, len(cuts))):
                if j > 1:
                    sums = sums + q[cuts[j - 1] : cuts[j]] @ columns[cuts[j - 1] : cuts[j], at]
                last = j >= len(cuts) - 1
                room = slack * size * norm[at] + (0 if last else mass[j - 1][at] * np.sqrt((q[cuts[j] :] ** 2).sum()) * (1 + 1e-9))
                room += 0 if last and whole else 1e-6 if whole else 1e-300
                low = sums - room
                least = max(floor, np.partition(low, len(low) - k)[len(low) - k] if len(at) > k else -np.inf)
                stay = sums + room >= least
                at, sums = at[stay], sums[stay]
            scores = [int(x) for x in sums.tolist()] if whole else exact(queries[t + i], cands[at])
            top = sorted(zip((-s for s in scores), ids[at].tolist(), strict=True))[:k]
            out += [(t + i, n, -s) for s, n in top]
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score."""
    scaled = lambda x: F.lit(256.0) * x.cast("double")
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole numbers
    d = finite(finite(vectors).select("vec_id", F.transform("embedding", scaled).alias("embedding")))
    rows = staged(d.select("vec_id", F.transform("embedding", whole).alias("v"), F.size("embedding").alias("dim"), F.rand(4).alias("at")), "search-rows")
    queries = staged(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.dim", "x.v"), "search-queries")
    n, width = rows.agg(F.count("*"), F.max("dim")).first()
    size = lambda most: max(1, min(most, COMPONENTS // max(1, width or 0)))
    n_c, n_q = -(-max(1, n) // size(CANDIDATES)), -(-max(1, queries.count()) // size(QUERIES))
    # A stated query set against all rows, in blocks: each block of candidates is sent to each block of queries.
    c = rows.withColumn("cb", F.floor(F.col("at") * n_c).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select("cb", "qb", "dim", "vec_id", "v")
    q = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int"))

    def block(cs, qs):
        import pandas as pd

        if not len(cs) or not len(qs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "beyond": []})
        own = qs["vec_id"].to_numpy()
        got = best(np.stack(qs["v"]), own, np.stack(cs["v"]), cs["vec_id"].to_numpy(), k, qs["floor"].to_numpy())
        return pd.DataFrame([(int(own[i]), n, min(max(s, -LONG), LONG - 1), beyond(s)) for i, n, s in got], columns=["query_id", "vec_id", "score", "beyond"])

    def met(q, first, last):
        q = q.withColumn("cb", F.explode(F.sequence(F.lit(first), F.lit(last)))).select("cb", "qb", "dim", "vec_id", "v", "floor")
        keys = ["cb", "qb", "dim"]
        found = c.filter(F.col("cb").between(first, last)).groupBy(*keys).cogroup(q.groupBy(*keys))
        return found.applyInPandas(block, "query_id long, vec_id long, score long, beyond string")

    none = F.lit(float("-inf"))
    found = met(q.withColumn("floor", none), 0, 0)
    if n_c > 1:
        found = staged(found, "search-first")
        floors = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
        # A score that a long cannot hold bounds nothing.
        floor = F.when((F.col("n") >= k) & (F.abs(F.col("least").cast("double")) < 2.0**62), F.col("least").cast("double")).otherwise(none)
        found = found.union(met(q.join(floors, "vec_id", "left").withColumn("floor", floor), 1, n_c - 1))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir):
    from .common import table

    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
