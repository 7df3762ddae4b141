"""Poisson tails and normal quantiles against direct sums; sampling; trees."""

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from vicinal.functions import normal as N
from vicinal.operators import ranks, residuals as R, trees


def log_tail(k, mean, above):
    """Sum of the probabilities up to k, or above it."""
    span = range(k + 1, int(max(k, mean) + 40 * math.sqrt(mean) + 200)) if above else range(k + 1)
    terms = [i * math.log(mean) - mean - math.lgamma(i + 1) for i in span]
    top = max(terms)
    return top + math.log(math.fsum(math.exp(t - top) for t in terms))


def test_poisson_to_normal(spark):
    cases = [(k, m) for m in (0.01, 0.5, 1.0, 3.7, 20.0, 150.0, 4000.0) for k in sorted({0, 1, 2, int(m), int(m) + 1, int(m + 3 * math.sqrt(m)), max(0, int(m - 3 * math.sqrt(m))), int(m + 9 * math.sqrt(m)) + 3})]
    cases += [(5, 0.0), (100_000, 2.0), (0, 9000.0)]
    df = spark.createDataFrame(cases, "k long, m double")
    got = {(r["k"], r["m"]): r["t"] for r in df.filter("m > 0").select("k", "m", N.log_tails(F.col("k"), F.col("m")).alias("t")).collect()}
    z = {(r["k"], r["m"]): r["z"] for r in df.withColumn("z", N.poisson_to_normal(F.col("k"), F.col("m"))).filter("z < 1e9").collect()}
    for k, m in cases:
        if m == 0 or k == 100_000:
            assert z[k, m] == 100
            continue
        low, up = log_tail(k, m, False), log_tail(k, m, True)
        assert abs(got[k, m]["low"] - low) < 1e-9 * max(1, abs(low)) and abs(got[k, m]["up"] - up) < 1e-9 * max(1, abs(up))
        p = min(low, up)
        if p > -600:
            want = NormalDist().inv_cdf(math.exp(p)) * (1 if low <= up else -1)
            assert abs(z[k, m] - want) < 1e-8 * max(1, abs(want))
    assert z[0, 9000.0] == -100 and -100 < z[0, 4000.0] < -85
    q = -z[0, 4000.0]  # beyond 27: the tail's asymptotic series gives the probability back
    assert abs(-q * q / 2 - math.log(q * math.sqrt(2 * math.pi)) + math.log1p(-1 / q**2 + 3 / q**4) + 4000) < 1e-6


def test_systematic_samples(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([0, 1, 5, 200])) for k in ("a", "b") for i in range(80)]
    got = sorted((r["k"], r["draw"], r["i"]) for r in ranks.systematic(spark.createDataFrame(rows, "k string, i long, w long").repartition(5), ["k"], ["i"], "w", 50).collect())
    want = []
    for k in ("a", "b"):
        mine = sorted((i, w) for x, i, w in rows if x == k)
        total = sum(w for _, w in mine)
        for draw in range(1, 51):
            before = 0
            for i, w in mine:
                if before * 51 < draw * total <= (before + w) * 51:
                    want.append((k, draw, i))
                before += w
    assert got == sorted(want) and len(got) == 100
    motifs = R.motif_samples(spark.createDataFrame([("AC", 1.0), ("AG", 1.0), ("AG", 1.0)], "p string, w double"), "p", "w", n=4).orderBy("draw").collect()
    assert [r["motif"] for r in motifs] == ["AC", "AG", "AG", "AG"]  # C weighs 1, G twice two


def test_tree_closure(spark):
    rng = random.Random(4)
    parent = {i: rng.randrange(max(0, i - 3), i) for i in range(1, 120)}
    edges = spark.createDataFrame([(f"n{p}", f"n{c}") for c, p in parent.items()], "parent string, child string")
    want = []
    for c in parent:
        at, steps = c, 0
        while at in parent:
            at, steps = parent[at], steps + 1
            want.append((f"n{c}", f"n{at}", steps))
    assert max(s for *_, s in want) > 33
    assert sorted(map(tuple, trees.closure(edges).collect())) == sorted(want)
    tips = {f"n{i}" for i in range(120)} - {f"n{p}" for p in parent.values()}
    for r in trees.subtrees(edges).collect():
        below = [x for x, up, _ in want if up == r["node"]]
        assert (r["n_below"], r["n_tips"]) == (len(below), len(tips & set(below)) or 1)
    with pytest.raises(ValueError, match="round"):
        trees.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string"))
