"""Exponentials of generators of long windows, as iterated joins.

A pattern is a number, its first symbol the fastest digit. The generator is a table of changes (i, j, x), made by the
executors from a range of patterns; with its diagonal, over the greatest rate r at which a pattern is left, it is a
stochastic matrix P. The exponential for a time t acts on the projection to short patterns as the sum of the Poisson(r t)
weights times P ** k (for a Gamma time: negative binomial weights), so each term is a join of the term before with P and a sum by pattern. Terms
are written, which cuts the lineage; how many there are follows from the tail of the weights. Short patterns are columns of a
term, COLUMNS at a time, each such group a series of its own. Nothing is held by the driver but the weights.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.fixation import parse
from ..staging import discard, staged
from .tmers import Shape

#: Short patterns that are worked on together, terms of a series at most, the weight of the terms that are left out.
COLUMNS, MOST_TERMS, TAIL = 64, 20_000, 1e-13


def digit(code: Column, place: int, base: int) -> Column:
    return F.floor(code / base**place) % base


def standing(code: Column, pattern: str, start: int, bases: str, length: int) -> Column:
    """Whether a pattern stands in a coded one from a place on; places go round."""
    return reduce(lambda a, b: a & b, (digit(code, (start + k) % length, len(bases)) == bases.index(c) for k, c in enumerate(pattern)))


def places(pattern: str, model) -> range:
    n = model.shape.longwin
    return range(0 if len(pattern) > n else n if model.boundary == "wrap" else n - len(pattern) + 1)


def selected(code: Column, model) -> Column:
    """The model's selection score of a coded pattern."""
    out = F.lit(0.0)
    for c, group in zip(model.selcoef, model.selpats, strict=bool(model.selcoef)):
        for q, w in group:
            for s in places(q, model):
                out += F.when(standing(code, q, s, model.bases, model.shape.longwin), float(c * w)).otherwise(0.0)
    return out


def changes(spark: SparkSession, model) -> DataFrame:
    """Written (i, j, x): the rates of the model's changes, for all patterns of its window."""
    k, n = len(model.bases), model.shape.longwin
    ways = []
    for rate, group in zip(model.rates, model.mutpats, strict=True):
        for a, b in group:
            for s in places(a, model):
                step = sum((model.bases.index(y) - model.bases.index(x)) * k ** ((s + m) % n) for m, (x, y) in enumerate(zip(a, b, strict=True)))
                if step:
                    ways.append(F.when(standing(F.col("id"), a, s, model.bases, n), F.struct((F.col("id") + step).alias("j"), F.lit(float(rate)).alias("x"))))
    every = F.array_compact(F.array(*ways)) if ways else F.array().cast("array<struct<j:bigint,x:double>>")
    d = spark.range(k**n).select(F.col("id").alias("i"), F.explode(every).alias("w")).select("i", "w.*")
    if model.selcoef:
        fix = parse(model.fixfn, dict(model.fixparams))
        d = d.withColumn("x", F.col("x") * fix(selected(F.col("j"), model) - selected(F.col("i"), model)))
    return staged(d.groupBy("i", "j").agg(F.sum("x").alias("x")), "series-changes")


def poisson(top: float) -> list[float]:
    """Weights of the terms of an exponential, up to a tail of TAIL."""
    return _weights(lambda k: k * math.log(top) - top - math.lgamma(k + 1)) if top else [1.0]


def negative_binomial(shape: float, top: float) -> list[float]:
    """Weights for a Gamma-distributed time."""
    if not top:
        return [1.0]
    p = top / (1 + top)
    return _weights(lambda k: math.lgamma(shape + k) - math.lgamma(shape) - math.lgamma(k + 1) + shape * math.log1p(-p) + k * math.log(p))


def _weights(log_weight) -> list[float]:
    """The weights whose logarithms are given, divided by their sum; a series that doesn't end within MOST_TERMS is an error."""
    out, total = [], 0.0
    while 1 - total > TAIL:
        if len(out) >= MOST_TERMS:
            raise ValueError(f"a series of more than {MOST_TERMS} terms: split the time")
        out.append(math.exp(log_weight(len(out))))
        total += out[-1]
        if len(out) > 8 and out[-1] < out[-2] and out[-1] < TAIL * 1e-3:  # what is missing of 1 is rounding
            break
    return [w / total for w in out]


def transitions(spark: SparkSession, model, shape: Shape | None = None) -> DataFrame:
    """Written (i, first, p): for each pattern of the window, and each group of COLUMNS short patterns by the number of its first, their probabilities in order."""
    shape = shape or model.shape
    k, n = len(model.bases), model.shape.longwin
    ways = changes(spark, model)
    left = staged(ways.groupBy("i").agg(F.sum("x").alias("x")), "series-left")
    rate = left.agg(F.max("x")).first()[0] or 0.0
    weights = negative_binomial(model.gamma_shape, rate * model.tlen) if model.gamma_shape else poisson(rate * model.tlen)
    whole = spark.range(k**n).withColumnRenamed("id", "i")
    stay = whole.join(left, "i", "left").select("i", F.col("i").alias("j"), (1 - F.coalesce("x", F.lit(0.0)) / (rate or 1.0)).alias("x"))
    matrix = staged(ways.select("i", "j", (F.col("x") / (rate or 1.0)).alias("x")).union(stay).filter("x <> 0"), "series-matrix")
    inner, count = F.floor(F.col("i") / k**shape.leftwin) % k**shape.shortwin, k**shape.shortwin
    out = None
    for first in range(0, count, COLUMNS):
        names = [f"s{c}" for c in range(min(COLUMNS, count - first))]
        terms = [staged(whole.select("i", *(F.when(inner == first + c, 1.0).otherwise(0.0).alias(name) for c, name in enumerate(names))), "series-term")]
        for _ in weights[1:]:
            met = matrix.join(terms[-1].withColumnRenamed("i", "j"), "j")
            terms.append(staged(met.groupBy("i").agg(*(F.sum(F.col("x") * F.col(c)).alias(c) for c in names)), "series-term"))
        every = reduce(DataFrame.union, (t.select("i", *(F.col(c) * w for c in names)) for t, w in zip(terms, weights, strict=True)))
        every = every.toDF("i", *names).groupBy("i").agg(*(F.sum(c).alias(c) for c in names))
        part = staged(every.select("i", F.lit(first).alias("first"), F.array(*names).alias("p")), "series-part")
        discard(*terms)
        out = part if out is None else out.union(part)
    discard(ways, left, matrix)
    return out


def code(pattern: Column, bases: str, length: int) -> Column:
    """The number of a pattern."""
    return reduce(lambda a, b: a + b, ((F.instr(F.lit(bases), F.substring(pattern, k + 1, 1)) - 1).cast("long") * len(bases) ** k for k in range(length)))


def pattern(number: Column, bases: str, length: int) -> Column:
    return F.concat(*(F.substring(F.lit(bases), (digit(number, k, len(bases)) + 1).cast("int"), F.lit(1)) for k in range(length)))


def predicted(counts: DataFrame, model, shape: Shape | None = None) -> DataFrame:
    """long, short, count: the totals of the long patterns times the model's transitions to all short ones. Patterns outside the model's alphabet have no prediction."""
    shape = shape or model.shape
    n = model.shape.longwin
    totals = counts.filter(~F.col("long").rlike(f"[^{model.bases}]")).groupBy("long").agg(F.sum("count").alias("total"))
    rows = totals.withColumn("i", code(F.col("long"), model.bases, n)).join(transitions(counts.sparkSession, model, shape), "i")
    rows = rows.select("long", "total", "first", F.posexplode("p").alias("k", "p"))
    return rows.select("long", pattern(F.col("first") + F.col("k"), model.bases, shape.shortwin).alias("short"), (F.col("total") * F.col("p")).alias("count"))
