"""Sparse Markov generators from rewriting rules, as coordinate tables.

A generator is a table of the ways in which a rule turns one pattern into another (gen_mut), a table of weighted
selection matches of the patterns, and their join with rates and coefficients. The diagonal is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.sequences import wrap_overwrite, wrap_substring

#: Most rows of a table of rules that is broadcast.
MOST_RULES = 10_000


def few(rules: DataFrame) -> DataFrame:
    """A table of rules, a model's configuration, marked for a broadcast; more rows than a configuration has are an error."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return F.broadcast(rules)


def applied(patterns: DataFrame, rules: DataFrame, boundary: str = "none") -> DataFrame:
    """i, j, rate_id, n: in how many ways the rules of a rate turn pattern i into j. boundary wrap: patterns are circles.

    The rule table is small by nature (a model's configuration), the pattern table may not be.
    """
    n, k = F.length("pattern"), F.length("from")
    d = patterns.select("pattern").crossJoin(few(rules.filter(F.length("from") == F.length("to"))))
    last = n if boundary == "wrap" else n - k + 1
    d = d.filter((last >= 1) & (k <= n)).withColumn("s", F.explode(F.sequence(F.lit(1), last)))
    if boundary == "wrap":
        d = d.filter(wrap_substring("pattern", F.col("s"), F.col("s") + F.length("from") - 1) == F.col("from"))
        j = wrap_overwrite("pattern", F.col("s"), F.col("to"))
    else:
        d = d.filter(F.substring(F.col("pattern"), F.col("s"), F.length("from")) == F.col("from"))
        j = F.overlay(F.col("pattern"), F.col("to"), F.col("s"))
    return d.select(F.col("pattern").alias("i"), j.alias("j"), "rate_id").filter("i <> j").groupBy("i", "j", "rate_id").agg(F.count("*").alias("n"))


def selection(patterns: DataFrame, selpats: DataFrame, boundary: str = "none") -> DataFrame:
    """pattern, sel_id, weight: weighted matches of selpats (sel_id, selpat, factor)."""
    d = patterns.select("pattern").crossJoin(few(selpats))
    n, k = F.length("pattern"), F.length("selpat")
    last = n if boundary == "wrap" else n - k + 1
    d = d.filter((last >= 1) & (k <= n)).withColumn("s", F.explode(F.sequence(F.lit(1), last)))
    at = wrap_substring("pattern", F.col("s"), F.col("s") + F.length("selpat") - 1) if boundary == "wrap" else F.substring(F.col("pattern"), F.col("s"), F.length("selpat"))
    return d.filter(at == F.col("selpat")).groupBy("pattern", "sel_id").agg(F.sum("factor").alias("weight"))


def differences(mut: DataFrame, sel: DataFrame) -> DataFrame:
    """i, j, sel_id, ds: selection of j less that of i, for the entries of mut; zeros are left out."""
    entries = mut.select("i", "j").distinct()
    plus = entries.join(sel.withColumnRenamed("pattern", "j"), "j").select("i", "j", "sel_id", F.col("weight").alias("w"))
    minus = entries.join(sel.withColumnRenamed("pattern", "i"), "i").select("i", "j", "sel_id", (-F.col("weight")).alias("w"))
    return plus.union(minus).groupBy("i", "j", "sel_id").agg(F.sum("w").alias("ds")).filter("ds <> 0")


def combined(mut: DataFrame) -> DataFrame:
    """Entries met several times: ways are summed."""
    return mut.groupBy("i", "j", "rate_id").agg(F.sum("n").alias("n"))


def averaged(sel: DataFrame) -> DataFrame:
    """Entries met several times: selection differences are averaged."""
    return sel.groupBy("i", "j", "sel_id").agg(F.avg("ds").alias("ds"))


def by_id(column: str, values: list[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, map(float, values))), F.col(column).cast("int") + 1)


def generator(mut: DataFrame, sel: DataFrame | None, rates: list[float], coefs: list[float] = (), fixfn=None) -> DataFrame:
    """i, j, x: the rate of each change times the multiplier of its selection difference."""
    x = mut.groupBy("i", "j").agg(F.sum(F.col("n") * by_id("rate_id", rates)).alias("x"))
    if not coefs or sel is None or fixfn is None:
        return x
    ds = sel.groupBy("i", "j").agg(F.sum(F.col("ds") * by_id("sel_id", coefs)).alias("ds"))
    return x.join(ds, ["i", "j"], "left").select("i", "j", (F.col("x") * fixfn(F.coalesce("ds", F.lit(0.0)))).alias("x"))


def mean_over_flanks(entries: DataFrame, value: str, ident: str, left: int, right: int, bases: int) -> DataFrame:
    """Entries between the inner patterns, averaged over the flanking symbols that are not seen."""
    inner = lambda c: F.substring(F.col(c), F.lit(left + 1), F.length(c) - (left + right)).alias(c)
    d = entries.select(inner("i"), inner("j"), ident, value).filter("i <> j")
    return d.groupBy("i", "j", ident).agg((F.sum(value) / float(bases ** (left + right))).alias(value))


def mean_generator(mut: DataFrame, sel: DataFrame | None, left: int, right: int, bases: int, rates: list[float], coefs: list[float] = (), fixfn=None) -> DataFrame:
    """i, j, x between the inner patterns: ways and selection differences are averaged first, the fixation function comes after."""
    ds = mean_over_flanks(sel, "ds", "sel_id", left, right, bases) if sel is not None else None
    return generator(mean_over_flanks(mut, "n", "rate_id", left, right, bases), ds, rates, coefs, fixfn)


def totals(gen: DataFrame) -> DataFrame:
    """Row sums: the rates at which patterns are left."""
    return gen.groupBy("i").agg(F.sum("x").alias("x"))
