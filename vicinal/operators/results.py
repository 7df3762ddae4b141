"""Collecting and summarising fits and chains."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import ranks

QUANTILES = (0.025, 0.25, 0.5, 0.75, 0.975)


def union_padded(tables: list[DataFrame]) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def by_schema(tables: list[DataFrame]) -> dict[str, DataFrame]:
    """Tables of equal column names, together."""
    groups: dict[str, list[DataFrame]] = {}
    for t in tables:
        groups.setdefault(",".join(t.columns), []).append(t)
    return {k: reduce(DataFrame.unionByName, v) for k, v in groups.items()}


def quantiles(df: DataFrame, key: str, value: str, qs: tuple = QUANTILES) -> DataFrame:
    names = [f"q{q * 100:g}".replace(".", "_") for q in qs]
    return ranks.quantiles(df, [key], value, qs).select(key, *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def boxplot(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles and whiskers: the last values within 1.5 times the spread of the quartiles."""
    q = ranks.quantiles(df, [key], value, (0.25, 0.5, 0.75))
    d = df.join(q, key)
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    v, lo, hi = F.col(value), F.col("q")[0] - reach, F.col("q")[2] + reach
    agg = d.groupBy(key).agg(F.min(F.when(v >= lo, v)).alias("low"), F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"), F.max(F.when(v <= hi, v)).alias("high"))
    return agg


def coverage(df: DataFrame, key: str) -> DataFrame:
    """Share of rows whose truth lies inside the 95 % and the 50 % interval."""
    inside = lambda a, b: F.avg(F.when(F.col("truth").between(F.col(a), F.col(b)), 1.0).otherwise(0.0))
    return df.groupBy(key).agg(inside("lo95", "hi95").alias("cover95"), inside("lo50", "hi50").alias("cover50"))


def diagnostics(df: DataFrame, key: str, value: str, truth: str) -> DataFrame:
    d = df.groupBy(key).agg(F.avg((F.col(value) <= F.col(truth)).cast("double")).alias("q_truth"), F.avg(value).alias("mean"))
    return d.join(ranks.quantiles(df, [key], value, (0.05, 0.25, 0.5, 0.75, 0.95)), key).select(key, "q_truth", "mean", *(F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q25", "med", "q75", "q95"))))


def trimmed(df: DataFrame, key: str, value: str, cut: float = 0.1, most: float = 4.0) -> DataFrame:
    """Rows within `most` trimmed standard deviations of the trimmed mean of their key."""
    q = ranks.quantiles(df, [key], value, (cut, 1 - cut))
    d = df.join(q, key)
    inner = F.when(F.col(value).between(F.col("q")[0], F.col("q")[1]), F.col(value))
    m = d.groupBy(key).agg(F.avg(inner).alias("m"), F.stddev_samp(inner).alias("s"))
    return df.join(m, key).filter(F.abs((F.col(value) - F.col("m")) / F.col("s")) < most).drop("m", "s")


def finite(df: DataFrame, value: str) -> DataFrame:
    """Rows whose value is a finite number."""
    return df.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))))


def reordered(df: DataFrame, *regexes: str) -> DataFrame:
    """Columns whose name matches the first pattern, then those of the next, each in order of name; the rest after them as they were."""
    seen: list[str] = []
    for r in regexes:
        seen += sorted(c for c in df.columns if re.search(r, c) and c not in seen)
    return df.select(*seen, *(c for c in df.columns if c not in seen))


def merged(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows whose keys are in all tables, with the columns of each."""
    return reduce(lambda a, b: a.join(b, keys), tables)


def zipped(a: DataFrame, b: DataFrame, order_a: list, order_b: list) -> DataFrame:
    """Row k of a beside row k of b, by their orders; rows without a partner go. Columns must differ in name."""
    a, b = ranks.ranked(a, order_a, place="_row"), ranks.ranked(b, order_b, place="_row")
    return a.join(b, "_row").drop("_row")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*").select(*df.columns)


def without_empty(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row."""
    n = df.agg(*(F.count(c).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if n[c]))


def column_chunks(df: DataFrame, width: int) -> list[DataFrame]:
    return [df.select(*df.columns[i : i + width]) for i in range(0, len(df.columns), width)]


def thinned(df: DataFrame, step: str, every: int) -> DataFrame:
    return df.filter(F.col(step) % every == 0)


def thinned_to(df: DataFrame, order: list[str], most: int = 1000) -> DataFrame:
    """Every k-th row in the order, from the first one on, k the least that leaves `most` rows."""
    every = max(1, -(-df.count() // most))
    return ranks.ranked(df, [F.col(c) for c in order], place="_place").filter((F.col("_place") - 1) % every == 0).drop("_place")


def after_burn_in(df: DataFrame, step: str, first: int, last: int | None = None) -> DataFrame:
    return df.filter(F.col(step) >= first if last is None else F.col(step).between(first, last))
