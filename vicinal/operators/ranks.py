"""Places in an order, and exact quantiles, without all rows of a key in one task.

Rows are range-partitioned by the whole order and written; a place is the rows of the ranges before, from the counts of
ranges, plus the place within the range. Rows that tie in the whole order share a range. Quantiles need no rows, only
values: equal values of a key are one row with a count, summed before they are sent, so a value that most rows have costs no
more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..staging import staged

#: Rows of a range, about, and most ranges whose counts are broadcast.
RANGE_ROWS, MOST_BROADCAST = 1 << 18, 100_000


def ranked(df: DataFrame, order: list[Column], keys: list[str] = (), place: str = "place", total: str | None = None) -> DataFrame:
    """df with the place of each row in the order, from 1, within its keys; total: a column for the number of rows of the keys."""
    parts = max(1, -(-df.count() // RANGE_ROWS))
    d = staged(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranks")
    counts = d.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(over.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_r"), before.alias("_before"), F.sum("_n").over(over).alias("_total"))
    counts = F.broadcast(counts) if not keys and parts <= MOST_BROADCAST else counts
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order))
    out = d.withColumn("_within", within).join(counts, same).withColumn(place, (F.col("_before") + F.col("_within")).cast("long"))
    more = [F.col("_total").alias(total)] if total else []
    return out.select(*df.columns, place, *more)


def cumulative(df: DataFrame, keys: list[str], order: list[str], weight: str) -> DataFrame:
    """df with _before, the sum of the weights of the earlier rows of its keys, and _total, that of all; the order's rows in ranges, so no key is in one task. Weights must be there."""
    d = staged(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranks")
    ranges = d.groupBy(*keys, "_range").agg(F.sum(weight).alias("_n"))
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    first = F.coalesce(F.sum("_n").over(over.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_r"), first.alias("_first"), F.sum("_n").over(over).alias("_total"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.coalesce(F.sum(weight).over(W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("_within", within).join(ranges, same).withColumn("_before", F.col("_first") + F.col("_within"))
    return d.select(*df.columns, "_before", "_total")


def systematic(df: DataFrame, keys: list[str], order: list[str], weight: str, n: int) -> DataFrame:
    """df, draw: of each key the row at each of n evenly spaced points of its summed weights, k / (n + 1) of the total for draw k. A row is drawn as often as points fall into its share; the order must tell rows apart."""
    d = cumulative(df.filter(F.col(weight) > 0), keys, order, weight)
    upto = lambda x: F.floor(x * (n + 1) / F.col("_total"))
    lo, hi = upto(F.col("_before")) + 1, F.least(upto(F.col("_before") + F.col(weight)), F.lit(n))
    return d.filter(lo <= hi).withColumn("draw", F.explode(F.sequence(lo, hi))).select(*df.columns, "draw")


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, qs: tuple) -> DataFrame:
    """keys, q (an array): exact quantiles, interpolated linearly, where a row stands for `weight` (a whole number) rows of its value; keys without values have none."""
    d = df.select(*keys, F.col(value).alias("_v"), F.col(weight).cast("long").alias("_w")).filter("_v IS NOT NULL AND _w > 0")
    d = cumulative(d.groupBy(*keys, "_v").agg(F.sum("_w").alias("_w")), keys, ["_v"], "_w")
    last = F.col("_before") + F.col("_w")

    def share(q: float):
        """How much of the value the quantile takes: those of the two places around it that the value holds."""
        at = (F.col("_total") - 1) * F.lit(float(q)) + 1
        low = F.floor(at)
        held = lambda p: (F.col("_before") < p) & (p <= last)
        return F.when(held(low), 1 - (at - low)).otherwise(0.0) + F.when(held(low + 1), at - low).otherwise(0.0)

    shares = F.array(*(share(q) for q in qs))
    d = d.select(*keys, "_v", shares.alias("_s")).filter(F.exists("_s", lambda x: x > 0))  # two values at most for each quantile of a key
    return d.groupBy(*keys).agg(F.array(*(F.sum(F.when(F.col("_s")[i] > 0, F.col("_v") * F.col("_s")[i]).otherwise(0.0)) for i in range(len(qs)))).alias("q"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: tuple) -> DataFrame:
    """keys, q (an array): exact quantiles of the values that are there, interpolated linearly; keys without values have none."""
    return weighted_quantiles(df.withColumn("_one", F.lit(1)), keys, value, "_one", qs)
