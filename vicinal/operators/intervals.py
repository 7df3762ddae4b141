"""Positions and intervals: range and overlap joins that never compare everything with everything.

Bins come in a ladder of widths, each FACTOR times the one before. An interval lies in bins of the first width that is
not below its length, so in two at most, however long it is. A position or a shorter interval looks into the one or two bins that it
touches on each width in use; bins are joined by equality, and the exact condition follows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

#: The narrowest bins and how much wider the next ones are, as powers of two; how many widths there are (the last is 2 ** 62).
WIDTH, FACTOR, RUNGS = 8, 3, 19


def bin_of(x: Column, rung: Column) -> Column:
    """The bin in which a position lies."""
    return F.call_function("shiftright", x.cast("long"), (WIDTH + FACTOR * rung).cast("int"))


def rung(size: Column) -> Column:
    """The first width that is not below a size."""
    last = F.lit(RUNGS - 1)
    return reduce(lambda out, k: F.when(size <= 1 << WIDTH + FACTOR * k, F.lit(k)).otherwise(out), reversed(range(RUNGS - 1)), last)


def binned(df: DataFrame, start: str, end: str) -> DataFrame:
    """Half-open intervals, a row for each of their one or two bins: _rung, _bin."""
    d = df.filter(F.col(start) < F.col(end)).withColumn("_rung", rung(F.col(end) - F.col(start)))
    lo, hi = (bin_of(x, F.col("_rung")) for x in (F.col(start), F.col(end) - 1))
    return d.withColumn("_bin", F.explode(F.array_distinct(F.array(lo, hi))))


def rungs(binned: DataFrame) -> list[int]:
    """The widths in use, at most RUNGS of them."""
    return sorted(r["_rung"] for r in binned.select("_rung").distinct().collect())


def probing(df: DataFrame, start: Column, end: Column, used: list[int], above: Column | None = None) -> DataFrame:
    """df, a row for each bin that [start, end) touches on each width in use above rung `above` (of the row; else on all): two a width at most where the width is not below its length."""
    places = [F.struct(F.lit(k).alias("r"), bin_of(x, F.lit(k)).alias("b")) for k in used for x in (start, end - 1)]
    spots = F.array_distinct(F.array(*places)) if places else F.array().cast("array<struct<r:int,b:bigint>>")
    spots = spots if above is None else F.filter(spots, lambda s: s["r"] > above)
    return df.withColumn("_p", F.explode(spots)).withColumns({"_rung": F.col("_p.r"), "_bin": F.col("_p.b")}).drop("_p")


def coding_frames(positions: DataFrame, cds: DataFrame, keys: list[str] = ()) -> DataFrame:
    """positions (keys, pos) with coding (whether in an interval of cds (keys, start, end)) and frame ((pos - start) mod 3) in the first one that covers it."""
    c = binned(cds.select(*keys, "start", "end").distinct(), "start", "end")
    p = probing(positions.distinct(), F.col("pos"), F.col("pos") + 1, rungs(c))
    hit = p.join(c, [*keys, "_rung", "_bin"]).filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
    first = hit.groupBy(*keys, "pos").agg(F.min(F.struct("start", "end")).alias("x"))
    out = positions.join(first, [*keys, "pos"], "left")
    return out.select(*positions.columns, F.col("x").isNotNull().alias("coding"), F.pmod(F.col("pos") - F.col("x.start"), F.lit(3)).alias("frame"))


def overlaps(blocks: DataFrame, regions: DataFrame, key: str = "chrom", inclusive: bool = False) -> DataFrame:
    """Pairs of a block and a region of the same key that overlap, with the part of the block that lies inside, half-open (inclusive: closed, so one base longer).

    The one of a pair that is of the narrower width looks into the bins of the other.
    """
    b = blocks.withColumnsRenamed({"start": "b_start", "end": "b_end"}).filter("b_start < b_end")
    r = regions.withColumnsRenamed({"start": "r_start", "end": "r_end"}).filter("r_start < r_end")
    inb, inr = binned(b, "b_start", "b_end"), binned(r, "r_start", "r_end")
    start, end = F.greatest("b_start", "r_start"), F.least("b_end", "r_end")
    probes = probing(b, F.col("b_start"), F.col("b_end"), rungs(inr), rung(F.col("b_end") - F.col("b_start")) - 1), probing(r, F.col("r_start"), F.col("r_end"), rungs(inb), rung(F.col("r_end") - F.col("r_start")))
    met = probes[0].join(inr, [key, "_rung", "_bin"]).unionByName(probes[1].join(inb, [key, "_rung", "_bin"]))
    d = met.filter(start < end).filter(bin_of(start, F.col("_rung")) == F.col("_bin"))  # in the first common bin only
    d = d.select(key, *(c for c in (*b.columns, *r.columns) if c != key))
    return d.withColumn("start", start).withColumn("end", end + (1 if inclusive else 0))


def clipped(d: DataFrame, seqs: list[str]) -> DataFrame:
    """The sequences of a block cut to the overlap."""
    return d.withColumns({s: F.substring(F.col(s), (F.col("start") - F.col("b_start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) for s in seqs})


def first_matches(df: DataFrame, dim: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Left join with the first row of each key of the dimension."""
    one = dim.withColumn("_n", F.row_number().over(W.partitionBy(*on).orderBy(*order))).filter("_n = 1").drop("_n")
    return df.join(one, on, "left")
