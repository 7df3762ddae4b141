"""Observed against expected counts, and what stands out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..functions.sequences import flanks_lowered, hamming, reverse_complement
from . import ranks
from .generator import few


def z_score(resid: Column, expected: Column, longwin: int) -> Column:
    """Windows overlap, so the variance is longwin times the expected count."""
    return F.when(expected > 0, resid / F.sqrt(expected * longwin))


def pearson(observed: Column, expected: Column) -> Column:
    return F.when(expected > 0, (observed - expected) / F.sqrt(expected))


def residuals(observed: DataFrame, expected: DataFrame, longwin: int, keys: list[str] = ("long", "short")) -> DataFrame:
    """inpat, outpat, observed, expected, resid, z; a cell missing on one side counts 0 there."""
    d = observed.withColumnRenamed("count", "observed").join(expected.withColumnRenamed("count", "expected"), list(keys), "full")
    o, e = F.coalesce("observed", F.lit(0)).cast("double"), F.coalesce("expected", F.lit(0.0))
    d = d.select(F.col(keys[0]).alias("inpat"), F.col(keys[1]).alias("outpat"), o.alias("observed"), e.alias("expected"))
    d = d.withColumn("resid", F.col("observed") - F.col("expected"))
    return d.withColumn("z", z_score(F.col("resid"), F.col("expected"), longwin))


def merged_complements(resids: DataFrame, longwin: int, leftwin: int, shortwin: int) -> DataFrame:
    """Each pattern pair together with its reverse complement, the smaller one standing for both; a pair that is its own counts once."""
    if longwin - shortwin - leftwin != leftwin:
        raise ValueError("reverse complements need equal overhangs")
    rc = [reverse_complement("inpat"), reverse_complement("outpat")]
    me, other = F.struct(F.col("inpat").alias("a"), F.col("outpat").alias("b")), F.struct(rc[0].alias("a"), rc[1].alias("b"))
    d = resids.select(F.least(me, other).alias("k"), "observed", "expected").groupBy("k").agg(F.sum("observed").alias("observed"), F.sum("expected").alias("expected"))
    d = d.select(F.col("k.a").alias("inpat"), F.col("k.b").alias("outpat"), "observed", "expected", (F.col("observed") - F.col("expected")).alias("resid"))
    return d.withColumn("z", z_score(F.col("resid"), F.col("expected"), longwin))


def listed(resids: DataFrame, leftwin: int, shortwin: int, trim: float = 20.0) -> DataFrame:
    """Residuals beyond trim standard deviations, flanks in lower case."""
    return resids.filter(F.abs("z") > trim).withColumn("inpat", flanks_lowered("inpat", leftwin, shortwin))


def extremes(df: DataFrame, by: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows with the highest and the k with the lowest value."""
    top = df.orderBy(F.desc(by), *ties).limit(k)
    low = df.orderBy(F.asc(by), *ties).limit(k)
    return top.union(low).distinct()


def above_quantile(df: DataFrame, by: str, q: float) -> DataFrame:
    found = ranks.quantiles(df, [], by, (q,)).first()
    return df.filter(F.col(by) > F.lit(found["q"][0] if found else None).cast("double"))


def motif(patterns: DataFrame, pattern: str, weight: str, keys: list[str] = ()) -> DataFrame:
    """The consensus of weighted patterns: a symbol above 75 % in upper case, above 50 % in lower case, else a dot."""
    d = patterns.select(*keys, F.posexplode(F.split(pattern, "")).alias("site", "c"), F.col(weight).alias("w")).filter("c <> ''")
    d = d.groupBy(*keys, "site", "c").agg(F.sum("w").alias("w"))
    d = d.withColumn("share", F.col("w") / F.sum("w").over(W.partitionBy(*keys, "site")))
    best = d.groupBy(*keys, "site").agg(F.max(F.struct("share", "c")).alias("x"))
    sign = F.when(F.col("x.share") > 0.75, F.upper("x.c")).when(F.col("x.share") > 0.5, F.lower("x.c")).otherwise(".")
    site = best.select(*keys, F.struct("site", sign.alias("c")).alias("s"))
    return site.groupBy(*keys).agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list("s")), lambda s: s["c"])).alias("motif"))


def motif_samples(patterns: DataFrame, pattern: str, weight: str, keys: list[str] = (), n: int = 24) -> DataFrame:
    """keys, draw, motif: n patterns whose symbols at each site are in proportion to their weights there (count times sum): at each site, symbols in order, those at evenly spaced points of the summed weights."""
    d = patterns.select(*keys, F.posexplode(F.split(pattern, "")).alias("site", "c"), F.col(weight).alias("_w")).filter("c <> ''")
    d = d.groupBy(*keys, "site", "c").agg((F.count("*") * F.sum("_w")).alias("w"))
    d = ranks.systematic(d, [*keys, "site"], ["c"], "w", n)
    return d.groupBy(*keys, "draw").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("site", "c"))), lambda s: s["c"])).alias("motif"))


def weighted_table(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Count times the sum of the weights of each value."""
    return df.groupBy(value).agg((F.count("*") * F.sum(weight)).alias("weight"))


def clusters(top: DataFrame, k: int, most: int = 300) -> DataFrame:
    """pattern, cluster: complete linkage of the Hamming distances of the top patterns; more than `most` are an error."""
    import numpy as np

    from .linalg import complete_linkage

    p = top.select("pattern").distinct()
    if p.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} patterns to cluster: take fewer by residual")
    rows = p.alias("a").crossJoin(F.broadcast(p).alias("b")).select(F.col("a.pattern").alias("a"), F.col("b.pattern").alias("b"), hamming("a.pattern", "b.pattern").alias("d")).collect()
    names = sorted({r["a"] for r in rows})
    at, d = {n: i for i, n in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in rows:
        d[at[r["a"]], at[r["b"]]] = r["d"]
    found = complete_linkage(d, k) if names else []
    return top.sparkSession.createDataFrame([(n, int(c)) for n, c in zip(names, found, strict=True)], "pattern string, cluster int")


def ordered_clusters(resids: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, n, z of the residuals (pattern, z) by clusters (pattern, cluster): sizes and highest z; to be read in falling order of z."""
    return resids.join(clusters, "pattern").groupBy("cluster").agg(F.count("*").alias("n"), F.max("z").alias("z"))


def divergence(counts: DataFrame, leftwin: int, shortwin: int) -> DataFrame:
    changed = hamming(F.substring(F.col("long"), leftwin + 1, shortwin), "short")
    return counts.agg((F.sum(changed * F.col("count")) / (F.sum("count") * shortwin)).alias("divergence"))


def mutations(counts: DataFrame, rules: DataFrame, leftwin: int, shortwin: int, full_range: bool = False) -> DataFrame:
    """rate_id, observed, possible: windows in which a rule's pattern stands in the long pattern, and those of them with its replacement in the short one."""
    d = counts.withColumn("inner", F.substring(F.col("long"), leftwin + 1, shortwin)).crossJoin(few(rules))
    last = F.lit(shortwin) - F.length("from") + 1
    last = last if full_range else F.least(last, F.greatest(F.lit(shortwin - 1), F.lit(1)))
    d = d.filter(last >= 1).withColumn("k", F.explode(F.sequence(F.lit(1), last)))
    at = lambda c: F.substring(F.col(c), F.col("k"), F.length("from"))
    d = d.filter(at("inner") == F.col("from"))
    return d.groupBy("rate_id").agg(F.sum(F.when(at("short") == F.col("to"), F.col("count")).otherwise(0)).alias("observed"), F.sum(F.abs("count")).alias("possible"))
