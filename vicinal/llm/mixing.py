"""Mixing sources to target weights [native].

Each source gets a share of all words by its weight. Within a source the rows are sorted by a hash-random
key, cut into ranges of that key, and a distributed prefix sum of word counts (range totals, then a running
sum inside each range) tells where the source's budget ends. A budget above the source's size repeats it.

Cases: a null text has size 0; rows of size 0 take nothing; the null source is a source of its own, last in
order; the key is a hash of doc_id and text, so null or repeated doc_ids do not gather in one range unless their texts
are equal too; equal rows (same doc_id and text) get spans one after the other; an empty table gives an empty result.
Only doc_id, text and source are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from .common import BIN_ROWS, WORD, bin_offsets, key_bin, ranked, shuffle_key, small_side, source_key, staged

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source (skey, n_rows, source_size) with its target.

    Water filling: sources in order of cap per weight; the first one that its share does not overfill, and
    all after it, share by weight what the capped ones leave.
    """
    by_name = [F.col("skey") == "", F.col("skey")]
    d = ranked(sizes, by_name, [], "mix-names")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int")).cast("long")
    d = d.select("skey", "n_rows", "source_size", weight.alias("w"), (F.lit(most) * F.col("source_size")).alias("cap"))
    d = ranked(d, [F.col("cap") / F.col("w"), *by_name], ["cap", "w"], "mix-room")
    size, w = d.agg(F.sum("source_size"), F.sum("w")).first()
    d = d.withColumns({"left": F.lit(size or 0) - F.col("cap_before"), "w_left": F.lit(w or 0) - F.col("w_before")})
    fits = F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left")
    place, left, w_left = d.agg(F.min(F.when(fits, F.struct("_place", "left", "w_left"))).alias("x")).select("x.*").first()
    share = F.col("w").cast("double") * F.lit(left).cast("double") / F.lit(w_left).cast("double")
    target = F.when(F.col("_place") < F.lit(place), F.col("cap").cast("double")).otherwise(share)
    return d.select("skey", "n_rows", "source_size", target.alias("target"))


def _keyed(docs: DataFrame, keep: tuple, seed: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, source_key(F.col("source")).alias("skey"), shuffle_key(seed, F.col("doc_id"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("_key"), size.alias("size"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns to keep, then size, source_size, target, taken, epochs (whole passes over the source before the cut one)."""
    rows = staged(_keyed(docs, ("doc_id",), seed), "mix-rows")
    sums = rows.groupBy("skey").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    targets = small_side(source_targets(sums, weights, most), "mix-sources")
    binned = lambda x: x.join(targets, "skey").withColumn("bin", key_bin(F.col("_key"), F.ceil(F.col("n_rows") / BIN_ROWS)))
    offsets = bin_offsets(binned(rows).groupBy("skey", "bin").agg(F.sum("size").alias("size")), ["skey"], "bin", ["size"])
    d = binned(rows if keep == ("doc_id",) else _keyed(docs, keep, seed))
    run = W.partitionBy("skey", "bin").orderBy("_key", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.join(offsets, ["skey", "bin"]).withColumn("before", F.col("size_before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    budget = F.floor(F.col("target") + 0.5)
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size")
    cut = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return d.select(*keep, "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"), "epochs")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix, with the columns of docs: each as often as it is taken whole; the row that the cut goes through counts as taken if at least half of it is."""
    renamed = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    at = {c: F.col(f"_{i}") for i, c in enumerate(docs.columns)}
    d = mix(renamed.select(*renamed.columns, *(at[c].alias(c) for c in ("doc_id", "text", "source"))), keep=tuple(renamed.columns), **how)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return d.withColumn("_times", F.explode(F.array_repeat(F.lit(1), times))).select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)))


def op1(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents")).drop("epochs")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(cast(doc_id AS varchar), 'null') || ':' || md5(coalesce(text, ''))) AS key,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, row_number() OVER r AS i,
             (sum(source_size) OVER () - coalesce(sum(cap) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS lft,
             (sum(w) OVER () - coalesce(sum(w) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS w_left
      FROM w WINDOW r AS (ORDER BY cap::double / w, source NULLS LAST)),
f AS (SELECT i AS fi, lft AS fl, w_left AS fw FROM o WHERE lft * w <= cap * w_left ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN i < fi THEN cap::double ELSE w::double * fl / fw END AS target FROM o, f),
c AS (SELECT d.*, t.source_size, t.target, floor(target + 0.5)::bigint AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM c)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(budget - epochs * source_size - before, 0), size))::bigint AS taken FROM e
"""
