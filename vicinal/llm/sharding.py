"""Sharding by proportional stratified interleaving [native].

Rows of a source are ranked in a seeded shuffle; rank r of n becomes the fraction (2r + 1) / 2n; all rows
sorted by that fraction interleave the sources in proportion, and equal cuts of the order are the shards.
So every shard holds each source's share to within about a row, and shard counts differ by one at most
(law `rows`). Ranks come from counts of key ranges plus row numbers inside a range: no source is sorted in
one task.

Cases: a null text has no bytes (size 1, crc of nothing: 0); the null source is a source of its own; equal
rows get different slots; the key is a hash of doc_id, size and CRC, so null or repeated doc_ids do not gather in one
range unless their texts are equal too; an empty table gives an empty result; only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from .common import BIN_ROWS, bin_offsets, key_bin, shuffle_key, small_side, source_key, staged

SHARDS = 8
SEED = "shard"


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (in the shard), grown_shard (null: the law is not `key`)."""
    rows = staged(
        docs.select(
            "doc_id",
            source_key(F.col("source")).alias("skey"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        ).withColumn("key", shuffle_key(seed, F.col("doc_id"), F.col("size"), F.col("text_crc32"))),
        "shard-rows",
    )
    sources = small_side(rows.groupBy("skey").agg(F.count("*").alias("n_s")), "shard-sources")
    d = rows.join(sources, "skey").withColumn("bin", key_bin(F.col("key"), F.ceil(F.col("n_s") / BIN_ROWS)))
    offsets = bin_offsets(d.groupBy("skey", "bin").agg(F.count("*").alias("n")), ["skey"], "bin", ["n"])
    ties = ["key", "doc_id", "size", "text_crc32"]
    rank = F.col("n_before") + F.row_number().over(W.partitionBy("skey", "bin").orderBy(*ties)) - 1
    d = staged(d.join(offsets, ["skey", "bin"]).withColumn("at", (2 * rank + 1) / (2 * F.col("n_s"))).drop("bin", "n_before", "n_s"), "shard-ranks")
    total = d.count()
    d = d.withColumn("bin", F.floor(F.col("at") * max(1, -(-total // BIN_ROWS))).cast("long"))
    offsets = bin_offsets(d.groupBy("bin").agg(F.count("*").alias("n")), [], "bin", ["n"])
    place = F.col("n_before") + F.row_number().over(W.partitionBy("bin").orderBy("at", "skey", *ties)) - 1
    d = d.join(offsets, "bin").withColumn("place", place).withColumn("shard", F.floor(F.col("place") * shards / F.lit(max(1, total))).cast("int"))
    slot = F.col("place") - F.ceil(F.col("shard").cast("long") * max(1, total) / F.lit(shards))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3(spark, sf_dir):
    from .common import table

    return shard(table(spark, sf_dir, "documents"))


# CRC-32 as SQL: one table step a byte, the table built from the polynomial.
ORACLE = r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
e AS (SELECT doc_id, source, strlen(coalesce(text, ''))::bigint + 1 AS size,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(
    list_prepend(4294967295::bigint, [('0x' || h)::bigint FOR h IN regexp_extract_all(hex(encode(text)), '..')]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END::bigint AS text_crc32 FROM documents, tab),
d AS (SELECT *, md5('shard:' || coalesce(cast(doc_id AS varchar), 'null') || ':' || size || ':' || text_crc32) AS key FROM e),
r AS (SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size, text_crc32) - 1) + 1)::double
             / (2 * count(*) OVER (PARTITION BY source)) AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, coalesce('=' || source, ''), key, doc_id, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM r),
s AS (SELECT *, floor(place * 8 / total)::int AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, (place - ceil(shard::bigint * total / 8))::bigint AS slot, NULL::int AS grown_shard FROM s
"""
