"""What the operators of this subpackage share: tables, bounded broadcasts, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from ..staging import discard, staged

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a side that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 10_000
#: Rows of texts that a task works on, and gives out, at once.
ROWS_AT_ONCE = 1024
#: Rows aimed at in one bin of a distributed sort.
BIN_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, order: list, values: list[str], tag: str) -> DataFrame:
    """df staged, with its place in the order (from 1) as _place, and for each value the sum over the rows before as <value>_before.

    The order must tell all rows apart. Rows are cut into ranges of the order, so no task holds more than a range.
    """
    parts = max(1, -(-df.count() // BIN_ROWS))
    d = df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id().cast("long"))
    d = staged(d.withColumn("_place", F.lit(1).cast("long")), tag)
    sums = d.groupBy("_range").agg(*(F.sum(v).alias(v) for v in (*values, "_place")))
    offsets = bin_offsets(sums, [], "_range", [*values, "_place"])
    before = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    total = lambda v: F.col(f"{v}_before") + F.coalesce(F.sum(v).over(before), F.lit(0))
    out = d.join(offsets, "_range").withColumns({f"{v}_before": total(v) for v in values} | {"_place": total("_place") + 1})
    return out.drop("_range", "_place_before")


def small_side(df: DataFrame, tag: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df staged and, if it has at most `most` rows, marked for a broadcast."""
    out = staged(df, tag)
    return F.broadcast(out) if out.count() <= most else out


def source_key(source: Column) -> Column:
    """A join key without nulls that tells the null source from every other."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def shuffle_key(seed: str, doc_id: Column, *more: Column) -> Column:
    """The seeded hash-random sort key of a row: 32 hex digits that DuckDB computes alike. more: what tells rows of one doc_id apart."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), *(m.cast("string") for m in more)))


def key_bin(key: Column, bins: Column) -> Column:
    """The range of the key among `bins` equal ranges of its first 24 bits."""
    return F.floor(F.conv(F.substring(key, 1, 6), 16, 10).cast("long") * bins / F.lit(1 << 24)).cast("long")


def bin_offsets(bins: DataFrame, parts: list[str], at: str, values: list[str], span: int = 1024) -> DataFrame:
    """For each bin the sums of the earlier bins of its part, as <value>_before, in two levels: no window holds more than `span` bins and the sums of the others."""
    wide = bins.withColumn("_span", F.floor(F.col(at) / span))
    tops = wide.groupBy(*parts, "_span").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    over = (W.partitionBy(*parts) if parts else W.partitionBy(F.lit(0))).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*parts, "_span", *(F.coalesce(F.sum(f"_{v}").over(over), F.lit(0)).alias(f"_{v}") for v in values))
    within = W.partitionBy(*parts, "_span").orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    return wide.join(tops, [*parts, "_span"]).select(
        *parts, at, *((F.col(f"_{v}") + F.coalesce(F.sum(v).over(within), F.lit(0))).alias(f"{v}_before") for v in values)
    )


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts: the fold of a document. Null for a null doc_id."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % parts


def text_bytes(column):
    """The UTF-8 bytes of an Arrow string column and the offsets of its rows; a null is an empty text."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def returned(batches, rows: int = ROWS_AT_ONCE):
    """The batches, Arrow ones in slices of so many rows; when they end, or the task does, memory goes back to the system."""
    try:
        for b in batches:
            if hasattr(b, "num_rows"):
                yield from (b.slice(lo, rows) for lo in range(0, b.num_rows, rows))
            else:
                yield b
    finally:
        give_back()


def give_back() -> None:
    """At the end of a task: what a reused worker process no longer needs goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
