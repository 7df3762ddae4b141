"""T-mer counts of alignment blocks that keep arriving: counts add up, so the running table is the batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.tmers import Shape, tmer_counts


def running_counts(spark: SparkSession, path: str, schema, shape: Shape, long: str, short: str) -> DataFrame:
    """A streaming DataFrame over Parquet files in a folder; write it in complete or update mode."""
    return tmer_counts(spark.readStream.schema(schema).parquet(path), shape, long, short)
