"""Writers."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.model import Model
from ..operators.tmers import Shape


def counts(df: DataFrame, path: str, shape: Shape) -> None:
    """Parts of tab-separated counts, each under a header line of its own with the shape and one with the names."""
    head = "# " + json.dumps({"leftwin": shape.leftwin, "longwin": shape.longwin, "shortwin": shape.shortwin})
    columns = df.columns

    def lines(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [head, "\t".join(columns)]})
        for b in batches:
            yield pd.DataFrame({"value": b.astype(str).agg("\t".join, axis=1) if len(b) else []})

    df.mapInPandas(lines, "value string").write.text(path)


def frames(df: DataFrame, path: str) -> None:
    """A folder for each frame."""
    df.write.partitionBy("frame").parquet(path)


def paired(df: DataFrame, path: str) -> None:
    """reference, derived, count without the keys that hold N, a folder for each direction."""
    d = df.filter(~F.contains("long", F.lit("N")) & ~F.contains("short", F.lit("N")))
    d.select(F.col("long").alias("reference"), F.col("short").alias("derived"), "count", "direction").write.partitionBy("direction").csv(path, sep="\t", header=True)


def residuals(df: DataFrame, path: str) -> None:
    three = {c: F.round(c, 3) for c in ("observed", "expected", "resid", "z")}
    df.withColumns(three).write.csv(path, sep="\t", header=True)


def results(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def by_pattern(df: DataFrame, path: str) -> None:
    df.write.partitionBy("pattern").option("compression", "gzip").csv(path)


def model(spark: SparkSession, m: Model, path: str) -> None:
    """A model with its rates as a small JSON document."""
    spark.createDataFrame([(json.dumps(dataclasses.asdict(m)),)], "value string").coalesce(1).write.text(path)


def config(values: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(values, f, indent=1)
