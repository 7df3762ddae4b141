"""Readers: text formats of alignments, positions and counts as DataFrames. Paths may be globs; .gz is read as it is."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.patterns import MOST_PATTERNS, patterns
from ..operators.model import Model
from ..operators.tmers import Shape, occurrences
from . import scan


def axt(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of an info line and two sequences, parted by blank lines; lines that start with # are skipped."""
    d = spark.read.option("lineSep", "\n\n").text(path)
    lines = F.filter(F.split("value", "\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#"))
    d = d.select(lines.alias("l")).filter(F.size("l") > 0)
    good = F.when(F.size("l") == 3, F.col("l")).otherwise(F.raise_error(F.concat(F.lit("not an AXT block: "), F.col("l")[0])).cast("array<string>"))
    d = d.select(good.alias("l")).select(F.split(F.trim(F.col("l")[0]), r"\s+").alias("f"), F.col("l")[1].alias("seq1"), F.col("l")[2].alias("seq2"))
    names = [("block_id", "long"), ("chrom", "string"), ("start", "long"), ("end", "long"), ("chrom2", "string"), ("start2", "long"), ("end2", "long"), ("strand", "string"), ("score", "long")]
    return d.select(*(F.get("f", i).try_cast(t).alias(n) for i, (n, t) in enumerate(names)), "seq1", "seq2")


def paired_fasta(spark: SparkSession, path: str, suffixes: list[str] = ()) -> DataFrame:
    """Records of four lines; the first header, less its suffix, must begin the second. Lines are numbered across the splits of a file, and records put together from them."""
    lines = scan.numbered(spark, path)
    part = lambda k: F.max(F.when(F.col("no") % 4 == k, F.trim("line")))
    d = lines.groupBy("file", F.floor(F.col("no") / 4).alias("rec")).agg(*(part(k).alias(c) for k, c in enumerate(("head1", "seq1", "head2", "seq2"))))
    base = reduce(lambda x, s: F.regexp_replace(x, f"\\Q{s}\\E$", ""), suffixes, F.col("head1"))
    ok = F.coalesce(F.startswith("head2", base), F.lit(False))
    seq2 = F.when(ok, F.col("seq2")).otherwise(F.raise_error(F.concat(F.lit("headers do not match: "), F.col("head1"))))
    return d.select("head1", "seq1", "head2", seq2.alias("seq2"))


def positions(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end; further fields are ignored, fewer are an error."""
    d = spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"), "value")
    ok = F.when(F.size("f") >= 3, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.col("value"))).cast("array<string>"))
    return d.select(ok.alias("f")).select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"))


def counts_header(spark: SparkSession, path: str) -> dict | None:
    """What a first line `# {...}` says."""
    first = spark.read.text(path).limit(1).collect()
    return json.loads(first[0][0][1:]) if first and first[0][0].startswith("#") else None


def counts(spark: SparkSession, path: str, leftwin: int | None = None, sum_duplicates: bool = False, skip: int = 0) -> tuple[DataFrame, Shape]:
    """A table of long patterns, short patterns and counts, and its shape (from the patterns; the header says leftwin only). skip: lines at the top of each file that are left out, blank ones not counted."""
    leftwin = leftwin if leftwin is not None else (counts_header(spark, path) or {}).get("leftwin")
    if leftwin is None:
        raise ValueError("leftwin is neither given nor in the header")
    lines = scan.numbered(spark, path).filter(F.col("no") >= skip).select(F.col("line").alias("value")) if skip else spark.read.text(path)
    d = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    names = [x.strip('"') for x in d.first()["f"]]
    d = d.filter(F.col("f") != F.array(*map(F.lit, names))).select(*(F.regexp_replace(F.col("f")[i], '"', "").alias(n) for i, n in enumerate(names[:-1])), F.col("f")[len(names) - 1].cast("double").alias("count"))
    repeated = d.groupBy(*names[:-1]).agg(F.sum("count").alias("count"), F.count("*").alias("n"))
    if not sum_duplicates and not repeated.filter("n > 1").isEmpty():
        raise ValueError("a cell has several counts")
    row = d.select(F.length(names[0]).alias("a"), F.length(names[1]).alias("b")).first()
    return (repeated.drop("n") if sum_duplicates else d), Shape(row["a"], row["b"], leftwin)


def dense_counts(spark: SparkSession, path: str, leftwin: int | None = None, bases: str | None = None, longs: DataFrame | None = None, shorts: DataFrame | None = None, skip: int = 0, sum_duplicates: bool = False) -> tuple[DataFrame, Shape]:
    """Counts with a row for every long pattern and every combination of short ones (0 where the file has none), and the shape.

    bases: by default the letters of the long patterns. longs, shorts (pattern): by default all patterns of these letters. A
    pattern of the file that is not among them is an error, and so are more cells than an enumeration may have.
    """
    d, shape = counts(spark, path, leftwin, sum_duplicates, skip)
    names = d.columns[:-1]
    if bases is None:
        letters = d.select(F.explode(F.split(names[0], "")).alias("c")).filter("c <> ''").distinct()
        bases = "".join(sorted(r["c"] for r in letters.collect()))  # an alphabet
    wanted = [longs if longs is not None else patterns(spark, shape.longwin, bases), *[shorts if shorts is not None else patterns(spark, shape.shortwin, bases)] * (len(names) - 1)]
    wanted = [w.select(F.col("pattern").alias(n)) for w, n in zip(wanted, names, strict=True)]
    if math.prod(w.count() for w in wanted) > MOST_PATTERNS:
        raise ValueError("too many cells: use the patterns that occur instead")
    for name, w in zip(names, wanted, strict=True):
        odd = unknown_patterns(d, w.withColumnRenamed(name, "pattern"), name).first()
        if odd:
            raise ValueError(f"a pattern that is not among those wanted: {odd[0]}")
    grid = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), wanted)  # MOST_PATTERNS rows at most
    return grid.join(d, names, "left").select(*names, F.coalesce("count", F.lit(0.0)).alias("count")), shape


def model(spark: SparkSession, path: str) -> Model:
    """A model that writers.model has written."""
    fields = json.loads("".join(r["value"] for r in spark.read.text(path).collect()))  # one small document
    tuples = lambda x: tuple(map(tuples, x)) if isinstance(x, list) else x
    return Model(**{k: Shape(**v) if k == "shape" else tuples(v) for k, v in fields.items()})


def unknown_patterns(counts: DataFrame, patterns: DataFrame, column: str) -> DataFrame:
    return counts.join(patterns.select(F.col("pattern").alias(column)), column, "left_anti").select(column).distinct()


def multiple_alignment(spark: SparkSession, path: str, taxa: list[str] | None = None) -> DataFrame:
    """taxon, seq of PHYLIP files, sequential (a line for each taxon) or interleaved; spaces inside sequences are dropped.

    The head line of a file tells the taxa and sites. Line i of each block of as many lines as taxa goes on with taxon i, whose name only the
    first block has. A taxon with other than the number of sites, as in truncated files, is an error, and so is a file with other than its number of taxa. Lines of files without a head line are a taxon each.
    """
    lines = scan.numbered(spark, path)
    head = F.regexp_extract("line", r"^\s*(\d+)\s+(\d+)\s*$", 1), F.regexp_extract("line", r"^\s*(\d+)\s+(\d+)\s*$", 2)
    said = lines.filter(F.col("no") == 0).select("file", *(h.try_cast("long").alias(c) for h, c in zip(head, ("taxa", "sites"), strict=True)))
    after = said.join(F.broadcast(lines.groupBy("file").agg((F.count("*") - 1).alias("n"))), "file")
    short, more = after.agg(F.bool_or(F.col("n") < F.col("taxa")), F.bool_or(F.col("n") > F.col("taxa"))).first()
    if short:
        raise ValueError("an alignment has fewer taxa than its head line says")
    d = lines.join(F.broadcast(said), "file").filter((F.col("no") > 0) | F.col("taxa").isNull())
    at = F.col("no") - 1
    d = d.withColumns({"i": F.when(F.col("taxa").isNull(), F.col("no")).otherwise(at % F.greatest("taxa", F.lit(1))), "part": F.when(F.col("taxa").isNull(), F.lit(0)).otherwise(F.floor(at / F.greatest("taxa", F.lit(1))))})
    named = F.col("part") == 0
    d = d.withColumn("taxon", F.when(named, F.regexp_extract("line", r"^\s*(\S+)", 1)))
    d = d.withColumn("seq", F.regexp_replace(F.when(named, F.regexp_replace("line", r"^\s*\S+", "")).otherwise(F.col("line")), r"\s", ""))
    if more:  # else every taxon is a line
        parts = F.transform(F.sort_array(F.collect_list(F.struct("part", "seq"))), lambda x: x["seq"])
        d = d.groupBy("file", "i", "taxa", "sites").agg(F.max("taxon").alias("taxon"), F.concat_ws("", parts).alias("seq"))
    wrong = F.raise_error(F.concat(F.lit("not as many sites as the head line says: "), F.col("taxon")))
    d = d.withColumn("seq", F.when(F.col("sites").isNull() | (F.length("seq") == F.col("sites")), F.col("seq")).otherwise(wrong))
    d = d.select("taxon", "seq")
    return d.filter(F.col("taxon").isin(taxa)) if taxa else d


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, symbol of raw files: every byte is a symbol. Files are read in ranges."""
    d = scan.stretches(spark, path)
    return d.select("path", "before", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("k", "symbol")).select("path", (F.col("before") + F.col("k") + 1).alias("pos"), "symbol")


def raw_occurrences(spark: SparkSession, path: str, patterns: list[str], breaks: bool = True, joined: bool = False, **sizes) -> DataFrame:
    """path, pattern, pos: where patterns stand in raw files, overlapping; see scan.stretches."""
    k = max(map(len, patterns))
    d = scan.stretches(spark, path, k, breaks, joined, **sizes)
    return occurrences(d, "seq", patterns, ["path", "before", "n"]).filter("pos <= n").select("path", "pattern", (F.col("before") + F.col("pos")).alias("pos"))


def table(spark: SparkSession, path: str, columns: int = 3) -> DataFrame:
    d = spark.read.csv(path, sep="\t", header=True)
    return d.select(*d.columns[:columns])


def coding_regions(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """start, end of the distinct CDS features of a chromosome in a GFF file."""
    d = spark.read.csv(path, sep="\t", comment="#")
    return d.filter((F.col("_c0") == chrom) & (F.col("_c2") == "CDS")).select(F.col("_c3").cast("long").alias("start"), F.col("_c4").cast("long").alias("end")).distinct()


def single_changes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, ref, alt of the single-letter rows of a VCF file."""
    d = spark.read.csv(path, sep="\t", comment="#")
    return d.filter((F.length("_c3") == 1) & (F.length("_c4") == 1)).select(F.col("_c0").alias("chrom"), F.col("_c1").cast("long").alias("pos"), F.col("_c3").alias("ref"), F.col("_c4").alias("alt"))


def with_name_parts(df: DataFrame, **patterns: str) -> DataFrame:
    """Attributes taken from the names of the files that rows come from."""
    return df.withColumns({k: F.regexp_extract(F.input_file_name(), p, 1) for k, p in patterns.items()})


def json_results(spark: SparkSession, path: str) -> DataFrame:
    """Many JSON documents as one table; what a document lacks is null, unreadable ones go."""
    d = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return d.filter(F.col("_bad").isNull()).drop("_bad") if "_bad" in d.columns else d


def saved(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
