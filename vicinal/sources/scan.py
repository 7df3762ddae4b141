"""Large files in parts: byte ranges of raw symbol streams, and lines with their numbers across the splits of a file."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..staging import staged

#: Bytes of a file that one task reads, and of a row.
RANGE, ROW = 32 << 20, 1 << 16


class Ranges(DataSource):
    """Rows (file, path, range, lead, start, own, tail) of byte ranges: parts of the bytes of a range, lead symbols of which come before, and the `overlap` symbols that follow them.

    Options: path (a file, a folder or a pattern of names), overlap, range, row, breaks (whether line breaks are symbols), joined (whether files, in order of
    name, are one stream). Compressed files are read from their start, in rows, by one task each, and end by themselves.
    """

    @classmethod
    def name(cls) -> str:
        return "vicinal-ranges"

    def schema(self) -> str:
        return "file int, path string, range long, lead long, start long, own binary, tail binary"

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(dict(self.options))


def found(path: str):
    """The file system of a path, and its files with their sizes, in order of name."""
    from pyarrow import fs

    path = path if "://" in path or path.startswith("/") else path.replace("file:", "", 1)
    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    top, _, pattern = at.rpartition("/")
    if any(c in pattern for c in "*?["):
        files = [f for f in system.get_file_info(fs.FileSelector(top)) if fnmatch.fnmatch(f.base_name, pattern)]
    else:
        info = system.get_file_info(at)
        files = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    return system, sorted(((f.path, f.size) for f in files if f.is_file and not f.base_name.startswith(("_", "."))))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.overlap = options["path"], int(options.get("overlap", 0))
        self.range, self.row = int(options.get("range", RANGE)), int(options.get("row", ROW))
        self.breaks, self.joined = options.get("breaks", "true") == "true", options.get("joined", "false") == "true"
        _, self.files = found(self.path)  # once, on the driver

    def partitions(self) -> list[InputPartition]:
        out = []
        for k, (path, size) in enumerate(self.files):
            step = max(1, size) if packed(path) else self.range
            out += [InputPartition((k, start, min(size, start + step))) for start in range(0, size, step)]
        return out

    def symbols(self, data: bytes) -> bytes:
        return data if self.breaks else data.translate(None, b"\r\n")

    def after(self, system, k: int, at: int) -> bytes:
        """The symbols that follow byte `at` of file k."""
        out = b""
        while len(out) < self.overlap and k < len(self.files) and not packed(self.files[k][0]):
            path, size = self.files[k]
            with system.open_input_file(path) as f:
                while len(out) < self.overlap and at < size:
                    part = f.read_at(min(size - at, 2 * self.overlap + 64), at)
                    out, at = out + self.symbols(part), at + len(part)
            k, at = (k + 1 if self.joined else len(self.files)), 0
        return out[: self.overlap]

    def pieces(self, system, k: int, start: int, end: int) -> Iterator[tuple[int, bytes, bytes]]:
        path = self.files[k][0]
        if packed(path):
            with system.open_input_stream(path, compression="detect") as f:
                at, held = 0, []
                while True:
                    piece = f.read(self.row)
                    if piece:
                        held.append(self.symbols(piece))
                    while held and (not piece or sum(map(len, held[1:])) >= self.overlap):
                        own = held.pop(0)
                        yield at, own, b"".join(held)[: self.overlap]
                        at += 1
                    if not piece:
                        return
        with system.open_input_file(path) as f:
            for at in range(start, end, self.row):
                stop = min(end, at + self.row)
                yield at, self.symbols(f.read_at(stop - at, at)), self.after(system, k, stop)

    def read(self, partition: InputPartition):
        import pyarrow as pa

        system, _ = found(self.path)
        (k, start, end), lead = partition.value, 0
        for at, own, tail in self.pieces(system, k, start, end):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([self.files[k][0]]), *(pa.array([x], pa.int64()) for x in (start, lead, at)), pa.array([own], pa.binary()), pa.array([tail], pa.binary())], ["file", "path", "range", "lead", "start", "own", "tail"])
            lead += len(own)


def packed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst"))


def stretches(spark: SparkSession, path: str, k: int = 1, breaks: bool = True, joined: bool = False, range_: int = RANGE, row: int = ROW) -> DataFrame:
    """Written (path, before, n, seq): the symbols of raw files, a byte each, in bounded rows.

    A row has n symbols of its own, of which the first is symbol before + 1 of its stream, and up to k - 1 that follow, so
    its windows of k symbols that begin in the first n are the file's. before comes from sums of n over the ranges before,
    a row each, which the driver has planned one by one.
    """
    spark.dataSource.register(Ranges)
    options = {"path": path, "overlap": k - 1, "range": range_, "row": row, "breaks": str(breaks).lower(), "joined": str(joined).lower()}
    d = staged(spark.read.format("vicinal-ranges").options(**options).load(), "ranges")
    text = lambda c: F.decode(F.col(c), "ISO-8859-1")
    own = F.length("own").cast("long")
    stream = W.partitionBy(F.lit(0) if joined else F.col("file")).orderBy("file", "range").rowsBetween(W.unboundedPreceding, -1)
    ranges = d.groupBy("file", "range").agg(F.sum(own).alias("n")).select("file", "range", F.coalesce(F.sum("n").over(stream), F.lit(0)).alias("earlier"))
    d = d.join(F.broadcast(ranges), ["file", "range"])
    return d.select("path", (F.col("lead") + F.col("earlier")).cast("long").alias("before"), own.alias("n"), F.concat(text("own"), text("tail")).alias("seq"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, no, line: the lines of text files that are not blank, numbered from 0 in each file.

    A split numbers its own lines; the sums of the splits before it, a row each, tell where it begins. Lines are written with their split, so that both come from one
    reading of the file.
    """
    line = F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line")
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line).filter(F.trim("line") != "")
    d = staged(d.withColumn("id", F.monotonically_increasing_id()), "lines")  # without gaps in a split
    parts = d.groupBy("file", "block").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "block", (before - F.col("least")).alias("shift"))
    return d.join(F.broadcast(parts), ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("no"), "line")
