"""Counting co-located substrings (T-mers) of aligned sequences.

Aligned sequences lie in one row, so co-location needs no join. Counts of patterns of a small alphabet are those of
packed keys (operators/packed.py). Where rows of keys are asked for, or patterns do not fit a key, a row is cut into chunks
of start positions, chunks are exploded and dealt out, and each start gives its substrings. Counting is one aggregate
with partial sums. Chunks keep substring() away from the start of long sequences, and long rows from one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.sequences import outside
from . import packed

CHUNK = 256


@dataclass(frozen=True)
class Shape:
    """Long patterns of longwin symbols; short ones of shortwin symbols that start leftwin symbols later."""

    longwin: int
    shortwin: int
    leftwin: int

    def __post_init__(self):
        if min(self.longwin, self.shortwin) < 1 or self.leftwin < 0 or self.leftwin + self.shortwin > self.longwin:
            raise ValueError(f"no such window: {self}")

    @property
    def rightwin(self) -> int:
        return self.longwin - self.shortwin - self.leftwin


def windows(df: DataFrame, taxa: dict[str, tuple[str, int, int]], span: int, keep: list[str] = (), cyclic: bool = False, spread: int | None = None) -> DataFrame:
    """keep, pos and, for each name in taxa, the substring of a column: name -> (column, offset, width).

    Starts are 1 to n - span + 1 (cyclic: 1 to n), n the length of the shortest sequence. spread deals the chunks
    out to that many tasks before they are exploded: of use where the input is a file or two.
    """
    columns = list(dict.fromkeys(c for c, _, _ in taxa.values()))
    n = F.least(*(F.length(c) for c in columns)) if len(columns) > 1 else F.length(columns[0])
    starts = n if cyclic else n - (span - 1)
    d = df.filter(F.least(starts, n) > 0)
    if cyclic:  # what is left after the end goes on at the beginning
        d = d.withColumns({c: F.concat(c, F.substring(F.repeat(F.col(c), span), 1, span - 1)) for c in columns})
        starts = n - (span - 1)
    first = F.explode(F.sequence(F.lit(0), F.floor((starts - 1) / CHUNK).cast("int"))).alias("_chunk")
    d = d.select(*keep, *columns, first, starts.alias("_starts"))
    at = F.col("_chunk") * CHUNK
    d = d.select(*keep, at.alias("_at"), F.least(F.lit(CHUNK), F.col("_starts") - at).alias("_n"), *(F.substring(F.col(c), at + 1, F.lit(CHUNK + span - 1)).alias(c) for c in columns))
    d = d.repartition(spread) if spread else d
    d = d.select(*keep, *columns, "_at", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_i"))
    return d.select(*keep, (F.col("_at") + F.col("_i")).alias("pos"), *(F.substring(F.col(c), F.col("_i") + o, F.lit(w)).alias(name) for name, (c, o, w) in taxa.items()))


def strict(df: DataFrame, names: list[str], alphabet: str = "ACGT") -> DataFrame:
    """Only windows whose patterns are of the alphabet."""
    for n in names:
        df = df.filter(~outside(n, alphabet))
    return df


def tmer_counts(df: DataFrame, shape: Shape, long: str, *shorts: str, alphabet: str | None = "ACGT", cyclic: bool = False, shift: int = 0, keep: list[str] = (), spread: int | None = None) -> DataFrame:
    """long, short1.. (or short), count; with shift, frame k holds the positions with (pos + k) mod shift = 0."""
    names = ["short"] if len(shorts) == 1 else [f"short{i + 1}" for i in range(len(shorts))]
    if not keep and not cyclic and packed.fits(shape.longwin + len(shorts) * shape.shortwin, alphabet, shift):
        found = packed.counted(df, [(long, list(shorts))], shape.longwin, shape.shortwin, shape.leftwin, alphabet, shift, spread)
        return packed.patterns(found, names, shape.longwin, shape.shortwin, alphabet, shift).select("long", *names, *(["frame"] if shift else []), "count")
    taxa = {"long": (long, 0, shape.longwin)} | {n: (c, shape.leftwin, shape.shortwin) for n, c in zip(names, shorts, strict=True)}
    d = windows(df, taxa, shape.longwin, list(keep), cyclic, spread)
    d = strict(d, ["long", *names], alphabet) if alphabet else d
    keys = [*keep, "long", *names]
    if shift:
        d = d.withColumn("frame", F.pmod(-F.col("pos"), F.lit(shift)).cast("int"))
        keys.append("frame")
    return d.groupBy(*keys).agg(F.count("*").alias("count"))


def several(df: DataFrame, shape: Shape, ways: list[tuple[dict, str, str]], alphabet: str = "ACGT", spread: int | None = None) -> DataFrame:
    """The columns of a way, long, short, count for each way (its columns, column of long patterns, column of short ones), in one pass over the sequences."""
    if packed.fits(shape.longwin + shape.shortwin, alphabet, len(ways)):
        found = packed.counted(df, [(a, [b]) for _, a, b in ways], shape.longwin, shape.shortwin, shape.leftwin, alphabet, spread=spread)
        return packed.patterns(found, ["short"], shape.longwin, shape.shortwin, alphabet, ways=[w for w, _, _ in ways]).select(*ways[0][0], "long", "short", "count")
    columns = list(dict.fromkeys(c for _, a, b in ways for c in (a, b)))
    at = {c: f"l{k}" for k, c in enumerate(columns)}
    d = windows(df, {name: (c, 0, shape.longwin) for c, name in at.items()}, shape.longwin, spread=spread)
    d = d.groupBy(*at.values()).agg(F.count("*").alias("n"))
    short = lambda c: F.substring(F.col(at[c]), F.lit(shape.leftwin + 1), F.lit(shape.shortwin)).alias("short")
    each = [F.struct(*(F.lit(v).alias(k) for k, v in w.items()), F.col(at[a]).alias("long"), short(b)) for w, a, b in ways]
    d = strict(d.select("n", F.explode(F.array(*each)).alias("w")).select("n", "w.*"), ["long", "short"], alphabet)
    return d.groupBy(*ways[0][0], "long", "short").agg(F.sum("n").alias("count"))


def both_directions(df: DataFrame, shape: Shape, a: str, b: str, spread: int | None = None) -> DataFrame:
    """direction, long, short, count: forward counts, and reverse counts with the roles of the sequences swapped."""
    return several(df, shape, [({"direction": "forward"}, a, b), ({"direction": "reverse"}, b, a)], spread=spread)


def all_pairs(df: DataFrame, shape: Shape, taxa: list[str], spread: int | None = None) -> DataFrame:
    """a, b, long, short, count: long patterns in a, short ones in b, for all pairs of the columns, windows up to the end of the shortest."""
    return several(df, shape, [({"a": x, "b": y}, x, y) for k, x in enumerate(taxa) for y in taxa[k + 1 :]], spread=spread)


def listed(counts: DataFrame, combos: DataFrame) -> DataFrame:
    """Only counts whose short patterns are among the listed combinations."""
    return counts.join(combos, combos.columns, "left_semi")


def kmers(df: DataFrame, seq: str, k: int, cyclic: bool = True, alphabet: str | None = "ACGT", keep: list[str] = ()) -> DataFrame:
    if not keep and packed.fits(k, alphabet):
        around = F.concat(F.col(seq), F.substring(F.repeat(F.col(seq), k), 1, k - 1)) if cyclic else F.col(seq)
        found = packed.counted(df.select(around.alias("_s")), [("_s", [])], k, 0, 0, alphabet)
        return packed.patterns(found, [], k, 0, alphabet).withColumnRenamed("long", "pattern")
    d = windows(df, {"pattern": (seq, 0, k)}, k, list(keep), cyclic)
    d = strict(d, ["pattern"], alphabet) if alphabet else d
    return d.groupBy(*keep, "pattern").agg(F.count("*").alias("count"))


def with_zeros(counts: DataFrame, patterns: DataFrame, key: str = "pattern") -> DataFrame:
    return patterns.select(F.col("pattern").alias(key)).join(counts, key, "left").withColumn("count", F.coalesce("count", F.lit(0)))


def occurrences(df: DataFrame, seq: str, patterns: list[str], keep: list[str]) -> DataFrame:
    """Overlapping occurrences of patterns: keep, pattern, pos. Pieces of the sequences are compared with a pattern as arrays of characters."""
    k = max(map(len, patterns))
    d = packed.segments(df.withColumn("_s", F.rpad(F.col(seq), F.length(seq) + k - 1, " ")), ["_s"], k, keep=list(keep))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema] + ["pattern string", "pos int"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi in packed.runs(batch.column("_n").to_numpy(zero_copy_only=False) + (k - 1), packed.STRETCH):
                rows = batch.slice(lo, hi - lo)
                first, n = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("_first", "_n"))
                codes, at = packed.characters(rows.column("_c0"))
                for p in patterns:
                    m = len(codes) - len(p) + 1
                    if m <= 0:
                        continue
                    same = np.ones(m, bool)
                    for j, c in enumerate(p):
                        same &= codes[j : j + m] == ord(c)
                    hit = np.flatnonzero(same)
                    row = np.searchsorted(at, hit, "right") - 1
                    own = hit - at[row] < n[row]  # the symbols after these begin the next piece
                    hit, row = hit[own], row[own]
                    pos = first[row] + (hit - at[row]) + 1
                    yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(row)) for c in keep), pa.array([p] * len(row), pa.string()), pa.array(pos, pa.int32())], [*keep, "pattern", "pos"])

    return d.mapInArrow(run, ", ".join(fields))


def sum_counts(tables: list[DataFrame]) -> DataFrame:
    """Tables long, short, count (text): counts that are no whole numbers are skipped."""
    d = tables[0]
    for t in tables[1:]:
        d = d.unionByName(t)
    d = d.withColumn("count", F.expr("try_cast(count AS bigint)")).filter("count IS NOT NULL")
    return d.groupBy("long", "short").agg(F.sum("count").alias("count"))


def skipped_counts(tables: list[DataFrame]) -> DataFrame:
    d = tables[0]
    for t in tables[1:]:
        d = d.unionByName(t)
    return d.filter(F.expr("try_cast(count AS bigint) IS NULL")).agg(F.count("*").alias("skipped"))


def row_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("long").agg(F.sum("count").alias("count"))


def projected(counts: DataFrame, old: Shape, new: Shape, shorts: list[str] = ("short",), overlapping: bool = True, combos: DataFrame | None = None) -> DataFrame:
    """Counts re-shaped to smaller windows: the sum over the admissible shifts, by their number if overlapping. combos: the combinations of short patterns that count."""
    lo = max(0, old.leftwin - new.leftwin)
    hi = min(old.leftwin + old.shortwin - new.leftwin - new.shortwin, old.longwin - new.longwin)
    if lo > hi:
        raise ValueError(f"unreconcilable: {old} and {new}")
    d = counts.withColumn("_k", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    k = F.col("_k")
    d = d.select(F.substring(F.col("long"), k + 1, F.lit(new.longwin)).alias("long"), *(F.substring(F.col(s), k + (new.leftwin - old.leftwin + 1), F.lit(new.shortwin)).alias(s) for s in shorts), "count")
    d = d if combos is None else listed(d, combos)
    return d.groupBy("long", *shorts).agg((F.sum("count") / F.lit(hi - lo + 1 if overlapping else 1)).alias("count"))
