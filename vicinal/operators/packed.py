"""T-mers as whole numbers: patterns of a small alphabet packed into a few bits a symbol.

Rows are cut to pieces of bounded length, so that a batch of rows is bounded too. A task takes rows of about STRETCH symbols
at a time, turns them into symbol codes, rolls these into packed patterns by shift and mask, and counts the packed keys; Spark adds up the counts by key, a long, and only keys that
occur are turned back into strings. A key holds, from its low end, the short patterns, the long one, the frame and the number of the way.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Symbols of a column worked on at once; keys that a task holds before it sends them; bits of the keys that are counted in a table.
STRETCH, MOST_KEYS, TABLE_BITS = 1 << 18, 1 << 20, 20
#: Starts of windows in a row that goes to one task, and in the rows that these are cut to step by step: substring() reads a row from its start. Rows go to Python in batches of up to 10,000.
SEGMENT, CUTS = 1 << 20, (1 << 16, 1 << 12)


def bits(alphabet: str) -> int:
    """Bits a symbol takes."""
    return max(1, math.ceil(math.log2(len(alphabet))))


def fits(symbols: int, alphabet: str | None, more: int = 1) -> bool:
    """Whether patterns of so many symbols in all, times `more` kinds, are a key of 62 bits; letters are ASCII ones."""
    return bool(alphabet) and alphabet.isascii() and len(set(alphabet)) == len(alphabet) and symbols * bits(alphabet) + max(0, more - 1).bit_length() <= 62


def letters(column, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the characters of an Arrow string column, and where each row starts; a character of several bytes is one that is in no alphabet."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    if data.max() < 128:
        return table[data], at
    lead = (data & 0xC0) != 0x80
    return table[data[lead]], np.r_[0, np.cumsum(lead)][at]


def characters(column) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the characters of an Arrow string column without nulls, and where each row starts."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]
    if not len(data) or data.max() < 128:
        return data, at
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum((data & 0xC0) != 0x80)][at]


def windows(codes: np.ndarray, width: int, n: int, shift: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The n packed patterns of `width` symbols from `start` on, and whether each has letters of the alphabet only (codes below 255)."""
    out, good = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(start, start + width):
        c = codes[j : j + n]
        out = out << shift | c
        good &= c != 255
    return out, good


class Counter:
    """Counts of keys of a task; sent when there are many."""

    def __init__(self, width: int):
        self.table = np.zeros(1 << width, np.int64) if width <= TABLE_BITS else None
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        if self.table is not None:
            found = np.bincount(keys)
            self.table[: len(found)] += found
        elif len(keys):
            k, n = np.unique(keys, return_counts=True)
            self.keys.append(k)
            self.counts.append(n)
            self.held += len(k)
            if self.held > MOST_KEYS:
                self.merge()

    def merge(self) -> None:
        k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.zeros(len(k), np.int64)
        np.add.at(n, at, np.concatenate(self.counts))
        self.keys, self.counts, self.held = [k], [n], len(k)

    def full(self) -> bool:
        return self.held > MOST_KEYS // 2 and len(self.keys) == 1

    def batches(self):
        import pyarrow as pa

        if self.table is not None:
            keys = np.flatnonzero(self.table)
            counts, self.table = self.table[keys], self.table * 0
        else:
            if self.keys:
                self.merge()
            keys, counts = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.int64),) * 2
            self.keys, self.counts, self.held = [], [], 0
        for lo in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 16)], pa.int64()), pa.array(counts[lo : lo + (1 << 16)], pa.int64())], ["key", "n"])


def segments(df: DataFrame, columns: list[str], span: int, spread: int | None = None, keep: list[str] = ()) -> DataFrame:
    """keep, and the columns cut to bounded stretches that overlap by span - 1 symbols, as _c0, ..., with _first, the number of symbols before, and _n, the starts of windows in a stretch."""
    n = F.least(*map(F.length, columns)) if len(columns) > 1 else F.length(columns[0])
    names = [f"_c{i}" for i in range(len(columns))]
    d = df.dropna(subset=columns).select(*keep, *(F.col(c).alias(i) for c, i in zip(columns, names, strict=True)), F.lit(0).cast("long").alias("_first"), (n - (span - 1)).alias("_n")).filter("_n > 0")

    def cut(d, size):
        def piece(k):
            at = k * size
            count = F.least(F.lit(size), F.col("_n") - at)
            return F.struct(*(F.substring(F.col(c), at + 1, count + (span - 1)).alias(c) for c in names), (F.col("_first") + at).alias("_first"), count.alias("_n"))

        return d.select(*keep, F.inline(F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / size).cast("int")), piece)))

    d = cut(d, SEGMENT)
    d = d.repartition(spread) if spread else d
    for size in CUTS:
        d = cut(d, size)
    return d


def runs(sizes: np.ndarray, most: int):
    """Ranges of rows that hold at most so many symbols, or one longer row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield first, last
        first = last


def counted(df: DataFrame, ways: list[tuple[str, list[str]]], longwin: int, shortwin: int, leftwin: int, alphabet: str, shift: int = 0, spread: int | None = None) -> DataFrame:
    """key, n: how often each packed key occurs. ways: (column of the long pattern, columns of the short ones)."""
    columns = list(dict.fromkeys(c for a, b in ways for c in (a, *b)))
    at = {c: i for i, c in enumerate(columns)}
    sides = [(at[a], [at[c] for c in b]) for a, b in ways]
    b, frames, most = bits(alphabet), max(1, shift), len(ways[0][1])
    width = (longwin + most * shortwin) * b
    total = width + (frames * len(ways) - 1).bit_length()
    table = np.full(256, 255, np.uint8)
    table[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))

    def add(c, rows):
        first, n = (rows.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("_first", "_n"))
        codes = [letters(rows.column(f"_c{i}"), table) for i in range(len(columns))]
        size = n + longwin - 1  # symbols of a row that windows meet
        flat = np.r_[0, np.cumsum(size)]
        begin = np.repeat(np.arange(len(n)), size)
        place = np.arange(flat[-1]) - flat[begin]
        m = len(place) - longwin + 1
        lined = [x[start[begin] + place] for x, start in codes]
        whole = (place < n[begin])[:m]  # windows that end in their row
        frame = ((-(first[begin] + place + 1)) % frames)[:m]
        for k, (long, shorts) in enumerate(sides):
            key, good = windows(lined[long], longwin, m, b)
            for s in shorts:
                part, fine = windows(lined[s], shortwin, m, b, leftwin)
                key, good = key << shortwin * b | part, good & fine
            c.add((key + ((frame + frames * k) << width))[good & whole])

    def run(batches):
        c = Counter(total)
        for batch in batches:
            for lo, hi in runs(batch.column("_n").to_numpy(zero_copy_only=False) + (longwin - 1), STRETCH):
                add(c, batch.slice(lo, hi - lo))
                if c.full():
                    yield from c.batches()
        yield from c.batches()

    d = segments(df, columns, longwin, spread)
    return d.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def text(key: Column, low: int, width: int, alphabet: str) -> Column:
    """The pattern of `width` symbols whose bits begin at `low`."""
    b = bits(alphabet)
    one = lambda k: F.substring(F.lit(alphabet), (F.shiftrightunsigned(key, low + b * (width - 1 - k)).bitwiseAND((1 << b) - 1) + 1).cast("int"), F.lit(1))
    return F.concat(*(one(k) for k in range(width)))


def patterns(counts: DataFrame, names: list[str], longwin: int, shortwin: int, alphabet: str, shift: int = 0, ways: list | None = None) -> DataFrame:
    """long, the short names, (frame,) count and, with ways (a row of columns for each, by name), these."""
    b, frames = bits(alphabet), max(1, shift)
    width = (longwin + len(names) * shortwin) * b
    key, rest = F.col("key"), F.shiftrightunsigned("key", width)
    out = [text(key, len(names) * shortwin * b, longwin, alphabet).alias("long")]
    out += [text(key, (len(names) - 1 - i) * shortwin * b, shortwin, alphabet).alias(n) for i, n in enumerate(names)]
    out += [(rest % frames).cast("int").alias("frame")] if shift else []
    for name in ways[0] if ways else ():
        out.append(F.element_at(F.array(*(F.lit(w[name]) for w in ways)), (F.floor(rest / frames) + 1).cast("int")).alias(name))
    return counts.select(*out, F.col("n").alias("count"))
