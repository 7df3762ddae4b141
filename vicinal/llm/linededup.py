"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line stripped of ASCII white space at both ends, with A-Z in lower case; keys are known by 128-bit
hashes and dealt to shards by them. An index has two tables: for each key the number of documents that hold it (a
reference count, exact, one row a key), and for each shard a cuckoo filter of the keys that THRESHOLD documents or
more hold. Inserting or deleting documents adds to or takes from the counts; keys that cross the threshold enter or
leave the filter of their shard, which cuckoo filters allow, so taking out what was put in gives the index from before.
Deleting documents that were never inserted is an error.

Documents are tested in blocks. A block sends each of its keys once to the key's shard, whose filter passes those of
the index and a few others; these are looked up in the counts, so no line is lost by mistake, and what stays goes
back to the block, which drops all lines with such a key. A line that all documents hold costs a shard one entry a block.
A filter grows by further levels of twice the size, so a shard holds a few bytes a key of the index.

Cases: a null or empty text is one empty line; lines whose key is empty always stay; a text may lose all lines, which leaves
an empty text; rows are documents each, whether or not they share a doc_id; a key counts once a document however often
it is repeated in it; texts and lines of any length are worked on whole; an empty table gives an empty index and an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .blocks import each, written
from .common import discard, give_back, staged

THRESHOLD = 10
#: Text of a shard, in bytes.
SHARD_BYTES = 64 << 20
#: Hits of all blocks together that are broadcast; more meet their blocks in a shuffle.
BROADCAST_BYTES = 8 << 20
WHITE, LOWER = b" \t\n\x0b\x0c\r", bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLOTS, KICKS, FULL = 4, 500, 0.9


class Cuckoo:
    """A set of 128-bit keys by fingerprints of 16 bits, with deletion: tests may pass a key that is not in it, never miss one that is.

    Levels are tables of buckets of SLOTS fingerprints, each of twice the size of the one before; a key that finds no place in
    the last gets a new one. Deleting looks at the largest level first: two keys that share buckets there share them in all
    smaller ones, so the fingerprint that stays serves the other key.
    """

    def __init__(self, levels: list[np.ndarray] | None = None):
        self.levels = levels or []

    @staticmethod
    def of(blob: bytes | None) -> Cuckoo:
        levels, at = [], 0
        while blob and at < len(blob):
            (n,) = struct.unpack_from("<q", blob, at)
            levels.append(np.frombuffer(blob, np.uint16, n * SLOTS, at + 8).copy())
            at += 8 + 2 * n * SLOTS
        return Cuckoo(levels)

    def packed(self) -> bytes:
        return b"".join(struct.pack("<q", len(t) // SLOTS) + t.tobytes() for t in self.levels)

    def places(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys (two 64-bit halves a row)."""
        mask = np.uint64(len(self.levels[level]) // SLOTS - 1)
        mark = keys[:, 1] % np.uint64(65535) + np.uint64(1)
        one = keys[:, 0] & mask
        return mark.astype(np.uint16), one, one ^ (mark * np.uint64(0x9E3779B1) & mask)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for k, t in enumerate(self.levels):
            mark, one, two = self.places(keys, k)
            t = t.reshape(-1, SLOTS)
            out |= (t[one.astype(np.int64)] == mark[:, None]).any(1) | (t[two.astype(np.int64)] == mark[:, None]).any(1)
        return out

    def insert(self, keys: np.ndarray) -> None:
        while len(keys):
            if not self.levels or self.last_filled:
                size = max(16, 2 * len(self.levels[-1]) // SLOTS if self.levels else 0, int(len(keys) / SLOTS / FULL) + 1)
                self.levels.append(np.zeros(SLOTS << (size - 1).bit_length(), np.uint16))
            keys = keys[self._filled(keys) :]
            self.last_filled = len(keys) > 0
        self.last_filled = False

    last_filled = False

    def _filled(self, keys: np.ndarray) -> int:
        """Puts keys into the last level; how many had a place."""
        t = self.levels[-1].tolist()
        mask = len(t) // SLOTS - 1
        done = 0
        for mark, one, two in zip(*(x.tolist() for x in self.places(keys, len(self.levels) - 1)), strict=True):
            moved, at = [], one
            for kick in range(KICKS):
                spot = next((s for b in ((one, two) if not kick else (at,)) for s in range(b * SLOTS, (b + 1) * SLOTS) if not t[s]), -1)
                if spot >= 0:
                    t[spot] = mark
                    break
                spot = at * SLOTS + (kick + mark) % SLOTS
                moved.append((spot, t[spot]))
                mark, t[spot] = t[spot], mark
                at ^= mark * 0x9E3779B1 & mask
            else:
                for spot, old in reversed(moved):
                    t[spot] = old
                break
            done += 1
        self.levels[-1] = np.array(t, np.uint16)
        return done

    def delete(self, keys: np.ndarray) -> None:
        """Keys that are in the set."""
        left = np.arange(len(keys))
        for k in reversed(range(len(self.levels))):
            t, missed = self.levels[k], []
            for i, mark, one, two in zip(left.tolist(), *(x.tolist() for x in self.places(keys[left], k)), strict=True):
                spot = next((s for b in (one, two) for s in range(b * SLOTS, (b + 1) * SLOTS) if t[s] == mark), -1)
                if spot < 0:
                    missed.append(i)
                else:
                    t[spot] = 0
            left = np.array(missed, int)
        if len(left):
            raise ValueError("keys to delete are not in the filter")


def line_keys(text: bytes) -> list[bytes]:
    """For each line the hash of its key, nothing for an empty key."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(WHITE).translate(LOWER)
        out.append(hashlib.blake2b(key, digest_size=16).digest() if key else b"")
    return out


def texts(rows):
    """The UTF-8 texts of a record batch, one by one."""
    import pyarrow as pa

    return (t.as_buffer().to_pybytes() for t in rows.column("text").cast(pa.large_binary()).fill_null(b""))


def numbers(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys[:, 0] >> np.uint64(40)) % np.uint64(shards)


def references(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, key, n): documents that hold a key, summed by block."""

    def run(batches):
        import pyarrow as pa

        for _, rows in each(batches):
            seen: Counter = Counter()
            for t in texts(rows):
                seen.update(set(line_keys(t)))
            del seen[b""]
            if seen:
                keys = list(seen)
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(numbers(keys), shards).astype(np.int32)), pa.array(keys, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["shard", "key", "n"])
        give_back()

    return blocks.mapInArrow(run, "shard int, key binary, n long")


@dataclass(frozen=True)
class LineIndex:
    """refs: (shard, key, n), filters: (shard, filter); both written. None: nothing inserted yet."""

    shards: int
    threshold: int = THRESHOLD
    refs: DataFrame | None = None
    filters: DataFrame | None = None

    @staticmethod
    def sized(blocks: DataFrame, threshold: int = THRESHOLD) -> LineIndex:
        """An empty index with shards for about so many documents."""
        return LineIndex(max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES)), threshold)

    def insert(self, blocks: DataFrame) -> LineIndex:
        return self._changed(references(blocks, self.shards).withColumn("before", F.lit(0).cast("long")))

    def delete(self, blocks: DataFrame) -> LineIndex:
        return self._changed(references(blocks, self.shards).select("shard", "key", (-F.col("n")).alias("n"), F.lit(0).cast("long").alias("before")))

    def _changed(self, new: DataFrame) -> LineIndex:
        """The index after some counts changed. The one before stays valid."""
        least = self.threshold
        if self.refs is not None:
            new = new.union(self.refs.select("shard", "key", "n", F.col("n").alias("before")))
        sums = new.groupBy("shard", "key").agg(F.sum("n").alias("n"), F.sum("before").alias("before"))
        lost = F.when(F.col("n") < 0, F.raise_error(F.lit("documents that were not inserted cannot be deleted")).cast("long"))
        every = staged(sums.withColumn("n", F.coalesce(lost, "n")), "lines-refs")
        crossed = every.filter((F.col("n") >= least) != (F.col("before") >= least)).select("shard", "key", (F.col("n") >= least).alias("enters"))

        def run(old, rows):
            import pyarrow as pa

            filter_ = Cuckoo.of(old.column("filter")[0].as_py() if old.num_rows else None)
            shard = (old if old.num_rows else rows).column("shard")[0].as_py()
            come, go = [], []
            for key, enters in sorted(zip(rows.column("key").to_pylist(), rows.column("enters").to_pylist(), strict=True)):
                (come if enters else go).append(key)
            filter_.delete(numbers(go))
            filter_.insert(numbers(come))
            give_back()
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([filter_.packed()], pa.binary())})

        old = self.filters if self.filters is not None else crossed.sparkSession.createDataFrame([], "shard int, filter binary")
        filters = staged(old.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(run, "shard int, filter binary"), "lines-filters")
        return LineIndex(self.shards, least, every.filter("n > 0").select("shard", "key", "n"), filters)

    def hits(self, blocks: DataFrame) -> DataFrame:
        """Written (block, keys): the keys of a block that reach the threshold, packed."""
        shards = self.shards

        def send(batches):
            import pyarrow as pa

            for b, rows in each(batches):
                found = set()
                for t in texts(rows):
                    found.update(line_keys(t))
                keys = numbers(sorted(found - {b""}))
                shard = shard_of(keys, shards)
                order = np.argsort(shard, kind="stable")
                names, first = np.unique(shard[order], return_index=True)
                parts = np.split(keys[order], first[1:]) if len(names) else []
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array([b["block"]] * len(names), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["shard", "block", "keys"])
            give_back()

        def tested(sent, filters):
            import pyarrow as pa

            blocks, keys = [np.zeros(0, np.int64)], []
            if filters.num_rows:
                filter_ = Cuckoo.of(filters.column("filter")[0].as_py())
                for block, blob in zip(sent.column("block").to_pylist(), sent.column("keys").to_pylist(), strict=True):
                    k = np.frombuffer(blob, np.uint64).reshape(-1, 2)
                    k = k[filter_.has(k)]
                    blocks.append(np.full(len(k), block))
                    keys += [r.tobytes() for r in k]
            give_back()
            blocks = np.concatenate(blocks)
            shard = sent.column("shard")[0].as_py() if sent.num_rows else 0
            return pa.table({"shard": pa.array([shard] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int64()), "key": pa.array(keys, pa.binary())})

        sent = blocks.mapInArrow(send, "shard int, block long, keys binary")
        passed = sent.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(tested, "shard int, block long, key binary")
        held = self.refs.filter(F.col("n") >= self.threshold).select("shard", "key")
        return staged(passed.join(held, ["shard", "key"]).groupBy("block").agg(F.collect_list("key").alias("keys")), "lines-hits")

    def dropped(self, blocks: DataFrame) -> DataFrame:
        """doc_id, n_lines, n_dropped, text (what stays) of every row of the blocks."""

        def run(batches):
            import pyarrow as pa

            for b, rows in each(batches):
                gone = set(b["keys"] or ())
                n, out, kept = [], [], []
                for t in texts(rows):
                    keys = line_keys(t)
                    stay = [k not in gone for k in keys]
                    n.append(len(keys))
                    out.append(len(keys) - sum(stay))
                    kept.append(b"\n".join(x for x, s in zip(t.split(b"\n"), stay, strict=True) if s) if out[-1] else t)
                for lo in range(0, len(n), 256):
                    at = slice(lo, lo + 256)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id")[at], pa.array(n[at], pa.int64()), pa.array(out[at], pa.int64()), pa.array(kept[at], pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])
            give_back()

        hits = self.hits(blocks)
        size = hits.agg(F.sum(16 * F.size("keys") + 64)).first()[0] or 0
        both = blocks.select("block", "rows").join(F.broadcast(hits) if size <= BROADCAST_BYTES else hits, "block", "left")
        return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")


def in_blocks(docs: DataFrame) -> DataFrame:
    """Documents in the form that an index takes: written once, so that every pass sees the same rows."""
    return written(docs.select("doc_id", "text"), "lines-blocks")


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_dropped, text: documents without the lines that `threshold` of them hold."""
    blocks = in_blocks(docs)
    return LineIndex.sized(blocks, threshold).insert(blocks).dropped(blocks)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::bigint AS n_lines, count(c.key)::bigint AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
