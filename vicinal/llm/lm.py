"""Language-model scoring by deleted interpolation of a trigram model.

p(w | u v) = l3(b) c(u v w) / c(u v) + l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), where b buckets the
history by the power of two of the count of u v or, if that is 0, of v. The weights of each bucket come from
expectation-maximisation on held-out counts: every training token is held out in turn, so its own occurrence is taken
from the counts that predict it. A round is a pass over all training tokens with their exact counts; there are 3 ROUNDS of them at most, fewer if they gain little. A text is its words and an end; the end also stands before the first word, where the
trigram estimate is the bigram's. A training text is scored with its own counts in, a held-out text has none.

Counts are exact and cover all training texts. Rows are worked on in blocks of BLOCK_BYTES of text, or one longer
text. A block sends its distinct words, pairs and triples with their counts, as sorted and packed arrays, to the part
of the hash range that they belong to; the parts add up the blocks and send the sums back to each block, where they
meet the texts again. So a frequent word costs a part one entry a block, and no count table is held by one task. Words,
pairs and triples are told apart by 64-bit hashes: two that agree are not to be expected below 10**9 of them.

Cases: null texts are empty and have one token, the end; without training rows N = V = 0 and every token has
probability 1; rows with a null doc_id are learned from; equal texts of a fold score alike; texts of any length are
scored whole; an empty table gives an empty result. Only doc_id and text are read. Texts are read twice, and the input must
give the same rows in the same order each time, as files do: how they are split is held fixed meanwhile, whatever
executors come and go. A block whose words, pairs or triples differ is noticed and the task fails.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..staging import fixed_splits
from .blocks import cut
from .common import discard, give_back, remainder, returned, staged, text_bytes
from .shingles import mix, pack, pieces, unpack, words

#: Text of a block, and of the part of the hash range that one task adds up, both in bytes.
BLOCK_BYTES, PART_BYTES = 2 << 20, 8 << 20
#: Most rounds, each of three passes over the training tokens; what a round must gain in log-likelihood a token for another to follow.
ROUNDS, GAIN = 3, 1e-5
END = mix(np.array([0x656E64], np.uint64))[0]


class Block:
    """The tokens of some rows: words and an end each."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        tokens, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, last in pieces(at):
            w, wat = words(data[at[first] : at[last]], at[first : last + 1] - at[first])
            n = np.diff(wat)
            out = np.full(len(w) + len(n), END, np.uint64)
            out[np.arange(len(w)) + np.repeat(np.arange(len(n)), n)] = w
            tokens.append(out)
            sizes.append(n + 1)
        self.tokens, self.sizes = np.concatenate(tokens), np.concatenate(sizes)
        self.first = starts(self.sizes)
        here = mix(self.tokens)
        self.pairs = mix(np.r_[END, self.tokens[:-1]][: len(here)] * np.uint64(3) + here)  # an end stands before a row
        self.triples = mix(np.r_[END, self.pairs[:-1]][: len(here)] * np.uint64(5) + here)[~self.first]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.tokens, self.pairs, self.triples


def starts(sizes: np.ndarray) -> np.ndarray:
    """Which tokens are the first of their row."""
    out = np.zeros(int(sizes.sum()), bool)
    out[np.cumsum(sizes) - sizes] = True
    return out


def _blocks(batches):
    """(number, record batch of doc_id, text and train) of each block; the same for the same rows in the same order."""
    from pyspark import TaskContext

    yield from enumerate(cut(batches, BLOCK_BYTES), TaskContext.get().partitionId() << 32)


def folded(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce(remainder(F.col("doc_id"), 5) != 1, F.lit(True)).alias("train"))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, their sums of n, and for each key its place among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]][: len(keys)]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ordered[first], np.add.reduceat(n[order], first) if len(first) else n[:0], at


def counts(docs: DataFrame, parts: int) -> DataFrame:
    """Written (block, part, kind, sums, seen): what all blocks together count of a block's words (kind 0), pairs (1) and triples (2), in the order of their hashes; seen adds these up. Block -1 - part has N and V of the part."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def run(batches):
        import pyarrow as pa

        types = {"block": pa.int64(), "part": pa.int32(), "kind": pa.int32(), "keys": pa.binary(), "n": pa.binary()}
        for block, rows in _blocks(batches):
            b = Block(*text_bytes(rows.column("text")))
            learned = np.repeat(np.array(rows.column("train").to_pylist(), bool), b.sizes).astype(np.int64)
            for kind, (keys, n) in enumerate(zip(b.keys(), (learned, learned, learned[~b.first]), strict=True)):
                keys, n, _ = _summed(keys, n)
                cuts = [0, *np.searchsorted(keys, edges), len(keys)]
                out = [(block, p, kind, pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), pack(n[lo:hi].astype(np.uint64))) for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], list(types))

    def add(table):
        import pyarrow as pa

        part, kind = table.column("part")[0].as_py(), table.column("kind")[0].as_py()
        keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        seen = [int(k.sum(dtype=np.uint64).astype(np.int64)) for k in keys]
        _, sums, at = _summed(np.concatenate(keys), np.concatenate([unpack(x) for x in table.column("n").to_pylist()]))
        back = np.split(sums[at], np.cumsum([len(k) for k in keys])[:-1])
        rows = [(b, part, kind, pack(x), s) for b, x, s in zip(table.column("block").to_pylist(), back, seen, strict=True)]
        if kind == 0:
            rows.append((-1 - part, part, kind, pack(np.array([sums.sum(), (sums > 0).sum()], np.uint64)), 0))
        give_back()
        types = {"block": pa.int64(), "part": pa.int32(), "kind": pa.int32(), "sums": pa.binary(), "seen": pa.int64()}
        return pa.table({name: pa.array(c, t) for c, (name, t) in zip(zip(*rows, strict=True), types.items(), strict=True)})

    sent = folded(docs).mapInArrow(run, "block long, part int, kind int, keys binary, n binary")
    return staged(sent.groupBy("part", "kind").applyInArrow(add, "block long, part int, kind int, sums binary, seen long"), "lm-sums")


def counted(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """Written (doc_id, train, sizes, ones, twos, threes), a row for each block: for each token the counts of the word, its pair and its triple, packed."""

    def texts(batches):
        import pyarrow as pa

        how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for block, rows in _blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=how) as out:
                out.write_batch(rows)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    def meet(left, right):
        import pyarrow as pa

        rows = pa.ipc.open_stream(left.column("rows")[0].as_py()).read_next_batch()
        b = Block(*text_bytes(rows.column("text")))
        back = sorted(right.to_pylist(), key=lambda r: r["part"])
        got = []
        for kind, keys in enumerate(b.keys()):
            known, _, at = _summed(keys, np.zeros(len(keys), np.int64))
            mine = [r for r in back if r["kind"] == kind]
            total = np.concatenate([unpack(r["sums"]) for r in mine] + [np.zeros(0, np.uint64)])
            if len(known) != len(total) or (sum(r["seen"] for r in mine) - int(known.sum(dtype=np.uint64))) % 2**64:
                raise ValueError("the rows of a block changed between two reads of the input")
            got.append(total[at])
        threes = got[1].copy()  # of the first tokens: the pair's
        threes[~b.first] = got[2]
        ids, train = rows.column("doc_id"), rows.column("train")
        one = lambda x: pa.array([x.to_pylist()], pa.list_(x.type))
        out = pa.table([one(ids), one(train), *(pa.array([pack(x)], pa.binary()) for x in (b.sizes.astype(np.uint64), got[0], got[1], threes))], ["doc_id", "train", "sizes", "ones", "twos", "threes"])
        give_back()
        return out

    left = folded(docs).mapInArrow(texts, "block long, rows binary").groupBy("block")
    right = sums.filter("block >= 0").groupBy("block")
    return staged(left.cogroup(right).applyInArrow(meet, "doc_id array<long>, train array<boolean>, sizes binary, ones binary, twos binary, threes binary"), "lm-counted")


def powers(n: int) -> int:
    """Buckets of histories of each kind: one for the count 0, one for each power of two up to n."""
    return int(n).bit_length() + 1


def estimates(ones: np.ndarray, twos: np.ndarray, threes: np.ndarray, first: np.ndarray, end: int, n: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and its trigram, bigram and unigram estimate (three columns). end: how often the end is counted; out: 1 takes the token itself from the counts."""
    ones, twos, threes = (x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64) for x in (ones, twos, threes))
    before = lambda x: np.where(first, end, np.r_[0, x[:-1]][: len(x)]) - out
    h1, h2 = before(ones), before(twos)
    known = h2 > 0
    bucket = np.frexp(np.maximum(np.where(known, h2, h1), 0).astype(float))[1] + powers(n) * known
    of = lambda c, h: (c - out) / np.maximum(h, 1)  # noqa: E731  what a history of no other token counts is 0 too
    return bucket, np.stack([of(threes, h2), of(twos, h1), of(ones, np.int64(n - out))]).T


def begun(n: int) -> np.ndarray:
    """For each bucket the weights that it begins with, and keeps if nothing falls into it: none on estimates that are 0."""
    out = np.tile([0.4, 0.3, 0.2, 0.1], (2 * powers(n), 1))
    for bucket, w in enumerate(out):
        w[: 0 if bucket >= powers(n) else 1 if bucket else 2 if n else 3] = 0
    return out / out.sum(1, keepdims=True)


def shares(bucket: np.ndarray, p: np.ndarray, v: int, w: np.ndarray) -> np.ndarray:
    """For each bucket the expected number of its tokens that each of the four estimates made, and the log-likelihood of the tokens."""
    order, out = np.argsort(bucket.astype(np.uint8), kind="stable"), np.zeros((len(w), 5))
    p, ends = np.take(p.T, order, axis=1), np.cumsum(np.bincount(bucket, minlength=len(w)))
    for k in np.flatnonzero(np.diff(ends, prepend=0)):
        q = p[:, ends[k - 1] if k else 0 : ends[k]]
        total = w[k, :3] @ q + w[k, 3] / (v + 1)
        rest = 1 / total
        out[k] = *(w[k, :3] * (q @ rest)), w[k, 3] / (v + 1) * rest.sum(), np.log(total).sum()
    return out


def climbed(step, w: np.ndarray, tokens: int) -> np.ndarray:
    """Weights of all buckets by expectation-maximisation; step gives the shares under some weights.

    Two rounds tell where a third sets out from: along the way that they went, as far as its slowing down says; a bucket for which that is
    no mixture, or likelier not to have been than the round before, goes on from the second round. The end is that of the plain rounds.
    """

    def round_(w):
        s = step(w)
        seen = s[:, :4] + [0, 0, 0, 1e-3]  # the uniform part stays above zero
        new = np.where(s[:, :4].sum(1, keepdims=True) > 0, seen / seen.sum(1, keepdims=True), w)
        return new, s[:, 4]

    last = -np.inf
    for _ in range(ROUNDS):
        a, _ = round_(w)
        b, before = round_(a)
        r, bend = a - w, b - 2 * a + w
        far = np.maximum(1, np.sqrt((r**2).sum(1) / np.maximum((bend**2).sum(1), 1e-300)))[:, None]
        ahead = w + 2 * far * r + far**2 * bend
        good = ((ahead > 0) | (w == 0)).all(1, keepdims=True) & np.isfinite(ahead).all(1, keepdims=True)
        ahead = np.where(good, np.maximum(ahead, 0), b)
        new, after = round_(ahead / ahead.sum(1, keepdims=True))
        w = np.where((after >= before)[:, None], new, b)
        reached = float(np.maximum(after, before).sum())
        if reached - last <= GAIN * tokens:
            break
        last = reached
    return w


def _unpacked(b, i: int) -> tuple:
    """doc_ids, train, sizes and the counts of the block in row i."""
    return b.column("doc_id")[i].as_py(), np.array(b.column("train")[i].as_py(), bool), *(unpack(b.column(c)[i].as_py()) for c in ("sizes", "ones", "twos", "threes"))


def weights(tokens: DataFrame, n: int, v: int) -> np.ndarray:
    """A row for each bucket: the shares of the trigram, bigram, unigram and uniform estimates. Each round is a pass over the training tokens, which gives a few numbers a bucket."""
    rows = 2 * powers(n)

    def step(w):
        def held_out(batches):
            import pyarrow as pa

            seen = np.zeros((rows, 5))
            for b in returned(batches, 8):
                for i in range(b.num_rows):
                    _, train, sizes, ones, twos, threes = _unpacked(b, i)
                    learned = np.repeat(train, sizes.astype(np.int64))
                    if learned.any():
                        bucket, p = estimates(ones, twos, threes, starts(sizes), int(ones[-1]), n, 1)
                        seen += shares(bucket[learned], p[learned], v, w)
            at = np.flatnonzero(seen[:, :4].any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(seen[at, k]) for k in range(5))], ["bucket", *"abcde"])

        found = tokens.mapInArrow(held_out, "bucket long, a double, b double, c double, d double, e double").groupBy("bucket").agg(*(F.sum(c).alias(c) for c in "abcde"))
        out = np.zeros((rows, 5))
        for r in found.collect():  # a row a bucket
            out[r["bucket"]] = [r[c] for c in "abcde"]
        return out

    return climbed(step, begun(n), n)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)).first()[0] or 1
    with fixed_splits(docs.sparkSession):
        sums = counts(docs, max(1, -(-size // PART_BYTES)))
        tokens = counted(docs, sums)

    def of_part(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([unpack(x).astype(np.int64) for x in b["sums"]], columns=["n", "v"])

    n, v = (int(x or 0) for x in sums.filter("block < 0").select("sums").mapInPandas(of_part, "n long, v long").agg(F.sum("n"), F.sum("v")).first())
    discard(sums)
    mixed = weights(tokens, n, v)

    def run(batches):
        import pyarrow as pa

        for b in returned(batches):
            for i in range(b.num_rows):
                ids, train, sizes, ones, twos, threes = _unpacked(b, i)
                first = starts(sizes)
                bucket, p = estimates(ones, twos, threes, first, int(ones[-1]), n, 0)
                w = mixed[bucket]
                p = (w[:, :3] * p).sum(1) + w[:, 3] / (v + 1)
                at = np.flatnonzero(first)
                base = np.add.reduceat(np.log10((ones + 0.5) / (n + 0.5 * (v + 1))), at)
                cols = [pa.array(ids, pa.int64()), pa.array(~train), pa.array(sizes.astype(np.int64)), pa.array(np.add.reduceat((ones > 0).astype(np.int64), at)), pa.array(np.full(len(at), n)), pa.array(base), pa.array(np.add.reduceat(np.log10(p), at))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return tokens.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7(spark, sf_dir):
    from .common import table

    return score(table(spark, sf_dir, "documents"))
