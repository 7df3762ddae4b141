"""N-gram Jaccard self-join by token-combination prefixes.

The shingles of a text are its tokens. Tokens of at least FREQUENT texts form the frequent class, all others the
rare one; in the global order rare tokens come first, each class by hash. Texts are counted for the tokens of the low
part of the hash range, from which prefixes are taken; the rest of the range is of the frequent class. The counts become
two bitmaps of bounded size: a rare token that meets a bit of the first counts as frequent, which is right too (any fixed
choice of the classes is), and a token without a bit in the second is in a single text, so it signs nothing. A set of n
tokens can miss d = n // 5 of them and still reach similarity 0.8, so its prefix must hold d + 1 units: a rare token is a
unit by itself; frequent tokens are dealt into subclasses and m tokens of a subclass give m - 1 units, because
signatures of that class are pairs of tokens. Prefixes are extended until they hold enough units. Two sets that
link share a signature: one that misses a token loses one unit at most. Signatures are made for size classes, each a
factor of 1.25 wide: a set signs for its own and the next, so sets of a signature are of similar size, and the
number of subclasses follows the class. For the next class all partners are larger: a set of n tokens can miss only
(5 n - 4 m) // 9 of them, m the least size there, so its prefix for that class is shorter, or there is none.

Equal sets are one class from the start. Signatures that occur once are dropped; every class is compared with
the most typical class of each of its signatures (a star, never all pairs); classes that are joined by then
need no further test. Two classes that are still apart were both compared with the centre of the signature that
they share, so to link they must either both lie well inside the centre or share tokens outside it, as many as are
missing: tokens outside are met from the rarest on, so that a passage that many have leads to a pair only where it is long enough for a link. Only such
pairs are tested after, and of what shares a token or signature only those of smaller components with the others.
Every link is verified on the whole sets. Components come from graph.components.

Tasks work on as many texts as hold TOKENS_AT_ONCE tokens, or one longer text. Token hashes have 64 bits, all of which are
compared; classes are named by 64-bit sums of mixed hashes, so two different sets in one class are not to be expected
below 10**9 texts. Cases: null texts, and texts without words, have empty sets and
link with nothing; texts under five words are one shingle; equal rows are in one class; a null doc_id takes part, and the smallest
doc_id of a component that holds other documents names it; an empty table gives an empty result; only doc_id
and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, Window as W

from .common import discard, give_back, returned, small_side, staged, text_bytes
from .graph import components
from .shingles import mix, pack, pieces, shingle_sets, unpack

WORDS = 5
#: Texts with a token of the counted part of the hash range that make it frequent, and that make it repeated.
FREQUENT, REPEATED = 3, 2
#: The part of the hash range whose tokens are counted: prefixes are taken from the low end of it.
COUNTED = 0.4
#: Low bits of hashes that counts and signatures, which only find candidates, do without; sets are compared by all 64 bits.
DROP = np.uint64(16)
TOP = np.uint64(int(COUNTED * 2**48))
#: Most bits, as a power of two, of a bitmap (16 MB).
MOST_BITS = 27
TOKENS_AT_ONCE = 1 << 20
#: Tokens that one task counts, or signatures that it gathers.
TOKENS_A_PART = 2_000_000
#: Most rows of a side that is broadcast; more are joined by a shuffle that may split skewed keys.
MOST_GONE = 1_000_000


def _sets(batches, k: int):
    """(doc_ids, sets) for runs of rows, in order."""
    for b in returned(batches):
        data, at = text_bytes(b.column("text"))
        ids = b.column("doc_id").to_pylist()
        for first, last in pieces(at):
            yield ids[first:last], shingle_sets(data[at[first] : at[last]], at[first : last + 1] - at[first], k)


def _gathered(parts, most: int = TOKENS_AT_ONCE):
    """Lists of arrays that hold about `most` numbers together."""
    held, n = [], 0
    for x in parts:
        held.append(x)
        n += len(x)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _name(tokens: np.ndarray) -> int:
    """The class of a set."""
    return int(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def classes(docs: DataFrame, k: int) -> DataFrame:
    """Written (doc_id, n, node) of every row."""

    def run(batches):
        import pyarrow as pa

        for ids, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) for s in sets], pa.int64())], ["doc_id", "n", "node"])

    return staged(docs.mapInArrow(run, "doc_id long, n long, node long"), "join-classes")


class Bits:
    """Which tokens of the counted part of the hash range have a property; a bit stands for a range of hashes."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, tokens: np.ndarray) -> np.ndarray:
        """For tokens of 48 bits, in the counted part."""
        at = tokens >> np.uint64(48 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def token_bits(docs: DataFrame, k: int, tokens: int) -> tuple[Bits, Bits]:
    """The frequent and the repeated tokens of the counted part, by the number of texts over all blocks.

    A block sends each distinct token once, with its count, so a token that all texts hold costs a part one entry a block.
    """
    parts = max(1, -(-int(tokens * COUNTED) // TOKENS_A_PART))
    bits = int(np.clip(int(tokens).bit_length() + 3, 16, MOST_BITS))
    edges = np.array([int(TOP) * i // parts for i in range(1, parts)], np.uint64)

    def run(batches):
        import pyarrow as pa

        for held in _gathered(s[: np.searchsorted(s, TOP << DROP)] for _, sets in _sets(batches, k) for s in sets):
            t, c = np.unique(np.concatenate(held) >> DROP, return_counts=True)
            cuts = [0, *np.searchsorted(t, edges), len(t)]
            out = [(p, pack(np.diff(t[lo:hi], prepend=np.uint64(0))), pack(c[lo:hi].astype(np.uint64))) for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "tokens", "n"])

    def add(table):
        import pyarrow as pa

        t = np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in table.column("tokens").to_pylist()])
        n = np.concatenate([unpack(x) for x in table.column("n").to_pylist()])
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        t, n = t[first], np.add.reduceat(n, first)
        rows = []
        for kind, least in ((0, FREQUENT), (1, REPEATED)):
            at = np.unique(t[n >= least] >> np.uint64(48 - bits))
            if len(at):
                word, start = np.unique(at >> np.uint64(6), return_index=True)
                rows.append((kind, word.tobytes(), np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start).tobytes()))
        give_back()
        return pa.table([pa.array(c, x) for c, x in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "at", "words"])

    sent = docs.mapInArrow(run, "part long, tokens binary, n binary")
    found = staged(sent.groupBy("part").applyInArrow(add, "kind int, at binary, words binary"), "join-bits")
    out = [np.zeros(1 << (bits - 6), np.uint64) for _ in range(2)]
    for r in found.collect():  # 2**MOST_BITS bits of each kind and their places at most
        at = np.frombuffer(r["at"], np.uint64).astype(np.int64)
        out[r["kind"]][at] |= np.frombuffer(r["words"], np.uint64)  # parts may share a word at their border
    discard(found)
    return Bits(out[0], bits), Bits(out[1], bits)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which tokens of x are in y; both sorted."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


#: The least size of each size class: a class spans a factor of 1.25, so partners are of one class or of two next to each other.
CLASSES = np.array([-(-(5**k) // 4**k) for k in range(120)], float)


def signatures(tokens: np.ndarray, frequent, repeated=None) -> np.ndarray:
    """Of a sorted set, for its own size class and the next; none if only equal sets can reach 0.8.

    frequent tells tokens of 48 bits of the counted part that are of the frequent class; repeated those that may be in two texts.
    """
    n = len(tokens)
    if n < 4:
        return tokens[:0]
    counted = int(np.searchsorted(tokens, TOP << DROP))
    often = np.ones(n, bool)
    often[:counted] = frequent(tokens[:counted] >> DROP)
    first, rest = tokens[~often], tokens[often]
    kind = int(np.searchsorted(CLASSES, n, "right")) - 1
    out = []
    for level, missing in ((kind, n // 5), (kind + 1, (5 * n - 4 * int(CLASSES[kind + 1])) // 9)):
        if missing < 0:  # no set of the next class is similar enough
            continue
        salt = mix(np.array([level], np.uint64))
        rare = first[: missing + 1]
        need = missing + 1 - len(rare)
        if repeated is not None:
            rare = rare[repeated(rare >> DROP)]
        out.append(mix(rare ^ salt))
        if need:  # a set that signs for the level has at least CLASSES[level - 1] tokens
            kinds = mix(rest) % np.uint64(max(1, int(CLASSES[max(0, level - 1)]) >> 3))
            order = np.argsort(kinds, kind="stable")
            again = np.zeros(len(rest), bool)  # not the first of its subclass
            again[order[1:]] = kinds[order[1:]] == kinds[order[:-1]]
            stop = int(np.searchsorted(np.cumsum(again), need)) + 1
            order = order[order < stop]
            for step in range(1, len(order)):  # pairs of a subclass, by their distance in it
                same = kinds[order[step:]] == kinds[order[:-step]]
                if not same.any():
                    break
                a, b = rest[order[:-step][same]], rest[order[step:][same]]
                out.append(mix((mix(a) * np.uint64(3) + mix(b) * np.uint64(5)) ^ salt))
    return np.unique(np.concatenate(out))


def postings(docs: DataFrame, bits: tuple[Bits, Bits], k: int, tokens: int) -> DataFrame:
    """Written rows (sig, node) of the signatures that two classes have.

    Signatures that a block of rows already holds twice pass as they are, with one of them sent along to the
    part that gathers the signature from all blocks; so no part gets more of a signature than there are blocks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    parts = max(1, -(-tokens // (2 * TOKENS_A_PART)))

    def send(sig, node):
        import pyarrow as pa

        sig = sig >> DROP
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        new = np.r_[True, sig[1:] != sig[:-1]]
        twice = ~(new & np.r_[new[1:], True])
        cuts = [0, *np.searchsorted(sig, np.array([(i << 48) // parts for i in range(1, parts)], np.uint64)), len(sig)]
        rows = []
        for p, keep in [(-1, np.flatnonzero(twice)), *((p, lo + np.flatnonzero(new[lo:hi])) for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))]:
            if len(keep):
                names, at = np.unique(node[keep], return_inverse=True)
                rows.append((p, pack(np.diff(sig[keep], prepend=np.uint64(0))), names.tobytes(), pack(at.astype(np.uint64))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "sig", "names", "at"])

    def run(batches):
        frequent, repeated = shared.value
        seen, sigs, nodes, n = set(), [], [], 0
        for _, sets in _sets(batches, k):
            for s in sets:
                if (node := _name(s)) not in seen:
                    seen.add(node)
                    sigs.append(x := signatures(s, frequent.has, repeated.has))
                    nodes.append(np.full(len(x), node, np.int64))
                    n += len(x)
            if n >= TOKENS_AT_ONCE // 2 or len(seen) >= TOKENS_AT_ONCE // 8:
                yield from send(np.concatenate(sigs), np.concatenate(nodes))
                seen, sigs, nodes, n = set(), [], [], 0
        if n:
            yield from send(np.concatenate(sigs), np.concatenate(nodes))

    def gather(table):
        import pyarrow as pa

        cols = table.to_pydict()
        sig = np.concatenate([np.cumsum(unpack(x), dtype=np.uint64) for x in cols["sig"]]).astype(np.int64)
        node = np.concatenate([np.frombuffer(x, np.int64)[unpack(y)] for x, y in zip(cols["names"], cols["at"], strict=True)])
        if cols["part"][0] >= 0:
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
            sig, node = sig[new], node[new]
            same = sig[1:] == sig[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            sig, node = sig[keep], node[keep]
            give_back()
        return pa.table({"sig": sig, "node": node})

    sent = docs.mapInArrow(run, "part long, sig binary, names binary, at binary")
    passed = F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("sig"), F.lit(1 << 40))).otherwise(F.col("part"))
    out = staged(sent.withColumn("part", passed).groupBy("part").applyInArrow(gather, "sig long, node long"), "join-postings")
    shared.unpersist()
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, repeated: Bits, k: int, n: int) -> DataFrame:
    """Written (node, tokens, shared) for the n classes among nodes; shared: which tokens may be in two texts.

    A bitmap keeps other classes from being sent; it has eight bits and more for each class, up to 2**MOST_BITS, and a class may be sent
    once for each run of rows that has it.
    """
    bits = int(np.clip(int(n).bit_length() + 3, 12, MOST_BITS))
    bit = F.shiftrightunsigned("node", 64 - bits)
    words = nodes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toPandas()  # 2**(MOST_BITS - 6) rows at most
    wanted = np.zeros(1 << (bits - 6), np.uint64)
    wanted[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast((wanted, repeated))

    def run(batches):
        import pyarrow as pa

        (m, repeated), sent = shared.value, set()
        for _, sets in _sets(batches, k):
            found = {}
            for s in sets:
                node = _name(s)
                at = (node & (2**64 - 1)) >> (64 - bits)
                if m[at >> 6] >> np.uint64(at & 63) & np.uint64(1) and node not in sent:
                    found[node] = s
                    sent.add(node)
            if len(sent) > TOKENS_AT_ONCE // 8:
                sent.clear()
            if found:
                some = []
                for s in found.values():
                    low = np.ones(len(s), bool)
                    counted = int(np.searchsorted(s, TOP << DROP))
                    low[:counted] = repeated.has(s[:counted] >> DROP)
                    some.append(np.packbits(low).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([pack(np.diff(s, prepend=np.uint64(0))) for s in found.values()], pa.binary()), pa.array(some, pa.binary())], ["node", "tokens", "shared"])

    sent = docs.mapInArrow(run, "node long, tokens binary, shared binary")
    out = staged(sent.join(F.broadcast(nodes) if n <= MOST_GONE else nodes, "node", "left_semi").dropDuplicates(["node"]), "join-sets")
    shared.unpersist()
    return out


def _tokens(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def compared(pairs: DataFrame, sets: DataFrame, tag: str) -> DataFrame:
    """Written (a, b, na, nb, c, extra): sizes, common tokens, and the tokens of a outside b that may be in two texts."""
    ones, others = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"), "shared"), sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    if pairs.count() <= MOST_GONE:  # then only sets of the pairs are shuffled
        pairs = F.broadcast(pairs)
        others = others.join(pairs, "b", "left_semi")
    both = pairs.join(ones, "a").join(others, "b").select("a", "b", "ta", "tb", "shared")

    def run(batches):
        import pyarrow as pa

        for p in returned(batches):
            out = []
            for x, y, some in zip(p.column("ta"), p.column("tb"), p.column("shared"), strict=True):
                x, y = _tokens(x.as_py()), _tokens(y.as_py())
                inside = _common(x, y)
                c = int(inside.sum())
                extra = x[~inside & (np.unpackbits(np.frombuffer(some.as_py(), np.uint8), count=len(x)) == 1)]
                out.append((len(x), len(y), c, extra.tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["a", "b", "na", "nb", "c", "extra"])

    return staged(both.mapInArrow(run, "a long, b long, na long, nb long, c long, extra binary"), tag)


def linked(d: DataFrame, percent: int) -> DataFrame:
    return d.filter(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def _exploded(batches):
    """Rows of the columns, once for each token of extra."""
    import pyarrow as pa

    for p in batches:
        extra = p.column("extra")
        sizes = np.array([len(x.as_py()) // 8 for x in extra], np.int64)
        tokens = np.frombuffer(b"".join(x.as_py() for x in extra), np.int64)
        rows = pa.array(np.repeat(np.arange(p.num_rows), sizes))
        names = [n for n in p.schema.names if n != "extra"]
        yield pa.RecordBatch.from_arrays([*(p.column(n).take(rows) for n in names), pa.array(tokens)], [*names, "token"])


def across(rows: DataFrame, on: list[str], keep, more: list[str] = ()) -> DataFrame:
    """(a, b): pairs of the rows (a, n, c, r, more) that share `on` and differ in r, if keep holds for columns a1, a2, n1, ...

    Of each `on` with several r, the rows of its most frequent r meet only the others: work follows the pairs that differ.
    """
    each = rows.groupBy(*on, "r").agg(F.count("*").alias("w"))
    several = each.groupBy(*on).agg(F.max(F.struct("w", "r"))["r"].alias("most"), F.count("*").alias("rs")).filter("rs > 1").select(*on, "most")
    rows = rows.join(several, on)
    side = lambda x, i, *names: x.select(*on, *(F.col(k).alias(f"{k}{i}") for k in ("a", "n", "c", "r", *more)), *names)
    one, two = side(rows.filter("r <> most"), 1, "most"), side(rows, 2)
    once = (F.col("a1") < F.col("a2")) | (F.col("r2") == F.col("most"))  # two rows of other r meet both ways
    return one.join(two, on).filter((F.col("r1") != F.col("r2")) & once & keep).select(F.least("a1", "a2").alias("a"), F.greatest("a1", "a2").alias("b"))


def _apart(d: DataFrame) -> DataFrame:
    """The rows (b, r, ...) of centres b whose rows here are of several components r."""
    several = d.groupBy("b").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo < hi").select("b")
    return d.join(several, "b", "left_semi").select(d.columns)  # a join puts its key first, and Arrow tasks take columns by place


def outside_prefixes(d: DataFrame, percent: int) -> DataFrame:
    """(a, z, n, c, r, token, rest) of the rows (a, b, n, c, r, extra) of d: tokens outside the centre by which a may meet a partner; rest: how many more it may share with one that it first meets there.

    A partner that is found by no token of the centre shares at least percent * n - c of the n - c tokens outside of it. In the order
    of the centre's classes those that one component has come first, then the others by how many classes have them, so one of the first
    n - c - (that number) + 1 tokens is shared, and what many have is met last, when few tokens are left to share.
    """
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * percent / 100) - F.col("c"))
    d = _apart(d.filter(F.octet_length("extra") / 8 >= need))
    rows = d.mapInArrow(_exploded, "a long, b long, n long, c long, r long, token long").withColumnRenamed("b", "z")
    rows = staged(rows, "join-outside")
    held = rows.groupBy("z", "token").agg(F.count("*").alias("f"), F.min("r").alias("lo"), F.max("r").alias("hi")).filter("lo < hi").select("z", "token", "f")
    of = W.partitionBy("a", "z")  # the tokens of a text
    met = rows.join(held, ["z", "token"]).withColumns({"q": F.count("*").over(of), "k": F.row_number().over(of.orderBy("f", "token"))})
    return met.filter(F.col("q") - F.col("k") + 1 >= need).select("a", "z", "n", "c", "r", "token", (F.col("q") - F.col("k")).alias("rest"))


def still_apart(post: DataFrame, star: DataFrame, stars: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link though their classes are not joined yet.

    Two classes of a signature have both been compared with its star's centre z. If they link, then either the
    tokens that each shares with z are as many as a link needs, or they share tokens outside z, as many as are missing.
    """
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    d = stars.join(root("a"), "a", "left").join(root("b"), "b", "left").withColumn("r", F.coalesce("ra", "a")).withColumn("rz", F.coalesce("rb", "b"))
    mixed = d.groupBy("b").agg(F.min(F.least("r", "rz")).alias("lo"), F.max(F.greatest("r", "rz")).alias("hi")).filter("lo < hi").select("b")
    d = staged(d.join(mixed, "b", "left_semi").select("a", "b", F.col("na").alias("n"), "c", "r", "extra"), "join-mixed")
    n, low, union = F.col("n1") + F.col("n2"), F.least("c1", "c2"), 100 + percent
    sizes = (F.col("n1") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n1") * percent)
    most = low + F.least("rest1", "rest2") + 1
    # Pairs that lie well inside z are those of `inside`.
    outside = across(outside_prefixes(d, percent), ["z", "token"], sizes & (low * union < n * percent) & (most * union >= n * percent), ["rest"])
    well = staged(_apart(d.filter(F.col("c") * 100 >= F.col("n") * percent).select(F.col("a").alias("node"), "a", "b", "n", "c", "r")), "join-well")
    # In a signature of two classes one is the centre, and nothing is left for the other to meet.
    met = staged(star.filter("held > 2").join(well.select("b").distinct(), "b", "left_semi").select("sig", "b"), "join-met")
    inner = post.join(F.broadcast(met) if met.count() <= MOST_GONE else met, "sig").join(well, ["node", "b"])
    inside = across(inner.select("sig", "a", "n", "c", "r"), ["sig"], sizes & (low * union >= n * percent))
    out = staged(outside.union(inside).distinct(), "join-rest")
    discard(d, well, met)
    return out


def join(docs: DataFrame, k: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row. The prefixes are those of 80 percent, so percent may not be lower."""
    assert percent >= 80
    docs = docs.select("doc_id", "text")
    rows = classes(docs, k)
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    bits = token_bits(docs, k, tokens)
    post = postings(docs, bits, k, tokens)
    # The most typical class of a signature: the one with the most shared signatures.
    weight = post.groupBy("node").agg(F.count("*").alias("w"))
    heavy = post.join(weight, "node")
    star = heavy.groupBy("sig").agg(F.max(F.struct("w", "node")).alias("top"), F.count("*").alias("held")).select("sig", F.col("top.node").alias("b"), "held")
    star = staged(star, "join-centres")
    pairs = post.join(star, "sig").filter("node <> b").groupBy(F.col("node").alias("a"), "b").agg(F.max("held").alias("held"))
    # A centre that shares only signatures of two classes with this one leads to no third: then sizes decide whether to compare.
    size = rows.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"))
    pairs = pairs.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    close = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = staged(pairs.filter((F.col("held") > 2) | close).select("a", "b"), "join-pairs")
    nodes = staged(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "join-nodes")
    sets = sets_of(docs, nodes, bits[1], k, nodes.count())
    stars = compared(pairs, sets, "join-stars")
    links = linked(stars, percent)
    roots = components(links)
    rest = still_apart(post, star, stars, roots, percent)
    done = [post, star, pairs, nodes, sets, stars, rest]
    if not rest.isEmpty():
        tested = compared(rest, sets, "join-tested")
        new = linked(tested, percent)
        if not new.isEmpty():  # what is joined so far is a star for each component
            roots = components(new.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        done.append(tested)
    discard(*done)
    d = rows.join(roots, "node", "left").withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    least = small_side(d.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least")), "join-least", MOST_GONE)
    return d.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: one of its smallest doc_id, or any if none has one. Rows count by themselves, whether or not they share a doc_id. Columns may have any names."""
    names = docs.columns
    numbered = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    at = {c: F.col(f"_c{i}") for i, c in enumerate(names)}
    rows = staged(numbered.select("*", at["doc_id"].alias("doc_id"), at["text"].alias("text"), F.monotonically_increasing_id().alias("_row")), "join-rows")
    found = join(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    found = rows.select("_row", "doc_id").join(found, "_row")
    found = staged(found, "join-found")
    least = found.groupBy("_group").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_kept")).filter("_n > 1")
    least = small_side(least, "join-groups", MOST_GONE)
    gone = staged(found.join(least, "_group").filter("_row <> _kept").select("_row"), "join-gone")
    discard(found)
    kept = rows.join(F.broadcast(gone) if gone.count() <= MOST_GONE else gone, "_row", "left_anti")
    return kept.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))


def op5(spark, sf_dir):
    from .common import table

    return join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s)::bigint AS n_shingles, component_id FROM s JOIN c ON s.doc_id = c.a
"""
