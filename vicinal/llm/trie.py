"""Prefix trie of conversations by van Emde Boas recursion.

Conversations are rebuilt first: the opening turns of another one stand before a conversation's own. A trie of height
2H is cut at half its depth into an upper trie and a forest of lower ones, one below each cut prefix, and so on down to
height 1; all tries of one height are worked on at once, each row of a task being a piece of a conversation.

Naming goes down: spans of 2, 4, 8, ... turns have names made of their halves' names, and a cut prefix is named by the
name of the prefix above it and the span between, so log2(depth) joins name every prefix of every conversation and prefixes that
are equal have equal names. A node is then known by its smallest member and its depth. Totals go up: sums over the
subtrees inside pieces of height H become those of height 2H when each node at the top of a lower trie grafts its sum on its
ancestors in the upper one, which it finds on the path of its smallest member. Every level is a join and an aggregate,
so no task holds a conversation, a node's members or a subtree.

Names are pairs of 64-bit hashes; two prefixes that agree in both are not to be expected. The members that end in a node are
joined to text in runs of SPAN ids and hashed as a stream, in order.

Cases: rows with a null conv_id are no turns of any conversation; null role or text is empty; turns order by turn, null
first, and those of one number by a hash of role and text; repeated rows are turns each; a conversation whose own
turns are all replaced by those of a missing one has no turn and is a member of the root only; depth has no limit; an
empty table gives an empty result. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import discard, ranked, staged

#: What a conversation takes the opening of: the first multiple of so many ids at or below its own; and fewer turns than so many.
GROUP, OPENING = 5, 9
#: Ids of a run of members that is one text.
SPAN = 1 << 14


def name(*parts: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), *parts).alias("x"), F.xxhash64(F.lit(2), *parts).alias("y")


def placed(turns: DataFrame) -> DataFrame:
    """Written (conv_id, at, x, y, size): the place of each turn in its conversation, from 1, its name, and the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = staged(rows.withColumn("uid", F.monotonically_increasing_id()), "trie-rows")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("uid")]
    rows = ranked(rows, order, [], "trie-ranges")
    first = rows.groupBy("conv_id").agg(F.min("_place").alias("first"))
    return staged(rows.join(first, "conv_id").select("conv_id", (F.col("_place") - F.col("first") + 1).alias("at"), *name(F.col("digest")), "size"), "trie-placed")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written (conv_id, n): every conversation and its number of turns once rebuilt, and (conv_id, d, n, x, y, size): its turns."""
    rows = placed(turns)
    convs = staged(rows.groupBy("conv_id").agg(F.count("*").alias("own")), "trie-own")
    opening = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % OPENING
    every = convs.withColumns({"h": opening, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    every = every.join(convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    every = staged(every.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), "trie-convs")
    own = rows.join(every, "conv_id").filter("at > h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("d"), "n", "x", "y", "size")
    lent = rows.filter(F.col("at") < OPENING).withColumnRenamed("conv_id", "base").join(every, "base").filter("at <= taken").select("conv_id", F.col("at").alias("d"), "n", "x", "y", "size")
    out = staged(own.union(lent), "trie-turns")
    return every.select("conv_id", "n"), out


def spans(turns: DataFrame, deepest: int) -> list[DataFrame]:
    """For each power of two below the depth, (conv_id, o, x, y): the names of the spans of so many turns after the first o, o a multiple of that power."""
    out = [turns.select("conv_id", (F.col("d") - 1).alias("o"), "x", "y")]
    while 2 << len(out) - 1 <= deepest:
        half = 1 << len(out) - 1
        low = F.col("o").bitwiseAND(half) == 0
        pick = lambda c, side: F.max(F.when(side, F.col(c)))
        both = out[-1].groupBy("conv_id", (F.col("o") - F.col("o") % (2 * half)).alias("o")).agg(*(pick(c, s).alias(f"{c}{k}") for k, s in enumerate((low, ~low)) for c in "xy"))
        out.append(staged(both.filter("x0 IS NOT NULL AND x1 IS NOT NULL").select("conv_id", "o", *name(*map(F.col, ("x0", "y0", "x1", "y1")))), "trie-spans"))
    return out


def prefixes(convs: DataFrame, turns: DataFrame, deepest: int) -> DataFrame:
    """Written (conv_id, n, d, x, y): the name of the first d turns of each conversation, d from 0 to n."""
    levels = spans(turns, deepest)
    out = convs.select("conv_id", "n", F.lit(0).cast("long").alias("d"), *name(F.lit("root")))
    for k in reversed(range(len(levels) if deepest else 0)):
        half = 1 << k
        cut = levels[k].filter(F.col("o") % (2 * half) == 0).select("conv_id", F.col("o").alias("d"), F.col("x").alias("sx"), F.col("y").alias("sy"))
        x, y = name(*map(F.col, ("x", "y", "sx", "sy")))
        lower = F.when(F.col("sx").isNotNull(), F.struct((F.col("d") + half).alias("d"), x, y))
        both = out.join(cut, ["conv_id", "d"], "left").select("conv_id", "n", F.explode(F.array(F.struct("d", "x", "y"), lower)).alias("p"))
        old, out = out, staged(both.filter("p IS NOT NULL").select("conv_id", "n", "p.*"), "trie-names")
        discard(*(f for f in (old,) if hasattr(f, "staged_at")))
    discard(*levels[1:])
    return out


def grafted(paths: DataFrame, own: DataFrame, deepest: int) -> DataFrame:
    """(conv_id, depth, saved_tokens, n_leaves): the sums of own (conv_id, depth, saved_tokens, n_leaves) over subtrees, but for the root's."""
    sums = [F.sum(c).alias(c) for c in ("saved_tokens", "n_leaves")]
    total, height = own, 1
    while height < deepest:
        top = total.filter((F.col("depth") > height) & ((F.col("depth") - 1) % (2 * height) == height))
        top = top.groupBy("conv_id", "depth").agg(*sums).withColumn("piece", F.floor((F.col("depth") - 1) / height) - 1)
        above = paths.filter(F.col("d") > 0).select("conv_id", F.floor((F.col("d") - 1) / height).alias("piece"), F.col("d").alias("up"), "node").filter(F.col("piece") % 2 == 0)
        graft = top.join(above, ["conv_id", "piece"]).groupBy(F.col("node").alias("conv_id"), F.col("up").alias("depth")).agg(*sums)
        total, height = total.union(staged(graft, "trie-graft")), 2 * height
    return total.groupBy("conv_id", "depth").agg(*sums)


def ends(members: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes in which members (node, depth, conv_id) end."""
    run = members.groupBy("node", "depth", F.floor(F.col("conv_id") / SPAN).alias("span")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def hashed(batches):
        import hashlib

        import pyarrow as pa

        open_, state = None, None
        for b in batches:
            done = []
            for node, depth, ids in zip(*(b.column(c).to_pylist() for c in ("node", "depth", "ids")), strict=True):
                if (node, depth) == open_:
                    state.update(b",")
                else:
                    if open_:
                        done.append((*open_, state.hexdigest()))
                    open_, state = (node, depth), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["conv_id", "depth", "ends_sha256"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*open_, state.hexdigest())], ["conv_id", "depth", "ends_sha256"])

    return run.repartition("node", "depth").sortWithinPartitions("node", "depth", "span").mapInArrow(hashed, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(turns)
    deepest = convs.agg(F.max("n")).first()[0] or 0
    names = prefixes(convs, turns, deepest)
    nodes = staged(names.groupBy("x", "y").agg(F.min("conv_id").alias("node"), F.min("d").alias("depth"), F.count("*").alias("n_convs")), "trie-nodes")
    paths = staged(names.join(nodes.select("x", "y", "node"), ["x", "y"]).select("conv_id", "n", "d", "node"), "trie-paths")
    facts = nodes.select(F.col("node").alias("conv_id"), "depth", "n_convs")
    facts = facts.join(paths.select("conv_id", (F.col("d") + 1).alias("depth"), F.col("node").alias("parent_conv_id")), ["conv_id", "depth"], "left")
    facts = staged(facts.join(turns.select("conv_id", F.col("d").alias("depth"), "size"), ["conv_id", "depth"], "left"), "trie-facts")
    children = facts.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    facts = staged(facts.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")
    own = facts.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.coalesce("size", F.lit(0).cast("long"))).alias("saved_tokens"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    totals = staged(grafted(paths, own, deepest), "trie-totals")
    root = facts.filter("depth = 0").select("conv_id", "depth")
    below = totals.filter("depth = 1").agg(*(F.sum(c).alias(c) for c in ("saved_tokens", "n_leaves"))).withColumn("depth", F.lit(0).cast("long"))
    below = root.join(F.broadcast(below), "depth").select("conv_id", "depth", "saved_tokens", "n_leaves").filter("n_leaves IS NOT NULL")  # one row
    totals = totals.union(below).groupBy("conv_id", "depth").agg(*(F.sum(c).alias(c) for c in ("saved_tokens", "n_leaves")))
    ended = ends(paths.filter("d = n").select("node", F.col("d").alias("depth"), "conv_id"))
    out = facts.join(totals, ["conv_id", "depth"]).join(ended, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return trie(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS s FROM bits WHERE k = 8),
t AS (SELECT conv_id, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, own, xor(list_reduce(
    list_prepend(4294967295::bigint, [('0x' || h)::bigint FOR h IN regexp_extract_all(hex(encode(conv_id::varchar)), '..')]),
    lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id), tab),
r AS (SELECT c.conv_id, least(h, coalesce(b.own, 0)) + pos - h AS d, m, text FROM t JOIN c USING (conv_id) LEFT JOIN (SELECT conv_id AS base, own FROM c) b USING (base) WHERE pos > h
  UNION ALL SELECT c.conv_id, pos, m, text FROM c JOIN t ON t.conv_id = c.base WHERE pos <= h),
p AS (SELECT conv_id, d, strlen(text) AS size, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT k, min(conv_id) AS conv_id, max(d) AS depth, count(*) AS n_convs, max(size) AS size FROM p GROUP BY k),
u AS (SELECT n.*, v.conv_id AS parent FROM n LEFT JOIN n v ON n.depth > 0 AND v.k = left(n.k, 32 * (n.depth - 1)::int)),
kids AS (SELECT left(k, 32 * (depth - 1)::int) AS k, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1),
w AS (SELECT left(u.k, 32 * i::int) AS k, (kids IS NULL)::int AS leaf, (n_convs - 1) * size AS saved FROM u LEFT JOIN kids USING (k), range(1000) g(i) WHERE i <= depth),
s AS (SELECT k, sum(leaf) AS leaves, sum(saved) AS saved FROM w GROUP BY k),
e AS (SELECT k, string_agg(conv_id::varchar, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(k, d) AS k FROM p GROUP BY conv_id) GROUP BY k)
SELECT u.conv_id, u.depth::bigint AS depth, u.parent AS parent_conv_id, u.n_convs, coalesce(kids, 0)::bigint AS n_children, leaves::bigint AS n_leaves,
  saved::bigint AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM u JOIN s USING (k) LEFT JOIN kids USING (k) LEFT JOIN e USING (k)
"""
