"""Symbol sequences derived from the given tables, as DataFrames and as the SQL of the same views."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.tmers import Shape, kmers, tmer_counts
from ..staging import staged

ALPHA, SYMBOLS = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
EVENTS = {"signup": "A", "purchase": "C", "error": "G", "view": "T"}
SHAPE = Shape(4, 2, 1)
#: Letters of a piece of a long sequence of events, about; a mark that is no letter.
PIECE, CUT = 4096, "-"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    """Tasks to deal chunks out to: the given tables are a file or a few."""
    return spark.sparkContext.defaultParallelism


def seq_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.translate(F.lower("text"), ALPHA, SYMBOLS).alias("seq"), "source")


def pair_docs(spark: SparkSession, d: str) -> DataFrame:
    """id, s1, s2: a document and the next one."""
    s = seq_docs(spark, d)
    a, b = s.select(F.col("doc_id").alias("id"), F.col("seq").alias("s1")), s.select((F.col("doc_id") - 1).alias("id"), F.col("seq").alias("s2"))
    return a.join(b, "id")


def trio_docs(spark: SparkSession, d: str) -> DataFrame:
    s = seq_docs(spark, d)
    return pair_docs(spark, d).join(s.select((F.col("doc_id") - 2).alias("id"), F.col("seq").alias("s3")), "id")


def pair_counts(spark: SparkSession, d: str, shape: Shape = SHAPE) -> DataFrame:
    return tmer_counts(pair_docs(spark, d), shape, "s1", "s2", spread=spread(spark))


def written_counts(spark: SparkSession, d: str, shape: Shape = SHAPE) -> DataFrame:
    """The same as a written table, for queries that use the counts several times."""
    return staged(pair_counts(spark, d, shape), "counts")


def event_runs(spark: SparkSession, d: str, k: int | None = None) -> DataFrame:
    """user_id, grp, part, no, text: the letters of each user in order of (ts, event_id), no user in one task.

    Events are sorted by ranges of (user_id, ts, event_id), so a user's run may go over several parts. A run is cut into
    pieces, grp a number of its own. With k, pieces overlap by k - 1 letters, and a row with grp -1 tells the run's
    ends: the first and last k - 1 letters with CUT between, or a run of at most 2 (k - 1) letters whole, and then no piece.
    """
    e = table(spark, d, "events")
    letter = F.coalesce(F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])[F.col("event_type")], F.lit("N"))
    keys = ["user_id", "ts", "event_id", "c"]
    e = e.select("user_id", "ts", "event_id", letter.alias("c")).repartitionByRange(*keys).sortWithinPartitions(*keys).select("user_id", "c")
    kind, over = e.schema["user_id"].dataType, (k or 1) - 1

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, no, user, n, text, head, rows = TaskContext.get().partitionId(), 0, None, 0, "", "", []

        def piece(last):
            """Puts out the letters at hand, but for the overlap; at the last of a run, its ends too."""
            nonlocal no, text
            if n > 2 * over and len(text) > over:
                rows.append((user, part << 32 | no, part, no, text))
                no += 1
            if last and n and k:
                rows.append((user, -1, part, 0, text if n <= 2 * over else head + CUT + text[len(text) - over :]))
            text = text[len(text) - over :] if n > 2 * over and over else text if n <= 2 * over else ""

        def out():
            found = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(found, ["user_id", "grp", "part", "no", "text"])

        types = None
        for b in batches:
            types = [b.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.string()]
            users, letters, at = b.column(0).to_pylist(), "".join(b.column(1).to_pylist()), 0
            for u, group in itertools.groupby(users):
                m = sum(1 for _ in group)
                if u != user:
                    piece(True)
                    user, n, text, head = u, 0, "", ""
                text += letters[at : at + m]
                n, at = n + m, at + m
                head = head if len(head) == over else text[:over]
                if len(text) >= PIECE:
                    piece(False)
            if rows:
                yield out()
        piece(True)
        if rows:
            yield out()

    return e.mapInArrow(run, f"user_id {kind.simpleString()}, grp long, part int, no int, text string")


def event_texts(spark: SparkSession, d: str, k: int, cyclic: bool = False) -> DataFrame:
    """seq: bounded texts whose windows of k letters without CUT are those of all users' sequences."""
    g = event_runs(spark, d, k).groupBy("user_id", "grp").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("l"))
    seq = F.concat_ws("", F.transform("l", lambda x: x["text"]))
    g = g.select("grp", seq.alias("seq"))
    if cyclic:  # what is left after the end goes on at the beginning
        g = g.withColumn("seq", F.when(F.col("grp") == -1, F.concat("seq", F.substring(F.repeat("seq", k), 1, k - 1))).otherwise(F.col("seq")))
    return g.select("seq")


def event_kmers(spark: SparkSession, d: str, k: int, cyclic: bool = False) -> DataFrame:
    """pattern, count over the sequences of all users, unknown letters included."""
    return kmers(event_texts(spark, d, k, cyclic), "seq", k, cyclic=False, alphabet=None).filter(~F.contains("pattern", F.lit(CUT)))


def seq_events(spark: SparkSession, d: str) -> DataFrame:
    """user_id, seq: for what gives the whole string out; gathered from pieces, a byte an event."""
    g = event_runs(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("part", "no", "text"))).alias("l"))
    return g.select("user_id", F.concat_ws("", F.transform("l", lambda x: x["text"])).alias("seq"))


def spin_pairs(spark: SparkSession, d: str) -> DataFrame:
    """l_orderkey, s1, s2: two aligned sequences of an order's lines."""
    x = lambda c: F.when(c, "X").otherwise("O")
    line = F.struct("l_linenumber", "l_linestatus", "l_returnflag", x(F.col("l_linestatus") == "F").alias("a"), x(F.col("l_returnflag") != "N").alias("b"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("l"))
    return g.select("l_orderkey", F.concat_ws("", F.transform("l", lambda x: x["a"])).alias("s1"), F.concat_ws("", F.transform("l", lambda x: x["b"])).alias("s2"))


def spin_lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("l_linestatus") == "F", "X").otherwise("O")
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_linestatus", c.alias("c")))).alias("l"))
    return g.select("l_orderkey", F.concat_ws("", F.transform("l", lambda x: x["c"])).alias("seq"))


SEQ = f"seq_docs AS (SELECT doc_id, translate(lower(text), '{ALPHA}', '{SYMBOLS}') AS seq, source FROM documents)"
PAIR = SEQ + ", pair_docs AS (SELECT a.doc_id AS id, a.seq AS s1, b.seq AS s2 FROM seq_docs a JOIN seq_docs b ON b.doc_id = a.doc_id + 1)"
EVENT_SEQ = "seq_events AS (SELECT user_id, string_agg(CASE event_type WHEN 'signup' THEN 'A' WHEN 'purchase' THEN 'C' WHEN 'error' THEN 'G' WHEN 'view' THEN 'T' ELSE 'N' END, '' ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id)"
SPIN = "spin_lines AS (SELECT l_orderkey, string_agg(CASE l_linestatus WHEN 'F' THEN 'X' ELSE 'O' END, '' ORDER BY l_linenumber, l_linestatus) AS seq FROM lineitem GROUP BY l_orderkey)"


SPIN_PAIR = "spin_pairs AS (SELECT l_orderkey, string_agg(CASE l_linestatus WHEN 'F' THEN 'X' ELSE 'O' END, '' ORDER BY l_linenumber, l_linestatus, l_returnflag) AS s1, string_agg(CASE l_returnflag WHEN 'N' THEN 'O' ELSE 'X' END, '' ORDER BY l_linenumber, l_linestatus, l_returnflag) AS s2 FROM lineitem GROUP BY l_orderkey)"


def windows_sql(shape: Shape = SHAPE) -> str:
    n, w, o = shape.longwin, shape.shortwin, shape.leftwin
    return PAIR + f""", wins AS (SELECT id, pos, substr(s1, pos, {n}) AS long, substr(s2, pos + {o}, {w}) AS short
      FROM (SELECT id, s1, s2, unnest(range(1, least(length(s1), length(s2)) - {n - 2})) AS pos FROM pair_docs)),
    ok AS (SELECT * FROM wins WHERE NOT regexp_matches(long, '[^ACGT]') AND NOT regexp_matches(short, '[^ACGT]'))"""


def counts_sql(shape: Shape = SHAPE) -> str:
    return windows_sql(shape) + ", counts AS (SELECT long, short, count(*) AS count FROM ok GROUP BY ALL)"
