"""Registered queries of the readers and writers: sequences and tables derived from the given ones, written in a format and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import tmers as C
from ..sources import readers, writers
from ..staging import shared_dir
from .views import PAIR, SEQ, counts_sql, pair_counts, pair_docs, seq_docs, table

#: name: (query, SQL)
FORMATS: dict = {}


def query(name: str, sql: str):
    def put(fn):
        FORMATS[name] = fn, sql
        return fn

    return put


def _path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/vicinal/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, value, name: str, sep: str = "\n") -> str:
    path = _path(df.sparkSession, name)
    df.select(value.alias("value")).write.option("lineSep", sep).text(path)
    return path


CLEAN = PAIR + ", clean AS (SELECT id, regexp_replace(s1, '[^ACGT]', '', 'g') AS a, regexp_replace(s2, '[^ACGT]', '', 'g') AS b FROM pair_docs), full_pairs AS (SELECT * FROM clean WHERE a <> '' AND b <> '')"


def _clean(spark, d):
    clean = lambda c, n: F.regexp_replace(c, "[^ACGT]", "").alias(n)
    return pair_docs(spark, d).select("id", clean("s1", "a"), clean("s2", "b")).filter("a <> '' AND b <> ''")


@query("axt_blocks", f"WITH {CLEAN} SELECT id AS block_id, 'chr' || (id % 5) AS chrom, 1::bigint AS start, length(a) AS \"end\", 'other' AS chrom2, 5::bigint AS start2, length(b) + 4 AS end2, '+' AS strand, id * 10 AS score, a AS seq1, b AS seq2 FROM full_pairs")
def _(spark, d):
    c = lambda x: x.cast("string") if not isinstance(x, str) else F.lit(x)
    info = F.concat_ws(" ", c(F.col("id")), F.concat(F.lit("chr"), c(F.col("id") % 5)), c("1"), c(F.length("a")), c("other"), c("5"), c(F.length("b") + 4), c("+"), c(F.col("id") * 10))
    return readers.axt(spark, _text(_clean(spark, d), F.concat_ws("\n", info, "a", "b"), "axt", "\n\n"))


@query("paired_fasta_records", f"WITH {CLEAN} SELECT '>d' || id AS head1, a AS seq1, '>d' || id || '_next' AS head2, b AS seq2 FROM full_pairs")
def _(spark, d):
    head = F.concat(F.lit(">d"), F.col("id").cast("string"))
    return readers.paired_fasta(spark, _text(_clean(spark, d), F.concat_ws("\n", head, "a", F.concat(head, F.lit("_next")), "b"), "fasta"))


@query("position_lines", "SELECT 'c' || o_custkey AS chrom, o_orderkey AS start, o_orderkey + 40 AS \"end\" FROM orders")
def _(spark, d):
    line = F.concat_ws(" ", F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.col("o_orderkey").cast("string"), (F.col("o_orderkey") + 40).cast("string"), "o_orderstatus")
    return readers.positions(spark, _text(table(spark, d, "orders"), line, "positions"))


@query("counts_file", f"WITH {counts_sql()} SELECT long, short, count::double AS count FROM counts")
def _(spark, d):
    path = _path(spark, "counts")
    writers.counts(pair_counts(spark, d), path, C.Shape(4, 2, 1))
    got, shape = readers.counts(spark, path)
    assert shape == C.Shape(4, 2, 1)
    return got


#: Whole texts in lines of 40 sites, the last one filled up; taxa of an alignment, about: the task that writes one has its lines at hand.
SITES, TAXA = 40, 100_000
PIECES = f"""{SEQ}, s AS (SELECT doc_id, regexp_replace(seq, '[^ACGT]', '', 'g') AS seq FROM seq_docs),
pieces AS (SELECT 't' || doc_id || '_' || k AS taxon, rpad(substr(seq, (k * {SITES} + 1)::int, {SITES}), {SITES}, '-') AS seq FROM (SELECT doc_id, seq, unnest(range(0, (length(seq) + {SITES - 1}) // {SITES})) AS k FROM s))"""


def _alignment(spark, d, parts: int) -> str:
    """Alignments of all texts' lines, each in `parts` blocks, under a head line in every file: more texts are more files."""
    s = seq_docs(spark, d).select("doc_id", F.regexp_replace("seq", "[^ACGT]", "").alias("seq")).filter("seq <> ''")
    files = max(16, -(-(s.agg(F.sum(F.ceil(F.length("seq") / SITES))).first()[0] or 0) // TAXA))
    s = s.select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{SITES}}}"), F.lit(0))).alias("k", "line"))
    line = F.rpad("line", SITES, "-")
    s = s.select(F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit("_"), F.col("k").cast("string")).alias("taxon"), line.alias("seq")).repartition(files, "taxon")
    width = SITES // parts

    def lines(batches):
        import pyarrow as pa

        rows = [(t, q) for b in batches for t, q in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([f" {len(rows)} {SITES}"])], ["value"])
        for k in range(parts):
            cut = slice(k * width, (k + 1) * width)
            for lo in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([f"{t}  {q[cut][:9]} {q[cut][9:]}" if k == 0 else f"   {q[cut]}" for t, q in rows[lo : lo + 4096]])], ["value"])
            yield pa.RecordBatch.from_arrays([pa.array([""])], ["value"])

    path = _path(spark, "alignment")
    s.mapInArrow(lines, "value string").write.text(path)
    return path


@query("dense_counts_file", f"""WITH {counts_sql()}, l(c) AS (VALUES ('A'), ('C'), ('G'), ('T')), longs AS (SELECT a.c || b.c || e.c || f.c AS long FROM l a, l b, l e, l f), shorts AS (SELECT a.c || b.c AS short FROM l a, l b)
SELECT long, short, coalesce(count, 0)::double AS count FROM longs CROSS JOIN shorts LEFT JOIN counts USING (long, short)""")
def _(spark, d):
    path = _path(spark, "counts")
    writers.counts(pair_counts(spark, d), path, C.Shape(4, 2, 1))
    return readers.dense_counts(spark, path, skip=1, leftwin=1, bases="ACGT")[0]


@query("result_documents", "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment FROM customer")
def _(spark, d):
    segment = F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment")  # what is null is not in the document
    rows = table(spark, d, "customer").select(F.to_json(F.struct("c_custkey", "c_nationkey", segment)).alias("value")).repartition(8)

    def documents(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["[" + ",\n".join(x for b in batches for x in b.column(0).to_pylist()) + "]"])], ["value"])

    path = _path(spark, "documents")
    rows.mapInArrow(documents, "value string").write.text(path)
    return readers.json_results(spark, path).select("c_custkey", "c_nationkey", "segment")


@query("alignment_lines", f"WITH {PIECES} SELECT * FROM pieces")
def _(spark, d):
    return readers.multiple_alignment(spark, _alignment(spark, d, 1))


@query("alignment_interleaved", f"WITH {PIECES} SELECT * FROM pieces")
def _(spark, d):
    return readers.multiple_alignment(spark, _alignment(spark, d, 4))


GENOME = ("ACGTA", "GGT", "TTTTTT")


@query("genome_occurrences", f"""WITH {SEQ}, s AS (SELECT doc_id, regexp_replace(seq, '[^ACGT]', '', 'g') AS seq FROM seq_docs),
p(pattern) AS (VALUES {", ".join(f"('{x}')" for x in GENOME)}),
i AS (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS k, seq || coalesce(lead(seq) OVER (ORDER BY doc_id), '') || coalesce(lead(seq, 2) OVER (ORDER BY doc_id), '') || coalesce(lead(seq, 3) OVER (ORDER BY doc_id), '') || coalesce(lead(seq, 4) OVER (ORDER BY doc_id), '') || coalesce(lead(seq, 5) OVER (ORDER BY doc_id), '') AS long, coalesce(sum(length(seq)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE seq <> '')
SELECT pattern, (before + k)::bigint AS pos FROM i, p WHERE substr(long, k, length(pattern)) = pattern""")
def _(spark, d):
    s = seq_docs(spark, d).select("doc_id", F.regexp_replace("seq", "[^ACGT]", "").alias("seq")).filter("seq <> ''")
    path = _path(spark, "genome")
    s.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("seq").write.text(path)
    return readers.raw_occurrences(spark, path, list(GENOME), breaks=False, joined=True, range_=1 << 20).select("pattern", "pos")


@query("tab_separated", "SELECT c_custkey::varchar AS c_custkey, c_mktsegment, c_nationkey::varchar AS c_nationkey FROM customer")
def _(spark, d):
    path = _path(spark, "tsv")
    table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_name").write.csv(path, sep="\t", header=True)
    return readers.table(spark, path)


@query("coding_region_lines", "SELECT DISTINCT o_orderkey - o_orderkey % 50 AS start, o_orderkey - o_orderkey % 50 + 40 AS \"end\" FROM orders WHERE o_custkey % 5 = 2 AND o_orderstatus = 'O'")
def _(spark, d):
    start, path = F.col("o_orderkey") - F.col("o_orderkey") % 50, _path(spark, "gff")
    o = table(spark, d, "orders")
    o.select(F.concat(F.lit("c"), (F.col("o_custkey") % 5).cast("string")), F.lit("orders"), F.when(F.col("o_orderstatus") == "O", "CDS").otherwise("gene"), start, start + 40).write.csv(path, sep="\t")
    return readers.coding_regions(spark, path, "c2")


@query("single_change_lines", "SELECT 'c' || o_custkey AS chrom, o_orderkey AS pos, o_orderstatus AS ref, substr(o_orderpriority, 1, 1) AS alt FROM orders WHERE o_custkey % 3 <> 0")
def _(spark, d):
    path = _path(spark, "vcf")
    alt = F.substring("o_orderpriority", 1, 1)
    o = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "o_orderkey", F.lit("."), "o_orderstatus", F.when(F.col("o_custkey") % 3 == 0, F.concat(alt, F.lit("x"))).otherwise(alt))
    o.write.csv(path, sep="\t")
    return readers.single_changes(spark, path)


@query("frames_by_name", "SELECT frame, count(*) AS n, sum(value) AS total FROM (SELECT o_orderkey % 3 AS frame, o_custkey AS value FROM orders) GROUP BY 1")
def _(spark, d):
    path = _path(spark, "frames")
    writers.frames(table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("frame"), F.col("o_custkey").alias("value")), path)
    got = readers.with_name_parts(spark.read.parquet(path).drop("frame"), frame=r"/frame=(\d+)/")
    return got.groupBy(F.col("frame").cast("long").alias("frame")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("result_lines", "SELECT l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    path = _path(spark, "results")
    writers.results(table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n")), path)
    return spark.read.schema("flag string, n long").json(path)


@query("residual_lines", "SELECT l_returnflag AS inpat, l_linestatus AS outpat, count(*)::double AS observed, round(avg(l_quantity), 3) AS expected, 0.0::double AS resid, 1.5::double AS z FROM lineitem GROUP BY ALL")
def _(spark, d):
    path = _path(spark, "residuals")
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("inpat"), F.col("l_linestatus").alias("outpat"))
    g = g.agg(F.count("*").cast("double").alias("observed"), F.avg("l_quantity").alias("expected")).withColumns({"resid": F.lit(0.0), "z": F.lit(1.5)})
    writers.residuals(g, path)
    return spark.read.csv(path, sep="\t", header=True, schema="inpat string, outpat string, observed double, expected double, resid double, z double")


@query("positions_by_pattern", "SELECT o_orderstatus AS pattern, count(*) AS n, sum(o_orderkey)::bigint AS total FROM orders GROUP BY 1")
def _(spark, d):
    path = _path(spark, "by-pattern")
    writers.by_pattern(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("pattern")), path)
    return spark.read.csv(path, schema="pos long, pattern string").groupBy("pattern").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


@query("paired_tuples", f"WITH {PAIR}, p AS (SELECT s1, s2, unnest(range(1, least(length(s1), length(s2)) - 1)) AS i FROM pair_docs), w AS (SELECT 'forward' AS direction, substr(s1, i, 3) AS reference, substr(s2, i + 1, 1) AS derived FROM p UNION ALL SELECT 'reverse', substr(s2, i, 3), substr(s1, i + 1, 1) FROM p) SELECT direction, reference, derived, count(*) AS count FROM w WHERE NOT regexp_matches(reference || derived, '[^ACGT]') GROUP BY ALL")
def _(spark, d):
    path = _path(spark, "tuples")
    writers.paired(C.both_directions(pair_docs(spark, d), C.Shape(3, 1, 1), "s1", "s2"), path)
    return spark.read.csv(path, sep="\t", header=True, schema="reference string, derived string, count long, direction string")
