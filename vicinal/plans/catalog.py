"""The registered queries of the sequence operators and the SQL that checks them.

Each query is a thin use of an operator on the given tables, or on symbol sequences that Spark derives from
them, whole. Sums of fractions are rounded alike on both sides.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import uuid

from pyspark.sql import DataFrame, functions as F, types as T, Window as W

from ..functions import fixation, normal as N, patterns as P, sequences as S
from ..operators import generator as G, intervals as I, linalg as A, model as M, ranks as K, residuals as R, results as X, series as E, simulate as Z, tmers as C, trees as Y
from ..sources import readers, writers
from ..staging import shared_dir
from .formats import FORMATS
from .views import EVENT_SEQ, PAIR, SEQ, SHAPE, SPIN, SPIN_PAIR, counts_sql, event_kmers, pair_counts, pair_docs, seq_docs, seq_events, spin_lines, spin_pairs, spread, table, trio_docs, windows_sql, written_counts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: A small model on ACGT for the numerical queries: three of the single changes and a neighbour rule.
MUTPATS = ((("A", "C"),), (("C", "T"),), (("G", "A"), ("T", "G")), (("CG", "TG"),))
RATES = (0.1, 0.2, 0.15, 0.3)
RULES_SQL = "rules(rate_id, f, t) AS (VALUES (0, 'A', 'C'), (1, 'C', 'T'), (2, 'G', 'A'), (2, 'T', 'G'), (3, 'CG', 'TG'))"
# Amino acids of the 64 codons of the standard code, codons in the order of TCAG, last letter fastest.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, itertools.product("TCAG", repeat=3)), AMINO_ACIDS, strict=True))


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return put


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def model(shape=SHAPE) -> M.Model:
    return M.Model("ACGT", MUTPATS, RATES, shape)


# Counting


@query("tmer_counts", f"WITH {counts_sql()} SELECT * FROM counts")
def _(spark, d):
    return pair_counts(spark, d)


@query("tmer_counts_both_directions", f"""WITH {PAIR}, p AS (SELECT s1, s2, unnest(range(1, least(length(s1), length(s2)) - 1)) AS i FROM pair_docs),
w AS (SELECT 'forward' AS direction, substr(s1, i, 3) AS long, substr(s2, i + 1, 1) AS short FROM p UNION ALL SELECT 'reverse', substr(s2, i, 3), substr(s1, i + 1, 1) FROM p)
SELECT direction, long, short, count(*) AS count FROM w WHERE NOT regexp_matches(long || short, '[^ACGT]') GROUP BY ALL""")
def _(spark, d):
    return C.both_directions(pair_docs(spark, d), C.Shape(3, 1, 1), "s1", "s2", spread=spread(spark))


@query("tmer_counts_frames", f"WITH {windows_sql()} SELECT long, short, (((-pos) % 3 + 3) % 3)::int AS frame, count(*) AS count FROM ok GROUP BY ALL")
def _(spark, d):
    return C.tmer_counts(pair_docs(spark, d), SHAPE, "s1", "s2", shift=3, spread=spread(spark))


TRIO = f"""{PAIR}, t AS (SELECT s1, s2, c.seq AS s3 FROM pair_docs p JOIN seq_docs c ON c.doc_id = p.id + 2),
w AS (SELECT substr(s1, i, 3) AS long, substr(s2, i + 1, 1) AS short1, substr(s3, i + 1, 1) AS short2 FROM (SELECT *, unnest(range(1, least(length(s1), length(s2), length(s3)) - 1)) AS i FROM t)),
trio AS (SELECT long, short1, short2, count(*) AS count FROM w WHERE NOT regexp_matches(long || short1 || short2, '[^ACGT]') GROUP BY ALL)"""


def _trio(spark, d):
    return C.tmer_counts(trio_docs(spark, d), C.Shape(3, 1, 1), "s1", "s2", "s3", spread=spread(spark))


@query("tmer_counts_three_taxa", f"WITH {TRIO} SELECT * FROM trio")
def _(spark, d):
    return _trio(spark, d)


@query("tmer_counts_listed_columns", f"WITH {TRIO} SELECT * FROM trio WHERE (short1, short2) IN (('A', 'C'), ('G', 'G'), ('T', 'A'))")
def _(spark, d):
    return C.listed(_trio(spark, d), spark.createDataFrame([("A", "C"), ("G", "G"), ("T", "A")], "short1 string, short2 string"))


@query("cyclic_kmers", f"""WITH {EVENT_SEQ}, w AS (SELECT substr(seq || repeat(seq, 3)[1:2], i, 3) AS pattern FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM seq_events)),
c AS (SELECT pattern, count(*) AS n FROM w GROUP BY 1), l(c) AS (VALUES ('A'), ('C'), ('G'), ('T'))
SELECT a.c || b.c || e.c AS pattern, coalesce(n, 0) AS count FROM l a, l b, l e LEFT JOIN c ON c.pattern = a.c || b.c || e.c""")
def _(spark, d):
    return C.with_zeros(event_kmers(spark, d, 3, cyclic=True), P.patterns(spark, 3, "ACGT"))


@query("spin_kmers", f"""WITH {SPIN}, w AS (SELECT substr(seq, i, 2) AS pattern FROM (SELECT seq, unnest(range(1, length(seq))) AS i FROM spin_lines)) SELECT pattern, count(*) AS count FROM w GROUP BY 1""")
def _(spark, d):
    return C.kmers(spin_lines(spark, d), "seq", 2, cyclic=False, alphabet=None)


@query("triple_counts", "SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber AS c, count(*) AS count FROM lineitem GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), F.col("l_linenumber").alias("c")).agg(F.count("*").alias("count"))


TEXT_COUNTS = "t AS (SELECT o_orderpriority AS long, o_orderstatus AS short, CASE WHEN o_custkey % 10 = 0 THEN 'x' ELSE o_custkey::varchar END AS count FROM orders)"


def _text_counts(spark, d):
    n = F.when(F.col("o_custkey") % 10 == 0, "x").otherwise(F.col("o_custkey").cast("string"))
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("long"), F.col("o_orderstatus").alias("short"), n.alias("count"), "o_orderkey")
    return [t.filter("o_orderkey % 2 = 0").drop("o_orderkey"), t.filter("o_orderkey % 2 <> 0").drop("o_orderkey")]


@query("summed_counts", f"WITH {TEXT_COUNTS} SELECT long, short, sum(try_cast(count AS bigint))::bigint AS count FROM t WHERE try_cast(count AS bigint) IS NOT NULL GROUP BY ALL")
def _(spark, d):
    return C.sum_counts(_text_counts(spark, d))


@query("skipped_counts", f"WITH {TEXT_COUNTS} SELECT count(*) AS skipped FROM t WHERE try_cast(count AS bigint) IS NULL")
def _(spark, d):
    return C.skipped_counts(_text_counts(spark, d))


@query("row_totals", f"WITH {counts_sql()} SELECT long, sum(count)::bigint AS count FROM counts GROUP BY 1")
def _(spark, d):
    return C.row_totals(pair_counts(spark, d))


@query("projected_counts", f"""WITH {counts_sql()}, k AS (SELECT *, unnest(range(0, 3)) AS k FROM counts)
SELECT substr(long, k + 1, 2) AS long, substr(short, k, 1) AS short, round(sum(count) / 2.0, 6) AS count FROM k WHERE k BETWEEN 1 AND 2 GROUP BY ALL""")
def _(spark, d):
    return rounded(C.projected(pair_counts(spark, d), SHAPE, C.Shape(2, 1, 0)), "count")


@query("projected_counts_three_taxa", f"""WITH {TRIO} SELECT substr(long, 2, 2) AS long, short1, short2, sum(count)::double AS count FROM trio GROUP BY ALL""")
def _(spark, d):
    return C.projected(_trio(spark, d), C.Shape(3, 1, 1), C.Shape(2, 1, 0), ["short1", "short2"])


@query("mean_table", f"WITH {windows_sql()}, f AS (SELECT long, short, pos % 3 AS frame, count(*) AS c FROM ok GROUP BY ALL) SELECT long, short, round(sum(c) / 3.0, 6) AS count FROM f GROUP BY ALL")
def _(spark, d):
    f = C.tmer_counts(pair_docs(spark, d), SHAPE, "s1", "s2", shift=3, spread=spread(spark))
    return rounded(f.groupBy("long", "short").agg((F.sum("count") / 3).alias("count")), "count")


@query("divergence", f"WITH {counts_sql()} SELECT round(sum(hamming(substr(long, 2, 2), short) * count) / (sum(count) * 2.0), 6) AS divergence FROM counts")
def _(spark, d):
    return rounded(R.divergence(pair_counts(spark, d), 1, 2), "divergence")


MUTATIONS = f"""{counts_sql()}, {RULES_SQL}, k AS (SELECT rate_id, f, t, substr(long, 2, 2) AS a, short AS b, count, unnest(range(1, least(3 - length(f), 1) + 1)) AS k FROM counts, rules),
m AS (SELECT rate_id::int AS rate_id, sum(CASE WHEN substr(b, k, length(f)) = t THEN count ELSE 0 END)::bigint AS observed, sum(count)::bigint AS possible FROM k WHERE substr(a, k, length(f)) = f GROUP BY 1)"""


def _mutations(spark, d):
    return R.mutations(pair_counts(spark, d), P.rules(spark, MUTPATS), 1, 2)


@query("mutation_counts", f"WITH {MUTATIONS} SELECT * FROM m")
def _(spark, d):
    return _mutations(spark, d)


@query("rate_estimates", f"WITH {MUTATIONS} SELECT rate_id, round(observed / possible, 6) AS rate FROM m")
def _(spark, d):
    return rounded(_mutations(spark, d).select("rate_id", (F.col("observed") / F.col("possible")).alias("rate")), "rate")


@query("base_frequencies", f"WITH {SEQ}, c AS (SELECT unnest(string_split(regexp_replace(seq, '[^ACGT]', '', 'g'), '')) AS base FROM seq_docs) SELECT base, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c WHERE base <> '' GROUP BY base")
def _(spark, d):
    c = seq_docs(spark, d).select(*(F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).alias(b) for b in "ACGT"))
    c = c.select(F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.col(b).alias("n")) for b in "ACGT"))).alias("x")).select("x.*")
    return rounded(c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))), "share")


@query("changed_site_sums", f"""WITH {counts_sql()} SELECT hamming(substr(long, 2, 2), short)::int AS n_changes, length(regexp_replace(long, '[^CG]', '', 'g'))::int AS gc, sum(count)::bigint AS count FROM counts GROUP BY ALL""")
def _(spark, d):
    c = pair_counts(spark, d).withColumn("n_changes", S.changed_sites(F.substring("long", 2, 2), "short")).withColumn("gc", S.gc_count("long"))
    return c.groupBy("n_changes", "gc").agg(F.sum("count").alias("count"))


@query("counts_with_zeros", f"""WITH {counts_sql()}, l(c) AS (VALUES ('A'), ('C'), ('G'), ('T')), s AS (SELECT a.c || b.c AS short FROM l a, l b), g AS (SELECT long, short FROM (SELECT DISTINCT long FROM counts), s)
SELECT long, short, coalesce(count, 0) AS count FROM g LEFT JOIN counts USING (long, short)""")
def _(spark, d):
    c = pair_counts(spark, d)
    grid = c.select("long").distinct().crossJoin(F.broadcast(P.patterns(spark, 2, "ACGT").select(F.col("pattern").alias("short"))))
    return grid.join(c, ["long", "short"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


@query("reordered_taxa", f"WITH {TRIO} SELECT long, short2 AS first, short1 AS second, count FROM trio")
def _(spark, d):
    return _trio(spark, d).select("long", F.col("short2").alias("first"), F.col("short1").alias("second"), "count")


@query("pattern_occurrences", f"""WITH {SEQ}, p(pattern) AS (VALUES ('AC'), ('ACA'), ('GGT')), i AS (SELECT doc_id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM seq_docs)
SELECT doc_id, pattern, pos::int AS pos FROM i, p WHERE substr(seq, pos, length(pattern)) = pattern""")
def _(spark, d):
    return C.occurrences(seq_docs(spark, d), "seq", ["AC", "ACA", "GGT"], ["doc_id"]).withColumn("pos", F.col("pos").cast("int"))


# Filters and derived columns


@query("strict_windows", f"WITH {windows_sql()} SELECT id, count(*) AS windows FROM ok GROUP BY 1")
def _(spark, d):
    w = C.windows(pair_docs(spark, d), {"long": ("s1", 0, 4), "short": ("s2", 1, 2)}, 4, ["id"], spread=spread(spark))
    return C.strict(w, ["long", "short"]).groupBy("id").agg(F.count("*").alias("windows"))


@query("keys_without_n", f"""WITH {EVENT_SEQ}, w AS (SELECT substr(seq, i, 2) AS pattern FROM (SELECT seq, unnest(range(1, length(seq))) AS i FROM seq_events)), c AS (SELECT pattern, count(*) AS count FROM w GROUP BY 1) SELECT * FROM c WHERE NOT contains(pattern, 'N')""")
def _(spark, d):
    return event_kmers(spark, d, 2).filter(~F.contains("pattern", F.lit("N")))


@query("path_columns", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(url, '([^/]*)$', 1) AS base, contains(url, '/en/') AS english, url IS NULL AS missing FROM pages")
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/]*)", 1).alias("host"), F.regexp_extract(u, "([^/]*)$", 1).alias("base"), F.contains(u, F.lit("/en/")).alias("english"), u.isNull().alias("missing"))


EVENT_PAIR = "e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS a, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 2 END AS b FROM events)"


@query("mean_or_either", f"WITH {EVENT_PAIR} SELECT event_id, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a + b) / 2 ELSE coalesce(a, b) END, 6) AS v FROM e")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("value") * 2).alias("b"))
    return e.select("event_id", F.round(F.coalesce((F.col("a") + F.col("b")) / 2, "a", "b"), 6).alias("v"))


@query("non_empty_columns", "SELECT event_id, value FROM events")
def _(spark, d):
    return X.without_empty(table(spark, d, "events").select("event_id", "value", F.lit(None).cast("double").alias("empty")))


@query("scaled_columns", "SELECT l_orderkey, l_linenumber, (round((l_quantity - 25) / 14, 6) + 0.0::double) AS quantity, (round((l_discount - 0.05) / 0.03, 6) + 0.0::double) AS discount FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round((F.col("l_quantity") - 25) / 14, 6).alias("quantity"), F.round((F.col("l_discount") - 0.05) / 0.03, 6).alias("discount"))


@query("normalised_columns", f"WITH {counts_sql()} SELECT long, short, round(count / sum(count) OVER (PARTITION BY short), 6) AS share FROM counts")
def _(spark, d):
    c = pair_counts(spark, d)
    return rounded(c.select("long", "short", (F.col("count") / F.sum("count").over(W.partitionBy("short"))).alias("share")), "share")


@query("thinned_trace", "SELECT event_id, value FROM events WHERE event_id % 7 = 0")
def _(spark, d):
    return X.thinned(table(spark, d, "events").select("event_id", "value"), "event_id", 7)


@query("trace_of_1000", "SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS k, count(*) OVER () AS n FROM events) WHERE (k - 1) % greatest(1, (n + 999) // 1000) = 0")
def _(spark, d):
    return X.thinned_to(table(spark, d, "events").select("event_id", "value"), ["event_id"], 1000)


@query("after_burn_in", "SELECT event_id, value FROM events WHERE event_id BETWEEN 100 AND 5000")
def _(spark, d):
    return X.after_burn_in(table(spark, d, "events").select("event_id", "value"), "event_id", 100, 5000)


@query("trimmed_outliers", """WITH q AS (SELECT event_type, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events GROUP BY 1),
m AS (SELECT e.event_type, avg(value) AS m, stddev_samp(value) AS s FROM events e JOIN q USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY 1)
SELECT event_id, e.event_type, value FROM events e JOIN m USING (event_type) WHERE abs((value - m) / s) < 4""")
def _(spark, d):
    return X.trimmed(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value").select("event_id", "event_type", "value")


# Joins


@query("merged_tables", """WITH a AS (SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS n, count(*) AS c FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS n, count(*) AS c FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY ALL)
SELECT f, s, n, a.c AS even, b.c AS odd FROM a JOIN b USING (f, s, n)""")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("n"), (F.col("l_orderkey") % 2).alias("odd"))
    return t.groupBy("f", "s", "n").pivot("odd", [0, 1]).count().dropna().withColumnsRenamed({"0": "even", "1": "odd"})


CODON_SQL = ", ".join(f"('{k}', '{v}')" for k, v in CODONS.items())


@query("codon_counts", f"""WITH {SEQ}, w AS (SELECT substr(seq, i, 3) AS codon FROM (SELECT seq, unnest(range(1, length(seq) - 1)) AS i FROM seq_docs)), c AS (SELECT codon, count(*) AS count FROM w WHERE NOT regexp_matches(codon, '[^ACGT]') GROUP BY 1), k(codon, aa) AS (VALUES {CODON_SQL})
SELECT c.codon, count, aa FROM c LEFT JOIN k USING (codon)""")
def _(spark, d):
    c = C.kmers(seq_docs(spark, d), "seq", 3, cyclic=False).withColumnRenamed("pattern", "codon")
    return I.first_matches(c, spark.createDataFrame(list(CODONS.items()), "codon string, aa string"), ["codon"], ["aa"])


@query("codon_changes", f"""WITH {PAIR}, w AS (SELECT substr(s1, i, 3) AS a, substr(s2, i, 3) AS b FROM (SELECT s1, s2, unnest(range(1, least(length(s1), length(s2)) - 1)) AS i FROM pair_docs)), c AS (SELECT a AS long, b AS short, count(*) AS count FROM w WHERE NOT regexp_matches(a || b, '[^ACGT]') GROUP BY ALL), k(codon, aa) AS (VALUES {CODON_SQL})
SELECT x.aa AS aa_from, y.aa AS aa_to, x.aa = y.aa AS synonymous, long = short AS same, sum(count)::bigint AS count FROM c JOIN k x ON x.codon = long JOIN k y ON y.codon = short GROUP BY ALL""")
def _(spark, d):
    k = spark.createDataFrame(list(CODONS.items()), "codon string, aa string")
    c = pair_counts(spark, d, C.Shape(3, 3, 0))
    c = c.join(F.broadcast(k.toDF("long", "aa_from")), "long").join(F.broadcast(k.toDF("short", "aa_to")), "short")  # 64 rows
    return c.groupBy("aa_from", "aa_to", (F.col("aa_from") == F.col("aa_to")).alias("synonymous"), (F.col("long") == F.col("short")).alias("same")).agg(F.sum("count").alias("count"))


@query("complement_partners", f"""WITH {counts_sql()}, r AS (SELECT long, short, count, reverse(translate(long, 'ACGT', 'TGCA')) AS rl, reverse(translate(short, 'ACGT', 'TGCA')) AS rs FROM counts)
SELECT a.long, a.short, a.count, b.count AS partner FROM r a LEFT JOIN counts b ON b.long = a.rl AND b.short = a.rs""")
def _(spark, d):
    c = pair_counts(spark, d)
    p = c.select(S.reverse_complement("long").alias("long"), S.reverse_complement("short").alias("short"), F.col("count").alias("partner"))
    return c.join(p, ["long", "short"], "left")


POSITIONS = "pos AS (SELECT o_custkey AS chrom, o_orderkey AS pos FROM orders), cds AS (SELECT DISTINCT o_custkey AS chrom, o_orderkey - o_orderkey % 50 AS start, o_orderkey - o_orderkey % 50 + 40 AS \"end\" FROM orders WHERE o_orderkey % 3 = 0)"


def _positions(spark, d):
    o = table(spark, d, "orders")
    start = F.col("o_orderkey") - F.col("o_orderkey") % 50
    return o.select(F.col("o_custkey").alias("chrom"), F.col("o_orderkey").alias("pos")), o.filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("chrom"), start.alias("start"), (start + 40).alias("end")).distinct()


@query("coding_frames", f"""WITH {POSITIONS}, h AS (SELECT p.chrom, p.pos, min(start) AS start FROM (SELECT DISTINCT * FROM pos) p JOIN cds c ON p.chrom = c.chrom AND p.pos >= c.start AND p.pos < c."end" GROUP BY ALL)
SELECT p.chrom, p.pos, h.start IS NOT NULL AS coding, (p.pos - h.start) % 3 AS frame FROM pos p LEFT JOIN h ON p.chrom = h.chrom AND p.pos = h.pos""")
def _(spark, d):
    p, c = _positions(spark, d)
    return I.coding_frames(p, c, ["chrom"])


BLOCKS = "b AS (SELECT l_suppkey AS chrom, l_orderkey AS s, l_orderkey + l_linenumber * 10 AS e FROM lineitem), r AS (SELECT ps AS chrom, p_partkey * 20 AS s, p_partkey * 20 + p_size AS e FROM (SELECT p_partkey, p_size, p_partkey % 50 AS ps FROM part))"


@query("region_overlaps", f"WITH {BLOCKS} SELECT b.chrom, b.s AS b_start, b.e AS b_end, r.s AS r_start, r.e AS r_end, greatest(b.s, r.s) AS start, least(b.e, r.e) AS \"end\" FROM b JOIN r ON b.chrom = r.chrom AND greatest(b.s, r.s) < least(b.e, r.e)")
def _(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    b = l.select(F.col("l_suppkey").alias("chrom"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_linenumber") * 10).alias("end"))
    r = p.select((F.col("p_partkey") % 50).alias("chrom"), (F.col("p_partkey") * 20).alias("start"), (F.col("p_partkey") * 20 + F.col("p_size")).alias("end"))
    return I.overlaps(b, r)


@query("taxa_pairs", f"""WITH {SEQ}, c AS (SELECT source, unnest(string_split(regexp_replace(seq, '[^ACGT]', '', 'g'), '')) AS base FROM seq_docs), f AS (SELECT source, base, count(*) AS n FROM c WHERE base <> '' GROUP BY ALL)
SELECT a.source AS a, b.source AS b, sum(abs(a.n - b.n))::bigint AS distance FROM f a JOIN f b ON a.base = b.base AND a.source < b.source GROUP BY ALL""")
def _(spark, d):
    f = C.kmers(seq_docs(spark, d), "seq", 1, cyclic=False, keep=["source"])
    a, b = (f.select(F.col("source").alias(n), "pattern", F.col("count").alias(f"n{n}")) for n in "ab")
    return a.join(b, "pattern").filter("a < b").groupBy("a", "b").agg(F.sum(F.abs(F.col("na") - F.col("nb"))).alias("distance"))


@query("taxa_pair_counts", f"""{"WITH " + PAIR}, t AS (SELECT s1, s2, c.seq AS s3 FROM pair_docs p JOIN seq_docs c ON c.doc_id = p.id + 2), i AS (SELECT *, unnest(range(1, least(length(s1), length(s2), length(s3)) - 1)) AS i FROM t),
w AS (SELECT 's1' AS a, 's2' AS b, substr(s1, i, 3) AS long, substr(s2, i + 1, 1) AS short FROM i UNION ALL SELECT 's1', 's3', substr(s1, i, 3), substr(s3, i + 1, 1) FROM i UNION ALL SELECT 's2', 's3', substr(s2, i, 3), substr(s3, i + 1, 1) FROM i)
SELECT a, b, long, short, count(*) AS count FROM w WHERE NOT regexp_matches(long || short, '[^ACGT]') GROUP BY ALL""")
def _(spark, d):
    return C.all_pairs(trio_docs(spark, d), C.Shape(3, 1, 1), ["s1", "s2", "s3"], spread=spread(spark))


@query("unknown_patterns", f"""WITH {EVENT_SEQ}, w AS (SELECT substr(seq, i, 2) AS pattern FROM (SELECT seq, unnest(range(1, length(seq))) AS i FROM seq_events)) SELECT DISTINCT pattern FROM w WHERE regexp_matches(pattern, '[^ACGT]')""")
def _(spark, d):
    seen = event_kmers(spark, d, 2).select("pattern")
    return seen.join(P.patterns(spark, 2, "ACGT"), "pattern", "left_anti").distinct()


@query("cherry_products", f"""WITH {counts_sql()}, t AS (SELECT * FROM counts) SELECT a.long, a.short || b.short AS shorts, (a.count * b.count)::bigint AS product FROM t a JOIN t b ON a.long = b.long""")
def _(spark, d):
    c = pair_counts(spark, d)
    a, b = c.toDF("long", "s1", "n1"), c.select("long", F.col("short").alias("s2"), F.col("count").alias("n2"))
    return a.join(b, "long").select("long", F.concat("s1", "s2").alias("shorts"), (F.col("n1") * F.col("n2")).alias("product"))


@query("matrix_vector", f"""WITH {counts_sql()}, v AS (SELECT substr(long, 1, 2) AS short, sum(count)::bigint AS x FROM counts GROUP BY 1) SELECT long, sum(count * x)::bigint AS y FROM counts JOIN v USING (short) GROUP BY 1""")
def _(spark, d):
    c = pair_counts(spark, d)
    v = c.groupBy(F.substring("long", 1, 2).alias("short")).agg(F.sum("count").alias("x"))
    return c.join(v, "short").groupBy("long").agg(F.sum(F.col("count") * F.col("x")).alias("y"))


# Summaries


@query("quantiles", """SELECT event_type, round(quantile_cont(value, 0.025), 6) AS q2_5, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.975), 6) AS q97_5 FROM events GROUP BY 1""")
def _(spark, d):
    q = X.quantiles(table(spark, d, "events"), "event_type", "value")
    return rounded(q, *q.columns[1:])


@query("boxplots", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(first(q1), 6) AS q1, round(first(median), 6) AS median, round(first(q3), 6) AS q3, round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM events JOIN q USING (event_type) GROUP BY 1""")
def _(spark, d):
    return rounded(X.boxplot(table(spark, d, "events"), "event_type", "value"), "low", "q1", "median", "q3", "high")


CREDIBLE = "c AS (SELECT event_type, value AS truth, 5 + event_id % 7 AS lo50, 60 - event_id % 11 AS hi50, event_id % 3 AS lo95, 150 - event_id % 13 AS hi95 FROM events)"


@query("interval_coverage", f"WITH {CREDIBLE} SELECT event_type, round(avg((truth BETWEEN lo95 AND hi95)::int), 6) AS cover95, round(avg((truth BETWEEN lo50 AND hi50)::int), 6) AS cover50 FROM c GROUP BY 1")
def _(spark, d):
    e = F.col("event_id")
    c = table(spark, d, "events").select("event_type", F.col("value").alias("truth"), (5 + e % 7).alias("lo50"), (60 - e % 11).alias("hi50"), (e % 3).alias("lo95"), (150 - e % 13).alias("hi95"))
    return rounded(X.coverage(c, "event_type"), "cover95", "cover50")


@query("chain_diagnostics", """SELECT event_type, round(avg((value <= user_id)::int), 6) AS q_truth, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS med, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1""")
def _(spark, d):
    x = X.diagnostics(table(spark, d, "events"), "event_type", "value", "user_id")
    return rounded(x, *x.columns[1:])


@query("covariances", "SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 2) AS cov, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("cov"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("weighted_table", "SELECT l_returnflag, round(count(*) * sum(l_quantity), 2) AS weight FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(R.weighted_table(table(spark, d, "lineitem"), "l_returnflag", "l_quantity"), "weight", digits=2)


@query("padded_union", "SELECT o_orderkey AS id, o_totalprice AS a, NULL::double AS b FROM orders UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer")
def _(spark, d):
    return X.union_padded([table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("a")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("b"))])


@query("set_operations", "WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier) SELECT k, 'both' AS kind FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT k, 'customer' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT k, 'supplier' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def _(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    kind = lambda x, n: x.withColumn("kind", F.lit(n))
    return kind(a.intersect(b), "both").union(kind(a.subtract(b), "customer")).union(kind(b.subtract(a), "supplier"))


DEPTHS = "SELECT doc_id, list_sum([x::bigint FOR x IN regexp_extract_all(text, '[0-9]{1,6}')])::bigint AS total FROM documents"


@query("field_sums", DEPTHS)
def _(spark, d):
    fields = F.regexp_extract_all("text", F.lit("([0-9]{1,6})"), F.lit(1))
    total = F.aggregate(fields, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return table(spark, d, "documents").select("doc_id", F.when(F.size(fields) > 0, total).alias("total"))


@query("zipped_rows", "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS k FROM customer), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) SELECT c_custkey, o_orderkey FROM a JOIN b USING (k)")
def _(spark, d):
    a, b = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_orderkey")
    return X.zipped(a, b, [F.col("c_custkey")], [F.col("o_orderkey")])


@query("sorted_positions", "SELECT o_custkey AS chrom, o_orderkey AS pos, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders")
def _(spark, d):
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("chrom"), F.col("o_orderkey").alias("pos"))
    return K.ranked(p, [F.col("chrom"), F.col("pos")])


@query("finite_values", "SELECT event_id, value FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND value IS NOT NULL AND isfinite(value)")
def _(spark, d):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return X.finite(table(spark, d, "events").select("event_id", v.alias("value")), "value")


FOLDS = 4


@query("folded_tables", "SELECT f, s, n, " + ", ".join(f"c{k}" for k in range(FOLDS)) + " FROM " + " JOIN ".join(f"(SELECT l_returnflag AS f, l_linestatus AS s, l_linenumber AS n, count(*) AS c{k} FROM lineitem WHERE l_orderkey % {FOLDS} = {k} GROUP BY ALL) t{k}" + (" USING (f, s, n)" if k else "") for k in range(FOLDS)))
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("n"), "l_orderkey")
    return X.merged([t.filter(F.col("l_orderkey") % FOLDS == k).groupBy("f", "s", "n").agg(F.count("*").alias(f"c{k}")) for k in range(FOLDS)], ["f", "s", "n"])


# Functions


@query("sequence_functions", f"""WITH {EVENT_SEQ} SELECT user_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, substr(seq || seq, length(seq), 3) AS wrapped, substr(seq, 1, 3) || 'XY' || substr(seq, 6) AS replaced,
'YZ' || substr(seq, 3, length(seq) - 3) || 'X' AS overrun, length(regexp_replace(seq, '[^CG]', '', 'g'))::int AS gc, hamming(seq, reverse(seq))::int AS distance FROM seq_events""")
def _(spark, d):
    n = F.length("seq")
    return seq_events(spark, d).select("user_id", S.reverse_complement("seq").alias("rc"), S.wrap_substring("seq", n, n + 2).alias("wrapped"), S.overwrite("seq", F.lit(4), F.lit("XY")).alias("replaced"), S.wrap_overwrite("seq", n, F.lit("XYZ")).alias("overrun"), S.gc_count("seq").alias("gc"), S.hamming("seq", F.reverse("seq")).alias("distance"))


@query("change_positions", f"WITH {counts_sql()} SELECT long, short, array_to_string(list_filter(range(1, 3), lambda i: substr(long, i + 1, 1) <> substr(short, i, 1)), ',') AS positions, flanks FROM (SELECT *, lower(substr(long, 1, 1)) || substr(long, 2, 2) || lower(substr(long, 4)) AS flanks FROM counts)")
def _(spark, d):
    c = pair_counts(spark, d)
    at = F.concat_ws(",", F.transform(S.change_positions(F.substring("long", 2, 2), "short"), lambda i: i.cast("string")))
    return c.select("long", "short", at.alias("positions"), S.flanks_lowered("long", 1, 2).alias("flanks"))


@query("pattern_indices", f"WITH {counts_sql()} SELECT DISTINCT long, (strpos('ACGT', substr(long, 1, 1)) - 1 + 4 * (strpos('ACGT', substr(long, 2, 1)) - 1) + 16 * (strpos('ACGT', substr(long, 3, 1)) - 1) + 64 * (strpos('ACGT', substr(long, 4, 1)) - 1))::bigint AS idx FROM counts")
def _(spark, d):
    return pair_counts(spark, d).select("long", S.pattern_index("long", "ACGT").alias("idx")).distinct()


@query("fixation_functions", """SELECT l_orderkey, l_linenumber, round(CASE WHEN ds = 0 THEN 1 ELSE 3 * (exp(2 * abs(ds)) - 1) / (exp(6 * abs(ds)) - 1) END, 6) AS shape, round(CASE WHEN ds = 0 THEN 1 ELSE 3 * (exp(-2 * ds) - 1) / (exp(-6 * ds) - 1) END, 6) AS popgen, round(1 / (1 + exp(-ds)), 6) AS ising, 1.0::double AS neutral FROM (SELECT *, l_discount - 0.05 AS ds FROM lineitem)""")
def _(spark, d):
    ds = F.col("l_discount") - 0.05
    f = lambda n, **p: F.round(fixation.parse(n, p)(ds), 6)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", f("shape", Ne=3.0).alias("shape"), f("popgen", Ne=3.0).alias("popgen"), f("ising").alias("ising"), f("null").alias("neutral"))


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


# Generators, on the patterns that occur


GEN = f"""{counts_sql()}, {RULES_SQL}, pats AS (SELECT DISTINCT long AS p FROM counts), s AS (SELECT p, rate_id, f, t, unnest(range(1, 6 - length(f))) AS k FROM pats, rules),
mut AS (SELECT p AS i, substr(p, 1, k - 1) || t || substr(p, k + length(f)) AS j, rate_id::int AS rate_id, count(*) AS n FROM s WHERE substr(p, k, length(f)) = f GROUP BY ALL)"""


def _seen(spark, d):
    return written_counts(spark, d).select(F.col("long").alias("pattern")).distinct()


@query("rule_applications", f"WITH {GEN} SELECT * FROM mut")
def _(spark, d):
    return G.applied(_seen(spark, d), P.rules(spark, MUTPATS))


WRAP = f"""{counts_sql()}, {RULES_SQL}, pats AS (SELECT DISTINCT long AS p FROM counts), s AS (SELECT p, rate_id, f, t, unnest(range(1, 5)) AS k FROM pats, rules)
SELECT p AS i, CASE WHEN k + length(f) - 1 <= 4 THEN substr(p, 1, k - 1) || t || substr(p, k + length(f)) ELSE substr(t, 2) || substr(p, 2, 2) || substr(t, 1, 1) END AS j, rate_id::int AS rate_id, count(*) AS n FROM s WHERE substr(p || p, k, length(f)) = f GROUP BY ALL"""


@query("rule_applications_wrapped", f"WITH {WRAP}")
def _(spark, d):
    return G.applied(_seen(spark, d), P.rules(spark, MUTPATS), "wrap")


SEL = "sp(sel_id, q, w) AS (VALUES (0, 'CG', 1.0), (0, 'GC', 0.5), (1, 'A', 0.25))"
SELPATS = [(0, "CG", 1.0), (0, "GC", 0.5), (1, "A", 0.25)]


def _selpats(spark):
    return spark.createDataFrame(SELPATS, "sel_id int, selpat string, factor double")


@query("selection_matches", f"""WITH {counts_sql()}, {SEL}, pats AS (SELECT DISTINCT long AS p FROM counts), s AS (SELECT p, sel_id, q, w, unnest(range(1, 6 - length(q))) AS k FROM pats, sp)
SELECT p AS pattern, sel_id::int AS sel_id, sum(w)::double AS weight FROM s WHERE substr(p, k, length(q)) = q GROUP BY ALL""")
def _(spark, d):
    return G.selection(_seen(spark, d), _selpats(spark))


@query("generator", f"""WITH {GEN}, {SEL}, ks AS (SELECT p, sel_id, q, w, unnest(range(1, 6 - length(q))) AS k FROM (SELECT i AS p FROM mut UNION SELECT j FROM mut), sp),
m AS (SELECT p, sum(w * CASE sel_id WHEN 0 THEN 0.5 ELSE -0.3 END) AS v FROM ks WHERE substr(p, k, length(q)) = q GROUP BY 1),
x AS (SELECT i, j, sum(n * CASE rate_id WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 WHEN 2 THEN 0.15 ELSE 0.3 END) AS x FROM mut GROUP BY ALL)
SELECT i, j, round(x / (1 + exp(-(coalesce(b.v, 0) - coalesce(a.v, 0)))), 6) AS x FROM x LEFT JOIN m a ON a.p = i LEFT JOIN m b ON b.p = j""")
def _(spark, d):
    mut = G.applied(_seen(spark, d), P.rules(spark, MUTPATS))
    every = mut.select(F.col("i").alias("pattern")).union(mut.select("j")).distinct()
    ds = G.differences(mut, G.selection(every, _selpats(spark)))
    return rounded(G.generator(mut, ds, list(RATES), [0.5, -0.3], fixation.ising), "x")


@query("mean_generator", f"""WITH {GEN} SELECT substr(i, 2, 2) AS i, substr(j, 2, 2) AS j, rate_id, round(sum(n) / 16.0, 6) AS n FROM mut WHERE substr(i, 2, 2) <> substr(j, 2, 2) GROUP BY ALL""")
def _(spark, d):
    mut = G.applied(_seen(spark, d), P.rules(spark, MUTPATS))
    return rounded(G.mean_over_flanks(mut, "n", "rate_id", 1, 1, 4), "n")


@query("mean_generator_selection", f"""WITH {GEN}, {SEL}, ks AS (SELECT p, sel_id, q, w, unnest(range(1, 6 - length(q))) AS k FROM (SELECT i AS p FROM mut UNION SELECT j FROM mut), sp),
m AS (SELECT p, sel_id, sum(w) AS v FROM ks WHERE substr(p, k, length(q)) = q GROUP BY ALL), ids(sel_id) AS (VALUES (0), (1)),
ds AS (SELECT i, j, ids.sel_id, coalesce(b.v, 0) - coalesce(a.v, 0) AS ds FROM (SELECT DISTINCT i, j FROM mut) CROSS JOIN ids LEFT JOIN m a ON a.p = i AND a.sel_id = ids.sel_id LEFT JOIN m b ON b.p = j AND b.sel_id = ids.sel_id),
hs AS (SELECT substr(i, 2, 2) AS i, substr(j, 2, 2) AS j, sum(ds * CASE sel_id WHEN 0 THEN 0.5 ELSE -0.3 END) / 16 AS s FROM ds GROUP BY ALL),
h AS (SELECT substr(i, 2, 2) AS i, substr(j, 2, 2) AS j, sum(n * CASE rate_id WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 WHEN 2 THEN 0.15 ELSE 0.3 END) / 16 AS x FROM mut GROUP BY ALL)
SELECT i, j, round(x / (1 + exp(-s)), 6) AS x FROM h JOIN hs USING (i, j) WHERE i <> j""")
def _(spark, d):
    mut = G.applied(_seen(spark, d), P.rules(spark, MUTPATS))
    every = mut.select(F.col("i").alias("pattern")).union(mut.select("j")).distinct()
    ds = G.differences(mut, G.selection(every, _selpats(spark)))
    return rounded(G.mean_generator(mut, ds, 1, 1, 4, list(RATES), [0.5, -0.3], fixation.ising), "x")


@query("column_major_order", f"WITH {GEN}, e AS (SELECT i, j, sum(n)::bigint AS n FROM mut GROUP BY ALL) SELECT i, j, n, row_number() OVER (ORDER BY j, i) AS place FROM e")
def _(spark, d):
    e = G.applied(_seen(spark, d), P.rules(spark, MUTPATS)).groupBy("i", "j").agg(F.sum("n").alias("n"))
    return K.ranked(e, [F.col("j"), F.col("i")])


# Expected counts and residuals


EXPECTED = f"""{counts_sql()}, e AS (SELECT a.long, b.short, a.n * b.n / t.n AS expected FROM (SELECT long, sum(count)::double AS n FROM counts GROUP BY 1) a, (SELECT short, sum(count)::double AS n FROM counts GROUP BY 1) b, (SELECT sum(count)::double AS n FROM counts) t),
r AS (SELECT long AS inpat, short AS outpat, coalesce(count, 0)::double AS observed, expected, coalesce(count, 0) - expected AS resid, (coalesce(count, 0) - expected) / sqrt(expected * 4) AS z FROM e LEFT JOIN counts USING (long, short))"""


def _independent(spark, d):
    """Expected counts if long and short patterns were independent."""
    c = written_counts(spark, d)
    a, b = c.groupBy("long").agg(F.sum("count").cast("double").alias("a")), c.groupBy("short").agg(F.sum("count").cast("double").alias("b"))
    t = c.agg(F.sum("count").cast("double").alias("t"))
    return c, a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(t)).select("long", "short", (F.col("a") * F.col("b") / F.col("t")).alias("count"))


def _resids(spark, d):
    return R.residuals(*_independent(spark, d), 4)


@query("residuals", f"WITH {EXPECTED} SELECT inpat, outpat, observed, round(expected, 4) AS expected, (round(resid, 4) + 0.0::double) AS resid, (round(z, 4) + 0.0::double) AS z FROM r")
def _(spark, d):
    return rounded(_resids(spark, d), "expected", "resid", "z", digits=4)


@query("pearson_residuals", f"WITH {EXPECTED} SELECT inpat, outpat, (round(resid / sqrt(expected), 4) + 0.0::double) AS pearson FROM r")
def _(spark, d):
    return _resids(spark, d).select("inpat", "outpat", F.round(R.pearson(F.col("observed"), F.col("expected")), 4).alias("pearson"))


MERGED = f"""{EXPECTED}, k AS (SELECT observed, expected, least((inpat, outpat), (reverse(translate(inpat, 'ACGT', 'TGCA')), reverse(translate(outpat, 'ACGT', 'TGCA')))) AS k FROM r),
g AS (SELECT k, sum(observed) AS observed, sum(expected) AS expected FROM k GROUP BY 1)
SELECT k[1] AS inpat, k[2] AS outpat, observed, round(expected, 4) AS expected, (round(observed - expected, 4) + 0.0::double) AS resid, (round((observed - expected) / sqrt(expected * 4), 4) + 0.0::double) AS z FROM g"""


@query("merged_complement_residuals", f"WITH {MERGED}")
def _(spark, d):
    return rounded(R.merged_complements(_resids(spark, d), 4, 1, 2), "expected", "resid", "z", digits=4)


def _sql_ratio(c: tuple, r: str) -> str:
    poly = lambda x: functools.reduce(lambda out, v: f"({out} * {r} + {v!r}::double)", reversed(x[:-1]), f"{x[-1]!r}::double")
    return f"({poly(c[0])} / {poly(c[1])})"


NORMAL = f"CASE WHEN p >= 0.075 THEN (p - 0.5) * {_sql_ratio(N.MIDDLE, '(0.180625 - (p - 0.5) * (p - 0.5))')} WHEN sqrt(-ln(p)) <= 5 THEN -{_sql_ratio(N.TAIL, '(sqrt(-ln(p)) - 1.6)')} ELSE -{_sql_ratio(N.FAR, '(sqrt(-ln(p)) - 5)')} END"


@query("normal_residuals", f"""WITH {EXPECTED}, k AS (SELECT inpat, outpat, observed, expected, unnest(range(0, (greatest(observed, expected) + 60 * sqrt(expected) + 80)::bigint)) AS k FROM r),
t AS (SELECT inpat, outpat, sum(CASE WHEN k <= observed THEN exp(k * ln(expected) - expected - lgamma(k + 1)) ELSE 0 END) AS lo, sum(CASE WHEN k > observed THEN exp(k * ln(expected) - expected - lgamma(k + 1)) ELSE 0 END) AS up FROM k GROUP BY ALL),
q AS (SELECT inpat, outpat, lo, up, least(lo, up) AS p FROM t WHERE least(lo, up) > 1e-300), z AS (SELECT inpat, outpat, CASE WHEN lo <= up THEN 1 ELSE -1 END * {NORMAL} AS z FROM q) SELECT inpat, outpat, round(z, 5) + 0.0::double AS z FROM z WHERE abs(z) < 36""")
def _(spark, d):
    z = N.poisson_to_normal(F.col("observed"), F.col("expected"))
    return rounded(_resids(spark, d).repartition(spread(spark)).select("inpat", "outpat", z.alias("z")).filter("abs(z) < 36"), "z", digits=5)


@query("listed_residuals", f"WITH {EXPECTED} SELECT lower(substr(inpat, 1, 1)) || substr(inpat, 2, 2) || lower(substr(inpat, 4)) AS inpat, outpat, (round(z, 4) + 0.0::double) AS z FROM r WHERE abs(z) > 0.5")
def _(spark, d):
    return rounded(R.listed(_resids(spark, d), 1, 2, 0.5).select("inpat", "outpat", "z"), "z", digits=4)


@query("extreme_residuals", f"""WITH {EXPECTED}, n AS (SELECT inpat, outpat, (round(z, 4) + 0.0::double) AS z, row_number() OVER (ORDER BY round(z, 4) DESC, inpat, outpat) AS hi, row_number() OVER (ORDER BY round(z, 4), inpat, outpat) AS lo FROM r) SELECT inpat, outpat, z FROM n WHERE hi <= 20 OR lo <= 20""")
def _(spark, d):
    return R.extremes(rounded(_resids(spark, d).select("inpat", "outpat", "z"), "z", digits=4), "z", 20, ["inpat", "outpat"])


@query("residuals_above_quantile", f"WITH {EXPECTED}, q AS (SELECT quantile_cont(z, 0.95) AS q FROM r) SELECT inpat, outpat, (round(z, 4) + 0.0::double) AS z FROM r, q WHERE z > q")
def _(spark, d):
    return rounded(R.above_quantile(_resids(spark, d), "z", 0.95).select("inpat", "outpat", "z"), "z", digits=4)


@query("residuals_in_order", f"WITH {EXPECTED}, x AS (SELECT inpat, outpat, (round(z, 4) + 0.0::double) AS z FROM r) SELECT *, row_number() OVER (ORDER BY z, inpat, outpat) AS place FROM x")
def _(spark, d):
    r = rounded(_resids(spark, d).select("inpat", "outpat", "z"), "z", digits=4)
    return K.ranked(r, [F.col("z"), F.col("inpat"), F.col("outpat")])


@query("motifs", f"""WITH {counts_sql()}, s AS (SELECT short, site, substr(long, site, 1) AS c, sum(count) AS w FROM (SELECT *, unnest(range(1, 5)) AS site FROM counts) GROUP BY ALL),
h AS (SELECT short, site, c, w::double / sum(w) OVER (PARTITION BY short, site) AS share FROM s), b AS (SELECT short, site, max(share) AS share, max_by(c, (share, c)) AS c FROM h GROUP BY ALL)
SELECT short, string_agg(CASE WHEN share > 0.75 THEN upper(c) WHEN share > 0.5 THEN lower(c) ELSE '.' END, '' ORDER BY site) AS motif FROM b GROUP BY 1""")
def _(spark, d):
    return R.motif(pair_counts(spark, d), "long", "count", ["short"])


@query("motif_samples", f"""WITH {counts_sql()}, s AS (SELECT short, site, substr(long, site, 1) AS c, count(*) * sum(count) AS w FROM (SELECT *, unnest(range(1, 5)) AS site FROM counts) GROUP BY ALL),
b AS (SELECT *, sum(w) OVER (PARTITION BY short, site ORDER BY c) - w AS before, sum(w) OVER (PARTITION BY short, site) AS total FROM s),
k AS (SELECT short, site, c, draw FROM b, range(1, 25) r(draw) WHERE before::hugeint * 25 < draw * total AND draw * total <= (before + w)::hugeint * 25)
SELECT short, draw, string_agg(c, '' ORDER BY site) AS motif FROM k GROUP BY ALL""")
def _(spark, d):
    return R.motif_samples(pair_counts(spark, d), "long", "count", ["short"])


@query("systematic_sample", """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::bigint AS w, sum(l_quantity::bigint) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - l_quantity::bigint AS before, sum(l_quantity::bigint) OVER () AS total FROM lineitem)
SELECT l_orderkey, l_linenumber, draw FROM (SELECT *, unnest(range(((before * 1001) // total + 1)::bigint, (least(((before + w) * 1001) // total, 1000) + 1)::bigint)) AS draw FROM b)""")
def _(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("w"))
    return K.systematic(t, [], ["l_orderkey", "l_linenumber", "l_partkey"], "w", 1000).select("l_orderkey", "l_linenumber", "draw")


EDGES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'l' || l_orderkey || '_' || l_linenumber FROM lineitem)"""


@query("tree_descendants", f"""WITH RECURSIVE {EDGES}, up(node, up, steps) AS (SELECT child, parent, 1 FROM edges UNION ALL SELECT node, parent, steps + 1 FROM up JOIN edges ON child = up),
nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges), depth AS (SELECT node, max(steps) AS depth FROM up GROUP BY 1),
below AS (SELECT up AS node, count(*) AS n, count(*) FILTER (node NOT IN (SELECT parent FROM edges)) AS tips FROM up GROUP BY 1)
SELECT node, coalesce(depth, 0)::bigint AS depth, coalesce(n, 0)::bigint AS n_below, coalesce(tips, 1)::bigint AS n_tips FROM nodes LEFT JOIN depth USING (node) LEFT JOIN below USING (node)""")
def _(spark, d):
    name = lambda prefix, *c: F.concat(F.lit(prefix), F.concat_ws("_", *(F.col(x).cast("string") for x in c)))
    edge = lambda t, parent, child: table(spark, d, t).select(parent.alias("parent"), child.alias("child"))
    e = edge("nation", name("r", "n_regionkey"), name("n", "n_nationkey")).union(edge("customer", name("n", "c_nationkey"), name("c", "c_custkey")))
    e = e.union(edge("orders", name("c", "o_custkey"), name("o", "o_orderkey"))).union(edge("lineitem", name("o", "l_orderkey"), name("l", "l_orderkey", "l_linenumber")))
    return Y.subtrees(e.distinct())


@query("ordered_groups", "SELECT source, count(*) AS n, row_number() OVER (ORDER BY regexp_extract(source, '([0-9]+)', 1)::int, source)::int AS place FROM documents GROUP BY source")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    order = [F.regexp_extract("source", "([0-9]+)", 1).cast("int"), F.col("source")]
    return g.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))


@query("multi_key_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_totalprice DESC, o_orderkey)::int AS place FROM orders")
def _(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderstatus", F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@query("first_occurrences", "SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k = 1")
def _(spark, d):
    return X.first_of(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber", "l_partkey"]).select("l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")


@query("distinct_features", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


# Models on counts of the documents


def pattern_sql(length: int, bases: str) -> str:
    letters = ", ".join(f"('{c}')" for c in bases)
    return f"letters(c) AS (VALUES {letters}), pats AS (SELECT {' || '.join(f'l{k}.c' for k in range(length))} AS p FROM {', '.join(f'letters l{k}' for k in range(length))})"


def rules_sql(mutpats, rates) -> str:
    rows = ", ".join(f"('{a}', '{b}', {x}::double)" for group, x in zip(mutpats, rates, strict=True) for a, b in group)
    return f"ways(f, t, rate) AS (VALUES {rows})"


def generator_sql(length: int, factor: str = "1") -> str:
    """g(i, j, x) from pats and ways; factor: of i and j."""
    return f"""gw AS (SELECT p, f, t, rate, unnest(range(1, {length + 2} - length(f))) AS k FROM pats, ways),
    ge AS (SELECT p AS i, substr(p, 1, k - 1) || t || substr(p, k + length(f)) AS j, sum(rate) AS x FROM gw WHERE substr(p, k, length(f)) = f GROUP BY ALL), g AS (SELECT i, j, x * {factor} AS x FROM ge)"""


def series_sql(start: str, t: float = 1.0, steps: int = 40) -> str:
    """tr(long, short, p): the exponential of the generator g for a time t, acting on what `start` (p, s) says, by its uniformization series."""
    return f"""o AS (SELECT i, sum(x) AS o FROM g GROUP BY i), top AS (SELECT max(o) AS r FROM o),
    pg AS (SELECT i, j, x / r AS x FROM g, top UNION ALL SELECT p, p, 1 - coalesce(o, 0) / r FROM pats LEFT JOIN o ON i = p, top),
    v(k, i, s, x) AS (SELECT 0, p, {start}, 1.0::double FROM pats UNION ALL SELECT k + 1, pg.i, s, sum(pg.x * v.x) FROM v JOIN pg ON v.i = pg.j WHERE k < {steps} GROUP BY k, pg.i, s),
    tr AS (SELECT i AS long, s AS short, sum(x * exp(k * ln(r * {t}) - r * {t} - lgamma(k + 1))) AS p FROM v, top GROUP BY ALL)"""


PREDICTED = f"""{pattern_sql(4, "ACGT")}, {rules_sql(MUTPATS, RATES)}, {generator_sql(4)}, {series_sql("substr(p, 2, 2)")}, {counts_sql()},
totals AS (SELECT long, sum(count) AS n FROM counts GROUP BY 1), predicted AS (SELECT long, short, n * p AS count FROM totals JOIN tr USING (long))"""


@query("predicted_counts", f"WITH RECURSIVE {PREDICTED} SELECT long, short, round(count, 4) AS count FROM predicted")
def _(spark, d):
    return rounded(M.predicted(pair_counts(spark, d), model()), "count", digits=4)


@query("predicted_by_saved_model", f"WITH RECURSIVE {PREDICTED} SELECT long, short, round(count, 4) AS count FROM predicted")
def _(spark, d):
    path = f"{shared_dir(spark)}/vicinal/model-{uuid.uuid4().hex}"
    writers.model(spark, model(), path)
    return rounded(M.predicted(pair_counts(spark, d), readers.model(spark, path)), "count", digits=4)


@query("model_residuals", f"""WITH RECURSIVE {PREDICTED}, r AS (SELECT long AS inpat, short AS outpat, coalesce(c.count, 0)::double AS observed, coalesce(p.count, 0) AS expected FROM predicted p FULL JOIN counts c USING (long, short))
SELECT inpat, outpat, observed, round(expected, 4) AS expected, round(observed - expected, 4) + 0.0::double AS resid, CASE WHEN expected > 0 THEN round((observed - expected) / sqrt(4 * expected), 2) + 0.0::double END AS z FROM r""")
def _(spark, d):
    c = written_counts(spark, d)
    r = R.residuals(c, M.predicted(c, model()), 4)
    return rounded(rounded(r, "expected", "resid", digits=4), "z", digits=2)


@query("predicted_counts_other_shape", f"""WITH RECURSIVE {pattern_sql(4, "ACGT")}, {rules_sql(MUTPATS, RATES)}, {generator_sql(4)}, {series_sql("substr(p, 1, 3)")}, {counts_sql()}, totals AS (SELECT long, sum(count) AS n FROM counts GROUP BY 1)
SELECT long, short, round(n * p, 4) AS count FROM totals JOIN tr USING (long)""")
def _(spark, d):
    return rounded(M.predicted(pair_counts(spark, d), model(), C.Shape(4, 3, 0)), "count", digits=4)


WIDE = C.Shape(6, 2, 2)


@query("predicted_counts_series", f"""WITH RECURSIVE {pattern_sql(6, "ACGT")}, {rules_sql(MUTPATS, RATES)}, {generator_sql(6)}, {series_sql("substr(p, 3, 2)")}, {counts_sql(WIDE)}, totals AS (SELECT long, sum(count) AS n FROM counts GROUP BY 1)
SELECT long, short, round(n * p, 4) AS count FROM totals JOIN tr USING (long)""")
def _(spark, d):
    return rounded(E.predicted(pair_counts(spark, d, WIDE), model(WIDE)), "count", digits=4)


def gamma_sql(shape: float, scale: float) -> str:
    """tr for a Gamma-distributed time: the weights of series_sql's terms are negative binomial."""
    p = f"(r * {scale} / (1 + r * {scale}))"
    return f"gm AS (SELECT i AS long, s AS short, sum(x * exp(lgamma(k + {shape}) - lgamma({shape}) - lgamma(k + 1) - {shape} * ln(1 + r * {scale}) + k * ln{p})) AS p FROM v, top GROUP BY ALL)"


@query("predicted_counts_gamma", f"""WITH RECURSIVE {pattern_sql(4, "ACGT")}, {rules_sql(MUTPATS, RATES)}, {generator_sql(4)}, {series_sql("substr(p, 2, 2)", steps=90)}, {gamma_sql(2.5, 0.4)}, {counts_sql()}, totals AS (SELECT long, sum(count) AS n FROM counts GROUP BY 1)
SELECT long, short, round(n * p, 4) AS count FROM totals JOIN gm USING (long)""")
def _(spark, d):
    return rounded(M.predicted(pair_counts(spark, d), dataclasses.replace(model(), gamma_shape=2.5, tlen=0.4)), "count", digits=4)


@query("predicted_counts_extended_time", f"""WITH RECURSIVE {pattern_sql(4, "ACGT")}, {rules_sql(MUTPATS, RATES)}, {generator_sql(4)}, {series_sql("substr(p, 2, 2)", steps=90)}, {gamma_sql(1.0, 0.6)}, {counts_sql()}, totals AS (SELECT long, sum(count) AS n FROM counts GROUP BY 1)
SELECT long, short, round(n * p, 4) AS count FROM totals JOIN gm USING (long)""")
def _(spark, d):
    m = dataclasses.replace(model(), gamma_shape=1.0, tlen=0.2)
    longer = A.extended_action(m.entries(), m.transitions(), 0.2, 0.6)
    return rounded(M.predicted(pair_counts(spark, d), m, cells=longer), "count", digits=4)


SPINS = M.Model("XO", ((("X", "O"), ("O", "X")), (("XO", "OX"),)), (0.5, 0.25), C.Shape(4, 2, 1), selpats=((("OX", 1.0), ("XO", 1.0)), (("X", 0.5),)), selcoef=(-0.6, 0.3), fixfn="ising")
SPIN_GEN = f"""{pattern_sql(4, "XO")}, {rules_sql(SPINS.mutpats, SPINS.rates)}, sel AS (SELECT p, (SELECT sum(CASE WHEN substr(p, k, 2) IN ('OX', 'XO') THEN -0.6 ELSE 0 END) FROM range(1, 4) r(k)) + 0.15 * length(replace(p, 'O', '')) AS s FROM pats),
{generator_sql(4, "(1 / (1 + exp((SELECT s FROM sel WHERE p = i) - (SELECT s FROM sel WHERE p = j))))")}"""
SPIN_COUNTS = f"{SPIN_PAIR}, sw AS (SELECT substr(s1, k, 4) AS long, substr(s2, k + 1, 2) AS short FROM (SELECT s1, s2, unnest(range(1, length(s1) - 2)) AS k FROM spin_pairs)), counts AS (SELECT long, short, count(*) AS count FROM sw GROUP BY ALL)"


def _spin_counts(spark, d):
    return C.tmer_counts(spin_pairs(spark, d), SPINS.shape, "s1", "s2", alphabet=None)


@query("predicted_counts_selection", f"""WITH RECURSIVE {SPIN_GEN}, {series_sql("substr(p, 2, 2)")}, {SPIN_COUNTS}, totals AS (SELECT long, sum(count) AS n FROM counts GROUP BY 1) SELECT long, short, round(n * p, 4) AS count FROM totals JOIN tr USING (long)""")
def _(spark, d):
    return rounded(M.predicted(_spin_counts(spark, d), SPINS), "count", digits=4)


@query("loglikelihood_selection", f"""WITH RECURSIVE {SPIN_GEN}, {series_sql("substr(p, 2, 2)")}, {SPIN_COUNTS}, shorter AS (SELECT long, substr(short, 1, 1) AS short, sum(p) AS p FROM tr GROUP BY ALL)
SELECT round((SELECT sum(count * ln(p)) FROM counts JOIN tr USING (long, short)) - (SELECT sum(count * ln(s.p)) FROM counts c JOIN shorter s ON c.long = s.long AND substr(c.short, 1, 1) = s.short), 3) AS loglik""")
def _(spark, d):
    return rounded(M.loglikelihood(_spin_counts(spark, d), SPINS), "loglik", digits=3)


#: Three taxa below one root; the long patterns are seen in the first.
STAR = [("root", "sp1", 0.3), ("root", "sp2", 0.2), ("root", "sp3", 0.4)]
FREQS = {"A": 0.3, "C": 0.2, "G": 0.2, "T": 0.3}


@query("predicted_tree_counts", f"""WITH RECURSIVE {pattern_sql(3, "ACGT")}, {rules_sql(MUTPATS, RATES)}, {generator_sql(3)}, {series_sql("p")},
q AS (SELECT t, i, s AS j, sum(x * exp(k * ln(r * t) - r * t - lgamma(k + 1))) AS p FROM v, top, (VALUES (0.3), (0.2), (0.4)) times(t) GROUP BY ALL),
b AS (SELECT t, i, substr(j, 2, 1) AS s, sum(p) AS p FROM q WHERE t <> 0.3 GROUP BY ALL),
root AS (SELECT p AS i, list_product([CASE WHEN c IN ('A', 'T') THEN 0.3 ELSE 0.2 END FOR c IN string_split(p, '')]) AS w FROM pats),
joint AS (SELECT q.j AS long, b.s AS short1, c.s AS short2, sum(w * q.p * b.p * c.p) AS x FROM root JOIN q USING (i) JOIN b USING (i) JOIN b c USING (i) WHERE q.t = 0.3 AND b.t = 0.2 AND c.t = 0.4 GROUP BY ALL),
{TRIO}, totals AS (SELECT long, sum(count) AS n FROM trio GROUP BY 1)
SELECT long, short1, short2, round(n * x / sum(x) OVER (PARTITION BY long), 4) AS count FROM joint JOIN totals USING (long)""")
def _(spark, d):
    m = M.Model("ACGT", MUTPATS, RATES, C.Shape(3, 1, 1))
    return rounded(M.predicted_tree(_trio(spark, d), STAR, "sp1", ["sp2", "sp3"], dict.fromkeys(("sp1", "sp2", "sp3"), m), FREQS), "count", digits=4)


@query("predicted_pair_counts", f"""WITH RECURSIVE {pattern_sql(3, "ACGT")}, {rules_sql(MUTPATS, RATES)}, {generator_sql(3)}, {series_sql("p")},
q AS (SELECT t, i, s AS j, sum(x * exp(k * ln(r * t) - r * t - lgamma(k + 1))) AS p FROM v, top, (VALUES (0.3), (0.2)) times(t) GROUP BY ALL),
b AS (SELECT i, substr(j, 2, 1) AS s, sum(p) AS p FROM q WHERE t = 0.2 GROUP BY ALL),
root AS (SELECT p AS i, list_product([CASE WHEN c IN ('A', 'T') THEN 0.3 ELSE 0.2 END FOR c IN string_split(p, '')]) AS w FROM pats),
joint AS (SELECT q.j AS long, b.s AS short, sum(w * q.p * b.p) AS x FROM root JOIN q USING (i) JOIN b USING (i) WHERE q.t = 0.3 GROUP BY ALL),
{counts_sql(C.Shape(3, 1, 1))}, totals AS (SELECT long, sum(count) AS n FROM counts GROUP BY 1)
SELECT long, short, round(n * x / sum(x) OVER (PARTITION BY long), 4) AS count FROM joint JOIN totals USING (long)""")
def _(spark, d):
    m = M.Model("ACGT", MUTPATS, RATES, C.Shape(3, 1, 1))
    found = M.predicted_tree(pair_counts(spark, d, m.shape), STAR[:2], "sp1", ["sp2"], dict.fromkeys(("sp1", "sp2"), m), FREQS)
    return rounded(found, "count", digits=4)


@query("projected_tree_counts", f"""WITH {PAIR}, t AS (SELECT s1, s2, c.seq AS s3 FROM pair_docs p JOIN seq_docs c ON c.doc_id = p.id + 2),
w AS (SELECT substr(s1, i, 4) AS long, substr(s2, i + 1, 2) AS a, substr(s3, i + 1, 2) AS b FROM (SELECT *, unnest(range(1, least(length(s1), length(s2), length(s3)) - 2)) AS i FROM t)),
c AS (SELECT long, a, b, count(*) AS count FROM w WHERE NOT regexp_matches(long || a || b, '[^ACGT]') GROUP BY ALL), k AS (SELECT *, unnest(range(1, 3)) AS k FROM c)
SELECT substr(long, k + 1, 2) AS long, substr(a, k, 1) AS short1, substr(b, k, 1) AS short2, sum(count) / 2.0::double AS count FROM k WHERE (substr(a, k, 1), substr(b, k, 1)) IN (('A', 'C'), ('G', 'G'), ('T', 'A')) GROUP BY ALL""")
def _(spark, d):
    c = C.tmer_counts(trio_docs(spark, d), SHAPE, "s1", "s2", "s3", spread=spread(spark))
    return C.projected(c, SHAPE, C.Shape(2, 1, 0), ["short1", "short2"], combos=spark.createDataFrame([("A", "C"), ("G", "G"), ("T", "A")], "short1 string, short2 string"))


@query("fitted_rates")
def _(spark, d):
    every = tuple(((a, b),) for a in "ACGT" for b in "ACGT" if a != b)
    shape = C.Shape(3, 1, 1)
    return M.fit_frame(pair_counts(spark, d, shape), M.Model("ACGT", every, (0.3,) * len(every), shape))


@query("sampled_rates")
def _(spark, d):
    shape = C.Shape(3, 1, 1)
    return M.sample(pair_counts(spark, d, shape), model(shape), 200, 4)


POINTS = "points(a, b) AS (SELECT 0.1 * (0.5 + 0.25 * i), 0.2 * (0.5 + 0.25 * j) FROM range(5) x(i), range(5) y(j))"


@query("likelihood_surface", f"""WITH RECURSIVE {pattern_sql(3, "ACGT")}, {POINTS}, ways(f, t, r) AS (VALUES ('A', 'C', 0), ('C', 'T', 1), ('G', 'A', 2), ('T', 'G', 2), ('CG', 'TG', 3)),
gw AS (SELECT p, f, t, r, unnest(range(1, 5 - length(f))) AS k FROM pats, ways), ge AS (SELECT p AS i, substr(p, 1, k - 1) || t || substr(p, k + length(f)) AS j, r FROM gw WHERE substr(p, k, length(f)) = f),
g AS (SELECT a, b, i, j, sum(CASE r WHEN 0 THEN a WHEN 1 THEN b WHEN 2 THEN 0.15 ELSE 0.3 END)::double AS x FROM ge, points GROUP BY ALL), o AS (SELECT a, b, i, sum(x) AS o FROM g GROUP BY ALL), top AS (SELECT a, b, max(o) AS r FROM o GROUP BY ALL),
pg AS (SELECT a, b, i, j, x / r AS x FROM g JOIN top USING (a, b) UNION ALL SELECT top.a, top.b, p, p, 1 - coalesce(o, 0) / r FROM pats CROSS JOIN top LEFT JOIN o ON o.i = p AND o.a = top.a AND o.b = top.b),
v(k, a, b, i, s, x) AS (SELECT 0, a, b, p, substr(p, 2, 1), 1.0::double FROM pats, points UNION ALL SELECT k + 1, v.a, v.b, pg.i, s, sum(pg.x * v.x) FROM v JOIN pg ON v.i = pg.j AND v.a = pg.a AND v.b = pg.b WHERE k < 40 GROUP BY ALL),
tr AS (SELECT a, b, i AS long, s AS short, sum(x * exp(k * ln(r) - r - lgamma(k + 1))) AS p FROM v JOIN top USING (a, b) GROUP BY ALL), {counts_sql(C.Shape(3, 1, 1))}
SELECT round(a::double, 9) AS x, round(b::double, 9) AS y, round(sum(count * ln(p)), 2) AS loglik FROM tr JOIN counts USING (long, short) GROUP BY ALL""")
def _(spark, d):
    shape = C.Shape(3, 1, 1)
    return rounded(rounded(M.surface(pair_counts(spark, d, shape), model(shape), 0, 1), "x", "y", digits=9), "loglik", digits=2)


RATE_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
PAIR_POINTS = f"""pairs(a, b) AS (VALUES {", ".join(map(str, RATE_PAIRS))}), base(r, rate) AS (VALUES {", ".join(f"({k}, {x}::double)" for k, x in enumerate(RATES))}),
points AS (SELECT row_number() OVER (ORDER BY a, b, i, j) AS id, a, b, p.rate * (0.5 + 0.5 * i) AS x, q.rate * (0.5 + 0.5 * j) AS y FROM pairs JOIN base p ON p.r = a JOIN base q ON q.r = b, range(3) s(i), range(3) t(j))"""


@query("likelihood_surfaces", f"""WITH RECURSIVE {pattern_sql(3, "ACGT")}, {PAIR_POINTS}, ways(f, t, r) AS (VALUES ('A', 'C', 0), ('C', 'T', 1), ('G', 'A', 2), ('T', 'G', 2), ('CG', 'TG', 3)),
gw AS (SELECT p, f, t, r, unnest(range(1, 5 - length(f))) AS k FROM pats, ways), ge AS (SELECT p AS i, substr(p, 1, k - 1) || t || substr(p, k + length(f)) AS j, r FROM gw WHERE substr(p, k, length(f)) = f),
g AS (SELECT id, i, j, sum(CASE ge.r WHEN a THEN x WHEN b THEN y ELSE rate END)::double AS x FROM ge JOIN base USING (r), points GROUP BY ALL), o AS (SELECT id, i, sum(x) AS o FROM g GROUP BY ALL), top AS (SELECT id, max(o) AS r FROM o GROUP BY ALL),
pg AS (SELECT id, i, j, x / r AS x FROM g JOIN top USING (id) UNION ALL SELECT top.id, p, p, 1 - coalesce(o, 0) / r FROM pats CROSS JOIN top LEFT JOIN o ON o.i = p AND o.id = top.id),
v(k, id, i, s, x) AS (SELECT 0, id, p, substr(p, 2, 1), 1.0::double FROM pats, points UNION ALL SELECT k + 1, v.id, pg.i, s, sum(pg.x * v.x) FROM v JOIN pg ON v.i = pg.j AND v.id = pg.id WHERE k < 40 GROUP BY ALL),
tr AS (SELECT id, i AS long, s AS short, sum(x * exp(k * ln(r) - r - lgamma(k + 1))) AS p FROM v JOIN top USING (id) GROUP BY ALL), {counts_sql(C.Shape(3, 1, 1))},
ll AS (SELECT id, round(sum(count * ln(p)), 2) AS loglik FROM tr JOIN counts USING (long, short) GROUP BY ALL)
SELECT a::int AS a, b::int AS b, round(x::double, 9) AS x, round(y::double, 9) AS y, loglik FROM points JOIN ll USING (id)""")
def _(spark, d):
    shape = C.Shape(3, 1, 1)
    return rounded(rounded(M.surfaces(pair_counts(spark, d, shape), model(shape), grid=3), "x", "y", digits=9), "loglik", digits=2)


#: The rates tried for each rule that is added alone: 12 from 0.0001 to 0.5, each by the same factor greater.
TRIED = "(SELECT 0.0001::double * pow(5000.0::double, e / 11.0::double) FROM range(12) z(e))"


@query("candidate_rules", f"""WITH RECURSIVE {pattern_sql(3, "ACGT")}, base(f, t, rate) AS (VALUES ('A', 'C', 0.1::double), ('C', 'T', 0.2), ('G', 'A', 0.15), ('T', 'G', 0.15), ('CG', 'TG', 0.3)),
tries AS (SELECT a.c || '->' || b.c AS rule, a.c AS f, b.c AS t, x.rate FROM letters a, letters b, {TRIED} x(rate) WHERE a.c <> b.c UNION ALL SELECT 'none', 'A', 'C', 0.0::double),
points AS (SELECT *, row_number() OVER (ORDER BY rule, rate) AS id FROM tries), ways AS (SELECT id, base.f, base.t, base.rate FROM points, base UNION ALL SELECT id, f, t, rate FROM points WHERE rate > 0),
gw AS (SELECT id, p, f, t, rate, unnest(range(1, 5 - length(f))) AS k FROM pats, ways), g AS (SELECT id, p AS i, substr(p, 1, k - 1) || t || substr(p, k + length(f)) AS j, sum(rate) AS x FROM gw WHERE substr(p, k, length(f)) = f GROUP BY ALL),
o AS (SELECT id, i, sum(x) AS o FROM g GROUP BY ALL), top AS (SELECT id, max(o) AS r FROM o GROUP BY 1),
pg AS (SELECT id, i, j, x / r AS x FROM g JOIN top USING (id) UNION ALL SELECT top.id, p, p, 1 - coalesce(o, 0) / r FROM pats CROSS JOIN top LEFT JOIN o ON o.i = p AND o.id = top.id),
v(k, id, i, s, x) AS (SELECT 0, id, p, substr(p, 1, 2), 1.0::double FROM pats, points UNION ALL SELECT k + 1, v.id, pg.i, s, sum(pg.x * v.x) FROM v JOIN pg ON v.i = pg.j AND v.id = pg.id WHERE k < 30 GROUP BY ALL),
two AS (SELECT id, i AS long, s AS short, sum(x * exp(k * ln(r) - r - lgamma(k + 1))) AS p FROM v JOIN top USING (id) GROUP BY ALL), one AS (SELECT id, long, substr(short, 1, 1) AS short, sum(p) AS p FROM two GROUP BY ALL), {counts_sql(C.Shape(3, 2, 0))},
single AS (SELECT long, substr(short, 1, 1) AS short, sum(count) AS count FROM counts GROUP BY ALL),
ll AS (SELECT id, a - b AS ll FROM (SELECT id, sum(count * ln(p)) AS a FROM counts JOIN two USING (long, short) GROUP BY 1) JOIN (SELECT id, sum(count * ln(p)) AS b FROM single JOIN one USING (long, short) GROUP BY 1) USING (id)),
gains AS (SELECT rule, rate, ll - (SELECT ll FROM ll JOIN points USING (id) WHERE rule = 'none') AS gain FROM ll JOIN points USING (id) WHERE rule <> 'none')
SELECT rule, round(max_by(rate, gain), 9) AS rate, round(max(gain), 1) + 0.0::double AS gain FROM gains GROUP BY 1""")
def _(spark, d):
    shape = C.Shape(3, 2, 0)
    found = M.candidates(pair_counts(spark, d, shape), model(shape), P.all_rules("ACGT", 1))
    return rounded(rounded(found, "rate", digits=9), "gain", digits=1)


@query("ordered_clusters", f"WITH {EXPECTED} SELECT substr(inpat, 2, 2) AS cluster, count(*) AS n, round(max(z), 4) + 0.0::double AS z, row_number() OVER (ORDER BY round(max(z), 4) DESC, cluster)::int AS place FROM r GROUP BY 1")
def _(spark, d):
    r = _resids(spark, d).select(F.col("inpat").alias("pattern"), "z", F.substring("inpat", 2, 2).alias("cluster"))
    c = rounded(R.ordered_clusters(r.select("pattern", "z"), r.select("pattern", "cluster").distinct()), "z", digits=4)
    return c.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("z"), "cluster")))  # 16 clusters


@query("residual_clusters")
def _(spark, d):
    top = R.above_quantile(_resids(spark, d), "z", 0.9).select(F.col("inpat").alias("pattern"))
    return R.clusters(top, 6)


@query("simulated_documents")
def _(spark, d):
    starts = seq_docs(spark, d).select(F.col("doc_id").alias("rep_id"), F.regexp_replace("seq", "[^ACGT]", "").alias("initseq")).repartition(spread(spark))
    return Z.simulate(starts, list(MUTPATS), list(RATES), 0.1, log=False).drop("events")


@query("simulated_tree")
def _(spark, d):
    starts = seq_events(spark, d).select(F.col("user_id").alias("rep_id"), F.regexp_replace("seq", "[^ACGT]", "").alias("initseq"))
    rules = (list(MUTPATS), list(RATES))
    return Z.simulate_tree(starts, [("root", "an", 0.2), ("root", "sp1", 0.5), ("an", "sp2", 0.3), ("an", "sp3", 0.3)], dict.fromkeys(("an", "sp1", "sp2", "sp3"), rules))


QUERIES |= {name: fn for name, (fn, _) in FORMATS.items()}
ORACLE_SQL |= {name: sql for name, (_, sql) in FORMATS.items()}
