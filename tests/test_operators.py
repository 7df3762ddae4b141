"""Golden matrices, identities and formats."""

import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from vicinal.functions import fixation, patterns as P, sequences as S
from vicinal.operators import config, generator as G, intervals as I, linalg as L, model as M, residuals as R, results as X, simulate as Z, tmers as C
from vicinal.sources import readers, writers
from vicinal.streaming.counts import running_counts

FLIPS = [[("X", "O")], [("O", "X")]]


def dense(entries, pats):
    m = np.zeros((len(pats), len(pats)))
    for r in entries.collect():
        m[pats.index(r["i"]), pats.index(r["j"])] += r["x"]
    return m


def test_enumeration_order(spark):
    assert P.pattern_list(2, "XO") == ["XX", "OX", "XO", "OO"]
    got = [r["pattern"] for r in P.patterns(spark, 2, "XO").orderBy("pattern_idx").collect()]
    assert got == P.pattern_list(2, "XO")
    assert P.rule_names([[("A", "C"), ("G", "T")]]) == ["A->C|G->T"]
    assert P.reverse_complement_rules([[("CG", "TG")], [("CG", "CA")], [("A", "C")]]) == [1, 0, None]


@pytest.mark.parametrize("rates", [(1, 1), (1, 2)])
def test_two_letter_generator(spark, rates):
    pats = P.pattern_list(2, "XO")
    mut = G.applied(P.patterns(spark, 2, "XO"), P.rules(spark, FLIPS))
    a, b = rates  # X becomes O at a, O becomes X at b
    assert dense(G.generator(mut, None, list(rates)), pats).tolist() == [[0, a, a, 0], [b, 0, 0, a], [b, 0, 0, a], [0, b, b, 0]]


def test_wrapped_rules_by_brute_force(spark):
    rules = [[("OX", "XO")], [("XOX", "OOO"), ("X", "O")]]
    want = Counter()
    for p in P.pattern_list(4, "XO"):
        for k, g in enumerate(rules):
            for a, b in g:
                for s in range(4):
                    at = [(s + d) % 4 for d in range(len(a))]
                    if "".join(p[i] for i in at) == a:
                        q = list(p)
                        for i, c in zip(at, b, strict=True):
                            q[i] = c
                        want[p, "".join(q), k] += 1
    got = G.applied(P.patterns(spark, 4, "XO"), P.rules(spark, rules), "wrap").collect()
    assert {(r["i"], r["j"], r["rate_id"]): r["n"] for r in got} == want


def test_selection_and_fixation(spark):
    pats = P.patterns(spark, 3, "XO")
    sel = G.selection(pats, spark.createDataFrame([(0, "OX", 1.0), (0, "X", 0.5)], "sel_id int, selpat string, factor double"))
    w = {p: 0.5 * p.count("X") + sum(p.startswith("OX", s) for s in range(2)) for p in P.pattern_list(3, "XO")}
    mut = G.applied(pats, P.rules(spark, FLIPS))
    got = G.generator(mut, G.differences(mut, sel), [1.0, 2.0], [0.7], fixation.parse("ising.fixfn"))
    for r in got.collect():
        rate = 1.0 if r["i"].count("X") > r["j"].count("X") else 2.0
        assert abs(r["x"] - rate / (1 + np.exp(-0.7 * (w[r["j"]] - w[r["i"]])))) < 1e-12
    with pytest.raises(ValueError):
        fixation.parse("__import__('os')")


def sparse(model):
    i, j, r = model.ways()
    return L.Sparse(i, j, np.array(model.rates)[r], len(model.patterns()))


def full(g):
    q = np.zeros((g.n, g.n))
    np.add.at(q, (g.i, g.j), g.x)
    return q - np.diag(q.sum(1))


def series(q, t):
    """Dense exponential by scaling and squaring."""
    a, out = q * t / 2**12, np.eye(len(q))
    for k in range(18, 0, -1):
        out = np.eye(len(q)) + a @ out / k
    for _ in range(12):
        out = out @ out
    return out


MODEL = M.Model("XO", tuple(map(tuple, FLIPS)) + ((("OX", "XO"),),), (0.4, 0.7, 0.3), C.Shape(4, 2, 1), 1.3)


def test_exponential_action():
    g = sparse(MODEL)
    u = L.projection(MODEL.patterns(), P.pattern_list(2, "XO"), 1)
    assert np.allclose(MODEL.transitions(), series(full(g), 1.3) @ u, atol=1e-9)
    assert np.allclose(MODEL.transitions().sum(1), 1)
    assert np.allclose(L.exp_action(g, u, 400.0).std(0), 0, atol=1e-6)


def test_gamma_time_is_exponential_for_shape_one():
    g = sparse(MODEL)
    want = np.linalg.inv(np.eye(g.n) - 0.8 * full(g))
    assert np.allclose(L.gamma_action(g, np.eye(g.n), 1.0, 0.8), want, atol=1e-8)


def test_peeling_against_dense_products():
    g, pats = sparse(MODEL), MODEL.patterns()
    u = L.projection(pats, P.pattern_list(2, "XO"), 1)
    pi = L.root_distribution(pats, {"X": 0.3, "O": 0.7})
    edges = config.newick("((a:0.3,b:0.6)n:0.2,c:0.5)r;")
    assert edges == [("r", "n", 0.2), ("n", "a", 0.3), ("n", "b", 0.6), ("r", "c", 0.5)]
    gens = dict.fromkeys("nabc", g)
    e = lambda t: series(full(g), t)
    want = np.einsum("r,rn,na,nb,bx,rc,cy->axy", pi, e(0.2), e(0.3), e(0.6), u, e(0.5), u).reshape(len(pats), -1)
    got = M.peel(edges, "a", ["b", "c"], gens, u, pi, normalize=False)
    assert np.allclose(got, want, atol=1e-9)
    two = config.newick("(a:0.3,b:0.6)r;")
    assert np.allclose(M.peel(two, "a", ["b"], gens, u, pi), L.up_down(g, g, u, pi, 0.6, 0.3), atol=1e-9)
    assert config.root(edges) == "r" and config.descendants(edges, "n") == ["a", "b"] and config.cherries(edges) == [("n", "a", "b")]


def test_fit_recovers_rates(spark):
    true = M.Model("XO", tuple(map(tuple, FLIPS)), (0.5, 0.8), C.Shape(3, 1, 1))
    p = M.transition_frame(spark, true)
    counts = p.withColumn("count", F.round(F.col("p") * 100_000).cast("long"))
    got, value, done = M.fit(counts, true.with_rates((0.2, 0.2)))
    assert np.allclose(got.rates, true.rates, rtol=0.02)
    kept, _, _ = M.fit(counts, M.Model("XO", true.mutpats, (0.5, 0.2), true.shape, scales=(0, 1)))
    assert kept.rates[0] == 0.5 and abs(kept.rates[1] - 0.8) < 0.02
    chain = M.sample(counts, true, 30, 2).groupBy("chain", "name").agg(F.avg("value").alias("m")).collect()
    assert len(chain) == 4 and all(0.3 < r["m"] < 1.0 for r in chain)


def test_minimise_stays_in_the_box():
    x, _, done = L.minimise(lambda x: ((x - [3, -2]) ** 2).sum(), np.array([0.5, 0.5]), np.array([0.0, 0.0]), np.array([1.0, 1.0]))
    assert np.allclose(x, [1, 0], atol=1e-6) and done


SEQS = st.lists(st.tuples(st.text("ACGTN", min_size=1, max_size=40), st.text("ACGTN", min_size=1, max_size=40)), min_size=1, max_size=5)


@settings(max_examples=15, deadline=None)
@given(SEQS, st.sampled_from([(4, 2, 1), (3, 1, 1), (2, 1, 0)]), st.sampled_from([0, 2, 3]))
def test_counts_by_brute_force(spark, pairs, shape, shift):
    n, w, o = shape
    want = Counter()
    for a, b in pairs:
        for x in range(min(len(a), len(b)) - n + 1):
            key = (a[x : x + n], b[x + o : x + o + w])
            if set("".join(key)) <= set("ACGT"):
                want[(*key, -(x + 1) % shift) if shift else key] += 1
    got = C.tmer_counts(spark.createDataFrame(pairs, "a string, b string"), C.Shape(*shape), "a", "b", shift=shift).collect()
    assert {tuple(r)[:-1]: r["count"] for r in got} == want


def test_chunks_do_not_matter(spark, monkeypatch):
    df = spark.createDataFrame([("ACGTTGCA" * 50, "TGCAACGG" * 50)], "a string, b string")
    count = lambda: sorted(map(tuple, C.tmer_counts(df, C.Shape(5, 2, 2), "a", "b").collect()))
    whole = count()
    monkeypatch.setattr(C, "CHUNK", 7)
    assert count() == whole


def test_projection_is_the_mean_over_shifts(spark):
    df = spark.createDataFrame([("XXOOXOXXOXOOOX" * 9, "XOOXXOXOOXXOXO" * 9)], "a string, b string")
    big, small = C.Shape(4, 2, 1), C.Shape(2, 1, 0)
    a = {tuple(r)[:2]: r["count"] for r in C.projected(C.tmer_counts(df, big, "a", "b", alphabet=None), big, small).collect()}
    b = {tuple(r)[:2]: r["count"] for r in C.tmer_counts(df, small, "a", "b", alphabet=None).collect()}
    assert all(abs(a[k] - b.get(k, 0)) <= 3 for k in a)
    with pytest.raises(ValueError, match="unreconcilable"):
        C.projected(df, small, big)


def test_string_functions(spark):
    df = spark.createDataFrame([("ACGTC", "AGGTT")], "a string, b string")
    got = df.select(
        S.wrap_substring("a", F.lit(4), F.lit(12)), S.wrap_overwrite("a", F.lit(4), F.lit("XYZ")), S.reverse_complement("a"), S.hamming("a", "b"), S.change_positions("a", "b"),
        S.changed_sites("a", "b", "a"), S.gc_count("a"), S.pattern_index(F.lit("CA"), "ACGT"), S.flanks_lowered("a", 1, 2), S.outside(F.lit("AC\n")),
    ).first()
    assert list(got) == ["TCACGTCAC", "ZCGXY", "GACGT", 2, [2, 5], 2, 3, 1, "aCGtc", True]


def test_intervals_by_brute_force(spark):
    rng = np.random.default_rng(3)
    pos = [(int(p),) for p in rng.integers(0, 5000, 300)]
    cds = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 5000, 40), rng.integers(0, 1500, 40), strict=True)]
    got = I.coding_frames(spark.createDataFrame(pos, "pos long"), spark.createDataFrame(cds, "start long, end long")).collect()
    assert len(got) == len(pos)
    for r in got:
        first = min((s for s, e in cds if s <= r["pos"] < e), default=None)
        assert r["coding"] == (first is not None) and r["frame"] == (None if first is None else (r["pos"] - first) % 3)
    blocks = [("c", s, e) for s, e in cds]
    pairs = I.overlaps(spark.createDataFrame(blocks, "chrom string, start long, end long"), spark.createDataFrame(blocks, "chrom string, start long, end long"))
    want = sum(max(a[1], b[1]) < min(a[2], b[2]) for a in blocks for b in blocks)
    assert pairs.count() == want


def test_merged_complements_is_an_involution(spark):
    d = spark.createDataFrame([("ACG", "C", 5.0, 4.0), ("CGT", "G", 3.0, 2.0), ("AAT", "A", 1.0, 1.0)], "inpat string, outpat string, observed double, expected double")
    once = R.merged_complements(d, 3, 1, 1)
    assert {r["inpat"]: r["observed"] for r in once.collect()} == {"ACG": 8.0, "AAT": 1.0}
    assert sorted(map(tuple, R.merged_complements(once, 3, 1, 1).collect())) == sorted(map(tuple, once.collect()))
    with pytest.raises(ValueError):
        R.merged_complements(d, 3, 0, 1)


def test_simulation(spark):
    starts = Z.random_sequences(spark, 4, 500, {"X": 0.5, "O": 0.5})
    one = Z.simulate(starts, [[("X", "O")]], [50.0], 1.0)
    assert {r["finalseq"] for r in one.collect()} == {"O" * 500}
    again = Z.simulate(starts, FLIPS, [0.3, 0.6], 1.0)
    assert sorted(r["finalseq"] for r in again.collect()) == sorted(r["finalseq"] for r in again.collect())
    share = np.mean([r["finalseq"].count("X") / 500 for r in Z.simulate(starts, FLIPS, [1.0, 3.0], 20.0).collect()])
    assert abs(share - 0.75) < 0.05
    tree = Z.simulate_tree(starts, [("r", "a", 0.1), ("a", "b", 0.1)], dict.fromkeys("ab", (FLIPS, [1.0, 1.0])))
    assert tree.count() == 12
    assert Z.shown("XOX", "XXX", [{"i": "O", "j": "X", "loc": 2}, {"i": "X", "j": "O", "loc": 3}]) == ".Xx"


def test_configuration():
    c = config.read(json.dumps({"bases": ["X", "O"], "mutpats": [[["X", "O"]]], "mutrates": [1], "selpats": {"a": {"XX": 2, "O": [0.5]}}, "selcoef": [1], "tree": ["(sp1:1,sp2:2)root;"], "sp1": "sp2", "sp2": {"mutrates": [3]}}))
    assert c["selpats"] == [["XX", "O"]] and c["selfactors"] == [[2.0, 0.5]] and config.check(c) == []
    m = config.models(c)
    assert m["sp1"]["mutrates"] == [3] and m["sp1"]["bases"] == ["X", "O"]
    assert config.check(c | {"mutrates": [1, 2]})
    with pytest.raises(ValueError):
        config.dereferenced({"a": "b", "b": "a"}, "a")
    assert list(config.models({"mutpats": [], "mutrates": []})) == ["tip"]


def test_formats(spark, tmp_path):
    (tmp_path / "x.axt").write_text("# c\n0 chr1 10 14 chr2 20 24 + 99\nACGTA\nACG-A\n\n1 chr1 30 32 chr2 1 3 - 5\nAAA\nAAT\n")
    got = readers.axt(spark, str(tmp_path / "x.axt")).orderBy("block_id").collect()
    assert [(r["chrom"], r["start"], r["seq2"], r["score"]) for r in got] == [("chr1", 10, "ACG-A", 99), ("chr1", 30, "AAT", 5)]
    (tmp_path / "x.fa").write_text(">a.1\nAC\n>a.2\nAG\n>b.1\nC\n>b.2\nC\n")
    assert readers.paired_fasta(spark, str(tmp_path / "x.fa"), [".1"]).count() == 2
    with pytest.raises(Exception, match="headers do not match"):
        readers.paired_fasta(spark, str(tmp_path / "x.fa")).collect()
    (tmp_path / "p").write_text("chr1 5 9 z\nchr2\t7 8\n")
    assert [tuple(r) for r in readers.positions(spark, str(tmp_path / "p")).orderBy("start").collect()] == [("chr1", 5, 9), ("chr2", 7, 8)]
    counts = spark.createDataFrame([("ACG", "C", 5), ("CGT", "G", 3)], "long string, short string, count long").coalesce(1)
    writers.counts(counts, str(tmp_path / "c"), C.Shape(3, 1, 1))
    back, shape = readers.counts(spark, str(tmp_path / "c"))
    assert shape == C.Shape(3, 1, 1) and sorted(map(tuple, back.collect())) == [("ACG", "C", 5.0), ("CGT", "G", 3.0)]
    (tmp_path / "d").write_text("a b count\nAC A 1\nAC A 2\n")
    with pytest.raises(ValueError):
        readers.counts(spark, str(tmp_path / "d"), 0)
    (tmp_path / "m").write_text(" 2 4\nhum AC GT\nape ACGA\n")
    assert {tuple(r) for r in readers.multiple_alignment(spark, str(tmp_path / "m"), ["hum"]).collect()} == {("hum", "ACGT")}
    assert [len(d.columns) for d in X.column_chunks(counts, 2)] == [2, 1]


def test_running_counts_equal_batch_counts(spark, tmp_path):
    df = spark.createDataFrame([("ACGTAC", "ACGGAC"), ("TTGACA", "TTGACC"), ("ACGT", "ACGA")], "a string, b string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    shape = C.Shape(3, 1, 1)
    q = running_counts(spark, str(tmp_path / "in"), df.schema, shape, "a", "b").writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, C.tmer_counts(df, shape, "a", "b").collect()))


def test_intervals_of_all_lengths(spark):
    import random

    from vicinal.operators import intervals as I

    rng = random.Random(5)
    spans = lambda n: [(f"c{rng.randrange(2)}", s := rng.randrange(-5000, 10**6), s + rng.choice([0, 1, 2, 255, 256, 257, 2048, 2049, 40_000, 10**6, 10**12])) for _ in range(n)]
    a, b = spans(120), spans(120)
    blocks, regions = (spark.createDataFrame(x, "chrom string, start long, end long") for x in (a, b))
    got = sorted((r["chrom"], r["b_start"], r["b_end"], r["r_start"], r["r_end"], r["start"], r["end"]) for r in I.overlaps(blocks, regions).collect())
    assert got == sorted((c, s, e, x, y, max(s, x), min(e, y)) for c, s, e in a for k, x, y in b if c == k and s < e and x < y and max(s, x) < min(e, y))
    pos = [(f"c{rng.randrange(3)}", rng.randrange(-6000, 10**6)) for _ in range(300)]
    frames = I.coding_frames(spark.createDataFrame(pos, "chrom string, pos long"), regions, ["chrom"]).collect()
    for r in frames:
        over = sorted((s, e) for c, s, e in b if c == r["chrom"] and s <= r["pos"] < e)
        assert (r["coding"], r["frame"]) == ((True, (r["pos"] - over[0][0]) % 3) if over else (False, None))
    assert len(frames) == 300
    whole = spark.createDataFrame([("c", 0, 10**15)], "chrom string, start long, end long")
    assert I.binned(whole, "start", "end").count() <= 2  # no row for each bin of a long interval
    assert I.overlaps(blocks.limit(0), regions).count() == I.coding_frames(spark.createDataFrame(pos, "chrom string, pos long"), regions.limit(0), ["chrom"]).filter("coding").count() == 0


def test_quantiles_of_tied_values(spark):
    import numpy as np

    from vicinal.operators import ranks

    rng = np.random.default_rng(2)
    rows = [("a", 5.0)] * 900 + [("a", float(x)) for x in rng.normal(5, 1, 100)] + [("b", float(x)) for x in rng.integers(0, 3, 50)] + [(None, 1.0), (None, 2.0), ("c", None), ("d", float("inf")), ("d", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    qs = (0.0, 0.01, 0.25, 0.5, 0.951, 1.0)
    got = {r["k"]: r["q"] for r in ranks.quantiles(df, ["k"], "v", qs).collect()}
    assert set(got) == {"a", "b", None, "d"} and got["d"][0] == 1.0 and got["d"][-1] == float("inf")
    for k in ("a", "b", None):
        assert np.allclose(got[k], np.quantile([v for x, v in rows if x == k], qs))
    counted = df.groupBy("k", "v").count()
    assert {r["k"]: r["q"] for r in ranks.weighted_quantiles(counted, ["k"], "v", "count", qs).collect()} == got
    assert ranks.quantiles(df.limit(0), [], "v", (0.5,)).collect()[0]["q"] in (None, [None])
