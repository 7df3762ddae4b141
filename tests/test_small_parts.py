"""Functions that no registered query reaches."""

import math

import numpy as np
import pytest

from vicinal.functions import patterns as P, sequences as S
from vicinal.operators import generator as G, linalg as L, model as M, results as X
from vicinal.operators.tmers import Shape
from vicinal.sources import readers, writers


def test_rule_functions(spark):
    assert P.n_patterns(3, "ACGT") == 64 and len(P.pattern_list(3, "ACGT")) == 64
    assert P.pattern_changes([[("CG", "TG"), ("CG", "CA")]]) == [[("C", "T"), ("G", "A")]]
    rules = P.all_rules("AC", 2, (1, 2))
    assert [("A", "C")] in rules and [("AC", "CA")] in rules and len(rules) == 2 + 12
    assert P.reverse_complement_rules([[("C", "T")], [("G", "A")], [("A", "C")]]) == [1, 0, None]
    with pytest.raises(ValueError, match="several"):
        P.reverse_complement_rules([[("C", "T")], [("G", "A")], [("G", "A")]])


def test_left_changed(spark):
    df = spark.createDataFrame([("ACGT", "TCGT"), ("ACGT", "ACGA"), ("ACGT", "ACGT")], "a string, b string")
    assert [r[0] for r in df.select(S.left_changed("a", "b", 1, 2)).collect()] == [True, False, None]


def test_derivatives():
    f = lambda x: 3 * x[0] ** 2 + 2 * x[0] * x[1] + x[1] ** 2
    x = np.array([0.5, -1.0])
    assert L.gradient(f, x) == pytest.approx([1.0, -1.0], abs=1e-6)
    h = L.hessian(f, x)
    assert h == pytest.approx(np.array([[6.0, 2.0], [2.0, 2.0]]), abs=1e-5)
    assert L.correlations(h)[0, 1] == pytest.approx(-2 / math.sqrt(12), abs=1e-5)


def test_tables_by_schema_and_combined(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "z int")
    got = X.by_schema([a, b, a])
    assert {k: v.count() for k, v in got.items()} == {"x,y": 2, "z": 1}
    mut = spark.createDataFrame([("A", "C", 0, 1), ("A", "C", 0, 2), ("A", "G", 0, 1)], "i string, j string, rate_id int, n int")
    assert sorted(map(tuple, G.combined(mut).collect())) == [("A", "C", 0, 3), ("A", "G", 0, 1)]
    sel = spark.createDataFrame([("A", "C", 0, 1.0), ("A", "C", 0, 2.0)], "i string, j string, sel_id int, ds double")
    assert tuple(G.averaged(sel).first()) == ("A", "C", 0, 1.5)
    gen = spark.createDataFrame([("A", "C", 0.5), ("A", "G", 0.25)], "i string, j string, x double")
    assert tuple(G.totals(gen).first()) == ("A", 0.75)
    assert [d.columns for d in X.column_chunks(mut, 3)] == [["i", "j", "rate_id"], ["n"]]


def test_fixed_rates_stay(spark):
    m = M.Model("XO", ((("X", "O"),), (("O", "X"),)), (0.3, 0.2), Shape(2, 1, 0), scales=(1.0, 0.0))
    counts = spark.createDataFrame([(a, s, 10 + 3 * k) for k, (a, s) in enumerate((a, s) for a in m.patterns() for s in "XO")], "long string, short string, count long")
    fitted, _, _ = M.fit(counts, m)
    assert fitted.rates[1] == 0.2 and fitted.rates[0] != 0.3


def test_models_that_do_not_fit():
    for bad in ({"rates": (1.0, 2.0)}, {"mutpats": ((("X", "OO"),),)}, {"mutpats": ((("X", "A"),),)}, {"fixfn": "other"}, {"selcoef": (1.0,)}):
        with pytest.raises(ValueError):
            M.Model(**({"bases": "XO", "mutpats": ((("X", "O"),),), "rates": (1.0,), "shape": Shape(1, 1, 0)} | bad))


def test_too_many_rules(spark, monkeypatch):
    monkeypatch.setattr(G, "MOST_RULES", 1)
    with pytest.raises(ValueError, match="more than 1 rules"):
        G.applied(P.patterns(spark, 2, "AC"), P.rules(spark, [[("A", "C"), ("C", "A")]]))


def test_saved_tables_and_raw_sequences(spark, tmp_path):
    (tmp_path / "raw").write_text("ACG")
    assert [(r["pos"], r["symbol"]) for r in readers.symbols(spark, str(tmp_path / "raw")).orderBy("pos").collect()] == [(1, "A"), (2, "C"), (3, "G")]
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.json").write_text('{"x": 2, "y": [1]}')
    (tmp_path / "c.json").write_text("{broken")
    assert sorted(r["x"] for r in readers.json_results(spark, str(tmp_path / "*.json")).collect()) == [1, 2]
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert readers.saved(spark, str(tmp_path / "t")).count() == 3
    writers.config({"rates": [1, 2]}, str(tmp_path / "conf"))
    from vicinal.operators import config

    assert config.updated({"a": {"rates": 1}}, {"a": {"rates": 2}}) == {"a": {"rates": 2}}


def test_dense_counts(spark, tmp_path):
    (tmp_path / "c").write_text('# {"leftwin": 0}\nx y count\nAC A 2\nCC C 5\n')
    got, shape = readers.dense_counts(spark, str(tmp_path / "c"))
    assert (shape.longwin, shape.shortwin, shape.leftwin) == (2, 1, 0)
    want = {(a + b, c): 0.0 for a in "AC" for b in "AC" for c in "AC"} | {("AC", "A"): 2.0, ("CC", "C"): 5.0}
    assert {(r["x"], r["y"]): r["count"] for r in got.collect()} == want
    assert readers.dense_counts(spark, str(tmp_path / "c"), bases="ACG", skip=1, leftwin=0)[0].count() == 27
    with pytest.raises(ValueError, match="not among those wanted: CC"):
        readers.dense_counts(spark, str(tmp_path / "c"), longs=spark.createDataFrame([("AC",)], "pattern string"))
    with pytest.raises(ValueError, match="not among those wanted"):
        readers.dense_counts(spark, str(tmp_path / "c"), bases="A")


def test_saved_model(spark, tmp_path):
    from vicinal.operators.model import Model
    from vicinal.operators.tmers import Shape
    from vicinal.sources import writers

    m = Model("XO", ((("X", "O"), ("O", "X")), (("XO", "OX"),)), (0.5, 0.25), Shape(4, 2, 1), selpats=((("OX", 1.0), ("XO", 1.0)), (("X", 0.5),)), selcoef=(-0.6, 0.3), fixfn="ising", gamma_shape=2.0, boundary="wrap")
    writers.model(spark, m, str(tmp_path / "m"))
    assert readers.model(spark, str(tmp_path / "m")) == m


def test_a_staged_job_leaves_no_shuffle_files(spark):
    import glob
    import time

    from pyspark.sql import functions as F

    from vicinal.staging import discard, staged

    files = lambda: set(glob.glob(f"{spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())}/../blockmgr-*/*/shuffle_*.data"))
    before = files()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    out = staged(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(key, None) == old
    assert out.count() == 7
    discard(out)
