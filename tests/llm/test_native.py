"""Mixing and sharding: SQL on a small table with odd rows, and their laws."""

from collections import Counter

import duckdb
import pytest

from vicinal.llm import mixing, sharding

ROWS = (
    [(i, " ".join(["word"] * (i % 7)), f"s{i % 4}", "en") for i in range(400)]
    + [(1000 + i, "a b c", "s0", "en") for i in range(50)]
    + [(2000, None, "s1", "en"), (2001, "", None, "fr"), (2002, "x\x0by z é", None, None), (2003, "w " * 5000, "tiny", "en"), (None, "null id", "s2", "en"), (7, "same id", "s3", "en"), (7, "same id", "s3", "en")]
)
SCHEMA = "doc_id long, text string, source string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def by_sql(docs, sql):
    c = duckdb.connect()
    documents = docs.toPandas()
    c.register("documents", documents)
    return c.sql(sql)


def rows(df, cols):
    return sorted(map(repr, (tuple(None if v != v else v for v in r) for r in df[cols].itertuples(index=False, name=None))))


@pytest.mark.parametrize(("run", "sql"), [(lambda d: mixing.mix(d).drop("epochs"), mixing.ORACLE), (sharding.shard, sharding.ORACLE)])
def test_sql(docs, run, sql):
    got = run(docs.filter("doc_id IS NOT NULL")).toPandas()
    want = by_sql(docs.filter("doc_id IS NOT NULL"), sql).df()
    cols = sorted(c for c in got.columns if c != "grown_shard")
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, cols) == rows(want.astype(got.dtypes[cols].to_dict()), cols)


def test_mix_laws(docs):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(ROWS)
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    assert abs(got["taken"].sum() - got["size"].sum()) <= 3
    for _, g in got.groupby(["source_size", "target"]):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.5


def test_mixed_rows(docs):
    got = mixing.mixed(docs).toPandas()
    assert list(got.columns) == docs.columns
    assert Counter(got["doc_id"].dropna()).most_common(1)[0][1] <= 6


def test_shard_laws(docs):
    got = sharding.shard(docs).toPandas()
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and len(n) == 8
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    per = got.merge(docs.toPandas()[["doc_id", "source"]].drop_duplicates(), on="doc_id").groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (per.max(axis=1) - per.min(axis=1) <= 3).all()


@pytest.mark.parametrize("run", [mixing.mix, mixing.mixed, sharding.shard])
def test_empty(docs, run):
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["mix", "shard"])
def test_small_ranges_and_many_sources(spark, monkeypatch, name):
    """Ranges of four rows, sources over many of them, null and repeated doc_ids: the same as the SQL."""
    from vicinal.llm import common

    for module in (common, mixing, sharding):
        monkeypatch.setattr(module, "BIN_ROWS", 4)
    rows_ = [(i % 90 if i % 5 else None, " ".join([f"w{i}"] * (i % 6)), None if i % 41 == 0 else f"host{i * i % 61}", "x") for i in range(400)]
    docs = spark.createDataFrame(rows_, SCHEMA)
    got = (mixing.mix(docs).drop("epochs") if name == "mix" else sharding.shard(docs)).toPandas()
    c = duckdb.connect()
    c.register("documents", docs.toArrow())  # keeps null doc_ids whole numbers
    want = c.sql(mixing.ORACLE if name == "mix" else sharding.ORACLE).df()
    cols = sorted(c for c in got.columns if c not in ("grown_shard", "doc_id"))
    assert len(got) == len(want) == 400
    assert rows(got, cols) == rows(want.astype(got.dtypes[cols].to_dict()), cols)
