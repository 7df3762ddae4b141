"""The pipeline's stages on the smallest tables, each against a brute-force version on its own input."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest
from tokenizers import Tokenizer

from vicinal.llm import bpe, mixing

from .test_text import brute

pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def steps(spark):
    """The input and the result of each stage."""
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        got = pipeline.staged(stage(spark, docs, DIR), "test")
        out.append((name, docs.toPandas(), got.toPandas()))
        docs = got
    return out


def test_columns(steps):
    for _, before, after in steps[:-1]:
        assert list(after.columns) == list(before.columns)


def test_language_and_toxicity_keep_rows_whole(steps):
    for _, before, after in steps[:2]:
        both = before.merge(after, on="doc_id", suffixes=("", "_after"))
        assert len(both) == len(after) and (both["text"] == both["text_after"]).all()
    assert len(steps[0][2]) == len(steps[0][1])  # every text has letters and one clear language
    toxic = set(duckdb.sql(f"SELECT doc_id FROM '{DIR}/labels.parquet' WHERE toxic = 0").df()["doc_id"])
    gone = set(steps[1][1]["doc_id"]) - set(steps[1][2]["doc_id"])
    assert len(gone & toxic) <= 1


def test_one_document_of_each_group(steps):
    _, before, after = steps[2]
    want = {c for _, _, c in brute(list(zip(before["doc_id"].tolist(), before["text"].tolist(), strict=True)))}
    assert sorted(after["doc_id"]) == sorted(want)


def test_mix(steps):
    _, before, after = steps[3]
    c = duckdb.connect()
    c.register("documents", before)
    want = c.sql(mixing.ORACLE).df()
    times = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in want.itertuples()}
    assert Counter(after["doc_id"]) == Counter({k: v for k, v in times.items() if v})


def test_tokens(steps):
    _, before, after = steps[4]
    lib, sha = Tokenizer.from_file(bpe.default_path()), lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in before.itertuples():
        ids = lib.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert sorted(want) == sorted(after[["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False, name=None))


def test_run_is_the_stages(spark, steps):
    got = pipeline.run(spark, DIR).toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, steps[-1][2].to_numpy().tolist()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, _row string, k0 string, lang_pred string, _tox_text string, size string, _0 string"


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows(spark, stage):
    """Nulls in every column, empty and very long texts, repeated rows, no rows, and further columns of any name."""
    name, fn = pipeline.STAGES[stage]
    long = " ".join(f"the word{i % 5000} of" for i in range(150_000))  # two megabytes
    texts = ["the water of the stone and the word " * 3, "the water of the stone and the word " * 3, None, "", " \n", "123 !!", long, "über den stein und das wasser nicht weit", "x"]
    rows = [(i if i != 7 else None, t, "en", "s" if i % 2 else None, None, "a", "b", "c", "d", "e", "f", "g") for i, t in enumerate(texts)]
    rows += [rows[0], (None,) * 12]
    docs = spark.createDataFrame(rows, ODD)
    got = fn(spark, docs, DIR)
    empty = fn(spark, docs.limit(0), DIR)
    assert empty.columns == got.columns and empty.count() == 0
    found = got.collect()
    if stage < 4:
        assert got.columns == docs.columns
        assert {tuple(r) for r in found} <= set(rows)
    if name == "n-gram Jaccard join":
        want = {c for _, _, c in brute([(i, r[1]) for i, r in enumerate(rows)])}
        assert len(found) == len(want)
    if name == "BPE encoding and decoding":
        lib = Tokenizer.from_file(bpe.default_path())
        assert sorted(r["n_tokens"] for r in found) == sorted(len(lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
