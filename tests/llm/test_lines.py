"""Line dedup against brute force, and its index over insertions and deletions."""

import hashlib
import random

import numpy as np
import pytest

from vicinal.llm import linededup as L

SCHEMA = "doc_id long, text string, n long, key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, threshold=10):
    held = {}
    for _, text, *_ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k] = held.get(k, 0) + 1
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or held[key(x)] < threshold]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def documents():
    rng = random.Random(3)
    common = ["Share this", " \tSHARE THIS\r", "Ä line", "ä line", " nbsp", "x" * 5000, "\x1funit"]
    rows = []
    for i in range(60):
        lines = [f"own line {i} {j}" for j in range(rng.randrange(4))] + rng.choices(common, k=3) + [""] * rng.randrange(3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), 0, ""))
    rows += [(100, None, 0, ""), (101, "", 0, ""), (102, "\n\n", 0, ""), (103, "share this\nSHARE THIS", 0, ""), (103, "share this\nSHARE THIS", 0, ""), (None, "alone", 0, ""), (104, "word " * 50_000, 0, "")]
    rows += [(200 + i, f"nine{'' if i else ' '}", 0, "") for i in range(9)] + [(300 + i, " TEN\nten", 0, "") for i in range(10)]
    return rows


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_against_brute_force(spark):
    rows = documents()
    assert collected(L.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)
    assert collected(L.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3), 2)) == brute(rows, 2)
    assert L.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted([(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)], key=str)
    assert collected(L.op12(spark, str(tmp_path))) == want


def test_reversible(spark):
    rows = documents()
    one, two = (L.in_blocks(spark.createDataFrame([r for i, r in enumerate(rows) if i % 2 == k], SCHEMA)) for k in (0, 1))
    first = L.LineIndex(3).insert(one)
    both = first.insert(two)
    assert collected(both.dropped(one.union(two))) == brute(rows)
    back = both.delete(two)
    assert collected(back.refs) == collected(first.refs)
    assert collected(back.dropped(one)) == brute(rows[::2])
    gone = back.delete(one)
    assert gone.refs.count() == 0 and all(not L.Cuckoo.of(r["filter"]).has(np.arange(200, dtype=np.uint64).reshape(-1, 2)).any() for r in gone.filters.collect())
    assert collected(gone.insert(two).dropped(two)) == brute(rows[1::2])
    with pytest.raises(Exception, match="not inserted"):
        first.delete(two)


@pytest.mark.parametrize("seed", range(4))
def test_cuckoo(seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2**64, (6000, 2), np.uint64)
    keys[1::7, 0] = keys[::7, 0][: len(keys[1::7])]  # buckets that many share
    held, f = np.zeros(len(keys), bool), L.Cuckoo()
    for _ in range(12):
        at = rng.choice(len(keys), 1500, replace=False)
        f.insert(keys[at[~held[at]][:900]])
        held[at[~held[at]][:900]] = True
        at = rng.choice(np.flatnonzero(held), held.sum() // 4, replace=False)
        f.delete(keys[at])
        held[at] = False
        f = L.Cuckoo.of(f.packed())
        assert f.has(keys[held]).all()
    others = rng.integers(0, 2**64, (20_000, 2), np.uint64)
    assert f.has(others).mean() < 0.01
    f.delete(keys[held])
    assert not any(t.any() for t in f.levels)
    with pytest.raises(ValueError):
        f.delete(keys[:1])
