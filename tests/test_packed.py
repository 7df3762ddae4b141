"""Packed patterns give what substrings give."""

import random
from collections import Counter

import numpy as np
import pytest

from vicinal.operators import packed, tmers as C


def brute(rows, shape, alphabet, columns, shift=0):
    out = Counter()
    for seqs in rows:
        if any(s is None for s in seqs):
            continue
        for i in range(min(map(len, seqs)) - shape.longwin + 1):
            pats = [seqs[0][i : i + shape.longwin], *(s[i + shape.leftwin : i + shape.leftwin + shape.shortwin] for s in seqs[1:])]
            if set("".join(pats)) <= set(alphabet):
                out[(*pats, -(i + 1) % shift) if shift else tuple(pats)] += 1
    return sorted((*k, n) for k, n in out.items())


@pytest.mark.parametrize(("alphabet", "shape", "taxa", "shift"), [("ACGT", C.Shape(4, 2, 1), 2, 0), ("ACGT", C.Shape(3, 1, 1), 3, 3), ("XO", C.Shape(6, 2, 2), 2, 0), ("ACGTN", C.Shape(2, 1, 0), 2, 2), ("ACGT", C.Shape(12, 3, 4), 2, 0)])
def test_counts(spark, monkeypatch, alphabet, shape, taxa, shift):
    monkeypatch.setattr(packed, "STRETCH", 50)
    monkeypatch.setattr(packed, "SEGMENT", 64)
    monkeypatch.setattr(packed, "TABLE_BITS", 12)
    rng = random.Random(len(alphabet) + taxa)
    letters = list(alphabet) * 4 + ["é", "-", "n"]
    rows = [["".join(rng.choices(letters, k=rng.randrange(120))) for _ in range(taxa)] for _ in range(60)]
    rows += [["", "A"] + ["A"] * (taxa - 2), [None] + ["ACGT"] * (taxa - 1), ["ACGTACGT" * 40] * taxa]
    names = [f"s{k}" for k in range(taxa)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).repartition(3)
    got = C.tmer_counts(df, shape, *names, alphabet=alphabet, shift=shift)
    assert sorted(map(tuple, got.collect())) == brute(rows, shape, alphabet, names, shift)
    if not shift:
        old = C.tmer_counts(df.withColumn("k", df[names[0]].isNull()), shape, *names, alphabet=alphabet, keep=["k"]).drop("k")  # by substrings
        assert sorted(map(tuple, old.collect())) == sorted(map(tuple, got.collect()))


def test_patterns_that_do_not_fit():
    assert packed.fits(31, "ACGT") and not packed.fits(32, "ACGT") and not packed.fits(3, None) and not packed.fits(3, "AÉ")


def test_counter_sends_what_it_holds(monkeypatch):
    monkeypatch.setattr(packed, "MOST_KEYS", 100)
    rng, c, got = np.random.default_rng(1), packed.Counter(40), Counter()
    every = rng.integers(0, 2**40, 500)
    want = Counter()
    for _ in range(30):
        keys = rng.choice(every, 64)
        want.update(keys.tolist())
        c.add(keys)
        if c.full():
            for b in c.batches():
                got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    for b in c.batches():
        got.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    assert got == want


def test_rows_to_python_are_short(spark, monkeypatch):
    df = spark.createDataFrame([("ACGT" * 40_000, "AC" * 80_000), ("ACG", "ACGT"), ("ACGTé" * 3000, "ACGTA" * 3000)], "a string, b string")
    d = packed.segments(df, ["a", "b"], 4)
    assert d.selectExpr("max(length(_c0))", "max(length(_c1))", "sum(_n)").first() == (4099, 4099, 160_000 - 3 + 15_000 - 3)  # 10,000 of these are a batch
    monkeypatch.setattr(packed, "SEGMENT", 1 << 14)
    monkeypatch.setattr(packed, "CUTS", (100, 7))
    got = C.tmer_counts(df, C.Shape(4, 2, 1), "a", "b", shift=3)
    assert sorted(map(tuple, got.collect())) == brute([tuple(r) for r in df.collect()], C.Shape(4, 2, 1), "ACGT", ["a", "b"], 3)


def test_rows_worked_on_at_once():
    sizes = np.array([5, 5, 1, 30, 2, 2, 9])
    assert list(packed.runs(sizes, 10)) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert list(packed.runs(sizes[:0], 10)) == []
