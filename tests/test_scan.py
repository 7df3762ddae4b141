"""Files read in parts give what whole files give, wherever they are cut."""

import gzip
import random

import pytest

from vicinal.sources import readers, scan


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def brute(text, patterns):
    return sorted((p, i + 1) for p in patterns for i in range(len(text)) if text.startswith(p, i))


@pytest.mark.parametrize(("breaks", "row", "range_"), [(True, 16, 48), (False, 16, 48), (False, 1, 3), (True, 1000, 1000)])
def test_raw_ranges(spark, tmp_path, breaks, row, range_):
    rng = random.Random(row)
    texts = ["".join(rng.choices("ACGT\n", weights=[4, 4, 4, 4, 1], k=n)) for n in (150, 0, 1, 70)]
    for k, t in enumerate(texts):
        (tmp_path / f"part{k}").write_bytes(t.encode())
    pats = ["AC", "ACG", "T", "GGTA"]
    clean = lambda t: t if breaks else t.replace("\n", "")
    got = readers.raw_occurrences(spark, str(tmp_path), pats, breaks, joined=True, row=row, range_=range_)
    assert sorted((r["pattern"], r["pos"]) for r in got.collect()) == brute(clean("".join(texts)), pats)
    got = readers.raw_occurrences(spark, str(tmp_path / "part*"), pats, breaks, row=row, range_=range_).collect()
    for k, t in enumerate(texts):
        assert sorted((r["pattern"], r["pos"]) for r in got if r["path"].endswith(f"part{k}")) == brute(clean(t), pats)


def test_raw_compressed_and_split(spark, tmp_path):
    text = "".join(random.Random(4).choices("ACGT", k=5000))
    (tmp_path / "g.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "g").write_text(text)
    for name in ("g.gz", "g"):
        got = readers.raw_occurrences(spark, str(tmp_path / name), ["ACG", "TTTT"], row=64, range_=256)
        assert sorted((r["pattern"], r["pos"]) for r in got.collect()) == brute(text, ["ACG", "TTTT"])
    spark.dataSource.register(scan.Ranges)
    ranges = spark.read.format("vicinal-ranges").options(path=str(tmp_path / "g"), range="256").load()
    assert ranges.rdd.getNumPartitions() == 20  # a file is many tasks
    assert "".join(r["symbol"] for r in readers.symbols(spark, str(tmp_path / "g")).orderBy("pos").collect()) == text


def test_records_across_splits(spark, tmp_path, small_splits):
    rng = random.Random(1)
    rows = [(f">d{i}", "".join(rng.choices("ACGT", k=rng.randrange(1, 90))), f">d{i}_next", "".join(rng.choices("ACGT", k=rng.randrange(1, 90)))) for i in range(60)]
    (tmp_path / "x.fa").write_text("".join("\n" * rng.randrange(2) + "\n".join(r) + "\r\n" for r in rows))
    (tmp_path / "y.fa").write_text(">z\nA\n>z2\nC\n")
    assert spark.read.text(str(tmp_path / "x.fa")).rdd.getNumPartitions() > 10
    assert sorted(tuple(r) for r in readers.paired_fasta(spark, str(tmp_path)).collect()) == sorted([*rows, (">z", "A", ">z2", "C")])
    got = scan.numbered(spark, str(tmp_path / "x.fa")).orderBy("no").collect()
    assert [r["no"] for r in got] == list(range(240)) and [r["line"] for r in got] == [x for r in rows for x in r]
    (tmp_path / "cut.fa").write_text(">a\nAC\n>a\n")
    readers.paired_fasta(spark, str(tmp_path / "cut.fa")).collect()
    (tmp_path / "bad.fa").write_text(">a\nAC\n")
    with pytest.raises(Exception, match="headers do not match"):
        readers.paired_fasta(spark, str(tmp_path / "bad.fa")).collect()


def test_both_layouts(spark, tmp_path, small_splits):
    rng = random.Random(2)
    taxa = {f"tax{i}": "".join(rng.choices("ACGT-", k=130)) for i in range(9)}
    (tmp_path / "seq.phy").write_text(" 9 130\n" + "".join(f"{t}  {s[:10]} {s[10:]}\n" for t, s in taxa.items()))
    blocks = [[s[i : i + 30] for s in taxa.values()] for i in range(0, 130, 30)]
    (tmp_path / "int.phy").write_text("9 130\n" + "\n".join("".join((f"{t} " if k == 0 else "   ") + f"{x[:7]} {x[7:]}\n" for t, x in zip(taxa, b, strict=True)) for k, b in enumerate(blocks)))
    for name in ("seq.phy", "int.phy"):
        assert {r["taxon"]: r["seq"] for r in readers.multiple_alignment(spark, str(tmp_path / name)).collect()} == taxa
    assert readers.multiple_alignment(spark, str(tmp_path), ["tax3"]).count() == 2


def test_large_files_are_not_shuffled(spark, tmp_path):
    """Places in a file come from a row a range, so the symbols stay where they are read."""
    from vicinal.staging import settings

    (tmp_path / "g").write_text("ACGT" * 500)
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        plan = scan.stretches(spark, str(tmp_path / "g"), 3, row=64, range_=256)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_more_taxa_are_more_files(spark, monkeypatch):
    from vicinal.plans import formats

    monkeypatch.setattr(formats, "TAXA", 40)
    path = formats._alignment(spark, "/root/testdata/sf0.001", 1)
    lines = spark.read.text(path).selectExpr("_metadata.file_path AS f", "value").filter("trim(value) <> ''").groupBy("f").count()
    assert lines.count() > 16 and lines.agg({"count": "max"}).first()[0] < 120
