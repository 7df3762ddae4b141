"""Sequences of events of which one user has most."""

import random
from collections import Counter

import pytest

from vicinal.plans import catalog, views


@pytest.fixture(scope="module", autouse=True)
def parts(spark):
    """Small ranges stay apart, so that runs go over their borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng, d = random.Random(4), str(tmp_path_factory.mktemp("events"))
    users = [7] * 30_000 + [u for u in [None, *range(100, 160)] for _ in range(rng.randint(1, 9))]
    rng.shuffle(users)
    kinds = [*views.EVENTS, "other", None]
    rows = [(i, rng.randint(0, 500), u, rng.choice(kinds)) for i, u in enumerate(users)]
    spark.createDataFrame(rows, "event_id long, t long, user_id long, event_type string").selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type").write.parquet(f"{d}/events.parquet")
    seqs: dict = {}
    for i, t, u, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        seqs[u] = seqs.get(u, "") + views.EVENTS.get(kind, "N")
    return d, seqs


def test_whole_strings(spark, events):
    d, seqs = events
    assert views.event_runs(spark, d).filter("user_id = 7").select("part").distinct().count() > 1
    assert {r["user_id"]: r["seq"] for r in views.seq_events(spark, d).collect()} == seqs


@pytest.mark.parametrize("k, cyclic, size", [(1, False, 64), (2, False, 4096), (3, True, 4096), (3, True, 5), (9, True, 20), (9, False, 300)])
def test_kmers(spark, events, monkeypatch, k, cyclic, size):
    d, seqs = events
    monkeypatch.setattr(views, "PIECE", size)
    want: Counter = Counter()
    for s in seqs.values():
        t = s + (s * k)[: k - 1] if cyclic else s
        want.update(t[i : i + k] for i in range(len(t) - k + 1))
    assert {r["pattern"]: r["count"] for r in views.event_kmers(spark, d, k, cyclic).collect()} == want


def test_no_user_in_one_text(spark, events, monkeypatch):
    """The queries that count need no user's whole sequence; no text is much longer than a piece and a batch."""
    d, seqs = events
    monkeypatch.setattr(catalog, "seq_events", None)
    for name in ("cyclic_kmers", "keys_without_n", "unknown_patterns"):
        assert catalog.QUERIES[name](spark, d).count() > 0
    assert views.event_texts(spark, d, 3).selectExpr("max(length(seq))").first()[0] < 15_000 < len(seqs[7])
