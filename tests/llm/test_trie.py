"""The prefix trie of conversations against a dictionary of prefixes."""

import hashlib
import random
import zlib

from vicinal.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth long, node string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    convs = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    members, path = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        path[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path[c]) + 1):
            members.setdefault(path[c][:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if path[c] == p))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in members.items())


def random_turns(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn * 2, rng.choice(["user", "assistant", "", None]), rng.choice(words), 0, ""))
    rng.shuffle(rows)
    return rows


def check(spark, rows, parts=3):
    got = T.trie(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_many_shared_prefixes(spark):
    check(spark, random_turns(1, range(60), 9, ["a", "é", None]))


def test_long_odd_and_sparse(spark):
    rows = random_turns(2, [0, 3, 4, 7, 8, 11, 99, 10**12 + 3, 10**12 + 4], 4, ["a", "b" * 3000])
    rows += [(5, t, "user", "a", 0, "") for t in range(40)] + [(6, t, "user", "a" if t != 30 else "z", 0, "") for t in range(43)]
    rows += [(None, 1, "user", "x", 0, ""), (20, None, "user", "n", 0, ""), (20, 1, "user", "b", 0, ""), (20, 1, "user", "a", 0, ""), (20, 1, "user", "a", 0, ""), (20, None, None, None, 0, "")]
    check(spark, rows, 4)
    # A conversation whose turns are all replaced by those of one that is not there.
    c = next(i for i in range(1, 100) if i % 5 and zlib.crc32(str(i).encode()) % 9 > 2)
    check(spark, [(c, 0, "user", "a", 0, ""), (c, 1, "user", "b", 0, "")])
    assert T.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_in_runs(spark, monkeypatch):
    monkeypatch.setattr(T, "SPAN", 4)
    check(spark, [(5 * c, t, "user", "same", 0, "") for c in range(30) for t in range(2)])
