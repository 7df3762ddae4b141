"""Enumerations of patterns and rewriting rules."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Enumerations above this many patterns are refused.
MOST_PATTERNS = 1 << 22


def n_patterns(length: int, bases: str) -> int:
    return len(bases) ** length


def patterns(spark: SparkSession, length: int, bases: str) -> DataFrame:
    """pattern_idx, pattern: all patterns, first symbol fastest. Made on the executors from a range."""
    n = n_patterns(length, bases)
    if n > MOST_PATTERNS:
        raise ValueError(f"{n} patterns of length {length}: use the patterns that occur instead")
    digits = [F.substring(F.lit(bases), (F.floor(F.col("id") / len(bases) ** k) % len(bases) + 1).cast("int"), F.lit(1)) for k in range(length)]
    return spark.range(n).select(F.col("id").alias("pattern_idx"), F.concat(*digits).alias("pattern"))


def pattern_list(length: int, bases: str) -> list[str]:
    return ["".join(p[::-1]) for p in itertools.product(bases, repeat=length)]


def rules(spark: SparkSession, mutpats: list) -> DataFrame:
    """rate_id, rule_id, from, to: one row for each rewriting rule; rules of a rate share rate_id."""
    rows = [(r, k, a, b) for r, group in enumerate(mutpats) for k, (a, b) in enumerate(group)]
    return spark.createDataFrame(rows, "rate_id int, rule_id int, `from` string, `to` string")


def all_rules(bases: str, most: int, n_changes: tuple = (1,)) -> list:
    """All changes of patterns of up to `most` symbols that change an allowed number of them, a rate each."""
    out = []
    for k in range(1, most + 1):
        for a, b in itertools.permutations(pattern_list(k, bases), 2):
            if sum(x != y for x, y in zip(a, b, strict=True)) in n_changes:
                out.append([(a, b)])
    return out


def pattern_changes(mutpats: list) -> list:
    """The single-symbol changes (from, to) of each rule group."""
    return [sorted({(x, y) for a, b in group for x, y in zip(a, b, strict=True) if x != y}) for group in mutpats]


def rule_names(mutpats: list, names: list | None = None) -> list[str]:
    auto = ["|".join(f"{a}->{b}" for a, b in group) for group in mutpats]
    return [n or x for n, x in zip(names or [""] * len(auto), auto, strict=True)]


def selection_names(selpats: list, names: list | None = None) -> list[str]:
    auto = ["|".join(group) for group in selpats]
    return [n or x for n, x in zip(names or [""] * len(auto), auto, strict=True)]


def reverse_complement_rules(mutpats: list) -> list[int | None]:
    """For each rule group the number of the group that holds its reverse complements; None without one, an error with several."""
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    out = []
    for group in mutpats:
        want = {(rc(a), rc(b)) for a, b in group}
        found = [i for i, g in enumerate(mutpats) if want <= set(map(tuple, g))]
        if len(found) > 1:
            raise ValueError("several groups hold the reverse complement of one")
        out.append(found[0] if found else None)
    return out
