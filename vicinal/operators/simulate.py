"""Simulation: uniformised jump processes on circular sequences; sequential in a sequence, parallel over replicates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

OUT = "rep_id long, initseq string, finalseq string, n_events long, events array<struct<i:string,j:string,loc:int>>"


def evolve(seq: list[str], mutpats: list, rates: list[float], tlen: float, rng) -> list[tuple[str, str, int]]:
    """Changes seq in place; returns the events. A site is chosen at the top rate, then a rule by its rate or nothing."""
    longest = max(len(a) for g in mutpats for a, _ in g)
    rules: dict[str, list] = {}
    for g, r in zip(mutpats, rates, strict=True):
        for a, b in g:
            rules.setdefault(a, []).append((b, r))
    sizes = sorted({len(a) for a in rules})
    top = sum(max(sum(r for _, r in v) for a, v in rules.items() if len(a) == k) for k in sizes)
    n, log = len(seq), []
    if n < longest or top == 0:
        return log
    for at in rng.integers(0, n, rng.poisson(top * tlen * n)):
        u = rng.random() * top
        for k in sizes:
            word = "".join(seq[(at + d) % n] for d in range(k))
            for to, r in rules.get(word, ()):
                u -= r
                if u < 0:
                    break
            if u < 0:
                for d, c in enumerate(to):
                    seq[(at + d) % n] = c
                log.append((word, to, int(at) + 1))
                break
    return log


def simulate(starts: DataFrame, mutpats: list, rates: list[float], tlen: float, seed: int = 1, log: bool = True) -> DataFrame:
    """starts (rep_id, initseq): final sequences and events. A replicate's stream depends on seed and rep_id only."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for rep, s in zip(b["rep_id"], b["initseq"], strict=True):
                seq = list(s or "")
                ev = evolve(seq, mutpats, rates, tlen, np.random.default_rng([seed, int(rep)]))
                rows.append((rep, s, "".join(seq), len(ev), [dict(zip("ij", e[:2], strict=True), loc=e[2]) for e in ev] if log else []))
            yield pd.DataFrame(rows, columns=["rep_id", "initseq", "finalseq", "n_events", "events"])

    return starts.select("rep_id", "initseq").mapInPandas(run, OUT)


def random_sequences(spark, n: int, length: int, freqs: dict[str, float], seed: int = 1) -> DataFrame:
    def run(batches):
        for b in batches:
            yield b.assign(initseq=["".join(np.random.default_rng([seed, int(i)]).choice(list(freqs), length, p=list(freqs.values()))) for i in b["rep_id"]])

    return spark.range(n).withColumnRenamed("id", "rep_id").mapInPandas(run, "rep_id long, initseq string")


def simulate_tree(starts: DataFrame, edges: list, rules: dict[str, tuple[list, list[float]]], seed: int = 1) -> DataFrame:
    """rep_id, taxon, seq for every node: the root's sequences change along each edge; rules: child -> (mutpats, rates)."""
    from pyspark.sql import functions as F

    root = next(iter({p for p, _, _ in edges} - {c for _, c, _ in edges}))
    at = {root: starts.select("rep_id", F.col("initseq").alias("seq"))}
    for k, (p, c, t) in enumerate(edges):
        at[c] = simulate(at[p].withColumnRenamed("seq", "initseq"), *rules[c], t, seed + 1000 * (k + 1), False).select("rep_id", F.col("finalseq").alias("seq"))
    out = None
    for name, d in at.items():
        d = d.withColumn("taxon", F.lit(name))
        out = d if out is None else out.union(d)
    return out


def shown(initseq: str, finalseq: str, events: list) -> str:
    """Dots for untouched sites, lower case for sites that changed back."""
    touched = {(e["loc"] - 1 + d) % len(initseq) for e in events for d, (x, y) in enumerate(zip(e["i"], e["j"], strict=True)) if x != y}
    return "".join("." if i not in touched else (b.lower() if a == b else b) for i, (a, b) in enumerate(zip(initseq, finalseq, strict=True)))
