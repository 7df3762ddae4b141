"""Toxicity: Levenshtein automata intersected with a lexicon trie, hits weighed by the words around them.

The lexicon (whole terms and stems) is learned from labelled rows. Its trie and the Levenshtein automata of
its terms form one nondeterministic automaton whose states are (trie node, edits); it is made deterministic
as words need it. A word is a hit if it is a term, or starts with a stem, within one edit (terms of at least
FUZZY_LETTERS letters; shorter ones must match exactly). Words around a hit tell quotation from abuse: quote
marks around it, an opening and a closing one with none between, and reporting words lower what the hit counts for, by fixed factors
to begin with; a logistic regression turns the sums of the hits, of marked ones and of reporting words into a score, and so learns what
quotation and reporting say in the labelled rows.

Learning reads at most TRAIN_ROWS labelled rows (a documented bound; picked by hash); scoring reads whole
texts. The lexicon has every term that tells the label in these rows; none is cut by number. Cases: null and empty texts
score like a text without hits; repeated labels of a doc_id count once, the worst one, and so do repeated documents of a
labelled doc_id, the one with the least text; labels without a document and null labels are left out; without both classes in the labels
every score is 0; equal texts get equal scores; an empty table gives an empty result. Only doc_id and text of
the documents and doc_id and toxic of the labels are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import remainder, returned, staged

TRAIN_ROWS = 20_000
LEAST_ROWS, LEAST_SHARE = 4, 0.75
#: Likelihood-ratio statistic that a term must reach: chance terms of a million words stay below.
LEAST_G2 = 24.0
#: Share of clean rows that a term may meet by an edit; above it the term must match exactly.
MOST_EDITED = 0.001
#: What a hit with an edit counts for.
EDITED = 0.8
STEM_LETTERS = (4, 5, 6, 7)
FUZZY_LETTERS = 5
WINDOW, FEATURES = 6, 6
MOST_CACHED = 100_000
MOST_STATES = 50_000
# Words that report what others said, and quotation marks.
REPORTING = frozenset("said says called calls wrote writes word words term quote quoted quotes insult slur dijo dice llamó palabra dit appelé mot sagte sagt nannte wort".split())
MARKS = "\"“”«»„‘’"
PART = re.compile(r"[^\W_]+")


def marks(token: str) -> str:
    """The quotation marks of a token in order: ( opens, ) closes, and | is a straight mark by itself, which does either."""
    y = token.rstrip(".,;:!?")
    if len(y) == 1:
        return "(" if y in "“«„‘" else ")" if y in "”»’" else "|" if y == '"' else ""
    return "(" * (token[0] in MARKS) + ")" * (y[-1:] in set(MARKS))


def quoted(tokens: list[str], i: int) -> bool:
    """Whether token i stands between an opening and a closing mark, both within WINDOW tokens, with no other mark between them."""
    own = marks(tokens[i])
    before = "".join(map(marks, tokens[max(0, i - WINDOW) : i])) + own[:1].replace(")", "")
    after = own[-1:].replace("(", "") + "".join(map(marks, tokens[i + 1 : i + WINDOW + 1]))
    return before[-1:] in ("(", "|") and after[:1] in (")", "|")


class Automaton:
    """Terms and stems within their number of edits, determinised lazily. A hit is (edits, term's number)."""

    def __init__(self, terms: list[tuple[str, bool, bool]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]  # the number of the term that ends at a node
        self.stem = [t[1] for t in terms]
        self.fuzzy: list[bool] = [False]  # below the node lies a term that allows an edit
        self.long: list[bool] = [False]  # the term that ends here allows an edit
        for number, (term, _, edits) in enumerate(terms):
            node, path = 0, [0]
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.fuzzy.append(False)
                    self.long.append(False)
                node = self.next[node][c]
                path.append(node)
            self.ends[node] = number
            if edits:
                self.long[node] = True
                for x in path:
                    self.fuzzy[x] = True
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set) -> int:
        items = set(items)
        for node, e in list(items):  # a term's letter left out
            if e == 0:
                items |= {(x, 1) for x in self.next[node].values() if self.fuzzy[x]}
        key = frozenset((n, e) for n, e in items if e == 0 or self.fuzzy[n])
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if (x := self.next[node].get(c)) is not None:
                out.add((x, e))
            if e == 0 and self.fuzzy[node]:
                out.add((node, 1))
                out |= {(x, 1) for x in self.next[node].values() if self.fuzzy[x]}
        return self._state(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """The hit with the fewest edits."""
        state, best, n = self.start, None, len(word)
        for i, c in enumerate(word):
            if (s := self.moves[state].get(c)) is None:
                if len(self.sets) > MOST_STATES:  # bounded memory: begin anew
                    self.__dict__.update(states={}, sets=[], moves=[])
                    self.start = self._state({(0, 0)})
                    return self.match(word)
                s = self.moves[state][c] = self._step(state, c)
            state = s
            if not self.sets[state]:
                break
            for node, e in self.sets[state]:
                end = self.ends[node]
                if end is not None and (e == 0 or self.long[node]) and (i == n - 1 or self.stem[end]):
                    best = (e, end) if best is None else min(best, (e, end))
        return best


@dataclass
class Model:
    terms: list[tuple[str, bool, bool]]  # letters, whether a stem, whether an edit is allowed
    weights: np.ndarray
    cache: dict = field(default_factory=dict)
    automaton: Automaton | None = None

    def kind(self, token: str) -> tuple[int, int] | None:
        """The best hit among the letter runs of a white-space token."""
        if token not in self.cache:
            if self.automaton is None:
                self.automaton = Automaton(self.terms)
            if len(self.cache) >= MOST_CACHED:
                self.cache.clear()
            kinds = [k for part in PART.findall(token) if (k := self.automaton.match(part)) is not None]
            self.cache[token] = min(kinds, default=None)
        return self.cache[token]

    def features(self, text: str | None) -> list[float]:
        """Terms and stems: whether any is there, and the weight of the hits as abuse; then the hits between marks, and the weight of the reporting words around hits."""
        tokens = (text or "").lower().split()
        hit = {t: k for t in set(tokens) if (k := self.kind(t)) is not None}
        sums = [0.0] * 4
        if hit:
            for i, t in enumerate(tokens):
                if (k := hit.get(t)) is not None:
                    around = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + WINDOW + 1]
                    marked = quoted(tokens, i)
                    cues = min(3, sum(x.strip(".,;:!?" + MARKS) in REPORTING for x in around))
                    abuse = (0.3 if marked else 1.0) * 0.6**cues
                    sums[self.terms[k[1]][1]] += abuse * (EDITED if k[0] else 1)
                    sums[2] += marked
                    sums[3] += 1 - 0.6**cues
        return [min(1.0, sums[0]), float(np.log1p(sums[0])), min(1.0, sums[1]), float(np.log1p(sums[1])), float(np.log1p(sums[2])), float(np.log1p(sums[3]))]

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "cache": {}, "automaton": None}


def _counted(batches):
    """Rows with and without the label for each word and stem."""
    import pandas as pd

    pos, neg = Counter(), Counter()
    for b in returned(batches):
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            words = {w for w in PART.findall((text or "").lower()) if len(w) > 2 and not w.isdigit()}
            stems = {w[:k] + "*" for w in words for k in STEM_LETTERS if len(w) > k}
            (pos if toxic else neg).update(words | stems)
    yield pd.DataFrame([(t, pos[t], neg[t]) for t in pos], columns=["term", "pos", "neg"])
    # A term seen only without the label in this task still counts against it elsewhere.
    rest = [(t, 0, n) for t, n in neg.items() if t not in pos]
    for i in range(0, len(rest), 100_000):
        yield pd.DataFrame(rest[i : i + 100_000], columns=["term", "pos", "neg"])


def telling(counts: DataFrame, n_pos: int, n_neg: int) -> DataFrame:
    """The terms (term, pos, neg) that tell the label."""
    p, n, rate = F.col("pos"), F.col("neg"), n_pos / (n_pos + n_neg)
    share = (p / n_pos) / (p / n_pos + (n + 0.5) / n_neg)
    g2 = 2 * sum((F.when(x > 0, x * F.log(x / (e * (p + n)))).otherwise(0.0) for x, e in ((p, rate), (n, 1 - rate))), F.lit(0.0))
    return counts.filter((p >= LEAST_ROWS) & (share >= 0.97) & (p / (p + n) >= LEAST_SHARE) & (g2 >= LEAST_G2))


def choose(good: dict[str, int]) -> list[tuple[str, bool]]:
    """Of the telling terms and their rows with the label: no stem that one longer form explains, no term that a chosen stem covers."""
    longer: dict[str, int] = {}
    for t, p in good.items():
        word = t.rstrip("*")
        for k in STEM_LETTERS:
            if len(word) > k:
                longer[word[:k] + "*"] = max(longer.get(word[:k] + "*", 0), p)
    chosen: list[tuple[str, bool]] = []
    stems: set[str] = set()
    for t, p in sorted(good.items(), key=lambda x: (-x[1], len(x[0]), x[0])):
        word, stem = t.rstrip("*"), t.endswith("*")
        if any(word[:k] in stems for k in STEM_LETTERS) or stem and longer.get(t, 0) >= 0.9 * p:
            continue
        chosen.append((word, stem))
        if stem:
            stems.add(word)
    return chosen


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """labels: the rows to learn from."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    picked = staged(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "toxic-labels")  # at most `rows` rows, so it may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # a doc_id counts once
    sample = staged(sample.select("text", "toxic"), "toxic-sample")
    sizes = dict(sample.groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return Model([], np.array([0.0] * FEATURES + [-99.0]))
    counts = sample.mapInPandas(_counted, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    terms = choose({r["term"]: r["pos"] for r in telling(counts, sizes[1], sizes[0]).collect()})  # of `rows` rows: each term is in LEAST_ROWS of them
    wide = docs.sparkSession.sparkContext.broadcast(Model([(t, s, len(t) >= FUZZY_LETTERS) for t, s in terms], np.zeros(FEATURES + 1)))

    def edited(batches):
        """Rows with and without the label in which a term is met by an edit."""
        import pandas as pd

        met = Counter()
        for b in returned(batches):
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                met.update({(k[1], toxic) for t in set((text or "").lower().split()) if (k := wide.value.kind(t)) and k[0]})
        yield pd.DataFrame([(t, n if y else 0, 0 if y else n) for (t, y), n in met.items()], columns=["term", "pos", "neg"])

    met = {r["term"]: r for r in sample.mapInPandas(edited, "term int, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}
    clean = lambda i: i not in met or met[i]["neg"] <= max(MOST_EDITED * sizes[0], met[i]["pos"] / 4)
    model = Model([(t, s, len(t) >= FUZZY_LETTERS and clean(i)) for i, (t, s) in enumerate(terms)], np.zeros(FEATURES + 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def featured(batches):
        import pandas as pd

        for b in returned(batches):
            x = np.array([shared.value.features(t) for t in b["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame(x, columns=list("abcdef")).assign(y=b["toxic"].to_numpy())

    got = sample.mapInPandas(featured, "a double, b double, c double, d double, e double, f double, y int").toPandas()  # `rows` rows of seven numbers at most
    model.weights = fit(got[list("abcdef")].to_numpy(), got["y"].to_numpy())
    return model


def _released(batches, model: Model):
    """The batches; what the model has remembered goes with the last."""
    try:
        yield from returned(batches)
    finally:
        model.cache, model.automaton = {}, None


def score(docs: DataFrame, model: Model, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns to keep, then score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in _released(batches, m):
            texts = b.column("_tox_text").to_pylist()
            x = np.array([m.features(t) for t in texts]).reshape(-1, FEATURES) if m.terms else np.zeros((len(texts), FEATURES))
            z = x @ m.weights[:-1] + m.weights[-1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], [*keep, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*keep, F.col("text").alias("_tox_text")).mapInArrow(run, f"{schema}, score double")


def op2(spark, sf_dir):
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
