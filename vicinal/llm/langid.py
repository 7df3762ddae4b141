"""Language identification with error-correcting output codes.

Every language has a codeword of bits. A binary n-gram classifier per bit (smoothed log odds of hashed byte
4-grams between the languages with the bit set and those without, languages weighing alike) gives a margin;
the decoder adds, over bits, reliability * log(1 + exp(-codeword * margin)) and takes the nearest codeword.
A small gap to the second nearest flags the text as ambiguous.

Learning reads at most TRAIN_ROWS_PER_LANG rows of a language (a documented bound; rows picked by hash).
Prediction reads whole texts. Cases: null texts and texts without a letter are `und` with score 0; a text too
short for a 4-gram is padded with spaces; rows with null lang are never learned from; with a single learned
language it is the answer for every lettered text; with none every row is `und`; equal texts get equal
answers; an empty table gives an empty result. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import remainder, returned, staged, text_bytes

TRAIN_ROWS_PER_LANG = 4000
#: A classifier of more languages is refused (an error, none is dropped).
MOST_LANGS = 1000
LOG_DIMS = 15
#: A text is ambiguous if its best probability is below this.
AMBIGUOUS = 0.6
#: Bytes worked on at once inside a task.
CHUNK = 1 << 18


def _fold() -> np.ndarray:
    """Bytes to lower case, everything of ASCII but letters to a space."""
    t = np.arange(256)
    t[:128] = 32
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t.astype(np.uint32)


FOLD = _fold()


def grams(data: np.ndarray) -> np.ndarray:
    """The hashed 4-gram that ends at each byte; bytes before the start count as spaces."""
    x = np.concatenate([np.full(3, 32, np.uint32), FOLD[data]])
    h = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - LOG_DIMS)).astype(np.int32)


def row_grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The same for rows that begin at the offsets: each row is on its own, with spaces before it."""
    n = len(at) - 1
    place = np.arange(len(data)) + 3 * np.repeat(np.arange(1, n + 1), np.diff(at))
    x = np.full(len(data) + 3 * n, 32, np.uint8)
    x[place] = data
    return grams(x)[place]


def codewords(k: int) -> np.ndarray:
    """k rows of +1/-1: all distinct splits for up to 5 languages, else the random code with the widest rows of 50."""
    if k <= 5:
        rows = np.array([[1 if (b >> j) & 1 else -1 for b in range(1, 2 ** (k - 1))] for j in range(k)], int)
        return rows.reshape(k, -1)
    rng, best = np.random.default_rng(6), None
    for _ in range(50):
        c = rng.choice([-1, 1], (k, 10 * int(np.ceil(np.log2(k)))))
        c = c[:, np.abs(c.sum(0)) < k]
        apart = ((c[:, None] != c[None]).sum(2) + np.eye(k) * 10**6).min()
        if best is None or apart > best[0]:
            best = (apart, c)
    return best[1]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # dims x bits
    trust: np.ndarray  # bits

    def margins(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """rows x bits: the sum of log odds by the root of the length."""
        out = np.zeros((len(at) - 1, self.weights.shape[1]))
        if not out.size:
            return out
        first = 0
        while first < len(at) - 1:  # as many rows as a chunk holds, or a longer row in chunks that overlap
            last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
            if last > first + 1:
                rows = first + np.flatnonzero(np.diff(at[first : last + 1]))
                if len(rows):
                    w = self.weights[row_grams(data[at[first] : at[last]], at[first : last + 1] - at[first])]
                    out[rows] = np.add.reduceat(w, at[rows] - at[first], axis=0, dtype=np.float64)
            else:
                for lo in range(at[first], at[last], CHUNK):
                    lead = min(3, lo - at[first])
                    w = self.weights[grams(data[lo - lead : min(at[last], lo + CHUNK)])[lead:]]
                    out[first] += np.add.reduceat(w, [0], axis=0, dtype=np.float64)[0]
            first = last
        return out / np.sqrt(np.diff(at) + 1.0)[:, None]

    def decode(self, margins: np.ndarray) -> np.ndarray:
        """rows x languages: probabilities from the losses of the codewords."""
        loss = np.stack([(self.trust * np.logaddexp(0, -c * margins)).sum(1) for c in self.code], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        return p / p.sum(1, keepdims=True)


def train(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS_PER_LANG) -> Model:
    """From rows with text and lang; counts are summed in Spark, a vector for each language reaches the driver."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()
    if len(share) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of lang: these are no languages")
    if not share:
        return Model([], np.zeros((0, 0)), np.zeros((1 << LOG_DIMS, 0)), np.zeros(0))
    langs = sorted(r["lang"] for r in share)
    odds = F.create_map(*[F.lit(x) for r in share for x in (r["lang"], float(min(1.0, rows_per_lang / r["n"])))])
    pick = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < odds[F.col("lang")] * (1 << 20)
    sample = staged(docs.filter(pick).select("lang", "text"), "langid-sample")

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for b in returned(batches):
            data, at = text_bytes(b.column("text"))
            for i, lang in enumerate(b.column("lang").to_pylist()):
                c = np.bincount(grams(data[at[i] : at[i + 1]]), minlength=1 << LOG_DIMS)
                sums[lang] = sums.get(lang, 0) + np.rint(4096 * np.sqrt(c)).astype(np.int64)  # the root keeps one long row from ruling; whole numbers add up alike in any order
        for lang, v in sums.items():
            seen = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(v[seen])], ["lang", "gram", "n"])

    def dense(table):
        import pyarrow as pa

        v = np.zeros(1 << LOG_DIMS)
        v[table.column("gram").to_numpy()] = table.column("n").to_numpy() / 4096
        return pa.table({"lang": table.column("lang").slice(0, 1), "sums": pa.array([v.tobytes()], pa.binary())})

    sums = np.zeros((len(langs), 1 << LOG_DIMS))
    found = sample.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    for r in found.groupBy("lang").applyInArrow(dense, "lang string, sums binary").collect():  # a row of 256 KB for each language
        sums[langs.index(r["lang"])] = np.frombuffer(r["sums"])
    p = (sums + 0.5) / (sums + 0.5).sum(1, keepdims=True)
    code = codewords(len(langs))
    weights = np.stack([np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)) for b in range(code.shape[1])] or [np.zeros(0)], 1) if code.size else np.zeros((1 << LOG_DIMS, 0))
    model = Model(langs, code, weights.astype(np.float32), np.ones(code.shape[1]))
    if code.size:

        def right(batches):
            import pyarrow as pa

            for b in returned(batches):
                m = model.margins(*text_bytes(b.column("text")))
                want = model.code[[model.langs.index(x) for x in b.column("lang").to_pylist()]].reshape(m.shape)
                yield pa.RecordBatch.from_arrays([pa.array([((m * want) > 0).sum(0).tolist()], pa.list_(pa.int64())), pa.array([len(m)], pa.int64())], ["good", "n"])

        found = sample.mapInArrow(right, "good array<long>, n long").select("n", *(F.col("good")[b].alias(f"g{b}") for b in range(code.shape[1]))).groupBy().sum().first()
        acc = np.clip((np.array(found[1:], float) + 1) / (found[0] + 2), 0.51, 0.999)
        model.trust = np.log(acc / (1 - acc)) / np.log(999)
    return model


def predict(docs: DataFrame, model: Model, keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns to keep, then lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in returned(batches):
            seen, n = np.array(b.column("lettered").to_pylist(), bool), b.num_rows
            if not m.langs:
                best, score = np.zeros(n, int), np.zeros(n)
            elif len(m.langs) == 1:
                best, score = np.zeros(n, int), np.ones(n)
            else:
                p = m.decode(m.margins(*text_bytes(b.column("text"))))
                best, score = p.argmax(1), p.max(1)
            seen &= bool(m.langs)
            names = np.array([*m.langs, "und"], object)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f"_{c}") for c in keep), pa.array(names[np.where(seen, best, -1)].tolist(), pa.string()), pa.array(np.where(seen, score, 0.0)), pa.array(seen & (score < AMBIGUOUS))],
                [*keep, "lang_pred", "score", "ambiguous"],
            )

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select("text", lettered.alias("lettered"), *(F.col(c).alias(f"_{c}") for c in keep)).mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def op6(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.filter(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
