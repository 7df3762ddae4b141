"""Language ID, toxicity, the n-gram join and the language model on small tables, against brute force."""

import binascii
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vicinal.llm import langid, lm, ngram_join, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc(i, m):
    return binascii.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = {"en": "the and of thing over water stone".split(), "de": "der und schrift über wasser stein nicht".split(), "fr": "le et çelle eau pierre être sur".split()}
    rows = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        t = [r.choice(words[lang]) + r.choice(words[lang]) for _ in range(r.randint(5, 40))]
        if i % 8 == 0:
            t[2] = r.choice(["idiot", "Moronic,", "scumbag"])
        rows.append((i, " ".join(t), lang, "s", "x"))
    return [*rows, (900, None, "en", "s", "x"), (901, "", "en", "s", "x"), (902, "123 !!", None, "s", "x"), (903, rows[0][1], "en", None, None), (None, "the and", "en", "s", "x")]


def test_language_id(spark, texts):
    docs = spark.createDataFrame(texts, SCHEMA)
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _, _ in texts[:240]) >= 236
    assert got[903]["lang_pred"] == got[0]["lang_pred"] and got[903]["score"] == got[0]["score"]
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0))).count() == 0
    one = docs.filter("lang = 'en'")
    assert {r["lang_pred"] for r in langid.predict(one, langid.train(one)).collect()} == {"en", "und"}


def test_codewords_apart():
    for k in (2, 3, 5, 12):
        c = langid.codewords(k)
        assert len({tuple(r) for r in c}) == k


def test_toxicity(spark, texts):
    docs = spark.createDataFrame(texts, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 8 == 0), None) for i in range(240)] + [(5000, 1, None), (3, None, None), (None, 1, None)], "doc_id long, toxic int, text string")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) == (i % 8 == 0) for i in range(240)) >= 234
    assert got[900] == got[901] < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.filter("toxic = 0"))
    assert {r["score"] < 0.5 for r in toxicity.score(docs, none).collect()} == {True}


def test_automaton_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(4)
    terms = ["abcab", "bacca", "cabba", "abc"]
    a = toxicity.Automaton([(t, False, len(t) >= 5) for t in terms])
    for _ in range(4000):
        w = "".join(r.choices("abc", k=r.randint(1, 7)))
        best = min((d for t in terms if (d := distance(w, t)) <= (1 if len(t) >= 5 else 0)), default=None)
        hit = a.match(w)
        assert (hit[0] if hit else None) == best, w


def test_quotation_counts_less():
    m = toxicity.Model([("idiot", False, True)], None)
    plain, quoted = m.features("you are an idiot today"), m.features('he wrote "idiot" in the report')
    assert plain[0] > quoted[0] > 0 and quoted[4] > plain[4]
    between = m.features('"hello" you idiot, go "away"')
    assert between[4] == 0 and between[0] == 1  # marks of two other quotations
    for text in ('he wrote "you are an idiot today" here', "« idiot »", "“idiot and more”", '" idiot "', '"an idiot", she thought'):
        assert m.features(text)[4] > 0, text
    for text in ("idiot »", "« a » idiot « b »", 'an idiot" here'):
        assert m.features(text)[4] == 0, text


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0] if rows[i][0] is not None else -1, len(sets[i]), least.get(find(i), -1)) for i in range(len(rows)))


def near_copies(seed, frequent):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = r.choices(vocab, k=50)
    rows, n = [], 0
    for base in range(12):
        words = r.choices(vocab, k=r.choice([6, 30, 80, 200]))
        if base % 3 == 0:
            words += passage
        for _ in range(frequent if base < 3 else 3):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6, 9])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, t) for i, t in enumerate([None, "", "  \n", "one two", "ONE two", "one two three four five", "\x1cone two", " ".join(passage), " ".join(passage).upper(), "x " * 30_000])]
    return [*rows, (0, rows[0][1]), (n + 99, rows[3][1])]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 3), (2, 40)])
def test_ngram_join(spark, seed, frequent):
    rows = near_copies(seed, frequent)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    got = ngram_join.join(docs).toPandas()
    assert sorted(map(tuple, got.fillna(-1).astype(int).to_numpy().tolist())) == brute(rows)
    kept = ngram_join.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for i, _, c in brute(rows) if i >= 0})


def test_deduplicated_by_row(spark):
    """Null and repeated doc_ids: one row of each component stays, and every row that has no copy."""
    text = lambda i: " ".join(f"t{i}w{j}" for j in range(30))
    rows = [(None, text(0)), (None, text(0)), (None, text(1)), (3, text(1)), (4, text(2)), (4, text(3)), (4, text(3)), (6, text(3)), (7, None), (7, None), (None, "")]
    kept = ngram_join.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(None, text(0)), (3, text(1)), (4, text(2)), (4, text(3)), (7, None), (7, None), (None, "")]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want))


def test_ngram_join_empty(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_meet():
    """Any two sets that link share a signature, whatever the frequent class is."""
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(4, 120))
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        b = a.copy()
        lose = int(rng.integers(0, n // 5 + 1))
        b = np.sort(np.r_[rng.permutation(a)[: len(a) - lose], rng.integers(0, 2**63, int(rng.integers(0, 3)), np.uint64)])
        same = len(np.intersect1d(a, b))
        common = np.unique(rng.permutation(a)[: int(rng.integers(0, len(a) + 1))] >> ngram_join.DROP)
        if len(b) >= 4 and 100 * same >= 80 * (len(a) + len(b) - same) and not np.array_equal(a, b):
            frequent = lambda x: ngram_join._common(x, common)
            assert len(np.intersect1d(ngram_join.signatures(a, frequent), ngram_join.signatures(b, frequent)))
            repeated = lambda x: ngram_join._common(x, np.intersect1d(a, b) >> ngram_join.DROP)
            assert len(np.intersect1d(ngram_join.signatures(a, frequent, repeated), ngram_join.signatures(b, frequent, repeated)))


def test_signatures_of_the_next_class_are_few():
    """Partners of the next size class are larger, so a set signs for it by fewer tokens; sets at the very bounds of a class and of the similarity still meet."""
    import numpy as np

    rng = np.random.default_rng(3)
    nothing = lambda x: np.zeros(len(x), bool)
    low = lambda n: np.unique(rng.integers(0, int(2**64 * 0.3), n, np.uint64))
    for n in (100, 500, 2000):
        tokens = low(n)
        assert len(ngram_join.signatures(tokens, nothing)) <= n // 5 + n // 9 + 2  # before: 2 (n // 5 + 1)
    for n in range(4, 150):
        a = low(n)
        for m in range(n, n * 5 // 4 + 1):  # larger partners, with as few common tokens as a link allows
            same = -(-4 * (n + m) // 9)
            if same <= n:
                b = np.sort(np.r_[a[n - same :], low(m - same)])
                assert len(np.intersect1d(ngram_join.signatures(a, nothing), ngram_join.signatures(b, nothing))), (n, m)


def test_ngram_join_meets_outside_a_centre(spark):
    """Two texts that link only with each other, by tokens that their star's centre has not; rows of one component at a centre lead to nothing."""
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long, n long, c long, r long, extra binary")
    blob = lambda *x: b"".join(v.to_bytes(8, "little") for v in x)
    d = frame([(1, 9, 45, 39, 1, blob(70, 71, 72)), (2, 9, 45, 39, 2, blob(71, 73)), (3, 8, 45, 39, 3, blob(71)), (4, 8, 45, 39, 3, blob(71)), (5, 9, 45, 30, 5, blob(71))])
    got = {tuple(r) for r in ngram_join.outside_prefixes(d, 80).select("a", "z", "r", "token", "rest").collect()}
    assert got == {(1, 9, 1, 71, 0), (2, 9, 2, 71, 0)}
    kept = ngram_join._apart(d)
    assert kept.columns == d.columns and {r["a"] for r in kept.collect()} == {1, 2, 5}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + [0]


def model_by_brute_force(rows):
    """base_score and score of each (doc_id, text), in plain loops."""
    docs = [(i, words_of(t)) for i, t in rows]
    one, two, three = Counter(), Counter(), Counter()
    for i, ws in docs:
        if i is None or crc(i, 5) != 1:
            h = [0, *ws]
            one.update(ws)
            two.update(zip(h, ws, strict=False))
            three.update(zip(h, ws, ws[1:], strict=False))
    n, v = sum(one.values()), len(one)

    def parts(ws, k, out):
        before = ws[k - 1] if k else 0
        h1 = one[before] - out
        h2 = (two[ws[k - 2] if k > 1 else 0, before] if k else one[0]) - out
        c2 = two[before, ws[k]] - out
        c3 = (three[ws[k - 2] if k > 1 else 0, before, ws[k]] - out) if k else c2
        power = lambda h: int(math.floor(math.log2(h))) + 1 if h > 0 else 0
        bucket = lm.powers(n) + power(h2) if h2 > 0 else power(h1)
        return bucket, (c3 / h2 if h2 > 0 else 0, c2 / h1 if h1 > 0 else 0, (one[ws[k]] - out) / (n - out) if n > out else 0)

    cells = Counter(parts(ws, k, 1) for i, ws in docs if i is None or crc(i, 5) != 1 for k in range(len(ws)))

    def step(w):
        new = np.zeros((len(w), 5))
        for (b, p), c in cells.items():
            each = [x * y for x, y in zip(w[b], [*p, 1 / (v + 1)], strict=True)]
            for j in range(4):
                new[b, j] += c * each[j] / sum(each)
            new[b, 4] += c * math.log(sum(each))
        return new

    mix = lm.climbed(step, lm.begun(n), n)
    out = []
    for _, ws in docs:
        total = 0.0
        for k in range(len(ws)):
            bucket, p = parts(ws, k, 0)
            w = mix[bucket]
            total += math.log10(sum(x * y for x, y in zip(w, [*p, 1 / (v + 1)], strict=True)))
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out.append((len(ws), sum(one[w] > 0 for w in ws), n, base, total))
    return out


@pytest.mark.parametrize("block", [1 << 22, 1000])
def test_language_model(spark, texts, monkeypatch, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm, "PART_BYTES", 4 * block)
    rows = [*((i, t) for i, t, *_ in texts), (1001, "Over the stone " * 3000), (1002, "over THE stone " * 3000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3, "doc_id")
    got = sorted(map(tuple, lm.score(docs).collect()), key=str)
    want = sorted([(i, i is not None and crc(i, 5) == 1, *x) for (i, _), x in zip(rows, model_by_brute_force(rows), strict=True)], key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6), g[0]
    assert lm.score(docs.limit(0)).count() == 0


def test_weights_climb_to_the_maximum(monkeypatch):
    """The extrapolated rounds end where very many plain ones do, also for estimates far below 2 ** -24."""
    monkeypatch.setattr(lm, "ROUNDS", 60)
    rng = np.random.default_rng(2)
    n, bucket = 1 << 30, rng.integers(0, 2 * lm.powers(1 << 30), 4000)
    p = 2.0 ** -rng.uniform(0, 34, (4000, 3)) * (rng.random((4000, 3)) < 0.6)
    step = lambda w: lm.shares(bucket, p, 50_000, w)
    plain = lm.begun(n)
    for _ in range(3000):
        s = step(plain)[:, :4] + [0, 0, 0, 1e-3]
        plain = s / s.sum(1, keepdims=True)
    ours = lm.climbed(step, lm.begun(n), 400)
    assert step(ours)[:, 4].sum() > step(plain)[:, 4].sum() - 0.5 and step(plain)[:, 4].sum() - step(lm.begun(n))[:, 4].sum() > 50
    assert np.abs(ours.sum(1) - 1).max() < 1e-12 and (ours[:, 3] > 0).all()


def test_other_splits_between_the_reads(spark, tmp_path):
    """How many tasks run at once does not matter while the texts are read."""
    from vicinal.staging import fixed_splits

    spark.range(4000).selectExpr("id AS doc_id", "concat('word', id, ' and ', id % 7, ' more') AS text").repartition(12).write.parquet(str(tmp_path / "d"))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    with fixed_splits(spark):
        assert int(spark.conf.get("spark.sql.files.minPartitionNum")) == spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) == before
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert lm.score(spark.read.parquet(str(tmp_path / "d"))).count() == 4000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if crc(i, 5) == 1)
    got = lm.score(spark.createDataFrame([(held, "a b c"), (held, None)], "doc_id long, text string")).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 0, 0), (4, 0, 0)]
    assert all(abs(r["score"]) < 1e-12 for r in got)


def test_model_is_a_distribution():
    """Over all words and the unknown, the probabilities after a history add up to one, whatever is known of the history."""
    import numpy as np

    corpus = [words_of("a b a c a b d"), words_of("b a b a"), words_of("")]
    one = Counter(w for ws in corpus for w in ws)
    two = Counter(p for ws in corpus for p in zip([0, *ws], ws, strict=False))
    three = Counter(p for ws in corpus for p in zip([0, *ws], ws, ws[1:], strict=False))
    n, v = sum(one.values()), len(one)
    mixed = lm.begun(n)
    for history in ([], ["a"], ["a", "b"], ["c", "d"], ["d", "x"], ["x", "y"], ["x", "a"]):
        total = 0.0
        for w in [*one, "unknown"]:
            ws = [*history, w]
            h = [0, *ws]
            ones, twos = np.array([one[x] for x in ws]), np.array([two[h[k], ws[k]] for k in range(len(ws))])
            threes = np.array([two[0, ws[0]], *(three[h[k - 1], ws[k - 1], ws[k]] for k in range(1, len(ws)))])
            first = np.arange(len(ws)) == 0
            bucket, p = lm.estimates(ones, twos, threes, first, one[0], n, 0)
            total += mixed[bucket[-1], :3] @ p[-1] + mixed[bucket[-1], 3] / (v + 1)
        assert abs(total - 1) < 1e-12, history


def test_toxicity_by_brute_force():
    """Features and score, with plain edit distances to every term and prefix."""
    import numpy as np

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    terms = [("scumbag", False, True), ("moron", True, True), ("rat", False, False), ("idio", True, False), ("scumbug", False, True)]

    def hit(token):
        found = []
        for part in re.findall(r"[^\W_]+", token):
            for k, (t, stem, edits) in enumerate(terms):
                ends = [part[:i] for i in range(1, len(part) + 1)] if stem else [part]
                d = min(distance(t, e) for e in ends)
                if d <= (1 if edits else 0):
                    found.append((d, k))
        return min(found, default=None)

    def features(text):
        tokens = (text or "").lower().split()
        sums = [0.0, 0.0, 0.0, 0.0]
        for i, t in enumerate(tokens):
            if (h := hit(t)) is None:
                continue
            near = range(max(0, i - toxicity.WINDOW), min(len(tokens), i + toxicity.WINDOW + 1))
            ends = lambda j: tokens[j].rstrip(".,;:!?")[-1:] in set(toxicity.MARKS)
            alone = lambda j: tokens[j].rstrip(".,;:!?") == "«"  # noqa: E731  opens only
            opened, closed = tokens[i][0] in toxicity.MARKS, ends(i)
            for j in reversed([j for j in near if j < i]):
                if opened or (ends(j) and not alone(j)):
                    break
                opened = tokens[j][0] in toxicity.MARKS
            for j in [j for j in near if j > i]:
                if closed or tokens[j][0] in toxicity.MARKS:
                    break
                closed = ends(j)
            cues = sum(tokens[j].strip(".,;:!?" + toxicity.MARKS) in toxicity.REPORTING for j in near if j != i)
            abuse = (0.3 if opened and closed else 1.0) * 0.6 ** min(3, cues)
            sums[1 if terms[h[1]][1] else 0] += abuse * (toxicity.EDITED if h[0] else 1)
            sums[2] += opened and closed
            sums[3] += 1 - 0.6 ** min(3, cues)
        return [min(1, sums[0]), math.log1p(sums[0]), min(1, sums[1]), math.log1p(sums[1]), math.log1p(sums[2]), math.log1p(sums[3])]

    r = random.Random(8)
    vocabulary = ["you", "are", "a", "scumbag", "scumbsg,", "skumbag!", '"moron"', "moronic", "m0ron.", "rat", "rats", "idiots", "idots", "said", "he", "wrote:", "«", "word»", "the", "stone", "..."]
    w = np.array([1.5, 0.7, 1.1, 0.2, -0.4, -0.1, -1.0])
    model = toxicity.Model(terms, w)
    for _ in range(300):
        text = " ".join(r.choices(vocabulary, k=r.randint(0, 25)))
        got, want = model.features(text), features(text)
        assert got == pytest.approx(want, abs=1e-12), text
    assert model.features(None) == features(None)


def test_language_id_does_not_look_at_other_rows():
    """A row's margins are those that it has alone, whatever stands before it, and those of a plain loop over its grams."""
    import numpy as np

    rng = np.random.default_rng(3)
    code = langid.codewords(3)
    model = langid.Model(["a", "b", "c"], code, rng.normal(size=(1 << langid.LOG_DIMS, code.shape[1])).astype(np.float32), np.ones(code.shape[1]))
    texts = [b"A,", b"", "être là".encode(), b"x", b"abc def 123", b"the end", b"x" * 9, "été ".encode() * 400_000, b"A,"]  # one is longer than a chunk
    for order in (list(range(9)), [3, 0, 7, 1, 8, 2, 6, 5, 4], list(range(9))[::-1]):
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        at = np.r_[0, np.cumsum([len(texts[i]) for i in order])]
        got = model.margins(data, at)
        for row, i in zip(got, order, strict=True):
            alone = model.margins(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))[0]
            assert np.array_equal(row, alone)
            if len(texts[i]) < 1000:
                folded = [32] * 3 + [int(langid.FOLD[x]) for x in texts[i]]
                want = np.zeros(code.shape[1])
                for j in range(len(texts[i])):
                    h = 0
                    for x in folded[j : j + 4]:
                        h = h << 8 | x
                    want += model.weights[(h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - langid.LOG_DIMS)]
                assert row == pytest.approx(want / math.sqrt(len(texts[i]) + 1))


def test_crowd_around_a_centre(spark):
    """Many texts near the threshold around one centre, many of which share passages that the centre lacks."""
    r = random.Random(7)
    vocab = [f"v{i}" for i in range(4000)]
    base, one, two = r.choices(vocab, k=130), r.choices(vocab, k=16), r.choices(vocab, k=9)
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5])):
            w[r.randrange(130)] = r.choice(vocab)
        if i % 2:
            at = r.randrange(131)
            w[at:at] = one
        rows.append((i, " ".join(w + two * (i % 3 == 0))))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    want = brute(rows)
    assert sorted(map(tuple, got.astype(int).to_numpy().tolist())) == want
    assert 5 < len({c for *_, c in want}) < 140
