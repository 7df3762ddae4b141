"""Byte-level BPE encoding and decoding by speculation and verification.

A word that is not known yet is split by greedy longest match against the vocabulary; the pairs of adjacent
tokens of all such words are then tested together: a split is the BPE result exactly if every adjacent pair
(t, u) is what merging the bytes of t and u by rank gives. Tests of pairs are remembered as sorted keys, so a
batch costs one search for all its pairs and an exact merge only for pairs never seen; words with a failing
pair are merged exactly. Words are split as the vocabulary's pre-tokenizer does and remembered, within bounds.

Nothing is trained; the vocabulary file is a parameter, read by the driver and sent to the tasks. Cases: a null
text is empty and has no tokens; the special token's string in a text becomes its id; texts of any length are
encoded whole (a word of n bytes takes n log n steps); equal texts get equal rows; an empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import give_back

MOST_WORDS = 250_000
MOST_PAIRS = 1_000_000
TEXTS_AT_ONCE = 256
#: Words of more bytes are merged with a heap.
SHORT = 48
# White space beyond ASCII.
SPACES = ((0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _ranges(keep, top: int) -> str:
    """The characters up to top for which keep(category) holds, as the inside of a character class."""
    out, start = [], None
    for c in range(top + 2):
        on = c <= top and keep(unicodedata.category(chr(c)))
        if on and start is None:
            start = c
        elif not on and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@cache
def splitter(top: int = sys.maxunicode) -> re.Pattern:
    """Contractions, letters, numbers, other signs (each with a space before it), white space; for texts without characters above top."""
    letter, number = _ranges(lambda c: c[0] == "L", top), _ranges(lambda c: c[0] == "N", top)
    space = r"\t-\r " + "".join(f"\\u{lo:04x}-\\u{hi:04x}" for lo, hi in SPACES if hi <= top)
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def split(text: str) -> list[str]:
    """By the splitter of the narrowest range that holds the text: narrow classes are faster."""
    if text.isascii():
        return splitter(0x7F).findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return splitter().findall(text)
    return splitter(0xFF).findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizer:
    """From the text of a vocabulary file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in self.special:
            self.ids.pop(t.encode(), None)
        self.bytes = {i: t for t, i in self.ids.items()}
        self.bytes.update({i: t.encode() for t, i in self.special.items()})
        self.merges: dict[tuple[int, int], int] = {}  # rank << 20 | new token
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[self.ids[a], self.ids[b]] = rank << 20 | self.ids[a + b]
        self.prefixes = {t[:n]: self.ids.get(t[:n], -1) for t in self.ids for n in range(1, len(t) + 1)}  # its token, or -1
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, tuple[str, bytes]] = {}
        self.pairs = np.zeros(0, np.int64)  # keys of the tested pairs, sorted, and whether they hold
        self.holds = np.zeros(0, bool)

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, get = [], 0, len(word), self.prefixes.get
        while i < n:
            j, token, end = i + 1, -1, i + 1
            while j <= n and (t := get(word[i:j])) is not None:
                if t >= 0:
                    token, end = t, j
                j += 1
            out.append(token)
            i = end
        return out

    def merged(self, word: bytes) -> list[int]:
        """The exact result: lowest rank first, leftmost among equals."""
        ids, get, none = [self.ids[word[i : i + 1]] for i in range(len(word))], self.merges.get, 1 << 62
        if len(ids) > SHORT:
            return self._merged_long(ids)
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i, new = ranks.index(least), least & 0xFFFFF
            ids[i : i + 2] = [new]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def _hold(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair, as first << 20 | second, holds; a token alone has the first 2**20 - 1."""
        new = np.setdiff1d(keys, self.pairs)
        if len(new):
            if len(self.pairs) > MOST_PAIRS:
                self.pairs, self.holds, new = self.pairs[:0], self.holds[:0], np.unique(keys)
            lone = (1 << 20) - 1
            ok = [self.merged((b"" if a == lone else self.bytes[a]) + self.bytes[b]) == ([b] if a == lone else [a, b]) for a, b in zip((new >> 20).tolist(), (new & lone).tolist(), strict=True)]
            at = np.searchsorted(self.pairs, new)
            self.pairs, self.holds = np.insert(self.pairs, at, new), np.insert(self.holds, at, ok)
        return self.holds[np.searchsorted(self.pairs, keys)]

    def learn(self, words: list[str]) -> None:
        """Adds the words' ids (as text) and the bytes that these decode to."""
        raw = [w.encode() for w in words]
        split = [self.greedy(w) for w in raw]
        size = np.array([len(s) for s in split])
        flat = np.fromiter((t for s in split for t in s), np.int64, size.sum())
        first = np.zeros(len(flat), bool)
        first[np.r_[0, np.cumsum(size)[:-1]]] = True
        lead = np.where(first, (1 << 20) - 1, np.r_[0, flat[:-1]])
        check = ~first | np.repeat(size == 1, size)
        bad = np.zeros(len(flat), bool)
        bad[check] = ~self._hold(lead[check] << 20 | flat[check])
        for i in np.unique(np.repeat(np.arange(len(words)), size)[bad]):
            split[i] = self.merged(raw[i])
        for w, s in zip(words, split, strict=True):
            self.words[w] = (",".join(map(str, s)), b"".join([self.bytes[t] for t in s]))

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """For each text its ids, joined by commas, and what they decode to."""
        parts = [[(p, p in self.special) for p in self.cut.split(t) if p] if self.cut and self.cut.search(t) else [(t, False)] for t in texts]
        runs = [[[p] if special else split(p) for p, special in row] for row in parts]
        new = {w for row, spec in zip(runs, parts, strict=True) for ws, (_, s) in zip(row, spec, strict=True) if not s for w in ws} - self.words.keys()
        if len(self.words) + len(new) > MOST_WORDS:
            self.words.clear()
            new = {w for row, spec in zip(runs, parts, strict=True) for ws, (_, s) in zip(row, spec, strict=True) if not s for w in ws}
        if new:
            self.learn(list(new))
        out = []
        for row, spec in zip(runs, parts, strict=True):
            got = [(str(self.special[p]), p.encode()) if s else self.words[w] for ws, (p, s) in zip(row, spec, strict=True) for w in ws]
            out.append((",".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        return out


_LOADED: dict[str, Tokenizer] = {}  # one for each file in a worker process; words are known for a task only


def loaded(source: str) -> Tokenizer:
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(source)
    return _LOADED[key]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. path: of the vocabulary file on the driver."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        tok = loaded(shared.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        try:
            for b in batches:
                for lo in range(0, b.num_rows, TEXTS_AT_ONCE):
                    part = b.slice(lo, TEXTS_AT_ONCE)
                    got = tok.encode([t or "" for t in part.column("text").to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array([ids.count(",") + 1 if ids else 0 for ids, _ in got], pa.int64()), pa.array([sha(ids.encode()) for ids, _ in got]), pa.array([sha(raw.decode("utf-8", "replace").encode()) for _, raw in got])],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
        finally:
            tok.words, tok.pairs, tok.holds = {}, tok.pairs[:0].copy(), tok.holds[:0].copy()
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10(spark, sf_dir):
    from .common import table

    return encode(table(spark, sf_dir, "documents"), default_path())
