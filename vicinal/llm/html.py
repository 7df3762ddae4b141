"""Main-text extraction by a maximum-scoring run of words and tags.

A page is a sequence of words and tags. A word scores a constant and the weights of the features of all elements
around it: their tags (but for containers that say nothing), the words of their class and id, their role, and whether
they are hidden. Tags cost. Plain tags are features of their own inside of what is known for other than main text, so that the lists of
menus say nothing on those of an article; inside of what speaks for main text they cost next to nothing and none speaks against it. Weights are log odds between the main part and the rest, learned from pages that mark
their main part themselves (<article>, <main>, role=main). One linear scan finds the contiguous run with the highest
sum; blocks of the run, and named elements inside a line, whose own words add up to less than zero are left out; what
stays is the text. Nothing is decided by a name alone: a name known to stand for other than main text (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) only begins with counts against it, which labelled
pages outweigh where it holds much of their main part, and says nothing where its element lies around the first marked
main part, or around nearly all words of the page. Content of scripts, styles, titles, text areas and the like is no text at all.

Learning reads at most TRAIN_PAGES pages (a documented bound; picked by hash); features and tags that fewer than two of
them, or LEAST_SHARE of them, have are not learned. Extraction reads whole pages, in time proportional to their length. Cases: a
null or empty html gives an empty text; text without tags is one block; unclosed and stray tags are tolerated: an end tag
closes what was opened inside its element, a block closes an open paragraph and an open <svg>, and what is never closed
ends with its parent; a tag that never ends is text; equal pages get equal texts; an empty table gives an empty result.
Only page_id, url and html are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame, functions as F

from .common import returned, staged

TRAIN_PAGES = 2000
LEAST_SHARE = 0.005
#: What a word scores without features, and the range of its score; most that the weights of a path may add up to above zero.
WORD, WORD_RANGE, MOST_FOR = 0.5, (-3.0, 1.0), 2.0
#: Ranges of weights: of names, roles and elements known for other than main text; of other tags. Costs of a tag: learned ones, others, and those inside a line.
WEIGHT, TAG_WEIGHT, TAG_RANGE, TAG, INLINE = 3.0, 1.0, (-1.0, -0.05), -1.0, -0.25
#: Share of the words outside of main parts that a name known for other than main text begins with.
PRIOR = 0.02
#: An element that holds this share of a page's words says nothing on which of them are main text.
NEARLY_ALL = 0.95
# Elements that end a block, that have no end tag, whose content is raw, whose content is never text, that say nothing.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
MUTE = frozenset("head iframe noscript object select svg math template".split())
PLAIN = frozenset("html body div span section table tbody thead tfoot tr td th center font b i em strong u small big br hr dl".split())
MAIN = frozenset(["article", "main"])
# Elements, words of a class or id, and roles that are known for other than main text.
NOISE = frozenset("aside button dialog footer form header menu nav".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar side "
    "comment comments reply replies discussion disqus menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended "
    "newsletter subscribe subscription signup login search toolbar widget pagination pager hidden".split()
)
ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar".split())
# What a compound name may end with to be about its first word, and may not begin with to be about its last one.
HOLDERS = frozenset("area bar block body box container content form inner item items left link links list panel right section slot text top unit wrap wrapper".split())
SWITCHES = frozenset("has hide is no non not with without".split())

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRS = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
PARTS = re.compile(r"[a-z]+")


def items(html: str):
    """(text, None) or (None, (end, name, attrs)) in page order. Every part of the page is looked at a few times at most."""
    at, n, start, unpaired, unended = 0, len(html), 0, 0, set()
    while (lt := html.find("<", at)) >= 0:
        if html.startswith("<!--", lt):
            stop, found = html.find("-->", lt + 4), None
            stop = n if stop < 0 else stop + 3
        elif html.startswith("<![CDATA[", lt):
            stop = html.find("]]>", lt)
            if stop < 0:
                break
            found, stop = (html[lt + 9 : stop], None), stop + 3
        elif m := NAME.match(html, lt + 1):
            stop = ATTRS.match(html, m.end()).end() if lt >= unpaired else m.end()
            if html[stop : stop + 1] != ">":  # a quote that is never closed, or none looked for: the next bracket ends the tag
                unpaired, stop = max(unpaired, stop), html.find(">", m.end())
                if stop < 0:
                    break
            name, end = m[1].lower(), html[lt + 1] == "/"
            found, stop = (None, (end, name, html[m.end() : stop])), stop + 1
            if name in RAW and not end and not found[1][2].endswith("/"):
                close = None if name in unended else re.compile(rf"</{name}(?![^\s/>])[^>]*>", re.I).search(html, stop)
                if close:
                    found, stop = None, close.end()
                else:
                    unended.add(name)
                    if name in ("script", "style"):
                        found, stop = None, n
        elif html.startswith(("<!", "<?"), lt):
            stop, found = html.find(">", lt), None
            if stop < 0:
                break
            stop += 1
        else:
            at = lt + 1
            continue
        if lt > start:
            yield html[start:lt], None
        if found:
            yield found
        at = start = stop
    if start < n:
        yield html[start:], None


def noisy(word: str) -> bool:
    """Whether a word of a class or id is known for other than main text: by itself, or as a compound about such a word."""
    parts = PARTS.findall(word)
    if not parts or parts[0] in SWITCHES:
        return False
    return parts[-1] in NAMES or parts[0] in NAMES and parts[-1] in HOLDERS


def features(name: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """The features of an element, and whether it marks the main part."""
    own = () if name in PLAIN else (name,)
    if not attrs.strip(" /"):
        return own, name in MAIN
    a = {k.lower(): x or y or z for k, x, y, z in ATTR.findall(attrs)}
    role = a.get("role", "").lower().strip()
    words = sorted(set((a.get("class", "") + " " + a.get("id", "")).lower().split()))
    hidden = "hidden" in a or a.get("aria-hidden", "") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    return own + tuple("." + w for w in words) + (("@" + role,) if role else ()) + (("!hidden",) if hidden else ()), name in MAIN or role == "main"


class Page:
    """Items and elements of a page. An item is (text, None, element, block), or for a tag (None, kind, element, block)."""

    def __init__(self, html: str):
        self.items: list[tuple] = []
        # For each element, the page being the first: parent, features, inside the main part, mute, own words, around the first mark, a block.
        self.parent, self.features, self.main, self.mute, self.words, self.around, self.block = [-1], [()], [False], [False], [0], [True], [True]
        self.other = [False]  # in or known for other than main text
        stack, under, open_, marked = [0], [0], Counter(), False  # under: place in the stack of the innermost block
        block, names = 0, [""]

        def close():
            stack.pop()
            under.pop()
            open_[names.pop()] -= 1

        for text, tag in items(html):
            if tag is None:
                e = stack[-1]
                self.items.append((text, None, e, block))
                if not self.mute[e]:
                    self.words[e] += len(text.split())
                continue
            end, name, attrs = tag
            if name in BLOCKS:
                block += 1
            if end:
                if open_[name] > 0:
                    while names[-1] != name:
                        close()
                    close()
                self.items.append((None, self.kind("/" + name, stack[-1]), stack[-1], block))
                continue
            if name in BLOCKS:
                while open_["svg"] > 0 or open_["math"] > 0:
                    close()
                k = under[-1]
                if names[k] == "p" or name == "li" and names[k] == "li":
                    while len(stack) > k:
                        close()
            own, mark = features(name, attrs)
            e = stack[-1]
            if name in VOID or attrs.rstrip().endswith("/"):
                self.items.append((None, self.kind(name, e), e, block))
                continue
            self.other.append(self.other[e] or any(map(known, own)))
            self.parent.append(e)
            self.features.append(tuple(self.kind(f, e) if generic(f) else f for f in own))
            self.main.append(self.main[e] or mark)
            self.mute.append(self.mute[e] or name in MUTE)
            self.words.append(0)
            self.around.append(False)
            self.block.append(name in BLOCKS)
            stack.append(len(self.parent) - 1)
            names.append(name)
            under.append(len(stack) - 1 if name in BLOCKS else under[-1])
            open_[name] += 1
            if mark and not marked:
                marked = True
                for x in stack:
                    self.around[x] = True
            self.items.append((None, self.kind(name, e), stack[-1], block))
        self.size = self.inside(self.words)

    def kind(self, name: str, e: int) -> str:
        """A plain tag by where it is: marked inside of what is known for other than main text."""
        return "~" + name if self.other[e] else name

    def inside(self, own: list[int]) -> list[int]:
        """For each element the sum over it and all elements in it."""
        out = list(own)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def main_words(self) -> list[int]:
        """For each element the main words in it: those of marked parts, but not of what is known for other than main text and holds less than half of them."""
        half = sum(n for n, m in zip(self.words, self.main, strict=True) if m) / 2
        other = [False]
        for e in range(1, len(self.parent)):
            p = self.parent[e]
            other.append(other[p] or self.main[p] and self.size[e] < half and any(map(known, self.features[e])))
        return self.inside([n if m and not o else 0 for n, m, o in zip(self.words, self.main, other, strict=True)])

    def word_scores(self, w: dict[str, float]) -> tuple[list[float], list[float], list[bool]]:
        """What a word in each element scores, what of it speaks for main text, and whether the element is a hole: it has what speaks against it, inside of what speaks for main text or as a minor part of a part of the page."""
        total, good, bad, hole = self.size[0], [0.0], [0.0], [False]
        for e in range(1, len(self.parent)):
            p = self.parent[e]
            x, y = good[p], bad[p]
            for f in self.features[e]:
                v = weight(f, w)
                if v > 0:
                    x = min(MOST_FOR, x + v)
                elif generic(f) and x > 0:
                    continue  # a list or a table inside of main text is part of it
                elif not (self.around[e] or self.size[e] >= NEARLY_ALL * total or f == "header" and self.main[p]):
                    y = max(-4 * WEIGHT, y + v)  # not around what is main text, nor the heading of a main part
            good.append(x)
            bad.append(y)
            minor = good[p] > 0 or 2 * self.size[e] < self.size[p] < NEARLY_ALL * total
            hole.append(hole[p] or self.mute[e] or y <= bad[p] - WEIGHT / 2 and minor)
        lo, hi = WORD_RANGE
        return [0.0 if m else min(hi, max(lo, WORD + x + y)) for x, y, m in zip(good, bad, self.mute, strict=True)], good, hole

    def scores(self, w: dict[str, float]) -> tuple[list[float], list[float]]:
        """What each item scores, and what a word in each element scores. Tags inside of what speaks for main text cost next to nothing, and so does what is in holes: it is left out without ending the run."""
        word, good, hole = self.word_scores(w)
        out = []
        for text, kind, e, _ in self.items:
            if text is not None:
                out.append((max(word[e], TAG_RANGE[1]) if hole[e] else word[e]) * len(text.split()))
            else:
                name, cost = kind.strip("~/"), w.get("t" + kind, TAG)
                out.append(TAG_RANGE[1] if hole[e] or name in MUTE or good[e] > 0 else max(cost, TAG if name in BLOCKS else INLINE))
        return out, word


def weight(feature: str, w: dict[str, float]) -> float:
    """Of a feature that no labelled page has: what its name alone says."""
    if (x := w.get("w" + feature)) is not None:
        return x
    if known(feature):
        return -WEIGHT
    return TAG_WEIGHT if feature in MAIN or feature == "@main" else 0.0


def generic(feature: str) -> bool:
    """Whether a feature is a plain tag, which is used in any part of a page."""
    return feature[0] not in ".@!" and not known(feature) and feature not in MAIN


def known(feature: str) -> bool:
    """Whether a feature is known for other than main text."""
    return feature in NOISE or feature == "!hidden" or feature[0] == "@" and feature[1:] in ROLES or feature[0] == "." and noisy(feature)


def learn(pages) -> tuple[Counter, Counter]:
    """Words by feature and tags by kind, in and out of the marked main part, of pages that mark one; and on how many pages each is."""
    seen, on = Counter(), Counter()
    for html in pages:
        page = Page(html or "")
        if any(page.main):
            here, main = set(), page.main_words()
            for e in range(1, len(page.parent)):
                for f in page.features[e]:
                    here.add("w" + f)
                    seen["w" + f, True] += main[e]
                    seen["w" + f, False] += page.size[e] - main[e]
            for text, kind, e, _ in page.items:
                if text is None:
                    here.add("t" + kind)
                    seen["t" + kind, page.main[e]] += 1
            on.update(here)
            seen["w", True] += main[0]
            seen["w", False] += page.size[0] - main[0]
            on.update(["w"])
    return seen, on


def weights(seen: dict) -> dict[str, float]:
    """Log odds of the main part."""
    words = {m: max(1, seen.get(("w", m), 0)) for m in (True, False)}
    tags = {m: max(1, sum(n for (k, x), n in seen.items() if k[0] == "t" and x == m)) for m in (True, False)}
    out = {}
    for k in {k for k, _ in seen} - {"w"}:
        total = words if k[0] == "w" else tags
        against = PRIOR * total[False] if k[0] == "w" and known(k[1:]) else 0
        odds = math.log((seen.get((k, True), 0) + 0.5) / total[True]) - math.log((seen.get((k, False), 0) + 0.5 + against) / total[False])
        most = WEIGHT if k[1] in ".@!" or known(k[1:]) else TAG_WEIGHT
        lo, hi = (-most, most) if k[0] == "w" else TAG_RANGE
        out[k] = min(hi, max(lo, odds))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the highest sum, the first of such and the longest from its start on; none if no score is above zero."""
    best, run, start, span = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        run += x
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, span = run, (start, i + 1)
    return span


def extract(html: str | None, w: dict[str, float]) -> str:
    page = Page(html or "")
    scores, word = page.scores(w)
    first, last = best_run(scores)
    # What is kept or left out as one: a block, or in it an element with a name that counts against it.
    apart = [0] * len(page.parent)
    for e in range(1, len(apart)):
        p = page.parent[e]
        apart[e] = 0 if page.block[e] else e if word[e] < 0 and any(f[0] in ".@!" and weight(f, w) < 0 for f in page.features[e]) else apart[p]
    units: dict[tuple[int, int], float] = {}
    for i in range(first, last):
        text, _, e, block = page.items[i]
        if text is not None and not page.mute[e]:
            units[block, apart[e]] = units.get((block, apart[e]), 0.0) + word[e] * len(text.split())
    blocks: dict[int, list[str]] = {}
    for i in range(first, last):
        text, _, e, block = page.items[i]
        if text is not None and not page.mute[e] and units[block, apart[e]] >= 0:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(unescape("".join(x)).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, rows: int = TRAIN_PAGES) -> dict[str, float]:
    n = pages.count()
    pick = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < int(min(1.0, rows / max(1, n)) * (1 << 20))
    sample = staged(pages.filter(pick).select("html"), "html-sample")

    def run(batches):
        import pandas as pd

        for b in batches:
            seen, on = learn(b["html"])
            yield pd.DataFrame([(k, seen[k, True], seen[k, False], c) for k, c in on.items()], columns=["kind", "inside", "outside", "pages"])

    got = sample.mapInPandas(run, "kind string, inside long, outside long, pages long").groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("inside", "outside", "pages")))
    least = max(2, math.ceil(LEAST_SHARE * sample.count())) if n > 2 else 1
    # A page has a bounded share of the features that LEAST_SHARE of the pages have, so these are few.
    seen = {}
    for r in got.filter(F.col("pages") >= least).collect():
        seen |= {(r["kind"], True): r["inside"], (r["kind"], False): r["outside"]}
    return weights(seen)


def extracted(pages: DataFrame, w: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(w)

    def run(batches):
        import pyarrow as pa

        for b in returned(batches):
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = [extract(h, shared.value) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8(spark, sf_dir):
    from .common import table

    pages = table(spark, sf_dir, "pages")
    return extracted(pages, train(pages))
