import itertools
import random
import time

import pytest

from vicinal.llm import html

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p><p>x';</script></head><body>"
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy now cheap words here</div>"
    "<article><h1>Head &amp; tail</h1><p><b>One  two\n three<br><p>Four &lt;five&gt; six seven</p><aside>See also this</aside>"
    "<p>Eight nine ten eleven.</p><form><label>Name</label><input></form><div id='comments'><p>First! great post</p></div></article>"
    "<footer>&copy; 2020 imprint</footer></body></html>"
)
WANT = "Head & tail\nOne two three\nFour <five> six seven\nEight nine ten eleven."


def learned(*pages):
    return html.weights(html.learn(pages)[0])


def test_page_with_and_without_learning():
    w = learned(*[PAGE] * 3)
    assert html.extract(PAGE, w) == WANT
    for name in ("section", "div"):
        assert html.extract(PAGE.replace("article", name), w) == WANT
    assert html.extract(PAGE, {}) == WANT


def test_the_scan_decides():
    """Without any name that helps, the run leaves out what lies before and after."""
    w = learned(*[PAGE] * 3)
    text = "<h1>A title</h1>" + "<p>some words that make a paragraph of the text</p>" * 3
    page = f"<html><body><div><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></div><div>{text}</div><div><ul><li><a href=z>Imprint</a></li></ul></div></body></html>"
    want = "A title\n" + "\n".join(["some words that make a paragraph of the text"] * 3)
    assert html.extract(page, w) == want
    p = html.Page(page)
    first, last = html.best_run(p.scores(w)[0])
    inside = [t for t, *_ in p.items[first:last] if t]
    assert len(inside) < len([t for t, *_ in p.items if t])


def test_best_run_is_the_best():
    r = random.Random(1)
    for _ in range(500):
        x = [r.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(r.randint(0, 12))]
        best = max([sum(x[i:j]) for i, j in itertools.combinations(range(len(x) + 1), 2)], default=0)
        a, b = html.best_run(x)
        assert sum(x[a:b]) == max(0, best)


@pytest.mark.parametrize("attrs", ['class="layout no-sidebar"', 'class="content with-comments"', 'id="page" class="has-header"', 'class="social-science"'])
def test_names_around_the_text(attrs):
    w = learned(*[PAGE] * 3)
    for inner in ("article", "section"):
        page = f"<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div {attrs}><{inner}><h1>T a</h1><p>one two three four five six</p></{inner}></div><footer>imprint x</footer></body></html>"
        assert html.extract(page, w) == "T a\none two three four five six"


def test_known_names_around_a_main_part():
    page = "<div class='sidebar'><article><p>one two three four five six</p></article></div><div class='comment-list'><p>First! great post</p></div>"
    assert html.extract(page, learned(PAGE)) == "one two three four five six"


def test_labels_outweigh_names():
    page = "<main><div class='promo'><p>one two three four</p></div></main><div class='zone'>see our offers today</div>"
    w = learned(*[page] * 20)
    assert w["w.promo"] > 0 > w["w.zone"]
    assert html.extract(page.replace("main", "div"), w) == "one two three four"


def test_inside_a_line():
    w = learned(*[PAGE] * 3)
    page = '<article><p>Some text is here and <span class="advert">BUY NOW</span> more words <a class="share">share it</a> and a <a href=x>link stays</a> here at the end.</p></article>'
    assert html.extract(page, w) == "Some text is here and more words and a link stays here at the end."


def test_odd_pages():
    w = learned(PAGE)
    assert html.extract(None, w) == html.extract("", w) == html.extract("<div></div>", w) == ""
    assert html.extract("just a  text", w) == "just a text"
    assert html.extract("<p>a &amp;amp; b</p><script>never closed", w) == "a &amp; b"
    assert html.extract("<article><p>unclosed <p>two <div class=ad>never closed</article>", w) == "unclosed\ntwo"
    assert html.extract("<p title='a > b'>x y z</p></div></p>", w) == "x y z"
    assert html.extract("a < b and <", w) == "a < b and <"
    assert html.extract("<p>x <a " + "'b' \"c\" " * 5000, w).startswith("x <a")  # many quotes, no end
    assert len(html.extract("<p>" + "word " * 100_000, w)) == 499_999
    assert html.extract("<p>one two</p><svg>a<svg>b</svg>LEAK</svg><p>three</p>", w) == "one two\nthree"
    assert html.extract("<p>a b</p><svg><path><text>x<p>next one</p><p>and two</p>", w) == "a b\nnext one\nand two"
    assert html.extract("<p>x y</p><textarea>in</textarea><noscript>turn it on</noscript><p>z</p>", w) == "x y\nz"


@pytest.mark.parametrize("part", ["<a ", "<a '", "<a \"'>", "<div>", "<b>", "<b><p>", "<title>", "<svg><p>", "</p>", "<p", "<!--x", "<![CDATA[", "x <y 'z> "])
def test_time_grows_with_the_length(part):
    w = learned(PAGE)
    start = time.perf_counter()
    html.extract(part * (10**6 // len(part)), w)
    assert time.perf_counter() - start < 30  # a second or two; hours if each tag looked at the rest of the page


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "u", "", "z"), (4, "u", PAGE, "x"), (None, None, PAGE, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extracted(df, html.train(df)).collect()}
    assert got == {1: (WANT, len(WANT)), 2: ("", 0), 3: ("", 0), 4: (WANT, len(WANT)), None: (WANT, len(WANT))}
    assert html.extracted(df.limit(0), html.train(df.limit(0))).count() == 0


NAV = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav><div class=ad>Buy this now or never</div>"
FOOT = "<footer>&copy; imprint and terms</footer>"
ARTICLES = [
    ("<article><h1>Cake</h1><p>Take these things to make a cake today:</p><ul><li>flour</li><li>two eggs</li></ul><p>Then stir it well and bake it for an hour.</p></article>", "Cake\nTake these things to make a cake today:\nflour\ntwo eggs\nThen stir it well and bake it for an hour."),
    ("<article><p>First paragraph.</p><table><tr><td>one</td><td>two cells</td></tr></table><p>Second paragraph.</p></article>", "First paragraph.\none\ntwo cells\nSecond paragraph."),
    ("<article><p>Some words before the list.</p><ul><li>a</li><li>b</li><li>c</li><li>d</li></ul></article>", "Some words before the list.\na\nb\nc\nd"),
    ("<article><dl><dt>Term</dt><dd>what it means</dd><dt>Other</dt><dd>more</dd></dl><p>Then the paragraph goes on.</p></article>", "Term\nwhat it means\nOther\nmore\nThen the paragraph goes on."),
    ("<article><p>Code:</p><pre>x = 1</pre><blockquote><p>a quote</p></blockquote><figure><img src=x><figcaption>cap</figcaption></figure><p>end of text</p></article>", "Code:\nx = 1\na quote\ncap\nend of text"),
    ("<article><h2>A</h2><p>first article has words</p></article><article><h2>B</h2><p>second article has words</p></article>", "A\nfirst article has words\nB\nsecond article has words"),
    ("<div class=post><p>The first post has some words in it.</p></div><div class=post><p>The second post has other words in it.</p></div>", "The first post has some words in it.\nThe second post has other words in it."),
    ("<article><p>See these links for more:</p><ol><li><a href=a>first link</a></li><li><a href=b>second link</a></li></ol></article>", "See these links for more:\nfirst link\nsecond link"),
    ("<article><p>Some words are here.</p><aside><ul><li>See this advert</li></ul></aside><ul><li>kept item</li></ul><div class=comments><ul><li>First! great</li></ul></div></article>", "Some words are here.\nkept item"),
]


@pytest.mark.parametrize(("part", "want"), ARTICLES)
def test_lists_tables_and_several_articles(part, want):
    page = f"<html><body>{NAV}{part}{FOOT}</body></html>"
    assert html.extract(page, learned(*[PAGE] * 3)) == want
    assert html.extract(page, learned(*[f"<html><body>{NAV}<article><p>one two three four</p><br><p>five six</p></article>{FOOT}</body></html>"] * 20)) == want


def test_word_recall_and_precision():
    """Over pages put together at random from such parts, with menus of lists around and in them."""
    r = random.Random(5)
    w = learned(*[PAGE] * 3)
    kept = right = wanted = 0
    for _ in range(200):
        words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
        parts, text = [], []
        for _ in range(r.randint(1, 8)):
            kind, items = r.choice(["p", "ul", "ol", "table", "dl", "h2", "pre", "menu"]), [words(r.randint(1, 6)) for _ in range(r.randint(1, 5))]
            if kind == "menu":
                parts.append(f"<nav><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul></nav>")
                continue
            text += items
            parts.append({"ul": lambda: f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", "ol": lambda: f"<ol>{''.join(f'<li>{x}</li>' for x in items)}</ol>", "dl": lambda: f"<dl>{''.join(f'<dt>{x}</dt>' for x in items)}</dl>", "table": lambda: f"<table>{''.join(f'<tr><td>{x}</td></tr>' for x in items)}</table>"}.get(kind, lambda: "".join(f"<{kind}>{x}</{kind}>" for x in items))())
        got = html.extract(f"<html><body>{NAV}<article>{''.join(parts)}</article>{FOOT}</body></html>", w).split()
        want = " ".join(text).split()
        kept, right, wanted = kept + len(got), right + len(set(got) & set(want)), wanted + len(want)
    assert right / wanted > 0.99 and right / kept > 0.99
