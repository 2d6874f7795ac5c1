from __future__ import annotations

import html as markup
import itertools
import random
import re
import time

import pytest

from roadlens.llm import main_text as mt

FOLDER = "/root/testdata/sf0.001"
PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><div class="menu"><a href=x>Home</a> <a href=y>News</a></div>
<main><h1>The  title &amp; more</h1><p>One <b>bold</b>
 line.<p>Two&nbsp;lines<br>here &lt;b&gt; &copy;<aside>See also</aside><ul><li>point one<li>point two</ul>
<div id="comments"><p>Nice article, I liked reading all of it, thank you.</p></div></main>
<form><label>Mail</label><input></form><div class="cookie-notice">We use cookies.</div><footer>end</footer>"""


def test_stated_roles():
    text, _, _ = mt.extract(PAGE, mt.train([]))
    assert text == "The title & more\nOne bold line.\nTwo lines here <b> ©\npoint one\npoint two"


def test_pages_against_their_article(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    rows = mt.main_text(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|<footer|$)", source[r.page_id], re.S).group(1)
        parts = [" ".join(markup.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split())
                 for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_unstated_pages_by_shape(spark):
    odds = mt.learned(spark.read.parquet(f"{FOLDER}/pages.parquet"))
    story = "A paragraph of the story, long enough to be taken as content by its shape, with commas, and a full stop."
    page = f"<body><div><a>Home</a></div><div><a>News</a></div><div><p>{story}</p><p>Short.</p><p>{story}</p></div>"
    assert mt.extract(page, odds)[0] == f"{story}\nShort.\n{story}"


def test_fit_on_a_sample_of_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    few, all_ = mt.learned(pages, fit_pages=40), mt.learned(pages)
    assert few.keys() == all_.keys() and few != all_
    assert mt.learned(pages.repartition(5), fit_pages=40) == few


def test_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 8)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        smooth = {(a, b): rng.uniform(0, 2) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}

        def value(labels):
            total = sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(costs, labels))
            return total + sum(w for (a, b), w in smooth.items() if labels[a] != labels[b])

        best = min(value(x) for x in itertools.product((False, True), repeat=n))
        assert abs(value(mt.cut(costs, smooth)) - best) < 1e-9


STORY = "It was said in the town that the bridge would open in spring, and many came to see the works on it by day."


@pytest.mark.parametrize("page, text", [
    (f"<form id=aspnetForm><article><h1>The bridge</h1><p>{STORY}<p>{STORY}</article></form>",
     f"The bridge\n{STORY}\n{STORY}"),
    (f"<div class='site has-sidebar'><article><h1>The bridge</h1><p>{STORY}</article></div>", f"The bridge\n{STORY}"),
    (f"<div class='sidebar'><main><p>{STORY}</main></div><div class='sidebar'>Links</div>", STORY),
    (f"<div class=entry-header><h1>The bridge</h1></div><div class=entry><p>{STORY}</div>", f"The bridge\n{STORY}"),
    ("<article><p>In <span class='social'>social</span> science, it holds.</article>", "In social science, it holds."),
    ("<article><p>Press <button>Start</button> or the <label>key</label> to go.</article>", "Press Start or the key to go."),
    ("<article><p>So <math><mi>x</mi></math> grows.<noscript><p>A note.</noscript></article>", "So x grows.\nA note."),
    (f"<article><p>{STORY}</p><section id=comments><article><p>{STORY}</article></section></article>", STORY),
    (f"<aside><article><p>{STORY}</article></aside><article><p>{STORY} End.</article>", f"{STORY} End."),
    (f"<form><label>Mail</label><button>Send</button></form><article><p>{STORY}</article>", STORY),
    (f"<p hidden>no</p><article><p>{STORY}<span style='display: none'>no</span></article>", STORY),
    (f"<form><div><p>{STORY}</p><p>{STORY}</p></div></form>", f"{STORY}\n{STORY}"),
])
def test_the_innermost_statement_decides(page, text):
    assert mt.extract(f"<body>{page}</body>", mt.train([]))[0] == text


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "x", "<div>x" * 100_000, "<div>" * 50_000 + "</section>" * 50_000 + "x",
    "<blockquote><li>x" * 50_000, "<b>" * 100_000 + "x", "<p>in between, as it were</p>" * 100_000,
    "<div><p>in between, as it</p><span>a b</span></div>" * 40_000])
def test_large_pages_take_seconds(page):
    began = time.process_time()
    mt.extract(page, mt.train([]))
    assert time.process_time() - began < 40


def test_reduced_cut_is_minimal(monkeypatch):
    """Edges that nest like brackets reduce wholly, and to a cut of the same cost."""
    rng = random.Random(8)
    for _ in range(150):
        n = rng.randrange(1, 40)
        costs = [rng.uniform(-1, 1) for _ in range(n)]
        smooth = {(i, i + 1): rng.uniform(0, 2) for i in range(n - 1)}

        def nest(lo, hi):
            if hi - lo >= 2 and rng.random() < 0.8:
                smooth[lo, hi] = rng.uniform(0, 2)
                middle = rng.randrange(lo + 1, hi)
                nest(lo, middle)
                nest(middle, hi)

        nest(0, n - 1)

        def value(labels):
            total = sum(max(c, 0) if not x else max(-c, 0) for c, x in zip(costs, labels))
            return total + sum(w for (a, b), w in smooth.items() if labels[a] != labels[b])

        near = [{} for _ in range(n)]
        for (a, b), w in smooth.items():
            near[a][b] = near[b][a] = w
        reduced = mt._reduced(dict(enumerate(costs)), near)
        assert abs(value([reduced[i] for i in range(n)]) - value(mt.cut(costs, smooth))) < 1e-9
    full = [{j: 1.0 for j in range(5) if j != i} for i in range(5)]
    assert mt._reduced(dict.fromkeys(range(5), 0.1), full) is None


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_blocks string"
    rows = [(1, None, None, "x", "y"), (None, "u", "", "x", "y"), (2, "u", "<p>" * 5000, "x", "y"),
            (2, "u", "plain &am", "x", "y"), (2, "u", "<article>" + "<p>a b.</p>" * 20_000, "x", "y"),
            (3, "u", "<<>><a <b <!-- <![CDATA[ </ ", "x", "y")]
    df = spark.createDataFrame(rows, schema)
    out = mt.main_text(df).collect()
    assert len(out) == len(rows)
    assert {r.n_chars for r in out if r.page_id in (1, None)} == {0}
    assert max(r.n_content for r in out) == 20_000
    assert mt.main_text(spark.createDataFrame([], schema)).count() == 0
