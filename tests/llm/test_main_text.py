"""Main text: blocks by hand, layouts that the tree was not trained on, odd markup, and the given pages against their articles."""

import html
import random
import re
import time

import pytest
from cubewright.llm import main_text as m
from pyspark.sql import functions as F

WORDS = "time river stone light house garden winter letter morning people water answer bridge summer market".split()
R = random.Random(5)


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def links(n):
    return "".join(f'<li><a href="/{k}">{prose(2)}</a></li>' for k in range(n))


@pytest.fixture(scope="module")
def model(spark):
    return m.tree(m.labelled(spark))


def blocks(page):
    return [b[0] for b in m.Cutter(page).found]


def test_blocks():
    page = "<title>no</title><p>a <b>b</b>c<p>d&nbsp;&amp;\n e<br>f<!-- g --><script>if (a<b) '</p>'</script><ul><li>h<li><a href=x>i j</a> k</ul>l < m <3 </>n</p>"
    assert m.Cutter(page).found == [("a bc", 2, 0, 0, False), ("d & e f", 4, 0, 0, False), ("h", 1, 0, 0, False), ("i j k", 3, 2, 0, False), ("l < m <3 n", 5, 0, 0, False)]
    assert blocks("a<p title='>'>b</p>c<p class=\"d>e") == ["a", "b", "c"]
    assert blocks("a<!-- b") == ["a"] and blocks("a<!-->b") == ["ab"]
    assert blocks("<script>a") == [] and blocks("&#" + "9" * 5000 + ";x") == ["�x"] and blocks("&#x41;&eacute;&nosuch;&am") == ["Aé&nosuch;&am"]
    assert [b[3] for b in m.Cutter("<article>a<aside>b</aside>c<div class=adBox>d</div></article>e<header>f</header><form>g<main>h</main></form><section id='comments'><article>i</article></section>").found] == [m.MAIN, m.STRONG, m.MAIN, m.WEAK, m.NONE, m.STRONG, m.FORM, m.MAIN, m.STRONG]


LAYOUTS = {
    "elements": lambda t, a: f"<html><body><header><a href=/>Site</a> {prose(5)}</header><nav><ul>{links(8)}</ul></nav><main><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in a) + f"</main><aside><h2>More</h2><ul>{links(5)}</ul><p>{prose(40)}</p></aside><footer>&copy; {prose(12)}</footer></body></html>",
    "classes": lambda t, a: f'<body class="has-sidebar"><div id="top-menu"><ul>{links(6)}</ul></div><div class="cookie-notice">{prose(30)}<button>ok</button></div><div class="page"><div class="post"><h1>{t}</h1>' + "".join(f"<p>{p}</p>" for p in a) + f'</div></div><div class="sidebar">{prose(35)}</div><form action=/s>{prose(6)}<input></form><div id="comments"><p>{prose(60)}</p><p>{prose(45)}</p></div><div class="footer">{prose(15)}</div></body>',
    "comments in article": lambda t, a: f"<body><nav>{links(4)}</nav><article><header class='entry-header'><h1>{t}</h1></header>" + "".join(f"<p>{p}" for p in a) + f"<section class='commentList'><article><p>{prose(50)}</p></article><article>{prose(70)}</article></section></article><footer>{prose(9)}</footer>",
    "advert between": lambda t, a: f"<ul>{links(9)}</ul><article><h1>{t}</h1><p>{a[0]}</p><div class='ad'>{prose(25)}</div>" + "".join(f"<p>{p}</p>" for p in a[1:]) + f"<script>var x='{prose(9)}'</script></article>",
    "within a form": lambda t, a: f"<form id='aspnet'><div class='nav'>{links(5)}</div><div><h1>{t}</h1>" + "".join(f"<div>{p}</div>" for p in a) + f"</div><div class='footer'>{prose(8)}</div></form>",
    "no names at all": lambda t, a: f"<table><tr><td>{links(7)}</td><td><h2>{t}</h2>" + "".join(f"<p>{p}</p>" for p in a) + f"</td><td><a href=/a>{prose(3)}</a> <a href=/b>{prose(4)}</a></td></tr></table>",
    "cut off": lambda t, a: f"<nav>{links(5)}</nav><article><h1>{t}</h1>" + "".join(f"<p>{p}</p>" for p in a) + "<p",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(spark, model, name):
    pages = [(k, prose(7), [prose(n) for n in sizes]) for k, sizes in enumerate(([60, 90, 45], [150, 30], [40, 12, 80, 20, 60], [300]))]
    df = spark.createDataFrame([(k, LAYOUTS[name](t, a)) for k, t, a in pages], "page_id long, html string")
    got = {r.page_id: r.text for r in m.main_text(df, model).collect()}
    for k, t, a in pages:
        assert got[k] == " ".join([t, *a]), name


def test_given_pages(spark, sf):
    got = {r.page_id: r for r in m.op12_main_text(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search("(?s)<article>(.*)</article>", r.html)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_odd_rows(spark, model):
    rows = [(1, None, "u"), (None, "", "u"), (2, "<p>", None), (3, "x" * 10, "u"), (3, "x" * 10, "u"), (4, "<article>" + "<p>a b c</p>" * 20_000, "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").withColumns({c: F.lit("z") for c in ("text", "blocks", "words", "place", "__blocks")})
    out = m.main_text(df, model)
    assert set(out.columns) == set(df.columns) - {"html"}
    got = sorted(((r.page_id, r.text) for r in out.collect()), key=repr)
    lone = next(t for k, t in got if k == 3)
    assert got == sorted([(1, ""), (None, ""), (2, ""), (3, lone), (3, lone), (4, " ".join(["a b c"] * 20_000))], key=repr)
    assert m.main_text(df.limit(0), model).count() == 0


def test_linear_time():
    def took(text):
        began = time.process_time()
        m.Cutter(text)
        return time.process_time() - began

    for part in ("<", "<p class='", "<!--", "<div>", "</section>", "&#", "<a href=x>", "<script>", "<p a=\"b\" c='", "</p"):
        small, large = (min(took(part * n) for _ in range(3)) for n in (20_000, 80_000))
        assert large < 12 * small + 0.05, part
