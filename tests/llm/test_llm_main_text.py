"""Main texts of planted pages, of broken ones, and of the given table."""

import html as entities
import re
import time

import numpy as np
import pytest

import __spark_entry__ as entry
from alignframe.llm.maintext import extract, main_text, smoothed

PARAGRAPHS = [
    "The first paragraph tells at some length what happened, when it did and who was there to see it.",
    "Short one.",
    "A third one with <a href='/x'>a link in it</a>, a <b>bold</b> word &amp; an entity, long enough to be read as prose.",
    "The last paragraph ends the story with as many words as a last paragraph may be expected to have.",
]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = "\n\n".join(["A title", *(re.sub("<[^>]*>", "", p).replace("&amp;", "&") for p in PARAGRAPHS)])
AROUND = {
    "menu": "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>",
    "unnamed menu": "<div><ul><li><a href=/a>Home page</a></li><li><a href=/b>All the news</a></li></ul></div>",
    "header": "<header><h1>The name of the site</h1><p>Its motto, which is as long as any sentence of prose could be.</p></header>",
    "named header": '<div id="masthead"><p>Its motto, which is as long as any sentence of prose could be.</p></div>',
    "sidebar": '<aside><h2>More</h2><p>Something else that readers of this page might want to read as well.</p></aside>',
    "named sidebar": '<div class="left-sidebar"><p>Something else that readers of this page might want to read.</p></div>',
    "notice": '<div class="cookie-notice"><p>This site uses cookies and says so in a sentence of some length.</p></div>',
    "advert": '<div class="ad">Buy this thing now, for it is a thing that everybody ought to have bought.</div>',
    "form": "<form><p>Tell us your address and we shall write to you about all that is new.</p><input><button>Go</button></form>",
    "script": '<script>var t="</p><p>not text";</script><style>p{margin:0}</style><noscript>Turn it on, please.</noscript><!-- <p>no</p> -->',
    "comments": '<section id="comments"><div class="comment"><p>I was there too and it was not like that at all, I can tell you.</p></div></section>',
    "footer": "<footer><p>&copy; The owners of this site, who keep all of their rights in every country.</p></footer>",
    "hidden": '<div style="display: none"><p>A text that nobody sees, though it is as long as any other.</p></div>',
}
FRAMES = {
    "article": "<article><h1>A title</h1>{}</article>",
    "article header": "<article><header><h1>A title</h1><p class=byline>By one of us</p></header>{}</article>",
    "main": "<main><h1>A title</h1>{}</main>",
    "named": '<div id="content" class="col-8"><h1>A title</h1>{}</div>',
    "plain": "<div class=x7><h1>A title</h1>{}</div>",
    "heading outside": "<h1>A title</h1><div>{}</div>",
}


@pytest.mark.parametrize("frame", sorted(FRAMES))
@pytest.mark.parametrize("around", [*sorted(AROUND), "all"])
def test_article_without_its_surroundings(frame, around):
    parts = list(AROUND.values()) if around == "all" else [AROUND[around]]
    article = FRAMES[frame].format(BODY)
    for before, after in ((parts, []), ([], parts)):
        page = f"<!DOCTYPE html><html><head><title>No</title></head><body class='has-sidebar'>{''.join(before)}{article}{''.join(after)}</body></html>"
        assert extract(page) == TEXT
        assert extract(page.replace("><", ">\n<")) == TEXT


def test_inside_an_article(spark):
    inner = AROUND["advert"] + AROUND["form"] + AROUND["comments"] + AROUND["sidebar"] + AROUND["script"]
    assert extract(f"<article><h1>A title</h1>{BODY}{inner}</article>") == TEXT
    lists = "<article><h1>T</h1><ul><li>one<li>two <ul><li>three</ul></ul><table><tr><td>a<td>b</table><blockquote>q<br>r</blockquote><pre>s\n t</pre></article>"
    assert extract(lists).split("\n\n") == ["T", "one", "two", "three", "a b", "q r", "s t"]


def test_broken_pages():
    assert extract(None) == extract("") == extract(" \n ") == extract("<script>var a") == extract("<!-- open") == extract("<p") == ""
    assert extract("just text &lt;") == "just text <" and extract("<p>a<p>b") == "a\n\nb" and extract("a < b") == "a < b"
    assert extract("<article><p><b>x<br><p>y</b> z</div></article>") == "x\n\ny z"
    assert extract("<form id=all><article><p>in a form</article></form>") == "in a form"
    assert extract("<nav><ul><li><a>menu</a></ul><article><p>after an open menu</article>") == "after an open menu"
    assert extract("<aside><article><p>teaser</article></aside><p>real") == "real"
    assert extract("<p>&#128512; &nbsp; &eacute;&unknown; x</p>") == "😀 é&unknown; x"
    started = time.time()
    assert len(extract("<p>" + "word " * 600_000)) == 3_000_000 - 1
    for page in ("<" * 100_000, "<div>" * 20_000 + "x", "<p><b>a" * 20_000, "&" * 100_000):
        extract(page)
    assert time.time() - started < 60


def test_smoothing_keeps_level_and_sum_of_weights():
    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0) and np.allclose(smoothed(np.array([5.0])), 5.0)
    out = smoothed(np.array([0.0, 0, 9, 0, 0]))
    assert out.argmax() == 2 and out[1] == out[3] > out[0] > 0


def test_tables(spark):
    rows = [(1, "u", "<p>a b", "old"), (1, "u", "<p>a b", "old"), (None, None, None, None), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [(1, "u", "a b", 3)] * 2 + [(None, None, "", 0), (2, "v", "", 0)]))
    assert main_text(pages.limit(0)).count() == 0


def test_query_over_all_pages(spark, tiny):
    """The given pages mark their article and leave tags open in it."""
    want = {}
    for r in spark.read.parquet(f"{tiny}/pages.parquet").collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        text = "\n\n".join(b for b in blocks if b)
        want[r["page_id"]] = (r["url"], text, len(text))
    got = entry.queries()["op13_main_text"](spark, tiny).collect()
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got} == want and len(got) == len(want)
