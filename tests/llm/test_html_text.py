import html
import re
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tablewright.llm import html_text
from tablewright.llm import html_text as t

ARTICLE = "<article><h1>A &amp; B</h1><p>First   paragraph\n of the <a href=x>text</a> &#8212; caf&eacute;.<p>Short.</p><ul><li>one item<li>two items</ul></article>"
KEPT = "A & B\n\nFirst paragraph of the text — café.\n\nShort.\n\none item\n\ntwo items"


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav>{}<footer>&copy; All rights reserved by the owner of this page</footer></body></html>",
        "<header><h1>Site name</h1></header><div class='ad'>Buy now, this is a long advertisement with a good many words in it to look like text.</div>{}",
        "{}<section id=comments><p>What a great article, I have read it three times and will read it again tomorrow.</p></section>",
        "<aside><p>Sidebar with a rather long text about other things that nobody asked to read here.</p></aside>{}<form>Name <input name=x> <button>Send</button></form>",
        "<script>var t='</p><article>';</script>{}<!-- <article><p>hidden</p></article> -->",
        "<div class=\"cookie-notice\" role='dialog'>We use cookies on this page to make it better for you and everyone else.</div>{}<div style='display: none'>hidden words</div>",
    ],
)
def test_article_is_kept_and_furniture_dropped(around):
    assert html_text.main_text(around.format(ARTICLE)) == KEPT


def test_furniture_inside_the_article():
    page = ARTICLE.replace("<p>Short.</p>", "<div class='share'>Share this</div><p>Short.</p><aside>Read more here about this</aside><div class=comments>Nice one, thanks a lot for it</div>")
    assert html_text.main_text(page) == KEPT


def test_pages_without_an_article():
    long = "This paragraph has quite a number of words so that it looks like running text to any reader."
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h1>Heading of it</h1><p>{long}</p><p>{long}</p><div><a href=c>Privacy</a></div></body>"
    assert html_text.main_text(page) == f"Heading of it\n\n{long}\n\n{long}"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "<p>" * 5000, "</div>" * 100, "<a href='x>", "&#0;&#xD800;&#99999999;"])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page), str)


def test_stray_end_tags_do_not_end_the_article():
    assert html_text.main_text("<body><article><p>One thing</div></section></p><p>Another thing</article><p>Outside of the article</p>") == "One thing\n\nAnother thing"


def test_breaks():
    assert html_text.main_text("<article><p>a<br>b<br><br>c &nbsp; d</p></article>") == "a b\n\nc d"


def test_table(spark):
    rows = [(1, "u", f"<body>{ARTICLE}</body>", "old"), (2, None, None, "old"), (3, "u", "<p>x", "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert got[1] == (KEPT, len(KEPT)) and got[2] == ("", 0)
    assert html_text.digest(df).columns == ["page_id", "url", "text", "n_chars"]
    assert html_text.digest(df.limit(0)).count() == 0


def test_tree_classifies_its_own_table():
    rows = [[float(v) for v in line.split()] for line in html_text.LABELLED.strip().splitlines()]
    assert all(html_text.classify(html_text.TREE, html_text.features(*r[:-1])) == r[-1] for r in rows)


def article_by_brute_force(page):
    """Blocks of a page of the test tables, whose articles hold only h1, p, b and br."""
    inside = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>(?=<br>)", inside.replace("<br>", " ")))
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_tables_against_brute_force():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    assert [t.main_text(p) for p in pages] == [article_by_brute_force(p) for p in pages]


def test_words_and_links_alone_tell_most_blocks():
    """With every element and attribute that names a part of the page made a plain div, the tree has only words and
    link densities of a block and its neighbours."""
    right = kept = wanted = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        whole = article_by_brute_force(page).split("\n\n")
        flat = re.sub(r"\sclass=\"[^\"]*\"", "", re.sub(r"<(/?)(?:nav|article|footer|h1)>", r"<\1div>", page))
        found = t.main_text(flat).split("\n\n")
        right += sum((Counter(whole) & Counter(found)).values())
        kept, wanted = kept + len(found), wanted + len(whole)
    assert right / kept > 0.88 and right / wanted > 0.88


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "x ' * 170_000, '<a "x ' * 170_000 + ">", "<div>" * 100_000 + "</p>" * 150_000, "<svg>" * 200_000, "<div><article>" + "<span class=ad>" * 50_000 + "</div>" * 50_000, "<p " + "id=" * 300_000 + '"x>a', "<!-- " * 200_000, "&#" + "9" * 10_000 + ";", "<" * 1_000_000])
def test_long_broken_pages_are_read_in_one_pass(page):
    start = time.process_time()
    t.main_text(page)
    assert time.process_time() - start < 1


def test_clashing_columns(spark):
    rows = [(1, "u", "<p>" + "word " * 60 + "</p>", "old", 5, "r", 2.0), (None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, row string, `a.b` double")
    out = t.extract(pages)
    assert out.columns == ["page_id", "url", "html", "row", "a.b", "text", "n_chars"]
    assert sorted((r["n_chars"], r["row"], r["a.b"]) for r in out.collect() if r["row"]) == [(299, "r", 2.0)] and out.where("text = ''").count() == 1
