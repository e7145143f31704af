"""Hostile markup, names of elements around the article, and subtree counts against a plain count."""

import collections
import time

import pytest

from tallystone.llm import templates
from tallystone.llm.templates import page_text

NONE = frozenset()


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<i>" * 100_000 + "</b>" * 100_000, "<div>" * 100_000 + "deep", "<i>" * 50_000 + "<div></div>" * 50_000, "<a '\">" * 100_000, "<a" * 300_000 + ">", "<!-- " * 200_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000,
     "<ul><li>" + "<div>" * 50_000 + "<ul>" + "<div>" * 50_000 + "<li></li>" * 50_000],
)
def test_time_grows_with_the_length(page):
    began = time.time()
    page_text(page, frozenset({1}))
    templates.page_hashes(page)
    assert time.time() - began < 20  # quadratic work takes minutes


def test_depth_keeps_the_text():
    assert page_text("<div>" * 100_000 + "deep", NONE) == "deep"
    assert page_text("<article>" + "<p>a <b>b</b></p>" * 3 + "</article>", NONE) == "a b\n\na b\n\na b"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>one</p></article><div class="sidebar">x</div></div>', "one"),
        ('<body class="page no-sidebar"><main><p>one</p></main></body>', "one"),
        ('<div class="page no-sidebar"><main><p>one</p></main></div>', "one"),
        ('<div class="sidebar-layout"><article><p>one</p></article></div>', "one"),
        ('<article><h2 class="post-header">Title</h2><p>one</p><h3 class="comments-header">Comments</h3></article>', "Title\n\none"),
        ('<div class="comments"><article><p>c</p></article></div><article><p>one</p><p class="notice">n</p></article>', "one"),
        ('<div id="content" class="with-menu"><p>one</p></div><div class="main-menu">m</div>', "one"),
        ('<article><h1>Work</h1><p class="notice-period">Three months.</p><section id="search"><h2>Search</h2><p>How.</p></section><div class="social-history"><p>Past.</p></div></article>', "Work\n\nThree months.\n\nSearch\n\nHow.\n\nPast."),
        ('<main><h1>Big Title</h1><p>lead and lead</p><article>teaser</article></main>', "Big Title\n\nlead and lead\n\nteaser"),
        ('<main><h1>T</h1><article><p>a long article of many words</p></article></main>', "a long article of many words"),
        ('<article><div class="post-header"><h1>Title</h1></div><p>one</p><div class="share-buttons">s</div><div class="newsletterSignup">n</div><section id="comments">c</section></article>', "Title\n\none"),
        ("a < b and <c", "a < b and <c"),
        ('<p title="a > b">one</p><p title="odd>two</p><p>three</p>', "one\n\ntwo\n\nthree"),
        ("", ""),
    ],
)
def test_names_around_the_article(page, text):
    assert page_text(page, NONE) == text


def test_templates_by_a_plain_count(spark):
    """Groups of blocks go exactly where a count of each host's distinct pages says so; paragraphs stay."""
    rows, n = [], 0
    for host, size in (("a.org", 3), ("b.org", 12), ("c.org", 40), ("d.org", 1)):
        for i in range(size):
            parts = [f"<div>every {m} of {host}</div>" for m in (1, 2, 3, 5) if i % m == 0]
            own = f"<p>{host} own {i} {'words and ' * 12}</p><p>shared paragraph of {host}</p>"
            rows.append((n, f"https://{host}/{i}", f"<article>{own}{''.join(parts)}</article>"))
            n += 1
        rows.append((n, f"https://{host}/again", rows[-1][2]))  # a copy counts once
        n += 1
    blocks = lambda html: [x.split("</")[0].strip() for x in html.replace("<p>", "<div>").split("<div>")[1:]]
    seen = collections.defaultdict(set)
    for _, url, html in rows:
        for x in blocks(html):
            if x.startswith("every"):
                seen[url.split("/")[2], x].add(html)
    gone = {x for x, where in seen.items() if len(where) >= templates.MANY_PAGES}
    assert gone and len(gone) < len(seen)
    want = {i: "\n\n".join(x for x in blocks(html) if (url.split("/")[2], x) not in gone) for i, url, html in rows}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    assert {r.page_id: r.text for r in templates.extract(df).collect()} == want


SITE = """<html><body><div><a href="/">The Daily</a> All the news that fits, every day of the year</div><div><p>Our shop has a sale this week.</p><p>Come and see.</p></div>
<div><div><h1>{title}</h1><p>{first}</p><p>{second}</p><div>Written by our own reporters in the field</div></div></div>
<div><p>Printed on recycled paper.</p></div></body></html>"""


def test_banners_that_no_name_gives_away(spark):
    """No tag or name tells the site's blocks from the article: only their recurrence does."""
    shared = "A paragraph that several reports quote word for word, as they all tell of one and the same event."
    story = [(f"Title {i}", f"First words of report {i}, which go on for a while to make a paragraph of some length.", shared if i < 6 else f"Second words of report {i}.") for i in range(9)]
    rows = [(i, f"https://daily.example/{i}", SITE.format(title=t, first=a, second=b)) for i, (t, a, b) in enumerate(story)]
    got = {r.page_id: r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{t}\n\n{a}\n\n{b}" for i, (t, a, b) in enumerate(story)}
    alone = page_text(rows[0][2], NONE)
    assert "sale this week" in alone and "recycled" in alone and "own reporters" in alone


def test_copies_of_an_article_in_different_pages(spark):
    """The same article under four addresses, with other things around it, is no template."""
    body = "<div><p>" + "</p><p>".join(f"Sentence {i} of the article that is told at several addresses." for i in range(5)) + "</p></div>"
    rows = [(i, f"https://h.example/{i}", f"<body>{body}<div>Seen {i} times</div></body>") for i in range(6)]
    got = [r.text for r in templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert all(t.count("Sentence") == 5 for t in got)
