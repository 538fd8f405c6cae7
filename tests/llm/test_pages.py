import random

import pytest

from bundlewise.llm import pages

from .helpers import SF, crowded

PAGE = "page_id bigint, url string, html string"


def whole(spark, rows):
    return {r["page_id"]: r["text"] for r in pages.extract(crowded(spark.createDataFrame(rows, PAGE)).repartition(3)).collect()}


def test_blocks_of_awkward_markup():
    html = """<html><head><title>t</title><style>p{}</style></head><body><!-- <p>no</p> --><header><h1>Site</h1></header>
    <nav><ul><li>m</ul></nav><div id="cookie-notice">We use</div><main><article><header><h1>A &amp; B</h1></header><script>var x="</p>";</script>
    <p>one <b>two</b><br>three<p>four&nbsp;&#x41;<aside>no</aside><ul><li>i<li>j</ul><div class="ad-box">no</div><form>no<input></form>
    <table><tr><td>c<td>d</table></article><section class="comments"><p>no</p></section></main><footer>no"""
    assert pages.main_text(pages.blocks(html), set()) == "A & B\none two three\nfour A\ni\nj\nc\nd"


@pytest.mark.parametrize("seed", range(30))
def test_alignment_is_a_longest_one(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randint(0, 14))] for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    found = sorted(pages.shared_lines(a, b))
    assert len(found) == best[-1][-1]
    at = iter(b)  # and it is a common one
    assert all(a[i] in at for i in found)


def page(n, body):
    return f"<html><body><div><p>Home and more</p><p>Latest stories of the day</p></div><div>{body}</div><div><p>All rights reserved</p></div></body></html>"


def test_shared_lines_go_where_nothing_marks_the_article(spark):
    rows = [(i, f"http://h{i % 2}.org/news/{i}", page(i, f"<p>story {i}</p><p>more of {i}</p>")) for i in range(40)]
    rows.append((99, "http://alone.org/", page(99, "<p>only</p>")))
    got = whole(spark, rows)
    assert all(got[i] == f"story {i}\nmore of {i}" for i in range(40))
    assert got[99] == "Home and more\nLatest stories of the day\nonly\nAll rights reserved"


def test_copies_of_an_article_stay(spark):
    article = "<article><h1>T</h1><p>body</p></article>"
    rows = [(i, f"http://h.org/a/{i}", f"<nav>menu</nav>{article}<footer>f</footer>") for i in range(6)]
    assert set(whole(spark, rows).values()) == {"T\nbody"}


def test_odd_pages(spark):
    rows = [(1, "http://h.org/a", None), (2, None, "<p>x  y</p>"), (3, "", ""), (None, "http://h.org/b", "<p>z"), (4, "not a url", "plain &lt;text"), (4, "not a url", "plain &lt;text")]
    rows.append((5, "http://h.org/c", "<p>" + "long " * 50_000 + "</p>"))
    got = pages.extract(spark.createDataFrame(rows, PAGE)).collect()
    assert len(got) == 7
    assert sorted((str(r["page_id"]), r["text"][:12]) for r in got) == [
        ("1", ""), ("2", "x y"), ("3", ""), ("4", "plain <text"), ("4", "plain <text"), ("5", "long long lo"), ("None", "z")]
    assert pages.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_given_pages(spark):
    import html
    import re

    given = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in given.collect():
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"] or "", re.S)
        lines = [re.sub(r"<[^>]*>", "", x) for x in re.split(r"</?(?:p|h1)>|<br>", m[1])] if m else []
        want[r["page_id"]] = [x for x in (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in lines) if x]
    got = {r["page_id"]: r["text"].split("\n") if r["text"] else [] for r in pages.extract(given).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar wide", "layout side", "comments-open", "side-effects", "with-ads"])
def test_layout_classes_are_no_boilerplate(name):
    for html in (f'<div class="{name}"><article><p>a</p></article></div>', f'<article><section class="{name}"><p>a</p></section></article>'):
        assert pages.main_text(pages.blocks(html), set()) == "a"


def test_an_article_resets_the_mark_of_its_container():
    text = lambda html: pages.main_text(pages.blocks(html), set())
    assert text('<div class="sidebar"><p>no</p><article><p>a</p></article><main>b</main><div role="main">c</div><p>no</p></div>') == "a\nb\nc"
    assert text('<aside><article>no</article></aside><div class="comments"><article id="comment-1">no</article></div><article>a</article>') == "a"
    for name in ("sidebar", "ad-300x250", "site-footer", "x cookie-notice", "widget_area", "comments", "related-posts"):
        assert text(f'<article><p>a</p><div class="{name}"><p>no</p></div></article>') == "a"


def test_a_marked_teaser_does_not_stand_for_the_page(spark):
    rows = [(i, f"http://h.org/n/{i}", page(i, f"<p>story {i}</p><article>card</article><p>more of {i}</p><nav>menu {i}</nav>")) for i in range(12)]
    assert all(t == f"story {i}\ncard\nmore of {i}" for i, t in whole(spark, rows).items())


@pytest.mark.parametrize("parts", [1, 4])
def test_pages_of_one_path_find_a_partner(spark, parts):
    if parts > 1:  # runs of one address that fill tasks
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, f"http://q.org/view.php?id={i}", page(i, f"<p>story {i}</p>")) for i in range(9)]
        rows += [(100 + i, "http://r.org/a", page(i, f"<p>capture {i}</p>")) for i in range(30)]
        rows += [(200, "http://r.org/b", page(0, "<p>next</p>")), (300, "http://s.org/only", "<p>x</p>"), (301, "http://s.org/only#top", "<p>x</p>")]
        got = whole(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(got[i] == f"story {i}" for i in range(9)) and all(got[100 + i] == f"capture {i}" for i in range(30))
    assert got[200] == "next" and got[300] == got[301] == "x"


COMMENT_LISTS = (
    "reader-comments user-comments wp-block-comments disqus_thread comments-area comment-list commentlist fb-comments post-comments "
    "article__comments readerComments comments-section comment-thread story-related entry-replies comments_area_outer my-comments-2 "
    "site-recommended comment-respond user_reply"
)


@pytest.mark.parametrize("name", COMMENT_LISTS.split())
def test_reader_comments_go_by_whatever_name(name):
    for html in (f'<article><p>a</p></article><section class="{name}"><p>no</p></section>', f'<article><p>a</p><div id="{name}"><article>no</article></div></article>'):
        assert pages.main_text(pages.blocks(html), set()) == "a"
    assert pages.main_text(pages.blocks('<article><p>a</p><div itemprop="comment"><p>no</p></div></article>'), set()) == "a"


NO_LISTS = (
    "has-comments no-comments with-related category-recommended tag-trending comments-open comments-closed allow-comments "
    "commentary comments-count type-reply related-work comment-on-law trending-now-style not-trending"
)


@pytest.mark.parametrize("name", NO_LISTS.split())
def test_what_only_mentions_comments_stays(name):
    assert pages.main_text(pages.blocks(f'<article class="{name}"><p>a</p><div class="{name}"><p>b</p></div></article>'), set()) == "a\nb"
