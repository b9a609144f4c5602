"""Page extraction goldens on hand-written HTML (boundary rows of FIXTURES section 5)."""

import difflib
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.operators import pages as P
from tidewatch.sources.html_blocks import parse_page, parsed_pages

HTML = (
    '<html><head><title> My  Page </title><script>var x="<p>no</p>";</script></head><body>'
    '<h2>Second</h2><h1>First</h1><h1>First</h1><h3>Third &amp; more</h3>'
    '<div>Plans from $9/mo</div><span>FEE waived</span><p>short</p><p>This paragraph is long enough to keep.</p>'
    '<ul><li>ab</li><li>abc</li><li>abc</li><li>Flat Rate pricing</li></ul>'
    '<article><h1></h1><h2>Good h2</h2></article><article><h2>Post two</h2></article>'
    '<div class="post-title">Classy title</div><div class="x Headline-big">Post two</div>'
    '<noscript><li>hidden item</li></noscript><p>one paragraph that is open<p>nested one inside it</p>'
    '</body></html>'
)


def _blocks(spark, html=HTML):
    return parsed_pages(spark.createDataFrame([(1, html)], "page_id long, html string"))


def _texts(df):
    return [r.text for r in df.orderBy("pos").collect()]


def test_headings_pricing_features(spark):
    b = _blocks(spark)
    assert _texts(P.headings(b)) == ["First", "Second", "Good h2", "Post two", "Third & more"]
    assert _texts(P.pricing_snippets(b)) == ["Plans from $9/mo", "FEE waived", "Flat Rate pricing"]
    assert _texts(P.feature_bullets(b)) == ["abc", "Flat Rate pricing"]


def test_article_titles_and_paragraphs(spark):
    b = _blocks(spark)
    # first article: h1 exists but is empty -> stop there; the class match repeating 'Post two' is skipped
    assert _texts(P.article_titles(b)) == ["Post two", "Classy title"]
    # no implied </p>: the open paragraph contains the nested one
    assert _texts(P.body_paragraphs(b)) == [
        "This paragraph is long enough to keep.", "one paragraph that is opennested one inside it", "nested one inside it"]


def test_page_text_and_title(spark):
    b = _blocks(spark)
    txt = P.page_text(b, "page").collect()[0].content_text
    assert txt == ("## TITLE\nMy Page\n## HEADINGS\nFirst\nSecond\nGood h2\nPost two\nThird & more\n"
                   "## PRICING\nPlans from $9/mo\nFEE waived\nFlat Rate pricing\n## FEATURES\nabc\nFlat Rate pricing")
    empty = parsed_pages(spark.createDataFrame([(2, "<html><body><p>x</p></body></html>")], "page_id long, html string"))
    assert P.page_text(empty, "updates").collect()[0].content_text == "## TITLE\n## HEADINGS\n## ARTICLE TITLES\n## BODY TEXT"


def test_paragraph_limits(spark):
    paras = "".join(f"<p>{'x' * (19 if i % 2 else 20)}{i:03d}</p>" for i in range(200))
    b = _blocks(spark, f"<html><body>{paras}</body></html>")
    got = _texts(P.body_paragraphs(b))
    want = []
    for i in range(180):
        t = f"{'x' * (19 if i % 2 else 20)}{i:03d}"
        if len(t) >= 20:
            want.append(t)
        if len(want) >= 60:
            break
    assert got == want


def test_diff_and_profile(spark):
    old, new = "a\nb\nc\nb", "a\nc\nd\nb\nb"
    df = spark.createDataFrame([("E0", "k", old, new, "changed")],
                               "entity string, page_key string, prev_text string, content_text string, status string")
    got = P.line_diff(df).collect()[0].diff
    want = "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), lineterm="", fromfile="previous", tofile="current"))
    assert got == want
    prof = P.diff_profile(df).collect()[0]
    added = Counter(new.splitlines()) - Counter(old.splitlines())
    removed = Counter(old.splitlines()) - Counter(new.splitlines())
    assert (prof.lines_added, prof.lines_removed) == (sum(added.values()), sum(removed.values()))


def test_compare_snapshots(spark):
    cur = spark.createDataFrame([("E0", "a", "x"), ("E0", "b", "y"), ("E1", "a", "z")],
                                "entity string, page_key string, content_text string")
    snap = spark.createDataFrame([("E0", "a", "x"), ("E0", "b", "old")], "entity string, page_key string, content_text string")
    got = {(r.entity, r.page_key): r.status for r in
           P.compare_snapshots(P.with_hash(cur), P.with_hash(snap)).collect()}
    assert got == {("E0", "a"): "unchanged", ("E0", "b"): "changed", ("E1", "a"): "baseline"}


def test_every_element_is_an_interval_of_the_text():
    html = "<div class='a b'>x<h1/><article><p>" + "long " * 100 + "</p></article>y<style>no</style></div>tail<p>z"
    title, text, elements = parse_page(html)
    assert title == "" and text == "x" + "long " * 100 + "yz"  # text outside of any element belongs to none
    got = [(e["ord"], e["until"], e["tag"], text[e["start"]:e["stop"]]) for e in elements]
    assert got == [(0, 4, "div", "x" + "long " * 100 + "y"), (1, 1, "h1", ""), (2, 3, "article", "long " * 100),
                   (3, 3, "p", "long " * 100), (5, 5, "p", "z")]
    deep = parse_page("<div>" * 3000 + "x" + "</div>" * 3000)
    assert len(deep[2]) == 3000 and deep[1] == "x"


def test_article_with_an_empty_self_closing_heading(spark):
    b = _blocks(spark, "<article><h1/><h2>Not this</h2></article><article><section><h3>Deep</h3></section></article><h1>outside</h1>")
    assert _texts(P.article_titles(b)) == ["Deep"]


def test_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<p>é中😀 " + "w " * 50 + "</p>"), (4, "<title>A<b>b</b></title><li>😀ab</li>")]
    parsed = parsed_pages(spark.createDataFrame(rows, "page_id long, html string"))
    got = {r.page_id: r.content_text for r in P.page_text(parsed, "updates").collect()}
    bare = "## TITLE\n## HEADINGS\n## ARTICLE TITLES\n## BODY TEXT"
    assert got == {1: bare, 2: bare, 3: bare + "\n" + ("é中😀 " + "w " * 50).strip(), 4: bare}
    assert [r.text for r in P.feature_bullets(parsed).collect()] == ["😀ab"]
    assert parsed_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0
