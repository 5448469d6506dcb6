import os

import pytest

from helixframe.llm import html_text as H


def text(page, host="h"):
    return "\n\n".join(H.reduced(page, host).texts)


def test_article_alone_is_kept():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></ul></nav>'
        '<div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One<br>two <i>three</i>\n four<p>Five</p><div class="ad-box">Buy</div>'
        "<section id=comments><p>nice</p></section></article><aside>side</aside><footer>&copy; f</footer></body></html>"
    )
    assert text(page) == "Head & line\n\nOne two three four\n\nFive"


def test_unmarked_pages_lose_what_is_marked_otherwise():
    page = '<div id="site-header">Top</div><div class="cookieNotice">We use</div><form>Mail</form><div role=navigation>a b</div><p>Main &lt;text&gt;</p><table><tr><td>a<td>b</table><div class="post">Rest'
    assert text(page) == "Main <text>\n\na\n\nb\n\nRest"


def test_broken_pages():
    for page in ("", "<", "<p", "a < b & c &am", "<!-- x", "<p>a</p></div></p>b", '<a href="x>y', "<p>a<script>b", "</p>", "<b>" * 3000 + "x"):
        text(page)
    assert text("a < b & c &amp d") == "a < b & c & d"
    assert text('<p title="1>0">x</p>') == "x"


def test_quoted_values_of_any_length_and_with_the_other_quote():
    for n in (10, 4_000, 5_000, 100_000):
        assert text(f'<p data-x="{"y" * n} > tail">text</p>') == "text"
        assert text(f"<p data-x='{'y > ' * n}' title = \"it's > 3\" id=a>text</p>") == "text"
    assert text('<p title="it\'s > 3">a</p><p title=\'say "x > y"\'>b</p><p title=it\'s>c</p>') == "a\n\nb\n\nc"
    assert text('<a href="x>y</a>') == "y" and text("<p a=>x</p><p =b/c=d / >y</p>") == "x\n\ny"
    assert text("<a " + "b='c' d " * 50_000) == "" and text("<a b='c' " + " " * 200_000 + "=" * 200_000) == ""


def test_long_page_takes_linear_time():
    assert len(text("<article>" + "<p>word word" * 60_000)) > 600_000
    text('<a b="' * 20_000)


def test_dropped_inline_elements_leave_their_block_whole():
    assert text("<article><p>One <button>Buy<div>now</div></button> two <b>three</b></p></article>") == "One\n\ntwo three"
    assert text('<p>One <span class="ad">Buy</span>two') == "One two"


def test_deep_and_stray_tags_take_linear_time():
    import time

    start = time.monotonic()
    assert len(H.reduced("<div>x" * 40_000, "h").trees) == 40_000
    for page in ("<div>" * 40_000 + "x" + "</i>" * 40_000, "<div><article>" + "<b>" * 40_000 + "</div>" * 40_000, "<ul>" + "<b>" * 40_000 + "<li>x" * 40_000):
        text(page)
    assert time.monotonic() - start < 30


def brute(pages, least=5):
    """The texts by plain dictionaries over all pages."""
    from collections import defaultdict

    found = [(H.host_of(url), *H.parse(page or "", H.host_of(url))) for _, url, page in pages]
    reduced = [H.reduced(page or "", H.host_of(url)) for _, url, page in pages]
    families, seen = defaultdict(set), defaultdict(set)
    for (host, _, trees), r in zip(found, reduced, strict=True):
        if host:
            families[host].add(r.family)
            for t in {x["tree"] for x in (*r.trees, *r.elsewhere)}:
                seen[host, t].add((r.family, r.digest))
    different = lambda x: len({f for f, _ in x})
    hit = {t for (host, t), x in seen.items() if different(x) >= max(least, len(families[host]) ** 0.5, len(x) / 2)}
    gone = [{i for t in r.trees if t["tree"] in hit for i in range(t["first"], t["last"])} for r in reduced]
    return ["\n\n".join(x for i, x in enumerate(r.texts) if i not in g) for r, g in zip(reduced, gone, strict=True)], sum(map(len, gone))


def article_site(n):
    """Pages with and without an article mark, boxes in and out of it, near copies, and a passage that many pages quote."""
    box = '<div class="more-inside">Subscribe to our letters</div>'
    quote = "<p>As the old saying goes, all that glitters is not gold.</p>"
    same = "".join(f"<p>Same text {j} of all.</p>" for j in range(12))
    pages = []
    for i in range(n):
        body = f"<h1>Title {i}</h1><p>Paragraph {i} one.</p>{quote}<p>Paragraph {i} two.</p>"
        menu = "<div class=plainmenu><p>Home</p><p>News</p></div>"
        if i % 3 == 0:
            pages.append((i, f"http://a.example/{i}", f"{menu}<article>{body}{box}</article><div>Outside {i}</div>"))
        elif i % 3 == 1:
            pages.append((i, f"http://a.example/{i}", f"{menu}<div>{body}</div>{box}"))
        else:  # near copies, which hold one box that no other page has
            pages.append((i, f"http://b.example/{i}", f"<article><h1>Same</h1>{same}<p>Copy {i}.</p><div class=fact>The only box</div></article>"))
    return pages


def test_pages_with_article_and_template_against_brute_force(spark):
    pages = article_site(60)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.main_text(df).collect()}
    want, n = brute(pages)
    assert got == dict(enumerate(want)) and n > 0
    saying = "As the old saying goes, all that glitters is not gold."
    assert got[0] == f"Title 0\n\nParagraph 0 one.\n\n{saying}\n\nParagraph 0 two."  # the box goes, the quoted passage stays
    assert "The only box" in got[2]  # near copies don't make a template
    assert got[1].startswith("Title 1") and "Home" not in got[1] and "Subscribe" not in got[1]
    counts = H.removed(df).first()
    assert counts["pages"] == 60 and counts["by_count"] == n and counts["by_rule"] >= counts["by_both"] > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no sample data")
def test_sample_pages_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want, _ = brute([tuple(r) for r in df.select("page_id", "url", "html").collect()])
    assert sorted(r["text"] for r in H.main_text(df).collect()) == sorted(want)


def site(spark, pages):
    return spark.createDataFrame([(i, f"http://{h}/p{i}", page) for i, (h, page) in enumerate(pages)], "page_id bigint, url string, html string")


def test_recurring_subtrees_of_a_host_are_removed(spark):
    strip = "<div class=strip>Read more on our site</div>"
    pages = [("one.example", f"<div>Text {i} of its own</div>{strip}") for i in range(20)] + [("two.example", f"<div>Only {i}</div>{strip}") for i in range(3)]
    # Copies of one article count once, so that they are no template.
    pages += [("three.example", "<div>Copied article</div>")] * 12
    got = {r["page_id"]: r["text"] for r in H.main_text(site(spark, pages)).collect()}
    assert got[0] == "Text 0 of its own" and got[21] == "Only 1\n\nRead more on our site" and got[25] == "Copied article"
    assert len(got) == len(pages)


def test_boxes_of_a_large_host_are_removed(spark):
    # Each section's box is on a twentieth of 3,000 pages; a sentence of the text that 20 pages share stays.
    box = lambda i: f"<div class=box>Read more in section {i % 20}</div>"
    shared = lambda i: "<p>As said before.</p>" if i < 20 else ""
    pages = [("large.example", f"<div><p>Text {i} of its own</p>{shared(i)}</div>{box(i)}") for i in range(3000)]
    got = {r["page_id"]: r["text"] for r in H.main_text(site(spark, pages)).collect()}
    assert got == {i: f"Text {i} of its own" + ("\n\nAs said before." if i < 20 else "") for i in range(3000)}


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, 1), (1, None, "<p>a", 2), (2, "x", "", 3), (2, "x", "", 3), (None, "http://h/", "<p>b", 4)], "page_id bigint, url string, html string, row int")
    for name in ("host", "family", "texts", "trees", "cut", "digest"):
        df = df.selectExpr("*", f"1 AS {name}")
    assert sorted(r["text"] for r in H.main_text(df).collect()) == ["", "", "", "a", "b"]
    assert H.main_text(df.limit(0)).collect() == []
