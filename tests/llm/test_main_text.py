import re
from html import unescape

import pytest

from llm.html_tree import parse
from llm.main_text import host_of, main_text, text_of

PLAIN = [
    ("<p>a<b>b<p>c</b>d", "ab\ncd"), ("<div class='ad'>x</div><p>y &am<i>p</i>; z&nbsp;&amp;q", "y &amp; z &q"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"), ("<p title='a>b'>t<br/>u</p><script>if(a<b)", "t u"),
    ("<article><h1>T</h1><section class=comments>no</section><p>x</article><footer>f", "T\nx"), ("plain <b", "plain"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<!-- c --><p>x<!-- unclosed <p>y", "x"), ("", ""), (" \n ", ""),
    ("<body class='no-sidebar'><main id=menu><p>kept</main></body>", "kept"), ("<p>a</i></div>b</p>", "ab"), ("<p hidden>a</p><p>b &lt;i&gt; &#233;", "b <i> é"),
    ("<nav>n</nav><header>h</header><aside>s</aside><form>f</form><style>p{}</style><div role=navigation>r</div>rest", "rest"),
]


@pytest.mark.parametrize("html,text", PLAIN)
def test_plain_pages(html, text):
    assert text_of(parse(html), set()) == text


WRAPPED = [
    ("<body><form id=aspnetForm action=x><nav>n</nav><article><h1>T</h1><p>kept</article><input></form>", "T\nkept"),
    ("<form role=form><div><p>All of a page without article tags.</p></div></form><form class=search>go</form>", "All of a page without article tags."),
    ("<div class='content with-sidebar'><p>whole text</p></div><div class=sidebar>s</div>", "whole text"),
    ("<div class='no-comments'><p>whole text</p></div><div class=comments>a much longer thread of reader comments</div>", "whole text"),
    ("<div class='menu-open'><p>whole text</p></div><div class='menu'><a href=x>a long list of links beside it</a></div>", "whole text"),
    ("<article class='post comments-open'><div class='entry widget'><p>whole text</p></div></article>", "whole text"),
    ("<article><p>story</p><article class='comment'>first</article><section id=comments><article>second</article></section></article>", "story"),
    ("<article><p>story</p></article><ol class=comments><li><article id='comment-7'>third</article></ol>", "story"),
    ("<main><p>story</p></main><article class=comment>fourth</article>", "story"),
    ("<p>a story without article tags</p><div class=comments><article>one of the readers wrote this long comment</article><article>and one that</article></div>", "a story without article tags"),
    ("<div id=comment><article><p>An opinion piece</p></article></div><p>more", "An opinion piece"),
    ("<div class='cookie-consent'>a notice that is longer than the text</div><p>short", "short"),
]


@pytest.mark.parametrize("html,text", WRAPPED)
def test_wrappers_and_comments(html, text):
    """Names on wrappers of the text, and comments marked up as articles."""
    assert text_of(parse(html), set()) == text


def test_long_and_deep_pages_end():
    assert text_of(parse("<div>" * 20_000 + "x" + "</p>" * 1000), set()) == "x"
    assert text_of(parse("<div class=menu><form>" * 10_000 + "x"), set()) == "x"
    assert text_of(parse("<a href=\"x" * 3000 + "<p>y"), set()) is not None
    assert len(text_of(parse("<p>" + "word " * 200_000), set())) == 999_999


def test_hosts():
    assert [host_of(u) for u in ("https://A.example.com:80/x", "http://u@b.example/?q", "no url", None, "")] == ["a.example.com", "b.example", "", "", ""]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text string, n_chars int")


@pytest.mark.parametrize("inline", [1000, 0])
def test_templates_of_a_host_go(spark, inline):
    """Furniture that nothing names: found by its recurrence on the host, and only there."""
    rows = [("http://a.example/", f"<div><p>Latest picks</p><p>Buy now</p></div><div><p>Story {i} of the day</p></div><p>Buy now</p>") for i in range(8)]
    rows += [("http://b.example/", "<div><p>Latest picks</p><p>Buy now</p></div><p>Once</p>")]
    rows += [("http://a.example/", "<article><p>Buy now</p><p>Copied article</p></article>")] * 8
    rows += [(None, None), ("bad url", "")]
    got = {r.page_id: r for r in main_text(pages(spark, rows), inline=inline).collect()}
    assert [got[i].text for i in range(8)] == [f"Story {i} of the day" for i in range(8)]
    assert got[8].text == "Latest picks\nBuy now\nOnce"
    assert all(got[i].text == "Buy now\nCopied article" for i in range(9, 17))
    assert got[17].text == got[18].text == "" and got[17].n_chars == 0 and len(got) == len(rows)
    assert main_text(pages(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("inline", [1000, 0])
def test_repeated_and_copied_pages_keep_their_text(spark, inline):
    """Pages without article tags: what recurs only because whole pages recur is no template."""
    menu = "<div><p>Latest picks</p><p><a href=x>Buy now</a></p></div>"
    rows = [("http://c.example/", f"{menu}<div class=content><p>Story {i} of the day</p><p>told at length</p></div>") for i in range(40)]
    rows += [("http://c.example/copy", f"{menu}<div class=content><p>One page that many rows repeat</p><p>whole</p></div>")] * 6
    rows += [(f"http://c.example/{i}", f"<!-- {i} -->{menu}<div class=content><p>Copied, each with a remark of its own</p></div>") for i in range(6)]
    rows += [("http://d.example/", "<div class=content><p>The only page there is</p></div>")] * 9
    rows += [("http://e.example/", f"<div>Same words on all</div><p><a href={i}>link {i}</a></p>") for i in range(9)]
    got = [r.text for r in sorted(main_text(pages(spark, rows), inline=inline).collect(), key=lambda r: r.page_id)]
    assert got[:40] == [f"Story {i} of the day" for i in range(40)]  # "told at length" recurs on forty pages that differ
    assert got[40:46] == ["One page that many rows repeat\nwhole"] * 6
    assert all("Copied, each with a remark of its own" in t for t in got[46:52])
    assert got[52:61] == ["The only page there is"] * 9
    assert all(t.startswith("Same words on all") for t in got[61:])


def test_pages_of_the_tables(spark):
    """The articles of the tables, read off by plain expressions."""
    import __spark_entry__ as e
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = e.queries()["op7_main_text"](spark, sf).collect()
    assert len(rows) == len(html)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", html[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
