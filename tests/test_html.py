"""HTML to Markdown: the parser, and the expressions against it."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions.html import html_to_markdown

SIMPLE = [
    ("<p>Just text.</p>", "Just text.\n"),
    ("<h1>Chapter 1</h1><p>Hello world.</p>", "# Chapter 1\nHello world.\n"),
    ("<h2> A  b\n c </h2>", "## A b c \n"),
    ("<p>a</p>\n\n<p>b</p>", "a\nb\n"),
    ("<p><b>Bold</b> and <em>soft</em></p>", "**Bold** and _soft_\n"),
    ("<b> in </b>word", "**in** word\n"),
    ("a<br>b<br/>c", "a  \nb  \nc\n"),
    ("x<hr>y", "x\n* * *\ny\n"),
    ("<ul><li>a</li><li>b</li></ul><p>c</p>", "  * a\n  * b\n\n\nc\n"),
    ('<a href="/x">t</a>', "[t](/x)\n"),
    ('<a href="#x">t</a>', "t\n"),
    ('<p><img src="../i/c.png" alt="Cover"/></p>', "![Cover](../i/c.png)\n"),
    ('<img src="c.png">', "![](c.png)\n"),
    ("<script>var t='</p>';</script><style>p{}</style>a<!-- no -->b", "ab\n"),
    ("<html><head><title>T</title></head><body>b</body></html>", "b\n"),
    ("a &amp; b &lt;i&gt; &copy; &middot; &quot;q&quot; &amp", "a & b <i> © · \"q\" &\n"),
    ("<p>1. one</p><p>- two</p><p>+ three</p>", "1\\. one\n\\- two\n\\+ three\n"),
    ("<p>use <code>f(x)</code> or <del>y</del></p>", "use `f(x)` or ~~y~~\n"),
    ("<p>a<b>b<p>c", "a**b\nc\n"),
    ("<p>say<em>x</em> (<em>y</em>) 1<em>z</em></p>", "say _x_ (_y_) 1 _z_\n"),
    ("<p>t</p><ul> <li> <p>a</p> </li> <li>b </li> </ul> <br> c", "t\n  * a\n  * b \n\n  \nc\n"),
    ("text</footer></html>\n", "text\n"),
    ("", "\n"),
]

NESTED = [
    ("<ul><li>x<ul><li>y</li></ul></li><li>z</li></ul>", "  * x\n    * y\n  * z\n\n\n"),
    ("<ol start=3><li><p>x</p></li><li>y</li></ol>", "  3. x\n  4. y\n\n\n"),
    ("<blockquote><p>a</p><p>b</p></blockquote><p>c</p>", "> a\n> b\nc\n"),
    ("<pre>a\n  b</pre><p>c</p>", "\n    a\n      b\nc\n"),
    ("<pre><code>x = 1\ny</code></pre>", "\n    x = 1\n    y\n"),
    ("<code>a\\*<b>b</b>\\*</code>\\*", "`a\\* **b** \\*`\\\\*\n"),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>",
     "a| b  \n---|---  \n1| 2  \n"),
    ("<a href='http://a.b/c'>http://a.b/c</a>", "<http://a.b/c>\n"),
    ("<a href='x(1)' title='T'>y</a>", '[y](x\\(1\\) "T")\n'),
    ("<a href='z'><img src='p.png' alt='q'></a>", "[![q](p.png)](z)\n"),
    ("<a href='z'></a>", "[](z)\n"),
    ("word<i>x</i>", "word _x_\n"),
    ("a&nbsp;b", "a\u00a0b\n"),
    ("<dl><dt>t</dt><dd>d</dd></dl>", "t\n    d\n"),
    ("<q>said</q>", '"said"\n'),
    ("<p>unclosed <b>bold <i>both", "unclosed **bold _both\n"),
    ("<head><p>never closed<body><p>seen", "seen\n"),
    ("</b></ul></a></blockquote></li>x", None),
]


@pytest.mark.parametrize("html, md", SIMPLE + NESTED)
def test_parser(html, md):
    result = html_to_markdown(html)
    assert result.endswith("\n")
    if md is not None and not html.startswith("<table"):
        assert result == md
    if html.startswith("<table"):
        assert result.rstrip() == md.rstrip()


def test_expressions_give_the_same_for_simple_markup(spark):
    frame = spark.createDataFrame(SIMPLE, "html string, md string")
    rows = frame.select("html", "md", markup.html_to_markdown(F.col("html")).alias("got")).collect()
    assert [(r["html"], r["got"]) for r in rows] == [(r["html"], r["md"]) for r in rows]


def test_expressions_and_parser_agree_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("html", markup.html_to_markdown(F.col("html")).alias("md")).collect()
    assert all(html_to_markdown(row["html"]) == row["md"] for row in rows)


def test_no_python_in_the_expression_form(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = pages.select(markup.html_to_markdown(F.col("html")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "InArrow" not in text


@pytest.mark.parametrize("html", [
    '<a href="u"><b>x</b></a>', "<a href='u'>x</a>", "<P>A</P><P>B</P>", "<p>&eacute;&mdash;</p>",
    "<p>&#8217;</p>", "<ol><li>a</li></ol>", '<img alt="t" src="i.png">', "<pre>a\n b</pre>",
    "<table><tr><td>1</td></tr></table>", "<ul><li>a<ul><li>b</li></ul></li></ul>",
    "<blockquote>q</blockquote>", '<a href="u" title="t">x</a>', "<p>1 < 2</p>", "<b><i>x</i></b>",
    '<img src="i.png" alt="(x)">', "<p>\\*</p>", "<p>\x02</p>", "<!-- never closed"])
def test_markup_that_the_expressions_do_not_cover_is_null(spark, html):
    frame = spark.createDataFrame([(html,)], "html string")
    assert frame.select(markup.html_to_markdown(F.col("html"))).first()[0] is None


def random_page(draw):
    def text():
        return " ".join(draw.choice(["one", "Two", "AT&amp;T", "&lt;t&gt;", "a.b", "end.", "(in)", "7"])
                        for _ in range(draw.randint(1, 4)))

    def inline():
        tag = draw.choice(["b", "strong", "em", "i", "u", "del", "code"])
        return draw.choice([
            text(), text(), f"<{tag}>{text()}</{tag}>", f"<{tag}><br>{text()}</{tag}>", "<br>",
            f'<a href="http://h/1">{text()}</a>', f'<img src="p.png" alt="{text()}">',
            f'<span class="c">{text()}</span>', f"<b>{text()}</b><i>{text()}</i>"])

    def block():
        body = draw.choice([" ", "", "\n"]).join(inline() for _ in range(draw.randint(1, 4)))
        items = "".join(f"<li>{text()}</li>" for _ in range(draw.randint(1, 3)))
        return draw.choice([
            f"<p>{body}</p>", f"<p>{body}</p>", f"<h2>{text()}</h2>", f"<ul>{items}</ul>", "<hr>",
            f'<div class="d">{body}</div>', "<!-- c -->", f"<ol>{items}</ol>", f"<P>{body}</P>"])

    return draw.choice(["", "\n", " "]).join(block() for _ in range(draw.randint(1, 4)))


def test_expressions_give_the_text_of_the_parser_or_null(spark):
    draw = random.Random(11)
    pages = [random_page(draw) for _ in range(3000)]
    frame = spark.createDataFrame([(page,) for page in pages], "html string")
    rows = frame.select("html", markup.html_to_markdown(F.col("html")).alias("md")).collect()
    covered = [row for row in rows if row["md"] is not None]
    assert len(covered) > 800
    assert [r["html"] for r in covered if html_to_markdown(r["html"]) != r["md"]] == []
