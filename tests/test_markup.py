import pytest
from pyspark.sql import functions as F

from lodestone.functions.markup import Attr, Selector, select
from lodestone.operators import acquisition

#: A page that meets the selector at the same place, and one that nearly does.
LINKS = [
    ('<a data-track-action="Download PDF" href=/m>x</a>', '<a data-track-action="Download PDF now" href=/m>x</a>'),
    ("<a data-track-action='pdf DOWNLOAD' href=/m>x</a>", '<b data-track-action="pdf download"><a href=/m>x</a></b>'),
    ('<a href=/m data-article-url="/x.pdf">x</a>', '<a href=/m data-article-url="/x.PDF">x</a>'),
    ('<a href="/m.pdf">x</a>', '<a href="/m.pdf#page">x</a>'),
    ('<a href="/pdf/doi/m">x</a>', '<a href="/pd/doi/m">x</a>'),
    ('<a href="/pdf/m">x</a>', '<a href="/PDF/m">x</a>'),
    ('<a title="DOWNLOAD pdf" href=/m>x</a>', '<a title="Download the PDF" href=/m>x</a>'),
    ('<a title=pdf href=/m>x</a>', '<a title="PDF of it" href=/m>x</a>'),
    ('<a aria-label="Now download PDF here" href=/m>x</a>', '<a aria-label="Download" href=/m>x</a>'),
    ('<a aria-label="a pdf" href=/m>x</a>', '<a aria-label="" href=/m>x</a>'),
    ('<div class="u c-pdf-download v"><p><b><a href=/m>x</a></b></div>', '<div class="c-pdf-download"></div><a href=/m>x</a>'),
    ('<div class=pdf-download><span><i></i><a href=/m>x</a></span></div>', '<a class="pdf-download" href=/m>x</a>'),
    ('<ul class="download-pdf"><li><a href=/m>x</a></ul>', '<ul class="Download-PDF"><li><a href=/m>x</a></ul>'),
    ("<a href=/m><i></i> PDF\n</a>", "<a href=/m>pdf</a>"),
    ("<a href=/m> download\n PDF </a>", "<a href=/m>download pdf now</a>"),
    ("<a href=/m>The full-text PDF, <b>2 MB</b></a>", "<a href=/m><b>Full Text PDF</b></a>"),
    ("<a href=/m>now vi<b>e</b>w pdf</a>", "<a href=/m>view the pdf</a>"),
    ("<a href=/m>Open&#32;PDF</a>", "<a href=/m><span>Open PDF</span></a>"),
]


@pytest.mark.parametrize("i", range(len(LINKS)))
def test_each_link_selector(i):
    hit, miss = LINKS[i]
    s = acquisition.PDF_LINKS[i]
    assert len(LINKS) == len(acquisition.PDF_LINKS)
    assert len(select(hit, (s,))[0]) == 1 and not select(miss, (s,))[0]
    assert not select(f"<div style='display: none'>{hit}</div>", (s,))[0] and not select(f"<!-- {hit} --><script>{hit}</script>", (s,))[0]
    assert len(select(hit + "<p hidden>" + hit + "</p>" + miss + hit, (s,))[0]) == 2


@pytest.mark.parametrize(
    ("i", "hit", "miss"),
    [(0, "<input name=p type=Password>", "<input type=text>"), (1, "<form action='/LogIn?x'>", "<form action=/search>"), (2, '<form action="/signin">', "<a action=/signin>"), (3, "<div id=theLoginForm1>", "<div id=login>"), (4, '<section class="a login-form-b">', "<section class=login>")],
)
def test_each_login_selector(spark, i, hit, miss):
    assert select(hit, (acquisition.LOGINS[i],))[0] and not select(miss, (acquisition.LOGINS[i],))[0]
    assert not select(hit.replace(" ", " hidden ", 1), (acquisition.LOGINS[i],))[0]
    got = spark.createDataFrame([(hit,), (miss,), (None,)], "p string").select(acquisition.login(F.col("p")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, False]


def test_order_resolution_and_broken_pages(spark):
    pages = [
        ("http://h/a/b?q", '<a href="c">View PDF</a><a href="../x.pdf">t</a>', "http://h/x.pdf"),  # the selector before the place
        ("http://h/a/b", '<a href="//g/suppl/1.pdf">s</a><a href=" d&amp;e.pdf">t</a>', "http://h/a/d&e.pdf"),
        ("http://h/a/b", '<a href="/esm/1.pdf">s</a>', "http://h/esm/1.pdf"),  # only a supplement
        ("http://h/suppl/b", '<a href="1.pdf">s</a><a href="/2.pdf">s</a>', "http://h/2.pdf"),  # judged as resolved
        ("http://h/x.PDF", '<a href="y.pdf">', "http://h/x.PDF"),
        ("http://h/", '<a href="http://[x.pdf">t</a>', None),
        ("http://h/", "<a href='/open.pdf' <b>x", None),
        ("http://h/", "<div><a href=1.pdf>x<p>y</div></b></p><a href=", "http://h/1.pdf"),
        ("http://h/", None, None), ("http://h/", "", None), (None, '<a href="/z.pdf">', "/z.pdf"),
    ]
    got = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(pages)], "i int, url string, html string")
    got = {r.i: r.pdf_link for r in acquisition.page_class(got).collect()}
    assert {i: got[i] for i in got if i != 6} == {i: w for i, (_, _, w) in enumerate(pages) if i != 6}


def test_long_pages_are_linear():
    deep = "<div class=pdf-download>" * 50_000 + "<a href=/m>x</a>" * 50_000
    open_links = "<a href=/m>view <b>" * 50_000
    assert len(select(deep, acquisition.PDF_LINKS)[11]) == 50_000
    assert not any(select(open_links + "<" * 100_000 + "'" * 50_000, acquisition.PDF_LINKS))
    one = "<a href=/m>" + "<b>view</b> " * 100_000 + "pdf"
    assert len(select(one, (Selector("a", matches="(?i)view pdf"),))[0]) == 1
    assert select(None, (Selector("a", (Attr("href", "=", "x"),)),)) == [[]]
