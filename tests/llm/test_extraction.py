import html
import os
import re
import time

import pytest

from tidewater.llm.extraction import extract, main_text, op12_extraction

DATA = "/root/testdata/sf0.001"
P = "The quick, brown fox jumps over the lazy dog, and it does so again, as told in this long paragraph of prose."
CASES = {
    "text without markup": ("just text, no markup", "just text, no markup"),
    "unclosed paragraphs": (f"<body><p>{P}<p>{P}", f"{P}\n\n{P}"),
    "marks by class": (
        f'<div class="nav"><a href=x>Home</a></div><div id="content"><h1>Title</h1><div class="ad">{P}</div><p>{P}</p><p>Short.</p><div class="share"><a>x</a></div></div><div class="sidebar"><p>{P}</p></div><div class="comments"><p>{P}</p><p>{P}</p><p>{P}</p></div><div class=footer>(c) 2020</div>',
        f"Title\n\n{P}\n\nShort.",
    ),
    "like sections are siblings": (f"<body><div id=wrap><div class=x><section><h2>One</h2><p>{P}</p><p>{P}</p></section><section><h2>Two</h2><p>{P}</p></section></div><div>We use it</div></div><div><a href=1>a</a> <a href=2>b</a> <a href=3>c</a></div>", f"One\n\n{P}\n\n{P}\n\nTwo\n\n{P}"),
    "paragraphs beside the best container": (f'<body><div class="c"><p>{P} Intro.</p><div class=inner><p>{P}</p><p>{P}</p></div><p>End.</p></div></body>', f"{P} Intro.\n\n{P}\n\n{P}\n\nEnd."),
    "links are no article": (f'<body><div>{"<a href=x>" + P + "</a> " * 5}</div><div><p>{P}</p></div></body>', P),
    "article with header and reader comments": (
        f'<main><article><header><h1>T</h1><p>by X</p></header><p>{P}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><footer>tags</footer></article><section id="comments"><article class="comment-body"><p>{P}</p></article></section></main>',
        f"T\n\n{P}\n\none\n\ntwo\n\na\n\nb",
    ),
    "two articles": (f"<body><article><p>{P}</p></article><article><p>{P} Two</p></article><aside>{P}</aside></body>", f"{P}\n\n{P} Two"),
    "notices and forms": (f'<body><div id="cookie-notice"><p>{P}</p></div><div class="post has-sidebar"><p>{P} Kept</p></div><form><p>{P}</p></form></body>', f"{P} Kept"),
    "references once, white space": (f"<article><p>a &amp;amp; b &lt;x&gt; &nbsp;\n\t c &eacute; &#8364;&#x20AC;<br>{P}</p></article>", f"a &amp; b <x> c é €€ {P}"),
    "scripts hold tags": (f'<article><script>if (a<b) document.write("</p><p>{P}")</script><p>{P}<style>x</style> tail</p></article>', f"{P} tail"),
    "comments": (f"<article><!-- <p>{P}</p> --><p>{P}</p></article><!-- <p>x", P),
    "stray less-than signs and quotes": (f'<article><p title="a > b">1 < 2 and 3 > 2, {P}</p><img alt="x>y"/></article>', f"1 < 2 and 3 > 2, {P}"),
    "inline elements": (f"<article><p>He<b>ll</b>o <i>w</i>orld<br/>next, {P}</p></article>", f"Hello world next, {P}"),
    "menu inside the article": (f"<article><p>{P}</p><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul></article>", P),
    "hidden": (f'<article><p>{P}</p><div hidden>{P}</div><div style="display: none">{P}</div></article>', P),
    "title alone": ("<article><h1>T</h1></article>", "T"),
    "nothing": ("", ""),
    "no article": ("<body><nav>a</nav><header><h1>Site</h1></header><footer>x</footer></body>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    page, want = CASES[name]
    assert main_text(page) == want


@pytest.mark.parametrize("unit", ["<div>", "<b>x<div>y</div>", "<header>", "<p ", "<", '<a "', "<li>", "<b>x<p>", "<b>x<li></a>", "<ul><li>", "<script>", "<!--", "<table><td>", "</p>"])
def test_odd_pages_take_linear_time(unit):
    began = time.time()
    main_text(unit * 20_000 + f"<p>{P}</p>")
    assert time.time() - began < 10


def test_rows(spark):
    rows = [(1, "u", CASES["two articles"][0], "x", "y", 3), (1, "u", CASES["two articles"][0], "x", "y", 3), (None, None, None, None, None, None), (2, "v", "", "x", "y", 3), (3, "w", f"<article>{'<p>' + P + '</p>'}</article>" * 3000, "", "", 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, N_CHARS string, drop int").repartition(2)
    want = [(r[0], r[1], t, len(t)) for r in rows for t in [main_text(r[2] or "")]]
    assert sorted(map(tuple, extract(frame).collect()), key=repr) == sorted(want, key=repr)
    assert want[-1][2].count(P) == 3000
    assert extract(frame.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_query_against_the_pages_own_form(spark):
    """The table's pages have one article element each, whose blocks a few patterns find."""
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op12_extraction(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"</?[a-z][^<>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h\d)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]] == (want, len(want))
