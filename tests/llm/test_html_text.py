import html as html_lib
import re
import time

from skein.llm.html_text import extract, extract_pages

LAYOUT = """<html><head><title>T</title><style>p{}</style></head><body class="home">
<header><h2>Site</h2><a href="/">Home</a></header>
<div id="cookie-notice"><p>We use cookies, please accept them all, thank you very much.</p></div>
<div class="wrap"><div class="sidebar"><p>Popular: one, two, three, four and many other things.</p></div>
<div class="post"><h1>Head &amp; line</h1><p>First   paragraph, with <a href=x>a link</a>, and text.</p>
<p>Second paragraph: longer,<br>much longer; it goes on, and on.</p><ul><li>item one</li><li>item two</li></ul>
<form><label>Your mail</label><input name=a></form><script>var t="</p>";</script></div>
<section class="comments"><p>Reader: I do not agree, at all, with any of this, sorry!</p></section></div>
<footer><p>Imprint, terms, and so on.</p></footer></body></html>"""


def test_layout():
    assert extract(LAYOUT) == (
        "Head & line\nFirst paragraph, with a link, and text.\nSecond paragraph: longer, much longer; it goes on, and on.\nitem one\nitem two"
    )


TEXT = "<p>This is a long paragraph of the article, with commas, and sentences. It goes on, and on, and on.</p>"
PLAIN = TEXT[3:-4]


def test_names_that_only_look_like_furniture():
    for wrapper in ('<div class="has-sidebar content">', '<section id="legal-analysis">', '<div class="sidebar-layout">', '<form id="f">', '<div class="notice">'):
        assert extract(f"<body>{wrapper}<h2>Head</h2>{TEXT}{TEXT}</body>") == f"Head\n{PLAIN}\n{PLAIN}", wrapper
    assert extract(f'<body><div class="page-header"><h1>Title</h1></div><div>{TEXT}{TEXT}</div></body>') == f"Title\n{PLAIN}\n{PLAIN}"


def test_attributes_and_links():
    assert extract(f"<body><p class=x'>Stray, but text.</p>{TEXT}</body>") == f"Stray, but text.\n{PLAIN}"
    assert extract(f"<article>{TEXT}<p><a href=x>A paragraph, all of it a link</a></p>{TEXT}</article>") == f"{PLAIN}\nA paragraph, all of it a link\n{PLAIN}"
    assert extract(f'<p><a title="a > b" class=\'c "d\'>link</a></p>{TEXT}') == f"link\n{PLAIN}"


def test_inline_furniture():
    page = f'<article>{TEXT}<p>Text <span class="advertisement">BUY <b>NOW</b></span>more <span hidden>secret</span><span class="share">Tweet <span>this</span></span>end.</p></article>'
    assert extract(page) == f"{PLAIN}\nText more end."


SHORT = "<p>Short.</p>"
LAYOUTS = [
    f'<div id="top-menu"><a href=a>A</a> <a href=b>B</a></div><div class="intro"><h2>Intro</h2>{TEXT}</div><div class="rest">{TEXT * 6}{SHORT}</div><div class="footer">Imprint, terms.</div>',
    f'<table><tr><td class="nav"><a href=a>A</a></td><td><h2>Intro</h2>{TEXT}{TEXT * 6}{SHORT}</td></tr></table>',
    f'<div id="wrapper"><div class="site-header">Site</div><div class="columns"><div class="side-bar widget">Popular: a, b, c, and d.</div><div class="text"><h2>Intro</h2>{TEXT}{TEXT * 6}{SHORT}</div></div></div>',
    f'<center><h2>Intro</h2>{TEXT}<div>{TEXT * 6}</div>{SHORT}</center><div class="comment-list"><p>No, I disagree, strongly, with all of it!</p></div>',
    f'<section><h2>Intro</h2>{TEXT}</section><section>{TEXT * 6}{SHORT}</section><div role="contentinfo">Imprint</div><div class="cookieBanner"><p>We use cookies, as you know, and so on.</p></div>',
]


def test_layouts_without_article():
    for layout in LAYOUTS:
        assert extract(f"<html><body>{layout}</body></html>") == "\n".join(["Intro", *[PLAIN] * 7, "Short."]), layout


def test_nesting_is_linear():
    start = time.monotonic()
    for hostile in ("<div>", "<div></p>", "<span class=ad>", "<x><p><y>", "<li>", "<ul><li>", "<a b='", "<table><td>"):
        assert "goes on" in extract(hostile * 100_000 + "</x>" + TEXT.replace("'", "")), hostile
    assert time.monotonic() - start < 30


def test_edges():
    assert extract(None) == "" and extract("") == "" and extract("<p></p>") == ""
    assert extract("just text &lt;b&gt;") == "just text <b>"
    assert extract("<article><h1>A</h1><p><b>One sentence.<br></article><footer>x</footer>") == "A\nOne sentence."
    long = "<article>" + "<p>word word, word.</p>" * 20000 + "</article>"
    assert extract(long).count("\n") == 19999


def test_frame(spark):
    rows = [(1, "u", LAYOUT, 7), (1, "u", LAYOUT, 7), (None, None, None, None), (3, "v", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = extract_pages(df).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert sum(r.text == "" for r in out) == 2
    assert extract_pages(df.limit(0)).count() == 0


def test_pages_fixture(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r.page_id: r.html for r in df.collect()}
    for r in extract_pages(df).collect():
        body = html[r.page_id].split("<article>")[1].split("</article>")[0]
        plain = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(x for x in plain if x)


def test_a_passing_path_stays_wherever_it_stands():
    lede = f"<p>A lede. {PLAIN} {PLAIN}</p>"
    page = f"<main><h1>T</h1>{lede}<article>{TEXT * 8}</article></main>"
    assert extract(page) == "\n".join(["T", lede[3:-4], *[PLAIN] * 8])
    page = f"<body><article><h2>One</h2>{TEXT * 6}</article><article><h2>Two</h2>{TEXT}</article></body>"
    assert extract(page) == "\n".join(["One", *[PLAIN] * 6, "Two", PLAIN])
    page = f"<body><article><h2>One</h2>{TEXT * 6}</article><div class='content'>{TEXT * 2}</div></body>"
    assert extract(page) == "\n".join(["One", *[PLAIN] * 8])


def test_scores_decide_over_hints():
    """A named section of prose inside the article stays, a line of an advert goes, and so do comments however long."""
    law = f"<section class='legal'><h2>Law</h2><p>{PLAIN} {PLAIN} {PLAIN} {PLAIN}</p></section>"
    page = f"<article><h1>H</h1>{TEXT * 6}{law}<div class='ad'>Buy now, it is cheap. Really.</div><section class='comments'><p>{PLAIN * 4}</p></section></article>"
    want = ["H", *[PLAIN] * 6, "Law", f"{PLAIN} {PLAIN} {PLAIN} {PLAIN}"]
    assert extract(page) == "\n".join(want)
    assert extract(page, strength=0.0) == "\n".join([*want, "Buy now, it is cheap. Really."])


def test_scores_change_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert all(extract(r.html) != extract(r.html, strength=0.0) for r in rows)
