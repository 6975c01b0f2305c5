import html
import re

from tessera.llm import html_extract as h


def test_page_furniture_goes_and_the_article_stays():
    page = """<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div>
    <aside>Side</aside><div id=ad-1>Buy this</div><!-- <p>no</p> --><article><header><h1>A &amp; B</h1></header><p>One<br>two  three.
    <p class="share-links">Share</p><p><b>Four</p><ul><li>five</li></ul><form><input><label>mail</label></form>
    <div class=comments><p>First!</p></div></article><footer>&copy; us</footer></body></html>"""
    assert h.extract(page) == "A & B One two three. Four five"


def test_without_main_elements_the_two_passes_decide():
    long = "The house on the hill was one of the first in the town and it is still there for all of us to see. " * 4
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h2>Title</h2><div>{long}</div><div>It was late.</div><div>{long}</div><div>Tags</div><div>© 2020 Us</div>"
    got = h.extract(page)
    assert got.startswith("Title The house") and "It was late." in got
    assert not any(x in got for x in ("Home", "Tags", "©"))


TEXT = "The house on the hill was one of the first in the town and it is still there for all of us to see. "


def test_main_elements_are_a_prior_and_never_discard_the_rest():
    body = f"<div>{TEXT * 4}</div><div>It was late.</div><div>{TEXT * 3}</div>"
    got = h.extract(f"<body>{body}<div><article><h3>Next story</h3><p>Read on</p></article></div></body>")
    assert TEXT * 4 in got + " " and "It was late." in got and "Next story" not in got
    got = h.extract(f"<body>{body}<article><p>{TEXT * 2}</p></article></body>")
    assert got.count(TEXT.strip()) == 9
    page = f"<article><h1>Title</h1><p>{TEXT}</p><p>Short one.</p><h2>Read more</h2><ul><li><a href=1>Other</a></li><li><a href=2>A longer headline of another story that goes on and on and on</a></li></ul></article>"
    assert h.extract(page) == f"Title {TEXT}Short one."


def test_names_alone_never_discard_the_text():
    assert h.extract(f'<body class="no-sidebar"><article><p>{TEXT}</p></article></body>') == TEXT.strip()
    assert h.extract(f'<body class="sidebar"><div id="page" class="header-fixed"><div>{TEXT * 4}</div></div></body>') == (TEXT * 4).strip()
    assert h.extract(f'<article class="post has-comments tag-social widget"><p>{TEXT}</p></article>') == TEXT.strip()
    assert h.extract(f'<div class="social"><main><p>{TEXT}</p><div class="share">Share</div></main></div>') == TEXT.strip()
    assert h.extract(f'<div class="widget"><div>{TEXT * 4}</div></div><div class="widget">{TEXT * 3}</div>') == (TEXT * 4).strip()
    assert h.extract(f'<p class="notice">{TEXT * 4}<div class="ad">Buy</div>') == (TEXT * 4).strip()
    # an unclosed paragraph loses nothing but itself; longer comments are not the text
    assert h.extract(f'<article><p>{TEXT}<div><p class="share">Share<div>{TEXT}</div></div></article>') == (TEXT * 2).strip()
    page = f'<article><p>{TEXT * 2}</p></article><ol class="comment-list"><li class="comment"><article class="comment"><p>{TEXT * 9}</p></article></li></ol>'
    assert h.extract(page) == (TEXT * 2).strip()
    h.extract("<div class=ad>" * 20_000 + "x" + "</div>" * 20_000)


def test_other_languages_keep_their_long_blocks():
    polish = "Dom na wzgórzu był jednym z pierwszych w mieście i wciąż tam stoi, aby wszyscy mogli go zobaczyć z daleka. "
    russian = "Дом на холме был одним из первых в городе и до сих пор стоит там, чтобы все могли его видеть издалека. "
    chinese = "山上的房子是城里最早的房子之一,它至今仍然矗立在那里,让所有人都能从远处看到它。"
    for text in (polish, russian, chinese):
        page = f"<div><a href=1>Home</a> <a href=2>News</a></div><div>{text * 3}</div><div>{text}</div><div>{text * 2}{text}</div><div>© 2020 Us</div>"
        assert h.extract(page) == " ".join(x.strip() for x in (text * 3, text, text * 3))
    # on a page with known stop words a long block without any stays bad
    assert "zobaczyć" not in h.extract(f"<div>{TEXT * 5}</div><div>{polish}</div>")


def test_odd_pages():
    assert [h.extract(x) for x in (None, "", "<", "<p", "<!-- open", "<script>x", "</div></p>")] == [""] * 7
    for x in ("<" * 50_000, "<div>" * 20_000 + "</section>" * 20_000, "<a b=\"c' " * 20_000, "<select>" * 20_000, "&amp" * 50_000):
        h.extract(x)
    assert h.extract("<article><p>a<script>if (1 < 2) {}</script>b</p></article>") == "ab"


def test_rows(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", "<main>x  y</main>", 2)], "page_id long, url string, html string, n_chars int")
    got = sorted((r.n_chars, r.text, r.url) for r in h.extract_pages(pages).collect() if r.url)
    assert got == [(3, "x y", "u")]
    assert h.extract_pages(pages).count() == 3
    assert h.extract_pages(pages.limit(0)).collect() == []


def test_query_keeps_whole_articles(spark, sf_dir):
    """Against brute force for these pages: everything inside <article>, markup cut out by pattern."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = h.op10_html(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        want = html.unescape(re.sub("<[^>]+>", "", re.sub("</?(?:p|h1|br)>", " ", inner)))
        assert r.text == " ".join(want.split()) and r.n_chars == len(r.text)
