import html as codec

from rookery.llm import html

SHELL = """<!doctype html><html><head><title>T</title><style>p {{}}</style></head><body><nav><a href=/>Home</a> menu</nav>
<div class="site-header">Site</div><div class="{box}"><h1>{title}</h1>{body}</div>
<div class="sidebar">Most read</div><div id="comments"><p>reader says a lot of words here, more than the article has in it at all</p></div><footer>Imprint</footer></body></html>"""


def page(title, blocks, box="post-12"):
    return SHELL.format(box=box, title=codec.escape(title), body="".join(f"<p>{codec.escape(b)}</p>" for b in blocks))


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, path string")
    return {r.page_id: r.text for r in html.extract(pages).collect()}


def test_articles_come_out_whole(spark):
    articles = {i: (f"Title {i} & more", [f"Paragraph {k} of {i}: <tags>, „quotes“ & 𝒳." for k in range(i % 4 + 1)]) for i in range(40)}
    got = texts(spark, [(i, f"http://h{i % 2}.org/{i}", page(t, b, f"post-{i}"), "p") for i, (t, b) in articles.items()])
    assert got == {i: "\n".join([t, *b]) for i, (t, b) in articles.items()}


def test_consensus_beats_the_page_own_choice(spark):
    long = "words " * 60
    rows = [(i, "http://a.org/x", f"<div class=story><p>Story {i} is told here at length, {long}.</p></div><div class=extra>short</div>", None) for i in range(9)]
    rows.append((9, "http://a.org/y", f"<div class=story><p>Brief.</p></div><div class=extra><p>{long}</p></div>", None))
    assert texts(spark, rows)[9] == "Brief."


def test_white_space_references_and_blocks():
    p = html.Page("<article>a\n  b&nbsp;&amp;&#x41;<br>c<script>var x = '<p>no</p>'</script><!-- no --><ul><li>one<li>two</ul><p>x<p>y <b>z</b></article>")
    assert p.text(None).split("\n") == ["a b &A", "c", "one", "two", "x", "y z"]


def test_unclosed_unquoted_and_deep_markup():
    assert html.Page("<p>a<div>b</p>c").text(None).split("\n")
    assert html.Page("<div>" * 3000 + "deep").text(None) == "deep"
    assert html.Page("a < b and <3 &bogus;").text(None) == "a < b and <3 &bogus;"
    assert html.Page('<p title="a > b">kept</p>').text(None) == "kept"
    assert len(html.Page("<p>" + "long " * 300_000 + "</p>").text(None)) == 1_499_999


def test_null_empty_and_repeated_rows(spark):
    schema = "page_id bigint, url string, html string, text int"
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 1), (None, "http://h", "<p>x</p>", 1), (3, "http://h", "<p>x</p>", 1), (3, "http://h", "<p>x</p>", 1)], schema)
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in html.extract(pages).collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (2, "u", "", 0), (0, "http://h", "x", 1), (3, "http://h", "x", 1), (3, "http://h", "x", 1)], key=repr)
    assert html.extract(spark.createDataFrame([], schema)).count() == 0


def test_long_attributes_and_deep_pages_are_read_like_others():
    assert html.Page(f'<img alt="{"x" * 25_000}>y"><p>kept</p>').text(None) == "kept"
    assert html.Page("<div>" * 600 + "<nav>menu</nav><aside>more</aside><p>kept</p>").text(None) == "kept"


def test_class_words_inside_the_article():
    own = '<p class="share-price">one</p><p class="related-work">two</p><div class="share-links">no</div><div class="comments"><p>no</p></div>'
    assert html.Page(f"<article>{own}</article>").text(None) == "one\ntwo"
    assert html.Page("<article><p>one is here</p></article><article><p>two</p></article>").text(None) == "one is here\ntwo"


SENTENCES = [f"Sentence {i} of the article says something of its own." for i in range(8)]
BOXES = ("story", "site-content has-sidebar", "content-with-sidebar", "post comments-open", "entry no-ads", "page search-result", "main-widget", "post recommended", "single-post with-newsletter", "layout--no-banner", "wrap nav-closed", "post-12 share-enabled")


def test_one_class_word_beside_others_takes_no_article():
    for box in BOXES:
        body = "".join(f"<p>{x}</p>" for x in SENTENCES)
        assert html.Page(f'<body><div class="{box}"><h1>Title</h1>{body}</div></body>').text(None) == "\n".join(["Title", *SENTENCES]), box


#: Parts of pages that are no article, by names of one or more words.
NOISE = (
    '<div class="related-articles"><a href=/1>Another story of the day</a> <a href=/2>And one more of them</a></div>', '<div class="cookie-message">We keep cookies. Accept them.</div>', '<div class="promo-strip-large">Buy now, pay later.</div>',
    '<section id="site-navigation"><a href=/>Home</a> <a href=/x>Sports pages</a></section>', '<div class="share-buttons">Share this</div>', '<div class="widget widget-links"><a href=/3>Most read today</a></div>',
    '<div class="comments-section"><p>Reader: I do not agree with any of it.</p></div>', '<div class="newsletter-signup-v2">Get it by mail. Sign up.</div>', '<div class="nav-below-post"><a href=/4>Older posts are here</a></div>',
)


def test_labelled_pages_have_full_recall_and_precision():
    found = wanted = right = 0
    for n, box in enumerate(BOXES):
        noise = [NOISE[(n + k) % len(NOISE)] for k in range(4)]
        body = "".join(f"<p>{x}</p>" + (noise[3] if i == 4 else "") for i, x in enumerate(SENTENCES))
        got = html.Page(f'<body>{noise[0]}<div class="{box}">{body}{noise[1]}</div>{noise[2]}</body>').text(None).split("\n")
        found, wanted, right = found + len(got), wanted + len(SENTENCES), right + len(set(got) & set(SENTENCES))
    assert right == wanted and right == found


def test_doubtful_names_are_settled_by_text_and_links():
    links = "".join(f"<a href=/{i}>headline number {i} of today</a> " for i in range(30))
    article = "<p>" + " ".join(SENTENCES) + "</p>"
    assert html.Page(f'<div class="story">{article}</div><div class="latest-with-ads">{links}</div>').text("div.story") == " ".join(SENTENCES)
    assert html.Page(f'<div class="has-sidebar">{article}<div class="read-related">{links}</div></div>').text(None) == " ".join(SENTENCES)
    assert html.Page('<div class="no-ads"></div>').text(None) == ""
