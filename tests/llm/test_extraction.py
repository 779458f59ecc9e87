import re

from orgatlas.llm import extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><a href="/">Home</a></header>
<nav><ul><li><a href="/a">About</a></li></ul></nav><div class="cookie-banner">We use cookies on this site to track whatever you read here.</div><!-- <p>hidden</p> -->
<main><article><h1>Caf&eacute; &amp;  more</h1><p><b>First<br>line &lt;x&gt; a < b<p>Ti.<blockquote>Quoted</blockquote><ul><li>one<li>two</ul><div class="ad-slot">Buy now buy now</div><form><p>Your mail</p></form>
<aside>See also</aside><p>Last &#8364; <a href="/x">link text</a>.</p><section id="comments"><p>Great post, I liked it very much indeed.</p></section></article></main>
<div class="sidebar"><p>Related stories of the day that are many words long</p></div><footer>&copy; 2020 us</footer></body></html>"""


def test_article_alone_is_kept():
    assert extraction.main_text(PAGE).split("\n\n") == ["Café & more", "First line <x> a < b", "Ti.", "Quoted", "one", "two", "Last € link text."]


def used(node):
    return {node[0]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()


def test_tree_uses_neighbours_and_holds_on_other_pages(spark):
    """Blocks of pages whose containers are taken away: the tree alone has to tell the article."""
    assert used(extraction.tree()) >= {0, 2, 3, 4}
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("html is not null").select("html").collect()]
    right = total = caught = main = 0
    for html in pages:
        bare = re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", html).replace('<div class="ad">', "<div>")
        told, blank = extraction.blocks(html), extraction.blocks(bare)
        if [b[0] for b in told] != [b[0] for b in blank]:
            continue
        for i, block in enumerate(told):
            found = extraction.is_main(extraction.shape(blank, i))
            right, total = right + (found == (block[4] > 0)), total + 1
            caught, main = caught + (found and block[4] > 0), main + (block[4] > 0)
    assert total > 500 and right > 0.95 * total and caught > 0.95 * main


def test_names_that_only_sound_like_boilerplate():
    page = "<article><h1>T</h1><div class='legal-analysis'><p>Law.</p></div><section class='social-policy'><p>Policy.</p></section><div class='share-buttons'>Share</div><div id='relatedArticles'>More</div><p class='noticeable'>End.</p></article>"
    assert extraction.main_text(page).split("\n\n") == ["T", "Law.", "Policy.", "End."]


def test_stray_quotes_end_with_their_tag():
    page = """<article><p class="a"">First <b>x</b></p><p title='it's'>Second > first</p><p data-x=a"b>Third</p><p a="1>2" b='3>4'>Fourth</p><p class="open>Fifth</p></article>"""
    assert extraction.main_text(page).split("\n\n")[:4] == ["First x", "Second > first", "Third", "Fourth"]
    assert extraction.main_text("<article><p>" + "<p a=\"" * 20_000) == ""


def test_pages_without_containers():
    page = "<html><body><div><a href=a>One</a></div><div><a href=b>Two</a></div><div>" + "word " * 90 + "</div><div>" + "more " * 80 + "</div><div><a href=c>Imprint</a></div></body></html>"
    assert extraction.main_text(page).split("\n\n") == [("word " * 90).strip(), ("more " * 80).strip()]


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None, 0), (2, None, "", 0), (3, "u", "<script>alert(1)", 0), (4, "u", "<article><p>" + "long " * 50_000, 0), (4, "u", "<article><p>x", 0), (5, "u", "plain", 0)], "page_id long, url string, html string, text int")
    rows = extraction.extract_main_text(pages).collect()
    assert len(rows) == 6 and all(r.n_chars == len(r.text) for r in rows)
    assert {r.page_id: r.text for r in rows if r.page_id < 4} == {1: "", 2: "", 3: ""} and max(r.n_chars for r in rows) == 249_999
    assert extraction.extract_main_text(pages.where("page_id = 9")).count() == 0


def test_wrappers_named_after_the_layout():
    story = "<h1>Title</h1><p>One.</p><section id='comments'><p>Great post, I liked it</p></section><aside>Also</aside>"
    for page in (f"<div class='content with-sidebar'><article>{story}</article></div>", f"<main class='comments-open'><article>{story}</article></main>", f"<main class='comments-open'>{story}</main>", f"<div id='comments-page'><div role='main'>{story}</div></div>"):
        assert extraction.main_text(f"<html><body>{page}<footer><article><p>Foot</p></article></footer></body></html>").split("\n\n") == ["Title", "One."]
    for beside in ("<div class='sidebar'><article><p>Related story</p></article></div>", "<nav class='menu'><article><p>Nav</p></article></nav>", "<div class='comments'><aside><article><p>No</p></article></aside></div>"):
        assert extraction.main_text(f"<body><article>{story}</article>{beside}</body>").split("\n\n") == ["Title", "One."]


def test_sections_of_an_article_keep_their_text():
    """Names that are ordinary words of sections, and names of headings, cost no text of an article; without text or full of links they still do."""
    text = "word " * 60
    for name in ("discussion", "section-discussion", "legal", "legal-notice", "notice", "related", "side", "overlay", "search", "share", "banner-text", "reply", "social", "login"):
        page = f"<body><article><h1>Title</h1><p>{text}</p><section class='{name}'><h2 id='{name}'>Part</h2><p>{text}</p></section><h2 id='{name}'>End</h2><p>{text}</p></article></body>"
        assert extraction.main_text(page).split("\n\n") == ["Title", text.strip(), "Part", text.strip(), "End", text.strip()], name
    for name in ("related", "share", "social-links", "search-form", "login", "reply"):
        for inner in ("Short words", "".join(f"<li><a href=x>Other story number {i}</a></li>" for i in range(20))):
            assert extraction.main_text(f"<article><p>{text}</p><div class='{name}'>{inner}</div></article>") == text.strip(), name
    for name in ("comments", "ad", "cookie-banner", "newsletter", "sponsored", "sidebar"):
        assert extraction.main_text(f"<article><p>{text}</p><div class='{name}'><p>{text}</p></div></article>") == text.strip(), name
    for name in ("notice", "legal", "related"):
        assert extraction.main_text(f"<article><p>{text}</p></article><div class='{name}'><p>{text}</p></div>") == text.strip(), name


def test_every_block_is_judged_by_the_tree(monkeypatch):
    monkeypatch.setattr(extraction, "is_main", lambda features: False)
    assert extraction.main_text(PAGE) == ""
