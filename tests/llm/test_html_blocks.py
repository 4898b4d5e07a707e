"""Main text of pages with many kinds of surroundings."""

import random

import pytest

from reelspark.llm import html_blocks

LONG = "The cut lands on the beat and the shot that comes after it is the one with the motion that we have seen before, so the eye is not lost."
PAGES = {
    "article": (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p><p>x';</script></head><body><header>Site</header><nav><ul><li><a href='/'>Home</a></ul></nav>"
        f"<div class='ad'>Buy now, {LONG}</div><article><h1>Cut &amp; beat</h1><p>{LONG}<br>More\n  text&nbsp;here.<p>Short.</p></article>"
        f"<aside>{LONG}</aside><div id=comments><p>{LONG}</p></div><footer>&copy; me</footer></body></html>",
        f"Cut & beat\n\n{LONG} More text here.\n\nShort.",
    ),
    "no article element": (
        f"<body><div class='top-menu'>Menu</div><div><h2>Title here</h2><p>{LONG}</p><p>{LONG} Again.</p><p>Yes.</p></div><div><a href=a>one</a> <a href=b>two</a> <a>three</a></div></body>",
        f"Title here\n\n{LONG}\n\n{LONG} Again.\n\nYes.",
    ),
    "unclosed": (f"<nav><ul><li><a>x</a><article><p>{LONG}<p>Tail", f"{LONG}\n\nTail"),
    "only short": ("<article><h1>A</h1><p><b>B<br></article>", "A\n\nB"),
    "comment with markup": (f"<article><!-- <p>no</p> --><p>{LONG}</p><form>Name <input></form><section class='reader-comments'><p>{LONG}</p></section></article>", LONG),
    "quotes and brackets": (f"<article><p title='a > b' class=\"x\">{LONG} 1 < 2</p></article>", f"{LONG} 1 < 2"),
    "cookie notice": (f"<div role=dialog>{LONG}</div><div class='cookie-notice'>{LONG}</div><main><p>{LONG}</p></main>", LONG),
    "header in article": (f"<article><header><h1>Head</h1></header><p>{LONG}</p><footer>by me</footer></article>", f"Head\n\n{LONG}"),
    "links inside": (f"<article><p>{LONG}</p><p><a href=x>Read this next, please</a></p></article>", LONG),
    "empty": ("", ""),
    "no text": ("<html><body><img src=x></body></html>", ""),
    "plain": ("just words", ""),
    "entities": (f"<article><p>&lt;b&gt; &#233;&#x41; {LONG}</p></article>", f"<b> éA {LONG}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert "\n\n".join(html_blocks.main_blocks(page)[0]) == want


def test_short_blocks_follow_the_nearest_decided_one():
    links = "".join(f"<p><a href={i}>link number {i}</a></p>" for i in range(3))
    page = f"<div>{links}<p>near links</p><p>x</p><p>near text</p><p>{LONG}</p><p>{LONG}</p></div>"
    kept, n = html_blocks.main_blocks(page)
    assert kept == ["x", "near text", LONG, LONG] and n == 8


def test_article_tag_is_no_filter():
    kept, n = html_blocks.main_blocks(f"<body><article><p>{LONG}</p></article><div><h2>Title</h2><p>{LONG} Again.</p></div></body>")
    assert kept == [LONG, "Title", f"{LONG} Again."] and n == 3
    # Outside one, a long block without stop words follows what is decided around it; in an article it is text.
    junk = ("Lorem ipsum dolor sit amet consectetur " * 4).strip()
    links = "".join(f"<p><a href={i}>link number {i}</a></p>" for i in range(3))
    assert html_blocks.main_blocks(f"<div><p>{LONG}</p>{links}<p>{junk}</p>{links}</div>")[0] == [LONG]
    assert html_blocks.main_blocks(f"<article><p>{LONG}</p>{links}<p>{junk}</p>{links}</article>")[0] == [LONG, junk]


FOREIGN = "Kamera pokazuje ulicę, potem twarz aktora, później deszcz oraz światła miasta nocą, zanim muzyka ucichnie i obraz zgaśnie powoli całkiem."


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content has-sidebar'><p>{LONG}</p></div>",
        f"<div id='main-content' class='no-sidebar'><p>{LONG}</p></div>",
        f"<article class='post related'><p>{LONG}</p></article>",
        f"<div class='sidebar-left'><div><article><p>{LONG}</p></article></div></div><div><a href=x>one link</a></div>",
        f"<div class='sidebar-left'><p>{LONG}</p></div>",
        f"<div class='related'><p>{LONG}</p></div><article><p>{LONG}</p><div class='post-share'>{LONG}</div></article><div id=comments><article><p>{LONG}</p></article></div>",
        f"<span><div class='ad'>{LONG}</span><p>{LONG}</p>",
    ],
)
def test_names_drop_no_article(page):
    assert html_blocks.main_blocks(page)[0] == [LONG]


def test_links_in_an_article_drop_only_themselves():
    links = "<p><a href=1>one link</a></p><p><a href=2>another link</a></p>"
    assert html_blocks.main_blocks(f"<article>{links}<h1>Title</h1><p>By Ann</p><p>{LONG}</p></article>")[0] == ["Title", "By Ann", LONG]
    assert html_blocks.main_blocks(f"<article><p>{LONG}</p><p><a href=1>the source</a></p><pre>x = 1</pre><p>Fin.</p></article>")[0] == [LONG, "x = 1", "Fin."]
    # Without an article element a heading goes with what follows it.
    assert html_blocks.main_blocks(f"<body>{links}<h1>Title</h1><p>By Ann</p><p>{LONG}</p></body>")[0] == ["Title", "By Ann", LONG]


@pytest.mark.parametrize("name", ["search-results", "menu-of-the-day", "layout-with-sidebar", "related-work", "side-by-side", "content has-ads"])
def test_names_of_text_in_an_article(name):
    assert html_blocks.main_blocks(f"<article><p>{LONG}</p><div class='{name}'><p>{LONG} More.</p></div></article>")[0] == [LONG, f"{LONG} More."]


@pytest.mark.parametrize(
    "name", ["user-comments-area", "reader_comments_box", "site-notice-bar", "readerComments", "top-ad-slot", "page-cookie-info", "search-box", "usercomments", "post-share", "the-newsletter-form"]
)
@pytest.mark.parametrize("inside", [True, False])
def test_compound_names_of_what_is_no_text(name, inside):
    junk = f"<div class='{name}'><p>{LONG} More.</p></div>"
    page = f"<article><p>{LONG}</p>{junk}</article>" if inside else f"<article><p>{LONG}</p></article>{junk}"
    assert html_blocks.main_blocks(page)[0] == [LONG]


WORDS = "the of and to in a is that cut shot beat frame light scene motion camera sound it was with on from this which".split()


def _page(rng):
    """A page of one of several templates, and the blocks of its article."""

    def sentence(n):
        return " ".join(rng.choice(WORDS) for _ in range(n)) + "."

    def link():
        return f"<a href='/{rng.randrange(99)}'>{sentence(rng.randint(1, 4))}</a>"

    want, body = [], []
    for kind in ["h1", "byline"] + [rng.choice(["p", "p", "p", "h2", "short", "code", "list", "link", "quote", "junk"]) for _ in range(rng.randint(4, 14))] + ["p"]:
        text = sentence(rng.randint(25, 60))
        if kind == "link":
            body.append(f"<p>{link()}</p>")
            continue
        if kind == "junk":
            body.append(rng.choice([f"<aside>{text}</aside>", f"<div class='share-bar'>{link()}</div>", f"<div class='ad-slot'><p>{text}</p></div>", "<script>var x = '<p>no</p>';</script>", f"<form>{text}</form>"]))
            continue
        text = {"h1": sentence(4), "h2": sentence(3), "byline": "By " + sentence(2), "short": sentence(2), "code": "x = f(1) &amp; 2", "list": sentence(5)}.get(kind, text)
        body.append({"h1": f"<h1>{text}</h1>", "h2": f"<h2>{text}</h2>", "code": f"<pre>{text}</pre>", "list": f"<ul><li>{text}</li></ul>", "quote": f"<blockquote>{text}</blockquote>"}.get(kind, f"<p class='x'>{text}</p>"))
        want.append(text.replace("&amp;", "&"))
    menu = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 6)))
    comments = "".join(f"<div class='comment'><p>{sentence(30)}</p></div>" for _ in range(rng.randint(0, 3)))
    opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<main><article class='post single'>", "</article></main>"), ("<div id='page'><article>", "</article></div>")])
    before = rng.choice([f"<nav><ul>{menu}</ul></nav>", f"<header><ul>{menu}</ul></header>", f"<div id='top-menu'><ul>{menu}</ul></div>", f"<div class='cookie-notice'><p>{sentence(30)}</p></div><ul>{menu}</ul>"])
    after = rng.choice([f"<section id='comments'>{comments}</section>", f"<div class='reader-comments-list'>{comments}</div>", f"<footer>{sentence(20)}</footer>", f"<div class='sidebar'><p>{sentence(30)}</p></div>", f"<ul>{menu}</ul>"])
    return f"<html><head><title>{sentence(3)}</title></head><body>{before}{opening}{''.join(body)}{closing}{after}</body></html>", want


def test_generated_pages_of_several_templates():
    rng = random.Random(5)
    for _ in range(400):
        page, want = _page(rng)
        assert html_blocks.main_blocks(page)[0] == want, page


def test_few_stop_words_stay_undecided():
    table = "Lens 35 mm, aperture f/2, shutter 1/50, gain 3 dB, take 4, reel 7"
    links = "".join(f"<p><a href={i}>link number {i}</a></p>" for i in range(3))
    assert html_blocks.main_blocks(f"<div>{links}</div><div><p>{LONG}</p><p>{table}</p><p>{FOREIGN}</p></div>")[0] == [LONG, table, FOREIGN]
    assert html_blocks.main_blocks(f"<div>{links}</div><div><p>{FOREIGN}</p><p>Krótko.</p></div>")[0] == [FOREIGN, "Krótko."]


def test_table(spark):
    rows = [(1, "u", PAGES["article"][0], 3), (2, None, None, 4), (1, "u", PAGES["article"][0], 5), (None, "v", "<p>" * 5000 + LONG, 6), (7, "w", f"<article><p>{LONG * 20_000}</p></article>", 7)]
    got = html_blocks.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert [(r.page_id, r.url) for r in got] == [(1, "u"), (2, None), (1, "u"), (None, "v"), (7, "w")]
    assert [r.text for r in got[:4]] == [PAGES["article"][1], "", PAGES["article"][1], LONG]
    assert got[4].text == LONG * 20_000
    assert html_blocks.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
