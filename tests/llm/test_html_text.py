"""Extracted texts of written pages."""

import pytest

from knotwork.llm import html_text

TREE = html_text.train_tree(html_text.LABELLED_BLOCKS)
BODY = "Long sentences of the article stand here, with many words that tell a reader something of use and of interest."

PAGES = {
    "menus": (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        f"<div class=\"ad\">Buy this now.</div><article><h1>Head &amp; line</h1><p><b>{BODY}<br><p>Short.</p></article><footer>&copy; x</footer></body></html>",
        f"Head & line\n{BODY}\nShort.",
    ),
    "parts": (
        f"<body><header><a href=a>Site</a></header><main><p>{BODY}</p><aside>Side {BODY}</aside><form>Name <input name=q></form>"
        f"<div class='cookie-notice'>We use cookies {BODY}</div><p>One\n  two&nbsp;three<p>four</main>"
        f"<section id=comments><p>First! {BODY}</p></section></body>",
        f"{BODY}\nOne two three\nfour",
    ),
    "article header": (f"<article><header><h1>Title</h1></header><p>{BODY}</p></article>", f"Title\n{BODY}"),
    "no article": (f"<div id=menu><a href=1>One</a> <a href=2>Two</a></div><div><p>{BODY}</p><p>{BODY}</p></div><div class=footer>Imprint</div>", f"{BODY}\n{BODY}"),
    "cut off": (f"<article><p>{BODY}</p><p>It ends &amp", f"{BODY}\nIt ends &"),
    "cut tag": (f"<article><p>{BODY}</p><p>It ends <a hre", f"{BODY}\nIt ends"),
    "script": ("<article><p>a</p><script>if (a < b) { '<p>x</p>' }</script><!-- <p>c</p> --><p>b &lt;i&gt;</p></article>", "a\nb <i>"),
    "attributes": ("<article><p title=\"a > b\">kept</p><p hidden>gone</p><p style='display: none'>gone</p></article>", "kept"),
    "stray": ("a < b & c <article><p>x < y</p></article>", "x < y"),
    "names": (
        f"<body class='has-sidebar'><div class='siteHeader'>Top</div><div class='post has-sidebar'><article><div class='entry-header'><h2>Named</h2></div>"
        f"<p>{BODY}</p><div id='reader-comments'><article><p>{BODY}</p></article></div></article></div><div role='search'>Find {BODY}</div></body>",
        f"Named\n{BODY}",
    ),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, wanted = PAGES[name]
    assert html_text.main_text(page, TREE) == wanted


LINKED_PAGES = {
    "short end before linked footer": (f"<article><p>{BODY}</p><p>So it ends.</p></article><footer><a href=1>Imprint</a> <a href=2>Contact</a></footer>", f"{BODY}\nSo it ends."),
    "related links behind": (f"<main><p>{BODY}</p><p>A last word of eight words stands here.</p></main><ul><li><a href=1>One</a><li><a href=2>Two</a></ul>", f"{BODY}\nA last word of eight words stands here."),
    "linked list": (
        f"<article><p>{BODY}</p><h2>Sources</h2><ul><li><a href=1>First one</a></li><li><a href=2>Second one</a></li><li><a href=3>Third</a></li></ul></article>",
        f"{BODY}\nSources\nFirst one\nSecond one\nThird",
    ),
    "short between texts": (
        f"<div><h1>Top</h1><p>{BODY}</p><p>No.</p><p>{BODY}</p><h2>Next part</h2><p>{BODY}</p><p>The end.</p></div>",
        f"Top\n{BODY}\nNo.\n{BODY}\nNext part\n{BODY}\nThe end.",
    ),
    "labels of link lists": (f"<div><p>{BODY}</p><p>{BODY}</p></div><p>Tags</p><p><a href=1>One</a></p><p><a href=2>Two</a></p>", f"{BODY}\n{BODY}"),
}


@pytest.mark.parametrize("name", LINKED_PAGES)
def test_short_blocks_beside_links(name):
    page, wanted = LINKED_PAGES[name]
    assert html_text.main_text(page, TREE) == wanted


def test_article_blocks_are_kept_whatever_stands_beside():
    sizes = (1, 3, 7, 8, 18, 60)
    for words in sizes:
        for near in [(a, x, b, y) for a in (0, *sizes) for b in (0, *sizes) for x in (0.0, 1.0) for y in (0.0, 0.5, 1.0)]:
            for links in (0.0, 0.5, 1.0):
                for run, longest in ((0, 3), (0, 60), (words, 60), (60, 60), (words, words)):
                    assert html_text.classify(TREE, (words, links, *near, 0, 1, 0, run, longest, 0)) == 1


def test_rest_blocks_go_whatever_stands_beside():
    for words in (1, 2, 3, 5, 7, 8, 14, 18, 30, 60, 200):
        for near in [(a, x, b, y) for a in (0, 2, 10, 40, 60) for b in (0, 2, 10, 60) for x in (0.0, 1.0) for y in (0.0, 1.0)]:
            for links in (0.0, 0.5, 0.9, 1.0):
                for article, heading, longest, outside in [(a, h, n, o) for a in (0, 1) for h in (0, 1) for n in (0, 3, 7, 20, 60) for o in (0, 1) if not (a and o)]:
                    assert html_text.classify(TREE, (words, links, *near, 1, article, heading, 0, longest, outside)) == 0


PLAIN_PAGES = {
    "short blocks alone": ("<body><h1>News</h1><p>It rained today.</p></body>", "News\nIt rained today."),
    "one short block": ("<p>Hello world</p>", "Hello world"),
    "short blocks and a menu": ("<nav><a href=1>One</a></nav><p>Hello world</p><div class=footer>Imprint</div>", "Hello world"),
    "terms": ("<dl><dt>Red</dt><dd>a color</dd><dt>Four</dt><dd>a number</dd></dl>", "Red\na color\nFour\na number"),
    "list": (f"<p>{BODY}</p><ul><li>one<li>two<li>three</ul><p>five words</p>", f"{BODY}\none\ntwo\nthree\nfive words"),
    "table": (f"<p>{BODY}</p><table><tr><td>a<td>b<tr><td>1<td>2</table>", f"{BODY}\na\nb\n1\n2"),
    "quote": (f"<p>{BODY}</p><blockquote>So it is.</blockquote><p>Yes.</p><p>No more.</p>", f"{BODY}\nSo it is.\nYes.\nNo more."),
    "math": (f"<article><p>{BODY}</p><p>Then <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p></article>", f"{BODY}\nThen x=1 holds."),
}
WORDS = "ten words of another story stand in this card"
BESIDE_PAGES = {
    "linked blocks": (f"<div><p>{BODY}</p><p>{BODY}</p></div><a href=1><div>{WORDS}</div></a><a href=2><div><h3>Other</h3>{WORDS}</div></a>", f"{BODY}\n{BODY}"),
    "open link": (f"<div><p><a href=1>{BODY}<p>{BODY}<p>{BODY}</div>", f"{BODY}\n{BODY}\n{BODY}"),
    "anchor": (f"<div><a name=top><p>{BODY}</p></a><p>{BODY}</p></div>", f"{BODY}\n{BODY}"),
    "notice": (f"<div class='cc-window'><p>{BODY}</p></div><h1>Headline</h1><article><p>{BODY}</p><p>{BODY}</p></article>", f"Headline\n{BODY}\n{BODY}"),
    "advert": (f"<article><p>{BODY}</p><div data-ad='3'><p>Buy {BODY}</p></div><p data-adjusted=1>{BODY}</p></article>", f"{BODY}\n{BODY}"),
    "reactions": (f"<article><p>{BODY}</p><div class='reader-reactions'><p>Nice {BODY}</p></div></article>", BODY),
    "teaser cards": (f"<div><p>{BODY}</p><p>{BODY}</p></div><div><article>Next story</article></div>", f"{BODY}\n{BODY}\nNext story"),
}


@pytest.mark.parametrize("name", PLAIN_PAGES)
def test_plain_pages_lose_nothing(name):
    page, wanted = PLAIN_PAGES[name]
    assert html_text.main_text(page, TREE) == wanted


@pytest.mark.parametrize("name", BESIDE_PAGES)
def test_parts_beside_the_text(name):
    page, wanted = BESIDE_PAGES[name]
    assert html_text.main_text(page, TREE) == wanted


CLOSED = f"<p>{BODY}</p>"
SKIPPED_PAGES = {
    "self-closed": (f"<article><p>One <svg width=\"1\"/>two <canvas/></p>{CLOSED}</article>", f"One two\n{BODY}"),
    "slash of a value": (f"<article><p>One <object data=/x/>gone</object>two</p>{CLOSED}</article>", f"One two\n{BODY}"),
    "unclosed button": (f"<article><div><button>Go</div>{CLOSED}</article>", BODY),
    "unclosed in the body": (f"<button>Go {CLOSED}{CLOSED}<button>Close</button>{CLOSED}", f"{BODY}\n{BODY}\n{BODY}"),
    "closed after its block": (f"<article><div><object>Gone</div>{CLOSED}</object>{CLOSED}</article>", f"{BODY}\n{BODY}"),
    "blocks inside": (f"<article>{CLOSED}<template><div>{CLOSED}</div></template><button><p>Go<p>there</button>{CLOSED}</article>", f"{BODY}\n{BODY}"),
    "nested": (f"<article>{CLOSED}<object>a<object>b</object>c</object>{CLOSED}</article>", f"{BODY}\n{BODY}"),
    "self-closed frame": (f"<article>{CLOSED}<iframe src='a' />{CLOSED}</article>", f"{BODY}\n{BODY}"),
}
NAMES = ("overflow-hidden", "tag-social-media", "has-modal", "ad-free", "category-notification", "modal", "comments")


@pytest.mark.parametrize("name", SKIPPED_PAGES)
def test_skipped_parts_end(name):
    page, wanted = SKIPPED_PAGES[name]
    assert html_text.main_text(page, TREE) == wanted


@pytest.mark.parametrize("name", NAMES)
def test_names_do_not_empty_an_article(name):
    for page in (f"<div class='{name}'><article>{CLOSED}</article></div>", f"<article class='post {name}'>{CLOSED}</article>", f"<div id={name}><main>{CLOSED}</main></div>"):
        assert html_text.main_text(page, TREE) == BODY


def test_names_beside_an_article_are_rest():
    other = f"<p>Other {BODY}</p>"
    for name in ("comments", "comment-list", "ad-container", "cookie-notice", "related-posts", "shareButtons", "ads-by-us"):
        for page in (
            f"<main>{CLOSED}<div class={name}>{other}</div></main>",
            f"<main>{CLOSED}<div class={name}><article>{other}</article></div></main>",
            f"<article>{CLOSED}</article><div class={name}><article>{other}</article></div>",
            f"<article>{CLOSED}</article><div class={name}>{other}</div>",
        ):
            assert html_text.main_text(page, TREE) == BODY


def test_long_pages_take_linear_time():
    import time

    start = time.perf_counter()
    for page in ("<" * 200_000, "<p " * 60_000, "<p a='" * 40_000, "&" * 200_000, "<div>" * 20_000 + "x", "<!--" * 50_000, "</p>" * 50_000):
        html_text.main_text("<article><p>" + page, TREE)
    assert time.perf_counter() - start < 30


def test_many_skipped_tags_take_linear_time():
    import time

    start = time.perf_counter()
    for page in ("<button>" * 50_000, "<svg>" * 50_000, "<svg/>" * 50_000, "<iframe/>" * 50_000, "<p><object>" * 20_000, "<svg></svg>" * 50_000):
        html_text.main_text("<article><p>" + page, TREE)
    assert time.perf_counter() - start < 30


def test_tree_learns_its_table():
    for *row, label in html_text.LABELLED_BLOCKS:
        assert html_text.classify(TREE, row) == label


def test_extract_pages(spark):
    rows = [(i, f"u{i}", page, "x", 1) for i, (page, _) in enumerate(PAGES.values())]
    rows += [(None, None, None, None, None), (0, "u0", rows[0][2], "x", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    found = html_text.extract_pages(table).collect()
    wanted = [text for _, text in PAGES.values()] + ["", next(iter(PAGES.values()))[1]]
    assert sorted((r.text, r.n_chars) for r in found) == sorted((t, len(t)) for t in wanted)
    assert html_text.extract_pages(table.limit(0)).count() == 0
