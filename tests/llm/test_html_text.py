from lumenary.llm import queries
from lumenary.llm.html_text import extract_text, main_text

import html
import re

from fixtures import table


def brute(page):
    """The generator's article: its blocks without markup."""
    article = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|div)>|<br>", article)]
    return "\n".join(x for x in blocks if x)


def test_query_against_the_marked_article(spark, sf):
    pages = {r["page_id"]: r for r in table(sf, "pages")}
    rows = queries.op4_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute(pages[r.page_id]["html"]) and r.n_chars == len(r.text) and r.url == pages[r.page_id]["url"]


PROSE = ["First paragraph of the story, long enough to be taken for prose by the window sums &amp; more.", "Second paragraph with a <a href='#'>link</a> inside it, and&nbsp;a break<br>here, also long enough."]


def test_page_without_an_article_mark():
    menu = "".join(f"<li><a href='/{k}'>Item {k}</a></li>" for k in range(12))
    page = f"<html><head><title>T</title><style>p{{}}</style></head><body><ul>{menu}</ul><div class='cookie-notice'>We use cookies on this long notice that says much.</div>"
    page += f"<div><h1>Head</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div><div class='comments'><p>A reader writes a comment that is quite as long as a paragraph of the story.</p></div>"
    page += "<form><p>Subscribe to our letter</p></form><footer>Imprint</footer><script>var x='</div>';</script></body></html>"
    assert main_text(page) == "Head\nFirst paragraph of the story, long enough to be taken for prose by the window sums & more.\nSecond paragraph with a link inside it, and a break here, also long enough."


def test_article_with_asides_and_a_short_end():
    page = f"<body><header>Site</header><article><header><h1>T</h1></header><p>{PROSE[0]}</p><aside><p>a</p><p>b</p><p>c</p><p>d</p></aside><p>End.</p><footer>By X</footer></article><p>{PROSE[1]}</p></body>"
    assert main_text(page) == "T\nFirst paragraph of the story, long enough to be taken for prose by the window sums & more.\nEnd."


def test_broken_markup():
    assert main_text("") == "" and main_text("<p>") == "" and main_text("plain  text\nonly") == "plain text only"
    assert main_text("<div class=ad>An advert left open<article><p>Text <b>bold<p>Next</article>") == "Text bold\nNext"
    assert main_text("<article><p>a <!-- open comment") == "a"
    assert main_text("<article><p title=\"a > b\">x &lt; y</p>" + "<p" * 2000) .startswith("x < y")


def test_nulls_empty_tables_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = spark.createDataFrame([(1, None, None, "t", "n"), (None, "u", "<article>a</article>", "t", "n"), (None, "u", "<article>a</article>", "t", "n")], schema)
    assert [(r.page_id, r.text, r.n_chars) for r in extract_text(rows).collect()] == [(1, "", 0), (None, "a", 1), (None, "a", 1)]
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


def test_small_article_beside_unmarked_text():
    body = "".join(f"<p>{k} {PROSE[0]}</p>" for k in range(6))
    for box in ("<article><p>A teaser.</p></article>", "<main><p>A teaser.</p></main>"):
        text = main_text(f"<body><ul><li><a href='/'>Home</a></li></ul>{box}<hr><div>{body}</div><footer>Imprint</footer></body>")
        assert text.split("\n") == ["A teaser.", *(f"{k} First paragraph of the story, long enough to be taken for prose by the window sums & more." for k in range(6))]


def test_windows_find_the_article_where_nothing_marks_it(sf):
    """The generator's pages without article marks, and with classes that say nothing."""
    same = 0
    pages = table(sf, "pages")
    for r in pages:
        want = brute(r["html"])
        bare = re.sub("</?article>", "", r["html"]).replace('class="ad"', 'class="x1"')
        text = main_text(bare)
        assert want in text or not want or len(text) < len(want)
        same += text == want
    assert same >= 0.9 * len(pages)


def test_article_text_is_kept_by_its_windows_only():
    """A short article beside long unmarked text is a surge by its bonus; an empty one is none."""
    long = "".join(f"<p>{PROSE[0]}</p>" for _ in range(5))
    assert "Teaser of ten" in main_text(f"<article><p>Teaser of ten</p></article><div>{long}</div>")
    assert main_text(f"<article></article><div>{long}</div>").count("First paragraph") == 5
    assert main_text(f"<article>{long}</article><div>A line of the page's own that says little.</div>").count("\n") == 4


STORY = [f"Paragraph {k} of a story, long enough to be taken for prose by the sums over windows." for k in range(6)]


def test_names_that_only_mention_a_sidebar_or_an_advert_drop_nothing():
    body = "".join(f"<p>{p}</p>" for p in STORY)
    for page in (
        f'<div class="layout has-sidebar"><div>{body}</div></div>',
        f'<div class="post ad-free">{body}</div>',
        f'<article class="search">{body}</article>',
        f'<form id="aspnetForm" class="form"><ul><li><a href="/">Home</a></li></ul><div>{body}</div></form>',
        f'<article><section class="related-work">{body[: len(body) // 2]}</section>{body[len(body) // 2 :]}</article>',
        f'<article><p>{STORY[0]}</p><div id="banner-history"><p>{STORY[1]}</p></div>{"".join(f"<p>{p}</p>" for p in STORY[2:])}</article>',
    ):
        assert main_text(f"<html><body><nav>Menu</nav>{page}<footer>Imprint</footer></body></html>").replace("\n", " ").split() == " ".join(STORY).split(), page


def test_marked_boxes_still_go():
    body = "".join(f"<p>{p}</p>" for p in STORY)
    boxes = "".join(f'<div class="{c}"><p>{"Some words of a box that is about as long as a paragraph of the story is. " * 2}</p></div>' for c in ("comment-list", "related-posts", "cookie_notice", "sidebar", "share-buttons top", "ad-container-2", "newsletter signup"))
    assert main_text(f"<html><body>{boxes}<div>{body}</div>{boxes}</body></html>").split("\n") == STORY


def test_a_very_long_page():
    story = [f"Line {k} of a page that goes on and on, with words enough for prose." for k in range(40_000)]
    assert main_text("<body><div class='menu'>x</div><div>" + "".join(f"<p>{p}</p>" for p in story) + "</div></body>") == "\n".join(story)
