"""Pages whose article text lies in more than one place."""

from lumenarc.llm import webtext

LONG = "This is one of the long paragraphs of the page, with many words in it and nothing that is not text. " * 4
NAV = "<nav><a href='/'>Home</a></nav>"


def held(html, *parts):
    text = webtext.main_text(f"<html><body>{NAV}{html}</body></html>")
    assert "Home" not in text
    return [p for p in parts if p.strip() not in text] == []


def test_title_and_lead_outside_the_entry():
    entry = f"<p>{LONG}</p>" * 9
    assert held(f"<div class=post><h1>Title</h1><p>lead</p><div class=entry>{entry}</div></div>", "Title", "lead", LONG)


def test_one_long_part_does_not_stand_alone():
    for tag, row in (("pre", "{}"), ("blockquote", "<p>{}</p>"), ("table", "<tr><td>{}</td></tr>"), ("ul", "<li>{}</li>")):
        assert held(f"<div><p>Before it.</p><{tag}>{row.format(LONG * 3) * 3}</{tag}><p>After it.</p></div>", "Before it.", "After it.", LONG), tag


def test_main_beside_an_article():
    assert held(f"<main><h2>Head</h2><p>{LONG}one</p><p>{LONG}two</p><p>{LONG}three</p></main><article><p>{LONG}card</p></article>", "Head", "one", "two", "three", "card")


def test_two_articles():
    many = "".join(f"<p>{LONG}{k}</p>" for k in range(6))
    assert held(f"<article>{many}</article><article><h2>Second</h2><p>{LONG}second</p></article>", "5", "Second", LONG.strip() + " second")


def test_names_that_only_sound_like_boilerplate():
    for name in ("page no-sidebar", "layout with-sidebar", "sidebar", "form"):
        assert held(f"<div class='{name}'><h1>Title</h1><p>{LONG}</p><p>{LONG}end</p></div>", "Title", "end"), name
    for anchor in ("discussion", "related-work", "legal-aspects", "search-results", "application-form"):
        assert held(f"<article><p>{LONG}</p><h2 id={anchor}>Head</h2><section id={anchor}><p>Short part.</p></section><p>{LONG}end</p></article>", "Head", "Short part.", "end"), anchor
    assert held(f"<article><p>{LONG}</p><h2 class=share>Head</h2></article>", "Head")


def test_named_parts_still_go():
    for part in (f"<div class='box sidebar'><p>{LONG}gone</p></div>", f"<div id=comments><p>{LONG * 9}gone</p></div>"):
        assert "gone" not in webtext.main_text(f"<body><article><p>{LONG}</p><p>{LONG}</p></article>{part}</body>")


PARTS = "".join(f"<p>Paragraph {k} of the article is long enough to be taken for content, with words and more words in it.</p>" for k in range(6))
TEXT = [f"Paragraph {k} of the article is long enough to be taken for content, with words and more words in it." for k in range(6)]


def test_a_wrapper_that_holds_the_page_is_no_form():
    assert webtext.main_text(f'<form id="aspnetForm"><article>{PARTS}</article></form>').split("\n") == TEXT
    assert webtext.main_text(f'<form class="signup"><p>Your name</p></form><article>{PARTS}</article>').split("\n") == TEXT


def test_main_keeps_what_stands_beside_its_one_article():
    last = "The last paragraph of main is long as well, so it stays with the rest of the text."
    assert webtext.main_text(f"<main><h1>Head</h1><article>{PARTS}</article><p>{last}</p></main>").split("\n") == ["Head", *TEXT, last]


def test_long_and_broken_pages_take_time_in_proportion():
    import time

    began = time.perf_counter()
    assert webtext.main_text("<div>" * 20_000 + PARTS).split("\n") == TEXT
    assert webtext.main_text("<b>x" * 20_000) == "x" * 20_000
    assert webtext.main_text("<p>a &amp; b < c" + "<a x='" * 20_000) == "a & b < c"
    assert webtext.main_text(f"<article>{PARTS * 1000}</article>").split("\n") == TEXT * 1000
    assert time.perf_counter() - began < 20


def test_rows_that_repeat_and_clash(spark):
    rows = [(1, "u", PARTS), (1, "u", PARTS), (None, None, None), (2, "v", ""), (3, "w", "<b>" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars", "'x' AS _html")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in webtext.extract(pages).collect()))
    text = "\n".join(TEXT)
    assert got == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0)]
