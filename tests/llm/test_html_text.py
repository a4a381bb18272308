import pytest

from tallyframe.llm import html_text

LONG, MORE = ("long text " * 40).strip(), ("more text " * 30).strip()


def test_blocks_choose_the_text_also_where_an_article_is_marked():
    story = "<div>" + "<p>" + "long text " * 40 + "</p></div>"
    links = "<a href=/>a</a><br>" * 4
    assert html_text.main_text(story + links + "<article><p>A teaser.</p></article>") == ("long text " * 40).strip()
    page = "<p>Near.</p><article><h1>Title</h1><p>" + "long text " * 40 + "</p><ul>" + "<li><a href=/>source</a>" * 4 + "</ul><p>Last.</article><p>Beside.</p>"
    assert html_text.main_text(page) == "Title " + "long text " * 40 + "source " * 4 + "Last."


def test_the_stretches_choose_the_text(monkeypatch):
    story, other = "long text " * 40, "more text " * 40
    page = f"<article><p>{story}</p></article><p>Beside.</p><article><p>{other}</p></article>"
    assert html_text.main_text(page) == f"{story}{other}".strip()
    monkeypatch.setattr(html_text, "_stretches", lambda size: [(len(size) - 1, len(size), True)])
    assert html_text.main_text(page) == other.strip()


@pytest.mark.parametrize("part", ['<p class="advert">{}</p>', '<p id="cookie-notice">{}</p>', "<p hidden>{}</p>", '<p role="alert">{}</p>', '<p class="newsletter">{}', '<p class="ad"><span class=x>{}</p>', '<div class="ad-slot-3">{}</div>', '<p class=sponsored>{}<ul><li>Kept.</ul>'])
def test_parts_that_are_not_text(part):
    got = html_text.main_text(f"<article><p>{LONG}</p>{part.format('Buy one of these.')}<p>{MORE}</p></article>")
    assert got == f"{LONG} {'Kept. ' if '<li>' in part else ''}{MORE}"


@pytest.mark.parametrize("name", ["share-price-analysis", "social-history", "alert-systems", "header-files-in-c", "commentary", "page content"])
def test_names_that_only_hold_such_a_word(name):
    assert html_text.main_text(f'<article><p>{LONG}</p><div class="{name}"><p>{MORE}</p></div></article>') == f"{LONG} {MORE}"




def test_div_article_keeps_both_sides_of_an_aside():
    aside = "<aside>" + "<p>An advert of some length.</p>" * 4 + "</aside>"
    page = f"<nav><p>Menu</p></nav><div><h1>Title</h1><p>3 May</p><p>By Jo</p><p>{LONG}</p>{aside}<p>{MORE}</p><p>End.</p></div><footer>Us</footer>"
    assert html_text.main_text(page) == f"Title 3 May By Jo {LONG} {MORE} End."


def test_stretches_are_joined_over_a_list_of_links():
    links = "<ul>" + "<li><a href=/>Another page</a>" * 5 + "</ul>"
    page = f"{links}<div><h1>A title</h1><p>3 May</p><p>By <a href=/>Jo Doe</a></p><p>{LONG}</p>{links}<p>{MORE}</p></div>{links}"
    assert html_text.main_text(page) == f"A title 3 May By Jo Doe {LONG} {MORE}"


def test_own_paragraphs_of_links_stay():
    page = f"<div><p><a href=/>A series</a></p><p>{LONG}</p><p>See <a href=/>the whole of the report</a></p><p>{MORE}</p><p><a href=/>Source</a></p></div><div><a href=/>Privacy</a></div>"
    assert html_text.main_text(page) == f"A series {LONG} See the whole of the report {MORE} Source"


def test_all_articles_of_a_page():
    links = "<p><a href=/>Another page</a>" * 5
    assert html_text.main_text(f"<article>{LONG}</article>{links}<article>Short.</article>{links}<article>{MORE}</article>{links}") == f"{LONG} Short. {MORE}"
    assert html_text.main_text(f"<main><h1>Title</h1><article>{LONG}</article></main>") == f"Title {LONG}"


def test_repeated_rows_clashing_columns_and_null_pages(spark):
    rows = [(1, "u", "<p>one two</p>", "x"), (1, "u", "<p>one two</p>", "y"), (None, None, None, None), (2, "v", "", "z")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got.collect()) == [("1", "one two", 7), ("1", "one two", 7), ("2", "", 0), ("None", "", 0)]
