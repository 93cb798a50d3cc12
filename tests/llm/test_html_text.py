"""Main text of pages that mark no article, or more than one."""

import time

import pytest

from sievemark.llm.html_text import main_text

LONG, CLOSING = "A sentence of the article. " * 150, "How the matter ended. " * 41
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(5)) + "</ul>"


def blocks(*texts):
    return "\n\n".join(" ".join(t.split()) for t in texts)


def test_text_behind_an_advert_stays():
    for cut in ('<div class="ad">Buy this</div>', "<aside>See also</aside>", '<p class="promo">Buy<p>'):
        for closing in (CLOSING, "The end."):
            page = f"<html><body><nav>{MENU}</nav><div><p>{LONG}</p>{cut}<p>{closing}</p></div><footer>Imprint</footer></body></html>"
            assert main_text(page) == blocks(LONG, closing)


def test_short_and_small_stretches_stay():
    assert main_text("<body><p>Closed today.</p></body>") == "Closed today."
    assert main_text(f"<body>{MENU}<p>Closed today.</p>{MENU}<p>{LONG}</p>{MENU}<p>{CLOSING}</p>{MENU}<p>Good night, all of you.</p></body>") == blocks("Closed today.", LONG, CLOSING, "Good night, all of you.")


def test_lists_of_links_go_and_links_within_text_stay():
    page = f'<body>{MENU}<p>{LONG}</p><p>See <a href="/x">the whole report of last year</a></p><p>{CLOSING}</p>{MENU}</body>'
    assert main_text(page) == blocks(LONG, "See the whole report of last year", CLOSING)


def test_all_article_regions_stay():
    page = f"<body><p>{LONG}</p><article><p>{LONG}</p></article><div>Outside</div><article><p>{CLOSING}</p><article>Nested</article></article><p>Outside</p></body>"
    assert main_text(page) == blocks(LONG, CLOSING, "Nested")
    page = f'<body><div itemprop="articleBody">{CLOSING}</div><div>Outside</div><div itemprop="articleBody">{LONG}</div></body>'
    assert main_text(page) == blocks(CLOSING, LONG)


SENTENCE = "A sentence of the article here. " * 8
ARTICLE = f"<p>{SENTENCE}</p>"


@pytest.mark.parametrize("name", ["layout-with-sidebar", "no-sidebar", "content has-comments"])
@pytest.mark.parametrize("page", ["<body><div class='{}'>{}</div></body>", "<article><div class='{}'>{}</div></article>"])
def test_classes_that_tell_of_what_is_beside(name, page):
    assert main_text(page.format(name, ARTICLE)) == SENTENCE.strip()


@pytest.mark.parametrize("page", ["<div class='page sidebar'><main>{}</main></div>", "<main><div class='search-results'>{}</div></main>", "<div id=banner><div class=menu><article>{}</article></div></div>"])
def test_wrappers_around_the_article(page):
    assert main_text(page.format(ARTICLE)) == SENTENCE.strip()


@pytest.mark.parametrize("beside", ["<div class=sidebar><article>teaser</article></div>", "<ol class=comments><li><article>{}{}</article></ol>", "<div class=related><main>{}{}</main></div>"])
def test_articles_that_are_not_the_page(beside):
    assert main_text(f"<div class=content>{ARTICLE}</div>" + beside.format(ARTICLE, ARTICLE)) == SENTENCE.strip()


def test_items_without_end_tags_and_slashes_in_values():
    assert main_text("<main><ul><li class=ad>buy<li>one<li>two</ul></main>") == "one\n\ntwo"
    assert main_text(f"<main><div class=ad data-u=/x/>buy</div>{ARTICLE}</main>") == SENTENCE.strip()


@pytest.mark.parametrize("page", ["<div class=sidebar>" * 15000 + "<article>" * 15000, "<div class=comments>" * 15000 + "x<article>" * 15000, "<main>" + "<div class=sidebar>x" * 20000, "<li class=ad>" * 30000])
def test_deep_wrappers_are_quick(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 2
