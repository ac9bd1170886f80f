"""Article text that words of classes, quotes and thin containers must not cost."""

import time

import pytest

from cataloom.llm.html_extract import Page, extract

AROUND = "<html><body><nav>menu</nav><article>{}</article><footer>foot</footer></body></html>"


def text(inside):
    return extract(AROUND.format(inside), [])


def test_words_of_classes_inside_an_article():
    inside = '<h2 class="section-header">Head</h2><p class="search-theory">Theory.</p><section id="related-work"><p>Work.</p></section><p class="notice">Note <math><mi>x</mi></math></p><div class="header"><p>By me</p></div>'
    assert text(inside) == "Head\nTheory.\nWork.\nNote x\nBy me"


def test_furniture_inside_an_article_goes():
    inside = "<p>Body text, long enough to win.</p><ol class='commentlist'><li>I disagree</li></ol><p class='comment'>me too</p><div class='ad-banner'>Buy</div><div class='related-posts'>See</div><div class='share_buttons'>Share</div><aside>Aside</aside>"
    assert text(inside) == "Body text, long enough to win."
    assert text("<p>Body text.</p><section class='commentary'><p>A comment on it.</p></section>") == "Body text.\nA comment on it."


def test_quotes_open_a_value_only_behind_an_equals_sign():
    assert text("<p data-x=it's>Hello one</p><p>the world's end</p>") == "Hello one\nthe world's end"
    assert extract('<p class="x>Hello</p><p>then</p>', []) == "Hello\nthen"
    assert text("<p title='a > b'>one</p><p title=\"c > d\" >two</p>") == "one\ntwo"


@pytest.mark.parametrize("piece", ["<a ", '<a b="', "<a b='\"", "<!-- ", '<div class="x', "<script>", "<p ", "</", '<a ="> <b =\'>'])
def test_time_is_linear_in_what_nothing_closes(piece):
    began = time.time()
    assert text("<p>x</p>" + piece * 100_000).startswith("x")
    assert time.time() - began < 5


def test_a_thin_winner_is_passed_over():
    page = "<html><body><div class='teaser'><p>Short teaser.</p></div><div class='story'><p>" + "Long article text, and more. " * 40 + "</p></div></body></html>"
    path = next(p for p in Page(page).path if "teaser" in p)
    assert extract(page, [path]).startswith("Long article") and extract(page.replace(" and more. " * 1, ""), [path]).startswith("Long article")
    even = page.replace("Long article text, and more. " * 40, "Short story.")
    assert extract(even, [path]) == "Short teaser."
