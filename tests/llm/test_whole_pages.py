"""Pages whose article stood to be lost whole."""

import pytest

from cataloom.llm.html_extract import extract

ARTICLE = "<article><p>one</p>{}<p>two</p><p>three</p></article>"


@pytest.mark.parametrize(
    "between",
    ['<svg-icon name="x"></svg-icon>', "<video-js></video-js>", "<audio-player/>", "<title-bar></title-bar>", "<svg>", "<video src='x'>", "<object><canvas>", "<svg><title>t</title></svg>", "<script>'<p>'</script>"],
)
def test_raw_elements_end_where_they_end(between):
    assert extract(ARTICLE.format(between), []) == "one\ntwo\nthree"


@pytest.mark.parametrize("name", ["script", "style", "textarea", "title", "iframe"])
def test_unclosed_text_elements_run_to_the_end(name):
    assert extract(ARTICLE.format(f"<{name}>"), []) == "one"


@pytest.mark.parametrize("kind", ["content no-sidebar", "has-sidebar", "with-comments", "header-wrap", "page modal", "banner"])
@pytest.mark.parametrize("inner", [ARTICLE.format(""), "<main><p>one</p><p>two</p><p>three</p></main>", "<p>one</p><p>two</p><p>three</p>"])
def test_marked_wrappers_keep_the_article(kind, inner):
    page = f'<body><div class="ad">Buy</div><div class="{kind}">{inner}<div class="sidebar"><p>more</p></div></div><footer>foot</footer></body>'
    assert extract(page, []) == "one\ntwo\nthree"


def test_marked_parts_still_go():
    said = '<article class="comment-body"><p>A long reply, with a lot to say about it.</p></article>'
    page = f'<body><article><p>one</p><div class="comments">{said}<article><p>Again.</p></article></div></article><div class="sidebar">{"<p>aside text</p>" * 9}</div></body>'
    assert extract(page, []) == "one"
    assert extract(f'<body><div><p>one</p></div><section id="comments"><p>{"long reply " * 20}</p></section></body>', []) == "one"
