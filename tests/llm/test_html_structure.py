"""Names inside the article, and pages that a backtracking scanner would read in quadratic time."""

import os
import time

import pytest

from brindle.llm import html_extract

WORDS = " ".join(f"word{i}" for i in range(30))


@pytest.mark.parametrize("inner", [
    f'<section id="related-work"><p>{WORDS}</p></section>',
    f'<section id="discussion"><h2 id="search-results">A heading</h2><p>{WORDS}</p></section>',
    f'<div class="article-header"><h1>A title</h1><p>{WORDS}</p></div>',
    f'<div class="story-header"><p>{WORDS}</p></div><div class="legal-analysis"><p>{WORDS}</p></div>',
])
def test_names_of_content_stay(inner):
    text = html_extract.main_text(f"<body><article><p>{WORDS}</p>{inner}<p>{WORDS}</p></article></body>")
    assert text.count(WORDS) == 2 + inner.count(WORDS) and ("h1" not in inner or "A title" in text) and ("h2" not in inner or "A heading" in text)


@pytest.mark.parametrize("inner", [
    '<div class="ad">Buy the new thing today</div>', '<div class="ad-slot"><p>Buy the new thing today</p></div>', '<div id="comments"><p>I liked the new thing a lot today</p></div>',
    '<section class="comments"><p>I liked the new thing a lot today</p></section>', '<ul class="social-share"><li>new thing</li></ul>', '<div class="newsletter-signup">Get the new thing by mail</div>', '<form><p>the new thing</p></form>',
    '<div class="related-links"><a href="/">new thing</a></div>', '<div style="display: none">new thing</div>', '<div class="article-promo"><a href="/">new thing here and there</a></div>',
])
def test_regions_in_the_article_go(inner):
    assert html_extract.main_text(f"<body><article><p>{WORDS}</p>{inner}<p>{WORDS}</p></article></body>") == f"{WORDS}\n\n{WORDS}"


@pytest.mark.parametrize("part", ["<a ", '<a "', "<!", "<?", "<title>", "<div>", "</p>", "<p <p", "<a b='", "<svg><b>", "<!--"])
def test_long_broken_pages_take_linear_time(part):
    began = time.process_time()
    html_extract.main_text(part * 60_000 + "</i>" * 60_000 + "<div>" * 20_000 + "</p>" * 20_000)
    assert time.process_time() - began < 15


def test_article_words_of_the_tables():
    """Precision and recall of words against the article element of the generated pages."""
    folder = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables here")
    import html
    import re

    import pyarrow.parquet as pq

    kept = wanted = both = 0
    for page in pq.read_table(folder)["html"].to_pylist():
        inside = re.search(r"<article>(.*?)</article>", page or "", re.S)
        if not inside:
            continue
        body = re.sub(r'<div class="ad">.*?</div>|<(script|style|form|aside|nav)\b.*?</\1>|<!--.*?-->', " ", inside[1], flags=re.S)
        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = html_extract.main_text(page).split()
        kept, wanted, both = kept + len(got), wanted + len(want), both + min(len(got), len(want))
    assert wanted and both >= 0.99 * wanted and both >= 0.99 * kept
