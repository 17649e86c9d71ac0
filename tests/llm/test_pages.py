"""HTML extraction: malformed pages, linear time, whole articles, and the given pages against a plain extraction."""

import html as entities
import re
import time

import pytest

pytest.importorskip("public_tokenizers")

from mixloom.llm import html, registry  # noqa: E402

SF = "/root/testdata/sf0.001"
ARTICLE = "".join(f"<p>Paragraph {i} of the article has a good many words in it, as such paragraphs do.</p>" for i in range(6))


def page(inside="", before="", after=""):
    return f"<html><body>{before}<article><h1>Title</h1>{ARTICLE}{inside}</article>{after}</body></html>"


def test_given_pages_hold_their_articles(spark):
    blocks = r"</?(?:p|h[1-6]|div|ul|ol|li|table|tr|td|th|blockquote|pre|section|article|hr|dl|dt|dd|figure|figcaption)\b[^>]*>"
    given = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r["page_id"]: r for r in registry.op10_html_extraction(spark, SF).collect()}
    assert len(found) == len(given)
    for row in given:
        inside = re.search(r"<article[^>]*>(.*)</article>", row["html"] or "", re.S)
        text = inside[1] if inside else ""
        text = re.sub(r"<!--.*?-->|<(script|style|nav|aside|form|footer)\b.*?</\1>", "", text, flags=re.S)
        text = re.sub(r"<br\s*/?>", " ", text)
        lines = re.sub(r"<[^>]*>", "", re.sub(blocks, "\0", text)).split("\0")
        wanted = "\n".join(filter(None, (" ".join(entities.unescape(x).split()) for x in lines)))
        assert found[row["page_id"]]["text"] == wanted
        assert found[row["page_id"]]["n_chars"] == len(wanted)


BROKEN = [
    "<![foo[bar]]>", "<![ %x[", "&#" + "9" * 5000, "&#" + "0" * 5000 + "65;", "<!", "<", "</", "<a", '<a b="', "<!--", "<script>x",
    "<p>a <b c", "<![CDATA[ x ]]>", "<a\0b>", "</a <b>", "<p/ / =x>", "<=>", "\0", "<title>x", "&#x" + "f" * 9000, "<div class='ad",
]


@pytest.mark.parametrize("broken", BROKEN)
def test_malformed_markup_takes_no_article_along(broken):
    clean = html.main_text(page())
    assert clean.count("\n") == 6
    html.main_text(broken)
    for cut in range(0, len(page()), 97):
        html.main_text(page()[:cut] + broken)
    found = html.main_text(page(f"<p>{broken} end</p>" + ARTICLE) + "</html>")
    assert found.startswith(clean)


def test_references_are_bounded():
    assert html.main_text("<p>&#0000000065;&#00000000000066 &#99999999a &#65x</p>") == "AB �a Ax"


@pytest.mark.parametrize(
    "unit", ['<div class="', "<a ", "<", "</a", "<!--", "<![x", "<a b='", "<section>", "</div>", "<nav>", "<title>", "<b x=\"><", "<p>x"]
)
def test_time_is_linear(unit):
    spent = []
    for size in (40_000, 320_000):
        text = unit * (size // len(unit))
        start = time.process_time()
        html.main_text(text)
        spent.append(time.process_time() - start)
    assert spent[1] < 20 * max(spent[0], 0.02)


@pytest.mark.parametrize("name", ["notice-period", "search-engines", "ad-hoc", "sharing-economy", "comment-free", "headlines"])
def test_class_words_inside_other_names_drop_nothing(name):
    for kind in ("class", "id"):
        inside = f"<div {kind}='{name}'><p>These words belong to the article, whatever its class says.</p></div>"
        assert "These words belong" in html.main_text(page(inside))


@pytest.mark.parametrize("name", ["ad", "cookie-banner", "site-footer", "comments", "comment-list", "ad slot1", "related-links"])
def test_parts_around_go(name):
    inside = f"<div class='{name}'><p>Please buy what we sell, it is cheap and good and lasts for long, they say.</p></div>"
    for where in ({"inside": inside}, {"before": inside}, {"after": inside}):
        assert html.main_text(page(**where)) == html.main_text(page())


def test_lists_of_links_inside_an_article_are_menus():
    links = "".join(f"<li><a href='/{i}'>Another page number {i}</a></li>" for i in range(30))
    assert html.main_text(page(f"<ul>{links}</ul>")) == html.main_text(page())
    one = "<p><a href='/x'>A paragraph that is a link</a></p>"
    assert "A paragraph that is a link" in html.main_text(page(one + ARTICLE))


def test_unmarked_text_beside_a_marked_box():
    text = "<html><body><div class='entry'><a href='/'>Teaser</a></div><div>" + ARTICLE + "</div></body></html>"
    assert html.main_text(text).count("Paragraph") == 6
