from __future__ import annotations

import time

import pytest

from panelwright.llm import html_extraction as H

SCHEMA = "page_id long, url string, html string, host string, winner string, text int, path string"


def page(body: str, end: str = "</body></html>") -> str:
    return f'<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>{body}{end}'


ARTICLE = "<article><h1>Head &amp; <i>more</i></h1><p><b>One.<br><p>Two\n  three&nbsp;<a href=x>four</a>.</p><ul><li>a<li>b</ul></article>"
TEXT = "Head & more\nOne.\nTwo three four.\na\nb"
AROUND = (
    '<div class="ad">Buy</div><nav><ul><li><a href="/a">A</a></ul></nav>{}<aside>Side</aside><form><p>Mail <input name=q> us</p></form>'
    '<div id="cookie-notice"><p>Cookies everywhere and a rather long sentence about them.</p></div>'
    '<section class="comments"><p>First!</p></section><footer>&copy; host</footer>'
)

CASES = [
    (page(AROUND.format(ARTICLE)), TEXT),
    (page(AROUND.format(ARTICLE), ""), TEXT),
    (page(AROUND.format(ARTICLE.replace("</article>", '<div class="comment-list"><p>nice</p></div></article>'))), TEXT),
    (page('<div class="wrap"><div class="post-body p7">' + ARTICLE.replace("article", "div") + "</div></div>"), TEXT),
    (page("<article><p>cut &am"), "cut &am"),
    (page("<article><p>cut</p><p class="), "cut"),
    (page("<article><p>1 < 2 and 3 > 2</p><pre>a\tb</pre></article>"), "1 < 2 and 3 > 2\na b"),
    (page("<article><table><tr><td>x<td>y</table><!-- <p>no</p> --></article>"), "x\ny"),
    ("", ""),
    (None, ""),
    ("plain words", "plain words"),
    ("<p>loose</p>", "loose"),
]


@pytest.mark.parametrize("source, want", CASES)
def test_single_pages(source, want):
    parsed = H.parse(source or "")
    assert H.main_text(parsed, H.best_path(parsed)[0]) == want


def test_hosts_agree_on_a_path(spark):
    normal = page('<div class="story-1"><p>' + "A long and good paragraph of the story. " * 5 + "</p></div><div class=\"teaser\"><p>More</p></div>")
    odd = page('<div class="story-99"><p>Short.</p></div><div class="teaser"><p>' + "A teaser that is longer than the story itself. " * 5 + "</p></div>")
    rows = [(k, f"http://h.example/{k}", normal, "h", "w", 1, "p") for k in range(5)]
    rows += [(9, "http://H.example/9", odd, "h", "w", 1, "p"), (9, "http://h.example/9", odd, "h", "w", 1, "p")]
    rows += [(10, None, odd, "h", "w", 1, "p"), (11, "http://h.example/x", None, "h", "w", 1, "p"), (12, "http://h.example/y", page("<article><p>Other</p></article>"), "h", "w", 1, "p")]
    got = H.extracted(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = {}
    for r in got.collect():
        assert r["n_chars"] == len(r["text"])
        text.setdefault(r["page_id"], set()).add(r["text"])
    assert text[9] == {"Short."}
    assert text[10] == {" ".join(["A teaser that is longer than the story itself."] * 5)}
    assert text[11] == {""} and text[12] == {"Other"}
    assert got.count() == len(rows)
    assert H.extracted(spark.createDataFrame([], SCHEMA)).count() == 0


LONG = "A sentence of the long part of the article. " * 12
WHOLE = [
    ('<div class=x><h1>Title</h1><p>Intro</p><section><p>{}</p></section><p>End</p></div><div class="teaser">T</div>', "Title\nIntro\n{}\nEnd"),
    ("<div class=x><section class=s1><p>{}</p></section><section class=s2><p>Short</p></section></div>", "{}\nShort"),
    ('<div class="page-with-sidebar"><article><p>{}</p><div class="comment-list">no</div></article><div class="sidebar">S</div></div>', "{}"),
    ('<div id="main-form-wrapper"><p>{}</p><p>End</p></div>', "{}\nEnd"),
    ('<form id=f><div class="content"><p>{}</p><form><p>Mail</p></form></div></form>', "{}"),
    ('<article><p>{}</p><table class="share-price-table"><tr><td>7</table><div class="search-results">R</div></article>', "{}\n7\nR"),
    ('<article></article><div class="ad"><p>{}</p></div>', ""),
    ('<div class="story"><p>{}</p></div><p>Stray</p><div class="teaser"><p>More</p></div>', "{}"),
    ("<article><p title='it \">{}</p></article>", "{}"),
    ("<article><p>&#" + "9" * 5000 + "; {}</p></article>", "� {}"),
]


@pytest.mark.parametrize("body, want", WHOLE)
def test_nothing_of_an_article_is_lost(body, want):
    parsed = H.read(page(body.replace("{}", LONG)))
    assert H.main_text(parsed, H.best_path(parsed)[0]) == want.replace("{}", LONG.strip())


HOSTILE = ["<div>x", "<div>", "<a ", '<a "', "<a '\"", "<a href='", "<!", "<!-- ", "<p><span>", "<span><li></li>", "<div></x>", "</", "<script", "<td><b>x", "& &#x", "<div class=a1 ", "<script> </script "]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_end_in_time_proportional_to_length(piece):
    seconds = []
    for size in (250_000, 1_000_000):
        source = "<article><p>Text</p>" + piece * (size // len(piece))
        start = time.perf_counter()
        parsed = H.read(source)
        assert H.main_text(parsed, H.best_path(parsed)[0]).startswith("Text")
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 15 and seconds[1] < 10 * seconds[0] + 1
