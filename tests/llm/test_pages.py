"""Main text of pages: registered pages against the article as an HTML parser reads it, and odd pages."""

from __future__ import annotations

import html
import re
import time
from html.parser import HTMLParser

import pytest

from ripplenet.llm import html_paths, queries

LONG = "This paragraph goes on for a while, as those of articles do; it has commas, and more than one sentence. It ends here."


class Article(HTMLParser):
    """Blocks of the article element; a block starts at every block tag."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if self.depth and tag in html_paths.BLOCKS:
            self.blocks.append("")
        if self.depth and tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if self.depth and tag in html_paths.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_pages_give_the_article(spark, sf):
    source = {r.page_id: r for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    rows = queries.op3_tag_paths(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(source)
    for r in rows:
        page = Article()
        page.feed(source[r.page_id].html or "")
        page.close()
        want = "\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in page.blocks) if x)
        assert (r.text, r.n_chars, r.url) == (want, len(want), source[r.page_id].url)


def article(inner: str) -> str:
    return f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title</h1><p>{LONG}</p>{inner}<p>{LONG}</p></article><footer>Imprint</footer></body></html>"


def around(middle: str) -> str:
    return "\n".join(["Title", LONG, *([middle] if middle else []), LONG])


@pytest.mark.parametrize(
    ("inner", "middle"),
    [
        ("<p>Then <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>", "Then x=1 holds."),
        ("<p>See <object data=a.swf>the fallback</object> and <noscript>plain text</noscript>.</p>", "See the fallback and plain text."),
        ('<p class="share-price">Shares rose by two percent.</p>', "Shares rose by two percent."),
        (f'<section class="related-work"><p>{LONG}</p></section>', LONG),
        ("<ul><li>One item</li><li>Another</ul>", "One item\nAnother"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<div>A short line.</div>", "A short line."),
        (f'<div class="comments"><p>{LONG}</p></div>', ""),
        ('<div class="ad-box">Buy now.</div>', ""),
        ("<script>var a = '<p>no</p>'</script ><STYLE>p{}</sTyLe><svg><text>no</text></svg>", ""),
        ("<p>&lt;b&gt; &amp;amp; &eacute;&#8230;</p>", "<b> &amp; é…"),
        ("<form><p>Subscribe</p></form><aside>More</aside>", ""),
    ],
)
def test_what_belongs_to_the_article(inner, middle):
    assert html_paths.main_text(article(inner)) == around(middle)


@pytest.mark.parametrize(
    ("inner", "middle"),
    [
        ('<div class="para">He left.</div>', "He left."),
        ('<section class="s2"><h2>Two</h2><p>He left.</p></section>', "Two\nHe left."),
        ('<div class="highlight"><pre>print(1)</pre></div>', "print(1)"),
        ('<h2>References</h2><ul><li><a href="x">Ref one</a></li><li><a href="y">Ref two</a></li></ul>', "References\nRef one\nRef two"),
        ("<details><summary>More</summary>He left.</details>", "More\nHe left."),
        ("<p>Press <button>Go</button> or pick <select><option>One</option></select> now.</p>", "Press Go or pick One now."),
    ],
)
def test_short_parts_of_an_article_with_long_paragraphs(inner, middle):
    """Six sentences a paragraph around them: what a score below the page's best may not cost."""
    six = " ".join(f"This is sentence number {i}, of a long paragraph that says a lot." for i in range(6))
    page = f"<body><nav><a href=1>Home</a></nav><article><p>{six}</p>{inner}<p>{six}</p></article><footer>Foot</footer></body>"
    assert html_paths.main_text(page) == f"{six}\n{middle}\n{six}"


def test_an_unnamed_advert_beside_the_article_is_left_out():
    page = f'<body><div class="x7"><p>Buy our things now.</p></div><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article><div class="x7"><p>And more things.</p></div></body>'
    assert html_paths.main_text(page) == "\n".join([LONG] * 3)


def test_paths_select_where_no_article_is_marked():
    page = f'<body><div class="q1"><a href=/>Home</a> <a href=/b>Blog</a></div><div class="q2"><h2>Head</h2><p>{LONG}</p><p>{LONG}</p></div><div class="q3">All rights reserved</div></body>'
    assert html_paths.main_text(page) == "\n".join(["Head", LONG, LONG])


def test_all_sibling_articles_are_returned():
    page = f"<body><article id=a><h1>One</h1><p>{LONG}</p></article><article id=b><h1>Two</h1><p>{LONG} {LONG}</p></article></body>"
    assert html_paths.main_text(page) == "\n".join(["One", LONG, "Two", f"{LONG} {LONG}"])


def test_letters_that_change_length_in_lower_case():
    page = article("İ" * 200 + "<script>x</script>" + "<p>after</p>")
    assert html_paths.main_text(page) == around("İ" * 200 + "\nafter")


@pytest.mark.parametrize("unit", ["<div>x y z, a.", "<b>x, ", "<p>x, <b>", "<ul><li>x, ", "<svg>x, ", "<a href='>x, ", "<table><td>x, "])
def test_deep_and_unclosed_markup_takes_time_in_proportion(unit):
    began = time.perf_counter()
    text = html_paths.main_text(unit * 100_000)
    assert time.perf_counter() - began < 8 and isinstance(text, str)


def test_lists_that_are_not_picked_take_time_in_proportion():
    """After a long paragraph the nested lists are judged by their links, each once."""
    began = time.perf_counter()
    page = "<p>" + "A long sentence, with commas, that makes the best score. " * 200 + "</p>" + "<ul><li>x y z, a." * 100_000
    assert html_paths.main_text(page).startswith("A long sentence")
    assert time.perf_counter() - began < 8


def brute_scores(page: str) -> dict[tuple, float]:
    """Ratios of well-formed pages, from plain lists of paths."""
    stack, found = [], {}
    for tag, text in re.findall(r"<([^>]+)>|([^<]+)", page):
        if tag.startswith("/"):
            stack.pop()
        elif tag:
            stack.append(tag)
        elif text.strip():
            found.setdefault(tuple(stack), []).append(html.unescape(text).strip())
    ratio = [(sum(map(len, x)) / len(x), sum(len(re.findall(r"[.,;:!?]", t)) for t in x) / len(x), sum(map(len, x))) for x in found.values()]
    ratio = [ratio[0], *ratio, ratio[-1]]
    mean = lambda i, k: (ratio[i][k] + 4 * ratio[i + 1][k] + ratio[i + 2][k]) / 6
    return {p: mean(i, 0) * (1 + mean(i, 1)) * ratio[i + 1][2] ** 0.5 for i, p in enumerate(found)}


def test_scores_match_plain_path_ratios():
    page = f"<body><div><h1>Head</h1><p>{LONG}</p><p>Short, but good.</p><ul><li>a, b</li><li>c</li></ul></div><section><p>x</p></section></body>"
    root = html_paths.Path(None, "", 1.0)
    paths = {}
    for path, _, text, _ in html_paths.text_nodes(page, root):
        paths[path] = None
        path.chars, path.marks, path.nodes = path.chars + len(text), path.marks + len(re.findall(r"[.,;:!?]", text)), path.nodes + 1
    html_paths.score_paths(list(paths))

    def way(p):
        return (*way(p.parent), p.element) if p.parent else ()

    assert {way(p): pytest.approx(p.score) for p in paths} == brute_scores(page)
