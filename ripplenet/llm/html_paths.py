"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path (elements with their classes).  Per path, text length and punctuation
per node are collected over the page, smoothed along the page's order of paths, and fused to one score with
the share of text outside links and a factor for names that sites give to notices, adverts and comments.
Paths whose score reaches a share of the page's best are selected.  The content is the smallest element that
holds the selected paths; inside it a container counts only if it holds a selected path itself, and with it the
headings, lists and tables that stand beside the selected paths.  Menus, footers, sidebars and forms by their elements
score nothing.  Within an article element nothing is left to scores but what is mostly links: short paragraphs, sections and
details belong to it, and so do its lists of links.

A page is one row and one call: the scan reads three columns, nothing is shuffled.  Paths are numbers of
a tree, so deep and unclosed markup costs no more than flat markup of its length.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
HINT = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
# White space and punctuation as HTML and common writing systems have them.
GAPS = re.compile(r"[ \t\n\x0b\x0c\r\xa0  -     　]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe svg textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE = frozenset("nav aside footer form menu dialog button select head".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th figure figcaption hr address".split())
LISTS = frozenset("ul ol dl table".split())
CONTENT = frozenset("article main".split())
#: What a hinted name leaves of the scores below it.
HINT_FACTOR = 0.002
# Class names of other things than content, and what such names are combined with.
HINTS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal navbar"
    " nav navigation newsletter notice notices popup promo related reply replies share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
FILLERS = frozenset(
    "area articles bar block body bottom box buttons center column container content form header holder inner item items left link links list main outer page"
    " post posts right row section site slot text thread top unit wrap wrapper".split()
)


class Path:
    """An element's place among the tag paths of a page, and the sums over its text nodes."""

    __slots__ = ("article", "chars", "children", "element", "factor", "inside", "linked", "links", "marks", "nodes", "parent", "score", "top", "whole")

    def __init__(self, parent: Path | None, element: str, factor: float):
        self.parent, self.element, self.factor = parent, element, factor
        self.children: dict[str, Path] = {}
        self.chars = self.marks = self.nodes = self.linked = 0
        self.whole = self.links = 0  # characters at or below, and those in links
        self.score = self.top = 0.0
        self.inside = element in CONTENT or (parent is not None and parent.inside)
        self.article = element == "article" or (parent is not None and parent.article)


def hinted(names: str) -> bool:
    """Whether a class, id or role is one of HINTS, or joins HINTS and FILLERS only."""
    for name in names.split():
        parts = WORD.findall(name)
        if any(x in HINTS for x in parts) and all(x in HINTS or x in FILLERS for x in parts):
            return True
    return False


def text_nodes(page: str, root: Path) -> Iterator[tuple[Path, int, str, bool]]:
    """(path, block number, text, in a link) of each text node in order; paths grow under ``root``."""
    path, block, at = root, 0, 0
    stack: list[tuple[str, Path, bool]] = []  # element, its path, inside a link
    places: dict[str, list[int]] = defaultdict(list)  # element -> places in the stack
    unclosed: set[str] = set()

    def pop_to(n: int) -> None:
        nonlocal path
        while len(stack) > n:
            places[stack.pop()[0]].pop()
        path = stack[-1][1] if stack else root

    while True:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text.strip():
            yield path, block, text, bool(stack) and stack[-1][2]
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name == "br":
            yield path, block, " ", False
        if name in BLOCKS:
            block += 1
        if m[1] or m[4]:
            if places[name]:
                pop_to(places[name][-1])
            continue
        if name in RAW:
            end = None if name in unclosed else re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(name)
            continue
        if name in VOID:
            continue
        if name in BLOCKS and places["p"]:
            pop_to(places["p"][0])
        elif name in CLOSES:
            last = max((places[x][-1] for x in CLOSES[name] if places[x]), default=-1)
            if last > max((places[x][-1] for x in LISTS if places[x]), default=-1):
                pop_to(min(p for x in CLOSES[name] for p in places[x] if p > max((places[y][-1] for y in LISTS if places[y]), default=-1)))
        found = [(h[0].lower(), (h[1] or h[2] or h[3]).lower()) for h in HINT.findall(m[3] or m[6] or "")]
        label = " ".join([name, *(v for k, v in found if k == "class")])
        waste = any(hinted(v) for _, v in found) and name not in ("html", "body", "main")
        if (step := path.children.get(key := label + "!" * waste)) is None:
            spoken = name in ("button", "select") and places["p"]  # part of a sentence
            none = (name in BOILERPLATE and not spoken) or (name == "header" and not path.inside)
            step = path.children[key] = Path(path, name, 0.0 if none else path.factor * (HINT_FACTOR if waste else 1.0))
        places[name].append(len(stack))
        stack.append((name, step, name == "a" or (bool(stack) and stack[-1][2])))
        path = step


def score_paths(paths: list[Path]) -> None:
    """Fused, smoothed ratio of each tag path, given in the order of the page."""
    ratios = [(p.chars / p.nodes, p.marks / p.nodes) for p in paths]
    smooth = lambda i, k: (ratios[max(i - 1, 0)][k] + 4 * ratios[i][k] + ratios[min(i + 1, len(ratios) - 1)][k]) / 6
    for i, p in enumerate(paths):
        p.score = smooth(i, 0) * (1 + smooth(i, 1)) * (1 - p.linked / p.chars) * p.chars**0.5 * p.factor


def select_paths(paths: list[Path], root: Path, share: float) -> set[Path]:
    """Paths of the content: the selected ones and the flow around them, under their common element.

    The threshold is ``share`` of the best score, and a tenth of it inside article and main elements.
    """
    best = max((p.score for p in paths), default=0.0)
    if best <= 0:
        return set()
    for p in paths:  # every element knows the best score at or below it
        up = p
        while up is not None and up.top < p.score:
            up.top, up = p.score, up.parent
    picks = lambda x: x.top >= best * share * (0.1 if x.inside else 1)
    content = root  # down as long as all selected paths share the way, but not into flow elements
    while content.score < share * best:
        ways = [x for x in content.children.values() if picks(x)]
        if len(ways) != 1 or ways[0].element in FLOW or ways[0].element not in BLOCKS | {"html", "body"}:
            break
        content = ways[0]
    add_up(root)
    kept: set[Path] = set()
    todo = [content]
    while todo:
        at = todo.pop()
        kept.add(at)
        for child in at.children.values():
            container = child.element in BLOCKS and child.element not in FLOW
            mostly = not picks(child) and 2 * child.links > child.whole
            if child.article:
                keep = child.factor == content.factor and not (container and mostly)
            else:
                keep = child.factor == content.factor and not container and not (child.element in LISTS and mostly)
            if child.factor > 0 and (keep or picks(child)):
                todo.append(child)
    return kept


def add_up(root: Path) -> None:
    """Characters and linked characters at or below each element."""
    order = [root]
    for at in order:
        order.extend(at.children.values())
        at.whole, at.links = at.chars, at.linked
    for at in reversed(order):
        if at.parent is not None:
            at.parent.whole += at.whole
            at.parent.links += at.links


def main_text(page: str, share: float = 0.1) -> str:
    """Main text: blocks in page order joined by newlines, white space folded, references decoded."""
    root = Path(None, "", 1.0)
    nodes = list(text_nodes(page, root))
    paths: dict[Path, None] = {}
    for path, _, text, link in nodes:
        if size := len(text.strip()):
            paths[path] = None
            path.chars += size
            path.marks += len(PUNCTUATION.findall(text))
            path.nodes += 1
            path.linked += size * link
    ordered = list(paths)
    if not ordered:
        return ""
    score_paths(ordered)
    kept = select_paths(ordered, root, share)
    blocks: dict[int, list[str]] = {}
    for path, block, text, _ in nodes:
        if path in kept:
            blocks.setdefault(block, []).append(text)
    lines = (GAPS.sub(" ", html.unescape("".join(parts))).strip(" ") for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(batches):
    for batch in batches:
        texts = [main_text(x.as_py() or "") for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every page, rows and urls unchanged.

    Null and empty html and pages without text give an empty text; only link text or menus, too.  Unclosed and truncated markup is
    read as browsers do: a block ends an open paragraph, an unfinished tag at the end is dropped.
    Any row is handled by itself, so repeated rows, ties and extra columns do no harm.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
