"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm import kernel

# Element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
# never part of a page's main text
DROPPED = frozenset(
    "script style noscript template iframe object embed svg math canvas audio video nav aside footer form fieldset button select "
    "textarea input dialog menu head title xmp noembed noframes".split()
)
# Class, id and role names that mark what is not the article
MARKS = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|footer|header|masthead|toolbar|share|sharing|social|related|"
    r"recommend\w*|comments?|respond|replies|reply|disqus|login|signup|search|pagination|pager|tags|meta|byline-share|skip|complementary|"
    r"contentinfo|rail|outbrain|taboola|disclaimer|copyright|legal)"
)
COMMENT = re.compile(r"comments?(?:-(?:body|item|entry|\d+))?|respond|replies|reply|disqus")
# What such a name is compounded with; any other part ("has-sidebar", "side-by-side") makes it another name
BESIDE = frozenset(
    "site page main global top bottom left right primary secondary sticky fixed mobile post posts entry article user list box bar block wrapper wrap "
    "container inner outer section area links link buttons button btn form icons icon items item panel row title text body slot unit group us in "
    "up out".split()
)
# an open element of the left kind ends when one of the right kinds begins
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSES_P = BLOCK - {"br", "body", "html", "head", "title", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "legend"}
SCOPE = frozenset("table td th ul ol dl div section article body".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "out", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool):
        self.tag, self.parent, self.out = tag, parent, out
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _marks(name: str) -> bool:
    """Whether a class token is a marker word, or one compounded with words that leave it one."""
    if MARKS.fullmatch(name):
        return True
    parts = [p for p in re.split("[_-]+", name) if p and not p.isdigit()]
    marked = [bool(MARKS.fullmatch(p)) for p in parts]
    return any(marked) and all(m or p in BESIDE for m, p in zip(marked, parts, strict=True))


def _out(tag: str, attributes: str, inside_article: bool) -> bool:
    """Whether an element is boilerplate by its kind or by how its author named it."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        name = m[1].lower()
        if tag == "article" and name not in ("class", "id"):
            continue
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        # an article is one whatever its name, but for a reader's comment
        if name in ("class", "id", "role") and any(map(COMMENT.fullmatch if tag == "article" else _marks, value.split())):
            return True
    return False


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order; lost end tags are mended the way browsers do."""
    root = Node("html", None, False)
    nodes, open_, articles = [root], root, 0
    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            open_.children.append(page[at:])
            break
        if m.start() > at:
            open_.children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            # the nearest open element of this kind; inline end tags do not reach out of a block
            up = open_
            while up is not root and up.tag != tag and (tag in BLOCK or up.tag not in BLOCK):
                up = up.parent
            if up is not root and up.tag == tag:
                while open_ is not up:
                    articles -= open_.tag == "article"
                    open_ = open_.parent
                articles -= tag == "article"
                open_ = up.parent
            continue
        if tag in CLOSES_P or tag in ENDS:
            up = open_
            stop = SCOPE - {tag} if tag in ENDS else SCOPE
            while up is not root and up.tag not in stop and not (up.tag == "p" and tag in CLOSES_P) and tag not in ENDS.get(up.tag, ()):
                up = up.parent
            if up is not root and (up.tag == "p" and tag in CLOSES_P or tag in ENDS.get(up.tag, ())):
                open_ = up.parent
        node = Node(tag, open_, open_.out or _out(tag, m[3], articles > 0))
        open_.children.append(node)
        nodes.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        articles += tag == "article"
        open_ = node
    return root, nodes


def _measure(nodes: list[Node]) -> None:
    """Text density of every node, link text set against it, and the sum over its children."""
    for node in reversed(nodes):
        if node.out:
            continue
        linked = node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(child.strip())
            elif not child.out:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if linked:
            node.link_chars = node.chars
    body = max(nodes[0].chars, 1)
    body_link = nodes[0].link_chars / body
    for node in reversed(nodes):
        if node.out or not node.chars:
            continue
        c, lc = node.chars, node.link_chars
        t, lt = max(node.tags, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - lc, 1) * lc + body_link * c + math.e)
        ratio = c / max(lc, 1) * t / lt
        node.density = c / t * (math.log(max(ratio, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else math.log(max(ratio, 1.0)))
        node.total = sum(x.density for x in node.children if not isinstance(x, str))


def _collect(top: Node, least: float) -> list[list[str]]:
    """Text of a subtree in page order, cut where blocks begin and end.

    Branches that are mostly links and less dense than the path are left out.
    """
    blocks: list[list[str]] = [[]]
    todo: list[Node | str | None] = list(reversed(top.children))
    while todo:
        child = todo.pop()
        if child is None:
            blocks.append([])
            continue
        if isinstance(child, str):
            blocks[-1].append(child)
            continue
        breaks = child.tag in BLOCK
        if breaks:
            blocks.append([])
            todo.append(None)
        links_only = breaks and child.chars and child.link_chars > 0.6 * child.chars and child.density < least
        if not child.out and not links_only:
            todo.extend(reversed(child.children))
    return blocks


def _dense(tops: list[Node], least: float) -> list[Node]:
    """The highest blocks in the given branches, in page order, that are as dense as the path and not mostly links."""
    found, todo = [], list(reversed(tops))
    while todo:
        x = todo.pop()
        if x.out or not x.chars:
            continue
        if x.tag in BLOCK and x.density >= least and x.link_chars <= 0.6 * x.chars:
            found.append(x)
        else:
            todo.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return found


def _alike(top: Node, least: float) -> list[Node]:
    """The element and those of its kind beside it that are as dense as the path and not mostly links."""
    beside = (c for c in top.parent.children if not isinstance(c, str) and c.tag == top.tag)
    return [c for c in beside if c is top or not c.out and c.chars and c.density >= least and c.link_chars <= 0.6 * c.chars]


def main_text(page: str) -> str:
    """The article of a page: blocks in page order, joined by one space."""
    root, nodes = parse(page)
    _measure(nodes)
    best = max((x for x in nodes if not x.out), key=lambda x: x.total, default=root)
    if not best.total:
        best = root
    # the least density on the way to the body decides what counts as content
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    least = min(x.density for x in path)
    # the element that holds the article as a whole, and other branches of the page as dense as the path
    top = next((x for x in path if x.tag in ("article", "main")), None)
    held = [top] if top is None or top.parent is None else _alike(top, least)
    if top is None:
        top, held = best, [best]
        while top.parent is not None:
            up = top.parent
            at = next(k for k, c in enumerate(up.children) if c is top)
            before, after = ([c for c in part if not isinstance(c, str)] for part in (up.children[:at], up.children[at + 1 :]))
            held = _dense(before, least) + held + _dense(after, least)
            # an element of which the article is the greater part is the article
            if top.tag == "p" or up.tag not in ("html", "body") and up.chars <= 1.5 * sum(x.chars for x in held):
                held = [up]
            top = up
    blocks = (b for x in held for b in _collect(x, least))
    texts = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return " ".join(t for t in texts if t)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in kernel.slices(batches, "html"):
        texts = [main_text(p) for p in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Null and empty pages give an empty text.  Null ids and urls and repeated rows
    are passed on; other columns are ignored.  A map without shuffle.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
