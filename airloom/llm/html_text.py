"""Main text of web pages by composite text density (operator 7).

A page is read into a tree of elements.  Each element has its characters C, tags T,
characters in links LC and link tags LT, of itself and all below.  Its density is the
number of characters per tag, adjusted by a logarithm that falls with the share of
links; its density sum is the sum over its children.  The element of the largest density
sum is where the text is; the least density on the way from there to the body is the
threshold, and of every other element above the threshold the subtree of the largest sum
is taken as well.  Never taken are elements that do not hold the text: scripts, styles,
forms, navigation, page headers and footers, asides, hidden elements, and those that
their class, id or role names as advert, notice, sidebar, menu or reader comments; their
links count all the same, as the densities tell text from links.

Where an article holds most of what may be taken, densities choose within it; the threshold
still comes from the whole way to the body.  Of a page without links, where densities have
nothing to tell, all that may be taken (of such an article) is the text.  Headings of the first
level are taken wherever they stand there."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.shipping import ship_package

TEXTS = "page_id long, url string, text string, n_chars long"

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CUT = frozenset("head script style nav footer aside form noscript iframe template svg canvas math object select option button textarea dialog menu input label audio video map title".split())
#: Those of CUT that hold nothing to be measured.
UNSEEN = CUT - frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
FENCE = frozenset("ul ol table td th div section article main aside nav footer header body html dl blockquote form".split())
# Words in class, id or role that name what is not the text.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside complementary "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist "
    "disqus respond replies popup modal overlay widget toolbar pager pagination masthead contentinfo search skip paywall".split()
)
# Those that an article element may have, too.
REPLIES = frozenset("ad ads advert promo sponsored related recommended comment comments commentlist reply replies respond".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "cut", "kept")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent, self.items, self.cut = tag, attributes, parent, [], False


def tree(page: str) -> Node:
    """The elements of a page, mended where tags are missing; text stands between them as strings."""
    root = Node("html", "", None)
    at, here, n = 0, root, len(page)
    raw_until = None
    match = _TOKEN.search(page)
    while match:
        if match.start() > at:
            here.items.append(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is not None:
            tag = tag.lower()
            if match[1]:
                up = here
                while up is not None and up.tag != tag:
                    up = up.parent
                if up is not None and up.parent is not None:
                    here = up.parent
            elif tag != "html":
                closes = CLOSES.get(tag)
                if closes:
                    up = here
                    while up is not None and up.tag not in FENCE - closes:
                        if up.tag in closes:
                            here = up.parent
                            break
                        up = up.parent
                if tag in BLOCK:
                    up = here
                    while up is not None and up.tag != "p" and up.tag not in FENCE:
                        up = up.parent
                    if up is not None and up.tag == "p":
                        here = up.parent
                node = Node(tag, match[3], here)
                here.items.append(node)
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    stop, after = (end.start(), end.end()) if end else (n, n)
                    if tag in ("title", "textarea"):
                        node.items.append(page[at:stop])
                    at = after
                elif tag not in VOID and not match[3].endswith("/"):
                    here = node
                elif tag not in VOID and tag in BLOCK | {"a", "b", "i", "em", "strong", "span"}:
                    here = node  # HTML ignores the slash of other elements
        match = _TOKEN.search(page, at)
    if at < n:
        here.items.append(page[at:])
    return root


def _unwanted(node: Node, inside: bool) -> bool:
    tag = node.tag
    if tag in CUT or (tag == "header" and not inside and (node.parent is None or node.parent.tag in ("html", "body"))):
        return True
    if not node.attributes or tag in ("html", "body", "main"):
        return False
    if _HIDDEN.search(node.attributes):
        return True
    words = _named(node)
    return not REPLIES.isdisjoint(words) if tag == "article" else not HINTS.isdisjoint(words) and not _holds_text(node)


def _named(node: Node) -> set[str]:
    """First and last words of the names that class, id and role give an element."""
    out = set()
    for found in _NAMED.findall(node.attributes):
        for name in " ".join(found).lower().split():
            words = _WORD.findall(name)
            if words and words[0] not in ("has", "with", "no", "without", "is"):
                out.update((words[0], words[-1]))
    return out


def _holds_text(node: Node) -> bool:
    todo = [node]
    while todo:
        for x in todo.pop().items:
            if isinstance(x, Node):
                if x.tag == "main" or x.tag == "article" and REPLIES.isdisjoint(_named(x)) and REPLIES.isdisjoint(_named(node)):
                    return True
                todo.append(x)
    return False


def _order(root: Node) -> list[Node]:
    """All elements, parents first; what is never seen is gone, what is not to be taken is marked."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or node.tag in ("article", "main")
        node.items = [x for x in node.items if isinstance(x, str) or x.tag not in UNSEEN]
        out.append(node)
        below = [x for x in node.items if isinstance(x, Node)]
        for x in below:
            x.cut = node.cut or _unwanted(x, inside)
        todo += [(x, inside) for x in reversed(below)]
    return out


def _measure(order: list[Node]) -> None:
    for node in reversed(order):
        chars = tags = link_chars = link_tags = kept = 0
        for x in node.items:
            if isinstance(x, str):
                seen = len(x) - x.count(" ") - x.count("\n")
                chars, kept = chars + seen, kept + seen
            else:
                kept += x.kept
                chars, tags, link_chars, link_tags = chars + x.chars, tags + x.tags + 1, link_chars + x.link_chars, link_tags + x.link_tags + (x.tag == "a")
        node.kept = 0 if node.cut else kept
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, chars if node.tag == "a" else link_chars, link_tags
    body = order[0]
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        inner = (c / max(lc, 1)) * (t / max(lt, 1))
        node.density = (c / t) * (math.log(inner) / math.log(base) if base > 1.0000001 and inner > 0 else math.log(max(inner, 1.0)) if inner > 0 else 0.0) if c else 0.0
        node.total, node.best = 0.0, node
        own = 0.0
        for x in node.items:  # elements inside a line are part of their block's text
            if isinstance(x, Node) and x.tag in BLOCK and not x.cut:
                own += x.density
        node.total = own
        for x in node.items:
            if isinstance(x, Node) and not x.cut and x.best.total > node.best.total:
                node.best = x.best


def _chosen(root: Node, order: list[Node]) -> set[int]:
    """The elements whose whole subtree is text, but for what is cut."""
    # a page that marks its article: the text is chosen within the mark, if that holds most of what may be taken
    marked = max((x for x in order if x.tag in ("article", "main") and not x.cut), key=lambda x: x.kept, default=None)
    top = marked if marked is not None and 2 * marked.kept >= root.kept else root
    if not root.link_chars:
        return {id(top)}
    best = top.best
    floor, up = best.density, best
    while up is not None:
        floor = min(floor, up.density)
        up = up.parent
    taken, todo = {id(best)}, [top]
    while todo:
        node = todo.pop()
        if node.density >= floor and node is not top and node.kept:
            taken.add(id(node.best))
        elif node.tag == "h1" and not node.link_chars:
            taken.add(id(node))
        todo += [x for x in node.items if isinstance(x, Node) and not x.cut]
    return taken


def _links_only(node: Node) -> bool:
    return node.tag in ("ul", "ol", "div", "section", "table", "dl", "p") and node.link_tags >= 3 and node.link_chars >= 0.8 * node.chars


def main_text(page: str) -> str:
    """The blocks of the main text, joined by empty lines."""
    root = tree(page)
    order = _order(root)
    _measure(order)
    taken = _chosen(root, order)
    blocks, parts = [], []

    def close():
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                blocks.append(line)
            parts.clear()

    todo: list = [(root, False, False)]
    while todo:
        x, inside, article = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            if inside:
                parts.append(x)
        else:
            inside, article = inside or id(x) in taken, article or x.tag == "article"
            if x.cut or inside and not article and _links_only(x):
                continue
            if x.tag == "br":
                parts.append(" ")
                continue
            block = x.tag in BLOCK
            if block:
                close()
                todo.append((None, False, False))
            todo += [(y, inside, article) for y in reversed(x.items)]
    close()
    return "\n\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) if page else "" for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    Defined results: null or empty html, and pages without text, give an empty text; rows
    without an id or address stay; repeated rows each have their result; other columns
    are ignored; an empty table gives an empty result."""
    spark = pages.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracted, TEXTS)


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
