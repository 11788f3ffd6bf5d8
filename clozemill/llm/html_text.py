"""Main text of web pages by composite text density.

Each page becomes a tree of elements. Every node has the characters and tags of its subtree and those
inside links; its density is characters per tag, brought down where links hold much of the text:

    D = C / T * log(C / LC * T / LT) to the base ln(C / nLC * LC + LCb / Cb * C + e)

(C characters, T tags, LC and LT those of links, nLC the characters outside links, b the body; zero
counts are taken as 1). The node with the greatest sum of its children's densities is the core; of equal sums
the one with more text, then one inside an article. The threshold is a share (``SHARE``) of the least density on
the way from the core to the body. The subtree taken is the core, widened to its parent while a sibling is a
heading or a text of few links that reaches the threshold, and not beyond an article or main element.

What is known by name not to be text of the article (menus, page headers and footers, asides, notices, adverts,
forms, comments) counts for the densities of what is around it, as the rest of the page does, but is
neither core nor sibling and never taken; scripts, styles and the like do not count at all. Names are read
from any word of a class or id outside article and main. Inside them they are a whole class or id or one joined with
a word for a container (`comment-list`, `ad-slot`), never of a heading, and of a section only if they name
comments. Hidden is what has the attribute `hidden` or aria-hidden=true. Of the subtree taken every block is kept,
however short.

Character references are decoded, white space inside a block is one space, blocks are joined by one
space in page order. Null, empty and text-free pages give an empty text; plain text without tags is one
block. Broken markup never fails: an unclosed element ends with its parent, a tag whose quotes do not close before
the next tag ends at its first `>`, a cut tag at the end is dropped. Long pages and deep nesting take time in
proportion to their length. An empty table gives no rows; repeated rows each get their result; only the kept
columns and the page are read, so others may have any name. A row depends on nothing but itself, so pages are
parsed where they are read.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozemill.llm.common import type_of

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
CUT = frozenset((
    "script style noscript template iframe svg math canvas object head title nav footer aside form "
    "button select option textarea input dialog menu audio video map noembed noframes").split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr").split())
CLOSES_P = frozenset((
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul").split())
LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
        "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("table ul ol dl td th article section div body html main".split())
# Words in class, id or role that name what is not the article.
NAMED = frozenset((
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside footer banner ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo comment comments disqus reply replies respond discussion "
    "cookie cookies consent gdpr notice notices alert notification popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended pagination pager toolbar widget search "
    "complementary contentinfo dialog alertdialog").split())
# Words that make such a name one of a container around the article (`with-sidebar`).
ABOUT = frozenset("with without has no main article".split())
HEADER_NAMES = frozenset("header masthead topbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
# Classes of a section of an article that never is its own text.
REPLIES = frozenset("comment comments commentlist disqus".split())
# Words for containers, and what they hold when it is not the article.
HOLDERS = frozenset((
    "list area section form thread box block container wrapper wrap button buttons bar slot unit banner "
    "links icons tools widget count feed panel").split())
HELD = frozenset("comment comments disqus reply replies ad ads advert share sharing social newsletter cookie promo sponsor".split())
STRUCTURE = SCOPE | {"p"} | set(LIKE)
HARD = CUT - {"nav", "footer", "aside", "form", "menu", "dialog"}
#: Share of the least density between core and body that a sibling has to reach.
SHARE = 0.5

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?:(?P<rest>(?:[^<>\"']|\"[^<\"]*\"|'[^<']*')*+)>|(?P<open>[^>]*)>)"
    r"|<[!?][^>]*>|<(?:/?[a-zA-Z!?][^>]*)\Z", re.DOTALL)
# One attribute after the other: a value is consumed whole, so nothing in it is taken for a name.
ATTRIBUTE = re.compile(r"""(=?[^\s>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("name", "parent", "children", "cut", "inside", "block", "scope", "names", "chars", "tags", "link_chars",
                 "link_tags", "density")

    def __init__(self, name: str, parent: Node | None, cut: int):
        self.name, self.parent, self.cut = name, parent, cut
        self.inside = name in ("article", "main") or (parent is not None and parent.inside)
        # The nearest open element that can end others (itself or above), the nearest scope, names open in a scope.
        self.block = self if parent is None or name in STRUCTURE else parent.block
        self.scope = self if parent is None or name in SCOPE else parent.scope
        self.names: dict[str, int] | None = {} if self.scope is self else None
        self.children: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def attributes(rest: str) -> dict[str, str]:
    """Names and values of a tag's attributes; the first of one name counts."""
    out: dict[str, str] = {}
    for key, value in ATTRIBUTE.findall(rest):
        if value[:1] in ("'", '"'):
            value = value[1:].removesuffix(value[0])
        out.setdefault(key.lower(), value.lower())
    return out


def named_in_article(token: str) -> bool:
    """Whether a class or id names what is not an article's own text: whole, or as a container of it."""
    if token in NAMED:
        return True
    words = WORD.findall(token)
    return len(words) > 1 and words[0] in HELD and words[-1] in HOLDERS


def is_cut(name: str, rest: str, parent: Node) -> bool:
    if name in CUT:
        return True
    inside = parent.inside
    if name == "header":
        return not inside
    if name in ("html", "body", "article", "main") or not rest.strip():
        return False
    own = attributes(rest)
    if "hidden" in own or own.get("aria-hidden", "").strip() == "true":
        return True
    if any(one in NAMED for one in own.get("role", "").split()):
        return True
    tokens = [*own.get("class", "").split(), *own.get("id", "").split()]
    if inside:
        # Headings and sections are the article's own; their ids are names of its parts.
        if name == "section":
            return any(one in REPLIES or (named_in_article(one) and WORD.findall(one)[0] in REPLIES) for one in tokens)
        return name not in HEADINGS and any(one in REPLIES or named_in_article(one) for one in tokens)
    for one in tokens:
        words = set(WORD.findall(one))
        if not words & ABOUT and (words & NAMED or words & HEADER_NAMES):
            return True
    return False


def parse(page: str) -> Node:
    """The page's tree; text stands in it as strings."""
    root = node = Node("html", None, 0)
    open_scopes: dict[str, int] = {}
    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at and not node.cut:
            node.children.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = m.group("name")
        if not name:
            continue
        name = name.lower()
        if m.group("end"):
            if name in SCOPE:
                # How many of a name are open tells whether there is one to close.
                if open_scopes.get(name):
                    node = out_of(node, lambda x: x.name == name, open_scopes)
            elif node.scope.names.get(name):
                # A stray end tag of something inside does not close what is around it.
                node = out_of(node, lambda x: x.name == name, open_scopes)
            continue
        rest = m.group("rest") or m.group("open") or ""
        if name in ("html", "body"):
            node = out_of(node, lambda x: False, open_scopes)
            continue
        if name in CLOSES_P:
            node = closed(node, ("p",), name, open_scopes)
        elif name in LIKE:
            node = closed(node, LIKE[name], name, open_scopes)
        cut = node.cut if node.cut == 2 or not is_cut(name, rest, node) else 1
        child = Node(name, node, 2 if name in HARD else cut)
        node.children.append(child)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            inner = page[at:end.start() if end else n]
            if not child.cut:
                child.children.append(inner)
            at = end.end() if end else n
        elif name not in VOID and not rest.endswith("/"):
            node = child
            counts = open_scopes if name in SCOPE else node.scope.names
            counts[name] = counts.get(name, 0) + 1
    return root


def out_of(node: Node, last, open_scopes: dict[str, int]) -> Node:
    """Close open elements up to the first that is ``last``, and that one too."""
    while node.parent is not None:
        counts = open_scopes if node.name in SCOPE else node.scope.names
        counts[node.name] -= 1
        if last(node):
            return node.parent
        node = node.parent
    return node


def closed(node: Node, names: tuple, name: str, open_scopes: dict[str, int]) -> Node:
    """The node to go on in when an element begins that ends open ones of these names."""
    up = node.block
    while up.parent is not None:
        if up.name in names:
            return out_of(node, lambda x: x is up, open_scopes)
        if up.name in SCOPE and not (up.name in ("td", "th") and name in LIKE):
            break
        up = up.parent.block
    return node


def measured(root: Node) -> list[Node]:
    """Counts and densities of all nodes but scripts and the like, children first."""
    order: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, link = stack.pop()
        order.append(node)
        for child in node.children:
            if isinstance(child, str):
                count = len(child.split()) and len(" ".join(child.split()))
                node.chars += count
                node.link_chars += count if link else 0
            elif child.cut < 2:
                inside = link or child.name == "a"
                child.link_tags += inside
                stack.append((child, inside))
    order.reverse()
    for node in order:
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.tags += node.tags + 1
            node.parent.link_chars += node.link_chars
            node.parent.link_tags += node.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t = node.chars, max(node.tags, 1)
        if c:
            lc, lt, plain = max(node.link_chars, 1), max(node.link_tags, 1), max(c - node.link_chars, 1)
            base = math.log(c / plain * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(c / lc * t / lt) / max(math.log(base), 1e-3) if base > 1 else c / t
            node.density = max(node.density, 0.0) or c / t * 1e-6
    return order


def core(root: Node) -> Node:
    """The subtree to take."""
    order = [x for x in measured(root) if not x.cut]

    def children(node: Node) -> list[Node]:
        return [x for x in node.children if not isinstance(x, str) and not x.cut]

    sums = {id(x): sum(y.density for y in children(x)) for x in order}
    best = max(order, key=lambda x: (sums[id(x)], x.chars, x.inside))
    if not sums[id(best)]:
        return root
    least, node = best.density, best
    while node.parent is not None:
        node = node.parent
        least = min(least, node.density)
    threshold = SHARE * least

    def goes_with(x: Node) -> bool:
        if not x.chars or 2 * x.link_chars >= x.chars:
            return False
        return x.name in HEADINGS or x.density >= threshold

    while best.parent is not None and best.name not in ("article", "main") and (
            best.name in INLINE or any(x is not best and goes_with(x) for x in children(best.parent))
            or any(isinstance(x, str) and x.strip() for x in best.parent.children)):
        best = best.parent
    return best


def blocks(top: Node) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append(text)

    stack: list = [top]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            run.append(html.unescape(item))
        elif not item.cut or item is top:
            if item.name not in INLINE:
                end()
                stack.append(None)
            stack.extend(reversed(item.children))
    end()
    return out


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    return " ".join(blocks(core(parse(page))))


def extract(pages: DataFrame, page: str = "html", keep: tuple = ("page_id", "url")) -> DataFrame:
    """The kept columns and ``text`` of every page."""

    def work(batches):
        for batch in batches:
            own = [batch.column(i) for i in range(batch.num_columns)]
            texts = [main_text(x.as_py()) for x in own[-1]]
            yield pa.record_batch([*own[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    kinds = ", ".join(f"{c} {type_of(pages, c)}" for c in keep)
    return pages.select(*keep, page).mapInArrow(work, f"{kinds}, text string")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
