"""Main text of web pages by composite text density.

The page becomes a DOM tree (end tags that HTML lets one omit are supplied);
scripts, styles, fields, buttons and hidden elements hold no article text and go, and forms that
do not hold the subtree of largest density sum. Every node gets its composite density, characters per tag adjusted by the shares of link
characters and link tags, and the sum of its parts' densities. The subtree with
the largest sum is selected. The least density on the way from it up to the body
is the threshold: beside that way, text blocks, and containers of several blocks,
which reach it and are not mostly links join the selection, and headings do.

Labels help, but do not choose. Menus and reader comments, named by element, role
or class, are taken out. What is named a footer, sidebar, notice, advert or the like
goes, however long it is, if it is mostly links or less dense than the rest of the page, or if that rest
has prose, a block with a sentence's end that is not mostly links; unless it alone holds an article, main or first heading.
So an article in a wrongly named container stays. A class counts if each of its parts is
a name of such a thing or of a place (``site-footer``, not ``content-with-sidebar``).
A header goes with the page's, and stays inside the selected subtree.

Defined cases: null and empty html give empty text; a page without a body is read
as one; nothing is dropped for being long; an empty table gives no rows; repeated
rows are answered each by itself; only the ``keep`` columns pass, whatever else the
table holds; broken markup is read as far as the tokenizer goes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
REMOVED = frozenset(
    "script style noscript template head iframe object embed svg canvas audio video button select textarea input option dialog".split()
)
#: Elements whose own text joins the article; other containers join by the blocks in them.
TEXT_TAGS = frozenset("#text p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
# Roles, and words of classes and ids, that name page parts beside the article; then words of places, which say nothing alone.
MENU_ROLES = frozenset("navigation menu menubar toolbar search form dialog alert alertdialog".split())
PART_ROLES = frozenset("banner contentinfo complementary".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond replies disqus".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
PART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs toolbar footer "
    "share sharing social related recommended newsletter subscribe signup login search pagination pager widget widgets skip copyright disclaimer".split()
)
PLACE_WORDS = frozenset(
    "left right top bottom main primary secondary site page global sticky fixed side box block bar panel slot unit area zone wrap wrapper container inner outer "
    "section list item items link links button buttons form thread reader user posts articles stories bottom".split()
)
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f]")
#: What ends when an element of the first kind begins: the nearest open element of the second, not beyond the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "body": ({"head"}, {"html"}),
}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dt", "dd"}
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "inside", "block")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.inside = self.block = False

    def nodes(self):
        return [c for c in self.children if isinstance(c, Node)]


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)
        self.open = Counter()  # open elements by tag: an end tag without one costs no walk

    def _pop(self, names, barrier=()) -> None:
        if not any(self.open[n] for n in names):
            return
        node = self.at
        while node is not self.root and node.tag not in barrier:
            if node.tag in names:
                self._leave(node)
                return
            node = node.parent

    def _leave(self, node: Node) -> None:
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in IMPLIED:
            self._pop(*IMPLIED[tag])
        if tag in CLOSES_P:
            self._pop({"p"}, {"td", "th", "table", "li", "div", "article", "section", "main", "blockquote", "body"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style", "iframe", "svg") and self.at.tag == tag:
            self._leave(self.at)

    def handle_endtag(self, tag):
        if tag in VOID or tag == "html":
            return
        barrier = () if tag in ("body", "table", "article", "main", "section", "div", "nav", "footer", "aside", "header", "form") else {"td", "th", "table", "body"}
        self._pop({tag}, barrier - {tag} if barrier else ())

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def _never_text(node: Node) -> bool:
    a = node.attrs
    return node.tag in REMOVED or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def label(node: Node) -> str | None:
    """``menu``, ``comments``, ``part`` or ``header`` of a node that names itself so."""
    role = node.attrs.get("role", "").lower()
    if node.tag in ("nav", "menu") or role in MENU_ROLES:
        return "menu"
    if node.tag in ("body", "html", "main") or node.tag in TEXT_TAGS and node.tag not in ("p", "ul", "ol"):
        return None
    named = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".strip()
    found = set()
    for token in _CAMEL.sub("-", named).lower().split() if named else ():
        parts = set(_PARTS.findall(token))
        if parts <= PLACE_WORDS | COMMENT_WORDS | HEADER_WORDS | PART_WORDS:
            found |= parts
    if found & COMMENT_WORDS:
        return "comments"
    if node.tag == "article":
        return None
    if node.tag in ("footer", "aside") or role in PART_ROLES or found & PART_WORDS:
        return "part"
    return "header" if node.tag == "header" or found & HEADER_WORDS else None


def remove(root: Node, out) -> None:
    """Takes out the nodes that ``out`` says."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if not (isinstance(c, Node) and out(c))]
        stack += node.nodes()


def parents_first(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.nodes()
    return order


def wrap_runs(body: Node) -> None:
    """Makes a node of each run of text and inline elements that stands beside blocks; ``block`` says what is or holds one."""
    for node in reversed(parents_first(body)):
        held = any(c.block for c in node.nodes())
        node.block = held or node.tag in BLOCKS
        if not held:
            continue
        out, run = [], []
        for c in [*node.children, None]:
            if c is not None and not (isinstance(c, Node) and c.block):
                run.append(c)
                continue
            if any(isinstance(x, Node) or not x.isspace() for x in run):
                own = Node("#text", {}, node)
                own.children, own.block = run, True
                for x in own.nodes():
                    x.parent = own
                out.append(own)
            run = []
            if c is not None:
                out.append(c)
        node.children = out


def measure(body: Node) -> list[Node]:
    """Counts, densities and sums of all nodes; returns them parents first, the body at the head."""
    body.inside = False
    order = parents_first(body)
    for node in order:
        for c in node.nodes():
            c.inside = node.inside or c.tag == "a"
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.tags += c.tags + (c.tag != "#text")
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
            else:
                size = len("".join(c.split()))
                node.chars += size
                node.link_chars += size * node.inside
    share = body.link_chars / max(1, body.chars)
    for node in order:
        node.density = composite(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in order:
        parts = [c.density for c in node.nodes() if c.block]
        node.total = sum(parts) if parts else node.density
    return order


def composite(chars: int, tags: int, link_chars: int, link_tags: int, body_link_share: float) -> float:
    """Characters per tag, times a logarithm that falls as links take more of the characters and tags."""
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_link_share * chars + math.e)
    return chars / t * math.log(max(1.0, chars / lc * t / lt)) / math.log(max(base, 1.0 + 1e-9))


def _link_heavy(node: Node) -> bool:
    return 3 * node.link_chars > node.chars


def idle_forms(body: Node) -> set[Node]:
    """Forms that do not hold the subtree with the largest density sum."""
    order = measure(body)
    forms = {n for n in order if n.tag == "form"}
    if forms:
        node = max((n for n in order if n.block or n is body), key=lambda n: n.total)
        while node is not body:
            forms.discard(node)
            node = node.parent
    return forms


def _prose(node: Node) -> bool:
    """A block without blocks in it that ends a sentence and is no heading and not mostly links."""
    if not node.block or not node.chars or node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") or _link_heavy(node) or any(c.block for c in node.nodes()):
        return False
    return any(isinstance(c, str) and SENTENCE_END.search(c) for n in parents_first(node) for c in n.children)


def vetoed(body: Node) -> set[Node]:
    """Nodes to take out by their labels: menus and comments always, others if mostly links, less dense than the rest, or beside prose that nothing labels."""
    order, labels, free = measure(body), {}, {body}
    for node in order:
        for c in node.nodes():
            if node in free and (kind := label(c)):
                labels[c] = kind
            elif node in free:
                free.add(c)
    bare = {n: sum(c.density for c in n.nodes() if c.block and c in free) or (0.0 if any(c in labels for c in n.nodes()) else n.density) for n in order if n in free and n.block}
    rest, prose = max(bare.values(), default=0.0), any(_prose(n) for n in order if n in free)
    marks = ("article", "main", "h1")
    marked = any(n.tag in marks for n in free)
    out = set()
    for node, kind in labels.items():
        if kind == "part":
            inside = parents_first(node)
            alone = not marked and any(n.tag in marks for n in inside)
            if _link_heavy(node) or not alone and (prose or max(n.total for n in inside) <= rest):
                out.add(node)
        elif kind in ("menu", "comments"):
            out.add(node)
    return out


def select(body: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    order = measure(body)
    if not body.chars:
        return []
    best = max((n for n in order if n.block or n is body), key=lambda n: n.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)

    titled = any(n.tag == "h1" for n in parents_first(best))

    def joins(node: Node) -> bool:
        if not node.block or label(node) or _link_heavy(node):
            return False
        if node.tag in ("h1", "h2", "h3") and (node.parent is not body or not titled):
            return True
        if node.density < threshold:
            return False
        return node.tag in TEXT_TAGS or node.total >= threshold and sum(c.block for c in node.nodes()) > 1

    parts = [best]
    for inner, up in zip(path, path[1:]):
        at = next(k for k, c in enumerate(up.children) if c is inner)
        parts = [c for c in up.children[:at] if isinstance(c, Node) and joins(c)] + parts + [c for c in up.children[at:] if isinstance(c, Node) and c is not inner and joins(c)]
    return parts


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks under a node in page order, white space collapsed."""
    out, held, stack = [], [], [iter([node])]

    def cut():
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    ends: list[bool] = [False]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                cut()
        elif isinstance(child, str):
            held.append(child)
        else:
            block = child.tag in BLOCKS
            if block:
                cut()
            elif child.tag == "br":
                held.append(" ")
            stack.append(iter(child.children))
            ends.append(block)
    cut()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    body = next((n for n in root.nodes() if n.tag == "body"), root)
    remove(body, _never_text)
    wrap_runs(body)
    remove(body, idle_forms(body).__contains__)
    named = vetoed(body)
    remove(body, named.__contains__)
    chosen = select(body)
    for part in chosen:
        # A header belongs to the page if the page was chosen as a whole, else to what was chosen.
        if part is body:
            remove(body, lambda n: n.parent is body and label(n) == "header")
    return "\n".join(b for part in chosen for b in blocks_of(part))


def extract(pages: DataFrame, html_col: str = "html", *keep: str) -> DataFrame:
    """The ``keep`` columns, text and n_chars of each page."""
    slim = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    schema = slim.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.columns[-1].to_pylist()]
            cols = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return slim.mapInArrow(run, schema)
