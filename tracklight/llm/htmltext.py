"""Main text of web pages by composite text density.

A page becomes a tree with the few implied end tags that real pages rely on.  Elements and roles that are never a part of
an article (menus, footers, sidebars, notices, forms, scripts, styles) are taken out; a form that wraps the page's
article or most of its text stays without its controls.  Words of a class or id are evidence only: an element that they
speak against goes unless its text outweighs that of the rest of the page by the weight of the words, or an article
lies in it.  For every remaining node the link-adjusted characters per tag are computed (Sun, Song, Liao 2011), each
node sums its children's densities, and the subtree with the largest sum is the core.  The smallest density on the path
from the body to the core is the threshold: every other part of the page that reaches it gives its own largest-sum
subtree, and blocks of text beside the path stay.  An ``article`` or ``main`` element around the core is taken whole if
it is at least as dense as the body.

Defined results: a null or empty page gives an empty text; pages cut off in the middle, stray end tags, unclosed
elements and quotes are read to their end; a "<" that begins no tag is text, or a comment if it is "</";
after ``STRICT`` tags whose quotes never close, quotes count for nothing; repeated pages give equal texts; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, fresh, read

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody tfoot thead tr ul caption".split()
)
#: Elements that an opening tag closes, looked for up to a boundary.
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Never part of an article.
DROP_TAGS = frozenset("aside audio button canvas dialog footer head iframe menu nav noscript object script select style svg template textarea title video".split())
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo menu menubar navigation".split())
#: Dropped as well, unless they wrap the page's article or most of its text; then only their labels (and controls) are.
WRAP_TAGS = frozenset(["form"])
WRAP_ROLES = frozenset("dialog form search".split())
# Words of a class or id that speak against an element, by weight: how many times the text of the rest of the
# page its own must have for it to stay.  The heavy ones name what is never an article; the light ones often are layout.
HEAVY, LIGHT = 4.0, 1.0
HEAVY_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus foot footer gdpr masthead menu menus modal nav navbar navigation newsletter pagination popup "
    "reply respond sidebar signup sponsor sponsored subscribe subscription toolbar".split()
)
LIGHT_WORDS = frozenset("alert copyright disclaimer legal login notice notices notification overlay pager promo promotion related replies share sharing social teaser widget widgets".split())
#: Dropped outside an article, where they are the page's own.
PAGE_HEADERS = frozenset(["header"])

#: Tags that may fail to close their quotes before quotes are no longer looked at.
STRICT = 100
#: Blocks of text that stay beside the core unless a third of them is links.
BESIDE = frozenset("p blockquote pre ul ol dl table figure details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAME = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "items", "never", "against", "wraps", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, never: bool = False, against: float = 0.0, wraps: bool = False):
        self.tag, self.parent, self.items, self.never, self.against, self.wraps, self.drop = tag, parent, [], never, against, wraps, False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def unwanted(tag: str, attributes: str, in_article: bool) -> tuple[bool, float, bool]:
    """Is the element never a part of an article (by element or role); the weight of what its class and id say against
    it (0: nothing); is it a form or the like?"""
    if tag in DROP_TAGS or (tag in PAGE_HEADERS and not in_article):
        return True, 0.0, False
    against, wraps = 0.0, tag in WRAP_TAGS
    for m in _ATTR.finditer(attributes) if attributes and tag not in ("html", "body") else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.strip().lower()
            if role in DROP_ROLES:
                return True, 0.0, False
            wraps |= role in WRAP_ROLES
        else:
            words = {w.lower() for w in _WORD.findall(value)}
            if words & HEAVY_WORDS or (not in_article and "header" in words):
                against = HEAVY
            elif words & LIGHT_WORDS:
                against = max(against, LIGHT)
    return False, against, wraps


def free_articles(order: list[Node]) -> set[int]:
    """Ids of the ``article`` and ``main`` elements that no evidence speaks against, on themselves or around them, and that
    have text of their own: outside headings, links, and elements with evidence.  ``order``: parents first."""
    bad, clean, found = set(), {}, set()
    for node in order:
        if node.never or node.against or (node.parent is not None and id(node.parent) in bad):
            bad.add(id(node))
    for node in reversed(order):
        if id(node) in bad or node.tag == "a" or node.tag in HEADINGS or node.tag == "label":
            clean[id(node)] = 0
            continue
        clean[id(node)] = sum(clean[id(x)] if isinstance(x, Node) else sum(map(len, x.split())) for x in node.items)
        if node.tag in ("article", "main") and clean[id(node)]:
            found.add(id(node))
    return found


def settle(root: Node, hints: bool) -> None:
    """Sets ``drop``: what never belongs, and what has evidence against it that its text does not outweigh, unless an
    article (itself without such evidence) lies in it.

    Text counts without links, and without what never belongs.  A form (or a role like it) goes too, unless such an
    article or most of the page's text lies in it; then its labels go.
    """
    order, todo, core, held, inside, text = [], [root], set(), set(), set(), {}
    while todo:
        node = todo.pop()
        order.append(node)
        if node.wraps or (node.parent is not None and id(node.parent) in inside):
            inside.add(id(node))
        todo.extend(x for x in node.items if isinstance(x, Node))
    for node in reversed(order):
        article = node.tag in ("article", "main") and not node.against and not node.never
        if id(node) in core or article:
            core.add(id(node))
            if node.parent is not None:
                core.add(id(node.parent))
        if inside and not node.never and (id(node) in held or article):  # what never belongs holds no article of the page
            held.add(id(node))
            if node.parent is not None:
                held.add(id(node.parent))
        lost = node.never or node.tag == "a" or (node.tag == "label" and id(node) in inside and id(node) not in core)
        text[id(node)] = 0 if lost else sum(text[id(x)] if isinstance(x, Node) else sum(map(len, x.split())) for x in node.items)
    whole, free, rivals = text[id(root)], free_articles(order) if hints else set(), {}
    for node in order:
        over = rivals.get(id(node.parent), 0)  # free articles around the node
        rivals[id(node)] = over + (id(node) in free)
        own = text[id(node)]
        elsewhere = len(free) > over  # an element with evidence holds none itself
        outweighed = own <= node.against * (whole - own) or bool(free)
        by_hint = hints and node.against and (elsewhere if id(node) in core else outweighed)
        by_form = node.wraps and id(node) not in held and 2 * own <= whole
        label = node.tag == "label" and id(node) in inside and id(node) not in core
        node.drop = node.never or bool(by_hint) or label or by_form or (node.parent is not None and node.parent.drop)


def parse(page: str) -> Node:
    """The page's tree; texts are strings in ``items``, with character references decoded."""
    root = Node("html", None)
    stack, at, n, articles, last, loose = [root], 0, len(page), 0, page.rfind(">"), 0
    # where elements of each name, and blocks, are open: a tag looks no further than the nearest
    opened: dict[str, list[int]] = {}
    blocks_: list[int] = []

    def nearest(tags: tuple[str, ...]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def push(node: Node) -> None:
        nonlocal articles
        opened.setdefault(node.tag, []).append(len(stack))
        if node.tag in BLOCK:
            blocks_.append(len(stack))
        stack.append(node)
        articles += node.tag in ("article", "main")

    def close(k: int) -> None:
        nonlocal articles
        while len(stack) > k:
            tag = stack.pop().tag
            opened[tag].pop()
            if tag in BLOCK:
                blocks_.pop()
            articles -= tag in ("article", "main")

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].items.append(_html.unescape(page[at:lt]) if "&" in page[at:lt] else page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) if loose < STRICT else None
        if not m:
            m = _LOOSE.match(page, lt)
            loose += m is not None
        if not m:
            if _NAME.match(page, lt):
                break  # a tag that the page's end cuts off
            if page.startswith("</", lt) and last > lt:
                at = page.find(">", lt) + 1  # no tag's name: a comment
                continue
            stack[-1].items.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            k = nearest((tag,))
            if k and (tag in BLOCK or not blocks_ or blocks_[-1] < k):
                close(k)
            continue
        if tag in ("html", "body"):
            continue  # both are the root: the head is an element that is dropped
        if tag in BLOCK:
            k = nearest(("p",))
            if k and blocks_[-1] == k:
                close(k)
        if tag in CLOSES:
            names, bounds = CLOSES[tag]
            k = nearest(tuple(names.split()))
            if k > nearest(bounds):
                close(k)
        if stack[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            close(len(stack) - 1)  # the body begins
        node = Node(tag, stack[-1], *unwanted(tag, m[3], articles > 0))
        stack[-1].items.append(node)
        if tag in VOID:
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            node.items.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else n
            continue
        if not (m[3].rstrip().endswith("/") and tag not in BLOCK):
            push(node)
    return root


def measure(root: Node) -> list[Node]:
    """Fills in counts, densities and sums; all kept nodes, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        order.append(node)
        todo.extend(x for x in node.items if isinstance(x, Node) and not x.drop)
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.chars += sum(map(len, x.split()))
            elif not x.drop:
                node.chars, node.tags = node.chars + x.chars, node.tags + x.tags + 1
                node.link_chars, node.link_tags = node.link_chars + x.link_chars, node.link_tags + x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(1, root.chars)
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * (math.log(max(1.0, c / lc * t / lt)) / max(1e-9, math.log(base)) if base > 1.0000001 else math.log(max(1.0, c / lc * t / lt)))
    for node in order:
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.drop)
        if any(isinstance(x, str) and not x.isspace() for x in node.items):
            node.total += node.density  # its own text counts as a child
    return order


def select(root: Node, order: list[Node]) -> set[int]:
    """Ids of the nodes whose subtrees are the main text."""
    def best(top: Node) -> Node:
        inside, todo = top, [top]
        while todo:
            node = todo.pop()
            if node.total > inside.total:
                inside = node
            todo.extend(x for x in node.items if isinstance(x, Node) and not x.drop)
        return inside

    core = best(root)
    path, node = [], core
    while node is not None:
        path.append(node)
        node = node.parent
    for node in path:  # the nearest article around the core
        if node.tag in ("article", "main"):
            if node.density >= root.density:
                return {id(node)}
            break
    threshold, on_path = min(x.density for x in path), {id(x) for x in path}
    chosen = {id(core)}
    for step in path[1:]:
        for x in step.items:
            if not isinstance(x, Node) or x.drop or id(x) in on_path or not x.chars:
                continue
            if x.density >= threshold:
                chosen.add(id(x) if x.tag in BLOCK - {"div", "section", "table", "ul", "ol"} else id(best(x)))
            elif x.tag in HEADINGS or (x.tag in BESIDE and 3 * x.link_chars <= x.chars):
                chosen.add(id(x))
    return chosen


def blocks(root: Node, chosen: set[int] | None) -> list[str]:
    """The blocks of the chosen subtrees in page order, white space squeezed."""
    out, line = [], []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list[tuple[object, bool]] = [(root, chosen is None)]
    while todo:
        x, on = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            if on:
                line.append(x)
        elif not x.drop:
            on = on or (chosen is not None and id(x) in chosen)
            if x.tag in BLOCK:
                flush()
                todo.append((None, on))
            elif x.tag in ("br", "td", "th"):
                line.append(" ")
            todo.extend((y, on) for y in reversed(x.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    root = parse(page)
    for hints in (True, False):  # a page whose hints cover everything is read without them
        settle(root, hints)
        order = measure(root)
        if root.chars:
            return "\n".join(blocks(root, select(root, order)))
    return ""


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``keep`` columns (all by default) and a struct with ``text``; also the struct's name."""
    name = fresh(pages, "article")
    return annotate(pages, [html], "text string", lambda _, h: {"text": [main_text(x) for x in h.to_pylist()]}, name, keep=keep), name


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """Registered query: all pages."""
    found, name = extract(read(spark, sf_dir, "pages"), keep=["page_id", "url"])
    text = F.col(f"{name}.text")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))
