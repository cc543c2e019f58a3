"""Main text of web pages by composite text density.

A page becomes a small DOM.  Every node gets its characters per tag, adjusted
for characters and tags inside links against those of the whole body; the node
with the largest sum of its children's densities is taken whole.  The lowest
density on the way from the body to that node is the threshold: of what else
hangs on that way, nodes that reach it stay, each with the densest subtree below
it, and so do first-level headings and the way's own running text.  An article or
main element overrides that: the one around the densest subtree, or else the one
that is at least half of it, is the text, with the others of its kind whose
density reaches the lowest on its own way from the body.  Page furniture (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
is cut by element, role and class before that.

Defined results: null or empty html gives the empty text; broken markup is
read as a browser would, an open element ends with its parent; character
references are decoded once; white space runs become one space.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runtime as rt

# The element names that HTML defines for each role, and usual class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|select|xmp|noembed|noframes"
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
DROPPED = frozenset("head nav footer aside form button dialog menu fieldset audio video canvas".split())
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions banner banners "
    "sidebar sidebars menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs masthead footer footers cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts announcement disclaimer popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist commenter discussion disqus respond reply replies share sharing social related recommended recommendations widget widgets toolbar "
    "pagination pager copyright legal skip search searchform form forms adsbygoogle".split()
)
#: A class word with one of these is about the layout, or about what holds the text.
NOT_JUNK = frozenset("has with without no not is content body article main text post entry story".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
HOLDERS = ("article", "main")  # the nearer first
#: Elements that a start tag of the same group ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div main td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>|<(?P<raw>" + RAW + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BARE = re.compile(r"=\s*[^\s\"'>]+/\Z|=\s*/\Z")  # a slash that belongs to a value without quotes
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LAYOUT = frozenset("has with without no not is".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that are furniture in an article too; the other JUNK can be what a section is about.
_FIRM = frozenset(
    "ad ads adv advert adverts adsense adsbygoogle sponsored sidebar sidebars nav navbar topnav subnav breadcrumb breadcrumbs masthead footer footers cookie cookies gdpr "
    "popup modal overlay newsletter subscribe signup login comment comments commentlist commenter disqus respond reply replies widget widgets toolbar pagination pager "
    "searchform advertisement advertisements".split()
)
_READERS = frozenset("comment comments commentlist commenter disqus respond reply replies".split())
#: Of a named section's characters, the share in links that marks furniture; and the running text by which a class is overruled.
LINK_SHARE, RUNNING = 0.4, 100
_ALWAYS = frozenset("comment comments commentlist sidebar footer advert adverts advertisement related share newsletter breadcrumb breadcrumbs navigation disqus replies".split())


class _Node:
    __slots__ = ("chars", "hidden", "ids", "inside", "junk", "kids", "link_chars", "link_tags", "names", "parent", "parts", "tag", "tags")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.junk, self.hidden, self.inside = tag, parent, False, False, False
        self.names: set[str] = set()  # words of ids and classes by which it is furniture
        self.ids: list[str] | None = None  # the id, if that alone made it furniture
        self.parts: list = []  # strings and child nodes, in page order
        self.kids: list[_Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0


def _judge(n: _Node, attrs: str, inside: bool) -> None:
    """Mark furniture by element, attributes and names.

    inside: in an article or main element, whose header is the text's own.
    """
    tag, n.inside = n.tag, inside
    n.junk = tag in DROPPED or tag == "header" and not inside
    by_class = False
    ids: list[str] = []
    for name, *values in _ATTR.findall(attrs) if attrs else ():
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDING.search(value):
            n.junk = n.hidden = True
            return
        if tag in ("html", "body", "main"):
            continue
        if name == "role" and value.lower() in JUNK_ROLES and tag != "form":
            n.junk = n.hidden = True
            return
        if name in ("class", "id") and tag not in HEADINGS:
            for word in value.split():
                parts = _NAMES.findall(word)
                lower = [x.lower() for x in parts]
                # Readers' words and asides to the text stay furniture when named after it: "post-comments", "article-sidebar".
                if (
                    lower
                    and (lower[0] in JUNK and len(lower) == 1 or not NOT_JUNK.intersection(lower) and (not JUNK.isdisjoint(lower) or "header" in lower and not inside))
                    or not _LAYOUT.intersection(lower)
                    and not _ALWAYS.isdisjoint(lower)
                ):
                    n.names.update(lower)
                    by_class |= name == "class"
                    if name == "id":
                        ids = lower
    if n.names and not n.junk:
        n.junk, n.ids = True, None if by_class else ids


def _own_text(n: _Node) -> bool:
    """Whether furniture by class holds the page's text after all: its heading or main element."""
    stack = list(n.kids)
    while stack:
        k = stack.pop()
        if k.tag in ("main", "h1"):
            return True
        stack += [x for x in k.kids if not x.junk]
    return False


def _counts(n: _Node) -> tuple[int, int, int, str]:
    """Characters, those in links and those in paragraphs outside links, and the words of the first heading."""
    chars = links = running = 0
    heading: str | None = None
    stack: list[tuple] = [(n, n.tag == "a", n.tag == "p", False)]
    title: list[str] = []
    while stack:
        x, link, para, head = stack.pop()
        if isinstance(x, str):
            size = len("".join(x.split()))
            chars, links, running = chars + size, links + size * link, running + size * (para and not link)
            if head:
                title.append(x)
            continue
        if x.junk and x is not n:
            continue
        if x.tag in HEADINGS and heading is None and not head:
            head, heading = True, ""
        stack += [(p, link or x.tag == "a", para or x.tag == "p", head) for p in reversed(x.parts)]
    return chars, links, running, "".join(title)


def _own_section(n: _Node) -> bool:
    """Whether what is furniture by its name is a section of the text: its id is its heading's
    words, or the name can be what a section is about; in both cases its text is not in links."""
    firm = not _FIRM.isdisjoint(n.names)
    if n.tag not in BLOCK or firm and n.ids is None:
        return False
    chars, links, running, title = _counts(n)
    if not chars or links >= LINK_SHARE * chars:
        return False
    if n.ids is None:
        return n.inside and running >= RUNNING
    titled = n.ids == [x.lower() for x in _NAMES.findall(title)]
    return titled and _READERS.isdisjoint(n.names) or n.inside and not firm and n.tag != "p"


def _holds_page(n: _Node, others: int) -> bool:
    """Whether a form is around the page's text: its heading, article or main element, or more
    characters than stand outside forms."""
    stack = list(n.kids)
    while stack:
        k = stack.pop()
        if k.tag in HOLDERS or k.tag == "h1":
            return True
        stack += [x for x in k.kids if not x.junk or x.tag == "header"]
    return _counts(n)[0] > others


def parse(page: str) -> _Node:
    root = _Node("html", None)
    node, at = root, 0

    def add(text: str) -> None:
        if text:
            node.parts.append(text)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            up = node
            while up is not None and up.tag != tag:
                if tag not in BLOCK and up.tag in BLOCK:  # an inline end tag does not end a block
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag in ("html", "body") and node.parent is None and tag == "html":
            continue
        if tag in CLOSES_P:  # a block ends an open paragraph and the inline elements in it
            up = node
            while up is not None and up.tag not in SCOPES and up.tag != "p":
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                node = up.parent
        if tag in SIBLINGS:
            up = node
            while up is not None and up.tag not in SIBLINGS[tag] and up.tag not in SCOPES - SIBLINGS[tag]:
                up = up.parent
            if up is not None and up.tag in SIBLINGS[tag] and up.parent is not None:
                node = up.parent
        inside, up = False, node
        while up is not None and not inside:
            inside, up = up.tag in HOLDERS, up.parent
        child = _Node(tag, node)
        _judge(child, m["attr"] or "", inside)
        node.parts.append(child)
        node.kids.append(child)
        if tag not in VOID and (not (m["attr"] or "").endswith("/") or _BARE.search(m["attr"])):
            node = child
    add(page[at:])
    return root


def _measure(root: _Node) -> list[_Node]:
    """Count characters and tags, without furniture; the nodes that count, parents first."""
    order, stack = [], [root]
    every, others = [root], -1
    for n in every:
        if not n.junk or n.hidden:
            pass
        elif n.tag == "form":
            others = _counts(root)[0] if others < 0 else others
            n.junk = not _holds_page(n, others)
        elif n.tag not in DROPPED and n.tag != "header" and (_own_text(n) or _own_section(n)):
            n.junk = False
        every += n.kids
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in n.kids if not k.junk]
    for n in reversed(order):
        n.chars = sum(len("".join(x.split())) for x in n.parts if isinstance(x, str))
        for k in n.kids:
            if not k.junk:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    return order


def density(n: _Node, body: _Node) -> float:
    """Characters per tag, times the logarithm of (C/LC * T/LT) to a base that grows with links."""
    if not n.chars:
        return 0.0
    tags, links, link_tags = n.tags or 1, n.link_chars or 1, n.link_tags or 1
    plain = (n.chars - n.link_chars) or 1
    base = math.log(n.chars / plain * n.link_chars + body.link_chars / (body.chars or 1) * n.chars + math.e)
    return n.chars / tags * math.log(max(1.0, n.chars / links * tags / link_tags) + 1e-9) / math.log(base + 1.0)


def select(root: _Node) -> _Node | None:
    order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    if not body.chars:
        body = root
    if not body.chars:
        return None
    dense = {id(n): density(n, body) for n in order}
    best, most, below = body, -1.0, {id(body)}
    for n in order:  # parents first
        if n is not body and (n.parent is None or id(n.parent) not in below):
            continue
        below.add(id(n))
        total = sum(dense[id(k)] for k in n.kids if not k.junk)
        if total > most:
            best, most = n, total
    path, n = [], best
    while n is not None:
        path.append(n)
        if n is body:
            break
        n = n.parent
    # The article around the densest subtree, or the one that is most of it.
    for tag in HOLDERS:
        around = next((n for n in path if n.tag == tag), None)
        inner = [n for n in order if n.tag == tag and n.chars * 2 >= best.chars and _within(n, best)]
        if around is not None or inner:
            found = around if around is not None else max(inner, key=lambda n: n.chars)
            return _with_others(found, body, order, dense)
    _prune(body, order, path, dense)
    return body


def _with_others(found: _Node, body: _Node, order: list[_Node], dense: dict[int, float]) -> _Node:
    """found, or the body with nothing but it and the elements of its kind outside it that reach
    the lowest density on found's own way from the body."""
    way, n = {id(found), id(body)}, found
    while n is not None and n is not body:
        way.add(id(n))
        n = n.parent
    threshold = min(dense[i] for i in way)
    held, inside = {id(found)}, {id(found)}
    for n in order:  # parents first
        if n is found or n.parent is not None and id(n.parent) in inside:
            inside.add(id(n))
        elif n.tag == found.tag and id(n) not in way and n.chars and dense[id(n)] >= threshold:
            held.add(id(n))
            inside.add(id(n))
    if len(held) == 1:
        return found
    partial = set()
    for n in order:
        if id(n) in held:
            while n is not body and n.parent is not None:
                n = n.parent
                partial.add(id(n))
    stack = [body]
    while stack:
        n = stack.pop()
        n.parts = [x for x in n.parts if not isinstance(x, str)]
        for k in n.kids:
            if id(k) in partial:
                stack.append(k)
            elif id(k) not in held:
                k.junk = True
    return body


def _prune(body: _Node, order: list[_Node], path: list[_Node], dense: dict[int, float]) -> None:
    """Cut all below body but the densest subtree (path's first) and what reaches the path's threshold."""
    threshold, way = min(dense[id(x)] for x in path), {id(x) for x in path}
    top: dict[int, tuple[float, _Node]] = {}  # of each node, the largest sum in its subtree
    for n in reversed(order):
        kids = [k for k in n.kids if not k.junk]
        own = sum(dense[id(k)] for k in kids), n
        top[id(n)] = max([own, *(top[id(k)] for k in kids)], key=lambda x: x[0])
    whole, partial, stack = {id(path[0])}, set(way), [body]

    def keep(n: _Node) -> None:
        whole.add(id(n))
        while n is not body and n.parent is not None and id(n.parent) not in partial:
            n = n.parent
            partial.add(id(n))

    while stack:
        n = stack.pop()
        if id(n) in whole:
            continue
        if id(n) not in way:
            if n.tag == "h1":
                keep(n)
                continue
            if n.chars and dense[id(n)] >= threshold:
                keep(top[id(n)][1])
            elif n.tag not in ("header", "hgroup"):
                continue
        kids = [k for k in n.kids if not k.junk]
        inline = [k for k in kids if k.tag not in BLOCK]
        if sum(len("".join(x.split())) for x in n.parts if isinstance(x, str)) > sum(k.link_chars for k in inline):
            for k in inline:  # a part of the node's own running text
                keep(k)
        stack += kids
    stack = [body]
    while stack:
        n = stack.pop()
        for k in n.kids if id(n) not in whole else ():
            if id(k) not in whole and id(k) not in partial:
                k.junk = True
            stack.append(k)


def _within(n: _Node, top: _Node) -> bool:
    while n is not None and n is not top:
        n = n.parent
    return n is top


def text_of(node: _Node) -> str:
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(_html.unescape(x))  # a reference ends where its text node does
        elif not x.junk or x is node:
            if x.tag in BLOCK:
                out.append(" ")
                stack.append(" ")
            stack += reversed(x.parts)
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = select(parse(page))
    return text_of(found) if found is not None else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, in one Arrow pass without a shuffle."""
    rt.prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rt.small(batches):
            found = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
