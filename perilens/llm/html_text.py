"""Operator 3: the main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|select|object|canvas|title|xmp)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S | re.I,
)
#: Elements that make blocks of their own; all others are inline and only count as tags.
BLOCKS = frozenset(
    "html body head article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption"
    " blockquote pre figure figcaption address header footer nav aside form fieldset details summary center dialog menu hr".split()
)
VOID = frozenset("hr".split())
#: What an opening tag closes when it is the innermost open block.
CLOSES = {
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "tbody": {"td", "th", "tr", "thead", "p"}, "body": {"head"},
}
#: Elements that never hold the article.
APART = frozenset("head nav footer".split())
#: Elements that mostly don't, and words of class, id and role names that say the same; neither covers the bulk of a text.
MOSTLY_APART = frozenset("aside form menu dialog fieldset".split())
APART_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead banner cookie cookies consent gdpr notice notices ad ads advert adverts advertisement adsbygoogle"
    " sponsor sponsored promo promotion popup modal overlay comment comments disqus reply replies respond share sharing social newsletter subscribe subscription signup login"
    " related recommended pagination pager widget widgets toolbar skip search complementary contentinfo alert disclaimer".split()
)
#: Words at a name's end that say nothing about what is inside.
WRAPPERS = frozenset("wrap wrapper container outer inner box block area section list slot unit group row col column panel holder region zone".split())
#: Headings, which no name of theirs takes out; inline controls; words of what readers wrote and of adverts.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("button label".split())
READER_WORDS = frozenset("comment comments disqus reply replies respond".split())
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion".split())
NAMED = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Share of link characters from which a name that holds such a word somewhere is believed.
LINKED = 1 / 3


def named(names: str, known: frozenset[str] = APART_WORDS) -> int:
    """1 if a name is that of boilerplate (by the words ``known``), 3 if it may be, else 0.

    A compound name is about its last word (``reader-comments`` are comments, ``related-work`` is work), wrapper words
    aside; a word of the list further in front only makes it likely, and the block's links then decide.
    """
    mark = 0
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", CAMEL.sub("-", name).lower()) if w]
        while len(words) > 1 and words[-1] in WRAPPERS:
            words.pop()
        if words and words[-1] in known:
            return 1
        if any(w in known for w in words):
            mark = 3
    return mark


def _names(attributes: str) -> str:
    return " ".join(v.strip("\"'") for v in NAMED.findall(attributes))


def mark_of(name: str, attributes: str, inside: bool) -> int:
    """2 for an element that never holds the article, else 1, 3 or 0 as ``named``.

    No name takes a heading out. An article is only taken out as a reader's comment. A section that its id alone names, as documents name
    their sections, needs the links' word, unless it is named for comments. ``inside``: in an article or main element.
    """
    if name in APART or (name == "header" and not inside):
        return 2
    if name in MOSTLY_APART:
        return 1
    if not attributes or name in HEADINGS or name in ("body", "main"):
        return 0
    names = _names(attributes)
    if name == "article":
        return int(named(names, READER_WORDS) == 1)
    mark = named(names)
    if mark == 1 and name == "section" and named(names, READER_WORDS) != 1 and not named(_names(re.sub(r"(?i)(^|\s)id\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", " ", attributes))):
        return 3
    return mark


class Node:
    __slots__ = ("name", "up", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "apart", "mark", "links")

    def __init__(self, name: str, up: Node | None, mark: int):
        self.name, self.up, self.mark, self.apart, self.links = name, up, mark, False, 0
        self.parts: list[Node | str] = []
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 1
        self.density = self.total = 0.0


def dom(page: str) -> Node:
    """The block tree of a page; scripts, styles and comments are left out, ``mark`` is as ``mark_of`` says.

    Inline controls and inline elements that are named for adverts are left out up to their end or that of their block.
    """
    root = node = Node("html", None, 0)
    at = links = 0
    mute: list[str] = []

    def add(raw: str) -> None:
        if mute:
            return
        text = html.unescape(raw)
        node.parts.append(text)
        size = len("".join(text.split()))
        node.chars += size
        if links:
            node.link_chars += size

    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            mute.clear()
        elif mute:
            if name == mute[-1]:
                mute.pop() if m[2] else mute.append(name)
            continue
        elif not m[2] and (name in CONTROLS or (m[4] and not m[4].rstrip().endswith("/") and name not in ("br", "img", "wbr", "input") and named(_names(m[4]), ADVERT_WORDS) == 1)):
            mute.append(name)
            continue
        if name not in BLOCKS:
            if m[2]:
                links = 0 if name == "a" else links
                continue
            node.tags += 1
            if name == "a":  # a link ends where the next one starts
                links = 1
                node.link_tags += 1
            elif name == "br":
                node.parts.append(" ")
            continue
        if m[2]:
            if name == "html" or name == "body":
                continue
            up = node
            while up is not None and up.name != name:
                up = up.up
            if up is not None and up.up is not None:  # a link goes on into blocks and past them, but not out of the block it began in
                node, links = up.up, up.links
            continue
        if name == "html" or (name == "body" and any(isinstance(x, Node) and x.name == "body" for x in root.parts)):
            continue
        if name in VOID:
            node.parts.append(Node(name, node, 0))
            continue
        while node.up is not None and (node.name == "p" or node.name in CLOSES.get(name, ())):
            node, links = node.up, node.links
        inside, up = False, node
        while up is not None and not inside:
            inside, up = up.name in ("article", "main"), up.up
        child = Node(name, node, mark_of(name, m[4], inside))
        child.links = links
        node.parts.append(child)
        node = child
    if at < len(page):
        add(page[at:])
    return root


def set_apart(root: Node) -> Node:
    """Decides what is ``apart``: marked 2, or marked 1 (by 3 if a third of it is link text) unless that would cover the article.

    A mark of 1 doesn't count if the node holds an article or main element and none with text is outside all marks, or
    if it holds more than half of the text of the article that it is in (of the page, where no such element is
    outside all marks). Where all text is apart, marks of 1 don't count at all.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Node) and x.mark != 2]
    size, linked = {id(n): n.chars for n in order}, {id(n): n.link_chars for n in order}
    holds = {id(n): False for n in order}
    for n in reversed(order):
        holds[id(n)] |= n.name in ("article", "main") and size[id(n)] > 0
        if n.up is not None:
            size[id(n.up)] += size[id(n)]
            linked[id(n.up)] += linked[id(n)]
            holds[id(n.up)] |= holds[id(n)]
        if n.mark == 3:
            n.mark = int(size[id(n)] > 0 and linked[id(n)] >= LINKED * size[id(n)])
    clear, free = {id(None)}, False
    for n in order:
        if n.mark == 0 and id(n.up) in clear:
            clear.add(id(n))
            free |= n.name in ("article", "main") and size[id(n)] > 0
    within: dict[int, Node | None] = {id(None): None}
    text = False
    for n in order:
        holder = within[id(n.up)]
        bulk = 2 * size[id(n)] > size[id(holder or root)] and (holder is not None or not free)
        n.apart = (n.up is not None and n.up.apart) or (n.mark == 1 and not bulk and not (holds[id(n)] and not free))
        within[id(n)] = n if n.name in ("article", "main") else holder
        text |= n.chars > 0 and not n.apart
    for n in order:
        n.apart &= text
        for x in n.parts:
            if isinstance(x, Node) and x.mark == 2:
                x.apart = True
    return root


def weigh(root: Node) -> list[Node]:
    """Fills composite densities and their sums over children; gives the nodes that aren't boilerplate, top first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.apart:
            continue
        order.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Node)]
    for node in reversed(order):
        if node.up is not None:
            node.up.chars += node.chars
            node.up.tags += node.tags
            node.up.link_chars += node.link_chars
            node.up.link_tags += node.link_tags
    share = root.link_chars / max(1, root.chars)
    for node in order:
        c, t, lc, lt = node.chars, node.tags, node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1e-9) / max(1.0, math.log(base) if base > math.e else 1.0)
            if c > 0 and node.density <= 0:
                node.density = 0.0
    for node in order:
        inner = [x.density for x in node.parts if isinstance(x, Node) and not x.apart]
        node.total = sum(inner) if inner else node.density
    return order


def chosen(order: list[Node]) -> list[Node]:
    """The subtrees that make the article, in page order.

    The node with the greatest sum leads. If an article or main element holds it, that element is the article. If
    not, the least density on the leader's path to the body is the threshold, and every node that reaches it
    gives the greatest-sum node of its own subtree.
    """
    if not any(n.chars for n in order):
        return []
    best = max(order, key=lambda n: n.total)
    up, holder = best, None
    while up is not None:
        if up.name == "article" or (up.name == "main" and holder is None):
            holder = up
        up = up.up
    if holder is not None:
        return [holder]
    threshold, up = best.density, best
    while up is not None:
        if up.name not in ("html",):
            threshold = min(threshold, up.density)
        up = up.up
    greatest: dict[int, Node] = {}
    for node in reversed(order):
        top = node
        for x in node.parts:
            if isinstance(x, Node) and not x.apart and greatest[id(x)].total > top.total:
                top = greatest[id(x)]
        greatest[id(node)] = top
    marked = {id(greatest[id(n)]) for n in order if n.density >= threshold}
    out, inside = [], set()
    for node in order:
        if node.up is not None and id(node.up) in inside:
            inside.add(id(node))
        elif id(node) in marked:
            inside.add(id(node))
            out.append(node)
    return out


def blocks(node: Node) -> Iterator[str]:
    """The text blocks below a node, white space made single; boilerplate inside is left out."""
    run: list[str] = []
    stack: list[tuple[Node, int]] = [(node, 0)]
    while stack:
        here, i = stack.pop()
        while i < len(here.parts):
            part = here.parts[i]
            i += 1
            if isinstance(part, str):
                run.append(part)
                continue
            if run:
                yield " ".join("".join(run).split())
                run = []
            if not part.apart:
                stack.append((here, i))
                here, i = part, 0
        if run:
            yield " ".join("".join(run).split())
            run = []


def main_text(page: str | None) -> str:
    """The article of one page: its blocks in page order, joined by line ends; empty if there is none."""
    if not page:
        return ""
    return "\n".join(b for node in chosen(weigh(set_apart(dom(page)))) for b in blocks(node) if b)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each page's whole html in ``out_col`` (a column of that name is replaced).

    One pass without a shuffle; page by page, so memory grows with the longest page only. Null or empty html
    gives an empty text, as does a page without an article; cut-off pages are read as far as they go; repeated rows
    give repeated results; all other columns are kept.
    """
    rows = pages.drop(*([out_col] if out_col.lower() != html_col.lower() else []))
    schema = rows.select("*", F.lit("").alias(out_col)).schema
    at = [c.lower() for c in rows.columns].index(html_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                texts = [main_text(x.as_py()) for x in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*whole.schema.names, out_col])

    return rows.mapInArrow(run, schema)
