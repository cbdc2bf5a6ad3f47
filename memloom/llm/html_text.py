"""Main text of web pages by tree scoring.

A tolerant parser builds a tree. Paragraphs pass points for their length and commas to their ancestors (all to
the parent, half to its parent, a third to the one above); a container's points are discounted by the share of
its text that stands in links. The best container is kept, with siblings that score well or read like text.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
#: A name and its value, in order: what stands in a value is no name. Most tags have none of the names that matter.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
MATTERS = re.compile(r"class|id|role|hidden|style", re.I)

#: Fixed values of HTML: elements without content, with raw content, of block kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag of the same family ends, and the elements beyond which it does not reach.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = frozenset("script style noscript template iframe object embed applet svg canvas nav aside footer form button select textarea input label fieldset dialog menu head title search audio video map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id names: what is no text, what is a header of whatever it stands in, what is main text, and what says neither.
NEGATIVE = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|shar(?:e|ing)|social|comments?|repl(?:y|ies)|disqus|respond|sidebar|aside|widgets?|related|recommend\w*|menu|nav\w*|breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|copyright|hidden", re.I)
HEAD = re.compile(r"header|masthead", re.I)
POSITIVE = re.compile(r"article|body|content|entry|hentry|main|post|text|blog|story", re.I)
NEUTRAL = re.compile(r"box|bar|list|items?|links?|buttons?|btn|containers?|wrap(?:per)?|inner|outer|block|section|area|panel|site|page|global|top|bottom|left|right|fixed|sticky|holder|group|row|col(?:umn)?|slot|unit|zone|region|form|title|heading|count|toggle|icons?|primary|secondary|posts|articles|stories|more|media|message|card|\w*\d\w*|\w", re.I)
#: What readers wrote stays out however long it is.
COMMENTS = re.compile(r"comments?|repl(?:y|ies)|disqus|respond", re.I)
NO_NAME = frozenset("has with without no is".split())
WORDS = re.compile(r"[_\-.:\s]+|(?<=[a-z])(?=[A-Z])")
#: What a name says: nothing, that it may be no text, that it is a header, that it is no text, that it is a reader's text.
PLAIN, HINT, HEADER, NO_TEXT, READER = range(5)


def named(value: str) -> tuple[int, bool]:
    """What a class or id value says of an element, and whether it names main text.

    Only a name that has no other word than those of its kind says that something is no text: share-buttons does, share-price
    is a hint. In a name with words of both kinds the last one decides, but a comment's body is a comment; has-sidebar says
    nothing.
    """
    says, good = PLAIN, False
    for name in value.split():
        parts = [p for p in WORDS.split(name) if p]
        if not parts or parts[0].lower() in NO_NAME:
            continue
        kinds = [(bool(NEGATIVE.fullmatch(p)), bool(HEAD.fullmatch(p)), bool(POSITIVE.fullmatch(p))) for p in parts]
        negative, head, positive = (any(k[i] for k in kinds) for i in range(3))
        known = all(any(k) or NEUTRAL.fullmatch(p) for k, p in zip(kinds, parts, strict=True))
        now = PLAIN
        if any(COMMENTS.fullmatch(p) for p in parts) and known:
            now = READER
        elif negative and (not positive or kinds[-1][0] or kinds[0][0]):
            now = NO_TEXT if known else HINT
        elif head and known and not positive:
            now = HEADER
        says = max(says, now)
        good |= positive and now == PLAIN
    return says, good


HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("bad", "good", "kids", "links", "parent", "says", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False, says: int = PLAIN, good: bool = False) -> None:
        self.tag, self.parent, self.bad, self.says, self.good = tag, parent, bad, says, good
        self.kids: list[Node | str] = []
        self.score = 0.0
        self.size = self.links = 0


def parse(page: str) -> Node:
    """Tree of a page; never fails: stray end tags are ignored and open elements end with their parent."""
    root = here = Node("#root", None)
    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if not m:
            here.kids.append(entities.unescape(page[at:]))
            break
        if m.start() > at:  # a reference ends with its text: no markup can complete it
            here.kids.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                here.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            node = here
            while node.parent is not None and node.tag != tag:
                if node.tag in ("td", "th", "table", "article", "main", "body") and tag not in BLOCK:
                    node = root
                    break
                node = node.parent
            if node.parent is not None:
                here = node.parent
            continue
        if tag in BLOCK or tag in ENDS:
            here = _closed(here, tag)
        attributes = m[3] or m[6] or ""
        node = Node(tag, here, *_hints(tag, attributes))
        here.kids.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*/?>|</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if not close and tag in ("title", "noscript", "textarea"):
                continue
            at = close.end() if close else end
            continue
        here = node
    return root


def _closed(here: Node, tag: str) -> Node:
    """Where a block element goes: paragraphs, headings and list items that it ends implicitly are left."""
    names, stop = ENDS.get(tag, (set(), set()))
    node, target = here, None
    while node.parent is not None and node.tag not in stop:
        if node.tag == "p" or node.tag in names or (node.tag in HEADINGS and tag in HEADINGS):
            target = node.parent
        if node.tag in ("table", "td", "th", "article", "section", "div", "body", "main", "button") and node.tag not in names:
            break
        node = node.parent
    return target or here


def _hints(tag: str, attributes: str) -> tuple[bool, int, bool]:
    """Whether an element is no part of the text, what its names say, and whether it is named like main text."""
    bad, says, good = tag in DROPPED, HEADER if tag == "header" else PLAIN, tag in ("article", "main")
    if tag not in ("html", "body") and MATTERS.search(attributes):
        first: dict[str, str] = {}
        for name, value in ATTRIBUTE.findall(attributes):
            first.setdefault(name.lower(), value.strip("\"'"))
        for name, value in first.items():
            if name in ("class", "id"):
                own, main = named(value)
                good |= main
                if not main and tag not in ("article", "main", *HEADINGS):
                    says = max(says, own)
            elif name == "role":
                good |= value in ("main", "article")
                bad |= value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                bad = True
    return bad, says, good


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under ``node`` in page order, white space made one space, dropped elements left out."""
    out: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]  # None ends a block
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            pieces.append(x)
        elif x.tag == "br":
            pieces.append(" ")
        elif not x.bad or x is node:
            if x.tag in BLOCK or x is node:
                flush()
                stack.append(None)
            stack.extend(reversed(x.kids))
    return out


def judge(root: Node) -> None:
    """Mark the elements whose names say that they are no text, unless what they hold speaks against it.

    A header goes where it stands in no article. An element that only hints goes if it is mostly links, or short and without a
    paragraph. One that holds most of a longer page's text, in several paragraphs and few links, stays, whatever its name, unless
    readers wrote it.
    """
    order: list[tuple[Node, bool]] = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        if not node.bad:
            order.append((node, inside))
            within = inside or node.tag in ("article", "main")
            stack.extend((k, within) for k in node.kids if isinstance(k, Node))
    paragraphs: dict[int, int] = {}
    for node, _ in reversed(order):
        kids = [k for k in node.kids if isinstance(k, Node) and not k.bad]
        node.size = sum(len(k.strip()) for k in node.kids if isinstance(k, str)) + sum(k.size for k in kids)
        node.links = node.size if node.tag == "a" else sum(k.links for k in kids)
        paragraphs[id(node)] = (node.tag == "p") + sum(paragraphs[id(k)] for k in kids)
    for node, inside in order:
        linked = 3 * node.links > node.size
        most = 2 * node.size > root.size and node.size >= 400 and paragraphs[id(node)] > 1 and not linked
        if node.says == READER or node.says == NO_TEXT and not most or node.says == HEADER and not inside and not most:
            node.bad = True
        elif node.says == HINT:
            node.bad = linked or node.tag not in ("p", "td", "li", "span", "em", "strong", "b", "i") and not paragraphs[id(node)] and node.size < 100
    for node, _ in order:
        node.size = node.links = 0


def main_node(root: Node) -> list[Node]:
    """The nodes whose text is the page's main text: the best container, and siblings that belong to it."""
    judge(root)
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.bad:
            continue
        order.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node))
    commas: dict[int, int] = {}
    for node in reversed(order):  # children before parents
        own = "".join(k for k in node.kids if isinstance(k, str)).split()
        kids = [k for k in node.kids if isinstance(k, Node) and not k.bad]
        node.size = sum(map(len, own)) + max(0, len(own) - 1) + sum(k.size for k in kids)
        node.links = node.size if node.tag == "a" else sum(k.links for k in kids)
        commas[id(node)] = sum(w.count(",") + w.count("،") + w.count("，") for w in own) + sum(commas[id(k)] for k in kids)
    scored: list[Node] = []
    for node in order:
        leaf = node.tag in ("p", "pre") or node.tag in ("blockquote", "td", "th", "dd", "div", "section", "article", "main", "body", "li") and not any(isinstance(k, Node) and k.tag in BLOCK and not k.bad for k in node.kids)
        if not leaf or node.size < 25:
            continue
        points = (1 + commas[id(node)] + min(node.size / 100, 3)) * (1 - node.links / node.size)
        up, share = node.parent, 1
        while up is not None and share <= 3:
            if not up.score and up.parent is not None:
                up.score = 25.0 * up.good
                scored.append(up)
            up.score += points / share
            up, share = up.parent, share + 1
    scored = [n for n in scored if n.parent is not None and n.tag not in ("html",)]
    value = lambda n: n.score * (1 - n.links / max(1, n.size))
    best = max(scored, key=value, default=None)
    if best is None:
        named = [n for n in order if n.tag in ("article", "main") and n.size] or [n for n in order if n.good and n.size] or [n for n in order if n.tag == "body"] or [root]
        return [max(named, key=lambda n: n.size)]
    if best.tag not in ("article", "main"):  # a section of an article is part of it
        up = best.parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        best = up if up is not None and not up.bad else best
    least, out = max(3.0, 0.2 * value(best)), []
    for kid in best.parent.kids if best.parent is not None else [best]:
        if kid is best:
            out.append(kid)
        elif isinstance(kid, Node) and not kid.bad and kid.says != HEADER and kid.size:
            density = kid.links / kid.size
            if value(kid) >= least or kid.tag == "p" and (kid.size > 80 and density < 0.25 or density == 0 and kid.size >= 25):
                out.append(kid)
    return out


def main_text(page: str | None) -> str:
    """Main text of a page: its blocks joined by newlines; empty for null, empty or textless pages."""
    if not page:
        return ""
    root = parse(page.replace("\0", "�"))
    return "\n".join(b for node in main_node(root) for b in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages(page_id, url, html)``.

    Null or empty html: empty text. Broken markup is read as far as it goes. Very long pages are read whole, in time that follows
    their length. Repeated rows are extracted each. No rows: no rows. Other columns are ignored.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def make():
        def step(part: pa.RecordBatch) -> dict:
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            return {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return map_rows(pages.select("page_id", "url", "html"), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", make, rows=64)
