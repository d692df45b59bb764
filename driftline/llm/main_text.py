"""The main text of web pages by tree scoring.

A page becomes a tree; elements that say what they are (menus, forms, adverts, comments, ... by tag, role,
class or id) are cut off. Each paragraph gives points, one for being there, one for each comma, up to three
for its length, to the container around it, half of them to the next container and less further up. A container's
points are discounted by the share of its text that lies in links. The best container (the whole article, if
it lies in one) is kept with those of its siblings that have points of their own or are of its kind, headings
included; lists that are nearly all links are dropped from it. All other blocks are joined in page order.

One page is one row of an Arrow batch of bounded bytes: no shuffle, and a task holds one tree at a time. No
step recurses, so markup may be as deep as it likes.

Defined cases: null, empty and blank pages give the empty text; a page cut off anywhere gives what its
beginning holds (an unfinished tag or comment is dropped, an unfinished reference stays as written);
repeated rows give equal rows; equal points go to the container that comes first; an empty table gives an
empty result; carried columns keep their names and result names that clash with them get a prefix.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import fresh, map_arrow, named

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("html table td th caption template object button".split())
#: A start tag of this kind ends an open element of these kinds, up to the first of the limits.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)), "optgroup": (("optgroup",), ("select",)),
}

# What is not main text, by element, role, and word of class or id.
DROP_TAGS = frozenset("aside audio button canvas datalist dialog embed footer form head iframe input menu nav noembed noframes noscript object "
                      "option script search select style svg template textarea title video xmp".split())
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adslot adsbygoogle breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr login menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup "
    "promo promotion promotions recommended recommendations related replies reply respond share sharing sidebar sidebars signup social sponsor sponsored "
    "subscribe subscription taboola outbrain toolbar widget widgets".split())
#: These words drop an element only where no word of KEEP_WORDS stands beside them.
DROP_WORDS_ALONE = frozenset("alert banner discussion header masthead overlay rail search skip tags topbar".split())
KEEP_WORDS = frozenset("article blog body content entry main page post story text".split())

#: What can hold a page's main text, with the points it starts with. Rows and lists are no containers: they would part a text.
START_POINTS = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0, "td": 3.0, "center": 0.0, "blockquote": 0.0, "body": 0.0, "html": 0.0}
LEVELS = 5
#: Characters from which a paragraph has its full point.
FULL_CHARS = 25
COMMAS = re.compile("[,،、，]")
SIBLING_SHARE = 0.2
SIBLING_LEAST = 10.0
LINK_LIST = 0.7

_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_WORDS = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    """A node; ``parts`` are texts and elements in order."""

    __slots__ = ("tag", "attributes", "parent", "parts", "points", "chars", "link_chars", "links")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.parts: list[str | Element] = []
        self.points: float | None = None
        self.chars = self.link_chars = self.links = 0


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` and the position after the tag's end, or -1 if the page ends first."""
    found: dict[str, str] = {}
    while True:
        match = _ATTRIBUTE.match(page, at)
        if match is None:
            break
        name, value = match.group(1).lower(), match.group(2) or ""
        if name not in found:
            found[name] = html.unescape(value[1:-1] if value[:1] in ('"', "'") and len(value) > 1 else value)
        at = match.end()
    end = page.find(">", at)
    return found, end + 1 if end >= 0 else -1


def _tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", text, {}), ("start", tag, attributes) and ("end", tag, {}) in order."""
    at, size = 0, len(page)
    while at < size:
        less = page.find("<", at)
        if less < 0:
            yield "text", page[at:], {}
            return
        if less > at:
            yield "text", page[at:less], {}
        at = less
        mark = page[at + 1:at + 2]
        if mark == "!" and page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                at = page.find(">", at) + 1
                continue
            end = page.find("-->", at + 4)
            if end < 0:
                return
            at = end + 3
        elif mark in ("!", "?") or (mark == "/" and not page[at + 2:at + 3].isalpha()):
            end = page.find(">", at)
            if end < 0:
                return
            at = end + 1
        elif name := _TAG_NAME.match(page, at + (2 if mark == "/" else 1)):
            attributes, after = _attributes(page, name.end())
            if after < 0:
                return
            tag = name.group().lower()
            at = after
            if mark == "/":
                yield "end", tag, {}
                continue
            yield "start", tag, attributes
            if tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>]|$)", re.I).search(page, at)
                if close is None:
                    return
                at = close.start()
        else:
            yield "text", "<", {}
            at += 1


def parse(page: str) -> Element:
    """The page's tree. Missing end tags are supplied where HTML does; stray ones are ignored."""
    root = Element("html", {}, None)
    here = root
    n_open: Counter[str] = Counter()

    def leave() -> None:
        nonlocal here
        n_open[here.tag] -= 1
        here = here.parent

    def close(tags: Sequence[str], limits: frozenset | Sequence[str]) -> None:
        if not any(n_open[t] for t in tags):
            return
        node = here
        while node is not root and node.tag not in tags:
            if node.tag in limits:
                return
            node = node.parent
        if node is not root:
            while here is not node:
                leave()
            leave()

    for kind, value, attributes in _tokens(page):
        if kind == "text":
            if here.tag == "head" and value.strip():
                leave()
            here.parts.append(html.unescape(value) if "&" in value else value)
        elif kind == "start":
            if value == "html":
                continue
            if here.tag == "head" and value not in HEAD:
                leave()
            if value in ENDS:
                close(*ENDS[value])
            if value in BLOCK:
                close(("p",), SCOPES)
                if value in HEADINGS and here.tag in HEADINGS:
                    leave()
            elif value == "a":
                close(("a",), BLOCK)
            node = Element(value, attributes, here)
            here.parts.append(node)
            if value not in VOID:
                here = node
                n_open[value] += 1
        elif value not in VOID:
            close((value,), SCOPES - {value} if value in BLOCK else BLOCK)
    return root


def unwanted(node: Element) -> bool:
    """Whether an element says by tag, role, class or id that it is not main text."""
    tag, a = node.tag, node.attributes
    if tag in DROP_TAGS or "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").strip().lower() in DROP_ROLES:
        return True
    if _HIDDEN.search(a.get("style", "")):
        return True
    if tag == "header" and not _in_article(node):
        return True
    if tag in ("html", "body", "main"):
        return False
    label = f"{a.get('class', '')} {a.get('id', '')}"
    if label == " ":
        return False
    said = set(_WORDS.findall(_HUMPS.sub(" ", label).lower()))
    return bool(said & DROP_WORDS) or bool(said & DROP_WORDS_ALONE) and not said & KEEP_WORDS


def _in_article(node: Element) -> bool:
    node = node.parent
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def _clean(root: Element) -> list[Element]:
    """Cut unwanted elements off; what is left, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.parts = [p for p in node.parts if isinstance(p, str) or not unwanted(p)]
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Element))
    return order


def _measure(order: list[Element]) -> None:
    """Characters, characters in links and links of every element, white space not counted."""
    for node in reversed(order):
        for part in node.parts:
            if isinstance(part, str):
                node.chars += sum(map(len, part.split()))
            else:
                node.chars += part.chars
                node.link_chars += part.link_chars
                node.links += part.links
        if node.tag == "a":
            node.link_chars = node.chars
            node.links += 1


def blocks(tops: Sequence[Element]) -> Iterator[tuple[Element, str]]:
    """(block element, text) of all runs of inline content below ``tops``, in page order, white space normalised."""
    pieces: list[str] = []
    owner = tops[0] if tops else None

    def flushed() -> list[tuple[Element, str]]:
        nonlocal pieces
        text = " ".join("".join(pieces).split())
        pieces = []
        return [(owner, text)] if text else []

    stack: list[tuple[str, Element | str]] = [("in", top) for top in reversed(tops)]
    while stack:
        step, item = stack.pop()
        if isinstance(item, str):
            pieces.append(item)
        elif item.tag == "br":
            pieces.append(" ")
        elif item.tag in BLOCK or item.parent is None:
            yield from flushed()
            if step == "in":
                owner = item
                stack.append(("out", item))
                stack.extend(("in", p) for p in reversed(item.parts))
            else:
                owner = item.parent
                while owner is not None and owner.tag not in BLOCK:
                    owner = owner.parent
        else:
            stack.extend(("in", p) for p in reversed(item.parts))
    yield from flushed()


def _pass_points(root: Element) -> list[Element]:
    """Give every paragraph's points to its ancestors; the containers that got some, in the order they were met."""
    met: list[Element] = []
    for owner, text in blocks([root]):
        if owner.tag in HEADINGS:
            continue
        size = len(text)
        points = min(size / FULL_CHARS, 1.0) + len(COMMAS.findall(text)) + min(size / 100, 3.0)
        node = owner if owner.tag in START_POINTS and owner.tag not in ("td", "blockquote") else owner.parent
        level = 0
        while node is not None and level < LEVELS:
            if node.tag in START_POINTS:
                if node.points is None:
                    node.points = START_POINTS[node.tag]
                    met.append(node)
                node.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            node = node.parent
    for node in met:
        node.points *= 1 - node.link_chars / node.chars if node.chars else 0
    return met


def _kept(best: Element) -> list[Element]:
    """The best container and the siblings that belong to it, in page order."""
    if best.parent is None or best.tag == "body":
        return [best]
    least = max(SIBLING_LEAST, best.points * SIBLING_SHARE)
    kind = best.tag, best.attributes.get("class")
    out = []
    for node in best.parent.parts:
        if not isinstance(node, Element):
            continue
        density = node.link_chars / node.chars if node.chars else 0.0
        if (node is best or node.tag in HEADINGS or node.points is not None and node.points >= least
                or (node.tag, node.attributes.get("class")) == kind and density < 0.25
                or node.tag in ("p", "pre", "blockquote") and density < 0.25 and (node.chars > 80 or node.links == 0 and node.chars > 0)):
            out.append(node)
    return out


def _without_link_lists(tops: list[Element]) -> None:
    stack = list(tops)
    while stack:
        node = stack.pop()
        node.parts = [p for p in node.parts if isinstance(p, str) or not (
            p.tag in ("ul", "ol", "dl", "div", "section", "table") and p.links > 1 and p.link_chars > LINK_LIST * p.chars)]
        stack.extend(p for p in node.parts if isinstance(p, Element))


def main_text(page: str | None) -> str:
    """The main text of one page."""
    root = parse(page or "")
    _measure(_clean(root))
    met = _pass_points(root)
    if not met:
        return " ".join(text for _, text in blocks([root]))  # headings at most
    best = max(met, key=lambda node: node.points)
    node = best
    while node is not None:  # an article is whole
        best = node if node.tag == "article" else best
        node = node.parent
    tops = _kept(best)
    _without_link_lists(tops)
    return " ".join(text for _, text in blocks(tops))


def extract(pages: DataFrame, *, html: str = "html", carry: Sequence[str] | None = None) -> DataFrame:
    """``carry`` (all other columns if not given) with the page's main ``text`` and its length ``n_chars``."""
    kept = pages.select(*[named(c) for c in (carry if carry is not None else [c for c in pages.columns if c != html])])
    text, n_chars = fresh(kept, "text", "n_chars")
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    source, = fresh(kept, "page")
    return map_arrow(pages.select(*[named(c) for c in kept.columns], F.coalesce(named(html), F.lit("")).alias(source)), run, schema)
