"""Main text of web pages by tree scoring.

A page becomes a light tree. Controls, hidden parts, scripts, styles and reader comments never count. Elements whose tag,
role, class or id says menu, header, footer, sidebar, notice, advert or form are only doubted: one that holds a marked
article (``article``, ``main`` or that role) with half of the page's unlinked text, or, doubted for its name or as a form,
most of that text, stays; a page of which nothing is left is read again with fewer doubts. Every paragraph passes points to
its parent (all of them), grandparent (half) and further ancestors (less): one, one per comma, one per 100 characters
up to three. A container's points are discounted by the share of its text inside links. The best container is kept
with those siblings that score near it or are paragraphs of running text. The kept containers' blocks are written in
page order, white space inside a block as one space, blocks two line feeds apart.

Scale: a narrow pass without a shuffle; a page is parsed alone in memory, by one regular expression over its text and
an explicit stack, so depth is not bounded by recursion.

Nulls and edges: a null or empty page, or one without text, gives an empty text; unclosed, misplaced and truncated
tags are accepted; a null page_id or url passes; repeated rows each give a row; other columns are ignored.
"""
from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from soilcast.llm.common import ship

ship(__name__)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
                    re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"p", "div", "article", "section", "main", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol",
          "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote",
          "pre", "figure", "figcaption", "header", "footer", "nav", "aside", "form", "fieldset", "address", "hr",
          "details", "summary", "center", "main"}
# Elements without article text by their tag, unless the article stands in them; a header inside an article is its own.
SKIP_TAGS = {"nav", "footer", "aside", "dialog", "menu"}
CONTROLS = {"head", "button", "select", "input", "option"}      # never text
SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
MAIN_ROLES = {"main", "article"}
_SKIP_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|side-bar|widget|footer|header|masthead|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|"
    r"subscri\w+|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|login|signup|search)(?=$|[\s_-])", re.I)
_COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|comment(?!ar)\w+|disqus\w*|respond|replies|reply)(?=$|[\s_-])", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HOLDS = 0.5      # a removed element that holds a marked article with so much of the page's unlinked text stays
MOST = 0.8       # so does one, removed for its name or as a form, that holds so much of it
KEEP_NAMES = {"article", "post", "entry", "content", "main", "story", "text", "body", "main-content", "post-content",
              "entry-content", "article-body", "post-body", "hentry"}
_LAYOUT = re.compile(r"\b(?:has|with|no|without)-\S+", re.I)  # names that say what stands beside an element
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
              "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SCOPE = {"table", "td", "th", "ul", "ol", "dl", "div", "article", "section", "body", "blockquote"}
GOOD, BAD = {"article": 30.0, "main": 25.0, "section": 5.0, "div": 5.0, "td": 3.0, "pre": 3.0, "blockquote": 3.0}, {
    "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0, "address": -3.0, "th": -5.0}


class Node:
    __slots__ = ("tag", "parent", "kids", "points", "chars", "linked", "skip", "attrs", "doubt")

    def __init__(self, tag: str, parent: Node | None, attrs: str = "", doubt: str = ""):
        self.tag, self.parent, self.attrs, self.doubt, self.skip = tag, parent, attrs, doubt, False
        self.kids: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0


def _names(attrs: str) -> tuple[str, str, bool]:
    names, role, hidden = [], "", False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            names.append(value)
        elif key == "role":
            role = value.lower()
        elif key == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif key == "hidden" or value.lower() == "true":
            hidden = True
    return " ".join(names), role, hidden


def _doubt(tag: str, attrs: str, parent: Node) -> str:
    """Why an element may hold no article text: "never" (controls, hidden parts), "comment", "tag", "name", or ""."""
    if tag in CONTROLS:
        return "never"
    names, role, hidden = _names(attrs) if attrs else ("", "", False)
    if hidden:
        return "never"
    names = _LAYOUT.sub("", _CAMEL.sub("-", names))
    if names and tag not in ("html", "body", "main") and _COMMENT_NAME.search(names) and not (
            KEEP_NAMES & set(names.lower().split())):
        return "comment"
    if tag in SKIP_TAGS or tag == "header" and not any(a.tag in ("article", "main") for a in _above(parent)):
        return "tag"
    if tag == "form" or tag == "label" and any(a.tag == "form" for a in _above(parent)) \
            and not any(a.tag == "p" for a in _above(parent)):
        return "name"
    if tag in ("html", "body", "article", "main") or role in MAIN_ROLES:
        return ""
    return "name" if role in SKIP_ROLES or names and _SKIP_NAME.search(names) and not (
        KEEP_NAMES & set(names.lower().split())) else ""


def decide(root: Node, trust: int = 0) -> None:
    """Sets ``skip`` of every element. Nothing is removed for its tag or name alone: an element that holds a marked article
    with half of the page's unlinked text stays, and so does one doubted for its name that holds most of that text.
    ``trust`` 1 keeps everything doubted for its name, 2 also for its tag."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node)]
    prose: dict[int, int] = {}
    holds: dict[int, int] = {}       # unlinked text of the largest marked article in it
    for node in reversed(order):
        n, most = sum(len(k.strip()) for k in node.kids if isinstance(k, str)), 0
        for k in node.kids:
            if isinstance(k, Node):
                n, most = n + prose[id(k)], max(most, holds[id(k)])
        if node.doubt in ("never", "comment") or node.tag == "a":
            n = most = 0
        elif node.tag in ("article", "main") or node.attrs and _names(node.attrs)[1] in MAIN_ROLES:
            most = n
        prose[id(node)], holds[id(node)] = n, most
    total = max(1, prose[id(root)])
    for node in order:                   # parents come before their children
        if node.doubt in ("never", "comment"):
            own = True
        elif node.doubt == "tag":
            own = trust < 2 and holds[id(node)] < HOLDS * total
        elif node.doubt == "name":
            own = trust < 1 and holds[id(node)] < HOLDS * total and prose[id(node)] < MOST * total
        else:
            own = False
        node.skip = own or node.parent is not None and node.parent.skip


def _above(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def parse(page: str) -> Node:
    """The tree of a page: text, block and inline elements, with the doubts about each."""
    root = here = Node("html", None)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            _text(here, page[at:])
            break
        _text(here, page[at:m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and not any(a.tag == "p" for a in _above(here)):
                continue
            stop = here
            while stop is not None and stop.tag != tag:
                # an inline end tag does not close the block around it
                if tag not in BLOCKS and stop.tag in BLOCKS:
                    stop = None
                    break
                stop = stop.parent
            if stop is not None and stop.parent is not None:
                here = stop.parent
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in ("html", "body") and any(a.tag == tag for a in _above(here)):
            continue
        if tag in VOID:
            here.kids.append(Node(tag, here) if tag == "hr" else " ")
            continue
        if tag in _CLOSES_P or tag in _CLOSED_BY:
            here = _close_open(here, tag)
        if m[3].endswith("/") and tag not in BLOCKS:
            continue
        child = Node(tag, here, m[3], _doubt(tag, m[3], here))
        here.kids.append(child)
        here = child
    return root


def _close_open(here: Node, tag: str) -> Node:
    """Close a paragraph or an item that a new ``tag`` ends; formatting elements inside it end with it."""
    ended = _CLOSED_BY.get(tag, set()) | ({"p"} if tag in _CLOSES_P else set())
    for a in _above(here):
        if a.tag in ended and a.parent is not None:
            return a.parent
        if a.tag in _SCOPE or a.tag == "html":
            break
    return here


def _text(here: Node, raw: str) -> None:
    if raw and here.doubt != "never":
        here.kids.append(html.unescape(raw) if "&" in raw else raw)


def score(root: Node) -> list[Node]:
    """Passes points up the tree; returns the containers that got any."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node) and not k.skip]
    candidates: dict[int, Node] = {}
    for node in reversed(order):  # children come before their parents
        own = [k for k in node.kids if isinstance(k, str)]
        node.chars = sum(len(" ".join(k.split())) for k in own)
        node.linked = node.chars if node.tag == "a" else 0
        for k in node.kids:
            if isinstance(k, Node) and not k.skip:
                node.chars += k.chars
                node.linked += k.chars if node.tag == "a" else k.linked
        inline = "".join(_inline(node)) if node.tag in ("p", "pre", "td", "blockquote", "li") or _has_text(own) else ""
        length = len(_SPACE.sub(" ", inline).strip())
        if length < 1 or node.tag in ("a",) or node.tag not in BLOCKS:
            continue
        points = 1 + inline.count(",") + inline.count("，") + min(length / 100, 3.0)
        ancestors = [a for a in _above(node.parent)] if node.tag not in ("div", "article", "section", "main", "body") \
            else list(_above(node))
        for depth, a in enumerate(ancestors):
            if a.tag not in BLOCKS:
                continue
            if id(a) not in candidates:
                candidates[id(a)] = a
                a.points += GOOD.get(a.tag, 0.0) + BAD.get(a.tag, 0.0)
            a.points += points / (1 if depth == 0 else 2 if depth == 1 else depth * 3)
    return list(candidates.values())


def _has_text(own: list[str]) -> bool:
    return any(not k.isspace() for k in own)


def _inline(node: Node) -> Iterator[str]:
    """The text of a node and of the inline elements in it, without its inner blocks."""
    stack: list[Node | str] = list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            yield k
        elif not k.skip and k.tag not in BLOCKS:
            stack += reversed(k.kids)


_SENTENCE = re.compile(r"^(?!©|\(c\)|copyright\b).*[.!?…。！？]['\"”»)]*$", re.I | re.S)


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def kept(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    found = score(root)
    if not found:
        return [root]
    for a in found:
        a.points *= 1 - density(a)
    best = max(found, key=lambda a: a.points)
    # a page that marks its article is taken at its word: the winner's whole article, else its whole main part
    around = {a.tag: a for a in reversed(list(_above(best)))}
    best = around.get("article") or around.get("main") or best
    if best.parent is None:
        return [best]
    marked = best.tag in ("article", "main")
    least = max(10.0, best.points * 0.2)
    names = _names(best.attrs)[0]
    out = []
    for k in best.parent.kids:
        if not isinstance(k, Node) or k.skip:
            continue
        bonus = best.points * 0.2 if names and _names(k.attrs)[0] == names else 0.0
        if k is best or k.points + bonus >= least and k.points > 0:
            out.append(k)
        elif k.tag == "p" and k.chars:
            # a short paragraph must be a sentence, and stands beside no marked article
            if k.chars > 80 and density(k) < 0.25 or density(k) == 0 and not marked and _SENTENCE.search(
                    "".join(_inline(k)).strip()):
                out.append(k)
        elif k.tag in ("h1", "h2", "h3") and k.chars and density(k) < 0.25:
            out.append(k)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below ``nodes``, in page order."""
    out, buffer = [], []

    def flush():
        text = _SPACE.sub(" ", "".join(buffer)).strip()
        buffer.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = []
    for n in reversed(nodes):
        stack += [None, n, None]
    while stack:
        k = stack.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            buffer.append(k)
        elif not k.skip:
            if k.tag in BLOCKS:
                stack += [None, *reversed(k.kids), None]
            else:
                stack += reversed(k.kids)
    flush()
    return out


def main_text(page: str) -> str:
    if not page:
        return ""
    for trust in (0, 1, 2):      # a page of which nothing is left is read again with fewer doubts
        root = parse(page)
        decide(root, trust)
        text = "\n\n".join(blocks(kept(root)))
        if text:
            break
    return text


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
