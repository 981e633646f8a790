"""Main text of a web page by tree scoring.

The page becomes a tree. Boilerplate (menus, page headers and footers, sidebars, notices, adverts, forms, reader
comments, scripts, styles) is left out by tag, role and class. Each remaining paragraph gives points for its
length and its commas to its ancestors: all of them to the parent, half to the grandparent, less further up. A
container's points are discounted by its link density; the best container is kept with the siblings that score
too, or its enclosing article. Each block's white space becomes single spaces, blocks are joined by one space.

Every page is handled on its own, whole; nothing is shuffled. Ordinary pages take time about linear in their length;
hostile markup (thousands of unclosed tags or quotes, deeply nested inline runs) can take time that grows with the
square of the page's length.

Defined cases: a null or empty page, and a page without any text outside boilerplate, has the empty text;
unclosed and misnested markup is repaired; repeated rows each get their row; a null page id keeps its row; columns
other than the id, url and html stay outside, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemirror.llm.common import only

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:script|style|noscript|template|textarea|iframe|title)\b[^>]*+>"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|[^<]++|<""",
    re.S | re.I)
RAW = re.compile(r"<(script|style|noscript|template|textarea|iframe|title)\b", re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table "
                   "tbody td tfoot th thead tr ul caption").split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option body html summary figcaption li dd dt".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
         "th": ("table", "tr"), "option": ("select",), "p": ("table", "td", "th", "button", "object")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What counts as boilerplate.
DROP_TAGS = frozenset("nav footer aside form button select iframe object embed svg canvas dialog menu head".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar".split())
DROP_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner banners cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login sidebar "
    "sidenav menu menus nav navbar navigation navi breadcrumb breadcrumbs masthead footer comment comments disqus reply "
    "replies respond share sharing social related recommended recommendations widget widgets toolbar pagination "
    "pager search skip").split())
KEEP_TAGS = frozenset("html body article main".split())


class Node:
    __slots__ = ("tag", "parent", "children", "names", "role", "dropped", "depth", "points", "length", "linked")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.points, self.length, self.linked = 0.0, 0, 0
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)} if "=" in attrs else {}
        self.names = frozenset(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower())
                               if found else ())
        self.role = found.get("role", "").lower()
        hidden = (re.search(r"\bhidden\b(?!\s*=\s*[\"']?until-found)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attrs)) is not None
                  or found.get("aria-hidden", "").lower() == "true"
                  or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I) is not None) if attrs else False
        self.dropped = hidden or boilerplate(self)


def boilerplate(node: Node) -> bool:
    if node.tag in KEEP_TAGS:
        return False
    if node.tag in DROP_TAGS or node.role in DROP_ROLES or not DROP_NAMES.isdisjoint(node.names):
        return True
    if node.tag == "header" or "header" in node.names:
        return not inside(node, ("article", "main"))
    return False


def inside(node: Node, tags: tuple[str, ...]) -> bool:
    up = node.parent
    while up is not None:
        if up.tag in tags:
            return True
        up = up.parent
    return False


def parse(page: str) -> Node:
    """The tree of a page; missing and misplaced end tags are repaired as browsers do for common cases."""
    root = top = Node("html", None)
    open_tags: dict[str, int] = {}
    at, end = 0, len(page)

    def close_to(node: Node) -> Node:
        nonlocal top
        while top is not node:
            open_tags[top.tag] -= 1
            top = top.parent
        open_tags[node.tag] -= 1
        top = node.parent
        return top

    def nearest(tags: tuple[str, ...], barrier: tuple[str, ...]) -> Node | None:
        if not any(open_tags.get(t) for t in tags):
            return None
        node = top
        while node is not root:
            if node.tag in tags:
                return node
            if node.tag in barrier:
                return None
            node = node.parent
        return None

    while at < end:
        m = TOKEN.match(page, at)
        at, whole = m.end(), m[0]
        if whole[0] != "<" or len(whole) == 1:
            top.children.append(whole)
            continue
        if raw := RAW.match(whole):
            done = re.compile(rf"</{raw[1]}\s*>", re.I).search(page, at)
            at = done.end() if done else end
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag in VOID or not open_tags.get(tag):
                if tag == "br":
                    top.children.append(" ")
                continue
            found = nearest((tag,), ("table",) if tag not in ("table", "article", "main", "body", "html", "div", "section") else ())
            if found is not None:
                close_to(found)
            continue
        if tag in VOID:
            top.children.append(Node(tag, top) if tag == "hr" else " " if tag == "br" else "")
            continue
        if tag in ("html", "body") and open_tags.get(tag, tag == "html"):
            continue
        if tag in CLOSES_P and (found := nearest(("p",), SCOPE["p"])) is not None:
            close_to(found)
        if tag in HEADINGS and top.tag in HEADINGS:
            close_to(top)
        while tag in SAME and (found := nearest(SAME[tag], SCOPE[tag])) is not None:
            close_to(found)
        node = Node(tag, top, m["attrs"] or "")
        top.children.append(node)
        if not (m["attrs"] or "").endswith("/") or tag in BLOCK:
            top = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def walk(root: Node):
    """Nodes outside boilerplate, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            yield node
            stack.extend(x for x in reversed(node.children) if not isinstance(x, str))


def score(root: Node) -> list[Node]:
    """Fill in points, text length and link length of all nodes outside boilerplate; returns them, parents first."""
    order = list(walk(root))
    for node in reversed(order):
        text = sum(len(x.strip()) for x in node.children if isinstance(x, str))
        inner = [x for x in node.children if not isinstance(x, str) and not x.dropped]
        node.length = text + sum(x.length for x in inner)
        node.linked = node.length if node.tag == "a" else sum(x.linked for x in inner)
    for node in order:
        own = [x for x in node.children if isinstance(x, str) or x.tag not in BLOCK]
        if node.tag not in BLOCK or not own or node.length == node.linked:
            continue
        length = sum(len(x.strip()) if isinstance(x, str) else x.length for x in own)
        if not length:
            continue
        commas = sum(x.count(",") for x in own if isinstance(x, str)) + sum(
            text.count(",") for x in own if not isinstance(x, str) for n in walk(x) for text in n.children if isinstance(text, str))
        points = (1 + commas + min(length / 100, 3)) * (0.3 if node.tag in HEADINGS else 1)
        up, share = node.parent or node, 1.0
        for level in range(1, 6):
            up.points += points * share
            if up.parent is None:
                break
            up, share = up.parent, 1.0 / (2 * level)
    return order


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def main_nodes(root: Node) -> list[Node]:
    """The best container, or its article, or it with the siblings that belong to it; in page order."""
    order = [n for n in score(root) if n.length]
    if not order:
        return []
    best = max(order, key=lambda n: (n.points * (1 - density(n)), n.depth))
    up, article = best, None
    while up is not None:
        if up.tag == "article":
            article = up
        up = up.parent
    if article is not None:
        return [article]
    if best.parent is None:
        return [best]
    least = max(0.2 * best.points * (1 - density(best)), 1e-9)
    return [x for x in best.parent.children if not isinstance(x, str) and not x.dropped and x.length
            and (x is best or x.points * (1 - density(x)) >= least
                 or x.tag in HEADINGS or (x.tag in ("p", "blockquote", "pre", "header") and density(x) < 0.5))]


def block_texts(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below ``nodes`` in page order, character references decoded, white space made single."""
    out: list[str] = []
    parts: list[str] = []

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(text)
            parts.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is None:
            end_block()
        elif not x.dropped:
            if x.tag in ("ul", "ol", "table") and x.length and density(x) > 0.7:
                continue        # a list of links inside the article is a menu
            if x.tag in BLOCK:
                end_block()
                stack.append(None)
            stack.extend(reversed(x.children))
    end_block()
    return out


def main_text(page: str | None) -> str:
    return " ".join(block_texts(main_nodes(parse(page)))) if page else ""


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars (code points) of every page."""
    @F.pandas_udf("string")
    def texts(batch: pd.Series) -> pd.Series:
        return batch.map(main_text, na_action=None)

    rows = only(pages, _key=key, _url=url, _page=page).select("_key", "_url", texts("_page").alias("_text"))
    return rows.select(F.col("_key").alias(key), F.col("_url").alias("url"), F.col("_text").alias("text"),
                       F.length("_text").cast("long").alias("n_chars"))
