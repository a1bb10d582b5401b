"""Main text of web pages by composite text density.

A page becomes a tree of its block elements. Parts that are never main text (navigation, page headers
and footers, side bars, scripts, styles) are cut by their tags. Forms and what roles, classes and ids call a
notice, an advert, a side bar or reader comments are cut too, but not where such an element holds the
article or most of the text, as layouts are named after their parts ("layout-with-sidebar"); `kept` decides
that on the whole tree, and where everything would go, nothing of this kind does. On the rest, each node's density is its characters per tag, adjusted by
its links against those of the whole body; the node with the largest sum of its children's densities
is the centre. The smallest density on the way from the body to it is the threshold: from the body
down, each node that reaches it gives the subtree with the largest sum, widened to the article
around it. The blocks of the chosen subtrees, in page order, are the text.

Pages are independent, so each is parsed within one task and nothing is shuffled. Edge cases: null and
empty pages give an empty text; a page without tags is one block; broken mark-up closes at its
parent's end; equal sums go to the node that comes first, the outer one before the inner; repeated
rows are parsed each on their own; a page of any length is parsed whole; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tablecloak.llm.common import ship

#: Elements by what they do.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "hgroup", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
         "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CUT = {"aside", "button", "canvas", "dialog", "footer", "head", "input", "menu", "nav", "object",
       "option", "select", "svg", "video", "audio", "map", "math", *RAW}
SOFT_CUT = {"form", "fieldset"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert",
             "alertdialog", "status", "toolbar"}
CUT_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "banner",
             "promo", "promotion", "sidebar", "side-bar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb",
             "breadcrumbs", "footer", "masthead", "site-header", "page-header", "topbar", "cookie", "cookies",
             "consent", "gdpr", "notice", "disclaimer", "comment", "comments", "commentlist", "disqus", "replies",
             "respond", "reply", "related", "recommended", "share", "sharing", "social", "subscribe", "newsletter",
             "popup", "modal", "overlay", "pagination", "pager", "widget", "toolbar", "search", "login", "signup"}
#: Those of them that tell of reader comments, which may be longer than the article.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "reply"}
MAIN = ("article", "main")
#: Times the text outside that an element named like a part to cut must hold to stay, without and with an article around.
BULK, BULK_INSIDE = 2, 4
FIRM, SOFT, COMMENT = 0, 1, 2
#: Names that begin so tell how a page is laid out ("has-sidebar").
LAYOUT = {"has", "no", "with", "without"}
#: A start tag closes open elements of these kinds, up to the nearest of SCOPE.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
          "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"article", "aside", "body", "div", "section", "main", "table", "ul", "ol", "dl", "blockquote", "footer", "header",
         "nav", "form", "figure"}
#: A quote counts only after "=", as in browsers; possessive, so that no broken tag is tried twice.
TAG = re.compile(r"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*+(?:>|\Z)"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "best",
                 "marked", "soft")

    def __init__(self, tag: str, parent: "Node | None", soft: int = FIRM):
        self.tag, self.parent, self.children, self.soft = tag, parent, [], soft
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best = self
        self.marked = False


def cut_kind(tag: str, attributes: str, inside_main: bool) -> int | None:
    """None for a part that always goes, SOFT or COMMENT for one that goes by its name, else FIRM."""
    if tag in CUT or (tag == "header" and not inside_main):
        return None
    kind = SOFT if tag in SOFT_CUT else FIRM
    for name, *value in ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = "".join(value).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return None
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return None
        if name == "role" and value in CUT_ROLES:
            kind = max(kind, SOFT)
        if name in ("class", "id") and tag not in ("html", "body", *MAIN):
            for part in value.split():
                words = re.split(r"[-_]", part)
                if words[0] not in LAYOUT and (part in CUT_NAMES or any(w in CUT_NAMES for w in words)):
                    kind = max(kind, COMMENT if COMMENTS.intersection(words) else SOFT)
    return kind


class Tree:
    """Block nodes of a page; a child is a node or a run of text as (text, is_link)."""

    def __init__(self, page: str):
        self.root = self.at = Node("body", None)
        self.open = []  # (tag, node before, in a cut part before, in a link before)
        self.count = Counter()  # open elements by tag
        self.cut, self.link, self.named = False, False, False
        end = 0
        while m := TAG.search(page, end):
            if m.start() > end:
                self.text(page[end:m.start()])
            if m.end() == len(page) and page[-1] != ">" and not page.startswith("<!--", m.start()):
                end = m.start()  # a tag without an end is text
                break
            end = m.end()
            closing, tag, attributes = m[1], m[2], m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self.close(tag)
            elif tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, end)
                stop_end = page.find(">", stop.start()) if stop else -1
                end = len(page) if stop_end < 0 else stop_end + 1
            else:
                self.start(tag, attributes)
        if end < len(page):
            self.text(page[end:])

    def text(self, raw: str) -> None:
        if not self.cut:
            self.at.children.append((raw, self.link))

    def start(self, tag: str, attributes: str) -> None:
        if tag == "body" or tag in BLOCK:
            self.close("head")
        if tag in ("html", "body"):
            return
        if tag in VOID:
            if tag in ("br", "hr") and not self.cut:
                self.at.children.append((" ", self.link))
            return
        if tag in BLOCK:
            self.close_open({"p"} | CLOSES.get(tag, set()))
        elif tag in CLOSES:
            self.close_open(CLOSES[tag])
        self.open.append((tag, self.at, self.cut, self.link))
        self.count[tag] += 1
        if not self.cut:
            kind = cut_kind(tag, attributes, self.count["article"] + self.count["main"] > 0)
            self.cut = kind is None or kind != FIRM and tag not in BLOCK
        if tag == "a":
            self.link = True
        if tag in BLOCK and not self.cut:
            node = Node(tag, self.at, kind)
            self.at.children.append(node)
            self.named = self.named or kind != FIRM
            self.at = node
        if attributes and attributes.rstrip().endswith("/") and tag not in BLOCK:
            self.pop()

    def pop(self) -> None:
        tag, self.at, self.cut, self.link = self.open.pop()
        self.count[tag] -= 1

    def close_open(self, tags: set) -> None:
        """Close the nearest open element of the kinds within the nearest scope."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.open[k][0]
            if tag in tags:
                while len(self.open) > k:
                    self.pop()
                return
            if tag in SCOPE or tag in ("td", "th", "li", "dd") and tag not in tags:
                return

    def close(self, tag: str) -> None:
        if not self.count[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self.pop()
                return
            if tag not in BLOCK and self.open[k][0] in BLOCK:
                return


def clean(raw: str) -> str:
    return entities.unescape(raw) if "&" in raw else raw


def in_order(root: Node) -> list[Node]:
    """Nodes, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def kept(nodes: list[Node]) -> set[Node]:
    """Of the elements with a name of a part to cut, those that hold the article or most of the text, and the ones
    around them."""
    holder, room = {}, {}  # the nearest named element, and the outermost article, that a node is in
    readers = set()  # nodes among reader comments
    free, links, size = Counter(), Counter(), Counter()  # characters of holders outside and in links, and of articles
    for node in nodes:  # parents come first
        up = node.parent
        holder[node] = node if node.soft else holder.get(up)
        room[node] = room.get(up) or (node if node.tag in MAIN else None)
        if node.soft == COMMENT or up in readers:
            readers.add(node)
        for child in node.children:
            if not isinstance(child, Node):
                n = len(BLANK.sub(" ", clean(child[0])).strip())
                (links if child[1] else free)[holder[node]] += n
                if room[node] is not None and holder[node] is holder[room[node]] and not child[1]:
                    size[room[node]] += n

    named = [n for n in nodes if n.soft and n not in readers and free[n] > links[n]]
    firm = max((n for n in size if holder[n] is None), key=lambda n: size[n], default=None)
    if firm is not None:
        inside = max((n for n in named if room[n] is firm), key=lambda n: free[n], default=None)
        chosen = inside if inside is not None and free[inside] >= BULK_INSIDE * size[firm] else None
    else:
        chosen = max((n for n in size if n not in readers), key=lambda n: size[n], default=None)
        if chosen is None:
            heavy = max(named, key=lambda n: free[n], default=None)
            chosen = heavy if heavy is not None and free[heavy] >= BULK * free[None] else None
    out = set()
    while chosen is not None:
        out |= {chosen} if chosen.soft else set()
        chosen = chosen.parent
    if not any(free[h] + links[h] for h in (None, *out)):
        out = {n for n in nodes if n.soft and n not in readers}
        if not any(free[h] + links[h] for h in out):
            out = {n for n in nodes if n.soft}
    return out


def drop_named(nodes: list[Node]) -> list[Node]:
    """The nodes that stay once named parts are cut."""
    stay = kept(nodes)
    for parent in {n.parent for n in nodes if n.soft and n not in stay}:
        parent.children = [c for c in parent.children if not isinstance(c, Node) or not c.soft or c in stay]
    return in_order(nodes[0])


def weigh(nodes: list[Node]) -> None:
    """Characters, tags and links of each subtree, then densities and sums of densities."""
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, Node):
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
            else:
                size = len(BLANK.sub(" ", clean(child[0])).strip())
                node.chars += size
                if child[1] and size:
                    node.link_chars += size
                    node.link_tags += 1
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0

    def density(chars: int, tags: int, links: int, link_tags: int) -> float:
        if not chars:
            return 0.0
        tags, free = max(tags + link_tags, 1), max(chars - links, 1)
        base = math.log(chars * links / free + share * chars + math.e)
        gain = math.log(max(chars / max(links, 1) * tags / max(link_tags, 1), 1.0)) / math.log(max(base, 1.0001) + 1)
        return chars / tags * (1.0 + gain) if links < chars else 0.0

    for node in nodes:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags)
    for node in reversed(nodes):
        own = links = runs = 0
        inside = []
        for child in node.children:
            if isinstance(child, Node):
                node.total += child.density
                inside.append(child.best)
            else:
                size = len(child[0].strip())
                own, links, runs = own + size, links + size * child[1], runs + (child[1] and size > 0)
        node.total += density(own, 1, links, runs)
        node.best = max((node, *inside), key=lambda n: n.total)


def mark(nodes: list[Node]) -> None:
    """Mark the subtrees of main text."""
    best = nodes[0].best
    if not best.chars:
        return
    threshold, node = best.density, best
    while node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    article(best).marked = True
    for node in nodes:  # parents come first
        if node.parent is not None and node.parent.marked:
            node.marked = True
        elif not node.marked and node.chars and node.density >= threshold and node.best.total:
            if not node.best.marked:
                node.best.marked = article(node.best).marked = True


def article(node: Node) -> Node:
    """The article (else the main element) around a node; without one the node itself."""
    for tag in ("article", "main"):
        found, at = None, node
        while at is not None:
            found, at = (at if at.tag == tag else found), at.parent
        if found is not None:
            return found
    return node


def blocks(root: Node) -> list[str]:
    """Blocks of the marked subtrees in page order: runs of text between borders of block elements."""
    out, run = [], []

    def end_run() -> None:
        text = BLANK.sub(" ", clean("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list = [(root, root.marked)]
    while stack:
        item, chosen = stack.pop()
        if item is None:
            end_run()
        elif isinstance(item, Node):
            end_run()
            chosen = chosen or item.marked
            stack.append((None, False))
            stack.extend((c, chosen) for c in reversed(item.children))
        elif chosen:
            run.append(item[0])
    end_run()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    nodes = in_order(tree.root)
    if tree.named:
        nodes = drop_named(nodes)
    weigh(nodes)
    mark(nodes)
    return "\n\n".join(blocks(tree.root))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """`key, url, text, n_chars` of every page."""
    ship(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.select(key, url).schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablecloak.llm import html_text

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [html_text.main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(x) for x in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, html).mapInArrow(
        run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")
