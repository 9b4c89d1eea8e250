"""HTML as a small tree of blocks with features per node; plain Python, used inside tasks."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

# Fixed tag sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title iframe svg math object canvas "
                   "textarea select option button datalist audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
                  "nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# What may stand in head; any other start tag, or text, ends a head left open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag of the key ends an open element of the values (end tags that HTML lets one leave out).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}}
# An open element of CLOSES is looked for up to these.
_NOT_P = BLOCK - {"p"}
FENCE = frozenset("ul ol menu dl table tbody thead tfoot body div section article".split())

# Words of class, id, role and aria-label, and tags, by what they usually mark.
MARKS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pagination pager toc",
    "head": "header masthead topbar logo branding hero",
    "foot": "footer copyright legal colophon contentinfo",
    "side": "sidebar aside widget widgets rail related recommended popular trending complementary more teaser",
    "note": "cookie cookies notice alert consent gdpr popup modal overlay newsletter subscribe warning "
            "banner paywall dialog disclaimer",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored adsense promo promotion",
    "form": "form search searchbox login signup signin register contact poll",
    "talk": "comment comments reply replies disqus discussion respond response responses thread reviews",
    "share": "share sharing social tweet follow buttons",
    "main": "article content main post entry story body text articlebody maincontent blog",
    "title": "title headline heading subtitle",
}
KINDS = list(MARKS)
_MARK_OF = {w: i for i, k in enumerate(KINDS) for w in MARKS[k].split()}
_TAG_MARK = {"nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "side", "dialog": "note",
             "form": "form", "fieldset": "form", "article": "main", "main": "main"}
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "children", "marks", "start", "chars", "link", "punct", "tags",
                 "pieces", "words", "own")

    def __init__(self, tag, parent, depth, marks, start):
        self.tag, self.parent, self.depth, self.marks, self.start = tag, parent, depth, marks, start
        self.children, self.chars, self.link, self.punct, self.tags = [], 0, 0, 0, 0
        self.pieces, self.words, self.own = 0, 0, 0


class Page(HTMLParser):
    """Nodes of a page, and its text pieces (node, block, text) in page order.

    Nodes are block elements, and inline elements with a class, id or role.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#", -1, 0, 0, 0)]
        self.pieces: list[tuple[int, int, str]] = []
        self.open: list[tuple[str, int]] = [("#", 0)]     # (tag, its node or that around it)
        self.n_open = Counter()                           # open elements by tag
        self.silent, self.links, self.block, self.at = 0, 0, 0, 0
        self.feed(html)
        self.close()
        self._sum()

    def handle_starttag(self, tag, attrs):
        if tag == "body" or self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop("head", frozenset())
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            self.block += tag == "hr"
            return
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCK:
            self.block += 1
            self._pop("p", _NOT_P)       # a block ends an open paragraph
            for old in CLOSES.get(tag, ()):
                self._pop(old, FENCE)
        self.links += tag == "a"
        at = self.open[-1][1]
        named = [v for k, v in attrs if k in ("class", "id", "role", "aria-label") and v]
        if tag in BLOCK or named and tag not in SILENT and tag != "a":
            marks = 0
            for word in _TOKEN.findall(" ".join(named)):
                kind = _MARK_OF.get(word.lower())
                if kind is not None:
                    marks |= 1 << kind
            if tag in _TAG_MARK:
                marks |= 1 << KINDS.index(_TAG_MARK[tag])
            parent = self.nodes[at]
            node = Node(tag, at, parent.depth + 1, marks, self.at)
            parent.children.append(len(self.nodes))
            self.nodes.append(node)
            at = len(self.nodes) - 1
        self.nodes[at].tags += 1
        self.open.append((tag, at))
        self.n_open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self.block += tag in BLOCK
            self._pop(tag, frozenset())

    def _pop(self, tag, fence) -> None:
        """Close the innermost open `tag` and all inside it, unless an element of `fence` is between."""
        if not self.n_open[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                for t, _ in self.open[i:]:
                    self.n_open[t] -= 1
                    self.silent -= t in SILENT
                    self.links -= t == "a"
                del self.open[i:]
                return
            if self.open[i][0] in fence:
                return

    def handle_data(self, data):
        self._text(data)

    def _text(self, data):
        if self.open[-1][0] == "head" and data.strip():
            self._pop("head", frozenset())
        if self.silent or not data:
            return
        at = self.open[-1][1]
        if at == 0 and not data.strip():
            return
        self.pieces.append((at, self.block, data))
        n, node = len(data.strip()), self.nodes[at]
        if n:
            node.own += n
            node.chars += n
            node.words += data.count(" ") + 1
            node.link += n if self.links else 0
            node.punct += data.count(".") + data.count(",") + data.count("?") + data.count("!")
            node.pieces += 1
            self.at += n

    def _sum(self):
        for node in reversed(self.nodes[1:]):             # children come after their parents
            up = self.nodes[node.parent]
            up.chars += node.chars
            up.link += node.link
            up.punct += node.punct
            up.tags += node.tags
            up.pieces += node.pieces
            up.words += node.words

    def features(self) -> list[list[float]]:
        """One row per node: subtree density, attribute tokens, depth, place and siblings."""
        nodes, total = self.nodes, max(1, self.nodes[0].chars)
        above = [0] * len(nodes)                           # marks of all ancestors
        # Of each node's children, once: the most characters, how many per tag, how many are links.
        most_of = [max((nodes[c].chars for c in n.children), default=0) for n in nodes]
        tags_of = [Counter(nodes[c].tag for c in n.children) for n in nodes]
        links_of = [sum(nodes[c].link > 0.5 * nodes[c].chars for c in n.children) for n in nodes]
        out = []
        for i, node in enumerate(nodes):
            up = nodes[node.parent] if i else node
            if i:
                above[i] = above[node.parent] | up.marks
            chars, kids = node.chars, up.children
            most = most_of[node.parent] if i else chars
            same = tags_of[node.parent][node.tag] if i else 1
            linked = links_of[node.parent] if i else 0
            row = [chars, chars / total, node.link / max(1, chars), chars / (1 + node.tags), node.punct / max(1, node.words),
                   chars / max(1, node.pieces), node.words, node.tags, len(node.children), node.depth,
                   node.start / total, (node.start + chars) / total, node.own / max(1, chars),
                   len(kids) if i else 1, chars / max(1, up.chars), chars / max(1, most), same / max(1, len(kids)),
                   linked / max(1, len(kids)), up.link / max(1, up.chars), up.chars / total,
                   node.tag == "p", node.tag in HEADING, node.tag == "li", node.tag in ("td", "th", "tr", "table"),
                   node.tag in ("div", "section"), node.tag in ("ul", "ol", "dl"), up.tag in ("div", "section", "body"),
                   up.tag == "li"]
            row += [float(node.marks >> k & 1) for k in range(len(KINDS))]
            row += [float(above[i] >> k & 1) for k in range(len(KINDS))]
            out.append(row)
        return out

    def text(self, kept: list[bool]) -> str:
        """Kept pieces: white space inside a block as one space, blocks joined by one space."""
        blocks, last = [], None
        for at, block, data in self.pieces:
            if kept[at]:
                if block != last:
                    blocks.append([])
                    last = block
                blocks[-1].append(data)
        parts = (" ".join("".join(b).split()) for b in blocks)
        return " ".join(p for p in parts if p)


N_FEATURES = 28 + 2 * len(KINDS)
