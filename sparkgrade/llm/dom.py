"""Elements and text blocks of web pages, as flat lists for numpy.

A page becomes nodes (its block elements, in document order) and blocks (the text between two
block boundaries, which belongs to one node). Inline elements only mark links. The tree is
built as browsers do where it matters for text: elements without an end, implied ends of
paragraphs, items and cells, stray ends, raw text and comments.
"""

from __future__ import annotations

import functools
import html
import re

#: Fixed values of HTML. Elements that never have content; whose content is no text of the page; that stand in a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button title datalist".split())
RAW = frozenset("script style iframe textarea title noscript".split())
BLOCKS = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary "
    "table caption thead tbody tfoot tr td th ul".split()
)
#: A start of the key ends an open element of the value, up to a boundary.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th"), "thead": ("tr", "td", "th")}
_BOUNDARY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)} | dict.fromkeys(("tr", "td", "th", "tbody", "tfoot", "thead"), ("table",))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Words of class, id, role and similar attributes, by what they usually name.
TOKENS = {
    "main": "article content post entry story body main text articlebody blogpost prose copy",
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs pagination pager toc tabs navlinks",
    "header": "header masthead banner topbar logo brand",
    "footer": "footer colophon copyright legal bottom contentinfo",
    "side": "sidebar side aside widget widgets rail secondary complementary",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay toast privacy announcement",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion adsense adbox",
    "form": "form login signin signup subscribe subscription newsletter search contact register",
    "comment": "comment comments reply replies respond discuss discussion disqus thread responses",
    "share": "share sharing social follow like tweet",
    "related": "related recommend recommended recommendations more popular trending teaser teasers",
    "hidden": "hidden invisible none",
}
GROUPS = tuple(TOKENS)
_GROUP_OF = {word: 1 << k for k, words in enumerate(TOKENS.values()) for word in words.split()}

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Where training pages say what a node is.
MARK = "data-sparkgrade"


@functools.lru_cache(1 << 14)
def _attributes(text: str) -> tuple[int, str]:
    """The token groups of an element's attributes as bits, and its mark in training pages."""
    bits, mark = 0, ""
    for name, value in _ATTRIBUTE.findall(text):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for word in _WORDS.findall(value):
                bits |= _GROUP_OF.get(word.lower(), 0)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            bits |= _GROUP_OF["hidden"]
        elif name == MARK:
            mark = value
    return bits, mark


class Nodes:
    """The nodes and blocks of many pages. A node's parent stands before it; -1: none."""

    def __init__(self) -> None:
        self.pages: list[int] = []
        self.parents: list[int] = []
        self.depths: list[int] = []
        self.tags: list[str] = []
        self.bits: list[int] = []
        self.marks: list[str] = []
        self.block_nodes: list[int] = []
        self.block_texts: list[str] = []
        self.block_links: list[int] = []

    def add(self, page: int, text: str | None) -> None:
        """Parses one page. Null: as empty. Every page has a root node, even an empty one."""
        _Page(self, page).read(text or "")

    def node(self, page: int, parent: int, depth: int, tag: str, bits: int, mark: str) -> int:
        self.pages.append(page)
        self.parents.append(parent)
        self.depths.append(depth)
        self.tags.append(tag)
        self.bits.append(bits)
        self.marks.append(mark)
        return len(self.pages) - 1


class _Page:
    def __init__(self, out: Nodes, page: int) -> None:
        self.out, self.page = out, page
        root = out.node(page, -1, 0, "#root", 0, "")
        #: Open elements: name and node; inline elements have the node that they stand in.
        self.names, self.nodes = ["#root"], [root]
        self.open: dict[str, int] = {}
        self.runs: list[str] = []
        self.linked = 0

    def boundary(self) -> None:
        """Ends the block."""
        if self.runs:
            text = " ".join("".join(self.runs).split())
            if text:
                self.out.block_nodes.append(self.nodes[-1])
                self.out.block_texts.append(text)
                self.out.block_links.append(min(self.linked, len(text)))
            self.runs, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            self.runs.append(raw)
            if self.open.get("a"):
                self.linked += len(raw.strip())

    def pop(self, to: int) -> None:
        """Closes the open elements from a place of the stack on."""
        if any(n in BLOCKS for n in self.names[to:]):
            self.boundary()
        for name in self.names[to:]:
            self.open[name] -= 1
        del self.names[to:], self.nodes[to:]

    def close(self, wanted: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """Closes the outermost open element of the wanted names within the innermost one of stop."""
        if not any(self.open.get(n) for n in wanted):
            return
        found = 0
        for k in range(len(self.names) - 1, 0, -1):
            if self.names[k] in stop:
                break
            if self.names[k] in wanted:
                found = k
                if not stop:
                    break
        if found:
            self.pop(found)

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS or name == "hr":
            if name != "html" and name != "body":
                self.close(("p",))
            if name in _CLOSES:
                self.close(_CLOSES[name], _BOUNDARY[name])
            elif name in _HEADINGS and self.names[-1] in _HEADINGS:
                self.pop(len(self.names) - 1)
            self.boundary()
        if name == "br":
            self.runs.append(" ")
        if name in VOID:
            return
        if name in BLOCKS:
            bits, mark = _attributes(attributes)
            node = self.out.node(self.page, self.nodes[-1], self.out.depths[self.nodes[-1]] + 1, name, bits, mark)
        else:
            node = self.nodes[-1]
        self.names.append(name)
        self.nodes.append(node)
        self.open[name] = self.open.get(name, 0) + 1

    def end(self, name: str) -> None:
        if name == "br":
            self.runs.append(" ")
        if not self.open.get(name):
            return
        for k in range(len(self.names) - 1, 0, -1):
            if self.names[k] == name:
                self.pop(k)
                return
            if name not in BLOCKS and self.names[k] in BLOCKS:  # an inline end doesn't close a block
                return

    def dropped(self, text: str, name: str, at: int) -> int:
        """The place behind an element whose content isn't text: behind its own end, or at the end of the page."""
        depth, pattern = 1, _ends(name)
        while depth and (m := pattern.search(text, at)):
            at = m.end()
            depth += -1 if m[1] else 0 if name in RAW else 1
        return at if not depth else len(text)

    def read(self, text: str) -> None:
        at = 0
        while True:
            found = text.find("<", at)
            if found < 0:
                break
            m = _TAG.match(text, found)
            if not m:  # not a tag
                self.text(text[at : found + 1])
                at = found + 1
                continue
            self.text(text[at:found])
            at = m.end()
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self.end(name)
                elif name in DROPPED:
                    at = self.head(text, at) if name == "head" else self.dropped(text, name, at)
                else:
                    self.start(name, m[3])
        self.text(text[at:])
        self.boundary()

    @staticmethod
    def head(text: str, at: int) -> int:
        """The place behind a head: at its end, at a body, or right here if there is neither."""
        m = _HEAD.search(text, at)
        return at if not m else m.end() if m[1] else m.start()


_HEAD = re.compile(r"<(?:(/)head\b[^>]*>|body\b)", re.I)


@functools.cache
def _ends(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){name}\b[^>]*>", re.I)
