"""A small tolerant reader of HTML: a tree of elements and text, enough for main-text extraction."""

from __future__ import annotations

import hashlib
import re

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset("""html body head article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th
caption figure figcaption hr address details summary header footer nav aside form fieldset legend menu dialog center hgroup search""".split())
ENDS_P = BLOCK - frozenset("html body head li dt dd thead tbody tfoot tr td th caption legend summary figcaption".split()) | frozenset(["li", "dt", "dd"])
#: A start tag closes an open element of these names, up to one of the second ones.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)),
}
_TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>=]++|=)*+)(>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list["Node | str"] = []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(self.attrs)} if self.attrs else {}

    def walk(self):
        """This element and all below, in page order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if not isinstance(c, str)]


def parse(html: str) -> Node:
    """The tree of a page. Unclosed, stray and crossing tags are mended as browsers do in
    the plain cases; a tag cut off by the end of the page is dropped."""
    root = top = Node("#page", "", None)
    at = 0
    end = len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            top.children.append(html[at:])
            break
        if m.start() > at:
            top.children.append(html[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None or not m[4]:
            continue
        name = name.lower()
        if m[1]:
            n = top
            while n.parent is not None and n.tag != name:
                if name not in BLOCK and n.tag in BLOCK:
                    n = root
                    break
                n = n.parent
            if n.parent is not None:
                top = n.parent
            continue
        if name in ENDS_P:
            top = _close(top, ("p",), ("article", "main", "section", "div", "td", "th", "body", "blockquote", "li", "aside", "form", "header", "footer", "nav"))
        if name in CLOSES:
            top = _close(top, *CLOSES[name])
        node = Node(name, m[3], top)
        top.children.append(node)
        if name in VOID or m[3].endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            node.children.append(html[at:stop.start() if stop else end])
            at = stop.end() if stop else end
            continue
        top = node
    return root


def _close(top: Node, names: tuple, within: tuple) -> Node:
    n = found = top
    out = top
    while n is not None and n.tag not in within:
        if n.tag in names:
            found, out = n, n.parent
        n = n.parent
    return out if found.tag in names else top


def subtree_hashes(top: Node) -> dict[int, int]:
    """id(element) -> 64-bit hash of its name, attributes, text and children."""
    out: dict[int, int] = {}
    for n in reversed(list(top.walk())):
        parts = [n.tag, n.attrs]
        parts += [" ".join(c.split()) if isinstance(c, str) else f"\x02{out[id(c)]:x}" for c in n.children]
        h = hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8)
        out[id(n)] = int.from_bytes(h.digest(), "little", signed=True)
    return out
