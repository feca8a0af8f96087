"""Small, forgiving reading of HTML into a tree: nodes in page order, and the text that stands directly in each."""

from __future__ import annotations

import html
import re

PARAGRAPH = {"p", "#text"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr ins del big acronym nobr".split())
#: An opening tag of the left closes an open element of the right, unless one of SCOPE is between.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
SCOPE = frozenset("table ul ol dl select div article section aside main nav header footer form body html blockquote figure".split())
#: A quote that nothing closes belongs to its tag, which ends at the next `>`.
_INSIDE = r"""(?>[^>"']+|"[^"<]*"|"[^"]*"(?=\s|/?>)|'[^'<]*'|'[^']*'(?=\s|/?>)|["'])*+"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Tree:
    """parent, tag, attrs of each node (0 is the page); text: (node, string) in page order; None for a break of line.

    Text that stands in no element opens one, `#text`, that ends as a paragraph does.

    Open elements are counted by name, for the page and inside the innermost element of SCOPE, so that a tag that closes
    nothing costs one look: reading takes time in proportion to the page.
    """

    __slots__ = ("_frames", "_open", "_stack", "attrs", "parent", "tag", "text")

    def __init__(self, page: str):
        self.parent, self.tag, self.attrs = [-1], ["#page"], [""]
        self.text: list[tuple[int, str | None]] = []
        self._stack, self._open, self._frames = [0], {}, [{}]
        at, end = 0, len(page)
        while at < end:
            m = TOKEN.search(page, at)
            if m is None:
                self._add(self._stack[-1], page[at:])
                break
            if m.start() > at:
                self._add(self._stack[-1], page[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if (self._frames[-1] if name in INLINE else self._open).get(name):
                    self._pop({name})
                continue
            if name not in INLINE and name not in VOID or name == "hr":
                self._close(PARAGRAPH)
            if name in CLOSES:
                self._close(CLOSES[name])
            if name == "br":
                self.text.append((self._stack[-1], None))
                continue
            self.parent.append(self._stack[-1])
            self.tag.append(name)
            self.attrs.append(m[3])
            if name in VOID or m[3].endswith("/") and name not in RAW and name not in SCOPE and name not in INLINE and name != "p":
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                body = page[at : close.start()] if close else page[at:]
                if name == "textarea" or name == "title":
                    self._add(len(self.tag) - 1, body)
                at = close.end() if close else end
                continue
            self._stack.append(len(self.tag) - 1)
            self._open[name] = self._open.get(name, 0) + 1
            if name in SCOPE:
                self._frames.append({})
            else:
                self._frames[-1][name] = self._frames[-1].get(name, 0) + 1
        del self._stack, self._open, self._frames

    def _add(self, node: int, s: str) -> None:
        if not node and not s.isspace():
            node = len(self.tag)
            self.parent.append(0)
            self.tag.append("#text")
            self.attrs.append("")
            self._stack.append(node)
            self._open["#text"] = self._open.get("#text", 0) + 1
            self._frames[-1]["#text"] = self._frames[-1].get("#text", 0) + 1
        self.text.append((node, html.unescape(s) if "&" in s else s))

    def _pop(self, names: set[str]) -> None:
        """Close open elements up to the first of these names, which is known to be open."""
        while True:
            name = self.tag[self._stack.pop()]
            self._open[name] -= 1
            if name in SCOPE:
                self._frames.pop()
            else:
                self._frames[-1][name] -= 1
            if name in names:
                return

    def _close(self, names: set[str]) -> None:
        if any(self._frames[-1].get(n) for n in names):
            self._pop(names)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw else {}
