"""HTML pages as trees of blocks, read in linear time: tags, attributes, omitted end tags, character references.

Reading never fails. A tag that never ends is text, an attribute quote that never ends is a plain character, an open script,
style, title or textarea takes the rest of the page, and elements nested deeper than DEEPEST belong to the last one counted.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

DEEPEST = 512
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
TAG_END = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
# HTML's element kinds
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object"}
TO_THE_END = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEAD = {"head", "html", "meta", "link", "base", "basefont", "bgsound"}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "table", "tbody", "tr", "td", "center", "figure", "ul", "ol", "dl", "blockquote"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "dd", "dt", "th", "hr", "header", "footer", "nav", "aside", "form", "fieldset", "address", "figcaption", "thead", "tfoot", "caption", "details", "summary", "head", "option", "select", "dialog", "menu", "legend", "label", "hgroup", "search", "button"}
IMPLIED_END = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "select"}


@dataclass
class Element:
    tag: str
    parent: int
    classes: tuple[str, ...] = ()
    words: frozenset[str] = frozenset()
    hidden: bool = False


@dataclass
class Block:
    """Text between two block boundaries: its element, its words joined by single spaces, and how much of it is in links."""

    at: int
    text: str
    linked: int
    links: int


def attributes(text: str) -> dict[str, str]:
    """Attribute values by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def name_words(token: str) -> list[str]:
    """Lower-case words of a class, id or role: ``mainMenu-2`` gives main, menu."""
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())


@dataclass
class Tree:
    """Elements in page order (the first is the page itself) and blocks in page order."""

    elements: list[Element] = field(default_factory=lambda: [Element("", -1)])
    blocks: list[Block] = field(default_factory=list)


class Reader:
    def __init__(self, text: str):
        self.tree = Tree()
        self._stack = [0]
        self._open = Counter()  # tags on the stack
        self._deeper = Counter()  # tags nested too deep to be on it
        self._buffer: list[str] = []
        self._linked = self._links = 0
        self._link_at = 0  # stack size where a link is open, 0: none
        self._hidden_at = 0  # stack size where a hidden inline element is open, 0: none
        self._read(text)

    def _top(self) -> str:
        return self.tree.elements[self._stack[-1]].tag

    def _flush(self) -> None:
        if self._buffer:
            words = " ".join(html.unescape("".join(self._buffer)).split())
            if words:
                self.tree.blocks.append(Block(self._stack[-1], words, min(self._linked, len(words)), self._links))
            self._buffer = []
        self._linked = self._links = 0

    def _text(self, part: str) -> None:
        if part and not self._hidden_at:
            if self._open["head"] and not part.isspace():
                self._pop_to("head")
            self._buffer.append(part)
            if self._link_at:
                self._linked += len(part.strip())

    def _cut(self, size: int) -> None:
        for at in self._stack[size:]:
            self._open[self.tree.elements[at].tag] -= 1
        del self._stack[size:]
        if self._link_at > size:
            self._link_at = 0
        if self._hidden_at > size:
            self._hidden_at = 0

    def _pop_to(self, tag: str, scopes: frozenset | set = frozenset()) -> None:
        """Close the nearest open ``tag`` and all in it, unless a scope lies between."""
        if self._open[tag]:
            for i in range(len(self._stack) - 1, 0, -1):
                name = self.tree.elements[self._stack[i]].tag
                if name == tag:
                    return self._cut(i)
                if name in scopes:
                    return None
        return None

    def _start(self, tag: str, attrs: str) -> None:
        if self._open["head"] and tag not in HEAD:
            self._pop_to("head")
        if tag == "a":
            self._links += 1
            self._link_at = len(self._stack)
            return
        found = attributes(attrs) if attrs else {}
        style = re.sub(r"\s", "", found.get("style", "")).lower()
        hidden = "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        block = tag in BLOCKS
        if block:
            self._flush()
            for other in IMPLIED_END.get(tag, ()):
                self._pop_to(other, SCOPES)
            if tag != "option":
                self._pop_to("p", SCOPES)
        elif tag == "br":
            self._buffer.append(" ")
        if tag in VOID or not block and not hidden and not self._open[tag]:
            return  # an inline element matters only where it is hidden, or stands in a hidden one of its kind
        if tag in ("html", "body") and self._open[tag]:
            return
        if len(self._stack) > DEEPEST:
            self._deeper[tag] += 1
            return
        named = [w for c in ("class", "id", "role") for t in found.get(c, "").split() for w in [tuple(name_words(t))] if w]
        words = frozenset(w for token in named if not {"has", "no", "with", "without", "is", "open", "enabled"} & set(token) for w in token)
        classes = tuple(sorted({re.sub(r"\d+", "#", c.lower()) for c in found.get("class", "").split()}))
        self.tree.elements.append(Element(tag, self._stack[-1], classes, words, hidden))
        self._stack.append(len(self.tree.elements) - 1)
        self._open[tag] += 1
        if hidden and not block and not self._hidden_at:
            self._hidden_at = len(self._stack)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link_at = 0
            return
        if tag in BLOCKS:
            self._flush()
        if self._deeper[tag]:
            self._deeper[tag] -= 1
        elif tag in BLOCKS:
            self._pop_to(tag)
        else:
            self._pop_to(tag, BLOCKS)  # an inline end never closes a block

    def _read(self, text: str) -> None:
        at, said, quotes, never = 0, 0, True, set()
        while (at := text.find("<", at)) >= 0:
            kind = text[at + 1 : at + 2]
            if kind in ("!", "?"):
                self._text(text[said:at])
                start, stop = ("<!--", "-->") if text.startswith("<!--", at) else ("<![CDATA[", "]]>") if text.startswith("<![CDATA[", at) else ("<", ">")
                found = text.find(stop, at + len(start))
                at = said = len(text) if found < 0 else found + len(stop)
                continue
            tag = TAG.match(text, at)
            if not tag:
                at += 1
                continue
            end = TAG_END.match(text, tag.end()) if quotes else None
            stop = end.end() if end else text.find(">", tag.end()) + 1
            if not end:
                quotes = False  # an open quote reaches the end of the page: from here on quotes mean nothing
            if not stop:
                break  # no tag ends any more
            self._text(text[said:at])
            name, attrs = tag[2].lower(), text[tag.end() : stop - 1]
            at = said = stop
            if tag[1]:
                self._end(name)
            elif name in RAW:
                if name not in never and not attrs.endswith("/"):
                    found = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(text, at)
                    if found:
                        at = said = found.end()
                    elif name in TO_THE_END:
                        at = said = len(text)
                    else:
                        never.add(name)
            else:
                self._start(name, attrs)
        self._text(text[said:])
        self._flush()


def read(text: str) -> Tree:
    return Reader(text).tree
