"""Visible text of a page in order of depth.

The text nodes of the document tree are read level by level. Within a level
they stand in page order, so it is enough to know each text's depth: a stack of
open elements, with the HTML rules for implied ends and for formatting elements
that go on across blocks, gives it without building the tree.
"""

from __future__ import annotations

import html
import re
from collections import Counter

_words = lambda s: frozenset(s.split())
# Element classes of the HTML standard.
VOID = _words("area base br col embed hr img input link meta source track wbr")
RAW = _words("script style xmp iframe noembed noframes noscript")
DECODED = _words("title textarea")
HEAD = _words("base basefont bgsound link meta title script style noframes noscript template")
FORMATTING = _words("a b big code em font i nobr s small strike strong tt u")
BLOCKS = _words(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav "
    "ol p search section summary ul h1 h2 h3 h4 h5 h6 pre listing form table hr plaintext xmp li dd dt"
)
HEADINGS = _words("h1 h2 h3 h4 h5 h6")
SCOPE = _words("applet caption html table td th marquee object template")
SPECIAL = BLOCKS | SCOPE | _words("body head tbody thead tfoot tr button select option optgroup textarea title iframe")
TABLE_PARTS = _words("table tbody thead tfoot tr")
SECTIONS = _words("tbody thead tfoot")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)", re.S)
_ERASED = re.compile(r" |\n|\r|\\n")


class _Stack(list):
    """Open elements, and how many of each there are: a tag that isn't open need not be looked for."""

    def __init__(self, tags: list[str]):
        super().__init__(tags)
        self.count = Counter(tags)

    def append(self, tag: str) -> None:
        super().append(tag)
        self.count[tag] += 1

    def pop(self) -> str:
        tag = super().pop()
        self.count[tag] -= 1
        return tag

    def __delitem__(self, at: int | slice) -> None:
        self.count.subtract(self[at] if isinstance(at, slice) else [self[at]])
        super().__delitem__(at)


class _Depths:
    def __init__(self):
        self.stack, self.active, self.body = _Stack(["html"]), [], False
        self.found: list[tuple[int, str]] = []

    def has(self, tags: frozenset[str] | set[str], limits: frozenset[str]) -> bool:
        if not any(self.stack.count[t] for t in tags):
            return False
        for tag in reversed(self.stack):
            if tag in tags:
                return True
            if tag in limits:
                return False
        return False

    def pop_to(self, tags: frozenset[str] | set[str]) -> None:
        while len(self.stack) > 2:
            if self.stack.pop() in tags:
                return

    def open_body(self) -> None:
        if not self.body:
            self.stack, self.body = _Stack(["html", "body"]), True

    def reconstruct(self) -> None:
        """Open again the formatting elements that a block's end has closed."""
        start = max((k + 1 for k, tag in enumerate(self.active) if tag is None), default=0)
        left = Counter({tag: self.stack.count[tag] for tag in self.active[start:]})
        for tag in self.active[start:]:
            if left[tag] > 0:
                left[tag] -= 1
            else:
                self.stack.append(tag)

    def text(self, text: str, depth: int | None = None) -> None:
        if not text or (not self.body and not text.strip(" \t\n\r\f")):
            return
        self.open_body()
        if self.stack[-1] in TABLE_PARTS and text.strip(" \t\n\r\f"):
            table = len(self.stack) - 1 - self.stack[::-1].index("table") if "table" in self.stack else 1
            self.found.append((table + 1, text))  # such text stands before its table
            return
        self.reconstruct()
        self.found.append((len(self.stack) + 1, text))

    def start(self, tag: str) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.open_body()
            return
        if tag in HEAD and not self.body:
            return
        self.open_body()
        stack = self.stack
        if tag in ("td", "th", "tr") or tag in SECTIONS or tag in ("caption", "colgroup"):
            if not self.has({"table"}, frozenset({"html"})):
                return
            wanted = {"td": {"tr"}, "th": {"tr"}, "tr": SECTIONS}.get(tag, frozenset())
            while stack[-1] not in wanted and stack[-1] != "table" and not (tag in ("td", "th") and stack[-1] in SECTIONS):
                if stack.pop() in ("td", "th", "caption"):
                    self.unmark()
            if stack[-1] == "table" and tag in ("tr", "td", "th"):
                stack.append("tbody")
            if stack[-1] in SECTIONS and tag in ("td", "th"):
                stack.append("tr")
            stack.append(tag)
            if tag in ("td", "th", "caption"):
                self.active.append(None)
            return
        if tag in BLOCKS and self.has({"p"}, SCOPE | {"button"}):
            self.pop_to({"p"})
        if tag in HEADINGS and stack[-1] in HEADINGS:
            stack.pop()
        if tag in ("li", "dd", "dt"):
            same = {"li"} if tag == "li" else {"dd", "dt"}
            for open_ in reversed(stack):
                if open_ in same:
                    self.pop_to({open_})
                    break
                if open_ in SPECIAL and open_ not in ("address", "div", "p"):
                    break
            if self.has({"p"}, SCOPE | {"button"}):
                self.pop_to({"p"})
        if tag in ("option", "optgroup") and stack[-1] == "option":
            stack.pop()
        if tag not in BLOCKS:
            if tag in ("a", "nobr") and tag in self.active[max((k + 1 for k, t in enumerate(self.active) if t is None), default=0) :]:
                self.end(tag)
            self.reconstruct()
        if tag in VOID:
            return
        stack.append(tag)
        if tag in FORMATTING:
            start = max((k + 1 for k, t in enumerate(self.active) if t is None), default=0)
            if self.active[start:].count(tag) >= 3:
                self.active.pop(start + self.active[start:].index(tag))
            self.active.append(tag)

    def unmark(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def end(self, tag: str) -> None:
        stack = self.stack
        if tag in ("html", "body", "head") or len(stack) < 3:
            return
        if tag in FORMATTING:
            if tag in self.active:
                del self.active[len(self.active) - 1 - self.active[::-1].index(tag)]
            if stack.count[tag] and self.has({tag}, SCOPE):
                at = len(stack) - 1 - stack[::-1].index(tag)
                # Below a block the element is cut out; what is open above it stays open.
                if any(t in SPECIAL for t in stack[at:]):
                    del stack[at]
                else:
                    del stack[at:]
            return
        if tag in HEADINGS:
            if self.has(HEADINGS, SCOPE):
                self.pop_to(HEADINGS)
        elif tag in BLOCKS or tag in SCOPE or tag in TABLE_PARTS:
            limits = {"html"} if tag in TABLE_PARTS or tag in ("td", "th", "caption") else SCOPE - {tag}
            limits = frozenset(limits) | (frozenset({"ul", "ol"}) if tag == "li" else frozenset())
            if self.has({tag}, limits):
                self.pop_to({tag})
                if tag in ("td", "th", "caption"):
                    self.unmark()
        elif stack.count[tag]:
            for k in range(len(stack) - 1, 1, -1):
                if stack[k] == tag:
                    del stack[k:]
                    return
                if stack[k] in SPECIAL:
                    return


def by_depth(page: str) -> str:
    """All text but scripts and styles, level by level."""
    state, at = _Depths(), 0
    for match in iter(lambda: _TAG.search(page, at), None):
        state.text(html.unescape(page[at : match.start()]))
        at = match.end()
        tag = (match[2] or "").lower()
        if not tag or not match[4]:
            continue
        if match[1]:
            state.end(tag)
        elif tag in RAW or tag in DECODED or tag == "plaintext":
            if tag not in HEAD:
                state.open_body()
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at) if tag != "plaintext" else None
            inside = page[at : close.start() if close else len(page)]
            at = close.end() if close else len(page)
            if tag not in ("script", "style") and inside:
                # The skeleton's head is as deep as its body.
                depth = (len(state.stack) if state.body else 2) + 2
                state.found.append((depth, html.unescape(inside) if tag in DECODED else inside))
        else:
            state.start(tag)
    state.text(html.unescape(page[at:]))
    return "".join(text for _, text in sorted(state.found, key=lambda x: x[0]))


def extract_text(page: str) -> str:
    """Text of a page: read, spaces erased, and the same once more on the result."""
    for _ in range(2):
        page = _ERASED.sub("", by_depth(page))
    return page
