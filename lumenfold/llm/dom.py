"""A small tolerant DOM: block elements and text runs as parallel lists, parents before children.

Tags are read by the HTML rules: a quote counts only where a value begins, and a
tag that the page ends within is no text. Inline elements make no nodes; of them
only links matter, as a flag on the text inside. Every step moves forward in the
page or takes an element off the stack, so the work is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

_words = lambda s: frozenset(s.split())
# Element classes of the HTML standard.
VOID = _words("area base br col embed hr img input link meta param source track wbr")
#: Their content isn't shown, or is a form's control, and no text of the page.
SKIPPED = _words("script style template iframe select title noembed noframes")
#: Their content is text without markup; in the second kind character references count.
VERBATIM, DECODED = _words("xmp"), _words("textarea")
INLINE = _words(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label map mark math nobr picture q rp rt ruby s samp "
    "small source span strike strong sub sup svg time track tt u var wbr"
)
#: An opening tag of the key closes an open element among the values, up to the nearest limit.
CLOSES = {k: _words(v) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
LIMITS = _words("ul ol dl table select body html article section div")
PARAGRAPH_LIMITS = LIMITS | _words("td th li blockquote button")
#: These end mathematics or a drawing that was left open.
HTML_BLOCKS = LIMITS | _words("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre main aside nav header footer form figure tr td th")
#: Attributes whose words describe an element.
NAMING = ("class", "id", "role")

_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s/>=\"'<]++=\"[^\"<>]*+\")*+)\s*+(/?)>")
_PLAIN_ATTRIBUTE = re.compile(r"([^\s/>=\"'<]++)=\"([^\"<>]*+)\"")
_MARKUP = re.compile(r"<(?:[!?a-zA-Z]|/[^<])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_BARE = re.compile(r"[^\s>]*+")
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def decoded(text: str) -> str:
    """Character references replaced; a number beyond all characters gives the replacement character."""
    if "&" not in text:
        return text
    return html.unescape(_HUGE.sub("�", _ZEROS.sub("&#", text)) if "&#" in text else text)


class Dom:
    """``parent[i]`` of node i (-1 for the root), its ``tag`` ("" for text), naming words and mark, text, and whether it is a link's."""

    __slots__ = ("parent", "tag", "names", "mark", "text", "linked")

    def __init__(self):
        self.parent, self.tag, self.names, self.mark, self.text, self.linked = [-1], ["#root"], [""], [""], [""], [False]

    def add(self, parent: int, tag: str, names: str = "", mark: str = "", text: str = "", linked: bool = False) -> int:
        self.parent.append(parent), self.tag.append(tag), self.names.append(names)
        self.mark.append(mark), self.text.append(text), self.linked.append(linked)
        return len(self.tag) - 1


class _Parser:
    def __init__(self, page: str, label: str):
        self.page, self.label = page, label
        self.dom, self.open = Dom(), [0]
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements on the stack, by tag
        self.link = 0  # the stack's height where a link was opened
        self.foreign = ("", 0)  # math or svg that is open, and the stack's height there: their elements are inline
        self.no_end: set[str] = set()  # tags that no end tag follows any more
        self.last_quote: dict[str, int] = {}

    def text(self, piece: str, decode: bool = True) -> None:
        dom, parent = self.dom, self.open[-1]
        if piece and (not piece.isspace() or (dom.tag[-1] == "" and dom.parent[-1] == parent)):
            dom.add(parent, "", text=decoded(piece) if decode else piece, linked=self.link > 0)

    def push(self, tag: str, attributes: list[tuple[str, str]]) -> None:
        names = " ".join(v for k, v in attributes if k in NAMING)
        mark = next((v for k, v in attributes if k == self.label), "")
        self.places[tag].append(len(self.open))
        self.open.append(self.dom.add(self.open[-1], tag, names, mark))

    def cut(self, height: int) -> None:
        while len(self.open) > height:
            self.places[self.dom.tag[self.open.pop()]].pop()
        if self.link > height:
            self.link = 0
        if self.foreign[1] > height:
            self.foreign = ("", 0)

    def top(self, tags: frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def close(self, tags: frozenset[str], limits: frozenset[str] = frozenset()) -> None:
        """Close the nearest open element of ``tags`` and all in it, unless a limit is nearer."""
        at = self.top(tags)
        if at > 0 and at >= self.top(limits):
            self.cut(at)

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """Attributes from ``at`` on, whether the tag ends itself, and where it ends."""
        page, n, found = self.page, len(self.page), []
        while True:
            gap = _GAP.match(page, at)
            at = gap.end()
            if at >= n:
                return found, False, n
            if page[at] == ">":
                return found, gap[0].endswith("/"), at + 1
            name = _ATTRIBUTE.match(page, at)
            at, value = name.end(), ""
            if equals := _EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ("'", '"') and quote not in self.last_quote:
                    self.last_quote[quote] = page.rfind(quote)
                if quote in ("'", '"') and self.last_quote[quote] > at:
                    end = page.find(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:  # also where a quote has no other end than the page's
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            found.append((name[0].lower(), value))

    def content(self, tag: str, at: int) -> tuple[int, int] | None:
        """Where an element ends that holds no markup: its content's and its end tag's end."""
        if tag in self.no_end:
            return None
        end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.IGNORECASE).search(self.page, at)
        if end is None:
            self.no_end.add(tag)
            return (len(self.page), len(self.page)) if tag in ("script", "style") else None
        return end.start(), end.end()

    def start(self, tag: str, attributes: list[tuple[str, str]], ended: bool, at: int) -> int:
        """Take an opening tag; returns where to go on."""
        if tag in SKIPPED or tag in VERBATIM or tag in DECODED:
            if (span := self.content(tag, at)) is None:
                return at
            if tag not in SKIPPED:
                self.push(tag, attributes)
                self.text(self.page[at : span[0]], tag in DECODED)
                self.cut(len(self.open) - 1)
            return span[1]
        if tag in HTML_BLOCKS:
            self.foreign = ("", 0)
        if tag in INLINE or self.foreign[0]:
            if tag == "br":
                self.dom.add(self.open[-1], "", text=" ", linked=self.link > 0)
            elif tag == "a":
                self.link = len(self.open)
            elif tag in ("math", "svg") and not ended and not self.foreign[0]:
                self.foreign = (tag, len(self.open))
            return at
        self.close(frozenset({"p"}), PARAGRAPH_LIMITS)
        if tag in CLOSES:
            self.close(CLOSES[tag], LIMITS)
        self.push(tag, attributes)
        if tag in VOID:
            self.cut(len(self.open) - 1)
        return at

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = 0
        elif self.foreign[0]:
            self.foreign = ("", 0) if tag == self.foreign[0] or tag in HTML_BLOCKS else self.foreign
            if tag in HTML_BLOCKS:
                self.end(tag)
        elif tag not in INLINE:
            self.close(frozenset({tag}), frozenset({"table"}) if tag in ("p", "li") else frozenset())

    def run(self) -> Dom:
        page, n, begin, at = self.page, len(self.page), 0, 0
        while found := _MARKUP.search(page, at):  # any other such sign is text
            at, after = found.start(), found[0][1:]
            self.text(page[begin:at])
            if (plain := _PLAIN.match(page, at)) is not None:
                tag, closing, ended, at = plain[2].lower(), plain[1], bool(plain[4]), plain.end()
                attributes = [(k.lower(), v) for k, v in _PLAIN_ATTRIBUTE.findall(plain[3])] if plain[3] else []
            elif page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                begin = at = end + 3 if end >= 0 else n
                continue
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at + 9)
                self.text(page[at + 9 : end if end >= 0 else n], False)
                begin = at = end + 3 if end >= 0 else n
                continue
            elif name := _NAME.match(page, at + 1 + (after[0] == "/")):
                tag, closing = name[0].lower(), after[0] == "/"
                attributes, ended, at = self.attributes(name.end())
            else:
                end = page.find(">", at)
                begin = at = end + 1 if end >= 0 else n
                continue
            if closing:
                self.end(tag)
            else:
                at = self.start(tag, attributes, ended, at)
            begin = at
        self.text(page[begin:])
        return self.dom


def parse(page: str, label: str = "") -> Dom:
    """Build the tree; anything that is no markup is text, and open elements end with the page. ``label`` names the mark's attribute."""
    return _Parser(page, label).run()


def blocks(dom: Dom) -> list[tuple[int, str, int]]:
    """(element, text, characters in links) of the text blocks in page order.

    A block is the text between two borders of non-inline elements; it belongs
    to the element right around it. White space inside is one space.
    """
    out: list[tuple[int, str, int]] = []
    pieces: list[str] = []
    now = linked = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(pieces).split())
        if joined:
            out.append((now, joined, linked))
        pieces.clear()
        linked = 0

    for i in range(1, len(dom.tag)):
        if dom.tag[i]:
            flush()
            now = i
            continue
        if dom.parent[i] != now:
            flush()
            now = dom.parent[i]
        pieces.append(dom.text[i])
        if dom.linked[i]:
            linked += len(dom.text[i].strip())
    flush()
    return out
