"""A page as elements with paths and blocks of text: the part of the template deduction that reads one page.

Tags are matched as browsers do in the common cases: void elements, end tags left out before the next block, paragraph, item, row or cell, inline elements
that a closed block closes, stray end tags ignored, scripts and styles as raw text. Character references are decoded once, in text only. An unclosed comment or script
ends with the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import xxhash

#: A plain tag, a comment, a declaration, a tag with quoted attributes, a tag with stray quotes. Groups: slash, name, rest, three times.
_TAG = re.compile(
    r"<(/?)([A-Za-z][^\s/>]*)([^>\"']*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
#: Attributes that tell something about an element.
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
#: Start and end of these end a block of text, and their start ends an open paragraph.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the second kind ends at a start tag of the first, unless one of the third lies between.
ENDS_OPEN = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
#: A paragraph stays open inside these.
HOLDS = frozenset("td th table button object caption".split())
CONTAINER = frozenset("html body div section center table tbody tr td main article".split())
#: Never part of an article.
APART = frozenset("head nav footer aside form button select dialog menu search svg canvas object template map".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer masthead cookie cookies consent notice newsletter subscribe subscription popup modal overlay comment comments disqus replies respond share "
    "sharing social related recommended recommendations widget toolbar pagination pager copyright disclaimer".split()
)


@dataclass(slots=True)
class Element:
    name: str
    path: int
    parent: int
    apart: bool
    article: bool
    main: bool
    link: bool


@dataclass(slots=True)
class Block:
    """Text between two block boundaries; `owner` is the path of the innermost block element, `inside` the paths of all that are open."""

    text: str
    owner: int
    apart: bool
    article: bool
    main: bool
    link_words: int
    inside: tuple[int, ...]


@dataclass(slots=True)
class Page:
    #: path: [parent, occurrences, place of the first, whether it can hold an article, words of text in it that is neither apart nor a link]
    elements: dict[int, list] = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)


_PATHS: dict[tuple[int, str, str], int] = {}


def _path(parent: int, name: str, signature: str) -> int:
    """Signed 64-bit digest of the tag names and classes from the root; a worker keeps those it has met."""
    if (found := _PATHS.get((parent, name, signature))) is None:
        if len(_PATHS) > 1 << 18:
            _PATHS.clear()
        found = xxhash.xxh64_intdigest(f"{parent} {name} {signature}".encode("utf-8", "replace"))
        found = _PATHS[parent, name, signature] = found - (1 << 64) if found >> 63 else found
    return found


def text_token(owner: int, text: str) -> int:
    return _path(owner, "#text", text) if len(text) < 64 else _path(owner, "#text", str(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))))


_NONE: dict[str, str] = {}


def _attributes(rest: str) -> dict[str, str]:
    if not rest or _TELLING.search(rest) is None:
        return _NONE
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)}


def _is_apart(name: str, attributes: dict[str, str], words: set[str] | frozenset[str], in_article: bool) -> bool:
    if name in APART:
        return True
    if not attributes:
        return name == "header" and not in_article
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower() or attributes.get("role", "").lower() in APART_ROLES:
        return True
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        return bool(words & {"comment", "comments", "related", "ad", "sponsored"})
    # The head of an article holds its title; only the page's header is apart.
    return bool(words & APART_WORDS) or (not in_article and (name == "header" or "header" in words))


_NO_WORDS: frozenset[str] = frozenset()


class _Reader:
    def __init__(self) -> None:
        self.page, self.stack, self.pieces = Page(), [Element("", 0, 0, False, False, False, False)], []
        self.owner, self.open_blocks, self.paragraphs = self.stack[0], [], 0

    def flush(self) -> None:
        """End the open block."""
        if not self.pieces:
            return
        text = " ".join("".join([t for t, _ in self.pieces]).split())
        linked = sum(len(t.split()) for t, link in self.pieces if link)
        self.pieces.clear()
        if not text:
            return
        top, inside = self.owner, tuple([e.path for e in self.open_blocks])
        self.page.blocks.append(Block(text, top.path, top.apart, top.article, top.main, linked, inside))
        if not top.apart:
            words = max(text.count(" ") + 1 - linked, 0)
            elements = self.page.elements
            for path in dict.fromkeys(inside):
                elements[path][4] += words

    def say(self, raw: str) -> None:
        if not raw:
            return
        if not self.pieces:
            if raw.isspace():
                return
            self.open_blocks = [e for e in self.stack if e.name in BLOCK]
            self.owner = self.stack[-1]
        self.pieces.append((unescape(raw) if "&" in raw else raw, self.stack[-1].link))

    def pop_to(self, at: int) -> None:
        for e in self.stack[at:]:
            if e.name in BLOCK:
                self.flush()
                self.paragraphs -= e.name == "p"
        del self.stack[at:]

    def start(self, name: str, rest: str) -> None:
        if name in VOID:
            if name == "hr":
                self.flush()
            elif name == "br" and self.pieces:
                self.pieces.append((" ", False))
            return
        if name in BLOCK:
            self.flush()
            for at in range(len(self.stack) - 1, 0, -1) if self.paragraphs else ():
                if self.stack[at].name in HOLDS:
                    break
                if self.stack[at].name == "p":
                    self.pop_to(at)
                    break
        if name in ENDS_OPEN:
            closes, stops = ENDS_OPEN[name]
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].name in stops:
                    break
                if self.stack[at].name in closes:
                    self.pop_to(at)
        top, attributes, role, signature, words = self.stack[-1], _attributes(rest), "", "", _NO_WORDS
        if attributes:
            named, role = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip(), attributes.get("role", "").lower()
            words = set(_WORD.findall(_HUMP.sub(" ", named).lower()))
            signature = re.sub(r"[0-9]+", "0", " ".join(sorted(named.lower().split())))
        apart = top.apart or _is_apart(name, attributes, words, top.article)
        article = top.article or (not apart and (name == "article" or role == "article"))
        main = top.main or (not apart and (name == "main" or role == "main"))
        path = _path(top.path, name, signature)
        self.stack.append(Element(name, path, top.path, apart, article, main, top.link or name == "a"))
        self.paragraphs += name == "p"
        seen = self.page.elements.get(path)
        if seen is None:
            self.page.elements[path] = [top.path, 1, len(self.page.elements), name in CONTAINER and not apart, 0]
        else:
            seen[1] += 1

    def end(self, name: str) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name == name:
                self.pop_to(at)
                return
            # An inline end tag does not reach out of its block.
            if name not in BLOCK and self.stack[at].name in BLOCK:
                return


_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}


def _raw_end(html: str, name: str, at: int) -> int:
    """Where the end tag of a raw element ends."""
    found = _RAW_END[name].search(html, at)
    return found.end() if found else len(html)


def read(html: str) -> Page:
    reader, at, search = _Reader(), 0, _TAG.search
    while (m := search(html, at)) is not None:
        start = m.start()
        if start > at:
            reader.say(html[at:start])
        at, last = m.end(), m.lastindex
        if not last:
            continue
        end, name, rest = m.group(last - 2, last - 1, last)
        name = name.lower()
        if end:
            reader.end(name)
        elif name in RAW:
            at = _raw_end(html, name, at)
        else:
            reader.start(name, rest)
            if rest.endswith("/") and name not in BLOCK:
                reader.end(name)
    reader.say(html[at:])
    reader.flush()
    return reader.page


def tokens(page: Page) -> Iterator[tuple[int, int, int, int, bool, bool, int]]:
    """(token, parent, occurrences, first place, is text, can hold an article, words) of each role on the page."""
    for path, (parent, n, first, holds, words) in page.elements.items():
        yield path, parent, n, first, False, holds, words
    seen: dict[int, list[int]] = {}
    for at, block in enumerate(page.blocks):
        if not block.apart:
            seen.setdefault(text_token(block.owner, block.text), [block.owner, 0, at])[1] += 1
    for token, (parent, n, first) in seen.items():
        yield token, parent, n, first, True, False, 0
