"""A tokeniser of HTML as a state machine, and the blocks of text and links that it finds in a page.

It follows the rules that browsers have for broken markup as far as text is concerned: a comment, a tag or an element of raw text that is never closed
takes the rest of the page; a ``<`` that begins nothing is text; attributes may be quoted, unquoted or repeated (the first one counts).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape
from html.entities import html5

_SPACE = " \t\n\r\f"
_NAME_END = _SPACE + "/>"
_ATTRIBUTE_END = _NAME_END + "="

# Elements whose content is no markup, elements whose content isn't shown as text, and elements that begin a block.
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp".split())
HIDDEN = frozenset("svg math template select object canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Characters that take no room.
_INVISIBLE = {i: None for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


def folded(text: str) -> str:
    """Compatibility forms composed (NFKC), invisible characters gone, runs of white space as one space."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return " ".join(text.split())


_CLOSED = re.compile("&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def decoded(text: str, closed: bool = False) -> str:
    """The text with its character references replaced: as browsers do, or (``closed``) only those that end with a semicolon, so that what is left of a
    reference that was cut off stays as it is."""
    if not closed or "&" not in text:
        return unescape(text)
    return _CLOSED.sub(lambda m: unescape(m[0]) if m[1][0] == "#" else html5.get(f"{m[1]};", m[0]), text)


def _until(html: str, at: int, ends: str) -> int:
    while at < len(html) and html[at] not in ends:
        at += 1
    return at


def _past(html: str, at: int, some: str) -> int:
    while at < len(html) and html[at] in some:
        at += 1
    return at


def _attributes(html: str, at: int, closed: bool) -> tuple[dict[str, str], int]:
    """The attributes from a tag's name on, and the place after the tag."""
    found: dict[str, str] = {}
    while True:
        at = _past(html, at, _SPACE + "/")
        if at >= len(html) or html[at] == ">":
            return found, at + 1
        end = _until(html, at + 1, _ATTRIBUTE_END)
        name, value = html[at:end].lower(), ""
        at = _past(html, end, _SPACE)
        if at < len(html) and html[at] == "=":
            at = _past(html, at + 1, _SPACE)
            if at < len(html) and html[at] in "\"'":
                end = html.find(html[at], at + 1)
                end = len(html) if end < 0 else end
                value, at = html[at + 1 : end], end + 1
            else:
                end = _until(html, at, _SPACE + ">")
                value, at = html[at:end], end
        found.setdefault(name, decoded(value, closed))


def _end_of_raw(html: str, lower: str, name: str, at: int) -> int:
    """Where the end tag of an element of raw text begins."""
    while True:
        at = lower.find(f"</{name}", at)
        if at < 0:
            return len(html)
        after = at + len(name) + 2
        if after >= len(html) or html[after] in _NAME_END:
            return at
        at = after


def tokens(html: str, closed: bool = False) -> Iterator[tuple[str, str, dict[str, str] | str]]:
    """(kind, name, what): ``text`` with its characters, ``open`` with its attributes, ``close``, and ``raw`` with an element's content."""
    at, lower = 0, html.lower()
    if len(lower) != len(html):  # characters whose lower case is longer
        lower = "".join(c.lower() if c.isascii() else c for c in html)
    while at < len(html):
        begin = html.find("<", at)
        begin = len(html) if begin < 0 else begin
        if begin > at:
            yield "text", "", decoded(html[at:begin], closed)
        if begin == len(html):
            return
        here = html[begin + 1 : begin + 2]
        closing = here == "/"
        first = html[begin + 2 : begin + 3] if closing else here
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = len(html) if end < 0 else end + 3
        elif here in ("!", "?") and here or closing and first and not (first.isascii() and first.isalpha()):
            end = html.find(">", begin)
            at = len(html) if end < 0 else end + 1
        elif first.isascii() and first.isalpha():
            start = begin + 1 + closing
            end = _until(html, start, _NAME_END)
            name = lower[start:end]
            attributes, at = _attributes(html, end, closed)
            if at > len(html):  # never closed
                return
            if closing:
                yield "close", name, ""
                continue
            yield "open", name, attributes
            if name in RAW:
                end = _end_of_raw(html, lower, name, at)
                yield "raw", name, html[at:end]
                at = end
        else:
            yield "text", "", "<"
            at = begin + 1


def page(html: str | None, closed: bool = False) -> dict:
    """``title``, ``base`` (of relative links), ``links`` (href and text) and ``blocks`` (tag, text, words, words in links) of a page; ``closed``: see ``decoded``."""
    out: dict = {"title": None, "base": None, "links": [], "blocks": []}
    text: list[str] = []
    linked: list[str] = []
    link: list[str] | None = None
    tag, hidden = "", []

    def flush() -> None:
        shown = folded("".join(text))
        if shown:
            out["blocks"].append({"tag": tag, "text": shown, "words": len(shown.split()), "link_words": len(folded("".join(linked)).split())})
        text.clear()
        linked.clear()

    def end_link() -> None:
        nonlocal link
        if link is not None:
            out["links"][-1]["text"] = folded("".join(link))
            linked.append(" ")
        link = None

    for kind, name, what in tokens(html or "", closed):
        if kind == "raw":
            if name == "title" and out["title"] is None:
                out["title"] = folded(decoded(what, closed))
        elif hidden:
            if kind == "open" and name == hidden[-1]:
                hidden.append(name)
            elif kind == "close" and name == hidden[-1]:
                hidden.pop()
        elif kind == "text":
            text.append(what)
            if link is not None:
                link.append(what)
                linked.append(what)
        elif name in BLOCKS:
            flush()
            tag = name if kind == "open" else ""
        elif name == "br":
            text.append(" ")
            if link is not None:
                link.append(" ")
                linked.append(" ")
        elif name == "a":
            end_link()
            if kind == "open" and what.get("href") is not None:
                out["links"].append({"href": what["href"].strip(_SPACE), "text": ""})
                link = []
        elif kind == "open" and name in HIDDEN:
            hidden.append(name)
        elif kind == "open" and name == "base" and out["base"] is None:
            out["base"] = what.get("href")
    end_link()
    flush()
    return out
