"""Tags and texts of a page of markup, in one pass over it.

Each character is looked at a bounded number of times whatever the page holds:
unclosed tags, comments and quotes end the page, they don't start a new search.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: What stands in a tag after its name; a quote begins a value only after "=".
BODY = re.compile(r"(?:[^>=]++|=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++))?+)*+")
ATTRIBUTE = re.compile(r"([^\s=/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?")
#: A "/" that closes a tag by itself, and not the end of a value without quotes.
ALONE = re.compile(r"(?:\A|[\s\"'])/\Z")
RAW = frozenset("script style textarea title noembed noframes xmp iframe".split())


def attributes(source: str, last: bool = False) -> dict[str, str]:
    """Of attributes of one name the first counts, as in browsers, or the last."""
    if not source.strip(" /\n\t"):
        return {}
    found = ATTRIBUTE.finditer(source)
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in (found if last else reversed(list(found)))}


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kind is text, start, end. Comments and declarations are passed over.

    A tag that the page's end cuts off is passed over, as browsers do; "<" before
    anything but a letter, "/", "!" or "?" is text. References are left as they are.
    """
    at = text_from = 0
    while (at := page.find("<", at)) >= 0:
        following = page[at + 1 : at + 2]
        ending = following == "/"
        name = NAME.match(page, at + 1 + ending)
        if not name and not (following and following in "!?/"):
            at += 1
            continue
        if at > text_from:
            yield "text", page[text_from:at], ""
        if not name:  # a comment, a declaration or nothing
            close = "-->" if page.startswith("<!--", at) else ">"
            end = page.find(close, at + 2)
            at = text_from = end + len(close) if end >= 0 else len(page)
            continue
        body = BODY.match(page, name.end())
        at = text_from = body.end() + 1
        if at > len(page):  # the page ends within the tag
            return
        tag = name[0].lower()
        yield ("end" if ending else "start"), tag, body[0]
        if tag in RAW and not ending and not body[0].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = end.start() if end else len(page)
            yield "text", page[at:stop], ""
            at = text_from = stop
    if text_from < len(page):
        yield "text", page[text_from:], ""
