"""What the operators on web pages share: the constructs of markup, raw text, attributes and their references."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

# Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])", re.I) for name in RAW}

#: One construct of the markup: a comment, a declaration, a tag with its attributes, whose quoted values may hold anything.
MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z))""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'][^\s=/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'][^\s]*)))?""")
REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(?P<next>=?)")


def in_value(value: str) -> str:
    """The value of an attribute with its character references decoded; a name without a semicolon only if nothing of a name or value follows, as in ``?a=1&copy=2``."""

    def one(m: re.Match) -> str:
        whole = m[0].removesuffix("=") if m["next"] else m[0]
        plain = whole[1] != "#" and (whole[1:] not in html5 or m["next"] and not whole.endswith(";"))
        return m[0] if plain else unescape(whole) + m["next"]

    return REFERENCE.sub(one, value) if "&" in value else value


def attributes(rest: str) -> dict[str, str]:
    """The attributes in the text of a tag, names in lower case; of repeated ones the first."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), in_value(m[2] or m[3] or m[4] or ""))
    return found


def tags(html: str, raw: frozenset[str] = RAW) -> Iterator[tuple[str, str]]:
    """(name, text of the attributes) of the start tags of a page: none in comments, in raw text or in the values of attributes."""
    at = 0
    while m := MARKUP.search(html, at):
        at = m.end()
        if m["name"] and not m["end"]:
            name = m["name"].lower()
            yield name, m["rest"]
            if name in raw:
                end = RAW_END[name].search(html, at)
                at = end.start() if end else len(html)
