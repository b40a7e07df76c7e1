"""HTML pages to text blocks with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that are blocks of text, elements that aren't shown, elements without an end, classes of page furniture.
BLOCKS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "figcaption"))
HIDDEN = frozenset(("script", "style", "noscript"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
FURNITURE = frozenset(("reference", "mw-editsection", "reflist", "hatnote", "mw-jump-link", "catlinks", "navbox", "vertical-navbox", "metadata", "mw-empty-elt"))
#: The page's content is the first element with this id, else the first of these, else all.
CONTENT_ID, CONTENT_TAGS = "mw-content-text", ("main", "body")
_MARKS = re.compile(r"\[(?:\d+|edit|citation needed|source)\]", re.IGNORECASE)


class _Blocks(HTMLParser):
    """Collects each block element's strings, those of nested blocks too, in the order in which blocks begin.

    An element ends at its end tag or that of one around it; unclosed ones nest.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list[str] | None, bool, frozenset]] = []
        self.blocks: list[tuple[list[str], frozenset]] = []
        self.roots: set[str] = set()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        found = dict(attrs)
        hidden = tag in HIDDEN or bool(FURNITURE & set((found.get("class") or "").split()))
        inside = self.stack[-1][3] if self.stack else frozenset()
        kind = CONTENT_ID if found.get("id") == CONTENT_ID else tag if tag in CONTENT_TAGS else None
        parts = [] if tag in BLOCKS else None
        if parts is not None:
            self.blocks.append((parts, inside))
        if kind and kind not in self.roots:
            self.roots.add(kind)
            inside |= {kind}
        self.stack.append((tag, parts, hidden, inside))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if data.strip() and not any(hidden for _, _, hidden, _ in self.stack):
            for _, parts, _, _ in self.stack:
                if parts is not None:
                    parts.append(data.strip())


def html_blocks(html: str | None) -> list[str]:
    """Text blocks of a page's content; a block equal to the one before is left out."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    root = next((k for k in (CONTENT_ID, *CONTENT_TAGS) if k in parser.roots), None)
    out: list[str] = []
    for parts, inside in parser.blocks:
        block = " ".join(_MARKS.sub("", " ".join(parts)).split())
        if (root is None or root in inside) and block and (not out or out[-1] != block):
            out.append(block)
    return out


@F.pandas_udf(T.StringType())
def page_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: "\n\n".join(html_blocks(h)))


def capped(text: Column, most: int = 25_000) -> Column:
    return F.substring(text, 1, most)
