"""HTML to text, and the small tree that alert mails are read from."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = frozenset("p div li br tr h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("script style noscript iframe svg form template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    """Collects text; a dropped element ends with its own end tag or with that of an element around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: Counter[str] = Counter()
        self.hidden: list[tuple[str, Counter[str]]] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in VOID:
            if tag in BLOCKS and not self.hidden:
                self.out.append("\n")
            return
        if tag in DROPPED:
            self.hidden.append((tag, Counter()))
        elif self.hidden:
            self.hidden[-1][1][tag] += 1
        else:
            self.open[tag] += 1
            if tag == "li":
                self.out.append("\n• ")
            elif tag in BLOCKS:
                self.out.append("\n")

    def handle_endtag(self, tag) -> None:
        if not self.hidden:
            self.open[tag] = max(self.open[tag] - 1, 0)
            return
        # from the innermost: its own end, an end within it, or one around it that takes it along
        for depth in reversed(range(len(self.hidden))):
            name, inside = self.hidden[depth]
            if name == tag:
                del self.hidden[depth:]
                return
            if inside[tag]:
                inside[tag] -= 1
                del self.hidden[depth + 1 :]
                return
            if name == "template":
                return
        if self.open[tag]:
            self.open[tag] -= 1
            self.hidden.clear()

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.out.append(data)


_AMPERSAND = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")


def _only_closed(raw: str) -> str:
    """HTML with every ampersand escaped that begins no known reference with a semicolon."""
    known = lambda name: name and (name[0] == "#" or name in html.entities.html5)
    return _AMPERSAND.sub(lambda m: m[0] if known(m[1]) else f"&amp;{m[1] or ''}", raw)


def text_of(raw: str | None, closed: bool = False) -> str:
    """Text of HTML whose entities may be escaped once more; list items get bullets.

    As browsers do, ``&amp`` without its semicolon counts as a reference, unless only
    ``closed`` ones are asked for: then what a cut left of one stays as it is.
    """
    if not raw:
        return ""
    known = _only_closed if closed else str
    reader = _Text()
    reader.feed(known(html.unescape(known(raw))))
    reader.close()
    text = unicodedata.normalize("NFKC", "".join(reader.out)).replace(" ", " ")
    text = re.sub("[​‌‍﻿]", "", text)
    text = re.sub(r"[ \t]+", " ", text)
    return re.sub(r"\n\s*\n\s*\n+", "\n\n", text).strip()


@F.pandas_udf(T.StringType())
def _html_to_text(values: pd.Series) -> pd.Series:
    return values.map(lambda x: text_of(x if isinstance(x, str) else None))


@F.pandas_udf(T.StringType())
def _closed_html_to_text(values: pd.Series) -> pd.Series:
    return values.map(lambda x: text_of(x if isinstance(x, str) else None, closed=True))


def html_to_text(raw: Column, closed: bool = False) -> Column:
    """Text of HTML, of ``closed`` references only where asked for; nulls and empty values stay in the JVM."""
    empty = raw.isNull() | (raw == "")
    return F.when(empty, F.lit("")).otherwise((_closed_html_to_text if closed else _html_to_text)(F.when(~empty, raw)))


def unescaped(raw: Column) -> Column:
    """Entities of a board's description, once."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    needs = F.contains(raw, F.lit("&"))
    return F.when(needs, run(F.when(needs, raw))).otherwise(raw)


def escaped(raw: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        raw = F.replace(raw, F.lit(char), F.lit(entity))
    return raw


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: "Element | None" = None
    children: list["Element | str"] = field(default_factory=list)

    def ancestors(self) -> Iterator["Element"]:
        """The elements above, the nearest first, without the document itself."""
        above = self.parent
        while above is not None and above.parent is not None:
            yield above
            above = above.parent

    def text(self, separator: str) -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                todo.extend(reversed(node.children))
        return separator.join(parts)


class _Tree(HTMLParser):
    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})
        self.dropped, self.hidden, self.elements = dropped, 0, []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in VOID:
            return
        if tag in self.dropped:
            self.hidden += 1
        element = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        if not self.hidden:
            self.at.children.append(element)
            self.elements.append(element)
        self.at = element

    def handle_endtag(self, tag) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is None:
            return
        while self.at is not node.parent:
            self.hidden -= self.at.tag in self.dropped
            self.at = self.at.parent

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.at.children.append(data)


def tree_of(raw: str, dropped: str = "script style noscript iframe img template") -> list[Element]:
    """All elements in document order, those within dropped tags left out."""
    reader = _Tree(frozenset(dropped.split()))
    reader.feed(raw)
    reader.close()
    return reader.elements
