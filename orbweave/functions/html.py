"""Columns over html. The pattern tier stays in the JVM; the exact tier parses in Arrow batches."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r]+"
LINK = r'(?is)<a\s[^>]*?href="([^"]*)"'


def title(html: Column) -> Column:
    """Text of the first title element, blanks collapsed, entities as they stand; empty if there is none."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), BLANKS, " "))


def body_text(html: Column) -> Column:
    """Visible text: head, scripts, styles, comments and tags give way to blanks, which collapse."""
    for pattern in (r"(?is)<head.*?</head>", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", r"(?s)<!--.*?-->", r"(?s)<[^>]+>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, BLANKS, " "))


def links(html: Column) -> Column:
    """Targets of the anchors with a quoted href, in order."""
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


_HREF = r"""href\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+)"""


def _value(attribute: Column) -> Column:
    """The value of `href=...` in any quoting, the ampersand's entity decoded."""
    bare = F.regexp_replace(attribute, r"(?is)^.*?=\s*[\"']?|[\"']$", "")
    return F.trim(F.regexp_replace(bare, "(?i)&amp;", "&"))


def all_links(html: Column) -> Column:
    """Targets of the anchors in order: quoted either way, or bare."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<a\s(?:[^>]*?\s)?({_HREF})"), F.lit(1)), _value)


def base_href(html: Column) -> Column:
    """What the page's first base element says links are relative to; empty if it has none."""
    return _value(F.regexp_extract(html, rf"(?is)<base\s(?:[^>]*?\s)?({_HREF})", 1))


def anchor_count(html: Column) -> Column:
    """Number of anchors, with or without a target."""
    return F.size(F.regexp_extract_all(html, F.lit(r"(?is)<a(?:\s[^>]*)?>"), F.lit(0)))


class _Page(HTMLParser):
    """Title, visible text and links of one page, tolerant of unclosed elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden = self.in_title = 0
        self.titled = False
        self.title: list[str] = []
        self.text: list[str] = []
        self.links: list[str] = []
        self.base = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag == "title" and not self.titled:
            self.in_title, self.titled = 1, True
        elif tag == "base" and not self.base:
            self.base = dict(attrs).get("href") or ""
        elif tag == "a":
            href = dict(attrs).get("href")
            if href and href.strip():
                self.links.append(href.strip())
        self._part(tag)

    def _part(self, tag: str) -> None:
        """Words part where a block begins or ends."""
        if tag not in ("b", "i", "em", "strong", "span", "a", "font", "code", "u", "small"):
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "title":
            self.in_title = 0
        self._part(tag)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.text.append(data)


def parse(html: str | None) -> tuple[str, str, list[str], str]:
    """(title, text, links, base) of a page; all empty for null."""
    if not html:
        return "", "", [], ""
    page = _Page()
    page.feed(html)
    page.close()
    return " ".join("".join(page.title).split()), " ".join("".join(page.text).split()), page.links, page.base


def parsed(html: str | Column) -> Column:
    """The exact tier as a struct: decoded title and text, links with any quoting, base of relative links."""

    @F.pandas_udf("title string, content string, links array<string>, base string")
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(h) for h in pages], columns=["title", "content", "links", "base"])

    return run(html)


def decoded(text: str | Column) -> Column:
    """Entities as the characters they stand for."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unescape(t) if t and "&" in t else t)

    return run(text)
