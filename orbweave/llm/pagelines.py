"""Visible text of html, line by line, fast enough for plain Python over Arrow batches."""

from __future__ import annotations

import re
from html import unescape

#: What is never visible: comments, and head, scripts and styles with all they hold (to the end if unclosed; a head
#: ends where a body begins).
HIDDEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S
)
TAG = re.compile(r"<[A-Za-z/!?][^>]*>")
LONG_TAG = re.compile(r"<[A-Za-z/!?][^>\n]*\n[^>]*>")
BLANKS = re.compile(r"[ \t\r]+")


def _breaks(m: re.Match) -> str:
    return "\n" * m.group().count("\n")


def blank_hidden(html: str) -> str:
    """The html without invisible parts; every line break stays, so line numbers do too."""
    return HIDDEN.sub(_breaks, html)


def visible_lines(html: str | None) -> list[tuple[int, str]]:
    """(line number from 1, visible text) of each line that has any."""
    if not html:
        return []
    text = HIDDEN.sub(_breaks, html)
    if "<" in text:
        text = TAG.sub("", LONG_TAG.sub(_breaks, text))
    out = []
    for number, line in enumerate(text.split("\n"), 1):
        if line:
            if "&" in line:
                line = unescape(line)
            if "  " in line or "\t" in line or "\r" in line:
                line = BLANKS.sub(" ", line)
            line = line.strip(" ")
            if line:
                out.append((number, line))
    return out
