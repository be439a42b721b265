"""Ant-style path patterns as regular expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = r"([\\.\[\]{}()+^$|])"


def _segment(segment: str) -> str:
    out, i = [], 0
    while i < len(segment):
        c = segment[i]
        if c == "*":
            out.append("[^/]*")
            while i + 1 < len(segment) and segment[i + 1] == "*":
                i += 1
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth, j = 1, i + 1
            while j < len(segment) and depth:
                depth += {"{": 1, "}": -1}.get(segment[j], 0)
                j += 1
            if depth:
                out.append(re.escape(c))
            else:
                _, colon, own = segment[i + 1 : j - 1].partition(":")
                out.append(f"(?:{own})" if colon else "[^/]*")
                i = j - 1
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def ant_to_regex(pattern: str) -> str:
    """A regular expression that matches the whole path as the pattern does.

    Segments part at slashes, empty ones do not count; a segment `**` stands for any number of segments, `*` and
    `?` for characters of one, `{name}` and `{name:regex}` for a variable. Leading slashes have to agree, closing
    ones too unless the pattern ends in `**`. Case counts.
    """
    segments = [s for s in pattern.split("/") if s]
    out = "/+" if pattern.startswith("/") else ""
    if not segments:
        return "^/*$" if pattern else "^$"
    first = True
    for number, segment in enumerate(segments):
        if segment == "**":
            if number == len(segments) - 1:
                out += ".*" if first else "(?:/.*)?"
            else:
                out += "(?:[^/]+/+)*" if first else "(?:/+[^/]+)*"
                continue
        else:
            out += _segment(segment) if first or out.endswith("/+)*") and number == 1 and segments[0] == "**" else "/+" + _segment(segment)
        first = False
    if segments[-1] != "**":
        out += "/+" if pattern.endswith("/") else ""
    return f"^{out}$"


def matches(path: str, pattern: str) -> bool:
    """Whether a path matches a pattern, on the driver."""
    return re.match(ant_to_regex(pattern), path, re.S) is not None


def any_match(path: Column, patterns: list[str]) -> Column:
    """Whether a path matches one of some patterns."""
    return reduce(lambda a, b: a | b, (path.rlike(ant_to_regex(p)) for p in patterns), F.lit(False))


def regex_of(pattern: Column) -> Column:
    """`ant_to_regex` as a column, for patterns that are data (without variables)."""
    p = F.regexp_replace(pattern, _SPECIAL, r"\\$1")
    p = F.regexp_replace(p, r"\?", "[^/]")
    p = F.regexp_replace(p, r"(?<=^|/)\*\*$", "\u0001")
    p = F.regexp_replace(p, r"(?<=^|/)\*\*/+", "\u0002")
    p = F.regexp_replace(p, r"\*+", "[^/]*")
    p = F.regexp_replace(p, r"/+", "/+")
    p = F.regexp_replace(p, "/\\+\u0001", "(?:/.*)?")
    p = F.regexp_replace(p, "\u0001", ".*")
    p = F.regexp_replace(p, "\u0002", "(?:[^/]+/+)*")
    return F.concat(F.lit("^"), p, F.lit("$"))
