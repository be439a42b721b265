"""Shapes of text that stands where content should: variables in marks, filler, traces."""

from __future__ import annotations

import re
from typing import NamedTuple

#: A name between marks: the marks open, the name, the marks that may close it.
_NAME = r"[=\-#/^&>!]?\s*([A-Za-z](?:[\w.\- |]*?[A-Za-z0-9])?|\d{1,2})\s*"
_MARKED = re.compile(rf"([$#]?(?:[{{\[<%@]{{1,4}}|[*|~]{{2,4}})){_NAME}([}}\]>%@*|~]{{1,4}})|(?<!\w)(__+)([A-Za-z](?:[\w.\-]*?[A-Za-z0-9])?)(__+)(?!\w)")
_MIRROR = str.maketrans("{[<", "}]>")
_HINT = re.compile(r"[{\[@_%<*~|]")
#: Without one of these there is no trace: a cheap test before the patterns.
TRACE_HINT = re.compile(r"rror|xception|raceback|[Tt]race:|^\s*at |on line|Warning:|ORA-|fault")
# The words by which pseudo-Latin filler is known.
FILLER_SEEDS = frozenset("lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt".split())
# How common runtimes print errors and traces.
TRACE = re.compile(
    r"Traceback \(most recent call last\)|\b(?:\w+\.)*\w*(?:Error|Exception)\b: \S|^\s*at [\w$.<>]+ ?\([^()\n]*:\d+(?::\d+)?\)"
    r"|\b(?:Fatal|Parse|Uncaught) error\b|\bWarning: \w+\(|\bStack trace:|\bORA-\d{5}\b|\bon line \d+\b|\bSegmentation fault\b",
    re.M,
)
WORD = re.compile(r"[^\W\d_]+")
#: Share of filler seeds from which a text is filler, and words it needs at least; characters a mark of a trace
#: accounts for.
FILLER_SHARE, FILLER_WORDS, TRACE_CHARS = 0.12, 5, 200


class Mark(NamedTuple):
    """A variable in a text: as it stands, its name, its marks, whether these hardly occur in prose or code, whether the
    text is nothing but variables, and whether it stands at the text's begin or end."""

    token: str
    name: str
    style: str
    strong: bool
    whole: bool
    edge: bool


def marks_in(text: str) -> tuple[Mark, ...]:
    """The variables in a text: names between marks that mirror each other, whatever the marks."""
    if not _HINT.search(text):
        return ()
    found = []
    for m in _MARKED.finditer(text):
        style, name, close = m.group(1, 2, 3) if m.group(1) else m.group(4, 5, 6)
        opening = style.lstrip("$#")
        closing = opening.translate(_MIRROR)[::-1]
        if not close.startswith(closing) or (opening in "%@<" and " " in name):
            continue  # not mirrored; single signs around several words are prose or markup
        found.append((m.start(), m.end() - len(close) + len(closing), name, style))
    if not found:
        return ()
    rest, at = [], 0
    for start, end, _, _ in found:
        rest.append(text[at:start])
        at = end
    rest.append(text[at:])
    whole = not WORD.search("".join(rest))
    first, last = text[: found[0][0]].strip(), text[found[-1][1] :].strip()
    out = []
    for k, (start, end, name, style) in enumerate(found):
        edge = (k == 0 and not first) or (k == len(found) - 1 and not last)
        strong = len(style) > 1 and style.strip("_") != ""
        words = re.split(r"[ .|]+", name)
        out.append(Mark(text[start:end], "".join(words[-1:]).lower().replace("_", ""), style, strong, whole, edge))
    return tuple(out)


def filler_share(text: str, words: frozenset[str]) -> float:
    """Share of filler words among the words of a text, 0 unless two different ones are there."""
    found = WORD.findall(text.lower())
    hits = [w for w in found if w in words]
    return len(hits) / len(found) if len(set(hits)) > 1 else 0.0


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the match stands inside quotation marks."""
    return bool(re.search(r"[“\"«„「『]\s*[^”\"»“」』]*\Z", text[:start])) and bool(re.match(r"[^“«„「『]*[”\"»」』]", text[end:]))


def residue_kind(text: str, marks: tuple[Mark, ...] = ()) -> int:
    """0 content, 1 nothing but variables, 2 filler, 3 a trace or error of a runtime."""
    if marks and marks[0].whole:
        return 1
    lowered = text.lower()
    if "lorem" in lowered or "ipsum" in lowered or "dolor" in lowered or "amet" in lowered:
        if len(WORD.findall(text)) >= FILLER_WORDS and filler_share(text, FILLER_SEEDS) >= FILLER_SHARE:
            return 2
    if TRACE_HINT.search(text):
        found = [m for m in TRACE.finditer(text) if not quoted(text, m.start(), m.end())]
        if len(found) * TRACE_CHARS > len(text):  # dense enough to be one, however long
            return 3
    return 0
