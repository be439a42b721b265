"""Cut html into the subtrees of template work: visible text with the elements it stands in, hashed bottom-up.

Most lines of a page are its site's template, so what a line holds (tags and runs of text, hashed) is parsed
once and kept by its markup; a page then only replays that on a stack of open elements. Lines are a matter of
caching and of numbers alone: a page written on one line has the same elements.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import xxhash

from orbweave.llm.pagelines import BLANKS, HIDDEN, LONG_TAG
from orbweave.llm.residue_text import Mark, marks_in, residue_kind

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^>]*)>|<[!?][^>]*>")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*["']?([^"'\s>]+(?:\s[^"'>]+)?)""", re.I)
_CODE = re.compile(r"<(code|samp|kbd)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.I | re.S)
#: Sites often add their name to a title behind a dash or a bar.
SUFFIX = re.compile(r"\s+[-–—|:·]+\s+")
_BLOCK = frozenset(
    "html body div p ul ol li dl dt dd table thead tbody tr td th caption h1 h2 h3 h4 h5 h6 header footer nav aside main article"
    " section blockquote figure figcaption pre form fieldset address noscript".split()
)
_INLINE = frozenset(["span", "b", "font", "small"])
_HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
_ENDED = _INLINE | _HEADING
_CELL = frozenset(["td", "th"])
#: Elements whose text is one, however many lines it takes; in others every line is a text of its own.
_WHOLE = _HEADING | frozenset("p li dt dd caption figcaption blockquote pre address".split())
#: What an opening tag closes if it is left open above it.
_CLOSES = {tag: frozenset(["p", *_INLINE]) for tag in _BLOCK - {"html", "body", "noscript"}}
_CLOSES["li"] = _CLOSES["li"] | {"li"}
_CLOSES["td"] = _CLOSES["th"] = _CLOSES["td"] | _CELL
_CLOSES["tr"] = _CLOSES["tr"] | _CELL | {"tr"}
_CLOSES["dt"] = _CLOSES["dd"] = _CLOSES["dt"] | {"dt", "dd"}
_RULE, _OPEN, _CLOSE, _TEXT = 0, 1, 2, 3

#: Bits of a unit: a heading; inside header, nav, aside, footer or small; inside nav, aside or footer; its element has a
#: class; elements that hold content whatever their class; the page's title; text between blocks. Residue kinds follow
#: from KIND on.
HEADING, EDGE, FRAME, CLASSED, CONTENT, TITLE, LOOSE_TEXT, KIND = 1, 2, 4, 8, 16, 32, 64, 7
_EDGE = frozenset(["header", "nav", "aside", "footer", "small"])
_FRAME = frozenset(["nav", "aside", "footer"])
_CONTENT = _HEADING | frozenset("li td th dt dd caption figcaption blockquote pre".split())

#: Characters of markup whose parse is kept, and of the longest line that is; a cache only, emptied when full.
CACHED_CHARS, CACHED_LINE = 6_000_000, 4_000
#: Element paths that are kept; emptied when full.
CACHED_PATHS = 50_000
_MASK, _ODD, _MORE = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def hashed(*parts: str) -> int:
    """64 hash bits of some texts."""
    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"))


def mixed(a: int, b: int) -> int:
    """64 hash bits of two numbers, in order."""
    x = (a * _ODD + b) & _MASK
    return ((x ^ x >> 29) * _MORE) & _MASK


class Run(NamedTuple):
    """A run of text inside one element on one line; its variables, those in code left out."""

    text: str
    hash: int
    kind: int
    marks: tuple[Mark, ...]


def _clean(text: str) -> str:
    if "  " in text or "\t" in text or "\r" in text:
        text = BLANKS.sub(" ", text)
    return text.strip(" ")


class Lines:
    """Parsed lines by their markup, of bounded size."""

    def __init__(self) -> None:
        self.held, self.room = {}, CACHED_CHARS
        self.paths: list[tuple[int, int]] = [(0, 0)]
        self.steps: dict[tuple[int, int], int] = {}

    def __call__(self, line: str) -> tuple:
        ops = self.held.get(line)
        if ops is None:
            ops = self._parse(line)
            if len(line) <= CACHED_LINE:
                self.room -= len(line) + 200
                if self.room < 0:
                    self.held.clear()
                    self.room = CACHED_CHARS
                self.held[line] = ops
        return ops

    def path(self, parent: int, tag: str, label: int, classed: bool) -> int:
        """The place of an element below another, seen for the first time: a number for its chain of labels."""
        above, bits = self.paths[parent]
        bits &= EDGE | FRAME
        bits |= EDGE * (tag in _EDGE) | FRAME * (tag in _FRAME) | HEADING * (tag in _HEADING)
        bits |= CLASSED * classed | CONTENT * (tag in _CONTENT)
        self.paths.append((mixed(above, label), bits))
        place = self.steps[parent, label] = len(self.paths) - 1
        return place

    def fresh(self) -> None:
        """Between pages: forget paths where there are too many."""
        if len(self.paths) > CACHED_PATHS:
            self.paths, self.steps = [(0, 0)], {}

    def _parse(self, line: str) -> tuple:
        ops: list[tuple] = []
        parts: list[str] = []
        at = 0
        coded = "<code" in line or "<samp" in line or "<kbd" in line
        bare = _clean(unescape(_TAG.sub("", _CODE.sub(" ", line)))) if coded else ""

        def flush() -> None:
            if parts:
                text = "".join(parts)
                parts.clear()
                text = _clean(unescape(text) if "&" in text else text)
                if text:
                    marks = marks_in(text)
                    if marks and coded:
                        marks = tuple(m for m in marks if m.token in bare)
                    ops.append((_TEXT, Run(text, hashed(text), residue_kind(text, marks), marks)))

        for m in _TAG.finditer(line):
            if m.start() > at:
                parts.append(line[at : m.start()])
            at = m.end()
            name = m.group(2)
            if name is None:
                continue
            tag = name.lower()
            if tag in _BLOCK:
                flush()
                if m.group(1):
                    ops.append((_CLOSE, tag))
                else:
                    # a body's class tells the kind of page, not the template; numbers tell the page
                    attr = _ATTR.search(m.group(3)) if m.group(3) and tag != "body" and tag != "html" else None
                    name = f"{tag}.{re.sub(r'[0-9]+', '', attr.group(1))}" if attr else tag
                    ops.append((_OPEN, tag, hashed("l", name), True, attr is not None, _CLOSES.get(tag, ())))
            elif tag == "hr":
                flush()
                ops.append((_RULE,))
            elif tag == "br":
                flush()
            elif tag in _INLINE:
                if m.group(1):
                    if any(op[0] == _OPEN and op[1] == tag for op in ops):
                        flush()
                        ops.append((_CLOSE, tag))
                elif m.group(3) and not "".join(parts).strip():
                    attr = _ATTR.search(m.group(3))
                    if attr:  # an inline element with a class that opens a run of text is an element of its own
                        parts.clear()
                        ops.append((_OPEN, tag, hashed("l", f"{tag}.{attr.group(1)}"), False, True, ()))
        if at < len(line):
            parts.append(line[at:])
        flush()
        return tuple(ops)


class Page(NamedTuple):
    """A page's units (runs of text) as parallel lists, and its inner subtrees as ranges of units.

    `items` hash the smallest subtree around a unit (all text of its element, as sites set one text in several
    elements; headings and the page's title with their label, so links to a page do not stand for its headline; a
    table's row as a whole), `texts` the text of that element alone, `paths` the chain of elements, `heads` the unit that is the heading of
    the section the unit stands in, -1 if none: a heading owns what follows it up to the next heading, a rule
    or the end of the element around it. `owners` number the smallest subtrees.
    """

    lines: list[int]
    items: list[int]
    texts: list[int]
    paths: list[int]
    flags: list[int]
    heads: list[int]
    chars: list[int]
    owners: list[int]
    strings: list[str]
    marks: list[tuple[Mark, ...]]
    names: set[str]
    trees: list[int]
    starts: list[int]
    stops: list[int]


def page_units(html: str, lines: Lines) -> Page:
    """The units of a page in order, with the hashes of the subtrees they are in."""
    lines.fresh()
    text = HIDDEN.sub(lambda m: "\n" * m.group().count("\n"), html)
    if LONG_TAG.search(text):
        text = LONG_TAG.sub(lambda m: m.group().replace("\n", " ") + "\n" * m.group().count("\n"), text)
    # open elements: (tag, number, heading before it opened); elements by number: place, parent, label, content
    stack: list[tuple[str, int, int]] = [("", 0, -1)]
    place, parent, tags, labels, inner, content = [0], [0], [""], [0], [True], [0]
    unit_line: list[int] = []
    unit_run: list[Run] = []
    unit_in: list[int] = []
    unit_head: list[int] = []
    head = -1
    known, steps = lines.held.get, lines.steps.get
    for number, line in enumerate(text.split("\n"), 1):
        if not line:
            continue
        for op in known(line) or lines(line):
            code = op[0]
            if code == _TEXT:
                tag, k, _ = stack[-1]
                if tag in _HEADING and (not unit_in or unit_in[-1] != k):
                    head = len(unit_in)
                run = op[1]
                x = (content[k] * _ODD + run.hash) & _MASK
                content[k] = ((x ^ x >> 29) * _MORE) & _MASK
                unit_line.append(number)
                unit_run.append(run)
                unit_in.append(k)
                unit_head.append(head)
            elif code == _OPEN:
                _, tag, label, block, classed, closes = op
                while stack[-1][0] in closes:
                    stack.pop()
                above = stack[-1][1]
                if block:
                    inner[above] = True
                k = len(place)
                at = steps((place[above], label))
                place.append(lines.path(place[above], tag, label, classed) if at is None else at)
                parent.append(above)
                tags.append(tag)
                labels.append(label)
                inner.append(False)
                content.append(0)
                stack.append((tag, k, head))
            elif code == _CLOSE:
                tag = op[1]
                for at in range(len(stack) - 1, 0, -1):
                    other = stack[at][0]
                    if other == tag or (tag in _HEADING and other in _HEADING):
                        if tag not in _HEADING:  # a heading inside an element ends with the element
                            head = stack[at][2]
                        del stack[at:]
                        break
                    if tag in _ENDED and other not in _ENDED:
                        break
            else:
                head = -1 if len(stack) <= 3 else stack[-1][2]
        while stack[-1][0] in _ENDED:  # spans and headings left open end with their line
            stack.pop()
    return _hashed_page(html, lines, (place, parent, tags, labels, inner, content), unit_line, unit_run, unit_in, unit_head)


def _hashed_page(html, lines, elements, unit_line, unit_run, unit_in, unit_head) -> Page:
    place, parent, tags, labels, inner, content = elements
    count, n = len(place), len(unit_in)
    first, last = [n] * count, [-1] * count
    whole = [0] * count
    chars = [len(run.text) for run in unit_run]
    for i, k in enumerate(unit_in):
        if i < first[k]:
            first[k] = i
        last[k] = i
        whole[k] += chars[i]
    subtree = content
    rows_inner = [False] * count
    trees, starts, stops = [], [], []
    half = sum(chars) / 2
    for k in range(count - 1, 0, -1):
        x = (subtree[k] * _ODD + labels[k]) & _MASK
        x = subtree[k] = ((x ^ x >> 29) * _MORE) & _MASK
        up = parent[k]
        end = last[k]
        if end >= 0:
            x = ((subtree[up] ^ 1) * _ODD + x) & _MASK
            subtree[up] = ((x ^ x >> 29) * _MORE) & _MASK
            begin = first[k]
            if begin < first[up]:
                first[up] = begin
            if end > last[up]:
                last[up] = end
            whole[up] += whole[k]
            # an inner subtree with several smallest ones; what is most of a page is the page itself, not its template.
            # Of elements around the same units the innermost stands for all.
            if inner[k]:
                rows_inner[up] = True
                if end > begin and whole[k] < half and not (trees and starts[-1] == begin and stops[-1] == end):
                    trees.append(subtree[k])
                    starts.append(begin)
                    stops.append(end)
        elif inner[k]:
            rows_inner[up] = True
    m = _TITLE.search(html[: html.find("<body")] if "<body" in html else html)
    names = set()
    if m:
        title = " ".join(unescape(m.group(1)).split())
        names = {title, *SUFFIX.split(title)} - {""} if title else names
    items, texts, flags, owners, paths = [], [], [], [], []
    i = 0
    while i < n:
        k = own = unit_in[i]
        j = i + 1
        tag = tags[k]
        if inner[k]:  # text between blocks: a subtree of its own
            own = -1 - i
        elif tag in _WHOLE:
            while j < n and unit_in[j] == k:
                j += 1
        elif tag in _CELL:
            up = parent[k]
            if tags[up] == "tr" and not rows_inner[up]:
                # a row of data: two cells with text or more, each on one line
                cells = unit_in[first[up] : last[up] + 1]
                if len(cells) > 1 and len(set(cells)) == len(cells):
                    own = up
                    while j < n and parent[unit_in[j]] == own:
                        j += 1
        run = unit_run[i]
        if j == i + 1:
            text, kind, name = run.hash, run.kind, run.text
        else:
            name = "\n".join(unit_run[x].text for x in range(i, j))
            marks = () if any(not r.marks or not r.marks[0].whole for r in unit_run[i:j]) else run.marks
            text, kind = hashed(name), residue_kind(name, marks)
            name = name.replace("\n", " ")
        titled = name in names
        h = subtree[own] if own > 0 and (own != k or tag in _HEADING) else mixed(text, 1) if titled else text
        bits = kind << KIND | TITLE * titled
        for x in range(i, j):
            at = unit_in[x]
            path, b = lines.paths[place[at]]
            if inner[at]:
                b = b & ~(CLASSED | HEADING) | LOOSE_TEXT
            items.append(h)
            texts.append(text)
            flags.append(b | bits)
            owners.append(own)
            paths.append(path)
        i = j
    marks = [r.marks for r in unit_run]
    if any(marks):
        # code over several lines
        hidden = set()
        for c in _CODE.finditer(html):
            if "\n" in c.group():
                at = html.count("\n", 0, c.start()) + 1
                hidden.update(range(at, at + c.group().count("\n") + 1))
        marks = [() if line in hidden else x for line, x in zip(unit_line, marks)]
    return Page(unit_line, items, texts, paths, flags, unit_head, chars, owners, [r.text for r in unit_run], marks, names, trees, starts, stops)
