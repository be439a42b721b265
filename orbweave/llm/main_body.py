"""Main body of web pages: site templates found by recurring element subtrees, and their removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.blocks import CLASSED, CONTENT, EDGE, FRAME, HEADING, KIND, LOOSE_TEXT, TITLE, Lines, page_units
from orbweave.llm.recurrence import by_site, recurring_items
from orbweave.llm.residue_text import marks_in
from orbweave.session import bounded_batches, durable

#: The smallest subtree around a text is template if it is on 3 pages of its host or more and on this share of them, or
#: on 2 and a tenth; a larger one if it is on 3 and on this share.
LEAST_PAGES, SHARE, SURE_SHARE, TREE_SHARE = 2, 0.02, 0.1, 0.005
#: An element place whose texts do not recur is template if it is on so large a share of the host's pages and stands
#: in nav, aside or footer, or has a class, so few units a page and so few characters a unit.
PLACE_SHARE, PLACE_UNITS, PLACE_CHARS = 0.1, 1.5, 100
#: Share of template under one place from which a unit of it that does not recur is template too, if its element
#: says so, or it is shorter than so many characters and stands among template.
PATH_SHARE, PATH_CHARS = 0.93, 200
#: Share of a place's remaining units that are their page's title from which it is a place of headlines.
HEADLINE_SHARE = 0.3
#: Hosts on which a text has to remain to be an error page's, and the share of the corpus' median of remaining
#: characters below which a page is compared with those texts.
#: A single text without a headline is no article below the other share.
ERROR_HOSTS, THIN_SHARE, LONE_SHARE = 3, 0.5, 0.2
#: Pages marked at once.
SLICE = 512
_ARRAYS = (
    "items array<bigint>, texts array<bigint>, paths array<bigint>, flags array<int>, heads array<int>, lines array<int>, chars array<int>,"
    " trees array<bigint>, starts array<int>, stops array<int>"
)
_RESIDUE = (
    "title string, shown boolean, marks array<struct<token: string, name: string, style: string, strong: boolean, whole: boolean, edge: boolean>>"
)
_PAGES = f"host bigint, catalog_id bigint, doc bigint, page bigint, {_ARRAYS}"
_REST = (
    "site bigint, doc bigint, units int, lines array<int>, texts array<bigint>, chars array<int>, flags array<int>, paths array<bigint>,"
    " loose array<boolean>, places array<bigint>, place_flags array<int>, n array<int>, gone array<int>, left_chars array<int>, titles array<int>"
)


def _lists(ends: list[int], values, kind: pa.DataType) -> pa.ListArray:
    if kind == pa.int64():
        flat = pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))
    else:
        flat = pa.array(np.asarray(values), kind)
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), flat)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _unit_arrays(residue: bool):
    """(host, catalog_id, doc, page, title, html) to ten arrays over the page's units and inner subtrees, with `residue` also the
    title, whether the page shows it, and the variables in title and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines()
        names = ["items", "texts", "paths", "flags", "heads", "lines", "chars"]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                ends, tree_ends = [0], [0]
                columns: dict[str, list[int]] = {name: [] for name in [*names, "trees", "starts", "stops"]}
                titles, shown, marks = [], [], []
                for title, html in zip(batch.column(4), batch.column(5)):
                    page = page_units(html.as_py() or "", lines)
                    for name in columns:
                        columns[name].extend(getattr(page, name))
                    ends.append(len(columns["lines"]))
                    tree_ends.append(len(columns["trees"]))
                    if residue:
                        title = " ".join((title.as_py() or "").split())
                        titles.append(title or None)
                        lettered = any(map(str.isalnum, title))
                        shown.append(bool(title) and any(title in text if lettered else title == text for text in page.strings))
                        # a variable counts once a record
                        found: dict[str, dict] = {}
                        for own in (marks_in(title), *page.marks):
                            for x in own:
                                held = found.setdefault(x.token, x._asdict())
                                held["whole"] |= x.whole
                                held["edge"] |= x.edge
                        marks.append(list(found.values()))
                # trees end in a 1 bit, the smallest subtrees do not
                columns["items"] = np.array(columns["items"], dtype=np.uint64) & ~np.uint64(1)
                columns["trees"] = np.array(columns["trees"], dtype=np.uint64) | np.uint64(1)
                wide = {"items", "texts", "paths", "trees"}
                arrays = [
                    _lists(ends if name in names else tree_ends, columns[name], pa.int64() if name in wide else pa.int32()) for name in columns
                ]
                out = ["host", "catalog_id", "doc", "page", *columns]
                if residue:
                    kind = pa.list_(pa.struct([*((n, pa.string()) for n in ("token", "name", "style")), *((n, pa.bool_()) for n in ("strong", "whole", "edge"))]))
                    arrays += [pa.array(titles, pa.string()), pa.array(shown, pa.bool_()), pa.array(marks, kind)]
                    out += ["title", "shown", "marks"]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *arrays], out)

    return run


def page_key(url):
    """What counts as one page: the path without host, case, closing slashes, fragment and referral marks."""
    bare = F.regexp_replace(F.lower(url), r"^[a-z]+://[^/?#]*|#.*$", "")
    return F.xxhash64(F.regexp_replace(F.regexp_replace(bare, r"(?<=[?&])(ref|utm_[a-z]+)=[^&]*&?", ""), r"[/?&]+$", ""))


def host_of(url):
    """Host of an absolute url, null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z]+://(?:www\d*\.)*([^/?#:]+)", 1)
    return F.when(host != "", host)


def page_arrays(rows: DataFrame, catalogs: DataFrame | None, residue: bool = False) -> DataFrame:
    """Units of all pages with html, parsed and written once. The site is the page's host, without url that of its catalog.

    With `residue` also titles and variables, and a null html is an empty page.

    Hosts of catalogs meet the few pages without one after parsing, so html is neither shuffled nor read twice.
    """
    bounded_batches(rows.sparkSession)
    host = host_of(F.col("url"))
    source = rows.filter("id is not null" + " and html is not null" * (not residue)).select(
        F.when(host.isNotNull(), F.xxhash64(host)).alias("host"), F.col("catalog_id").cast("bigint").alias("catalog_id"),
        F.col("id").cast("bigint").alias("doc"), F.coalesce(page_key(F.col("url")), F.xxhash64("id")).alias("page"),
        (F.col("title") if residue else F.lit(None)).cast("string").alias("title"), "html",
    )
    pages = durable(source.mapInArrow(_unit_arrays(residue), f"{_PAGES}, {_RESIDUE}" if residue else _PAGES), "page-units")
    known, homeless = pages.filter("host is not null"), pages.filter("host is null").drop("host")
    own = F.xxhash64(F.coalesce(F.col("catalog_id").cast("string"), F.lit("")))
    if catalogs is not None:
        sites = catalogs.select(F.col("id").cast("bigint").alias("catalog_id"), host_of(F.col("url")).alias("host")).groupBy("catalog_id").agg(F.min("host").alias("host"))
        homeless = homeless.join(sites.withColumn("host", F.xxhash64("host")).filter("host is not null"), "catalog_id", "left")
        homeless = homeless.withColumn("host", F.coalesce("host", own))
    else:
        homeless = homeless.withColumn("host", own)
    return known.unionByName(homeless).withColumnRenamed("host", "site").drop("catalog_id")


def site_templates(pages: DataFrame) -> DataFrame:
    """(site, tpl): hashes of the subtrees that recur on many pages of their site."""
    both = pages.select("site", "page", F.expr("array_union(items, trees)").alias("items"))
    c, n = F.col("c"), F.col("n")
    tree = F.pmod("item", F.lit(2)) == 1
    recurs = (c > LEAST_PAGES) & (c >= F.when(tree, TREE_SHARE).otherwise(SHARE) * n) | (~tree & (c >= SURE_SHARE * n))
    found = recurring_items(both, LEAST_PAGES, condition=recurs)
    return durable(found.select("site", F.col("items").alias("tpl")), "site-templates")


def _flat(batch: pa.RecordBatch, name: str, owners: str | None = None) -> np.ndarray:
    """The values of a list column, end to end (with `owners`: the row of each)."""
    column = batch.column(batch.schema.get_field_index(name))
    if owners:
        return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return column.flatten().to_numpy(zero_copy_only=False)


def _marks(batch: pa.RecordBatch) -> np.ndarray:
    """Which units of some pages are in a subtree that recurs, or below a heading that does. `mine`: the page's recurring hashes."""
    row, items = _flat(batch, "items", "rows"), _flat(batch, "items")
    tree_row, mine_row = _flat(batch, "trees", "rows"), _flat(batch, "mine", "rows")
    odd = np.uint64(0x9E3779B97F4A7C15)

    def key(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values.astype(np.int64).view(np.uint64) ^ (rows.astype(np.uint64) * odd)

    mine = key(mine_row, _flat(batch, "mine"))
    gone = np.isin(key(row, items), mine)
    starts = np.searchsorted(row, np.arange(batch.num_rows))
    heads = _flat(batch, "heads")
    below = heads >= 0
    headed = np.zeros(len(gone), dtype=bool)
    headed[below] = gone[heads[below] + starts[row[below]]]
    inside = np.isin(key(tree_row, _flat(batch, "trees")), mine)
    edges = np.zeros(len(gone) + 1, dtype=np.int32)
    np.add.at(edges, _flat(batch, "starts")[inside] + starts[tree_row[inside]], 1)
    np.add.at(edges, _flat(batch, "stops")[inside] + starts[tree_row[inside]] + 1, -1)
    return gone | headed | (np.cumsum(edges)[:-1] > 0)


def rest_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page arrays with `mine` to what is left of each page, and counts of its places."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            # slices share their parent's values: take makes lists of their own
            batch = batch.take(pa.array(np.arange(batch.num_rows)))
            yield _rest(batch)


def _rest(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows, row = batch.num_rows, _flat(batch, "items", "rows")
    gone = _marks(batch)
    paths, flags, chars = _flat(batch, "paths"), _flat(batch, "flags"), _flat(batch, "chars")
    n = len(gone)
    # neighbours on the same page; beyond its ends there is template
    same_left = np.zeros(n, dtype=bool)
    same_left[1:] = row[1:] == row[:-1]
    same_right = np.zeros(n, dtype=bool)
    same_right[:-1] = same_left[1:]
    left_gone, right_gone = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    left_gone[1:] = ~same_left[1:] | gone[:-1]
    right_gone[:-1] = ~same_right[:-1] | gone[1:]
    kin = np.zeros(n, dtype=bool)
    kin[1:] |= same_left[1:] & (paths[1:] == paths[:-1])
    kin[:-1] |= same_right[:-1] & (paths[1:] == paths[:-1])
    loose = ((flags & (EDGE | CLASSED)) > 0) | ((chars < PATH_CHARS) & left_gone & right_gone & kin)
    # what stands beside template in a nav, aside or footer is in it too
    framed = (flags & FRAME) > 0
    beside = np.zeros(n, dtype=bool)
    beside[1:] |= same_left[1:] & gone[:-1] & framed[:-1]
    beside[:-1] |= same_right[:-1] & gone[1:] & framed[1:]
    gone = gone | (framed & beside)
    kept = np.flatnonzero(~gone)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=rows))])
    # counts by page and place
    order = np.lexsort((paths, row))
    new = np.ones(n, dtype=bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (paths[order][1:] != paths[order][:-1])
    group = np.cumsum(new) - 1
    size = int(group[-1]) + 1 if n else 0
    total = lambda x: np.bincount(group, x[order], size).astype(np.int32)
    first = order[new]
    place_ends = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=rows))])
    left = (~gone).astype(np.int64)
    # a subtree of several units is its page's title once
    arrays = {
        "lines": (ends, _flat(batch, "lines")[kept]), "texts": (ends, _flat(batch, "texts")[kept]), "chars": (ends, chars[kept]),
        "flags": (ends, flags[kept]), "paths": (ends, paths[kept]), "loose": (ends, loose[kept]),
        "places": (place_ends, paths[first]), "place_flags": (place_ends, flags[first] & ((1 << KIND) - 1 - TITLE)),
        "n": (place_ends, total(np.ones(n))), "gone": (place_ends, total(gone.astype(np.int64))), "left_chars": (place_ends, total(chars * left)),
        "titles": (place_ends, total(left * ((flags & TITLE) > 0))),
    }
    lists = [pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v)) for e, v in arrays.values()]
    units = pa.array(np.bincount(row, minlength=rows).astype(np.int32))
    out = [batch.column(batch.schema.get_field_index("site")), batch.column(batch.schema.get_field_index("doc")), units, *lists]
    return pa.RecordBatch.from_arrays(out, ["site", "doc", "units", *arrays])


def page_rests(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """What is left of each page outside recurring subtrees, and counts of its element places, written once."""
    joined = by_site(pages, templates, "left", entries="tpl")
    mine = F.coalesce(F.expr("array_intersect(array_union(items, trees), tpl)"), F.expr("cast(array() as array<bigint>)"))
    marked = joined.withColumn("mine", mine).select(
        "site", "doc", "items", "texts", "paths", "flags", "heads", "lines", "chars", "trees", "starts", "stops", "mine"
    )
    return durable(marked.mapInArrow(rest_arrays, _REST), "page-rest")


def place_rules(rests: DataFrame) -> DataFrame:
    """(site, mostly, shaped, headlines): places of a site that are mostly template, that are it by their shape, and
    that hold headlines."""
    rows = rests.groupBy("site").agg(F.count("*").alias("rows"))
    each = F.explode(F.arrays_zip("places", "place_flags", "n", "gone", "left_chars", "titles")).alias("p")
    counted = (
        rests.select("site", each)
        .groupBy("site", F.col("p.places").alias("path"))
        .agg(
            F.count("*").alias("on"), F.bit_and("p.place_flags").alias("flags"), F.sum("p.n").alias("n"), F.sum("p.gone").alias("gone"),
            F.sum("p.left_chars").alias("chars"), F.sum("p.titles").alias("titles"),
        )
        .filter("on >= 2")
    )
    has = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    left = F.col("n") - F.col("gone")
    small = has(CLASSED) & ~has(CONTENT) & (F.col("n") <= PLACE_UNITS * F.col("on")) & (F.col("chars") < PLACE_CHARS * left)
    return (
        by_site(counted, rows, key="path")
        .select(
            "site", "path",
            ((F.col("gone") >= 2) & (F.col("gone") >= PATH_SHARE * F.col("n"))).alias("mostly"),
            ((F.col("on") >= PLACE_SHARE * F.col("rows")) & (has(FRAME) | small)).alias("shaped"),
            ((F.col("titles") >= 2) & (F.col("titles") >= HEADLINE_SHARE * left) & ~has(LOOSE_TEXT)).alias("headline"),
        )
        .filter("mostly or shaped or headline")
        .groupBy("site")
        .agg(*(F.collect_list(F.when(F.col(c), F.col("path"))).alias(c) for c in ("mostly", "shaped", "headline")))
    )


def leftovers(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """(site, doc, units, rest): the page's number of units, and those outside the site's template."""
    rests = page_rests(pages, templates)
    rules = durable(place_rules(rests), "place-rules")
    joined = by_site(rests.select("site", "doc", "units", "lines", "texts", "chars", "flags", "paths", "loose"), rules, "left", key="doc", entries="mostly")
    here = {c: F.coalesce(F.expr(f"array_intersect({c}, paths)"), F.expr("cast(array() as array<bigint>)")) for c in ("mostly", "shaped", "headline")}
    rest = F.expr(
        "transform(filter(sequence(0, size(lines) - 1), i -> not array_contains(shaped, paths[i]) and not (loose[i] and array_contains(mostly, paths[i]))),"
        f" i -> struct(lines[i] as line_no, texts[i] as item, chars[i] as chars, shiftright(flags[i], {KIND}) as residue,"
        f" (flags[i] & {HEADING | TITLE}) > 0 or array_contains(headline, paths[i]) as headline, paths[i] as path))"
    )
    none = F.expr(
        "cast(array() as array<struct<line_no: int, item: bigint, chars: int, residue: int, headline: boolean, path: bigint>>)"
    )
    return joined.withColumns(here).select("site", "doc", "units", F.when(F.size("lines") > 0, rest).otherwise(none).alias("rest"))


def _once(left: DataFrame) -> DataFrame:
    """(site, doc, items, size): texts left, and their characters, each text counted once."""
    once = F.expr("aggregate(array_distinct(transform(rest, u -> struct(u.item as item, u.chars as chars))), 0, (a, u) -> a + u.chars)")
    return left.filter(F.size("rest") > 0).select("site", "doc", F.expr("array_distinct(rest.item)").alias("items"), once.alias("size"))


def error_texts(left: DataFrame, thin: float) -> DataFrame:
    """(doc, errors): the texts of pages thinner than `thin` that also remain on such pages of other hosts: error pages and notices."""
    texts = _once(left).filter(F.col("size") < thin).select("site", "doc", F.explode("items").alias("item"))
    common = texts.select("site", "item").distinct().groupBy("item").agg(F.count("*").alias("hosts")).filter(F.col("hosts") >= ERROR_HOSTS)
    return texts.join(common.select("item"), "item").groupBy("doc").agg(F.collect_set("item").alias("errors"))


def judged(left: DataFrame) -> DataFrame:
    """(site, doc, units, rest, lines, content, all_chars): lines left, and characters of real and of all text left.

    Thin is measured by the corpus' median of what is left on a page; that one number comes to the driver.
    """
    median = _once(left).agg(F.percentile_approx("size", 0.5, 1000)).first()[0] or 0
    marked = left.join(error_texts(left, THIN_SHARE * median), "doc", "left")
    marked = marked.withColumn("errors", F.coalesce("errors", F.expr("cast(array() as array<bigint>)")))
    real = "filter(rest, u -> u.residue = 0 and not array_contains(errors, u.item))"
    total = "aggregate({}, 0, (a, u) -> a + u.chars)"
    # neither a headline alone nor a short text without one is a main body
    lone = f"not exists(rest, u -> u.headline) and size(array_distinct(rest.item)) = 1 and {total.format('rest')} < {LONE_SHARE * median}D"
    return marked.withColumn("real", F.expr(real)).select(
        "site", "doc", "units", "rest",
        F.expr("rest.line_no").alias("lines"),
        F.expr(f"if(exists(real, u -> not u.headline) and not ({lone}), {total.format('real')}, 0)").alias("content"),
        F.expr(total.format("rest")).alias("all_chars"),
    )


def page_bodies(pages: DataFrame) -> DataFrame:
    """`judged` over the units of pages: count subtrees, mark, and judge what is left."""
    return judged(durable(leftovers(pages, site_templates(pages)), "page-left"))


def main_lines(rows: DataFrame, catalogs: DataFrame | None = None) -> DataFrame:
    """Lines of each page's main body: (id, line_no int).

    Element subtrees (label, children and text, hashed bottom-up) are counted per host on distinct pages; all that lies
    in a recurring one is template, and so is what a recurring heading opens. Of places (chains of labels)
    whose texts differ from page to page those are template that stand in nav, aside or footer, or have a class and hold one
    short text a page (bylines, mottos), never headings, list items, cells, quotes or captions; and what is short among template
    under a place of template. Where what is left is chiefly an error message, filler or placeholders,
    or nothing but a headline, there is no main body; otherwise all that is left counts, single
    placeholders included. Rows with null id or html, and pages without visible text, give no lines; a
    null url counts as a page of its own; a row stored twice gives its lines twice; extra columns are
    never read. An empty table gives an empty result.
    """
    kept = page_bodies(page_arrays(rows, catalogs)).filter("2 * content > all_chars")
    return kept.select(F.col("doc").alias("id"), F.explode(F.array_distinct("lines")).alias("line_no"))


def _body_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines = Lines()
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            texts = []
            for html, wanted in zip(batch.column(1), batch.column(2).to_pylist()):
                page = page_units(html.as_py(), lines)
                keep = {(u["line_no"], u["path"], u["item"]) for u in wanted}
                signed = map(_signed, page.texts), map(_signed, page.paths)
                chosen: list[list[str]] = []
                last = None
                for n, item, path, text in zip(page.lines, *signed, page.strings):
                    if (n, path, item) in keep:
                        if n != last:
                            chosen.append([])
                        chosen[-1].append(text)
                        last = n
                texts.append("\n".join(" ".join(line) for line in chosen))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])


def main_texts(rows: DataFrame, catalogs: DataFrame | None = None) -> DataFrame:
    """(id, text): the main body of each page, element by element, one line per line of html; pages without one are left out.

    It is cut at elements, so a page written on one line loses its template too.
    """
    bounded_batches(rows.sparkSession)
    bodies = page_bodies(page_arrays(rows, catalogs)).filter("2 * content > all_chars").select(F.col("doc").alias("id"), "rest")
    bodies = bodies.groupBy("id").agg(F.first("rest").alias("rest"))
    pages = rows.select(F.col("id").cast("bigint").alias("id"), "html").filter("id is not null and html is not null")
    return pages.join(bodies, "id").select("id", "html", "rest").mapInArrow(_body_texts, "id bigint, text string")


def main_contents(docs: DataFrame, rows: DataFrame, catalogs: DataFrame | None = None) -> DataFrame:
    """(id, content): search documents with nothing but their page's main body, on one line; null without one."""
    texts = main_texts(rows, catalogs).groupBy("id").agg(F.max("text").alias("text"))
    joined = docs.select(F.col("id").cast("bigint").alias("id")).filter("id is not null").join(texts, "id", "left")
    return joined.select("id", F.regexp_replace("text", r"\s+", " ").alias("content"))
