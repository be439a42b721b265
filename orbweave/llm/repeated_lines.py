"""Lines repeated across one site's documents: a graph of consecutive lines, its blocks and their removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.pagelines import visible_lines
from orbweave.llm.recurrence import by_site, recurring_items
from orbweave.session import bounded_batches, durable

#: A text is repeated if it is on 4 pages of its site or more and on three tenths of them or more.
LEAST_PAGES, SHARE_TENTHS = 4, 3
_LINES = "site bigint, doc bigint, page bigint, items array<bigint>, lines array<int>"


def line_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, doc, page, text) to the hashes and numbers of the visible lines, two arrays a document."""
    h = xxhash.xxh3_64_intdigest
    for batch in batches:
        flat, numbers, ends = [], [], [0]
        for text in batch.column(3).to_pylist():
            for number, line in visible_lines(text):
                flat.append(h(line.encode("utf-8", "surrogatepass")))
                numbers.append(number)
            ends.append(len(flat))
        offsets = pa.array(np.asarray(ends, dtype=np.int32))
        items = pa.array(np.asarray(flat, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i) for i in range(3)),
                pa.ListArray.from_arrays(offsets, items),
                pa.ListArray.from_arrays(offsets, pa.array(np.asarray(numbers, dtype=np.int32))),
            ],
            ["site", "doc", "page", "items", "lines"],
        )


def site_lines(rows: DataFrame, site: str, doc: str, page: str, text: str) -> DataFrame:
    """The visible lines of all documents with a site and a text, written once.

    `page` becomes a hash; a document with null page is kept with page null and never counts as support.
    """
    bounded_batches(rows.sparkSession)
    source = rows.select(
        F.col(site).cast("bigint").alias("site"),
        F.col(doc).cast("bigint").alias("doc"),
        F.when(F.col(page).isNotNull(), F.xxhash64(page)).alias("page"),
        F.col(text).alias("text"),
    ).filter("site is not null and doc is not null and text is not null")
    return durable(source.mapInArrow(line_arrays, _LINES), "site-lines")


def components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's connected component, for edges between nodes 0 .. n - 1, by label propagation with pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (site, a, b) in the order of sites to (site, item, block): the components of all sites of a batch at once.

    The site that a batch ends in waits for the next; a site's graph is bounded by page length (see recurrence).
    """
    held: pd.DataFrame | None = None

    def named(part: pd.DataFrame) -> pd.DataFrame:
        ends = pd.concat([part[["site", "a"]].rename(columns={"a": "item"}), part[["site", "b"]].rename(columns={"b": "item"})])
        nodes = ends.groupby(["site", "item"], sort=True).ngroup().to_numpy()
        table = ends.assign(node=nodes).drop_duplicates("node").sort_values("node")
        label = components(nodes[: len(part)], nodes[len(part) :], len(table))
        item = table["item"].to_numpy()
        return pd.DataFrame({"site": table["site"].to_numpy(), "item": item, "block": item[label]})

    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf["site"].iloc[-1]
        whole = pdf["site"] != last
        if whole.any():
            yield named(pdf[whole])
        held = pdf[~whole]
    if held is not None and len(held):
        yield named(held)


def line_graph(lines: DataFrame, least: int = LEAST_PAGES, tenths: int = SHARE_TENTHS) -> tuple[DataFrame, DataFrame]:
    """Nodes (site, items, counts) and edges (site, a, b, weight) of high support.

    Nodes are (site, line text) weighted by distinct pages, edges are pairs of lines that follow each other
    in a document, weighted by documents. An edge stays if both its ends do and it is in `least` documents or more.
    """
    kept = recurring_items(lines.filter("page is not null"), least, condition=10 * F.col("c") >= tenths * F.col("n"))
    kept = durable(kept.select("site", "items", "counts"), "kept-lines")
    chosen = by_site(lines.filter("page is not null").select("site", "page", F.col("items").alias("seq")), kept.select("site", "items"), entries="items")
    here = F.expr("array_intersect(seq, items)")
    marked = chosen.select("site", "seq", here.alias("here")).select(
        "site", F.expr("transform(seq, h -> if(array_contains(here, h), h, cast(null as bigint)))").alias("seq")
    )
    follows = F.expr(
        "array_distinct(filter(transform(sequence(1, size(seq) - 1), i -> struct(seq[i - 1] as a, seq[i] as b)),"
        " e -> e.a is not null and e.b is not null))"
    )
    edges = (
        marked.filter("size(seq) > 1")
        .select("site", F.explode(follows).alias("e"))
        .groupBy("site", F.col("e.a").alias("a"), F.col("e.b").alias("b"))
        .agg(F.count("*").alias("weight"))
        .filter(F.col("weight") >= least)
    )
    return kept, durable(edges, "line-edges")


def boilerplate_blocks(lines: DataFrame, least: int = LEAST_PAGES, tenths: int = SHARE_TENTHS) -> DataFrame:
    """(site, items, blocks): the repeated lines of each site, sorted by hash, and the block each belongs to.

    Blocks are the connected components of the line graph, single lines included.
    """
    return _named_blocks(*line_graph(lines, least, tenths))


def _named_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    loops = nodes.select("site", F.explode("items").alias("a")).withColumn("b", F.col("a"))
    pairs = edges.select("site", "a", "b").unionByName(loops).repartition("site").sortWithinPartitions("site")
    return (
        pairs.mapInPandas(_blocks, "site bigint, item bigint, block bigint")
        .groupBy("site")
        .agg(F.sort_array(F.collect_list(F.struct("item", "block"))).alias("x"))
        .select("site", F.col("x.item").alias("items"), F.col("x.block").alias("blocks"))
    )


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, doc, lines, seq, mine, blocks) to (site, doc, block, lines): each run of lines that follow each other in one block."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        lists = {name: batch.column(i) for i, name in enumerate(batch.schema.names) if i > 1}
        row, mine_row = (np.repeat(np.arange(batch.num_rows), np.diff(lists[c].offsets.to_numpy())) for c in ("seq", "mine"))
        lines, seq, mine, blocks = (lists[c].flatten().to_numpy(zero_copy_only=False) for c in ("lines", "seq", "mine", "blocks"))
        wanted, have = (x.astype(np.int64).view(np.uint64) ^ (r.astype(np.uint64) * odd) for x, r in ((seq, row), (mine, mine_row)))
        order = np.argsort(have)
        at = np.minimum(np.searchsorted(have[order], wanted), max(0, len(have) - 1))
        hit = have[order][at] == wanted if len(have) else np.zeros(len(wanted), dtype=bool)
        where = np.flatnonzero(hit)
        block = blocks[order][at[where]] if len(have) else np.empty(0, dtype=np.int64)
        fresh = np.ones(len(where), dtype=bool)
        fresh[1:] = (where[1:] != where[:-1] + 1) | (row[where][1:] != row[where][:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(fresh)
        docs, sites = (batch.column(i).take(pa.array(row[where][first])) for i in (1, 0))
        ends = pa.array(np.append(first, len(where)).astype(np.int32))
        runs = pa.ListArray.from_arrays(ends, pa.array(lines[where].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([sites, docs, pa.array(block[first].astype(np.int64)), runs], ["site", "doc", "block", "lines"])


def block_occurrences(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(site, doc, block, lines): the runs of lines in which blocks, or parts of them, stand in the documents."""
    mine = F.expr("array_intersect(seq, items)")
    found = by_site(lines.select("site", "doc", F.col("items").alias("seq"), "lines"), blocks, key="doc", entries="items").withColumn("mine", mine)
    own = F.expr("transform(mine, h -> blocks[cast(array_position(items, h) - 1 as int)])")
    return found.select("site", "doc", "lines", "seq", "mine", own.alias("blocks")).mapInArrow(
        _occurrences, "site bigint, doc bigint, block bigint, lines array<int>"
    )


def repeated_lines(
    rows: DataFrame, site: str = "catalog_id", doc: str = "id", page: str = "url", text: str = "html",
    least: int = LEAST_PAGES, tenths: int = SHARE_TENTHS,
) -> DataFrame:
    """Every line of every occurrence of a boilerplate block: (doc, line_no int, block bigint), repeated rows included once each.

    A line's visible text is repeated if, in its site, it stands on c >= least distinct pages and
    10 * c >= tenths * n of the n pages. Such lines are the graph's nodes, and each of them is in a block, if only in one of
    its own; so the occurrences of blocks, whole or in part, are all repeated lines. Rows with null site, doc or text are left out; rows with null page
    lend no support but lose their repeated lines too. Blank lines never count. An empty table gives an
    empty result. Texts are told apart by 64 hash bits within a site.
    """
    lines = site_lines(rows, site, doc, page, text)
    found = block_occurrences(lines, durable(boilerplate_blocks(lines, least, tenths), "line-blocks"))
    return found.select(F.col("doc").alias(doc), F.explode("lines").alias("line_no"), "block")


def _block_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, wanted in zip(batch.column(batch.num_columns - 1), batch.column(batch.num_columns - 2).to_pylist()):
            keep = set(wanted)
            texts.append("\n".join(text for number, text in visible_lines(html.as_py()) if number in keep))
        kept = [batch.column(i) for i in range(batch.num_columns - 2)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*batch.schema.names[:-2], "text"])


def repeated_blocks(
    rows: DataFrame, site: str = "catalog_id", doc: str = "id", page: str = "url", text: str = "html",
) -> DataFrame:
    """(site, block, nodes, support, edges, weight, occurrences, text) of every boilerplate block.

    Lines in the block, distinct pages of its most frequent line, its edges of high support and their documents, runs of
    its lines in the documents, and the text of the longest of them (of the first document that has it).
    """
    lines = site_lines(rows, site, doc, page, text)
    nodes, edges = line_graph(lines)
    blocks = durable(_named_blocks(nodes, edges), "line-blocks")
    flat = nodes.select("site", F.explode(F.arrays_zip("items", "counts")).alias("x")).select("site", "x.items", "x.counts").toDF("site", "item", "c")
    member = blocks.select("site", F.explode(F.arrays_zip("items", "blocks")).alias("x")).select("site", "x.items", "x.blocks").toDF("site", "item", "block")
    size = member.join(flat, ["site", "item"]).groupBy("site", "block").agg(F.count("*").alias("nodes"), F.max("c").alias("support"))
    weight = edges.join(member.withColumnRenamed("item", "a"), ["site", "a"]).groupBy("site", "block").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    longest = F.min(F.struct((-F.size("lines")).alias("n"), "doc", "lines"))
    seen = block_occurrences(lines, blocks).groupBy("site", "block").agg(F.count("*").alias("occurrences"), longest.alias("x"))
    known = size.join(weight, ["site", "block"], "left").join(seen, ["site", "block"]).na.fill(0, ["edges", "weight"])
    columns = ["site", "block", "nodes", "support", "edges", "weight", "occurrences"]
    source = rows.select(F.col(doc).cast("bigint").alias("doc"), F.col(site).cast("bigint").alias("site"), F.col(text).alias("html"))
    source = source.join(known.select("site", F.col("x.doc").alias("doc")).distinct(), ["site", "doc"], "left_semi").dropDuplicates(["site", "doc"])
    chosen = known.select(*columns, F.col("x.doc").alias("doc"), F.col("x.lines").alias("lines")).join(source, ["site", "doc"]).select(*columns, "lines", "html")
    schema = "site bigint, block bigint, nodes bigint, support bigint, edges bigint, weight bigint, occurrences bigint, text string"
    return chosen.mapInArrow(_block_texts, schema).withColumnRenamed("site", site)


def _cleaner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = []
        for text, gone in zip(pdf["text"], pdf["gone"]):
            drop = set() if gone is None else set(map(int, gone))
            texts.append("\n".join(line for n, line in enumerate(text.split("\n"), 1) if n not in drop))
        yield pd.DataFrame({"doc": pdf["doc"], "removed": [0 if g is None else len(g) for g in pdf["gone"]], "text": texts})


def without_repeated_lines(
    rows: DataFrame, site: str = "catalog_id", doc: str = "id", page: str = "url", text: str = "html",
) -> DataFrame:
    """(doc, removed, text): each document with a text, less its repeated lines; the others word for word."""
    gone = repeated_lines(rows, site, doc, page, text).groupBy(doc).agg(F.collect_set("line_no").alias("gone"))
    source = rows.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    return (
        source.join(gone.withColumnRenamed(doc, "doc"), "doc", "left")
        .mapInPandas(_cleaner, "doc bigint, removed int, text string")
        .withColumnRenamed("doc", doc)
        .withColumnRenamed("text", text)
    )
