"""Long spans that stand verbatim in more than one text: a compacted de Bruijn graph over sampled k-mers.

Tokens are code points. Of all k-mers (edges of the de Bruijn graph) those are kept that are minimal in some
window of W consecutive ones; as SPAN = K + W - 1, every span of SPAN code points holds at least one kept
k-mer, the same one wherever the span stands. Kept k-mers that stand in two different texts follow each
other along the texts; runs without branches are compacted to paths through joins on successor and
predecessor. Their source coordinates are then read again: a path of SPAN code points or more is hashed as a
whole from the text, around a shorter one all SPAN-mers that hold it are compared. So every span is verified by 128 bits
of the text itself, whatever the 64 bits of a k-mer say, and no pair is tried that does not share one.

Texts that are equal as a whole count once throughout and are expanded at the very end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.session import durable

#: Code points of a shared span, of a k-mer, and k-mers of a window; SPAN = K + W - 1.
SPAN, K = 200, 110
W = SPAN - K + 1
#: Code points hashed at once; longer texts are hashed alone.
CHUNK = 400_000
#: Members of a group that meet in one task when its pairs are made.
BLOCK = 1000

_R1, _R2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(max(n, CHUNK + 1), np.uint64(base), dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64, public domain)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    """Hash of every run of `size` code points, by differences of one prefix sum."""
    up, down = powers.upto(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(0x51ED2701)) * up, dtype=np.uint64, out=sums[1:])
    return (sums[size:] - sums[:-size]) * down[: len(codes) - size + 1]


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the code points from `begin` to `end`, whatever their number, by the same prefix sum."""
    up, down = powers.upto(len(codes))
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(0x51ED2701)) * up, dtype=np.uint64, out=sums[1:])
    return (sums[end] - sums[begin]) * down[begin]


def sliding(a: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every w consecutive values, in linear time."""
    op = np.minimum if least else np.maximum
    n = len(a)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max if least else 0, dtype=np.uint64)
    padded[:n] = a
    grid = padded.reshape(blocks, w)
    forward = op.accumulate(grid, axis=1).ravel()
    backward = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(backward[: n - w + 1], forward[w - 1 : n])


def kept_grams(codes: np.ndarray, lengths: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the kept k-mers of some texts of SPAN code points or more, laid end to end."""
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    h = mixed(gram_hashes(codes, K, powers))
    whole = owner[: len(h)] == owner[K - 1 :]
    values = np.where(whole, h, np.iinfo(np.uint64).max)
    lowest = sliding(values, W, True)
    inside = owner[: len(lowest)] == owner[SPAN - 1 :]
    lowest = np.where(inside, lowest, 0)
    # a k-mer is kept if it is the minimum of some window within its text: the largest minimum around it is its own
    around = np.zeros(len(h) + W - 1, dtype=np.uint64)
    around[W - 1 : W - 1 + len(lowest)] = lowest
    chosen = np.flatnonzero((sliding(around, W, False)[: len(h)] == h) & whole)
    return chosen, h[chosen]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers(_R1)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        group: list[np.ndarray] = []
        tids: list[int] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if group:
                lengths = np.array([len(g) for g in group])
                with np.errstate(over="ignore"):
                    at, h = kept_grams(np.concatenate(group), lengths, powers)
                starts = np.concatenate([[0], np.cumsum(lengths)])
                owner = np.searchsorted(starts, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(np.asarray(tids, dtype=np.int64)[owner]), pa.array((at - starts[owner]).astype(np.int32))],
                    ["h", "tid", "pos"],
                )

        for tid, text in zip(ids, texts):
            codes = code_points(text)
            if size + len(codes) > CHUNK:
                yield from flush()
                group, tids, size = [], [], 0
            group.append(codes)
            tids.append(tid)
            size += len(codes)
        yield from flush()


def _windows(every: bool):
    """(tid, text, starts, stops) to (w1, w2, size, tid, pos): long stretches as a whole and SPAN-mers that hold a whole short
    one, or (`every`) all SPAN-mers that share a k-mer with any stretch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Powers(_R1), Powers(_R2)
        for batch in batches:
            for tid, text, starts, stops in zip(*(c.to_pylist() for c in batch.columns)):
                codes = code_points(text)
                last = len(codes) - SPAN
                whole = [] if every else [(s, e) for s, e in zip(starts, stops) if e - s >= SPAN]
                if every:
                    ranges = [(s - (SPAN - K), e - K) for s, e in zip(starts, stops)]
                else:
                    ranges = [(e - SPAN, s) for s, e in zip(starts, stops) if e - s < SPAN]
                spans = [np.arange(max(0, a), min(b, last) + 1) for a, b in ranges]
                at = np.unique(np.concatenate(spans)) if spans else np.empty(0, dtype=np.int64)
                begin = np.concatenate([[s for s, _ in whole], at]).astype(np.int64)
                end = np.concatenate([[e for _, e in whole], at + SPAN]).astype(np.int64)
                with np.errstate(over="ignore"):
                    w1, w2 = (mixed(span_hashes(codes, begin, end, p)).view(np.int64) for p in (one, two))
                columns = [pa.array(w1), pa.array(w2), pa.array((end - begin).astype(np.int32)), pa.array(np.full(len(begin), tid)), pa.array(begin.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["w1", "w2", "size", "tid", "pos"])

    return cut


def _texts(rows: DataFrame, doc: str, text: str) -> DataFrame:
    return (
        rows.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
        .filter(F.col("doc").isNotNull() & (F.length("text") >= SPAN))
        .withColumn("tid", F.xxhash64("text"))
    )


def shared_paths(texts: DataFrame) -> DataFrame:
    """(tid, start, stop): occurrences of compacted paths of k-mers that two different texts share."""
    grams = durable(texts.select("tid", "text").mapInArrow(_kept, "h bigint, tid bigint, pos int"), "kept-grams")
    common = grams.groupBy("h").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).filter("a <> b").select("h")
    hits = durable(grams.join(common, "h", "left_semi").dropDuplicates(["tid", "pos"]), "common-grams")
    along = Window.partitionBy("tid").orderBy("pos")
    step = F.struct(F.col("h").alias("to"), F.col("pos").alias("by"))
    after, before = F.lead(step).over(along), F.lag(step).over(along)
    none = F.struct(F.lit(0).cast("bigint").alias("to"), F.lit(-1).alias("by"))
    linked = (
        hits.withColumns({"after": after, "before": before})
        .withColumn("after", F.coalesce(F.when(F.col("after.to").isNotNull(), F.struct(F.col("after.to").alias("to"), (F.col("after.by") - F.col("pos")).alias("by"))), none))
        .withColumn("before", F.coalesce(F.when(F.col("before.to").isNotNull(), F.struct(F.col("before.to").alias("to"), (F.col("pos") - F.col("before.by")).alias("by"))), none))
    )
    ways = (
        linked.groupBy("h")
        .agg(F.min("after").alias("a"), F.max("after").alias("b"), F.min("before").alias("c"), F.max("before").alias("d"))
        .select("h", ((F.col("a") == F.col("b")) & (F.col("a.by") >= 0)).alias("one_out"), ((F.col("c") == F.col("d")) & (F.col("c.by") >= 0)).alias("one_in"))
    )
    # k-mers further apart than K do not overlap, so what stands between them is not known to be equal
    near = F.coalesce(F.col("pos") - F.lag("pos").over(along) <= K, F.lit(False))
    joined = hits.join(ways, "h").withColumn("inner", near & F.col("one_in") & F.coalesce(F.lag("one_out").over(along), F.lit(False)))
    return (
        joined.withColumn("path_no", F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(along))
        .groupBy("tid", "path_no")
        .agg(F.min("pos").alias("start"), F.max("pos").alias("last"))
        .select("tid", "start", (F.col("last") + K).alias("stop"))
    )


def span_windows(texts: DataFrame, stretches: DataFrame, every: bool = False) -> DataFrame:
    """(w1, w2, size, tid, pos), 128 hash bits read from the source coordinates of stretches (tid, start, stop).

    A stretch of SPAN code points or more is hashed as a whole; texts that share a shorter one and SPAN code points around it
    share a SPAN-mer that holds it whole. With `every` all SPAN-mers that hold a k-mer of a stretch, so that all
    shared code points are covered.
    """
    wanted = stretches.groupBy("tid").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    first = texts.groupBy("tid").agg(F.min("doc").alias("doc"))  # one copy of each text is read
    chosen = wanted.join(first, "tid").select("doc", "starts", "stops")
    schema = "w1 bigint, w2 bigint, size int, tid bigint, pos int"
    return texts.join(chosen, "doc").select("tid", "text", "starts", "stops").mapInArrow(_windows(every), schema)


def span_classes(texts: DataFrame) -> DataFrame:
    """(k1, k2, tid): spans that several texts share, with the texts that hold them.

    Neighbouring windows mostly have the same texts: of all spans with one set of texts a single one stays, so every
    two texts that share a span are together in a class. This is the operator's compact form; pairs are made from it.
    """
    windows = durable(span_windows(texts, shared_paths(texts)).select("w1", "w2", "size", "tid"), "span-windows")
    keyed = windows.select(F.xxhash64("w1", "size").alias("k1"), F.xxhash64("w2", "size", F.lit(9)).alias("k2"), "tid").distinct()
    sets = (
        keyed.groupBy("k1", "k2")
        .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64("tid", F.lit(5))).alias("y"))
        .filter("n > 1")
        .groupBy("n", "x", "y")
        .agg(F.min(F.struct("k1", "k2")).alias("k"))
        .select("k.k1", "k.k2")
    )
    return durable(keyed.join(sets, ["k1", "k2"], "left_semi"), "span-members")


def pairs_within(members: DataFrame, keys: list[str], member: str) -> DataFrame:
    """All (a, b), a < b, of members of one group, each pair once a group.

    A group of n members is cut into n / BLOCK blocks by hash, and each two of its blocks meet in a task of their own: no task
    makes more than about BLOCK * BLOCK pairs, however large the group.
    """
    sizes = members.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = members.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(member, F.lit(7)), F.col("blocks")).cast("int"))
    left = cut.select(*keys, F.col(member).alias("a"), F.col("block").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))
    right = cut.select(*keys, F.col(member).alias("b"), F.col("block").alias("j"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"))
    return left.join(right, [*keys, "i", "j"]).filter("a < b").select(*keys, "a", "b")


def shared_pairs(rows: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs (doc_1, doc_2), doc_1 < doc_2, of records that share SPAN code points or more in one stretch.

    Every character counts, line breaks included. Null or shorter texts are in no pair; repeats inside one
    record do not count; records with equal texts of SPAN code points pair up; repeated rows with one id
    give no pair with themselves; extra columns are never read; an empty table gives an empty result. Equal
    stretches are told by 128 hash bits of the text, equal texts by 64.
    """
    texts = _texts(rows, doc, text)
    between = pairs_within(span_classes(texts), ["k1", "k2"], "tid").select("a", "b").distinct()
    docs = durable(texts.select("tid", "doc").distinct(), "text-ids")
    left, right = docs.toDF("a", "d1"), docs.toDF("b", "d2")
    between = between.join(left, "a").join(right, "b").select("d1", "d2")
    copies = pairs_within(docs, ["tid"], "doc").select(F.col("a").alias("d1"), F.col("b").alias("d2"))
    return (
        between.unionByName(copies)
        .select(F.least("d1", "d2").alias(f"{doc}_1"), F.greatest("d1", "d2").alias(f"{doc}_2"))
        .filter(F.col(f"{doc}_1") < F.col(f"{doc}_2"))
        .distinct()
    )


def shared_classes(rows: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(class_id, members, doc): classes of records that hold one and the same span, one row a record and class.

    Records with equal texts are in the classes of their text, and make up a class of their own if in no other.
    """
    texts = _texts(rows, doc, text)
    docs = durable(texts.select("tid", "doc").distinct(), "text-ids")
    spans = span_classes(texts).select(F.xxhash64("k1", "k2").alias("class_id"), "tid")
    copies = docs.groupBy("tid").agg(F.count("*").alias("n")).filter("n > 1").join(spans, "tid", "left_anti").select(F.col("tid").alias("class_id"), "tid")
    held = durable(spans.unionByName(copies).join(docs, "tid").select("class_id", F.col("doc").alias(doc)), "class-members")
    return held.join(held.groupBy("class_id").agg(F.count("*").alias("members")), "class_id").select("class_id", "members", doc)


def shared_stretches(rows: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, stop): the longest stretches of each record (code points from 0, stop not included) all of whose code points
    are in a span of SPAN or more that another record has too. Of repeated rows with one id and text one counts."""
    texts = _texts(rows, doc, text)
    windows = durable(span_windows(texts, shared_paths(texts), True).drop("size"), "span-windows")
    common = windows.groupBy("w1", "w2").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).filter("a <> b")
    along = Window.partitionBy("tid").orderBy("pos")
    runs = (
        windows.join(common, ["w1", "w2"], "left_semi")
        .select("tid", "pos")
        .distinct()
        .withColumn("new", F.when(F.col("pos") - F.lag("pos").over(along) <= SPAN, 0).otherwise(1))
        .withColumn("run", F.sum("new").over(along))
        .groupBy("tid", "run")
        .agg(F.min("pos").alias("start"), (F.max("pos") + SPAN).alias("stop"))
    )
    docs = durable(texts.select("tid", "doc", F.length("text").alias("n")).distinct(), "text-ids")
    copies = docs.groupBy("tid").agg(F.count("*").alias("copies"), F.max("n").alias("n")).filter("copies > 1")
    whole = copies.select("tid", F.lit(0).alias("start"), F.col("n").alias("stop"))
    found = runs.drop("run").join(copies.select("tid"), "tid", "left_anti").unionByName(whole)
    return docs.join(found, "tid").select(F.col("doc").alias(doc), "start", "stop")


def shared_amounts(rows: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_chars, shared_chars, shared_share) of every record with a non-null id.

    `shared_chars` counts the code points inside stretches of SPAN or more that another record has too; a
    record whose whole text another record has is shared throughout. Null and short texts share nothing.
    """
    covered = shared_stretches(rows, doc, text).groupBy(doc).agg(F.sum(F.col("stop") - F.col("start")).alias("covered"))
    known = rows.select(F.col(doc).cast("bigint").alias(doc), F.length(text).alias("n")).filter(F.col(doc).isNotNull())
    return (
        known.join(covered, doc, "left")
        .select(doc, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_chars"), F.coalesce("covered", F.lit(0)).cast("bigint").alias("shared_chars"))
        .withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
    )
