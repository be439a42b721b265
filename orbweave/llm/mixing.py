"""Mixing sources to target weights by pivotal dependent rounding of copy counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.tokens import token_sizes
from orbweave.session import durable

#: Records of one source that meet in one task of the first pass, and open records that do in the tree above it.
GROUP_ROWS, FAN_IN = 50_000, 64
#: Records moved by one copy at the very end, where that brings their source nearer to its goal.
NUDGES = 3
#: Records above 8 times their source's mean size are settled first, those above the mean next, the others last.
SIZE_CLASSES = (8, 1)
_STATE = "source string, doc bigint, tokens bigint, base int, p double, open boolean, node int"


def _chance(*parts: object) -> float:
    """A uniform number that depends on its arguments only, so a task that runs again decides alike."""
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)).encode()) / 2.0**64


def _transfer(a: tuple, b: tuple, seed: int) -> tuple[tuple, tuple]:
    """Move expected size between two fractional records until one is whole.

    a, b: (doc, tokens, p). The sum of p * tokens is kept, and so is each record's expectation of p.
    """
    (da, sa, pa), (db, sb, pb) = a, b
    up = min((1 - pa) * sa, pb * sb)  # size that a can gain from b
    down = min(pa * sa, (1 - pb) * sb)  # size that b can gain from a
    move = up if _chance(seed, da, db) * (up + down) < down else -down
    pa, pb = pa + move / sa, pb - move / sb
    snap = lambda p: 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p
    return (da, sa, snap(pa)), (db, sb, snap(pb))


def _rounder(seed: int, last: bool):
    """One pass of the tree: pair the open records of each group in their order; at most one a group stays open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[tuple, tuple[tuple, int]] = {}
        for pdf in batches:
            rows = []
            for name, doc, tokens, base, p, is_open, node, group in pdf.itertuples(index=False):
                source = name, group
                if not is_open:
                    rows.append((name, doc, tokens, base, p, False, node))
                    continue
                mine = ((doc, tokens, p), base)
                other = waiting.pop(source, None)
                if other is None:
                    waiting[source] = mine
                    continue
                a, b = _transfer(other[0], mine[0], seed)
                for (d, s, q), base_ in ((a, other[1]), (b, mine[1])):
                    if 0 < q < 1:
                        waiting[source] = ((d, s, q), base_)
                    else:
                        rows.append((name, d, s, base_ + int(q), 0.0, False, node))
            yield pd.DataFrame(rows, columns=["source", "doc", "tokens", "base", "p", "open", "node"])
        rows = []
        for (source, _), ((doc, tokens, p), base) in waiting.items():
            if last:
                # what is missing or too much is this record's own fraction: the smaller miss
                rows.append((source, doc, tokens, base + int(p >= 0.5), 0.0, False, 0))
            else:
                rows.append((source, doc, tokens, base, p, True, xxhash.xxh3_64_intdigest(str(doc)) & 0x7FFFFFFF))
        yield pd.DataFrame(rows, columns=["source", "doc", "tokens", "base", "p", "open", "node"])

    return run


def _source_rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None) -> tuple[DataFrame, int]:
    """Targets with what their sources hold, and copies per record. Targets are a short list (one row a source)."""
    held = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    wanted = (
        targets.groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
        .filter("source is not null and target_share > 0")
        .join(held, "source", "left")
        .na.fill(0, ["documents", "available", "max_repeats"])
    )
    can = wanted.withColumn("reach", F.col("available") * F.col("max_repeats"))
    total = int(total_tokens if total_tokens is not None else sizes.agg(F.sum("tokens")).first()[0] or 0)
    goal = F.least(F.col("target_share") * F.lit(float(total)), F.col("reach").cast("double"))
    return can.withColumn("goal", goal).withColumn("rate", F.when(F.col("available") > 0, F.col("goal") / F.col("available")).otherwise(0.0)), total


def _settle(records: DataFrame, seed: int) -> DataFrame:
    """Whole copies for records with a rate: one pass over groups of a source by hash, then a tree over what stays open.

    Groups depend on the records alone, so the draw does not change with the layout of the files or of the cluster.
    """
    state = (
        records.withColumn("rate", F.least("rate", F.col("max_repeats").cast("double")))
        .withColumn("base", F.least(F.floor("rate"), F.col("max_repeats")).cast("int"))
        .withColumn("p", F.when(F.col("base") < F.col("max_repeats"), F.col("rate") - F.col("base")).otherwise(0.0))
        .withColumn("open", (F.col("p") > 1e-12) & (F.col("p") < 1 - 1e-12))
        .withColumn("base", F.when(F.col("p") >= 1 - 1e-12, F.col("base") + 1).otherwise(F.col("base")).cast("int"))
        .withColumn("group", F.pmod(F.xxhash64("doc", F.lit(seed)), F.ceil(F.col("documents") / GROUP_ROWS)))
        .select("source", "doc", "tokens", "base", "p", "open", F.lit(0).alias("node"), "group")
        .repartition("source", "group")
        .sortWithinPartitions("source", "group", F.desc("tokens"), "doc")
    )
    now = durable(state.mapInPandas(_rounder(seed, False), _STATE), "rounded")
    settled = now.filter("not open")
    while True:
        left = now.filter("open")
        most = left.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if not most:
            return settled
        groups = -(-most // FAN_IN)
        gathered = (
            left.withColumn("group", F.pmod("node", F.lit(groups)))
            .repartition("source", "group")
            .sortWithinPartitions("source", "group", F.desc("tokens"), "doc")
            .select("source", "doc", "tokens", "base", "p", "open", "node", "group")
        )
        now = durable(gathered.mapInPandas(_rounder(seed + groups, groups == 1), _STATE), "rounded")
        settled = settled.unionByName(now.filter("not open"))


def _nudged(settled: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """One record more or less of each source where that brings it nearer to its goal: the best one, found in one aggregate."""
    got = settled.groupBy("source").agg(F.sum(F.col("tokens") * F.col("base")).alias("got"))
    miss = rates.select("source", "goal", "max_repeats").join(got, "source").select("source", "max_repeats", (F.col("goal") - F.col("got")).alias("miss"))
    step = F.when((F.col("miss") > 0) & (F.col("base") < F.col("max_repeats")), 1).when((F.col("miss") < 0) & (F.col("base") > 0), -1)
    moves = settled.select("source", "doc", "tokens", "base").join(F.broadcast(miss), "source").withColumn("step", step).filter("step is not null")
    moves = moves.withColumn("left", F.abs(F.col("miss") - F.col("step") * F.col("tokens"))).filter(F.col("left") < F.abs("miss"))
    order = F.struct("left", F.xxhash64("doc", F.lit(seed)), "doc")
    best = moves.groupBy("source").agg(F.min_by(F.struct("doc", "step"), order).alias("x")).select("source", "x.doc", "x.step")
    return durable(
        settled.join(F.broadcast(best), ["source", "doc"], "left").withColumn("base", (F.col("base") + F.coalesce("step", F.lit(0))).cast("int")).drop("step"), "rounded"
    )


def mix(
    rows: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text",
    total_tokens: int | None = None, seed: int = 17, vocabulary: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Drawn records (source, doc, tokens, copies) and the shares reached (one row per target).

    A source's goal is its share of the tokens of all records, or of `total_tokens`, if given, however little any other
    source holds. A source too small for that gives all its repeats, and `shortfall_tokens` is what it lacks; no other
    source makes up for it, as that would take those away from their shares. A record
    of a source gets floor(rate) copies for sure and one more with the rest as probability. Pivotal rounding
    settles these: records are paired, expected size moves between them until one is whole; what stays open
    goes up a tree of tasks. Large records settle first and the rest make up for them; at the end up to NUDGES records of a source get one copy more or
    less where that brings its total nearer to the goal. None is drawn more often than allowed. Targets are a short list, one row
    a source, and so is all that is broadcast. Sources without a target, and records without tokens, are not drawn; null
    sources and ids are left out; targets repeated for a source add up, with the least repeats. A source
    without records is reported with 0. Empty tables give empty results; extra columns are never read.
    """
    sizes = token_sizes(rows, {doc: "bigint", source: "string"}, text, vocabulary)
    sizes = durable(sizes.select(F.col(doc).alias("doc"), F.col(source).alias("source"), "tokens").filter("doc is not null and source is not null"), "token-sizes")
    rates, total = _source_rates(sizes, targets, total_tokens)
    rates = durable(rates, "source-rates")
    # large records first: each class of sizes gets the rate that what is still missing asks for
    mean = F.col("available") / F.col("documents")
    wide = sum((F.when(F.col("tokens") <= F.lit(k) * mean, 1).otherwise(0) for k in SIZE_CLASSES), F.lit(0))
    classed = durable(
        sizes.filter("tokens > 0").join(F.broadcast(rates.filter("goal > 0")), "source").select("source", "doc", "tokens", "max_repeats", "documents", wide.alias("class")),
        "sized-records",
    )
    settled = None
    for number in range(len(SIZE_CLASSES) + 1):
        left = classed.filter(F.col("class") >= number).groupBy("source").agg(F.sum("tokens").alias("left"))
        got = None if settled is None else settled.groupBy("source").agg(F.sum(F.col("tokens") * F.col("base")).alias("got"))
        now = rates.select("source", "goal").join(left, "source")
        now = now.withColumn("got", F.lit(0)) if got is None else now.join(got, "source", "left").na.fill(0, ["got"])
        rate = now.select("source", F.greatest(F.lit(0.0), (F.col("goal") - F.col("got")) / F.col("left")).alias("rate"))
        part = _settle(classed.filter(F.col("class") == number).join(F.broadcast(rate), "source"), seed + 1000 * number)
        settled = part if settled is None else settled.unionByName(part)
    for _ in range(NUDGES):
        settled = _nudged(settled, rates, seed)
    drawn = settled.filter("base > 0").select("source", F.col("doc").alias(doc), "tokens", F.col("base").alias("copies"))
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    shares = rates.join(got, "source", "left").na.fill(0, ["drawn_tokens", "most_copies"])
    everything = Window.partitionBy(F.lit(0))  # one row a target
    shares = shares.withColumn("whole", F.sum("drawn_tokens").over(everything)).select(
        "source", "target_share", "max_repeats", "documents", F.col("available").alias("available_tokens"),
        F.round("goal").cast("bigint").alias("goal_tokens"), "drawn_tokens", "most_copies",
        F.when(F.col("whole") > 0, F.round(F.col("drawn_tokens") / F.col("whole"), 6)).otherwise(0.0).alias("actual_share"),
        F.greatest(F.lit(0), F.round(F.col("target_share") * F.lit(float(total)) - F.col("goal")).cast("bigint")).alias("shortfall_tokens"),
    )
    return drawn, shares


def mixture_checks(rows: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """Per target what must hold of the mixture: 0 each of records drawn too often, drawn twice, or of another source; and whether
    no single copy more or less would bring the source nearer to its goal by more than its smallest record."""
    drawn, shares = mix(rows, targets, doc, source, **options)
    drawn = durable(drawn, "drawn")
    limits = shares.select("source", "max_repeats")
    owners = rows.select(F.col(doc).cast("bigint").alias(doc), F.col(source).alias("owner")).distinct()
    counted = (
        drawn.join(F.broadcast(limits), "source")
        .join(owners, doc)
        .groupBy("source")
        .agg(
            F.count_if(F.col("copies") > F.col("max_repeats")).alias("too_often"),
            (F.count("*") - F.count_distinct(doc)).alias("twice"),
            F.count_if(F.col("owner") != F.col("source")).alias("strange"),
        )
    )
    return limits.select("source").join(counted, "source", "left").na.fill(0)
