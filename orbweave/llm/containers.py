"""Filling containers of fixed capacity: patterns of few lengths fitted by non-negative least squares.

Only the histogram of lengths reaches the driver; it has at most `capacity` bins however many items there
are. There, patterns of up to three lengths that fill a container are enumerated on a grid, their repeat
counts are fitted to the histogram, rounded down, and what is left is packed by best fit, still as counts.
The items themselves meet their containers through a rank among items of one length, in parallel.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.tokens import token_sizes
from orbweave.session import durable

#: Steps of the grid on which patterns are enumerated; least buckets over which items of one length are ranked,
#: and records from which there are more of them.
GRID, RANK_BUCKETS, BUCKET_ROWS = 256, 64, 200_000
#: Shares of the fitted repeats that are tried; the fewest containers win.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)


def patterns_of(grid: int) -> np.ndarray:
    """All non-decreasing triples of grid lengths that sum to `grid`, 0 for a place left out."""
    return np.array([(a, b, grid - a - b) for a in range(grid // 3 + 1) for b in range(a, (grid - a) // 2 + 1)], dtype=np.int64)


class Fit(NamedTuple):
    """Pattern repeats, the share of the wanted counts they leave unmet or exceed, and whether no pattern could improve them."""

    repeats: np.ndarray
    residual: float
    converged: bool


def fit(patterns: np.ndarray, wanted: np.ndarray, tolerance: float = 1e-6) -> Fit:
    """Non-negative least squares (active set, Lawson and Hanson 1974) of pattern repeats against counts by length.

    Every round at least one pattern enters; a solution has at most one pattern a length, so ten rounds a length are
    ample, and `converged` says whether they were.
    """
    n, m = len(patterns), len(wanted)
    matrix = np.zeros((m, n))
    for place in range(patterns.shape[1]):
        np.add.at(matrix, (patterns[:, place], np.arange(n)), 1.0)
    matrix[0] = 0  # an empty place has no length
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    target = wanted.astype(float).copy()
    target[0] = 0
    scale = max(1.0, float(target.max()))
    converged = not n
    for _ in range(10 * m if n else 0):
        slope = matrix.T @ (target - matrix @ x)
        slope[active] = -np.inf
        # several well separated columns may enter at once; the inner loop takes back what turns negative
        best = np.argpartition(slope, -min(4, n))[-min(4, n) :]
        best = best[slope[best] > tolerance * scale]
        if not len(best):
            converged = True
            break
        active[best] = True
        while active.any():
            at = np.flatnonzero(active)
            solution = np.linalg.lstsq(matrix[:, at], target, rcond=None)[0]
            negative = solution <= 1e-9
            if not negative.any():
                break
            step = np.min(x[at][negative] / np.maximum(x[at][negative] - solution[negative], 1e-12), initial=1.0)
            x[at] += step * (solution - x[at])
            out = negative & (x[at] <= 1e-9)
            # at least the worst leaves, so the loop ends
            out[np.argmin(np.where(negative, x[at], np.inf))] = True
            active[at[out]] = False
            x[~active] = 0
        x[:] = 0
        if active.any():
            x[at] = solution
    missed = np.abs(target - matrix @ x).sum() / max(1.0, target.sum())
    return Fit(x, float(missed), converged)


def _take(runs: list[list[int]], count: int) -> list[tuple[int, int]]:
    """Take `count` items from the end of a list of [length, items left] runs."""
    out = []
    while count:
        length, left = runs[-1]
        n = min(left, count)
        out.append((length, n))
        count -= n
        if n == left:
            runs.pop()
        else:
            runs[-1][1] -= n
    return out


class Plan(NamedTuple):
    """Groups (lengths in one container, number of such containers); the share of the fitted repeats they use, containers
    that best fit alone would take, and how well the patterns meet the histogram."""

    groups: list[tuple[tuple[int, ...], int]]
    share: float
    best_fit: int
    residual: float
    converged: bool


def plan(histogram: dict[int, int], capacity: int, grid: int = GRID) -> Plan:
    """Containers that hold every item of the histogram; lengths run from 1 to capacity. Deterministic in the histogram.

    Patterns of up to three lengths that fill a container are fitted to the histogram; capacities up to twice the grid are
    enumerated length by length, larger ones in steps. Of the shares of SHARES of the repeats the one with the fewest
    containers is taken, residuals packed by best fit; share 0 is best fit alone, so the plan is never worse.
    """
    unit = 1 if capacity <= 2 * grid else -(-capacity // grid)
    steps = capacity // unit
    wanted = np.zeros(steps + 2, dtype=np.int64)
    for length, n in histogram.items():
        wanted[min(-(-length // unit), steps + 1)] += n
    patterns = patterns_of(steps)
    patterns = patterns[((patterns == 0) | (wanted[patterns] > 0)).all(axis=1)]
    fitted = fit(patterns, wanted[: steps + 1])
    plans = {share: _filled(histogram, capacity, unit, patterns, share * fitted.repeats) for share in SHARES}
    counts = {share: sum(n for _, n in groups) for share, groups in plans.items()}
    best = min(SHARES, key=lambda share: (counts[share], -share))
    return Plan(plans[best], best, counts[0.0], fitted.residual, fitted.converged)


def least_containers(histogram: dict[int, int], capacity: int) -> int:
    """A lower bound (Martello and Toth 1990): items above half a container need one each, and what is too large for the room
    beside them needs more."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64)
    best = 0
    for least in {0, *lengths[2 * lengths <= capacity].tolist()}:
        alone, large = lengths > capacity - least, (2 * lengths > capacity) & (lengths <= capacity - least)
        small = (2 * lengths <= capacity) & (lengths >= least)
        room = int((counts[large] * (capacity - lengths[large])).sum())
        beyond = int((counts[small] * lengths[small]).sum()) - room
        best = max(best, int(counts[alone].sum() + counts[large].sum()) + max(0, -(-beyond // capacity)))
    return best


def _filled(histogram: dict[int, int], capacity: int, unit: int, patterns: np.ndarray, repeats: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns as often as their rounded repeats and the items allow, then all other items by best fit."""
    bins: dict[int, list[list[int]]] = defaultdict(list)
    for length in sorted(histogram):
        if histogram[length]:
            bins[-(-length // unit)].append([length, histogram[length]])
    groups: list[list] = []  # [lengths, containers, room]
    for k in np.argsort(-repeats):
        parts = [int(b) for b in patterns[k] if b]
        times = int(repeats[k] + 1e-6)
        for b in set(parts):
            times = min(times, sum(n for _, n in bins[b]) // parts.count(b))
        if times < 1:
            continue
        taken = [_take(bins[b], times) for b in parts]
        while taken[0]:
            n = min(t[-1][1] for t in taken)
            lengths = [t[-1][0] for t in taken]
            groups.append([lengths, n, capacity - sum(lengths)])
            for t in taken:
                if t[-1][1] == n:
                    t.pop()
                else:
                    t[-1] = (t[-1][0], t[-1][1] - n)
    # residuals: longest first into the fullest container that takes them, all as counts
    rooms: dict[int, list[list]] = defaultdict(list)
    for group in groups:
        rooms[group[2]].append(group)
    open_rooms = np.zeros(capacity + 1, dtype=bool)
    for room in rooms:
        open_rooms[room] = True
    done: list[tuple[tuple[int, ...], int]] = []
    rest = sorted(([length, n] for runs in bins.values() for length, n in runs if n), reverse=True)
    for length, n in rest:
        while n:
            fitting = np.flatnonzero(open_rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                group = rooms[room].pop()
                if not rooms[room]:
                    open_rooms[room] = False
                most = room // length
                if n >= group[1]:
                    times, used = min(most, n // group[1]), group[1]
                else:
                    times, used = 1, n
                if used < group[1]:
                    rooms[room].append([group[0], group[1] - used, room])
                    open_rooms[room] = True
                filled = [group[0] + [length] * times, used, room - times * length]
                n -= times * used
            else:
                times = min(capacity // length, n)
                used = n // times
                filled = [[length] * times, used, capacity - times * length]
                n -= times * used
            rooms[filled[2]].append(filled)
            open_rooms[filled[2]] = True
    for same in rooms.values():
        done += [(tuple(sorted(lengths, reverse=True)), n) for lengths, n, _ in same]
    return sorted(done, reverse=True)


def _places(groups: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Intervals of ranks by length: from, to, first container, items of that length in one container."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, n in groups:
        for length in dict.fromkeys(lengths):
            each = lengths.count(length)
            rows.append((length, used[length], used[length] + n * each, base, each))
            used[length] += n * each
        base += n
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "base", "each"])


def _assigner(tables: dict[int, pd.DataFrame], totals: dict[int, int]):
    keys = {}
    for spec, table in tables.items():
        table = table.sort_values(["length", "lo"])
        keys[spec] = (table["length"].to_numpy(np.int64), table["lo"].to_numpy(np.int64), table["base"].to_numpy(np.int64), table["each"].to_numpy(np.int64))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros(len(pdf), dtype=np.int64)
            for spec in pdf["spec_id"].unique():
                mine = (pdf["spec_id"] == spec).to_numpy()
                length, rank = pdf["tokens"].to_numpy(np.int64)[mine], pdf["rank"].to_numpy(np.int64)[mine]
                got = np.zeros(len(length), dtype=np.int64)
                if int(spec) in keys:
                    lengths, los, bases, each = keys[int(spec)]
                    order = np.argsort(length, kind="stable")
                    cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
                    for rows in np.split(order, cuts[1:]):  # intervals of one length, by the rank they start at
                        one = length[rows[0]]
                        if one:
                            a, b = np.searchsorted(lengths, [one, one + 1])
                            k = a + np.searchsorted(los[a:b], rank[rows], side="right") - 1
                            got[rows] = bases[k] + (rank[rows] - los[k]) // each[k]
                empty = length == 0
                got[empty] = rank[empty] % max(1, totals[int(spec)])
                out[mine] = got
            yield pdf[["spec_id", "doc", "part", "tokens"]].assign(container=out)

    return assign


def pack(
    rows: DataFrame, specs: DataFrame, doc: str = "doc_id", text: str = "text", vocabulary: str | None = None, grid: int = GRID
) -> DataFrame:
    """(spec_id, container, doc, part, tokens): every record's place in the containers of every spec.

    A record stays whole (part 0) unless it is larger than the capacity: then it is cut into full containers
    and one rest (parts 0, 1, ...). Records without tokens are placed too and take no room. Rows with null
    doc are left out; a row stored twice is packed twice; specs without a positive capacity are left out.
    `specs` is a short list of tasks (a few rows); histograms have at most `capacity` bins. An empty table gives
    an empty result; extra columns are never read.
    """
    spark = rows.sparkSession
    wanted = [(int(s), int(c)) for s, c in specs.select("spec_id", "capacity_tokens").collect() if s is not None and c and c > 0]
    sizes = durable(token_sizes(rows, {doc: "bigint"}, text, vocabulary).filter(F.col(doc).isNotNull()), "token-sizes")
    schema = f"spec_id int, container bigint, {doc} bigint, part int, tokens bigint"
    if not wanted:
        return spark.createDataFrame([], schema)
    task = F.explode(F.array(*(F.struct(F.lit(s).alias("spec_id"), F.lit(c).cast("bigint").alias("capacity")) for s, c in wanted)))
    cut = F.expr("if(size <= capacity, 0, cast((size + capacity - 1) div capacity as int) - 1)")
    items = (
        sizes.select(F.col(doc).alias("doc"), F.col("tokens").alias("size"))
        .withColumn("t", task)
        .select("doc", "size", "t.spec_id", "t.capacity")
        .withColumn("part", F.explode(F.sequence(F.lit(0), cut)))
        .withColumn("tokens", F.expr("least(capacity, size - part * capacity)"))
    )
    buckets = max(RANK_BUCKETS, sizes.count() // BUCKET_ROWS)
    bucket = F.pmod(F.xxhash64("doc", "part"), F.lit(buckets)).cast("int")
    counted = durable(items.groupBy("spec_id", "tokens", bucket.alias("bucket")).agg(F.count("*").alias("n")), "length-counts")
    before = Window.partitionBy("spec_id", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("spec_id", "tokens", "bucket").orderBy("doc", "part")
    ranked = (
        items.withColumn("bucket", bucket)
        .withColumn("at", F.row_number().over(inside) - 1)
        # offsets grow with the records, and their small files would pass for a table that can be broadcast from the driver
        .join(offsets.drop("n").hint("merge"), ["spec_id", "tokens", "bucket"])
        .select("spec_id", "doc", "part", "tokens", (F.col("at") + F.col("offset")).alias("rank"))
    )
    tables, totals = {}, {}
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for spec, length, n in counted.filter("tokens > 0").groupBy("spec_id", "tokens").agg(F.sum("n")).collect():
        histograms[spec][length] = n
    for spec, capacity in wanted:
        groups = plan(histograms[spec], capacity, grid).groups
        totals[spec] = sum(n for _, n in groups)
        if groups:
            tables[spec] = _places(groups)
    placed = ranked.mapInPandas(_assigner(tables, totals), "spec_id int, doc bigint, part int, tokens bigint, container bigint")
    return placed.select("spec_id", "container", F.col("doc").alias(doc), "part", "tokens")


def container_fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, container, items, tokens, capacity_tokens, fill) of every container."""
    filled = packed.groupBy("spec_id", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return filled.join(specs.select("spec_id", "capacity_tokens"), "spec_id").withColumn("fill", F.round(F.col("tokens") / F.col("capacity_tokens"), 6))


def packing_summary(packed: DataFrame, specs: DataFrame, grid: int = GRID) -> DataFrame:
    """Per spec: containers used, the fewest possible by a proven bound, those that best fit alone would take, the mean fill, and how
    the patterns met the histogram: the share of their repeats used, what they left unmet of it, and whether the fit ended.

    Histograms (at most `capacity` bins a spec) come to the driver; the result has one row a spec.
    """
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for spec, length, n in packed.filter("tokens > 0").groupBy("spec_id", "tokens").agg(F.count("*")).collect():
        histograms[spec][length] = n
    capacities = {s: c for s, c in specs.select("spec_id", "capacity_tokens").collect() if s in histograms}
    used = {r.spec_id: r.n for r in packed.groupBy("spec_id").agg(F.count_distinct("container").alias("n")).collect()}
    rows = []
    for spec, capacity in sorted(capacities.items()):
        h, best = histograms[spec], plan(histograms[spec], capacity, grid)
        fill = sum(k * n for k, n in h.items()) / (used[spec] * capacity)
        rows.append((spec, capacity, used[spec], least_containers(h, capacity), best.best_fit, round(fill, 6), best.share, round(best.residual, 6), best.converged))
    schema = (
        "spec_id int, capacity_tokens int, containers bigint, least_containers bigint, best_fit_containers bigint, mean_fill double,"
        " pattern_share double, residual double, converged boolean"
    )
    return packed.sparkSession.createDataFrame(rows, schema)


def packing_checks(packed: DataFrame, specs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per spec what must hold: records placed, and 0 each of containers over their capacity, records cut though they fit, and
    records whose parts are not full but for the last."""
    limits = specs.select("spec_id", F.col("capacity_tokens").alias("capacity"))
    over = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("load")).join(limits, "spec_id")
    over = over.groupBy("spec_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"))
    whole = packed.groupBy("spec_id", doc).agg(
        F.count("*").alias("parts"), F.count_if(F.col("part") == 0).alias("copies"), F.sum("tokens").alias("size"), F.min("tokens").alias("least")
    )
    counted = whole.join(limits, "spec_id").groupBy("spec_id").agg(
        F.sum("copies").alias("documents"),
        F.count_if((F.col("copies") == 1) & (F.col("parts") > 1) & (F.col("size") <= F.col("capacity"))).alias("torn"),
        F.count_if((F.col("copies") == 1) & (F.col("size") <= (F.col("parts") - 1) * F.col("capacity")) & (F.col("parts") > 1)).alias("loose"),
    )
    return counted.join(over, "spec_id").select("spec_id", "documents", "overfull", "torn", "loose")
