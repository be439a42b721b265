"""Deduplication of paths and resources: exact, Bloom, unique key, and the export of what was seen."""

from __future__ import annotations

import math
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.operators.counters import running_total

#: The four values that identify a path within a run.
KEYS = ("catalog_id", "refer", "path", "version")
#: The resource table's unique key.
UNIQUE = ("catalog_id", "cat", "version", "title", "url")


#: Keys a Bloom filter is planned for at least; only bits that are set take room.
LEAST_EXPECTED = 1_000_000


class DedupMode(Enum):
    """How a run remembers what it has seen."""

    EXACT = "exact"
    BLOOM = "bloom"
    STREAM = "stream"

    @classmethod
    def by_name(cls, name: str) -> DedupMode:
        """Mode for a catalog's filter name; an unknown name is an error."""
        known = {"redis": cls.EXACT, "redis-bloomfilter": cls.BLOOM, "redission-bloomfilter": cls.BLOOM, "rocksdb": cls.STREAM}
        if name not in known:
            raise ValueError(f"unknown url filter: {name}")
        return known[name]


def unseen(frontier: DataFrame, visited: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Rows of the frontier whose key is new, one per key."""
    return frontier.dropDuplicates(list(keys)).join(visited.select(*keys), list(keys), "left_anti")


def first_of_key(rows: DataFrame, keys: tuple[str, ...] = UNIQUE, order: str = "id") -> DataFrame:
    """`rows` with `is_saved`: the row of lowest `order` per unique key is saved, further ones exist already.

    Nulls in a key column count as equal. A hot key is one window group; the rank needs its rows in order, so only
    the first is kept apart, by a minimum with map-side combine, and rows meet it by that order value.
    """
    first = rows.groupBy(*keys).agg(F.min(order).alias(order)).select(order).withColumn("is_saved", F.lit(True))
    return rows.join(first, order, "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))


def bloom_parameters(expected: int, error: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter (Bloom 1970)."""
    bits = math.ceil(-expected * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / max(1, expected) * math.log(2)))


def bloom_unseen(frontier: DataFrame, visited: DataFrame, keys: tuple[str, ...] = KEYS, error: float = 0.03, expected: int | None = None) -> DataFrame:
    """`unseen` through a Bloom filter of the visited keys: drops up to `error` of the new ones, never keeps an old one.

    Bits are kept as rows (word, mask) of a table, so the filter is distributed and no task holds it whole.
    """
    n = expected or max(LEAST_EXPECTED, visited.count())
    bits, hashes = bloom_parameters(n, error)
    probes = F.array(*(F.pmod(F.xxhash64(*keys, F.lit(k)), F.lit(bits)) for k in range(hashes)))
    words = (
        visited.select(F.explode(probes).alias("bit"))
        .groupBy(F.expr("bit div 63").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 63 as int))")).alias("mask"))
    )
    new = frontier.dropDuplicates(list(keys))
    hit = (
        new.select(*keys, F.explode(probes).alias("bit"))
        .withColumn("word", F.expr("bit div 63"))
        .join(words, "word")
        .filter("(shiftright(mask, cast(bit % 63 as int)) & 1L) = 1L")
        .groupBy(*keys)
        .agg(F.count_distinct("bit").alias("set"))
    )
    wanted = F.size(F.array_distinct(probes))
    full = new.select(*keys, wanted.alias("wanted")).join(hit, list(keys)).filter("set >= wanted")
    return new.join(full.select(*keys), list(keys), "left_anti")


def export(visited: DataFrame, keys: tuple[str, ...] = KEYS, limit: int | None = None, first_index: int = 1) -> DataFrame:
    """Seen paths in order with a running index (`position`), all of them or the first `limit`."""
    rows = visited.select(*keys).distinct()
    if limit is not None:
        rows = rows.orderBy(*keys).limit(limit)
    numbered = running_total(rows.withColumns({"_all": F.lit(0), "_one": F.lit(1)}), ("_all",), keys, "_one", "position")
    return numbered.select(*keys, (F.col("position") - 1 + first_index).alias("position"))


def seen_size(visited: DataFrame, keys: tuple[str, ...] = KEYS, exact: bool = True) -> DataFrame:
    """Number of distinct keys seen, exact or by HyperLogLog."""
    if exact:
        return visited.select(*keys).distinct().agg(F.count("*").alias("seen"))
    return visited.agg(F.approx_count_distinct(F.struct(*keys)).alias("seen"))
