"""What changed between consecutive full snapshots, by subtracted invertible Bloom lookup tables.

Every snapshot (group, version) is summarised per hash bucket in a small table of cells. A cell holds the
count and the XOR of the (key hash, value digest) elements that fall into it, so the tables of two
snapshots subtract: equal elements vanish and only the difference is left to peel. A bucket whose table
is too full to peel is enlarged and tried again; nothing is capped and nothing is dropped.

Work per row stays in the JVM (hashes, `bit_xor` with map-side combine). Python sees only the cells that
are not zero after subtraction, many buckets to a batch, and peels them all at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.session import durable

#: Rows of the larger snapshot that share a hash bucket, cells at the first attempt, growth per attempt.
BUCKET_ROWS, FIRST_CELLS, GROWTH, ATTEMPTS = 256, 384, 4, 10
SUBTABLES = 3
#: Copies of the short snapshot list; a hot group's rows are spread over them in the join.
SALTS = 16

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hash_long(values: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """XXH64 of one 8-byte value, as Spark's `xxhash64` chains it (published algorithm)."""
    with np.errstate(over="ignore"):
        v = np.ascontiguousarray(values, dtype=np.int64).view(np.uint64)
        s = np.uint64(seed) if isinstance(seed, int) else np.ascontiguousarray(seed, dtype=np.int64).view(np.uint64)
        h = s + _P5 + np.uint64(8)
        h = h ^ (_rotl(v * _P2, 31) * _P1)
        h = _rotl(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _check_of(k1: np.ndarray, k2: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    h: np.ndarray | int = 42
    for part in (k1, k2, d1, d2):
        h = hash_long(part, h)
    return h


def _place(check: np.ndarray, table: int, attempt: int, cells: np.ndarray) -> np.ndarray:
    """Cell of an element in one subtable; equals pmod(xxhash64(check, salt), cells) in Spark."""
    salt = np.full(len(check), 100 * attempt + table, dtype=np.int64)
    return hash_long(salt, hash_long(check, 42)) % cells


_FIELDS = ["k1", "k2", "d1", "d2"]
_OUT = "group_id bigint, pair int, bucket int, k1 bigint, k2 bigint, d1 bigint, d2 bigint, side int, failed boolean"


def _peel_batch(pdf: pd.DataFrame, attempt: int, size: int) -> pd.DataFrame:
    """Peel all buckets of `pdf` together. A bucket that keeps a cell or misses its digest is reported as failed."""
    gid = pdf.groupby(["group_id", "pair", "bucket"], sort=False).ngroup().to_numpy()
    heads = pdf.drop_duplicates(["group_id", "pair", "bucket"])[["group_id", "pair", "bucket"]].reset_index(drop=True)
    pos = pdf["cell"].to_numpy()
    total = pos < 0
    span = SUBTABLES * size
    address = gid.astype(np.int64) * span + pos
    keep = ~total
    order = np.argsort(address[keep], kind="stable")
    address, owner = address[keep][order], gid[keep][order]
    cnt = pdf["cnt"].to_numpy(dtype=np.int64)[keep][order].copy()
    x = {c: pdf[c].to_numpy(dtype=np.int64)[keep][order].copy() for c in [*_FIELDS, "chk"]}
    alive = np.ones(len(address), dtype=bool)
    found: list[tuple[np.ndarray, ...]] = []
    while True:
        pure = np.flatnonzero(alive & (np.abs(cnt) == 1))
        if len(pure):
            pure = pure[_check_of(*(x[c][pure] for c in _FIELDS)) == x["chk"][pure]]
        if not len(pure):
            break
        # an element may be pure in several cells at once: take it once per bucket
        _, first = np.unique(np.stack([owner[pure], x["chk"][pure]]), axis=1, return_index=True)
        pure = pure[first]
        element = {c: x[c][pure].copy() for c in [*_FIELDS, "chk"]}
        sign, own = cnt[pure].copy(), owner[pure].copy()
        found.append((own, *(element[c] for c in _FIELDS), sign))
        for t in range(SUBTABLES):
            at = own * span + t * size + _place(element["chk"], t, attempt, size)
            where = np.searchsorted(address, at)
            there = (where < len(address)) & (address[np.minimum(where, len(address) - 1)] == at)
            where, part = where[there], there
            np.subtract.at(cnt, where, sign[part])
            for c in [*_FIELDS, "chk"]:
                np.bitwise_xor.at(x[c], where, element[c][part])
            missing = own[~there]  # a false element: its bucket can't come out right
            if len(missing):
                bad = np.isin(owner, missing)
                alive &= ~bad
                cnt[bad] = 99
        alive &= ~((cnt == 0) & (x["chk"] == 0))
    left = np.zeros(len(heads), dtype=bool)
    left[owner[(cnt != 0) | (x["chk"] != 0)]] = True
    if found:
        own, k1, k2, d1, d2, sign = (np.concatenate(col) for col in zip(*found))
    else:
        own, k1, k2, d1, d2, sign = (np.empty(0, dtype=np.int64) for _ in range(6))
    # digests: what was recovered has to add up to the bucket's own totals, kept apart from the cells
    digest = np.zeros((len(heads), 2), dtype=np.int64)
    np.add.at(digest[:, 0], own, sign)
    np.bitwise_xor.at(digest[:, 1], own, _check_of(d2, d1, k2, k1))
    told = np.zeros((len(heads), 2), dtype=np.int64)
    told[gid[total], 0] = pdf["cnt"].to_numpy(dtype=np.int64)[total]
    told[gid[total], 1] = pdf["chk"].to_numpy(dtype=np.int64)[total]
    left |= (digest != told).any(axis=1)
    good = ~left[own]
    out = heads.iloc[own[good]].reset_index(drop=True)
    for name, values in zip([*_FIELDS, "side"], (k1, k2, d1, d2, sign)):
        out[name] = values[good]
    out["failed"] = False
    bad = heads[left].copy()
    for name in [*_FIELDS, "side"]:
        bad[name] = 0
    bad["failed"] = True
    return pd.concat([out, bad], ignore_index=True).astype({"pair": "int32", "bucket": "int32", "side": "int32"})


def _peeler(attempt: int, size: int):
    def peel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf.iloc[-1] if len(pdf) else None
            if last is None:
                continue
            same = ((pdf["group_id"] == last["group_id"]) & (pdf["pair"] == last["pair"]) & (pdf["bucket"] == last["bucket"])).to_numpy()
            held = pdf[same]  # the last bucket may go on in the next batch
            if (~same).any():
                yield _peel_batch(pdf[~same], attempt, size)
        if held is not None and len(held):
            yield _peel_batch(held, attempt, size)

    return peel


def _attempt(elements: DataFrame, attempt: int, size: int) -> DataFrame:
    """Elements (group_id, pair, bucket, side, k1, k2, d1, d2) to recovered differences and failed buckets."""
    chk = F.xxhash64("k1", "k2", "d1", "d2")
    places = [
        F.struct(
            (F.lit(t * size) + F.pmod(F.xxhash64("chk", F.lit(100 * attempt + t).cast("bigint")), F.lit(size))).cast("int").alias("cell"),
            F.col("chk").alias("c"),
        )
        for t in range(SUBTABLES)
    ] + [F.struct(F.lit(-1).alias("cell"), F.xxhash64("d2", "d1", "k2", "k1").alias("c"))]
    cells = (
        elements.withColumn("chk", chk)
        .withColumn("p", F.explode(F.array(*places)))
        .groupBy("group_id", "pair", "bucket", F.col("p.cell").alias("cell"))
        .agg(
            F.sum(F.col("side").cast("bigint")).alias("cnt"),
            *(F.bit_xor(c).alias(c) for c in _FIELDS),
            F.bit_xor("p.c").alias("chk"),
        )
        .filter("cnt <> 0 or chk <> 0 or k1 <> 0 or k2 <> 0 or d1 <> 0 or d2 <> 0")
    )
    return (
        cells.repartition("group_id", "pair", "bucket")
        .sortWithinPartitions("group_id", "pair", "bucket")
        .mapInPandas(_peeler(attempt, size), _OUT)
    )


def snapshot_changes(
    rows: DataFrame,
    group: str = "catalog_id",
    version: str = "version",
    key: str = "url",
    value: str = "html",
    order: str = "id",
    bucket_rows: int = BUCKET_ROWS,
    first_cells: int = FIRST_CELLS,
) -> DataFrame:
    """Keys added, removed or changed from each snapshot of a group to its next higher version present.

    Returns (group, key, version, change_kind) with the later version. Rows whose key, group or version is
    null are left out. Of several rows with one key in a snapshot the one with the highest `order` counts
    (equal orders: the larger digest, so a repeated row changes nothing). A null value differs from every
    non-null one, the empty text included. The first snapshot of a group yields nothing; an empty table an
    empty result; columns besides the five named are never read.

    Keys are told apart by 128 hash bits and values by 128 digest bits.
    """
    digest = [F.when(F.col("_v").isNull(), F.lit(n)).otherwise(F.xxhash64("_v", F.lit(n))) for n in (1, 2)]
    latest = (
        rows.select(
            F.col(group).cast("bigint").alias("group_id"),
            F.col(version).cast("int").alias("version"),
            F.col(key).alias("key"),
            F.col(order).alias("_o"),
            F.col(value).alias("_v"),
        )
        .filter("group_id is not null and version is not null and key is not null")
        .select("group_id", "version", "key", F.struct("_o", digest[0].alias("d1"), digest[1].alias("d2")).alias("last"))
        .groupBy("group_id", "version", "key")
        .agg(F.max("last").alias("last"))
        .select(
            "group_id", "version", "key",
            F.xxhash64("key").alias("k1"), F.xxhash64("key", F.lit(7)).alias("k2"),
            F.col("last.d1").alias("d1"), F.col("last.d2").alias("d2"),
        )
    )
    latest = durable(latest, "snapshot-keys")
    in_order = Window.partitionBy("group_id").orderBy("version")
    pairs = (
        latest.groupBy("group_id", "version")
        .agg(F.count("*").alias("n"))
        .withColumn("previous", F.lag("version").over(in_order))
        .withColumn("next", F.lead("version").over(in_order))
        .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.max("n").over(Window.partitionBy("group_id")) / bucket_rows)).cast("int"))
        .drop("n")
    )
    salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    roles = F.array(
        F.when(F.col("previous").isNotNull(), F.struct(F.col("version").alias("pair"), F.lit(1).alias("side"))),
        F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("pair"), F.lit(-1).alias("side"))),
    )
    elements = (
        latest.drop("key")
        .withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int"))
        .join(salted, ["group_id", "version", "salt"])
        .withColumn("bucket", F.pmod("k2", F.col("buckets")).cast("int"))
        .withColumn("role", F.explode(F.filter(roles, lambda r: r.isNotNull())))
        .select("group_id", F.col("role.pair").alias("pair"), "bucket", F.col("role.side").alias("side"), *_FIELDS)
    )
    recovered, todo, size = [], elements, first_cells // SUBTABLES
    for attempt in range(ATTEMPTS):
        result = durable(_attempt(todo, attempt, size), "snapshot-peeled")
        recovered.append(result.filter("not failed"))
        failed = result.filter("failed").select("group_id", "pair", "bucket")
        if failed.isEmpty():
            break
        todo, size = elements.join(failed, ["group_id", "pair", "bucket"], "left_semi"), size * GROWTH
    else:
        raise RuntimeError(f"buckets of {bucket_rows} rows did not peel in {ATTEMPTS} attempts")
    differences = recovered[0]
    for more in recovered[1:]:
        differences = differences.unionByName(more)
    kinds = (
        differences.groupBy("group_id", "pair", "k1", "k2")
        .agg(F.max("side").alias("hi"), F.min("side").alias("lo"))
        .withColumn("change_kind", F.when(F.col("lo") == 1, "added").when(F.col("hi") == -1, "removed").otherwise("changed"))
        .join(pairs.select("group_id", F.col("version").alias("pair"), "previous"), ["group_id", "pair"])
        .withColumn("version", F.when(F.col("change_kind") == "removed", F.col("previous")).otherwise(F.col("pair")))
    )
    return (
        kinds.join(latest.select("group_id", "version", "k1", "k2", "key"), ["group_id", "version", "k1", "k2"])
        .select(F.col("group_id").alias(group), F.col("key").alias(key), F.col("pair").alias(version), "change_kind")
    )
