"""Has this key been seen before? Golomb-coded sets over the keys of all earlier epochs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.golomb import GolombSet, add
from orbweave.session import durable

#: Epochs the records are cut into by order, distinct keys planned for a shard, bits of the false-positive bound.
EPOCHS, SHARD_KEYS, FP_BITS = 16, 1 << 14, 12
_FLAGGED = "shard int, epoch int, h bigint, first bigint, n bigint, maybe boolean, bound double, held_bits bigint"
#: Copies of the candidates' hashes; the rows of a hot key are spread over them.
SALTS = 8


def _prober(shards: int, universe_bits: int):
    """Runs over (shard, epoch, h, first, n) in that order; holds one epoch and the coded sets of one shard."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        levels: list[GolombSet] = []
        now: int | None = None
        held: pd.DataFrame | None = None

        def finish(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal levels, now
            shard = int(part["shard"].iloc[0])
            if shard != now:
                levels, now = [], shard
            reduced = part["h"].to_numpy(dtype=np.int64).view(np.uint64) >> np.uint64(64 - universe_bits)
            maybe = np.zeros(len(part), dtype=bool)
            for one in levels:
                maybe |= one.contains(reduced)
            out = part.assign(
                maybe=maybe,
                bound=sum(one.count for one in levels) / 2.0**universe_bits,
                held_bits=sum(one.bits for one in levels),
            )
            add(levels, np.unique(reduced), 1 << universe_bits)
            return out

        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            code = pdf["shard"].to_numpy(dtype=np.int64) * 1024 + pdf["epoch"].to_numpy()
            cuts = np.flatnonzero(np.diff(code)) + 1
            done = 0
            for cut in cuts:
                yield finish(pdf.iloc[done:cut])
                done = int(cut)
            held = pdf.iloc[done:]
        if held is not None and len(held):
            yield finish(held)

    return probe


def _keyed(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    named = [F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]
    base = rows.select(F.col(order).cast("bigint").alias("id"), *named).dropna()
    return base.withColumn("h", F.xxhash64(*(f"key{i}" for i in range(len(keys)))))


def probe_keys(base: DataFrame, epochs: int = EPOCHS, shard_keys: int = SHARD_KEYS, fp_bits: int = FP_BITS) -> DataFrame:
    """One row per distinct (epoch, key hash): its first record, its records, and whether an earlier epoch may hold the key.

    Records are cut into epochs by quantiles of `id` and keys into shards by hash. Inside an epoch equal
    hashes collapse before the shuffle, so a key that makes up a third of all rows is one row an epoch.
    A negative is certain; a positive is wrong with probability at most held keys / universe <= 2**-fp_bits.
    """
    shares = F.array(*(F.lit(i / epochs) for i in range(1, epochs))) if epochs > 1 else F.array(F.lit(0.5))
    total, quantiles = base.agg(F.count("*"), F.percentile_approx("id", shares, 1000)).first()
    cuts = sorted(set(quantiles or [])) if epochs > 1 else []
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, total / shard_keys)))))
    universe_bits = min(60, int(np.ceil(np.log2(max(2, 2 * min(total, shard_keys))))) + fp_bits)
    epoch = sum((F.when(F.col("id") >= int(c), 1).otherwise(0) for c in cuts), F.lit(0))
    firsts = (
        base.select("id", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), epoch.cast("int").alias("epoch"))
        .groupBy("shard", "epoch", "h")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
    )
    return (
        firsts.repartition("shard").sortWithinPartitions("shard", "epoch").mapInPandas(_prober(shards, universe_bits), _FLAGGED)
    )


def candidate_records(base: DataFrame, flagged: DataFrame) -> DataFrame:
    """The records the sets do not prove to be the only ones of their key: its hash may be in an earlier epoch's set, or
    comes again inside an epoch. Only these go on to the exact check.

    Candidates' hashes are one row a key however often it occurs, copied over salts; a hot key's records are spread over those.
    """
    hashes = flagged.filter("maybe or n > 1").select("h").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(hashes, ["h", "salt"], "left_semi").drop("salt")


def _earliest(candidates: DataFrame) -> DataFrame:
    """(id, h) of the first record of each candidate key."""
    keys = [c for c in candidates.columns if c.startswith("key")]
    return candidates.groupBy("h", *keys).agg(F.min("id").alias("id")).select("id", "h")


def seen_before(rows: DataFrame, keys: Sequence[str] = ("catalog_id", "url"), order: str = "id", **options: int) -> DataFrame:
    """Records whose key came before at a smaller `order`: (order).

    The coded sets name the candidates (see candidate_records); a record they prove new is compared with nothing.
    An exact check of the candidates follows, so no false positive stays. Records with a null in a key column or in `order` are
    neither reported nor remembered. Keys compare character by character; blanks and case count. Records
    that share one `order` value do not precede each other. An empty table gives an empty result; further
    columns are never read.
    """
    base = _keyed(rows, keys, order)
    candidates = durable(candidate_records(base, probe_keys(base, **options)), "seen-candidates")
    return candidates.join(_earliest(candidates), ["id", "h"], "left_anti").select(F.col("id").alias(order))


def seen_rates(rows: DataFrame, keys: Sequence[str] = ("catalog_id", "url"), order: str = "id", **options: int) -> DataFrame:
    """Probes of new keys, false positives among them, the audited rate and the theoretical one, bits held a key.

    What the sets call new is new; of the rest the exact check tells which keys were.
    """
    base = _keyed(rows, keys, order)
    flagged = durable(probe_keys(base, **options), "seen-flags")
    earliest = _earliest(candidate_records(base, flagged)).withColumnRenamed("id", "first")
    new = flagged.filter("not maybe").unionByName(flagged.filter("maybe").join(earliest, ["first", "h"], "left_semi"))
    held = (
        flagged.groupBy("shard")
        .agg(F.max(F.struct("epoch", "held_bits")).alias("x"))
        .agg(F.coalesce(F.sum("x.held_bits"), F.lit(0)).alias("held_bits"))
    )
    probed = new.agg(
        F.count("*").alias("probes"), F.count_if("maybe").alias("wrong"), F.coalesce(F.avg("bound"), F.lit(0.0)).alias("bound")
    )
    none = F.lit(None).cast("bigint")
    both = probed.select("probes", "wrong", "bound", none.alias("held_bits")).unionByName(
        held.select(none.alias("probes"), none.alias("wrong"), F.lit(None).cast("double").alias("bound"), "held_bits")
    )
    one = both.agg(F.max("probes").alias("probes"), F.max("wrong").alias("wrong"), F.max("bound").alias("bound"), F.max("held_bits").alias("held_bits"))
    per = lambda c: F.coalesce(F.col(c) / F.nullif("probes", F.lit(0)), F.lit(0.0))
    return one.select(
        F.col("probes").alias("probes_of_new_keys"), F.col("wrong").alias("false_positives"), per("wrong").alias("audited_rate"),
        F.round("bound", 9).alias("theoretical_rate"), F.round(per("held_bits"), 3).alias("bits_per_key"),
    )
