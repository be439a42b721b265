"""The run's dataflow as streams: counters, seen paths on the RocksDB state store, budgets, windows, index sink."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Files of a folder as a stream, a few at a time."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def counters(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Running count per kind (complete or update mode)."""
    return events.groupBy(kind).agg(F.count("*").alias("n"))


def windowed(events: DataFrame, kind: str = "event_type", time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling or sliding window, late events within a bound included."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    window = F.window("_t", width, slide) if slide else F.window("_t", width)
    return timed.groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def sessions(events: DataFrame, who: str = "user_id", time: str = "ts", gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Events per session, a session ending after a gap."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    grouped = timed.groupBy(F.session_window("_t", gap).alias("w"), who).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), who, "n")


def unseen(packets: DataFrame, keys: list[str], time: str | None = None, within: str | None = None) -> DataFrame:
    """First packet of each key; with a time bound the state is dropped after it."""
    if time and within:
        return packets.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
    return packets.dropDuplicates(keys)


def budgeted(events: DataFrame, most: int, key: str = "catalog_id") -> DataFrame:
    """(key, used, over): used budget per key after each batch, and whether it is exceeded (strictly above)."""

    def step(k: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        used += sum(len(b) for b in batches)
        state.update((used,))
        yield pd.DataFrame({key: [k[0]], "used": [used], "over": [used > most]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, used long, over boolean", "used long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, checkpoint: str, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result from files in `folder`, whatever its size.

    Appended rows are written as they come; of complete results the latest replaces the one before.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", folder).start()
        query.awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(folder)
    done: list[int] = []

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        done.append(number)

    query = writer.foreachBatch(replace).start()
    query.awaitTermination()
    if not done:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/batch-{max(done)}")


def upsert_sink(stream: DataFrame, store, table: str, key: str, checkpoint: str, order: str | None = None):
    """Stream rows into a stored table: new rows replace old ones of their key, batch by batch.

    Of a batch's rows with one key the one highest in `order` (by default in all its columns) is taken. A batch whose keys are all new is
    appended; only one that replaces something rewrites the table.
    """
    from orbweave.operators.index import upsert

    def write(batch: DataFrame, _number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        by = F.struct(order, *rest) if order else F.struct(*rest)
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("x")).select(key, "x.*").select(*batch.columns).persist()
        old = store.read(table)
        if old.join(latest.select(key), key, "left_semi").isEmpty():
            store.append(table, latest)
            latest.unpersist()
            return
        store.write(table, upsert(old.select(*latest.columns), latest, (key,)))
        latest.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
