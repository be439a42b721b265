"""Storage of the engine's tables: Parquet folders written whole and swapped, or read from a database."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orbweave.schemas import CATALOG, CATALOG_INDEX, INDEXED_RESOURCE, RESOURCE

SCHEMAS: dict[str, T.StructType] = {"catalog": CATALOG, "catalog_index": CATALOG_INDEX, "resource": RESOURCE, "indexed_resource": INDEXED_RESOURCE}


class Store:
    """Tables in one folder. A table is a folder of generations; a pointer names the current one.

    A change is written as a new generation and then pointed to, so a table is never read and overwritten at once
    and a failed write leaves the old one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self, name: str) -> str | None:
        folder = self._path(f"{self.root}/{name}")
        if not self._fs.exists(folder):
            return None
        done = [s.getPath().getName() for s in self._fs.listStatus(folder) if s.isDirectory()]
        done = [d for d in done if self._fs.exists(self._path(f"{self.root}/{name}/{d}/_SUCCESS"))]
        return max(done) if done else None

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str) -> DataFrame:
        """The current generation with its fixed schema; an empty table if there is none."""
        current, schema = self._current(name), SCHEMAS.get(name)
        if current is None:
            if schema is None:
                raise FileNotFoundError(name)
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{name}/{current}")

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = (), keep: int = 1) -> DataFrame:
        """Write a new generation, drop all but `keep` older ones, return the table read back."""
        old = self._current(name)
        number = int(old.split("-")[1]) + 1 if old else 0
        target = f"{self.root}/{name}/gen-{number:012d}-{uuid.uuid4().hex[:8]}"
        schema = SCHEMAS.get(name)
        rows = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schema)) if schema else df
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
        folder = self._path(f"{self.root}/{name}")
        for gone in sorted(s.getPath().getName() for s in self._fs.listStatus(folder))[: -keep - 1]:
            self._fs.delete(self._path(f"{self.root}/{name}/{gone}"), True)
        return self.read(name)

    def append(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Add rows to the current generation as files of their own: nothing that is stored is read or written again."""
        current = self._current(name)
        if current is None:
            return self.write(name, df, partition_by)
        schema = SCHEMAS.get(name)
        rows = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schema)) if schema else df
        writer = rows.write.mode("append").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/{current}")
        return self.read(name)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database, read in parallel over ranges of a numeric column where given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    """Rows into a table of a database."""
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
