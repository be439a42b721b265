"""The search index as a table: projection of resources, creation, upgrade, deletion, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions import html
from orbweave.operators.catalogs import increment_version

FIELDS = ("id", "title", "content", "url", "path", "cat", "catalog", "version", "create_time")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a timestamp without zone, read as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def current_versions(index: DataFrame) -> DataFrame:
    """(catalog_id, version), the newest row where left-over ones remain."""
    return index.groupBy("catalog_id").agg(F.max_by("version", F.struct("last_modified", "id")).alias("version"))


def indexable(resources: DataFrame, index: DataFrame) -> DataFrame:
    """Resources up to the current version of their catalog, with that version as `now`."""
    now = current_versions(index).withColumnRenamed("version", "now")
    return resources.join(now, "catalog_id").filter("version <= now")


def documents(resources: DataFrame, catalogs: DataFrame, version: Column, exact: bool = False) -> DataFrame:
    """Search documents of resources: text of the page, site, path, catalog's name, time in ms.

    `exact` parses the html in Arrow batches (entities decoded, any markup); else patterns in the JVM do.
    """
    details = catalogs.select(F.col("id").alias("catalog_id"), F.col("url").alias("site"), F.col("name").alias("catalog"))
    content = html.parsed("html")["content"] if exact else html.body_text(F.col("html"))
    return resources.join(details, "catalog_id").select(
        "id", "title", content.alias("content"), F.col("site").alias("url"), F.col("url").alias("path"), "cat", "catalog",
        version.cast("int").alias("version"), epoch_ms(F.col("create_time")).alias("create_time"),
    )


def create_index(resources: DataFrame, catalogs: DataFrame, index: DataFrame, exact: bool = False) -> DataFrame:
    """All documents up to the current version, stamped with it."""
    return documents(indexable(resources, index), catalogs, F.col("now"), exact)


def recreate_index(docs: DataFrame, resources: DataFrame, catalogs: DataFrame, index: DataFrame, exact: bool = False) -> DataFrame:
    """Documents of the current version made anew; those of other versions and catalogs stay."""
    fresh = create_index(resources, catalogs, index, exact)
    now = catalogs.join(current_versions(index).withColumnRenamed("catalog_id", "id"), "id").select(F.col("name").alias("catalog"), "version")
    kept = docs.join(now.distinct(), ["catalog", "version"], "left_anti").select(*FIELDS)
    return upsert(kept, fresh)


def upgrade_index(docs: DataFrame, resources: DataFrame, catalogs: DataFrame, index: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, index) one version up. Documents are keyed by (id, version), so older versions stay searchable;
    with `overwrite` a document replaces the one of the same id."""
    raised = increment_version(index)
    return upsert(docs.select(*FIELDS), create_index(resources, catalogs, raised), ("id",) if overwrite else ("id", "version")), raised


def upsert(docs: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Old documents whose key is not among the new, and the new."""
    return docs.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def delete_documents(docs: DataFrame, catalogs: DataFrame, catalog_id: int, version: int = -1) -> DataFrame:
    """Documents without those of a catalog, of one version or (below 0) of all; others of the same name stay."""
    mine = catalogs.filter(F.col("id") == catalog_id).select(F.col("name").alias("catalog"), "url")
    hit = docs if version < 0 else docs.filter(F.col("version") == version)
    return docs.join(hit.join(mine, ["catalog", "url"], "left_semi").select("id", "version"), ["id", "version"], "left_anti")
