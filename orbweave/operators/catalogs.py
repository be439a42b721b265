"""Catalogs: resolved details, listing, and changes as rewrites of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions import urls
from orbweave.schemas import DEFAULTS


def csv_list(column: Column) -> Column:
    """Parts of a comma-separated list, untrimmed; empty for blank; empty parts at the end fall away."""
    parts = F.split(F.regexp_replace(column, ",+$", ""), ",")
    return F.when(column.isNull() | (F.trim(column) == "") | (F.regexp_replace(column, ",+$", "") == ""), F.array().cast("array<string>")).otherwise(parts)


def or_default(name: str) -> Column:
    """A policy field, or its default where it is null or blank."""
    column, default = F.col(name), DEFAULTS[name]
    if isinstance(default, str):
        return F.coalesce(F.nullif(F.trim(column), F.lit("")), F.lit(default)).alias(name)
    return F.coalesce(column.cast("bigint" if name in ("duration", "interval_ms") else "int"), F.lit(default)).alias(name)


def catalog_details(catalogs: DataFrame) -> DataFrame:
    """Catalogs with defaults resolved and lists split."""
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), urls.host(F.col("url")))
    pattern = F.coalesce(F.nullif(F.trim("path_pattern"), F.lit("")), urls.default_path_pattern(F.col("url")))
    return catalogs.select(
        "id", name.alias("name"), "url", F.coalesce(F.nullif(F.trim("start_url"), F.lit("")), F.col("url")).alias("start_url"), "cat",
        csv_list(pattern).alias("path_patterns"), csv_list(F.col("excluded_path_pattern")).alias("excluded_path_patterns"),
        csv_list(F.col("url_path_acceptor")).alias("url_path_acceptors"),
        *(or_default(n) for n in ("page_encoding", "max_fetch_size", "duration", "interval_ms", "depth", "counting_type", "max_retry_count", "url_path_filter", "extractor")),
        "credential_handler", "running_state", F.coalesce("indexed", F.lit(True)).alias("indexed"),
    )


def listing(catalogs: DataFrame, index: DataFrame, name: str | None = None, cat: str | None = None, url: str | None = None) -> DataFrame:
    """Catalogs with version and time of their index, newest first; name and url filter as `like`, cat exactly."""
    found = catalogs
    if name:
        found = found.filter(F.col("name").like(f"%{name}%"))
    if cat:
        found = found.filter(F.col("cat") == cat)
    if url:
        found = found.filter(F.col("url").like(f"%{url}%"))
    versions = index.select(F.col("catalog_id").alias("id"), "version", F.col("last_modified").alias("last_indexed"))
    return found.join(versions, "id").orderBy(F.desc("last_modified"), F.desc("last_indexed"), "id", "version")


def page(rows: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """One page, counted from 1, of rows in a total order."""
    return rows.offset((max(1, number) - 1) * size).limit(size)


def max_version(catalogs: DataFrame, index: DataFrame, cat: str) -> DataFrame:
    """Highest index version among the catalogs of a category."""
    return index.join(catalogs.filter(F.col("cat") == cat).select(F.col("id").alias("catalog_id")), "catalog_id", "left_semi").agg(F.max("version").alias("version"))


def running(catalogs: DataFrame) -> DataFrame:
    """Catalogs in a state other than none."""
    return catalogs.filter(F.col("running_state").isNotNull() & (F.col("running_state") != "none"))


def latest_path(resources: DataFrame) -> DataFrame:
    """Url of each catalog's latest resource: (catalog_id, path)."""
    return resources.filter("create_time is not null").groupBy("catalog_id").agg(F.max_by("url", F.struct("create_time", "id")).alias("path"))


def is_index_page(path: Column, url: Column) -> Column:
    """Whether a path is the site's first page."""
    return (path == url) | (path == F.concat(url, F.lit("/")))


def save_catalogs(catalogs: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by id: non-null fields of a change win, unknown ids are added; all fields of a new catalog are kept."""
    fields = [c for c in catalogs.columns if c != "id"]
    joined = catalogs.alias("o").join(changes.alias("n"), "id", "full")
    merged = [
        (F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in changes.columns else F.col(f"o.{c}")).cast(catalogs.schema[c].dataType).alias(c)
        for c in fields
    ]
    return joined.select("id", *merged)


def set_running_state(catalogs: DataFrame, catalog_id: int, state: str) -> DataFrame:
    """The table with one catalog's state changed."""
    return catalogs.withColumn("running_state", F.when(F.col("id") == catalog_id, F.lit(state)).otherwise(F.col("running_state")))


def increment_version(index: DataFrame, catalog_id: int | None = None) -> DataFrame:
    """The index table with the version of one catalog, or all, one higher."""
    mine = F.lit(True) if catalog_id is None else F.col("catalog_id") == catalog_id
    return index.withColumn("version", F.when(mine, F.col("version") + 1).otherwise(F.col("version")))


def raise_resource_versions(resources: DataFrame, index: DataFrame) -> DataFrame:
    """Resources lifted to the current version of their catalog where they are below it."""
    now = index.groupBy("catalog_id").agg(F.max("version").alias("_now"))
    return resources.join(now, "catalog_id", "left").withColumn("version", F.greatest("version", "_now")).drop("_now").select(*resources.columns)


def without_catalog(rows: DataFrame, catalog_id: int, column: str = "catalog_id", name: Column | None = None) -> DataFrame:
    """Rows of other catalogs; rows without a catalog stay."""
    return rows.filter(~F.coalesce(F.col(column) == catalog_id, F.lit(False)))
