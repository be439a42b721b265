"""The engine: one object over a store, with a method per public operation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.functions import robots, urls
from orbweave.operators import catalogs as cat
from orbweave.operators import index as idx
from orbweave.operators import search as srch
from orbweave.operators.counters import elapsed_text, run_counters
from orbweave.operators.dedup import DedupMode
from orbweave.plans.crawl import LOG, Budget, CrawlResult, crawl, seeds
from orbweave.plans.jobs import JobQueue, RunGuard, decide
from orbweave.schemas import COUNTERS, DEFAULTS
from orbweave.session import durable, written_tables
from orbweave.sources.fetchers import for_policy, live_fetch
from orbweave.sources.store import Store


class Engine:
    """Crawl, index and search over the tables of a folder.

    Pages come from `pages` (url, html, id), or live through the extractor, retries, pause and charset each catalog names.
    Robots files are rows (host, content), by default those among the pages; `obey_robots` False turns them off.
    """

    def __init__(self, spark: SparkSession, root: str, pages: DataFrame | None = None, robots: DataFrame | None = None, obey_robots: bool = True):
        self.spark, self.store, self.pages = spark, Store(spark, root), pages
        self.robots = None if not obey_robots else robots if robots is not None else self._robots_files(pages)
        self.queue, self.guard = JobQueue(), RunGuard()

    # catalogs

    def categories(self) -> DataFrame:
        return self.store.read("catalog").select("cat").distinct()

    def catalog(self, catalog_id: int) -> DataFrame:
        return self.store.read("catalog").filter(F.col("id") == catalog_id).limit(1)

    def details(self, catalog_id: int | None = None) -> DataFrame:
        rows = self.store.read("catalog")
        return cat.catalog_details(rows if catalog_id is None else rows.filter(F.col("id") == catalog_id))

    def list_catalogs(self, name: str | None = None, category: str | None = None, url: str | None = None, number: int = 1, size: int = 10) -> DataFrame:
        return cat.page(cat.listing(self.store.read("catalog"), self._index(), name, category, url), number, size)

    def save_catalog(self, **fields) -> int:
        """Add or change a catalog; a new one gets an id and index version 0."""
        known = self.store.read("catalog")
        old = fields.get("id")
        if old is None or self.catalog(old).isEmpty():
            top = known.agg(F.max("id")).first()[0]
            fields["id"] = old if old is not None else (top or 0) + 1
        change = self.spark.createDataFrame([fields], known.select(*fields).schema).withColumn("last_modified", F.current_timestamp().cast("timestamp_ntz"))
        self.store.write("catalog", cat.save_catalogs(known, change))
        index = self.store.read("catalog_index")
        if index.filter(F.col("catalog_id") == fields["id"]).isEmpty():
            top = index.agg(F.max("id")).first()[0]
            row = self.spark.range(1).select(
                F.lit((top or 0) + 1).alias("id"), F.lit(fields["id"]).alias("catalog_id"), F.current_timestamp().cast("timestamp_ntz").alias("last_modified"), F.lit(0).alias("version")
            )
            self.store.write("catalog_index", index.unionByName(row))
        return fields["id"]

    def delete_catalog(self, catalog_id: int) -> None:
        self.clean_catalog(catalog_id)
        self.store.write("catalog", cat.without_catalog(self.store.read("catalog"), catalog_id, "id"))
        self.store.write("catalog_index", cat.without_catalog(self.store.read("catalog_index"), catalog_id))

    def clean_catalog(self, catalog_id: int, retain_index: bool = False) -> None:
        """Drop a catalog's resources, seen paths and, unless kept, its documents."""
        self.guard.check(catalog_id)
        if not retain_index:
            self.delete_index(catalog_id)
        self.store.write("resource", cat.without_catalog(self.store.read("resource"), catalog_id))
        if self.store.exists("visited"):
            self.store.write("visited", cat.without_catalog(self.store.read("visited"), catalog_id))

    # runs

    def crawl(self, catalog_id: int, *, budget: Budget | None = None, resolve_links: bool = True, fetch: Callable | None = None) -> str:
        """Crawl or update, as the latest stored path asks for; while another run is on, the job is queued."""
        details = self.details(catalog_id)
        site = details.first()
        if site is None:
            raise KeyError(catalog_id)
        latest = cat.latest_path(self.store.read("resource").filter(F.col("catalog_id") == catalog_id)).first()
        action = decide(latest["path"] if latest else None, site["url"], self.guard.running is not None)
        if action == "enqueue":
            self.queue.put(catalog_id, "crawl")
            return action
        paths = cat.latest_path(self.store.read("resource")) if action == "update" else None
        self._run(catalog_id, details, action, paths, budget, resolve_links, fetch)
        return action

    def rebuild(self, catalog_id: int, **options) -> str:
        """Clean, one version up, crawl from the start."""
        if self.guard.running is not None:
            self.queue.put(catalog_id, "rebuild")
            return "enqueue"
        self.clean_catalog(catalog_id)
        self.store.write("catalog_index", cat.increment_version(self.store.read("catalog_index"), catalog_id))
        self._run(catalog_id, self.details(catalog_id), "crawl", None, options.get("budget"), options.get("resolve_links", True), options.get("fetch"))
        return "rebuild"

    @staticmethod
    def _robots_files(pages: DataFrame | None) -> DataFrame | None:
        if pages is None:
            return None
        files = pages.filter(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]+/robots\.txt$"))
        return files.groupBy(urls.host(F.col("url")).alias("host")).agg(F.max_by("html", "id").alias("content"))

    def _policy(self, site, fetch: Callable | None) -> dict:
        """What a catalog's fields mean for its crawl: filter, acceptors, robots and, without stored pages, the fetcher."""
        options = {"mode": DedupMode.by_name(site["url_path_filter"]), "acceptors": list(site["url_path_acceptors"] or ())}
        if self.robots is not None:
            options["robots"] = robots.rules(self.robots)
        if fetch is None and self.pages is None:
            fetch = live_fetch(for_policy(site["extractor"], site["max_retry_count"], site["interval_ms"]), site["page_encoding"])
        if fetch is not None:
            options["fetch"] = fetch
        return options

    def _run(self, catalog_id, details, action, paths, budget, resolve_links, fetch) -> CrawlResult:
        site = details.first()
        if budget is None:
            budget = Budget(COUNTERS[site["counting_type"]], site["max_fetch_size"], site["duration"])
        options = self._policy(site, fetch)
        with self.guard.run(catalog_id) as run, written_tables(self.spark):
            budget.interrupted = run.interrupted
            began = int(time.time() * 1000)
            self.store.write("catalog", cat.set_running_state(self.store.read("catalog"), catalog_id, action))
            try:
                start = seeds(details, self._index(), action, paths)
                visited = self.store.read("visited") if self.store.exists("visited") else None
                mine = visited.filter(F.col("catalog_id") == catalog_id) if visited is not None else None
                result = crawl(start, self.pages, details, visited=mine, resolve_links=resolve_links, budget=budget, **options)
                stamped = result.resources.withColumn("create_time", F.current_timestamp().cast("timestamp_ntz"))
                stamped = durable(stamped.select(*self.store.read("resource").columns), "saved-resources")
                self.store.append("resource", stamped)
                if site["indexed"]:
                    self._put_documents(idx.documents(stamped, self.store.read("catalog"), F.col("version"), exact=True))
                seen = result.visited
                if visited is not None:
                    seen = visited.filter((F.col("catalog_id") != catalog_id) | F.col("catalog_id").isNull()).unionByName(seen)
                self.store.write("visited", seen)
                ended = int(time.time() * 1000)
                self.store.append("run_log", result.log.withColumns({"started": F.lit(began), "ended": F.lit(ended)}))
                row = [(catalog_id, action, began, ended, result.levels, result.stopped)]
                self.store.append("runs", self.spark.createDataFrame(row, "catalog_id bigint, action string, started bigint, ended bigint, levels int, stopped string"))
                return result
            finally:
                self.store.write("catalog", cat.set_running_state(self.store.read("catalog"), catalog_id, "none"))

    def _put_documents(self, docs: DataFrame) -> None:
        """New documents into the index and its postings: those of the same id give way, the rest is not rewritten."""
        fresh = durable(docs, "documents")
        old = self.store.read("indexed_resource").join(fresh.select("id"), "id", "left_semi").select("id")
        if old.isEmpty():
            self.store.append("indexed_resource", fresh)
            self._add_postings(fresh)
        else:
            self.store.write("indexed_resource", idx.upsert(self.store.read("indexed_resource"), fresh))
            self._refresh_postings()

    def _add_postings(self, docs: DataFrame) -> None:
        self.store.append("postings", srch.inverted(docs), partition_by=("bucket",))

    def _refresh_postings(self) -> None:
        self.store.write("postings", srch.inverted(self.store.read("indexed_resource")), partition_by=("bucket",))

    def run_next(self) -> str | None:
        """Start the next queued job."""
        job = self.queue.take()
        return None if job is None else (self.rebuild(job[0]) if job[1] == "rebuild" else self.crawl(job[0]))

    def interrupt(self) -> None:
        self.guard.interrupt()

    def runs(self, catalog_id: int) -> DataFrame:
        """Past runs of a catalog: times, levels, and what stopped each (empty where nothing was left to do)."""
        return self.store.read("runs").filter(F.col("catalog_id") == catalog_id)

    def is_running(self, catalog_id: int) -> bool:
        return self.guard.running == catalog_id

    def summary(self, catalog_id: int) -> DataFrame:
        """Counters and time of a catalog's runs; zeros where it never ran."""
        log = self.store.read("run_log") if self.store.exists("run_log") else self.spark.createDataFrame([], LOG + ", started long, ended long")
        mine = log.filter(F.col("catalog_id") == catalog_id)
        times = mine.groupBy("catalog_id", "version").agg((F.max("ended") - F.min("started")).alias("elapsed_ms"))
        return run_counters(mine).join(times, ["catalog_id", "version"]).withColumn("elapsed", elapsed_text(F.col("elapsed_ms")))

    # index and search

    def _index(self) -> DataFrame:
        return idx.current_versions(self.store.read("catalog_index")).join(
            self.store.read("catalog_index").groupBy("catalog_id").agg(F.max("last_modified").alias("last_modified")), "catalog_id"
        )

    def _scope(self, catalog_id: int | None) -> tuple[DataFrame, DataFrame]:
        rows, index = self.store.read("catalog"), self.store.read("catalog_index")
        if catalog_id is None:
            return rows, index
        return rows.filter(F.col("id") == catalog_id), index.filter(F.col("catalog_id") == catalog_id)

    def recreate_index(self, catalog_id: int | None = None) -> None:
        rows, index = self._scope(catalog_id)
        self.store.write("indexed_resource", idx.recreate_index(self.store.read("indexed_resource"), self.store.read("resource"), rows, index))
        self._refresh_postings()

    def upgrade_index(self, catalog_id: int | None = None, overwrite: bool = False) -> None:
        rows, index = self._scope(catalog_id)
        docs, raised = idx.upgrade_index(self.store.read("indexed_resource"), self.store.read("resource"), rows, index, overwrite)
        self.store.write("indexed_resource", docs)
        self._refresh_postings()
        rest = self.store.read("catalog_index").join(index.select("id"), "id", "left_anti")
        self.store.write("catalog_index", rest.unionByName(raised))
        self.store.write("resource", cat.raise_resource_versions(self.store.read("resource"), raised))

    def delete_index(self, catalog_id: int, version: int = -1) -> None:
        self.store.write("indexed_resource", idx.delete_documents(self.store.read("indexed_resource"), self.store.read("catalog"), catalog_id, version))
        self._refresh_postings()

    def index_size(self) -> int:
        return self.store.read("indexed_resource").count()

    def search(self, q: str, c: str | None = None, v: int | None = -1, number: int = 1, size: int = 10) -> DataFrame:
        """A page of hits. A null version means the highest one among the catalogs of the category."""
        if v is None:
            top = cat.max_version(self.store.read("catalog"), self.store.read("catalog_index"), c).first()
            v = top["version"] if top and top["version"] is not None else -1
        docs = self.store.read("indexed_resource")
        return srch.search(docs, q, v, c, number, size, self.store.read("postings") if self.store.exists("postings") else None)

    def views(self) -> None:
        """Register the tables for SQL."""
        for name in ("catalog", "catalog_index", "resource", "indexed_resource"):
            self.store.read(name).createOrReplaceTempView(name)

    defaults = DEFAULTS
