"""The crawl as a fixpoint over tables: frontier, visited keys, stored pages, acceptance, exact budgets, counters.

Each level is one step for all catalogs at once, over keys and what a page says about itself (title, links, whether it is
blank): stored html is read once before the first level and joined once to what was saved in the end. What is carried
from level to level is written to the shared folder and compacted, so lineage stays short and a lost executor costs a
task. Visited keys meet the frontier by an anti-join on the four values that identify a path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from time import monotonic

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.functions import html, urls
from orbweave.operators import accept
from orbweave.operators.counters import run_counters, running_total
from orbweave.operators.dedup import KEYS, UNIQUE, DedupMode, bloom_unseen, first_of_key, unseen
from orbweave.schemas import COUNTERS, RESOURCE
from orbweave.session import durable

#: Levels after which the tables of seen paths are written as one.
COMPACT_LEVELS = 8
#: Path, identity and outcome of every packet; links that were turned away have outcome FILTERED.
LOG = "catalog_id bigint, refer string, path string, version int, action string, level int, outcome string"


@dataclass
class CrawlResult:
    """Tables of a finished run, and the number of levels it took."""

    resources: DataFrame
    visited: DataFrame
    log: DataFrame
    levels: int
    stopped: str = ""

    def counters(self) -> DataFrame:
        """Run counters per (catalog_id, version)."""
        return run_counters(self.log)


@dataclass
class Budget:
    """Stops a run: `most` of a counter (strictly above ends it), a wall-clock limit, or a flag that is read."""

    counter: str | None = None
    most: int | None = None
    minutes: float | None = None
    interrupted: Callable[[], bool] = lambda: False


def seeds(details: DataFrame, versions: DataFrame, action: str = "crawl", paths: DataFrame | None = None) -> DataFrame:
    """One packet per catalog: its start url, or the given path where it is an update."""
    rows = details.join(versions.select(F.col("catalog_id").alias("id"), "version"), "id", "left")
    start = F.col("start_url")
    if paths is not None:
        rows = rows.join(paths.select(F.col("catalog_id").alias("id"), "path"), "id", "left")
        start = F.coalesce("path", start)
    return rows.select(
        F.lit(action).alias("action"), F.col("id").alias("catalog_id"), F.col("url").alias("refer"),
        urls.without_closing_slash(start, F.col("url")).alias("path"), "cat", F.coalesce("version", F.lit(0)).cast("int").alias("version"),
        F.lit(0).alias("level"),
    )


def fetched(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """The offline fetch: latest stored page by url; a miss is an empty page."""
    stored = pages.filter("html is not null").groupBy("url").agg(F.max_by("html", "id").alias("html")).withColumnRenamed("url", "path")
    return frontier.join(stored, "path", "left").withColumn("html", F.coalesce("html", F.lit("")))


def rewritten(page: Column, rewriters: list[Callable[[Column], Column]]) -> Column:
    """A page through the chain of rewriters; blank becomes empty."""
    for rewrite in rewriters:
        page = rewrite(page)
    return F.when(F.trim(page) == "", F.lit("")).otherwise(page)


def page_facts(page: Column, rewriters: list[Callable[[Column], Column]] = ()) -> list[Column]:
    """What the crawl needs of a page besides its html: title, whether it is missing or blank, links and their base."""
    page = rewritten(page, list(rewriters))
    return [
        html.title(page).alias("title"), (page == "").alias("missing"), (html.body_text(page) == "").alias("blank"),
        html.all_links(page).alias("hrefs"), html.base_href(page).alias("base"),
    ]


def stored_facts(pages: DataFrame, rewriters: list[Callable[[Column], Column]] = ()) -> DataFrame:
    """(path, page, title, missing, blank, hrefs, base) of the latest stored page of each url: one scan, html is not shuffled."""
    facts = pages.filter("html is not null and url is not null").select(F.col("url").alias("path"), F.col("id").alias("page"), *page_facts(F.col("html"), rewriters))
    rest = [c for c in facts.columns if c != "path"]
    latest = facts.groupBy("path").agg(F.max_by(F.struct(*rest), "page").alias("x")).select("path", "x.*")
    return durable(latest, "page-facts")


def outgoing(
    ok: DataFrame, details: DataFrame, resolve_links: bool = True, robots: DataFrame | None = None, acceptors: list[str] = (),
) -> DataFrame:
    """Links of pages (`hrefs`, `base`) with `accepted`; the chain sees user acceptors, robots, depth and path patterns of the link's catalog."""
    base = F.when(F.col("base") == "", F.col("path")).otherwise(F.coalesce(urls.resolved(F.col("base"), F.col("path")), F.col("path")))
    target = urls.resolved(F.col("href"), base) if resolve_links else F.col("href")
    found = (
        ok.select("catalog_id", "refer", "path", "base", "cat", "version", "action", "level", F.explode("hrefs").alias("href"))
        .filter(F.trim("href") != "")
        .withColumn("link", F.coalesce(target, F.col("href")))
    )
    policy = details.select(F.col("id").alias("catalog_id"), "depth", "path_patterns", "excluded_path_patterns")
    found = found.join(policy, "catalog_id")
    allowed = None
    if robots is not None:
        from orbweave.functions.robots import allowed as by_rules

        found = by_rules(found.withColumn("_h", urls.host(F.col("link"))), robots, "link", "_h").withColumnRenamed("allowed", "_allowed").drop("_h")
        allowed = F.col("_allowed")
    columns = {"depth": F.col("depth"), "included": F.col("path_patterns"), "excluded": F.col("excluded_path_patterns")}
    verdict = F.coalesce(accept.accepted(F.col("link"), F.col("refer"), columns, list(acceptors), allowed), F.lit(False))
    return found.select(
        "catalog_id", "refer", F.col("path").alias("source"), urls.without_closing_slash(F.col("link"), F.col("refer")).alias("path"), "cat",
        "version", "action", "level", verdict.alias("accepted"),
    )


RUN = ("catalog_id", "version")


def _trim_to_budget(frontier: DataFrame, spent: DataFrame, most: int) -> DataFrame:
    """Packets that still count, in the order of their paths: the one that exceeds the budget is the last of its run."""
    used = spent.select(*RUN, F.col(COUNTERS[0].lower()).alias("_used"))
    sizes = frontier.groupBy(*RUN).agg(F.count("*").alias("_n")).join(used, list(RUN), "left").na.fill(0, ["_used"])
    sizes = durable(sizes.filter(F.col("_n") + F.col("_used") > most + 1), "over-budget")
    if sizes.isEmpty():
        return frontier
    within = frontier.join(sizes.select(*RUN), list(RUN), "left_anti")
    over = frontier.join(sizes.select(*RUN, "_used"), list(RUN)).withColumns({"_one": F.lit(1), "_key": F.xxhash64("refer", "action")})
    cut = running_total(over, RUN, ("path", "_key"), "_one").filter(F.col("total") + F.col("_used") <= most + 1)
    return within.unionByName(cut.select(*frontier.columns))


def _last_paths(outcomes: DataFrame, spent: DataFrame | None, counter: str, most: int) -> DataFrame | None:
    """(catalog_id, version, last_path) of the runs in which a counter exceeds its budget in this level: the path at which it does."""
    counts = outcomes.filter(F.col("outcome") == counter).groupBy(*RUN, "source").agg(F.count("*").alias("n"))
    now = counts.groupBy(*RUN).agg(F.sum("n").alias("_n"))
    if spent is not None:
        now = now.join(spent.select(*RUN, F.col(counter.lower()).alias("_used")), list(RUN), "left").na.fill(0, ["_used"])
    else:
        now = now.withColumn("_used", F.lit(0))
    over = durable(now.filter(F.col("_n") + F.col("_used") > most).select(*RUN, "_used"), "over-budget")
    if over.isEmpty():
        return None
    totals = running_total(counts.join(over, list(RUN)), RUN, ("source",), "n").filter(F.col("total") + F.col("_used") > most)
    return durable(totals.groupBy(*RUN).agg(F.min("source").alias("last_path")), "last-paths")


def _up_to(rows: DataFrame, last: DataFrame | None, path: str) -> DataFrame:
    """Rows of runs that go on, and of the others those up to their last path."""
    if last is None:
        return rows
    return rows.join(last, list(RUN), "left").filter(F.col("last_path").isNull() | (F.col(path) <= F.col("last_path"))).drop("last_path")


def crawl(
    start: DataFrame, pages: DataFrame | None, details: DataFrame, *, visited: DataFrame | None = None, resolve_links: bool = True,
    robots: DataFrame | None = None, budget: Budget | None = None, rewriters: list[Callable[[Column], Column]] = (),
    max_levels: int | None = None, fetch: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None, acceptors: list[str] = (),
    mode: DedupMode = DedupMode.EXACT,
) -> CrawlResult:
    """Follow links from the seeds until nothing new is found or a budget ends the run.

    A packet whose key was seen counts as existing and goes no further in a crawl; in an update its page is
    not saved but its links are still followed (once a run, so cycles end). A page that can't be had counts as
    invalid; one without text is dropped. A page whose unique key is taken counts as existing, and its links are
    followed all the same. Links of a page are crawled on, or updated on where the page was seen before.
    The budget of any counter is exact: the packet that exceeds it is the last of its catalog and version, packets of a level
    being taken in the order of their paths. Wall-clock limits and the flag are read between levels. With mode BLOOM a
    few new paths (at most the filter's error) pass for seen; EXACT and STREAM keep all. Without `fetch` pages are the stored ones;
    a fetch step adds `html` to the rows it is given, and its pages are kept as fetched. Without `max_levels` the run ends by itself,
    as every path is gone on from once.
    """
    spark = start.sparkSession
    began = monotonic()
    facts = stored_facts(pages, rewriters) if fetch is None else None
    frontier = start.select("action", "catalog_id", "refer", "path", "cat", "version")
    # keys seen so far, and whether this run has gone on from them; one part a level
    if visited is None:
        visited = spark.createDataFrame([], "catalog_id bigint, refer string, path string, version int")
    known = [visited.select(*KEYS, F.lit(False).alias("_went"))]
    stored: list[DataFrame] = []
    logs: list[DataFrame] = []
    kept: list[DataFrame] = []
    spent: DataFrame | None = None
    level, stopped = 0, ""
    limited = budget is not None and budget.counter is not None and budget.most is not None
    while max_levels is None or level < max_levels:
        if budget and budget.interrupted():
            stopped = "interrupted"
            break
        if budget and budget.minutes is not None and (monotonic() - began) / 60 > budget.minutes:
            stopped = "duration"
            break
        if limited and budget.counter == COUNTERS[0] and spent is not None:
            frontier = _trim_to_budget(frontier, spent, budget.most)
        crawls = F.when(F.col("action") == "crawl", 1).otherwise(0)
        packets = frontier.groupBy(*KEYS).agg(F.max_by(F.struct("action", "cat"), crawls).alias("x"), F.count("*").alias("copies"))
        seen = _union(known).groupBy(*KEYS).agg(F.max("_went").alias("_went"))
        old = packets.select(*KEYS, "x.action", "x.cat", "copies").join(seen, list(KEYS), "left")
        old = old.withColumns({"_seen": F.col("_went").isNotNull(), "_went": F.coalesce("_went", F.lit(False))})
        if mode is DedupMode.BLOOM:
            new = bloom_unseen(old.filter("not _seen").select(*KEYS), seen.select(*KEYS)).withColumn("_new", F.lit(True))
            old = durable(old, "crawl-paths").join(new, list(KEYS), "left").withColumn("_seen", F.col("_new").isNull()).drop("_new")
        old = durable(old, "crawl-paths")
        # an update walks on through seen pages, but through each of them once
        going = (~F.col("_seen") | (F.col("action") == "update")) & ~F.col("_went")
        walk = old.filter(going)
        if facts is None:
            got = durable(fetch(walk, pages).withColumns({"html": F.coalesce("html", F.lit("")), "page": F.xxhash64(*KEYS)}), "crawl-fetched")
            kept.append(got.select("page", F.col("path").alias("url"), "html"))
            hit = got.select(*walk.columns, "page", *page_facts(F.col("html"), rewriters))
        else:
            hit = walk.join(facts, "path", "left")
        step = durable(hit.withColumns({"missing": F.coalesce("missing", F.lit(True)), "blank": F.coalesce("blank", F.lit(True))}), "crawl-step")
        ok = step.filter("not missing and not blank")
        new = ok.filter("not _seen").select(
            F.xxhash64("catalog_id", "path", "version").alias("id"), "title", F.col("path").alias("url"), "cat", "version", "catalog_id", "refer", "page"
        )
        marked = first_of_key(new)
        if stored:
            had = _union(stored).select(*UNIQUE).withColumn("_had", F.lit(True))
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in UNIQUE]
            marked = marked.alias("n").join(had.alias("h"), same, "left").select("n.*", "_had")
            marked = marked.withColumn("is_saved", F.col("is_saved") & F.col("_had").isNull()).drop("_had")
        marked = durable(marked, "crawl-saved")
        follow = ok.withColumns({"action": F.when(F.col("_seen"), F.col("action")).otherwise("crawl"), "level": F.lit(level)})
        links = durable(outgoing(follow, details, resolve_links, robots, acceptors), "crawl-links")
        outcomes = _log(old, step, marked, links, level)
        last = None
        if limited and budget.counter != COUNTERS[0]:
            last = _last_paths(outcomes, spent, budget.counter, budget.most)
        outcomes = _up_to(outcomes, last, "source").drop("source")
        outcomes = durable(outcomes, "crawl-log") if limited else outcomes
        logs.append(outcomes)
        stored.append(_up_to(marked.filter("is_saved"), last, "url").drop("is_saved", "refer"))
        known.append(_up_to(walk, last, "path").select(*KEYS, F.lit(True).alias("_went")))
        if limited:
            counted = run_counters(outcomes)
            if spent is not None:
                counted = spent.unionByName(counted).groupBy(*RUN).agg(*(F.sum(c.lower()).alias(c.lower()) for c in COUNTERS))
            spent = durable(counted, "run-counters")
        for parts, label in ((known, "visited"), (stored, "crawl-stored"), (logs, "crawl-log")):
            if len(parts) > COMPACT_LEVELS:
                whole = _union(parts)
                parts[:] = [durable(whole.groupBy(*KEYS).agg(F.max("_went").alias("_went")) if parts is known else whole, label)]
        frontier = _up_to(links, last, "source").filter("accepted").select("action", "catalog_id", "refer", "path", "cat", "version")
        level += 1
        if limited:
            frontier = frontier.join(spent.filter(F.col(budget.counter.lower()) <= budget.most).select(*RUN), list(RUN), "left_semi")
        if frontier.isEmpty():
            if limited and not spent.filter(F.col(budget.counter.lower()) > budget.most).isEmpty():
                stopped = "size"
            break
    else:
        stopped = "levels"
    log = _union(logs) if logs else spark.createDataFrame([], LOG)
    saved = spark.createDataFrame([], RESOURCE).drop("create_time")
    if stored:
        # html meets what was saved, once
        source = _union(kept) if facts is None else pages.select(F.col("id").alias("page"), "url", "html").filter("html is not null").dropDuplicates(["page", "url"])
        saved = _union(stored).join(source, ["page", "url"]).withColumn("html", rewritten(F.col("html"), list(rewriters)))
        saved = saved.select("id", "title", "html", "url", "cat", "version", "catalog_id")
    return CrawlResult(saved, _union(known).select(*KEYS).distinct(), log, level, stopped)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _log(old: DataFrame, step: DataFrame, marked: DataFrame, links: DataFrame, level: int) -> DataFrame:
    """Outcome rows of one level: totals, existing, invalid, saved, indexed, filtered; `source` is the path of the packet they come from."""
    base = ["catalog_id", "refer", "path", "version", "action"]
    own = F.col("path").alias("source")
    # every packet of a path counts; all but the first of a new path exist already
    total = old.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    existing = total.filter("_seen or k > 1").select(*base, own, F.lit(COUNTERS[2]).alias("outcome"))
    invalid = step.filter("missing").select(*base, own, F.lit(COUNTERS[1]).alias("outcome"))
    pages = marked.select("catalog_id", "refer", F.col("url").alias("path"), "version", F.lit("crawl").alias("action"), "is_saved")
    saved = pages.filter("is_saved").select(*base, own, F.explode(F.array(F.lit(COUNTERS[4]), F.lit(COUNTERS[5]))).alias("outcome"))
    taken = pages.filter("not is_saved").select(*base, own, F.lit(COUNTERS[2]).alias("outcome"))
    filtered = links.filter("not accepted").select(*base, "source", F.lit(COUNTERS[3]).alias("outcome"))
    parts = [total.select(*base, own, F.lit(COUNTERS[0]).alias("outcome")), existing, invalid, saved, taken, filtered]
    return _union(parts).withColumn("level", F.lit(level))


def partitioned(frontier: DataFrame, parts: int) -> DataFrame:
    """Packets of one path together, as the exchange between steps lays them out."""
    return frontier.repartition(parts, *KEYS)


def actions(frontier: DataFrame) -> dict[str, DataFrame]:
    """Packets by action; another action is an error of the caller and is not in any part."""
    return {name: frontier.filter(F.col("action") == name) for name in ("crawl", "update", "index")}


__all__ = ["Budget", "CrawlResult", "crawl", "fetched", "outgoing", "partitioned", "actions", "rewritten", "seeds", "unseen"]
