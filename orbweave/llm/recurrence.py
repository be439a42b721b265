"""Items that recur across many pages of one site: exact distinct-page counts at the cost of row counts.

Pages come as one row with an array of item hashes. A first pass counts rows per (site, item) with
map-side combine; as an item's rows are at least its distinct pages, that prunes without loss. What is
left per site is bounded by page length and not by the number of pages: the counts of a site's items add
up to at most its pages times items a page, so at most (items a page) / (share) of them can recur. Exact
distinct counts then run over those few items only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of the short per-site lists; a hot site's pages are spread over them in the join.
SALTS = 8
#: Entries of all lists up to which the optimizer may copy them to every executor (8 bytes each, times SALTS); above, pages
#: and lists meet by shuffle and sort whatever the size of the file.
BROADCAST_ENTRIES = 500_000


def by_site(pages: DataFrame, lists: DataFrame, how: str = "inner", site: str = "site", key: str = "page", entries: str | None = None) -> DataFrame:
    """Join pages with one row per site, hot sites spread over salts.

    `entries` names a list column of `lists`, a written table: its entries are counted and decide whether a broadcast is allowed.

    The salt also counts the input partition, so rows that are alike in everything do not meet in one task either.
    """
    if entries and (lists.agg(F.sum(F.size(entries))).first()[0] or 0) > BROADCAST_ENTRIES:
        lists = lists.hint("merge")
    salted = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(SALTS)) + F.spark_partition_id(), F.lit(SALTS)).cast("int")
    return pages.withColumn("_salt", salt).join(salted, [site, "_salt"], how).drop("_salt")


def recurring_items(pages: DataFrame, least: int, share: float | None = None, condition: Column | None = None) -> DataFrame:
    """(site, items array<bigint>, counts array<bigint>, n) of items on enough distinct pages of their site.

    `pages`: site, page (what counts as one page, any number of rows each), items array<bigint>. An item
    recurs if it is on `least` distinct pages or more and `condition` over c and n holds (default:
    c >= share * n). Sites without recurring items are left out.
    """
    condition = F.col("c") >= F.lit(share) * F.col("n") if condition is None else condition
    sizes = pages.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("n"))
    rough = (
        pages.select("site", F.explode(F.array_distinct("items")).alias("item"))
        .groupBy("site", "item")
        .agg(F.count("*").alias("c"))
        .filter(F.col("c") >= least)
    )
    candidates = (
        by_site(rough, sizes, key="item")
        .filter(condition)
        .groupBy("site")
        .agg(F.sort_array(F.collect_list("item")).alias("candidates"), F.first("n").alias("n"))
    )
    # of the few items left every (page, item) counts once, whatever the rows of the page
    found = (
        by_site(pages, candidates.select("site", "candidates"))
        .select("site", "page", F.explode(F.array_intersect("items", "candidates")).alias("item"))
        .distinct()
        .groupBy("site", "item")
        .agg(F.count("*").alias("c"))
    )
    named = by_site(found, sizes, key="item")
    return (
        named.filter((F.col("c") >= least) & condition)
        .groupBy("site")
        .agg(F.sort_array(F.collect_list(F.struct("item", "c"))).alias("x"), F.first("n").alias("n"))
        .select("site", F.col("x.item").alias("items"), F.col("x.c").alias("counts"), "n")
    )
