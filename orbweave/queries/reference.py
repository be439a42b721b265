"""Queries of the crawl, index and search operators, each over whole tables, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import html, robots, urls
from orbweave.operators import accept, catalogs, counters, dedup, index, search
from orbweave.plans import crawl
from orbweave.session import table
from orbweave.sources.fetchers import fetched

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is some."""

    def add(fn):
        name = f"ref_{fn.__name__}"
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawler_catalog")


def _index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawler_catalog_index")


def _resource(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawler_resource")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "indexed_resource")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


OUTCOME = {"view": "URL_TOTAL_COUNT", "click": "SAVED_RESOURCE_COUNT", "signup": "INDEXED_RESOURCE_COUNT", "error": "INVALID_URL_COUNT", "purchase": "EXISTING_URL_COUNT"}
_BODY_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<head.*?</head>', ' ', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
 '(?s)<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"""
_ROOT_SQL = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*')"
_HOST_SQL = "nullif(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')"
_TOKENS_SQL = r"list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


# sources and sinks


@query("SELECT id, name, url, cat, depth, interval_ms, indexed FROM crawler_catalog WHERE indexed")
def s1_catalog_scan(spark, d):
    """Table scan with an explicit schema, filter and columns pushed down."""
    return _catalog(spark, d).filter("indexed").select("id", "name", "url", "cat", "depth", "interval_ms", "indexed")


@query("SELECT id, title, url, cat, version, catalog_id FROM crawler_resource WHERE version = 1")
def s1_resource_scan(spark, d):
    return _resource(spark, d).filter("version = 1").select("id", "title", "url", "cat", "version", "catalog_id")


def _scratch_engine(spark, d):
    """An engine over a copy of the tables in the shared folder."""
    import uuid

    from orbweave.engine import Engine
    from orbweave.session import shared_folder

    engine = Engine(spark, f"{shared_folder(spark)}/engine-{uuid.uuid4().hex}")
    for name, rows in (("catalog", _catalog), ("catalog_index", _index), ("resource", _resource), ("indexed_resource", _docs)):
        engine.store.write(name, rows(spark, d))
    return engine


@query("""SELECT id, CASE WHEN running_state = 'crawl' THEN 'none' ELSE running_state END AS running_state, coalesce(name, '') AS name
FROM crawler_catalog WHERE cat <> 'shop' OR cat IS NULL""")
def s2_update_and_delete(spark, d):
    """Update and delete in the engine's store: a new generation of the table, read back."""
    store = _scratch_engine(spark, d).store
    rows = store.read("catalog").filter("cat <> 'shop' or cat is null")
    state = F.when(F.col("running_state") == "crawl", "none").otherwise(F.col("running_state"))
    return store.write("catalog", rows.withColumns({"running_state": state, "name": F.coalesce("name", F.lit(""))})).select("id", "running_state", "name")


@query("""SELECT id, CASE WHEN trim(h) = '' THEN '' ELSE h END AS html FROM (
 SELECT id, replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), chr(13), '') AS h FROM crawler_resource)""")
def s9_rewriting_chain(spark, d):
    """Pages through a chain of rewriters."""
    chain = [lambda h: F.coalesce(h, F.lit("")), lambda h: F.regexp_replace(h, r"(?s)<!--.*?-->", ""), lambda h: F.replace(h, F.lit("\r"), F.lit(""))]
    return _resource(spark, d).select("id", crawl.rewritten(F.col("html"), chain).alias("html"))


@query(f"""WITH fresh AS (SELECT r.id, r.title, {_BODY_SQL} AS content, c.url, r.url AS path, r.cat, c.name AS catalog, r.version,
 epoch_us(r.create_time) // 1000 AS create_time FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id WHERE r.version = 0)
SELECT * FROM fresh UNION ALL SELECT id, title, content, url, path, cat, catalog, version, create_time FROM indexed_resource
WHERE id NOT IN (SELECT id FROM fresh)""")
def s15_index_upsert(spark, d):
    """Upsert of documents by resource id."""
    fresh = index.documents(_resource(spark, d).filter("version = 0"), _catalog(spark, d), F.col("version"))
    return index.upsert(_docs(spark, d).select(*index.FIELDS), fresh)


@query("""WITH p AS (SELECT url, arg_max(html, id) AS html FROM crawler_resource WHERE html IS NOT NULL GROUP BY url)
SELECT i.id, i.path, coalesce(p.html, '') = '' AS invalid FROM indexed_resource i LEFT JOIN p ON p.url = i.path""")
def s18_default_body(spark, d):
    """Fetch with the default body on a miss."""
    return fetched(_docs(spark, d).select("id", "path"), _resource(spark, d).select("url", F.col("html"), "id")).select("id", "path", (F.col("html") == "").alias("invalid"))


@query("""SELECT catalog_id, refer, path, version, row_number() OVER (ORDER BY catalog_id NULLS FIRST, refer NULLS FIRST, path NULLS FIRST, version) AS position FROM (
 SELECT DISTINCT r.catalog_id, c.url AS refer, r.url AS path, r.version FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id)
ORDER BY position LIMIT 100""")
def s19_filter_export(spark, d):
    """Export of the first seen paths with a running index (the limit is the operator's)."""
    return dedup.export(_visited(spark, d), limit=100)


@query("""SELECT catalog_id, refer, path, version, row_number() OVER (ORDER BY catalog_id NULLS FIRST, refer NULLS FIRST, path NULLS FIRST, version) AS position FROM (
 SELECT DISTINCT r.catalog_id, c.url AS refer, r.url AS path, r.version FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id)""")
def s19_whole_export(spark, d):
    """Export of all seen paths with their index, ranged over tasks."""
    return dedup.export(_visited(spark, d))


def _visited(spark, d):
    refer = _catalog(spark, d).select(F.col("id").alias("catalog_id"), F.col("url").alias("refer"))
    return _resource(spark, d).join(refer, "catalog_id").select("catalog_id", "refer", F.col("url").alias("path"), "version")


# projections


@query("""SELECT id, coalesce(nullif(trim(page_encoding), ''), 'UTF-8') AS page_encoding, coalesce(max_fetch_size, 10000) AS max_fetch_size,
 coalesce(depth, -1) AS depth, coalesce(duration, 5) AS duration, coalesce(interval_ms, 1000) AS interval_ms, coalesce(counting_type, 0) AS counting_type,
 coalesce(max_retry_count, 0) AS max_retry_count, coalesce(nullif(trim(url_path_filter), ''), 'redission-bloomfilter') AS url_path_filter,
 coalesce(nullif(trim(extractor), ''), 'resttemplate') AS extractor FROM crawler_catalog""")
def c1_defaults(spark, d):
    """Policy fields with their defaults."""
    return catalogs.catalog_details(_catalog(spark, d)).select("id", "page_encoding", "max_fetch_size", "depth", "duration", "interval_ms", "counting_type", "max_retry_count", "url_path_filter", "extractor")


@query("""SELECT id, pos, parts[pos] AS pattern FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (
 SELECT id, CASE WHEN trim(coalesce(path_pattern, '')) = '' THEN [] ELSE string_split(regexp_replace(path_pattern, ',+$', ''), ',') END AS parts FROM crawler_catalog))""")
def c2_csv_lists(spark, d):
    """Comma-separated lists, untrimmed."""
    return _catalog(spark, d).select("id", F.posexplode(catalogs.csv_list(F.col("path_pattern"))).alias("pos", "pattern")).withColumn("pos", (F.col("pos") + 1).cast("bigint"))


@query("""SELECT event_id, key AS name, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def c3_json_map(spark, d):
    """JSON objects as maps."""
    return _events(spark, d).select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


@query(f"""SELECT id, CASE WHEN trim(coalesce(path_pattern, '')) <> '' THEN path_pattern ELSE regexp_extract(url, '^([a-z]+)://', 1) || '://**.' ||
 string_split({_HOST_SQL.format('url')}, '.')[-2] || '.**/**' END AS pattern,
 regexp_extract(url, '^([a-z]+)://', 1) || '://**.' || string_split({_HOST_SQL.format('url')}, '.')[-2] || '.**/**' AS default_pattern FROM crawler_catalog""")
def c4_default_pattern(spark, d):
    """Default path patterns from protocol and domain."""
    default = urls.default_path_pattern(F.col("url"))
    return _catalog(spark, d).select("id", F.coalesce(F.when(F.trim("path_pattern") != "", F.col("path_pattern")), default).alias("pattern"), default.alias("default_pattern"))


@query("SELECT id, CASE WHEN p = url || '/' THEN url ELSE p END AS path FROM (SELECT id, url, coalesce(start_url, url || '/') AS p FROM crawler_catalog)")
def c5_closing_slash(spark, d):
    """The site's root with a slash."""
    p = F.coalesce("start_url", F.concat("url", F.lit("/")))
    return _catalog(spark, d).select("id", urls.without_closing_slash(p, F.col("url")).alias("path"))


@query("""SELECT catalog_id, count(*) AS packets, count(DISTINCT (refer, path, version)) AS paths FROM (
 SELECT r.catalog_id, c.url AS refer, r.url AS path, r.version FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id WHERE r.url IS NOT NULL) GROUP BY catalog_id""")
def c6_path_identity(spark, d):
    """Identity by four values."""
    seen = _visited(spark, d).filter("path is not null").groupBy(*dedup.KEYS).agg(F.count("*").alias("n"))
    return seen.groupBy("catalog_id").agg(F.sum("n").alias("packets"), F.count("*").alias("paths"))


@query(r"""SELECT id, len(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|(?is)<(script|style)\b.*?</(script|style)\s*>', '', 'g'), '(?is)<a\s[^>]*?href\s*=\s*["'']?[^"''>\s]')) AS links FROM crawler_resource""")
def c7_exact_parse(spark, d):
    """Pages through the exact tier: number of links."""
    p = html.parsed("html")
    return _resource(spark, d).select("id", p.alias("p")).select("id", F.size("p.links").cast("bigint").alias("links"))


@query(r"""SELECT id, trim(regexp_replace(coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ''), '[ \t\n\r]+', ' ', 'g')) AS page_title FROM crawler_resource WHERE html IS NOT NULL""")
def c8_title(spark, d):
    return _resource(spark, d).filter("html is not null").select("id", html.title(F.col("html")).alias("page_title"))


@query(f"SELECT id, {_BODY_SQL} AS body FROM crawler_resource WHERE html IS NOT NULL")
def c9_body_text(spark, d):
    return _resource(spark, d).filter("html is not null").select("id", html.body_text(F.col("html")).alias("body"))


@query("SELECT id, html, length(html) AS n FROM crawler_resource")
def c10_stored_html(spark, d):
    """Html is stored as it came."""
    return _resource(spark, d).select("id", "html", F.length("html").cast("bigint").alias("n"))


@query(r"""SELECT id, href, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"', 1)) AS href FROM crawler_resource) GROUP BY id, href""")
def c11_links(spark, d):
    """Link extraction."""
    return _resource(spark, d).select("id", F.explode(html.links(F.col("html"))).alias("href")).groupBy("id", "href").agg(F.count("*").alias("n"))


_LINKS_SQL = r"""SELECT r.id, r.catalog_id, c.url AS refer, r.url AS base, c.depth AS d0, unnest(regexp_extract_all(r.html, '(?is)<a\s[^>]*?href="([^"]*)"', 1)) AS href
 FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id WHERE r.url IS NOT NULL"""
_RESOLVED_SQL = f"""SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href WHEN starts_with(href, '/') THEN {_ROOT_SQL.format('base')} || href
 WHEN starts_with(href, '#') THEN regexp_replace(base, '#.*$', '') || href ELSE NULL END AS link FROM ({_LINKS_SQL})"""


def _links(spark, d):
    policy = _catalog(spark, d).select(F.col("id").alias("catalog_id"), F.col("url").alias("refer"), F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"),
        catalogs.csv_list(F.col("path_pattern")).alias("included"), catalogs.csv_list(F.col("excluded_path_pattern")).alias("excluded"))
    rows = _resource(spark, d).filter("url is not null").join(policy, "catalog_id")
    found = rows.select("id", "catalog_id", "refer", F.col("url").alias("base"), "depth", "included", "excluded", F.explode(html.links(F.col("html"))).alias("href"))
    return found.withColumn("link", urls.resolved(F.col("href"), F.col("base")))


@query(f"SELECT link, count(*) AS n FROM ({_RESOLVED_SQL}) GROUP BY link")
def c12_resolved_links(spark, d):
    """Links against the page they stand on."""
    return _links(spark, d).groupBy("link").agg(F.count("*").alias("n"))


@query("""SELECT r.id, CASE lower(trim(coalesce(c.page_encoding, ''))) WHEN 'windows-1252' THEN 'cp1252' WHEN 'iso-8859-1' THEN 'iso8859-1' WHEN 'latin1' THEN 'iso8859-1'
 WHEN 'gbk' THEN 'gbk' WHEN 'gb18030' THEN 'gb18030' WHEN 'euc-jp' THEN 'euc_jp' WHEN 'koi8-r' THEN 'koi8-r' WHEN 'shift_jis' THEN 'shift_jis' WHEN 'windows-1251' THEN 'cp1251'
 WHEN 'big5' THEN 'big5' WHEN 'ascii' THEN 'ascii' WHEN 'us-ascii' THEN 'ascii' ELSE 'utf-8' END AS charset, true AS intact
FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id WHERE r.html IS NOT NULL""")
def c13_charset(spark, d):
    """Pages written as bytes in their catalog's charset, whatever its spelling, and read back: none is damaged."""
    from orbweave.sources.fetchers import charset_of, decoded_pages, encoded_pages

    @F.pandas_udf("string")
    def resolved(names: pd.Series) -> pd.Series:
        return names.map(charset_of)

    enc = _catalog(spark, d).select(F.col("id").alias("catalog_id"), "page_encoding")
    pages = _resource(spark, d).filter("html is not null").select("id", "catalog_id", "html").join(enc, "catalog_id")
    once = decoded_pages(encoded_pages(pages).drop("html"))
    twice = decoded_pages(encoded_pages(once.select("id", "page_encoding", "html")).withColumnRenamed("html", "before"))
    return twice.select("id", resolved("page_encoding").alias("charset"), (F.col("html") == F.col("before")).alias("intact"))


@query("SELECT id, epoch_us(create_time) // 1000 AS ms FROM crawler_resource")
def c14_epoch_ms(spark, d):
    return _resource(spark, d).select("id", index.epoch_ms(F.col("create_time")).alias("ms"))


@query(f"SELECT {_HOST_SQL.format('url')} AS host, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1), '') AS protocol, count(*) AS pages FROM crawler_resource GROUP BY 1, 2")
def c15_host_and_protocol(spark, d):
    return _resource(spark, d).groupBy(urls.host(F.col("url")).alias("host"), urls.protocol(F.col("url")).alias("protocol")).agg(F.count("*").alias("pages"))


@query("SELECT event_id, printf('%dH %dm %ds', s // 3600, (s % 3600) // 60, s % 60) AS elapsed FROM (SELECT event_id, event_id * 7919 // 1000 AS s FROM events)")
def c16_elapsed_text(spark, d):
    return _events(spark, d).select("event_id", counters.elapsed_text(F.col("event_id") * 7919).alias("elapsed"))


@query("SELECT id, coalesce(CAST(id AS VARCHAR), '') AS display_id FROM crawler_catalog")
def c17_display_id(spark, d):
    return _catalog(spark, d).select("id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("display_id"))


@query("SELECT catalog_id, count(*) AS pages, count(DISTINCT (url, version)) AS ids FROM crawler_resource WHERE url IS NOT NULL GROUP BY catalog_id")
def c19_identifiers(spark, d):
    """Ids that depend on catalog, url and version only: as many as there are of those."""
    rows = _resource(spark, d).filter("url is not null").select("catalog_id", F.xxhash64("catalog_id", "url", "version").alias("stable_id"))
    return rows.groupBy("catalog_id").agg(F.count("*").alias("pages"), F.count_distinct("stable_id").alias("ids"))


@query("SELECT id, title, content, url, path, cat, catalog, version, make_timestamp(create_time * 1000) AS create_time FROM indexed_resource")
def c20_search_result(spark, d):
    """Documents as results, the time as a timestamp."""
    return _docs(spark, d).withColumn("create_time", F.timestamp_millis("create_time").cast("timestamp_ntz")).select(*index.FIELDS)


# predicates


def _robots_files(spark, d):
    kind = F.when(F.col("cat") == "blog", "User-agent: *\nDisallow: /news\nAllow: /news/a").when(F.col("cat") == "travel", "User-agent: *\nDisallow: /*.html$\n").otherwise("# nothing here")
    return _catalog(spark, d).withColumn("host", urls.host(F.col("url"))).groupBy("host").agg(F.min_by(kind, "id").alias("content"))


@query(f"""WITH f AS (SELECT host, k FROM (SELECT {_HOST_SQL.format('url')} AS host, cat AS k, row_number() OVER (PARTITION BY {_HOST_SQL.format('url')} ORDER BY id) AS n FROM crawler_catalog) WHERE n = 1)
SELECT r.id, CASE WHEN k = 'blog' THEN NOT starts_with(p, '/news') OR starts_with(p, '/news/a') WHEN k = 'travel' THEN NOT regexp_matches(p, '\\.html$') ELSE true END AS allowed
FROM (SELECT id, {_HOST_SQL.format('url')} AS host, coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1), ''), '/') AS p FROM crawler_resource WHERE url IS NOT NULL) r LEFT JOIN f ON f.host = r.host""")
def p1_robots(spark, d):
    """Robots rules by host, longest match first."""
    rows = _resource(spark, d).filter("url is not null").select("id", "url", urls.host(F.col("url")).alias("h"))
    return robots.allowed(rows, robots.rules(_robots_files(spark, d)), "url", "h").select("id", "allowed")


@query(f"""SELECT id, link, count(*) AS n, depth FROM (SELECT *, length(q) - length(replace(q, '/', '')) AS depth FROM (
 SELECT *, regexp_replace(replace(link, refer, ''), '^/', '') AS q FROM ({_RESOLVED_SQL}))) WHERE coalesce(d0, -1) < 0 OR depth <= d0 GROUP BY id, link, depth""")
def p2_depth(spark, d):
    """Links within the catalog's depth."""
    rows = _links(spark, d).withColumn("links_depth", accept.link_depth(F.col("link"), F.col("refer")))
    kept = rows.filter(accept.within_depth(F.col("link"), F.col("refer"), F.col("depth")))
    return kept.groupBy("id", "link", "links_depth").agg(F.count("*").alias("n")).select("id", "link", "n", F.col("links_depth").cast("bigint").alias("depth"))


@query(r"""WITH c AS (SELECT id, url AS refer, CASE WHEN trim(coalesce(path_pattern, '')) = '' THEN [] ELSE string_split(path_pattern, ',') END AS inc,
 CASE WHEN trim(coalesce(excluded_path_pattern, '')) = '' THEN [] ELSE string_split(excluded_path_pattern, ',') END AS exc FROM crawler_catalog),
t AS (SELECT id, refer, list_transform(inc, lambda p: '^' || regexp_replace(replace(replace(regexp_replace(regexp_replace(p, '([.+?(){}|^$\[\]\\])', '\\\1', 'g'), '/\*\*$', '§'), '**/', '¤'), '*', '[^/]*'), '/+', '/+', 'g') || '$') AS inc,
 list_transform(exc, lambda p: '^' || regexp_replace(replace(replace(regexp_replace(regexp_replace(p, '([.+?(){}|^$\[\]\\])', '\\\1', 'g'), '/\*\*$', '§'), '**/', '¤'), '*', '[^/]*'), '/+', '/+', 'g') || '$') AS exc FROM c),
u AS (SELECT id, refer, list_transform(inc, lambda p: replace(replace(p, '§', '(/.*)?'), '¤', '([^/]+/+)*')) AS inc, list_transform(exc, lambda p: replace(replace(p, '§', '(/.*)?'), '¤', '([^/]+/+)*')) AS exc FROM t)
SELECT r.id, CASE WHEN len(list_filter(exc, lambda p: regexp_matches(r.url, p))) > 0 THEN false WHEN len(inc) > 0 THEN len(list_filter(inc, lambda p: regexp_matches(r.url, p))) > 0
 ELSE starts_with(r.url, refer) END AS accepted FROM crawler_resource r JOIN u ON u.id = r.catalog_id WHERE r.url IS NOT NULL""")
def p3_path_patterns(spark, d):
    """Pages accepted by the path patterns of their catalog."""
    policy = _catalog(spark, d).select(F.col("id").alias("catalog_id"), F.col("url").alias("refer"), catalogs.csv_list(F.col("path_pattern")).alias("i"), catalogs.csv_list(F.col("excluded_path_pattern")).alias("e"))
    rows = _resource(spark, d).filter("url is not null").select("id", "url", "catalog_id").join(policy, "catalog_id")
    return rows.select("id", accept.path_accepted(F.col("url"), F.col("refer"), F.col("i"), F.col("e")).alias("accepted"))


@query("""WITH t AS (SELECT r.id, r.catalog_id, c.url AS refer, r.url AS path, r.version FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id WHERE r.url IS NOT NULL)
SELECT DISTINCT catalog_id, refer, path, version FROM t EXCEPT SELECT catalog_id, refer, path, version FROM t WHERE id IN (SELECT id FROM indexed_resource)""")
def p5_seen_before(spark, d):
    """New paths among all arrivals, those of indexed pages having been visited."""
    refer = _catalog(spark, d).select(F.col("id").alias("catalog_id"), F.col("url").alias("refer"))
    rows = _resource(spark, d).filter("url is not null").join(refer, "catalog_id").select("id", "catalog_id", "refer", F.col("url").alias("path"), "version")
    return dedup.unseen(rows, rows.join(_docs(spark, d).select("id"), "id", "left_semi")).select(*dedup.KEYS)


@query(f"SELECT id FROM crawler_resource WHERE html IS NOT NULL AND length({_BODY_SQL}) > 0")
def p6_pages_with_text(spark, d):
    return _resource(spark, d).filter(F.col("html").isNotNull() & (html.body_text(F.col("html")) != "")).select("id")


@query("SELECT id, name, cat, url FROM crawler_catalog WHERE name LIKE '%Online%' AND cat = 'travel' AND url LIKE '%example%'")
def p7_listing_filter(spark, d):
    ix = _index(spark, d)
    return catalogs.listing(_catalog(spark, d), ix, "Online", "travel", "example").select("id", "name", "cat", "url").distinct()


@query("SELECT id, running_state FROM crawler_catalog WHERE running_state IS NOT NULL AND running_state <> 'none'")
def p8_running_catalogs(spark, d):
    return catalogs.running(_catalog(spark, d)).select("id", "running_state")


@query("SELECT id, version, cat FROM indexed_resource WHERE version = 1 AND cat = 'travel'")
def p9_search_filters(spark, d):
    return search.scored(_docs(spark, d), "", 1, "travel").select("id", "version", "cat")


@query(f"SELECT id FROM indexed_resource WHERE list_has_any({_TOKENS_SQL.format('title')}, ['harbour', 'bridge'])")
def p10_title_must_match(spark, d):
    return search.scored(_docs(spark, d), "harbour bridge").select("id")


@query("SELECT id, version FROM indexed_resource WHERE NOT (version = 1 AND catalog = (SELECT name FROM crawler_catalog WHERE id = 1001) AND url = (SELECT url FROM crawler_catalog WHERE id = 1001)) OR catalog IS NULL")
def p11_delete_by_query(spark, d):
    return index.delete_documents(_docs(spark, d), _catalog(spark, d), 1001, 1).select("id", "version")


@query("""SELECT l.catalog_id, l.path, l.path = c.url OR l.path = c.url || '/' AS is_index_page FROM (
 SELECT catalog_id, arg_max(url, create_time) AS path FROM (SELECT * FROM crawler_resource WHERE create_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY create_time DESC, id DESC) = 1) GROUP BY catalog_id) l
JOIN crawler_catalog c ON c.id = l.catalog_id""")
def p12_index_page(spark, d):
    latest = catalogs.latest_path(_resource(spark, d))
    site = _catalog(spark, d).select(F.col("id").alias("catalog_id"), "url")
    return latest.join(site, "catalog_id").select("catalog_id", "path", catalogs.is_index_page(F.col("path"), F.col("url")).alias("is_index_page"))


# joins


@query("""SELECT c.id, c.name, i.version FROM crawler_catalog c JOIN crawler_catalog_index i ON i.catalog_id = c.id WHERE c.cat = 'blog'""")
def j1_catalog_with_version(spark, d):
    return catalogs.listing(_catalog(spark, d), _index(spark, d), cat="blog").select("id", "name", "version")


@query("SELECT max(i.version) AS version FROM crawler_catalog_index i JOIN crawler_catalog c ON c.id = i.catalog_id WHERE c.cat = 'travel'")
def j2_max_version_of_category(spark, d):
    return catalogs.max_version(_catalog(spark, d), _index(spark, d), "travel")


_CURRENT_SQL = "(SELECT catalog_id, version FROM crawler_catalog_index QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY last_modified DESC, id DESC) = 1)"


@query(f"SELECT r.id, r.version, i.version AS now FROM crawler_resource r JOIN {_CURRENT_SQL} i ON i.catalog_id = r.catalog_id WHERE r.version <= i.version")
def j3_up_to_version(spark, d):
    return index.indexable(_resource(spark, d), _index(spark, d)).select("id", "version", "now")


@query(f"SELECT c.id, c.name, i.version FROM crawler_catalog c LEFT JOIN {_CURRENT_SQL} i ON i.catalog_id = c.id")
def j4_details_lookup(spark, d):
    return _catalog(spark, d).join(index.current_versions(_index(spark, d)).withColumnRenamed("catalog_id", "id"), "id", "left").select("id", "name", "version")


@query("SELECT r.id, c.name AS catalog, c.url FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id")
def j5_enrichment(spark, d):
    return index.documents(_resource(spark, d), _catalog(spark, d), F.col("version")).select("id", "catalog", "url")


@query("""SELECT i.id, length(coalesce(p.html, '')) AS n FROM indexed_resource i LEFT JOIN (SELECT url, arg_max(html, id) AS html FROM crawler_resource WHERE html IS NOT NULL GROUP BY url) p ON p.url = i.path""")
def j6_fetch_join(spark, d):
    return fetched(_docs(spark, d).select("id", "path"), _resource(spark, d)).select("id", F.length("html").cast("bigint").alias("n"))


@query("SELECT id FROM crawler_resource r WHERE NOT EXISTS (SELECT 1 FROM indexed_resource i WHERE i.id = r.id)")
def j7_not_indexed(spark, d):
    return _resource(spark, d).join(_docs(spark, d).select("id"), "id", "left_anti").select("id")


# aggregations


@query("SELECT c.cat, max(i.version) AS version FROM crawler_catalog_index i JOIN crawler_catalog c ON c.id = i.catalog_id GROUP BY c.cat")
def a1_max_version(spark, d):
    cat = _catalog(spark, d).select(F.col("id").alias("catalog_id"), "cat")
    return _index(spark, d).join(cat, "catalog_id").groupBy("cat").agg(F.max("version").alias("version"))


@query("SELECT DISTINCT cat FROM crawler_catalog")
def a2_categories(spark, d):
    return _catalog(spark, d).select("cat").distinct()


def _tagged(spark, d):
    return _events(spark, d).withColumn("outcome", F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOME.items() for x in kv]), F.col("event_type")))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS url_total_count, count(*) FILTER (event_type = 'error') AS invalid_url_count,
 count(*) FILTER (event_type = 'purchase') AS existing_url_count, CAST(0 AS BIGINT) AS filtered_url_count, count(*) FILTER (event_type = 'click') AS saved_resource_count,
 count(*) FILTER (event_type = 'signup') AS indexed_resource_count FROM events GROUP BY user_id""")
def a3_run_counters(spark, d):
    """Six counters in one pass."""
    return counters.run_counters(_tagged(spark, d), by=("user_id",))


@query("""SELECT event_type, round(coalesce(avg(value) FILTER (value > 0), 0), 9) AS mean_latency FROM (
 SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 256 GROUP BY event_type""")
def a5_mean_latency(spark, d):
    return counters.mean_latency(_events(spark, d), "event_type", [F.desc("ts"), F.desc("event_id")], "value").withColumn("mean_latency", F.round("mean_latency", 9))



@query(f"SELECT count(*) AS hits FROM indexed_resource WHERE list_has_any({_TOKENS_SQL.format('title')}, ['garden'])")
def a6_hit_count(spark, d):
    return search.hit_count(_docs(spark, d), "garden")


@query("SELECT count(*) AS n FROM indexed_resource")
def a7_index_size(spark, d):
    return _docs(spark, d).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS seen FROM (SELECT DISTINCT r.catalog_id, c.url, r.url AS path, r.version FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id)")
def a8_seen_size(spark, d):
    return dedup.seen_size(_visited(spark, d))


@query("SELECT true AS close")
def a8_seen_estimate(spark, d):
    """The estimate is within a tenth of the exact size."""
    exact, rough = dedup.seen_size(_visited(spark, d)), dedup.seen_size(_visited(spark, d), exact=False).withColumnRenamed("seen", "rough")
    return exact.select("seen", F.lit(1).alias("k")).join(rough.withColumn("k", F.lit(1)), "k").select((F.abs(F.col("rough") / F.col("seen") - 1) < 0.1).alias("close"))


# dedup


@query("SELECT DISTINCT catalog_id, url FROM crawler_resource WHERE url IS NOT NULL")
def d1_exact(spark, d):
    return _resource(spark, d).filter("url is not null").select("catalog_id", "url").dropDuplicates(["catalog_id", "url"])


@query("SELECT CAST(0 AS BIGINT) AS kept_old, true AS within_bound")
def d2_bloom(spark, d):
    """New paths through a Bloom filter (D2, D3): no old one is kept, and of the new ones few are lost, as bounded."""
    rows = _visited(spark, d).filter("path is not null")
    old = F.pmod(F.xxhash64("path"), F.lit(2)) == 1
    frontier, seen = rows, rows.filter(old)
    kept = dedup.bloom_unseen(frontier, seen).select(*dedup.KEYS)
    new = dedup.unseen(frontier, seen).select(*dedup.KEYS)
    both = kept.withColumns({"k": F.lit(1), "n": F.lit(0)}).unionByName(new.withColumns({"k": F.lit(0), "n": F.lit(1)})).groupBy(*dedup.KEYS).agg(F.max("k").alias("k"), F.max("n").alias("n"))
    return both.agg(F.count_if(F.expr("k = 1 and n = 0")).alias("kept_old"), (F.count_if(F.expr("k = 0 and n = 1")) <= 0.05 * F.count_if(F.expr("n = 1")) + 5).alias("within_bound"))


@query("SELECT id, CASE coalesce(nullif(trim(url_path_filter), ''), 'redission-bloomfilter') WHEN 'redis' THEN 'exact' WHEN 'rocksdb' THEN 'stream' ELSE 'bloom' END AS mode FROM crawler_catalog")
def d5_filter_choice(spark, d):
    """How each catalog's run remembers what it has seen."""

    @F.pandas_udf("string")
    def mode(names: pd.Series) -> pd.Series:
        return names.map(lambda n: dedup.DedupMode.by_name(n).value)

    return catalogs.catalog_details(_catalog(spark, d)).select("id", mode("url_path_filter").alias("mode"))


@query()
def d4_streaming(spark, d):
    """Seen paths on the RocksDB state store, as a stream over the files."""
    from orbweave.streaming import runs

    runs.use_rocksdb(spark)
    stream = runs.read_stream(spark, d, "events.parquet", _events(spark, d).schema)
    return _streamed(spark, runs.unseen(stream, ["user_id", "event_type"]).select("user_id", "event_type"), "append")


def _streamed(spark, stream, mode):
    import uuid

    from orbweave.session import shared_folder
    from orbweave.streaming import runs

    name = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return runs.run_to_end(stream, f"{name}/checkpoint", f"{name}/result", mode)


SQL["ref_d4_streaming"] = "SELECT DISTINCT user_id, event_type FROM events"


@query("""SELECT id, row_number() OVER (PARTITION BY catalog_id, cat, version, title, url ORDER BY id) = 1 AS is_saved FROM crawler_resource""")
def d6_unique_key(spark, d):
    return dedup.first_of_key(_resource(spark, d)).select("id", "is_saved")


# order, paging


@query("""SELECT c.id, c.name, i.version FROM crawler_catalog c JOIN crawler_catalog_index i ON i.catalog_id = c.id
ORDER BY c.last_modified DESC, i.last_modified DESC, c.id, i.version LIMIT 10 OFFSET 10""")
def t4_second_page(spark, d):
    """Second page of the listing (order T1, paging T4 and T6)."""
    rows = catalogs.listing(_catalog(spark, d), _index(spark, d))
    return catalogs.page(rows, 2, 10).select("id", "name", "version")


@query("""SELECT catalog_id, url AS path FROM crawler_resource WHERE create_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY create_time DESC, id DESC) = 1""")
def t2_latest_path(spark, d):
    return catalogs.latest_path(_resource(spark, d))


@query("SELECT id, name, url FROM crawler_catalog WHERE id = 2004 LIMIT 1")
def t3_point_lookup(spark, d):
    return _catalog(spark, d).filter("id = 2004").limit(1).select("id", "name", "url")


_CORPUS = "SELECT count(*)::double AS n, avg(len(t)) AS m FROM (SELECT {tok} AS t FROM indexed_resource) WHERE len(t) > 0"


def _bm25_sql(field: str, terms: str) -> str:
    tok = _TOKENS_SQL.format(field)
    return f"""SELECT h.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / m))) AS s FROM (
 SELECT id, dl, term, count(*)::double AS tf FROM (SELECT id, len(t)::double AS dl, unnest(t) AS term FROM (SELECT id, {tok} AS t FROM indexed_resource)) WHERE term IN ({terms}) GROUP BY id, dl, term) h
 JOIN (SELECT term, count(*)::double AS df FROM (SELECT DISTINCT id, unnest({tok}) AS term FROM indexed_resource) WHERE term IN ({terms}) GROUP BY term) f ON f.term = h.term,
 ({_CORPUS.format(tok=tok)}) GROUP BY h.id"""


_T = "'harbour', 'bridge'"


def _postings(spark, d):
    """The inverted index, built once a session and data folder, as the engine keeps it: stored by bucket of terms."""
    from orbweave.session import shared_folder

    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        _BUILT.clear()
        path = f"{shared_folder(spark)}/postings-{abs(hash(key))}"
        search.inverted(_docs(spark, d)).write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(path)
        _BUILT[key] = path
    return spark.read.parquet(_BUILT[key])


_BUILT: dict[tuple[str, str], str] = {}


@query(f"SELECT id, round(s, 6) AS score FROM ({_bm25_sql('title', _T)})")
def f2_bm25(spark, d):
    return search.bm25(_docs(spark, d), "title", ["harbour", "bridge"]).select("id", F.round("score", 6).alias("score"))


@query(f"""SELECT t.id, round(t.s + coalesce(c.s, 0), 6) AS score FROM ({_bm25_sql('title', _T)}) t LEFT JOIN ({_bm25_sql('content', _T)}) c ON c.id = t.id
ORDER BY t.s + coalesce(c.s, 0) DESC, t.id LIMIT 10""")
def t7_ranked_page(spark, d):
    """First page of ranked hits from the inverted index: title and content combined (F3, T7)."""
    return search.top(search.scored(_docs(spark, d), "harbour bridge", postings=_postings(spark, d))).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, len({_TOKENS_SQL.format('content')}) AS n, array_to_string(list_sort(list_distinct({_TOKENS_SQL.format('title')})), ' ') AS terms FROM indexed_resource")
def f1_tokens(spark, d):
    return _docs(spark, d).select("id", F.size(search.tokens(F.col("content"))).cast("bigint").alias("n"), F.array_join(F.sort_array(F.array_distinct(search.tokens(F.col("title")))), " ").alias("terms"))



@query(f"""SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOKENS_SQL.format('title')}) AS term FROM indexed_resource) GROUP BY id, term) GROUP BY term""")
def f1_postings(spark, d):
    return search.postings(_docs(spark, d), "title").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"""SELECT id, true AS marked, true AS plain FROM (SELECT t.id FROM ({_bm25_sql('title', _T)}) t LEFT JOIN ({_bm25_sql('content', _T)}) c ON c.id = t.id
ORDER BY t.s + coalesce(c.s, 0) DESC, t.id LIMIT 10)""")
def f4_highlights(spark, d):
    """A page of results: titles have the words marked, and without the marks they are as stored."""
    from orbweave.schemas import HIGHLIGHT_POST, HIGHLIGHT_PRE

    page = search.search(_docs(spark, d), "harbour bridge").select("id", "version", "title")
    plain = F.replace(F.replace("title", F.lit(HIGHLIGHT_PRE), F.lit("")), F.lit(HIGHLIGHT_POST), F.lit(""))
    stored = _docs(spark, d).select("id", "version", F.trim("title").alias("own"))
    checks = page.select("id", "version", F.contains("title", F.lit(HIGHLIGHT_PRE)).alias("marked"), plain.alias("bare")).join(stored, ["id", "version"])
    return checks.select("id", "marked", F.startswith("own", "bare").alias("plain"))


@query("SELECT id, version FROM indexed_resource WHERE version = (SELECT max(i.version) FROM crawler_catalog_index i JOIN crawler_catalog c ON c.id = i.catalog_id WHERE c.cat = 'docs') AND cat = 'docs'")
def f5_version_choice(spark, d):
    """Without a version the highest of the category's catalogs is searched."""
    top = catalogs.max_version(_catalog(spark, d), _index(spark, d), "docs").first()["version"]
    return search.scored(_docs(spark, d), "", top, "docs").select("id", "version")


# index maintenance


_CREATED_SQL = f"""SELECT r.id, r.title, {_BODY_SQL} AS content, c.url, r.url AS path, r.cat, c.name AS catalog, {{v}} AS version, epoch_us(r.create_time) // 1000 AS create_time
 FROM crawler_resource r JOIN {_CURRENT_SQL} i ON i.catalog_id = r.catalog_id JOIN crawler_catalog c ON c.id = r.catalog_id WHERE r.version <= {{v}}"""


@query(_CREATED_SQL.format(v="i.version"))
def v2_create_index(spark, d):
    return index.create_index(_resource(spark, d), _catalog(spark, d), _index(spark, d))


def _one(spark, d):
    """Index rows of the current versions only."""
    current = index.current_versions(_index(spark, d))
    return _index(spark, d).groupBy("catalog_id").agg(F.max("id").alias("id"), F.max("last_modified").alias("last_modified")).join(current, "catalog_id").select("id", "catalog_id", "last_modified", "version")


@query(f"""WITH fresh AS ({_CREATED_SQL.format(v='i.version')}) SELECT * FROM fresh UNION ALL
SELECT id, title, content, url, path, cat, catalog, version, create_time FROM indexed_resource o WHERE id NOT IN (SELECT id FROM fresh)
 AND NOT EXISTS (SELECT 1 FROM crawler_catalog c JOIN {_CURRENT_SQL} i ON i.catalog_id = c.id WHERE c.name = o.catalog AND i.version = o.version)""")
def v3_recreate_index(spark, d):
    return index.recreate_index(_docs(spark, d), _resource(spark, d), _catalog(spark, d), _one(spark, d))


@query(f"""WITH fresh AS ({_CREATED_SQL.format(v='i.version + 1')}) SELECT * FROM fresh UNION ALL
SELECT id, title, content, url, path, cat, catalog, version, create_time FROM indexed_resource o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.id = o.id AND f.version = o.version)""")
def v4_upgrade_index(spark, d):
    return index.upgrade_index(_docs(spark, d), _resource(spark, d), _catalog(spark, d), _one(spark, d))[0]


@query("SELECT id, catalog_id, version + 1 AS version FROM crawler_catalog_index")
def v5_increment_version(spark, d):
    return catalogs.increment_version(_index(spark, d)).select("id", "catalog_id", "version")


@query("SELECT r.id, greatest(r.version, i.v) AS version FROM crawler_resource r LEFT JOIN (SELECT catalog_id, max(version) AS v FROM crawler_catalog_index GROUP BY catalog_id) i ON i.catalog_id = r.catalog_id")
def v6_raise_versions(spark, d):
    return catalogs.raise_resource_versions(_resource(spark, d), _index(spark, d)).select("id", "version")


_SIZES_SQL = """SELECT 'catalog' AS name, (SELECT count(*) FROM crawler_catalog {c}) AS n UNION ALL SELECT 'catalog_index', (SELECT count(*) FROM crawler_catalog_index {i})
UNION ALL SELECT 'resource', (SELECT count(*) FROM crawler_resource WHERE catalog_id <> 1001) UNION ALL SELECT 'indexed_resource', (SELECT count(*) FROM indexed_resource d WHERE NOT EXISTS (
 SELECT 1 FROM crawler_catalog c WHERE c.id = 1001 AND c.name = d.catalog AND c.url = d.url))"""


def _sizes(engine):
    counts = [engine.store.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("catalog", "catalog_index", "resource", "indexed_resource")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(_SIZES_SQL.format(c="", i=""))
def v7_clean_catalog(spark, d):
    """Cleaning one catalog: rows left in the engine's tables."""
    engine = _scratch_engine(spark, d)
    engine.clean_catalog(1001)
    return _sizes(engine)


@query(_SIZES_SQL.format(c="WHERE id <> 1001", i="WHERE catalog_id <> 1001"))
def v8_delete_catalog(spark, d):
    """Deleting one catalog: rows left in the engine's tables."""
    engine = _scratch_engine(spark, d)
    engine.delete_catalog(1001)
    return _sizes(engine)


@query("""SELECT id, CASE WHEN running_state = 'crawl' THEN 'N' || id ELSE name END AS name, url, CASE WHEN running_state = 'crawl' THEN CAST(9 AS SMALLINT) ELSE depth END AS depth FROM crawler_catalog
UNION ALL SELECT id + 1000000, 'new', 'http://new.example', 9 FROM crawler_catalog WHERE id = 1001""")
def v9_save_catalogs(spark, d):
    """Upsert of catalogs: non-null fields win, new ones are added."""
    rows = _catalog(spark, d)
    changes = rows.filter("running_state = 'crawl'").select("id", F.concat(F.lit("N"), "id").alias("name"), F.lit(None).cast("string").alias("url"), F.lit(9).cast("smallint").alias("depth"))
    new = rows.filter("id = 1001").select(F.col("id") + 1000000, F.lit("new"), F.lit("http://new.example"), F.lit(9).cast("smallint"))
    return catalogs.save_catalogs(rows, changes.union(new)).select("id", "name", "url", "depth")


@query("SELECT id, CASE WHEN id = 1001 THEN 'rebuild' ELSE running_state END AS running_state FROM crawler_catalog")
def v10_running_state(spark, d):
    return catalogs.set_running_state(_catalog(spark, d), 1001, "rebuild").select("id", "running_state")


# dataflow


def _graph(spark, d):
    """A derived site per catalog: its distinct urls in order (each url in one site), page i linking to pages (7i+1) and (7i+2) modulo n."""
    at = Window.partitionBy("catalog_id")
    nodes = (
        _resource(spark, d).filter("url is not null").groupBy("url").agg(F.min("catalog_id").alias("catalog_id"))
        .withColumn("i", F.row_number().over(at.orderBy("url")) - 1).withColumn("n", F.count("*").over(at))
    )
    to = nodes.select("catalog_id", F.col("i").alias("j"), F.col("url").alias("target"))
    edges = nodes.withColumn("j", F.explode(F.array((F.col("i") * 7 + 1) % F.col("n"), (F.col("i") * 7 + 2) % F.col("n")))).join(to, ["catalog_id", "j"])
    page = F.concat(F.lit("<html><head><title>page</title></head><body>text "), F.array_join(F.transform(F.sort_array(F.collect_list("target")), lambda t: F.concat(F.lit('<a href="'), t, F.lit('">x</a>'))), " "), F.lit("</body></html>"))
    pages = edges.groupBy("catalog_id", "i", "url").agg(page.alias("html")).withColumn("id", F.xxhash64("catalog_id", "i"))
    first = nodes.filter("i = 0").select("catalog_id", F.col("url").alias("path"))
    details = catalogs.catalog_details(_catalog(spark, d)).withColumns({"depth": F.lit(-1), "path_patterns": F.array().cast("array<string>"), "excluded_path_patterns": F.array().cast("array<string>")})
    return pages, first, details


def _graph_crawl(spark, d, **options):
    pages, first, details = _graph(spark, d)
    from orbweave.session import durable

    pages = durable(pages, "graph-pages")
    start = crawl.seeds(details, index.current_versions(_index(spark, d)), "crawl", first).join(first.select("catalog_id"), "catalog_id", "left_semi")
    return crawl.crawl(start, pages, details, **options)


_REACH_SQL = """WITH RECURSIVE n0 AS (SELECT catalog_id, url, row_number() OVER (PARTITION BY catalog_id ORDER BY url) - 1 AS i, count(*) OVER (PARTITION BY catalog_id) AS n
 FROM (SELECT min(catalog_id) AS catalog_id, url FROM crawler_resource WHERE url IS NOT NULL GROUP BY url)),
nodes AS (SELECT n0.*, starts_with(n0.url, c.url) AS ok FROM n0 JOIN crawler_catalog c ON c.id = n0.catalog_id),
edges AS (SELECT s.catalog_id, s.i, t.i AS j, t.ok FROM (SELECT catalog_id, i, n, unnest([(i * 7 + 1) % n, (i * 7 + 2) % n]) AS k FROM nodes) s JOIN nodes t ON t.catalog_id = s.catalog_id AND t.i = s.k),
reach AS (SELECT catalog_id, i FROM nodes WHERE i = 0 UNION SELECT e.catalog_id, e.j FROM reach r JOIN edges e ON e.catalog_id = r.catalog_id AND e.i = r.i WHERE e.ok)
"""


@query(_REACH_SQL + "SELECT r.catalog_id, n.url FROM reach r JOIN nodes n ON n.catalog_id = r.catalog_id AND n.i = r.i")
def x3_crawl(spark, d):
    """The crawl to its fixpoint over the derived sites: saved pages (X1 to X3, X6, X7)."""
    return _graph_crawl(spark, d).resources.select("catalog_id", "url")


@query(_REACH_SQL + """, m AS (SELECT catalog_id, count(*) AS saved FROM reach GROUP BY catalog_id),
f AS (SELECT e.catalog_id, count(*) FILTER (NOT e.ok) AS filtered, count(*) FILTER (e.ok) AS links FROM reach r JOIN edges e ON e.catalog_id = r.catalog_id AND e.i = r.i GROUP BY e.catalog_id)
SELECT m.catalog_id, 1 + f.links AS url_total_count, 0 AS invalid_url_count, 1 + f.links - m.saved AS existing_url_count, f.filtered AS filtered_url_count, m.saved AS saved_resource_count, m.saved AS indexed_resource_count
FROM m JOIN f ON f.catalog_id = m.catalog_id""")
def x3_crawl_counters(spark, d):
    """Counters of that crawl (A3, A4): every link is filtered or counted, every packet is existing or saved."""
    return _graph_crawl(spark, d).counters().drop("version")


@query(_REACH_SQL.replace("reach AS (SELECT", "reach0 AS (SELECT") + """, seen AS (SELECT n.catalog_id, n.i, n.url IN (SELECT path FROM indexed_resource WHERE path IS NOT NULL) AS old FROM nodes n),
went AS (SELECT catalog_id, i, 'update' AS action FROM nodes WHERE i = 0 UNION
 SELECT e.catalog_id, e.j, CASE WHEN s.old THEN w.action ELSE 'crawl' END FROM went w JOIN seen s ON s.catalog_id = w.catalog_id AND s.i = w.i
 JOIN edges e ON e.catalog_id = w.catalog_id AND e.i = w.i WHERE e.ok AND (NOT s.old OR w.action = 'update'))
SELECT DISTINCT w.catalog_id, n.url FROM went w JOIN seen s ON s.catalog_id = w.catalog_id AND s.i = w.i JOIN nodes n ON n.catalog_id = w.catalog_id AND n.i = w.i WHERE NOT s.old""")
def x4_update(spark, d):
    """An update over sites partly seen (the indexed pages): unseen pages are saved, seen ones only followed."""
    pages, first, details = _graph(spark, d)
    from orbweave.session import durable

    pages = durable(pages, "graph-pages")
    start = crawl.seeds(details, index.current_versions(_index(spark, d)), "update", first).join(first.select("catalog_id"), "catalog_id", "left_semi")
    versions = start.select("catalog_id", "refer", "version")
    indexed = _docs(spark, d).select(F.col("path").alias("url")).distinct()
    seen = pages.join(indexed, "url", "left_semi").select("catalog_id", F.col("url").alias("path")).join(versions, "catalog_id")
    return crawl.crawl(start, pages, details, visited=seen).resources.select("catalog_id", "url")


@query("SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 5000")
def x11_first_over_budget(spark, d):
    """The event that exceeds a budget of 5000."""
    return counters.first_over_budget(_events(spark, d), ["ts", "event_id"], 5000).select("event_id", "ts", "value")


@query("""SELECT c.id, CASE WHEN l.path IS NULL OR trim(l.path) = '' OR l.path = c.url OR l.path = c.url || '/' THEN 'crawl' ELSE 'update' END AS action FROM crawler_catalog c LEFT JOIN (
 SELECT catalog_id, url AS path FROM crawler_resource WHERE create_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY create_time DESC, id DESC) = 1) l ON l.catalog_id = c.id""")
def x16_crawl_or_update(spark, d):
    from orbweave.plans.jobs import decision

    latest = catalogs.latest_path(_resource(spark, d)).withColumnRenamed("catalog_id", "id")
    rows = _catalog(spark, d).select("id", "url").join(latest, "id", "left")
    return rows.select("id", decision(F.col("path"), F.col("url")).alias("action"))


@query("""SELECT r.catalog_id, r.version, count(*) AS stored, count(i.id) AS indexed, epoch_us(max(r.create_time)) // 1000 - epoch_us(min(r.create_time)) // 1000 AS elapsed_ms
FROM crawler_resource r LEFT JOIN indexed_resource i ON i.id = r.id GROUP BY r.catalog_id, r.version""")
def x23_run_summary(spark, d):
    """Stored and indexed pages and the time of every run."""
    docs = _docs(spark, d).select("id", F.lit(1).alias("in_index"))
    ms = index.epoch_ms(F.col("create_time"))
    return _resource(spark, d).join(docs, "id", "left").groupBy("catalog_id", "version").agg(
        F.count("*").alias("stored"), F.count("in_index").alias("indexed"), (F.max(ms) - F.min(ms)).alias("elapsed_ms"))


_START_SQL = "coalesce(nullif(trim(c.start_url), ''), c.url)"
_LATEST_SQL = "(SELECT catalog_id, url AS path FROM crawler_resource WHERE create_time IS NOT NULL QUALIFY row_number() OVER (PARTITION BY catalog_id ORDER BY create_time DESC, id DESC) = 1)"


@query(f"""SELECT c.id AS catalog_id, c.url AS refer, CASE WHEN {_START_SQL} = c.url || '/' THEN c.url ELSE {_START_SQL} END AS path, coalesce(i.version, 0) AS version
FROM crawler_catalog c LEFT JOIN {_CURRENT_SQL} i ON i.catalog_id = c.id""")
def x7_crawl_seeds(spark, d):
    """One packet per catalog at its start."""
    details = catalogs.catalog_details(_catalog(spark, d))
    return crawl.seeds(details, index.current_versions(_index(spark, d))).select("catalog_id", "refer", "path", "version")


@query(f"""SELECT c.id AS catalog_id, CASE WHEN coalesce(l.path, {_START_SQL}) = c.url || '/' THEN c.url ELSE coalesce(l.path, {_START_SQL}) END AS path, 'update' AS action
FROM crawler_catalog c LEFT JOIN {_LATEST_SQL} l ON l.catalog_id = c.id""")
def x8_update_seeds(spark, d):
    """One packet per catalog at its latest stored path."""
    details, latest = catalogs.catalog_details(_catalog(spark, d)), catalogs.latest_path(_resource(spark, d))
    return crawl.seeds(details, index.current_versions(_index(spark, d)), "update", latest).select("catalog_id", "path", "action")


@query("SELECT count(*) AS crawls, (SELECT count(*) FROM crawler_catalog) AS updates, CAST(0 AS BIGINT) AS others FROM crawler_catalog")
def x2_actions(spark, d):
    """Seed packets of crawls and updates, dispatched by action."""
    details, versions = catalogs.catalog_details(_catalog(spark, d)), index.current_versions(_index(spark, d))
    packets = crawl.seeds(details, versions).unionByName(crawl.seeds(details, versions, "update", catalogs.latest_path(_resource(spark, d))))
    parts = crawl.actions(packets)
    tagged = parts["crawl"].select(F.lit("c").alias("k")).union(parts["update"].select(F.lit("u"))).union(parts["index"].select(F.lit("i")))
    return tagged.agg(F.count_if(F.expr("k = 'c'")).alias("crawls"), F.count_if(F.expr("k = 'u'")).alias("updates"), F.count_if(F.expr("k = 'i'")).alias("others"))


@query("SELECT id, catalog_id, version, url FROM crawler_resource WHERE catalog_id = 1001 ORDER BY id LIMIT 100 OFFSET 100")
def t5_resource_page(spark, d):
    """Second page of a hundred of one catalog's resources, in a total order."""
    rows = _resource(spark, d).filter("catalog_id = 1001").select("id", "catalog_id", "version", "url").orderBy("id")
    return catalogs.page(rows, 2, 100)


@query("SELECT count(*) AS packets, CAST(0 AS BIGINT) AS split_paths FROM crawler_resource r JOIN crawler_catalog c ON c.id = r.catalog_id")
def x1_partitioning(spark, d):
    """Packets of one path lie in one partition."""
    placed = crawl.partitioned(_visited(spark, d), 8).withColumn("part", F.spark_partition_id())
    paths = placed.groupBy(*dedup.KEYS).agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts"))
    return paths.agg(F.sum("n").alias("packets"), F.count_if(F.col("parts") > 1).alias("split_paths"))


@query("SELECT CASE event_type WHEN 'view' THEN 'URL_TOTAL_COUNT' WHEN 'click' THEN 'SAVED_RESOURCE_COUNT' WHEN 'signup' THEN 'INDEXED_RESOURCE_COUNT' WHEN 'error' THEN 'INVALID_URL_COUNT' ELSE 'EXISTING_URL_COUNT' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def a4_counter_events(spark, d):
    """Events by the counter they raise."""
    return _tagged(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT c.id, c.name, i.version, row_number() OVER (ORDER BY c.last_modified DESC, i.last_modified DESC, c.id, i.version) AS position
FROM crawler_catalog c JOIN crawler_catalog_index i ON i.catalog_id = c.id""")
def t1_listing_order(spark, d):
    """The whole listing in its order (a short table, numbered in one task)."""
    rows = catalogs.listing(_catalog(spark, d), _index(spark, d))
    place = Window.orderBy(F.desc("last_modified"), F.desc("last_indexed"), "id", "version")
    return rows.withColumn("position", F.row_number().over(place).cast("bigint")).select("id", "name", "version", "position")


@query(f"""SELECT d.id, round(t.s + coalesce(c.s, 0), 6) AS score FROM indexed_resource d JOIN ({_bm25_sql('title', _T)}) t ON t.id = d.id LEFT JOIN ({_bm25_sql('content', _T)}) c ON c.id = d.id
WHERE d.version >= 0 AND d.cat = 'travel' ORDER BY t.s + coalesce(c.s, 0) DESC, d.id LIMIT 10""")
def f6_search_entry(spark, d):
    """First page of a search within a category."""
    return search.top(search.scored(_docs(spark, d), "harbour bridge", -1, "travel", _postings(spark, d)), 1, 10).select("id", F.round("score", 6).alias("score"))


@query(_CREATED_SQL.format(v="i.version") + " AND r.id = (SELECT max(id) FROM crawler_resource)")
def v1_index_one(spark, d):
    """One resource into the index."""
    one = _resource(spark, d).join(_resource(spark, d).agg(F.max("id").alias("id")), "id", "left_semi")
    return index.create_index(one, _catalog(spark, d), _index(spark, d))


@query("SELECT i.id, i.catalog_id, i.version FROM crawler_catalog_index i WHERE i.catalog_id <> 1001")
def v11_delete_index_row(spark, d):
    """The index table less one catalog's rows."""
    return catalogs.without_catalog(_index(spark, d), 1001).select("id", "catalog_id", "version")


# extensions: windows over the run log


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    """Extension: counts an hour."""
    return _events(spark, d).groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_stream_tumbling(spark, d):
    """Extension: the same as a stream in complete mode."""
    from orbweave.streaming import runs

    stream = runs.read_stream(spark, d, "events.parquet", _events(spark, d).schema)
    return _streamed(spark, runs.windowed(stream), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a3_stream_counters(spark, d):
    """Running counters as a stream."""
    from orbweave.streaming import runs

    stream = runs.read_stream(spark, d, "events.parquet", _events(spark, d).schema)
    return _streamed(spark, runs.counters(stream), "complete")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 hour THEN 1 ELSE 0 END AS g FROM events)) GROUP BY user_id, s""")
def ext_sessions(spark, d):
    """Extension: sessions with a gap of six hours."""
    return _events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT cat, version, count(*) AS n FROM crawler_resource GROUP BY ROLLUP (cat, version)")
def ext_rollup(spark, d):
    """Extension: pages by category and version with subtotals."""
    return _resource(spark, d).rollup("cat", "version").agg(F.count("*").alias("n"))
