import pytest
from pyspark.sql import functions as F

from orbweave.engine import Engine
from orbweave.operators import search as srch
from orbweave.operators.accept import ACCEPTORS, acceptor
from orbweave.operators import dedup
from orbweave.plans.crawl import Budget, crawl, seeds
from orbweave.plans.jobs import JobQueue, RunGuard, RunningError, decide
from orbweave.sources.fetchers import FetchError, Paced, Retrying, charset_of, decode, decoded_pages, encoded_pages, factory_of, register
from orbweave.sources.store import Store
from orbweave.streaming import runs

ROOT = "http://s.test"


def site(spark, links, text="words"):
    rows = [(i, u, None if ls is None else f"<html><head><title>t</title></head><body>{text} {u} " + " ".join(f'<a href="{x}">l</a>' for x in ls) + "</body></html>") for i, (u, ls) in enumerate(links.items())]
    return spark.createDataFrame(rows, "id bigint, url string, html string")


def details(spark, depth=-1, included=(), excluded=()):
    return spark.range(1).select(
        F.lit(1).cast("bigint").alias("id"), F.lit(ROOT).alias("url"), F.lit(ROOT).alias("start_url"), F.lit("c").alias("cat"), F.lit(depth).alias("depth"),
        F.array(*map(F.lit, included)).cast("array<string>").alias("path_patterns"), F.array(*map(F.lit, excluded)).cast("array<string>").alias("excluded_path_patterns"),
    )


def start(spark, d, action="crawl"):
    return seeds(d, spark.createDataFrame([(1, 3)], "catalog_id bigint, version int"), action)


LINKS = {ROOT: ["/a", "/b", "/a", "http://other.test/"], f"{ROOT}/a": ["/b", ROOT + "/"], f"{ROOT}/b": ["/a", "/missing", "/blank"], f"{ROOT}/blank": [], f"{ROOT}/far": []}


def counts(result):
    return {k: v for k, v in result.counters().first().asDict().items() if k.endswith("count")}


def test_crawl_reaches_its_fixpoint(spark):
    pages = site(spark, LINKS).union(spark.createDataFrame([(9, f"{ROOT}/blank", "<html><body> <script>x</script></body></html>")], "id bigint, url string, html string"))
    d = details(spark)
    result = crawl(start(spark, d), pages, d)
    assert {r.url for r in result.resources.collect()} == {ROOT, f"{ROOT}/a", f"{ROOT}/b"}
    # total: seed + a b a + b root + a missing blank; a fourth link leaves the site
    assert counts(result) == {"url_total_count": 9, "invalid_url_count": 1, "existing_url_count": 4, "filtered_url_count": 1, "saved_resource_count": 3, "indexed_resource_count": 3}
    assert result.resources.first()["version"] == 3


def test_crawl_does_not_depend_on_order_or_partitions(spark):
    d, pages = details(spark), site(spark, LINKS)
    a = crawl(start(spark, d), pages.repartition(7), d)
    b = crawl(start(spark, d), pages.orderBy(F.desc("id")).coalesce(1), d)
    assert sorted(r.url for r in a.resources.collect()) == sorted(r.url for r in b.resources.collect())
    assert counts(a) == counts(b)


def test_relative_links_stay_unresolved_on_request(spark):
    d = details(spark)
    result = crawl(start(spark, d), site(spark, LINKS), d, resolve_links=False)
    assert [r.url for r in result.resources.collect()] == [ROOT] and counts(result)["filtered_url_count"] == 4


def test_policy(spark):
    d = details(spark, depth=0, excluded=[f"{ROOT}/b"])
    result = crawl(start(spark, d), site(spark, LINKS), d)
    assert {r.url for r in result.resources.collect()} == {ROOT, f"{ROOT}/a"}


def test_budget_is_exact(spark):
    d = details(spark)
    chain = {ROOT: ["/1", "/2", "/3"], f"{ROOT}/1": ["/4"], f"{ROOT}/2": ["/5"], f"{ROOT}/3": [], f"{ROOT}/4": [], f"{ROOT}/5": []}
    result = crawl(start(spark, d), site(spark, chain), d, budget=Budget("URL_TOTAL_COUNT", 2))
    assert counts(result)["url_total_count"] == 3 and {r.url for r in result.resources.collect()} == {ROOT, f"{ROOT}/1", f"{ROOT}/2"}
    stopped = crawl(start(spark, d), site(spark, chain), d, budget=Budget(interrupted=lambda: True))
    assert stopped.stopped == "interrupted" and stopped.resources.count() == 0


@pytest.mark.parametrize(
    ("counter", "most", "want", "urls"),
    [
        ("SAVED_RESOURCE_COUNT", 1, 2, {ROOT, f"{ROOT}/1"}),
        ("INDEXED_RESOURCE_COUNT", 2, 3, {ROOT, f"{ROOT}/1", f"{ROOT}/2"}),
        ("INVALID_URL_COUNT", 0, 1, {ROOT, f"{ROOT}/1"}),
        ("FILTERED_URL_COUNT", 0, 1, {ROOT, f"{ROOT}/1", f"{ROOT}/2"}),
        ("EXISTING_URL_COUNT", 0, 1, {ROOT, f"{ROOT}/1", f"{ROOT}/2", f"{ROOT}/3"}),
    ],
)
def test_budgets_of_every_counter_are_exact(spark, counter, most, want, urls):
    """Packets of a level count in the order of their paths, and the one that exceeds the budget is the last."""
    d = details(spark)
    links = {ROOT: ["/1", "/2", "/3"], f"{ROOT}/1": ["/0gone"], f"{ROOT}/2": ["http://other.test/"], f"{ROOT}/3": ["/1"]}
    if counter == "INVALID_URL_COUNT":
        links = {ROOT: ["/1", "/2", "/3"], f"{ROOT}/1": [], f"{ROOT}/3": []}
    result = crawl(start(spark, d), site(spark, links), d, budget=Budget(counter, most))
    assert counts(result)[counter.lower()] == want and result.stopped == "size"
    got = {r.url for r in result.resources.collect()}
    assert got == urls if counter not in ("FILTERED_URL_COUNT", "EXISTING_URL_COUNT") else got <= urls | {f"{ROOT}/3"} and got >= urls


def test_html_is_read_once_and_joined_once(spark):
    """The plan of a level holds no html: only the scan before the first level and the join after the last do."""
    d = details(spark)
    asked = []

    def fetch(walk, pages):
        asked.append(walk.columns)
        return walk.join(pages.select(F.col("url").alias("path"), "html"), "path", "left")

    a = crawl(start(spark, d), site(spark, LINKS), d, fetch=fetch)
    b = crawl(start(spark, d), site(spark, LINKS), d)
    assert sorted((r.url, r.html) for r in a.resources.collect()) == sorted((r.url, r.html) for r in b.resources.collect())
    assert counts(a) == counts(b) and all("html" not in c for c in asked)


def test_links_in_any_quoting_and_with_a_base(spark):
    d = details(spark)
    page = "<html><head><base href='/deep/er/'></head><body>text <a class=x href='one'>a</a><a href=two>b</a><a data-href=\"no\" href=\"../t?a=1&amp;b=2\">c</a><A HREF = \"/x\">d</A></body></html>"
    pages = spark.createDataFrame([(1, ROOT, page)], "id bigint, url string, html string")
    log = crawl(start(spark, d), pages, d).log.filter("level = 1 and outcome = 'URL_TOTAL_COUNT'")
    assert {r.path for r in log.collect()} == {f"{ROOT}/deep/er/one", f"{ROOT}/deep/er/two", f"{ROOT}/deep/t?a=1&b=2", f"{ROOT}/x"}


def test_bloom_mode_loses_few_and_keeps_no_old_path(spark):
    d = details(spark)
    many = {ROOT: [f"/p{i}" for i in range(300)], **{f"{ROOT}/p{i}": [] for i in range(300)}}
    exact = crawl(start(spark, d), site(spark, many), d).resources.count()
    bloom = crawl(start(spark, d), site(spark, many), d, mode=dedup.DedupMode.BLOOM)
    got = [r.url for r in bloom.resources.collect()]
    assert exact == 301 and len(got) == len(set(got)) and 0.9 * 301 <= len(got) <= 301


def test_update_follows_seen_pages_once(spark):
    d = details(spark)
    loop = {ROOT: ["/a"], f"{ROOT}/a": [ROOT, "/new"], f"{ROOT}/new": ["/a", "/newer"], f"{ROOT}/newer": []}
    seen = spark.createDataFrame([(1, ROOT, ROOT, 3), (1, ROOT, f"{ROOT}/a", 3)], "catalog_id bigint, refer string, path string, version int")
    result = crawl(start(spark, d, "update"), site(spark, loop), d, visited=seen)
    assert {r.url for r in result.resources.collect()} == {f"{ROOT}/new", f"{ROOT}/newer"}
    again = crawl(start(spark, d), site(spark, loop), d, visited=result.visited)
    assert again.resources.count() == 0 and counts(again)["existing_url_count"] == 1


def test_unique_key(spark):
    rows = spark.createDataFrame([(1, 1, "c", 0, "t", "u"), (2, 1, "c", 0, "t", "u"), (3, 1, "c", 0, None, "u"), (4, 1, "c", 0, None, "u")], "id bigint, catalog_id bigint, cat string, version int, title string, url string")
    assert {r.id: r.is_saved for r in dedup.first_of_key(rows).collect()} == {1: True, 2: False, 3: True, 4: False}


def test_bloom_never_keeps_an_old_key(spark):
    seen = spark.range(2000).selectExpr("id catalog_id", "'r' refer", "cast(id as string) path", "0 version")
    new = spark.range(1000, 4000).selectExpr("id catalog_id", "'r' refer", "cast(id as string) path", "0 version")
    got = {r.catalog_id for r in dedup.bloom_unseen(new, seen).collect()}
    assert got <= set(range(2000, 4000)) and len(got) > 1800
    assert dedup.bloom_parameters(100_000_000, 0.03)[1] == 5
    assert dedup.DedupMode.by_name("rocksdb") is dedup.DedupMode.STREAM
    with pytest.raises(ValueError):
        dedup.DedupMode.by_name("other")


def test_jobs():
    q = JobQueue()
    q.put(1, "crawl"), q.put(2, "rebuild")
    assert q.take() == (1, "crawl") and q.take() == (2, "rebuild") and q.take() is None
    assert [decide(p, "u") for p in (None, " ", "u", "u/", "x")] == ["crawl", "crawl", "crawl", "crawl", "update"]
    assert decide("x", "u", True) == "enqueue"
    guard, done = RunGuard(), []
    guard.on_completion.append(done.append)
    with guard.run(5):
        with pytest.raises(RunningError):
            guard.check(5)
        guard.check(6)
        with pytest.raises(RunningError), guard.run(6, 0.01):
            pass
    assert done == [5]


def test_events_of_a_run():
    guard, told = RunGuard(), []
    guard.on_interruption.append(lambda c: told.append(("stop", c)))
    guard.on_completion.append(lambda c: told.append(("done", c)))
    with guard.run(3) as run:
        guard.interrupt()
        assert run.interrupted()
    assert told == [("stop", 3), ("done", 3)]


def test_pauses_and_charsets():
    waits = []
    fetch = Paced(lambda url, charset: url, 500, sleep=waits.append)
    assert fetch("u", "x") == "u" and waits == [0.5]
    spread = Paced(lambda url, charset: url, 500, least_ms=100, sleep=waits.append)
    for _ in range(50):
        spread("u", "x")
    assert all(0.1 <= w <= 0.5 for w in waits) and len(set(waits)) > 10
    assert [charset_of(n) for n in (None, " ", " utf8", "Windows-1251", "GB18030", "no-such")] == ["utf-8", "utf-8", "utf-8", "cp1251", "gb18030", "utf-8"]
    assert decode("река".encode("cp1251"), "windows-1251") == "река" and decode("图书馆".encode("gb18030"), " GB18030 ") == "图书馆"
    assert decode("été".encode(), "no-such") == "été" and decode(b"\xff", "utf-8") == "\ufffd"


def test_pages_in_the_charset_of_their_catalog(spark):
    rows = [(1, "windows-1251", "река 图"), (2, "gb18030", "图书馆"), (3, "nonsense", "été"), (4, None, "é"), (5, "latin1", None), (6, "", "x" * 100_000)]
    pages = spark.createDataFrame(rows, "id bigint, page_encoding string, html string")
    got = {r.id: r.html for r in decoded_pages(encoded_pages(pages).drop("html")).collect()}
    assert got == {1: "река &#22270;", 2: "图书馆", 3: "été", 4: "é", 5: None, 6: "x" * 100_000}


def test_fetchers():
    tries = []

    def bad(url, charset):
        tries.append(url)
        raise OSError

    with pytest.raises(FetchError):
        Retrying(bad, 3, 0)("u", "utf-8")
    assert len(tries) == 3
    with pytest.raises(ValueError):
        factory_of("nothing")


def test_store_keeps_the_old_table_while_it_is_rewritten(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("catalog").count() == 0 and not store.exists("catalog")
    store.write("t", spark.range(3))
    store.write("t", store.read("t").union(spark.range(3, 5).toDF("id")))
    assert store.read("t").count() == 5
    store.drop("t")
    assert not store.exists("t")


def test_engine_from_catalog_to_search(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), site(spark, LINKS, "harbour bridge"))
    key = engine.save_catalog(name="S", url=ROOT, cat="c", path_pattern=f"{ROOT},{ROOT}/**", max_fetch_size=100)
    assert key == 1 and engine.list_catalogs(name="S").count() == 1
    assert engine.crawl(key) == "crawl"
    assert engine.store.read("resource").count() == 4 and engine.index_size() == 4
    summary = engine.summary(key).first()
    assert summary["saved_resource_count"] == 4 and summary["elapsed"].endswith("s")
    assert engine.search("t").count() == 4 and engine.search("harbour").count() == 0  # the title has to match
    assert engine.search("t", v=0).count() == 4 and engine.search("t", v=7).count() == 0
    engine.upgrade_index(key, overwrite=True)
    assert engine.store.read("catalog_index").first()["version"] == 1 and engine.search("t", v=1).count() == 4
    assert engine.crawl(key) in ("update", "crawl")
    assert engine.rebuild(key) == "rebuild" and engine.store.read("catalog_index").first()["version"] == 2
    engine.save_catalog(id=key, cat="d")
    assert engine.catalog(key).first()["cat"] == "d" and engine.catalog(key).first()["name"] == "S"
    assert [r.cat for r in engine.categories().collect()] == ["d"]
    engine.delete_catalog(key)
    assert engine.store.read("resource").count() == 0 and engine.index_size() == 0 and engine.catalog(key).isEmpty()


def test_policy_fields_reach_the_crawl(spark, tmp_path):
    """Robots, user acceptors, filter and stop reason of a catalog, over stored pages."""

    @acceptor("no-a")
    def _no_a(url, refer, policy):
        return ~url.endswith("/a")

    try:
        pages = site(spark, {ROOT: ["/a", "/b", "/c"], f"{ROOT}/a": [], f"{ROOT}/b": [], f"{ROOT}/c": []})
        pages = pages.unionByName(spark.createDataFrame([(50, f"{ROOT}/robots.txt", "User-agent: *\nDisallow: /b")], "id bigint, url string, html string"))
        engine = Engine(spark, str(tmp_path / "x"), pages)
        key = engine.save_catalog(name="S", url=ROOT, cat="c", path_pattern=f"{ROOT},{ROOT}/**", url_path_acceptor="no-a,unknown", url_path_filter="redis", max_fetch_size=100)
        engine.crawl(key)
        assert {r.url for r in engine.store.read("resource").collect()} == {ROOT, f"{ROOT}/c"}
        (run,) = engine.runs(key).collect()
        assert run.stopped == "" and run.action == "crawl" and run.levels == 2
        free = Engine(spark, str(tmp_path / "y"), pages, obey_robots=False)
        other = free.save_catalog(name="S", url=ROOT, cat="c", path_pattern=f"{ROOT},{ROOT}/**", url_path_filter="rocksdb", max_fetch_size=2)
        free.crawl(other)
        assert free.runs(other).first().stopped == "size" and free.store.read("resource").count() == 3
        free.save_catalog(id=other, url_path_filter="odd")
        with pytest.raises(ValueError):
            free.rebuild(other)
    finally:
        ACCEPTORS.pop("no-a")


def test_extractor_retries_and_charset_reach_the_fetcher(spark, tmp_path):
    """Without stored pages the catalog's extractor is called, as often as it may be, in the catalog's charset."""

    def factory():
        tries = {}

        def fetch(url, charset):
            tries[url] = tries.get(url, 0) + 1
            if tries[url] < 2:
                raise OSError("not yet")
            links = '<a href="/two">x</a>' if url == ROOT else ""
            return f"<html><head><title>{url}</title></head><body>{charset} {links}</body></html>"

        return fetch

    register("made-up", factory)
    engine = Engine(spark, str(tmp_path))
    key = engine.save_catalog(name="S", url=ROOT, cat="c", path_pattern=f"{ROOT},{ROOT}/**", extractor="Made-Up", max_retry_count=2, interval_ms=1, page_encoding="koi8-r", url_path_filter="redis")
    engine.crawl(key)
    got = {r.url: r.html for r in engine.store.read("resource").collect()}
    assert set(got) == {ROOT, f"{ROOT}/two"} and all("koi8-r" in h for h in got.values())
    engine.save_catalog(id=key, extractor="nothing")
    with pytest.raises(ValueError):
        engine.rebuild(key)


def test_search_by_postings_is_search_by_texts(spark):
    rows = [(i, f"harbour {'bridge ' * (i % 3)}w{i}", " ".join(["harbour"] * (i % 4) + ["x"] * i), "u", "p", "c", "n", i % 2, 0) for i in range(40)] + [(99, None, "harbour", "u", "p", "c", "n", 1, 0)]
    docs = spark.createDataFrame(rows, "id bigint, title string, content string, url string, path string, cat string, catalog string, version int, create_time bigint")
    plain = {r.id: round(r.score, 9) for r in srch.scored(docs, "harbour bridge").collect()}
    by = {r.id: round(r.score, 9) for r in srch.scored(docs, "harbour bridge", postings=srch.inverted(docs)).collect()}
    assert by == plain and len(by) == 40
    # postings added later count as if made at once
    both = srch.inverted(docs.filter("id < 20")).unionByName(srch.inverted(docs.filter("id >= 20")))
    assert {r.id: round(r.score, 9) for r in srch.scored(docs, "harbour bridge", postings=both).collect()} == plain
    assert srch.scored(docs, "nowhere", postings=both).count() == 0


def test_stream_into_a_stored_table(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.write("t", spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "id bigint, name string, at int"))
    folder = str(tmp_path / "in")
    for k, rows in enumerate([[(3, "a", 5), (3, "b", 7)], [(1, "new", 1)]]):
        spark.createDataFrame(rows, "id bigint, name string, at int").coalesce(1).write.mode("append").parquet(folder)
    stream = runs.read_stream(spark, folder, "*.parquet", store.read("t").schema)
    runs.upsert_sink(stream, store, "t", "id", str(tmp_path / "c"), "at").awaitTermination()
    assert {tuple(r) for r in store.read("t").collect()} == {(1, "new", 1), (2, "old", 0), (3, "b", 7)}


def test_results_of_streams_come_from_files(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(100).selectExpr("id % 7 as event_type").write.parquet(folder)
    stream = runs.read_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema)
    got = runs.run_to_end(runs.counters(stream), str(tmp_path / "c1"), str(tmp_path / "r1"))
    assert sum(r.n for r in got.collect()) == 100 and got.count() == 7
    first = runs.run_to_end(runs.unseen(stream, ["event_type"]), str(tmp_path / "c2"), str(tmp_path / "r2"), "append")
    assert sorted(r.event_type for r in first.collect()) == list(range(7))


def test_dot_segments_however_many(spark):
    from orbweave.functions.urls import without_dots

    cases = {"/a/b/c/./../../g": "/a/g", "/a" * 20 + "/.." * 19 + "/g": "/a/g", "/../../g": "/g", "/a/..": "/", "/a/b/.": "/a/b/", "/": "/", "/a//b/../c": "/a//c", "/.hidden/..x": "/.hidden/..x", "/a/b/": "/a/b/"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", without_dots(F.col("p")).alias("q"))
    assert {r.p: r.q for r in df.collect()} == cases


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    from types import SimpleNamespace

    from orbweave.session import shared_folder

    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        shared_folder(fake)


def test_tables_of_a_block_go_with_it(spark):
    import os

    from orbweave.session import durable, shared_folder, written_tables

    before = set(os.listdir(shared_folder(spark)))
    with written_tables(spark):
        assert durable(spark.range(3), "gone").count() == 3
        assert set(os.listdir(shared_folder(spark))) > before
    assert set(os.listdir(shared_folder(spark))) == before


def test_batches_are_bounded(spark):
    from orbweave.session import BATCH_BYTES, BATCH_ROWS, bounded_batches

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows), spark.conf.get(size)
    for given, want in ((("0", "1g"), (str(BATCH_ROWS), str(BATCH_BYTES))), (("50", "4m"), ("50", "4m"))):
        spark.conf.set(rows, given[0]), spark.conf.set(size, given[1])
        bounded_batches(spark)
        assert (spark.conf.get(rows), spark.conf.get(size)) == want
    spark.conf.set(rows, before[0]), spark.conf.set(size, before[1])
