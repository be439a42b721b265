import pytest
from pyspark.sql import functions as F

from orbweave.functions import html, robots, urls
from orbweave.functions.antpath import ant_to_regex, matches, regex_of
from orbweave.operators.accept import link_depth, path_accepted, within_depth
from orbweave.operators.catalogs import csv_list
from orbweave.operators.counters import elapsed_ms, elapsed_text
from orbweave.operators.search import fragments, query_terms

PATHS = [
    ("https://**.wayfarer.**/**", "https://one.wayfarer.com/a/b", True),
    ("https://**.wayfarer.**/**", "https://a.wayfarer.com", True),
    ("https://**.wayfarer.**/**", "https://wayfarer.com/x", False),
    ("/a/**/b", "/a/b", True),
    ("/a/**/b", "/a/x/y/b", True),
    ("/a/*", "/a/x/y", False),
    ("**/b", "b", True),
    ("**/b", "x/y/b", True),
    ("/a/**", "/a", True),
    ("/a/?", "/a/xy", False),
    ("/a/{id:\\d+}", "/a/12", True),
    ("/a/{id:\\d+}", "/a/x", False),
    ("/a/{name}", "/a/any", True),
    ("a/**/**/c", "a/c", True),
    ("/a/", "/a", False),
    ("a", "A", False),
    ("http://h.example/login/**", "http://h.example/login/x", True),
    ("http://h.example/a.b", "http://h.example/aXb", False),
]


@pytest.mark.parametrize(("pattern", "path", "want"), PATHS)
def test_ant_patterns(pattern, path, want):
    assert matches(path, pattern) is want


def test_ant_patterns_as_columns(spark):
    cases = [c for c in PATHS if "{" not in c[0]]
    df = spark.createDataFrame(cases, "pattern string, path string, want boolean")
    wrong = df.filter(F.rlike("path", regex_of(F.col("pattern"))) != F.col("want")).collect()
    assert not [r for r in wrong if not r.pattern.endswith("/")], wrong
    assert ant_to_regex("") == "^$"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("href", "want"),
    [
        ("http://x.test/a", "http://x.test/a"),
        ("//y.test/b", "https://y.test/b"),
        ("/c?d=1", "https://h.example/c?d=1"),
        ("#top", "https://h.example/p/q?r=1#top"),
        ("?s=2", "https://h.example/p/q?s=2"),
        ("e.html", "https://h.example/p/e.html"),
        ("../f", "https://h.example/f"),
        ("./g/./h", "https://h.example/p/g/h"),
        ("../../../z", "https://h.example/z"),
        ("", None),
    ],
)
def test_resolved_links(spark, href, want):
    assert one(spark, urls.resolved(F.col("h"), F.col("b")), h=href, b="https://h.example/p/q?r=1#old") == want


def test_url_parts(spark):
    u = F.col("u")
    assert one(spark, urls.host(u), u="http://me@a.b.co.uk:80/x") == "a.b.co.uk"
    assert one(spark, urls.default_path_pattern(u), u="https://www.site.example/x") == "https://**.site.**/**"
    assert one(spark, urls.without_closing_slash(u, F.lit("https://a.com")), u="https://a.com/") == "https://a.com"
    assert one(spark, urls.without_closing_slash(u, F.lit("https://a.com")), u="https://a.com/x/") == "https://a.com/x/"
    assert one(spark, urls.host(u), u="no url") is None


@pytest.mark.parametrize(
    ("url", "depth", "ok", "count"),
    [("https://a.com/x/y", 1, True, 1), ("https://a.com/x/y", 0, False, 1), ("https://b.com/x", 9, True, 3), ("https://a.com", 0, True, 0), ("https://a.com/a/b/c", -1, True, 2)],
)
def test_depth(spark, url, depth, ok, count):
    assert one(spark, link_depth(F.col("u"), F.lit("https://a.com")), u=url) == count
    assert one(spark, within_depth(F.col("u"), F.lit("https://a.com"), F.lit(depth)), u=url) is ok


def test_path_acceptance(spark):
    def accepted(url, included, excluded):
        arrays = [F.array(*map(F.lit, x)).cast("array<string>") for x in (included, excluded)]
        return one(spark, path_accepted(F.col("u"), F.lit("http://a.com"), *arrays), u=url)

    assert accepted("http://a.com/x", ["http://a.com/**"], []) is True
    assert accepted("http://a.com/x", ["http://a.com/**"], ["http://a.com/x"]) is False
    assert accepted("http://a.com/x", [], []) is True
    assert accepted("http://b.com/x", [], []) is False
    assert accepted("http://b.com/x", ["http://a.com/**"], []) is False


def test_robots():
    rules = robots.parse("User-agent: *\nDisallow: /a\nAllow: /a/b$\n\nUser-agent: ourbot\nDisallow:\n")
    assert [(a, n) for _, a, n in rules] == [(False, 2), (True, 5)]
    assert robots.parse("User-agent: *\nDisallow: /\nUser-agent: ourbot\nAllow: /", "OurBot/1.0") == [("^/", True, 1)]
    assert robots.parse(None) == []


def test_robots_longest_match(spark):
    files = spark.createDataFrame([("h.test", "User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /*.pdf$\nAllow: /t\nDisallow: /t"), ("x.test", None)], "host string, content string")
    pages = ["/a", "/a/b/c", "/d.pdf", "/d.pdf?x", "/t", ""]
    df = spark.createDataFrame([("h.test", "http://h.test" + p) for p in pages] + [("x.test", "http://x.test/a"), (None, None)], "host string, url string")
    got = {r.url: r.allowed for r in robots.allowed(df, robots.rules(files)).collect()}
    want = [False, True, False, True, True, True]
    assert [got["http://h.test" + p] for p in pages] == want
    assert got["http://x.test/a"] is True and got[None] is True


def test_html_tiers(spark):
    page = '<html><head><title> A\n&amp; B </title><style>x{}</style></head><body>\n<!-- c --><script>var t="</p>";</script><p>one&nbsp;two <b>th</b>ree</p><a href="/l">x</a><a name=y></a></body></html>'
    df = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    first = df.select(html.title(F.col("html")).alias("t"), html.body_text(F.col("html")).alias("b"), html.links(F.col("html")).alias("l"), html.anchor_count(F.col("html")).alias("n")).collect()
    assert first[0].t == "A &amp; B" and first[0].l == ["/l"] and first[0].n == 2
    assert "var t" not in first[0].b and first[0].b.startswith("one&nbsp;two")
    exact = df.select(html.parsed("html").alias("p")).select("p.*").collect()
    assert exact[0].title == "A & B" and exact[0].content == "one two three x" and exact[0].links == ["/l"]
    assert exact[1].content == "" and exact[2].links == []


def test_small_columns(spark):
    assert one(spark, csv_list(F.col("x")), x="a, b,,c,,") == ["a", " b", "", "c"]
    assert one(spark, csv_list(F.col("x")), x=" ") == []
    assert one(spark, elapsed_text(F.col("x")), x=3_723_999) == "1H 2m 3s"
    args = F.lit(0).cast("bigint"), F.lit(9), F.lit(5), F.lit(True)
    assert one(spark, elapsed_ms(*args), x=1) == 0


def test_highlights():
    text = "alpha " * 30 + "Bridge over water " + "beta " * 40
    out = fragments(text, query_terms("bridge"))
    assert "<font color='red' class='searchKeyword'>Bridge</font>" in out and len(out) < 260
    assert fragments("bridges only", ["bridge"]) == "bridges only"
    assert fragments(None, ["a"]) is None and fragments("", ["a"]) == ""
