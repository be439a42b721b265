"""Problems 2, 3 and 6: lines of html, repeated lines, main bodies, residue."""

import random

import numpy as np
import pytest

from orbweave.llm.blocks import CLASSED, Lines, page_units
from orbweave.llm.main_body import main_contents, main_lines, main_texts
from orbweave.llm.pagelines import visible_lines
from orbweave.llm.repeated_lines import boilerplate_blocks, components, repeated_blocks, repeated_lines, site_lines, without_repeated_lines
from orbweave.llm.residue import template_residue
from orbweave.llm.residue_text import marks_in, residue_kind

PAGES = "id bigint, title string, html string, url string, catalog_id bigint"


def test_visible_lines():
    html = '<html><head><title>no</title></head>\n<body>\r\n<script>\nvar t="</p>"; {{x}}\n</script><!-- a\nb --><p>A&amp;B \t c<b>d</b></p>\n<noscript>on</noscript>\n<a\n href="x">l</a>\n&nbsp;\n\n'
    assert visible_lines(html) == [(6, "A&B cd"), (7, "on"), (9, "l"), (10, "\xa0")]
    assert visible_lines(None) == visible_lines("") == [] and visible_lines("a < b\n<3") == [(1, "a < b"), (2, "<3")]
    assert visible_lines("<head><title>x</title>\n<body>y</body><header>z</header>") == [(2, "yz")]
    assert visible_lines("<script>never closed\nx") == []


def test_units_follow_the_visible_lines():
    html = "<body>\n<aside><h3>More</h3>\n<p><a href=1>x</a></p>\n</aside><div class=c><p>one\ntwo</p>\nplain\n<span class=m>by</span>\n</div><hr>\ntail</body>"
    page = page_units(html, Lines())
    assert list(zip(page.lines, page.strings)) == visible_lines(html)
    at = {text: i for i, text in enumerate(page.strings)}
    assert page.heads[at["x"]] == 0 and page.heads[at["one"]] == -1 and page.flags[at["by"]] & CLASSED
    assert page.items[at["one"]] == page.items[at["two"]] and page.owners[at["one"]] == page.owners[at["two"]]


def test_subtrees_do_not_depend_on_lines():
    html = "<body><nav><ul><li>Home</li><li>News</li></ul></nav><main><h1>Title</h1><p>One text.</p><table><tr><td>a</td><td>1</td></tr></table></main></body>"
    one, many = page_units(html, Lines()), page_units(html.replace("><", ">\n<"), Lines())
    assert one.items == many.items and one.trees == many.trees and one.paths == many.paths and one.strings == many.strings
    assert one.items[-1] == one.items[-2]  # a row is one subtree
    assert (one.starts[-1], one.stops[-1]) == (0, 1)  # the menu


def brute_repeated(rows, least=4, tenths=3):
    pages, support = {}, {}
    for r in rows:
        if None not in (r[0], r[2], r[3], r[4]):
            pages.setdefault(r[4], set()).add(r[3])
            for _, t in visible_lines(r[2]):
                support.setdefault((r[4], t), set()).add(r[3])
    return {
        (r[0], n) for r in rows if None not in (r[0], r[2], r[4]) for n, t in visible_lines(r[2])
        if len(support.get((r[4], t), ())) >= least and 10 * len(support[r[4], t]) >= tenths * len(pages[r[4]])
    }


@pytest.mark.parametrize("seed", range(3))
def test_repeated_lines_against_brute_force(spark, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(160):
        lines = [r.choice(words[: r.choice([4, 90])]) for _ in range(r.randint(0, 12))]
        html = r.choice(["\n", "\r\n"]).join(f"<p>{x}</p>" if r.random() < 0.8 else f"{x}&nbsp;" for x in lines)
        rows.append((i, "t", r.choice([html, html, html, None, ""]), r.choice([None, *(f"u{k}" for k in range(40))]), r.choice([1, 1, 2, None])))
    got = [tuple(x) for x in repeated_lines(spark.createDataFrame(rows, PAGES)).select("id", "line_no").collect()]
    assert set(got) == brute_repeated(rows) and len(got) == len(set(got))


def test_many_repeated_lines_of_one_site(spark):
    # more than one mask word of candidates
    html = "\n".join(f"<p>line {i}</p>" for i in range(200))
    rows = [(i, "t", html + f"\nown {i}", f"u{i}", 1) for i in range(6)]
    got = {tuple(x) for x in repeated_lines(spark.createDataFrame(rows, PAGES)).select("id", "line_no").collect()}
    assert got == {(i, n) for i in range(6) for n in range(1, 201)}


def test_blocks_are_components_of_consecutive_lines(spark):
    rows = [(i, "t", f"a\nb\nc{i}\nd\ne", f"u{i}", 1) for i in range(5)] + [(9, "t", "alone\nx9", "u9", 1)]
    lines = site_lines(spark.createDataFrame(rows, PAGES), "catalog_id", "id", "url", "html")
    (site,) = boilerplate_blocks(lines).collect()
    assert len(site["items"]) == 4 and len(set(site["blocks"])) == 2


def test_components():
    r = random.Random(2)
    for n in (1, 5, 60, 300):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(n // 2 + 1)]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        assert components(*(np.array(x) for x in zip(*edges)), n).tolist() == root
    chain = np.arange(999)
    assert components(chain, chain + 1, 1000).tolist() == [0] * 1000


def test_block_texts_and_weights(spark):
    rows = [(i, "t", f"<nav>\n<a>Home</a>\n<a>News</a>\n</nav>\n<p>own {i}</p>\n<p>Legal</p>", f"u{i}", c) for c in (1, 2) for i in range(10 * c, 10 * c + 6)]
    got = {(r.catalog_id, r.text): (r.nodes, r.support, r.edges, r.weight, r.occurrences) for r in repeated_blocks(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(c, t): x for c in (1, 2) for t, x in (("Home\nNews", (2, 6, 1, 6, 6)), ("Legal", (1, 6, 0, 0, 6)))}
    lines = repeated_lines(spark.createDataFrame(rows, PAGES)).collect()
    assert len({(r.id, r.line_no) for r in lines}) == 36 and len({r.block for r in lines}) == 2
    assert repeated_blocks(spark.createDataFrame([], PAGES)).count() == 0


def test_removal_keeps_the_rest(spark):
    rows = [(i, "t", f"menu\r\n<p>text {i}</p>\nfoot", f"u{i}", 1) for i in range(5)] + [(7, "t", None, "u7", 1), (8, "t", "", None, 1)]
    got = {r.id: (r.removed, r.html) for r in without_repeated_lines(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[0] == (2, "<p>text 0</p>") and got[8] == (0, "") and 7 not in got


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], PAGES)
    assert repeated_lines(empty).count() == 0 and main_lines(empty).count() == 0 and template_residue(empty).count() == 0
    assert main_texts(empty).count() == 0 and without_repeated_lines(empty).count() == 0
    rows = spark.createDataFrame([(i, "t", f"same\nown {i}", f"http://h.test/{i}", 1) for i in range(5)], PAGES)
    extra = rows.selectExpr("*", "1 as site", "2 as doc", "'p' as page", "3 as items", "4 as lines", "'h' as host", "5 as tpl")
    assert repeated_lines(extra).count() == 5 and main_lines(extra).count() == 5


ARTICLE = "The {0} council moved its {1} across the river before the winter came, and nobody in the town of {2} objected to it."


def article_site(n=12, host="http://www.news.test"):
    words = ["harbour", "kiln", "bridge", "museum", "garden", "quarry", "sawmill", "orchard", "library", "ferry", "tannery", "clinic"]
    rows = []
    for i in range(n):
        a, b = words[i % 12], words[(i * 5 + 1) % 12]
        html = f"""<html><head><title>{a} {b} {i}</title></head><body class="s{i % 3}">
<nav><ul><li>Home</li>
<li>Weather</li>
</ul></nav><div class="bc">Home &gt; part {i % 3}</div>
<aside><h3>Most read</h3>
<p><a href="/{i}">Teaser of {b} number {i}</a></p>
</aside><main><h1>{a} and {b} {i}</h1>
<p class="m">Written by Person {i}, {i}.1.2024</p>
<p>{ARTICLE.format(a, b, i)}
{ARTICLE.format(b, a, i + 100)}</p>
<p>Share this page</p>
</main><footer><small>All rights reserved.</small></footer></body></html>"""
        rows.append((i, f"{a} {b} {i}", html, f"{host}/{i}", 1))
    return rows


def test_main_body_of_a_site(spark):
    df = spark.createDataFrame(article_site(), PAGES)
    got = {}
    for r in main_lines(df).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    assert got == {i: {7, 9, 10} for i in range(12)}
    texts = {r.id: r.text for r in main_texts(df).collect()}
    assert texts[3].splitlines()[0] == "museum and garden 3" and "Home" not in texts[3] and texts[3].count("\n") == 2
    contents = {r.id: r.content for r in main_contents(df.select("id"), df).collect()}
    assert contents[3] == texts[3].replace("\n", " ")


def test_articles_of_a_site_that_mostly_serves_one_error_page(spark):
    """The error page makes the paths of headline and text template, but not what stands under them only once."""
    error = "<html><body>\n<h1>Oops</h1>\n<p>The page could not be found here.</p>\n<p>Try again later.</p>\n</body></html>"
    body = "<html><body>\n<h1>{0} and {1}</h1>\n<p class='m'>By the desk</p>\n<p>{2}</p>\n<h3>About the {1}</h3>\n<p>{3}</p>\n</body></html>"
    rows = [(i, "t", error, f"http://hot.test/{i}", 1) for i in range(200)]
    for i, (a, b) in enumerate([("kiln", "ferry"), ("quarry", "clinic"), ("garden", "library")]):
        rows.append((300 + i, "t", body.format(a, b, ARTICLE.format(a, b, i), ARTICLE.format(b, a, i + 50)), f"http://hot.test/a{i}", 1))
    got = {(r.id, r.line_no) for r in main_lines(spark.createDataFrame(rows, PAGES)).filter("id >= 300").collect()}
    assert got >= {(300 + i, n) for i in range(3) for n in (2, 4, 5, 6)}


def test_url_variants_are_one_page(spark):
    # the same article under three spellings of its url is no template
    rows = article_site()
    rows += [(100 + k, rows[0][1], rows[0][2], "http://www.news.test/0" + tail, 1) for k, tail in enumerate(["?ref=mail", "#top", "//"])]
    got = {r.id for r in main_lines(spark.createDataFrame(rows, PAGES)).filter("line_no = 9").collect()}
    assert got >= {0, 100, 101, 102}


def test_nulls_long_and_repeated_rows(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, None, None, None, None), (2, "", "", "u", 1), (None, "t", "<p>x</p>", "u", 1), (3, "t", long, "http://a.test/3", 1), (3, "t", long, "http://a.test/3", 1)]
    df = spark.createDataFrame(rows, PAGES)
    assert [r.line_no for r in main_lines(df).collect()] == [1, 1]
    assert template_residue(df).count() == 0
    assert {r.id for r in repeated_lines(df).collect()} == set()


def test_error_pages_have_no_main_body(spark):
    error = "<html><body>\n<h1>Oops</h1>\n<p>The page could not be found here.</p>\n</body></html>"
    rows = article_site() + [(500 + k, "Oops", error, f"http://e{k}.test/x", 10 + k) for k in range(4)]
    df = spark.createDataFrame(rows, PAGES)
    assert main_lines(df).filter("id >= 500").count() == 0
    assert {r.id for r in template_residue(df).filter("reason = 'replaced'").collect()} == {500, 501, 502, 503}


def classed(rows):
    return [(r[0], r[1], r[2].replace("<h1>", '<h1 class="text">').replace("<p>", '<p class="text">'), *r[3:]) for r in rows]


def test_articles_with_classes_stay(spark):
    rows = []
    for i in range(50):
        body = "\n".join(f"<p>Sentence {k} of page {i} tells of matter {i * 7 + k}.</p>" for k in range(4))
        rows.append((i, "t", f"<html><body><nav>\n<ul><li>Home</li></ul>\n</nav>\n<h1>Story {i}</h1>\n{body}\n</body></html>", f"http://c.test/{i}", 1))
    for pages in (rows, classed(rows)):
        assert main_lines(spark.createDataFrame(pages, PAGES)).count() == 250


def test_a_page_on_one_line_loses_its_menu(spark):
    rows = [(i, t, html.replace("\n", " "), url, c) for i, t, html, url, c in article_site(50)]
    texts = {r.id: r.text for r in main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(texts) == 50
    for text in texts.values():
        assert "council moved" in text and not any(x in text for x in ("Home", "Weather", "Most read", "Teaser", "All rights", "Share this", "Written by"))


def test_short_pages_and_long_error_pages(spark):
    """A short page with a headline stays; an error page is one however many lines it has."""
    note = "<html><body>\n<h1>Closed on Monday</h1>\n<p>We are away.</p>\n</body></html>"
    lines = "\n".join(f"<p>Step {k}: look at the address once more.</p>" for k in range(9))
    rows = [(i, t, html.replace("</p>\n<p>Share", f" {ARTICLE * 4}</p>\n<p>Share"), u, c) for i, t, html, u, c in article_site(30)]
    rows += [(300, "Closed on Monday", note, "http://short.test/1", 7)]
    rows += [(500 + k, "Gone", f"<html><body>\n<h1>Gone</h1>\n{lines}\n</body></html>", f"http://e{k}.test/x", 10 + k) for k in range(4)]
    df = spark.createDataFrame(rows, PAGES)
    got = {(r.id, r.line_no) for r in main_lines(df).filter("id >= 300").collect()}
    assert got == {(300, 2), (300, 3)}
    assert {r.id for r in template_residue(df).filter("reason = 'replaced'").collect()} == {500, 501, 502, 503}


def test_headlines_survive_links_to_them(spark):
    rows = article_site(12)
    links = "".join(f"<li><a href='/{i}'>{r[2].split('<h1>')[1].split('<')[0]}</a></li>\n" for i, r in enumerate(rows))
    rows = [(i, t, html.replace("</main>", f"<ul>{links}</ul></main>"), u, c) for i, t, html, u, c in rows]
    assert main_lines(spark.createDataFrame(rows, PAGES)).filter("line_no = 7").count() == 12


@pytest.mark.parametrize(
    "text", ["{{ name }}", "{{{page.title}}}", "${user}", "#{x}", "<%= post.date %>", "{% block a %}", "[[company]]", "@@author@@", "%%x%%", "__headline__", "{0}",
             "{name}", "[INSERT DATE]", "*|FNAME|*", "<<NAME>>", "%NAME%", "[First Name]", "{{" + "long_" * 40 + "name}}"]
)
def test_variables(text):
    for value, whole, edge in ((text, True, True), (f"{text} came today", False, True), (f"by {text} today", False, False)):
        (mark,) = marks_in(value)
        assert (mark.token, mark.whole, mark.edge) == (text, whole, edge)


@pytest.mark.parametrize("text", ["{}", "{ 1, 2 }", "100% sure, 50% off", "a__b__c", "$5 {", "f(x) = {x | x > 0", "@home", "if (a<b)", "Home | News | About |", "a * b * c"])
def test_no_variables(text):
    assert not marks_in(text)


def test_variables_in_texts_about_code_are_no_residue(spark):
    rows = article_site(12)
    sentences = ["Call __init__ to construct the object.", "GET /users/{id} returns a user.", "Here the set {a} is closed.", "Please use the ${HOME} directory."]
    for k, sentence in enumerate(sentences):
        for i in (2 * k, 2 * k + 1):  # each stands in two articles
            rows[i] = (rows[i][0], rows[i][1], rows[i][2].replace("<p>The", f"<p>{sentence} The"), *rows[i][3:])
    assert template_residue(spark.createDataFrame(rows, PAGES)).filter("reason = 'placeholder'").count() == 0


@pytest.mark.parametrize("token", ["*|FNAME|*", "&lt;&lt;NAME&gt;&gt;", "%NAME%", "[First Name]", "__author__", "${user}"])
def test_variables_left_in_slots_are_residue(spark, token):
    rows = article_site(12)
    for i in (1, 4, 6):
        rows[i] = (rows[i][0], rows[i][1], rows[i][2].replace(f"Written by Person {i}, {i}.1.2024", token), *rows[i][3:])
    got = template_residue(spark.createDataFrame(rows, PAGES)).filter("reason = 'placeholder'")
    assert {r.id for r in got.collect()} == {1, 4, 6}


@pytest.mark.parametrize("sentence", ["Здесь будет текст", "Sample text goes here", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris"])
def test_filler_is_known_by_its_recurrence(spark, sentence):
    rows = []
    for k in range(4):
        rows += [(100 * k + r[0], *r[1:3], r[3], k) for r in article_site(8, f"http://h{k}.test")]
        html = rows[-1][2]
        rows[-1] = (rows[-1][0], rows[-1][1], html[: html.index("<p>The")] + f"<p>{sentence}</p>\n<p>{sentence}</p>\n<p>Share" + html.split("<p>Share")[1], *rows[-1][3:])
    got = template_residue(spark.createDataFrame(rows, PAGES)).filter("reason = 'replaced'")
    assert {r.id for r in got.collect()} == {7, 107, 207, 307}


def test_residue_kinds():
    kind = lambda text: residue_kind(text, marks_in(text))
    assert kind("{{a}} - ${b}") == 1 and kind("Price: {{a}}") == 0
    trace = "\n".join(f"at f{k} (/srv/app/view.js:{k}:7)" for k in range(90))
    assert len(trace) > 2000 and residue_kind(trace) == 3
    assert residue_kind("The team met ValueError: bad input. " + "Then it went on to other things. " * 20) == 0
    assert residue_kind("Lorem ipsum dolor sit amet consectetur adipiscing") == 2 and residue_kind("El dolor de la mano") == 0
    assert residue_kind("  at render (/srv/app/view.js:854:7)") == 3 and residue_kind("ValueError: bad") == 3
    assert residue_kind('The log said “Fatal error: no database” and stopped.') == 0


def test_residue_reasons(spark):
    rows = article_site(8)

    def change(i, title=None, old="", new=""):
        r = rows[i]
        rows[i] = (r[0], title if title is not None else r[1], r[2].replace(old, new) if old else r[2], r[3], r[4])

    change(0, old="<h1>", new="<h1>{{ headline }} ")
    change(1, title="Untitled")
    change(2, title="null - The News")
    change(3, title=" ")
    change(6, title="-")
    change(4, old="<p class", new="<p><code>{{ x }}</code></p>\n<p class")
    change(5, old="<head>", new="<head><script>var a = '{{ x }}';</script>")
    rows.append((50, "t", None, "http://www.news.test/50", 1))
    for k in range(3):  # defaults recur on other sites
        rows += [(100 + 10 * k + i, f"{r[1]} of {k}", *r[2:4], 2 + k) for i, r in enumerate(article_site(3, f"http://h{k}.test"))]
        rows[-1] = (rows[-1][0], "Untitled", *rows[-1][2:])
        rows[-2] = (rows[-2][0], "null", *rows[-2][2:])
    got = {(r.id, r.reason) for r in template_residue(spark.createDataFrame(rows, PAGES)).filter("id < 100").collect()}
    assert got == {(0, "placeholder"), (1, "title"), (2, "title")}
