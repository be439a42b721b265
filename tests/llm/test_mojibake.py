"""Problem 4: garbled text."""

import random

import numpy as np
import pytest

from orbweave.llm import mojibake as M

SCHEMA = "id bigint, title string, html string"
WORDS = {
    "fr": "été déjà château forêt bibliothèque élève garçon français où très près après même être règle".split(),
    "de": "für schön größer Straße Mühle Bücherei täglich plötzlich Käfer Gärtner öffnet über Gemälde".split(),
    "ru": "река город мельница архив театр дорога пекарня библиотека осторожно заметно гавань рынок".split(),
}


def corpus(n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = WORDS[r.choice(list(WORDS))]
        text = " ".join(r.choice([*words, "plain", "words"]) for _ in range(30))
        rows.append((i, " ".join(r.sample(words, 3)), f"<html><body><p>{text}</p></body></html>"))
    return rows


GARBLES = [("utf-8", "cp1252", "fr"), ("utf-8", "latin-1", "de"), ("cp1252", "cp850", "de"), ("utf-8", "mac_roman", "fr"), ("cp1251", "latin-1", "ru"), ("koi8_r", "cp1251", "ru"), ("utf-8", "cp1251", "ru")]


@pytest.fixture(scope="module")
def clean():
    return corpus()


@pytest.mark.parametrize(("written", "read", "lang"), GARBLES)
def test_garbled_titles_are_found_and_restored(spark, clean, written, read, lang):
    original = " ".join(w for w in WORDS[lang] if not any("\x80" <= c <= "\x9f" for c in w.encode(written).decode(read, "replace")) and "�" not in w.encode(written).decode(read, "replace"))
    bad = original.encode(written).decode(read)
    rows = [*clean, (9000, bad, None), (9001, "fine", f"<p>x</p><code>{bad}</code>")]
    got = {(r.id, r.field_name): r for r in M.garbled_fields(spark.createDataFrame(rows, SCHEMA), restore=True).collect()}
    assert set(got) == {(9000, "title")}
    assert got[9000, "title"].restored == original and got[9000, "title"].complete


def test_entities_and_lost_characters(spark, clean):
    rows = [*clean, (1001, None, "<p>ch&#195;&#162;teau d&#195;&#169;j&#195;&#160;</p>"), (1002, "ch�teau", None), (1003, None, "<p>a\x93b</p>"), (1004, "", ""), (1005, None, None), (None, "cafÃ©", None)]
    got = {(r.id, r.field_name): r for r in M.garbled_fields(spark.createDataFrame(rows, SCHEMA), restore=True).collect()}
    assert set(got) == {(1001, "html"), (1002, "title"), (1003, "html")}
    assert got[1001, "html"].restored == "<p>château déjà</p>" and not got[1002, "title"].complete


def test_found_alone_agrees_with_restoring(spark, clean):
    rows = [*clean, (1, "chÃ¢teau trÃ¨s", "<p>Ã©tÃ©</p>"), (1, "chÃ¢teau trÃ¨s", "<p>Ã©tÃ©</p>")]
    df = spark.createDataFrame(rows, SCHEMA)
    a = sorted((r.id, r.field_name) for r in M.garbled_fields(df).collect())
    assert a == sorted((r.id, r.field_name) for r in M.garbled_fields(df, restore=True).collect()) == [(1, "html")] * 2 + [(1, "title")] * 2


def test_empty_and_ascii_tables(spark):
    assert M.garbled_fields(spark.createDataFrame([], SCHEMA)).count() == 0
    assert M.garbled_fields(spark.createDataFrame([(1, "plain", "<p>plain</p>")], SCHEMA)).count() == 0


def test_held_out_accuracy(clean):
    table = np.zeros(1 << M.BITS)
    for _, title, html in clean:
        for t in (title, html):
            np.add.at(table, M._buckets(M._codes(" " + t + " ")), 1)
    model = M.BigramModel(table)
    held = corpus(150, seed=2)
    words = {w for _, t, _ in held for w in t.split() if not w.isascii()}
    assert not any(found for found, _, _ in M.judge(model, sorted(words)))
    bad = [(g, w) for g, w in ((w.encode("utf-8").decode("cp1252", "ignore"), w) for w in sorted(words)) if g.encode("cp1252", "ignore").decode("utf-8", "ignore") == w]
    assert np.mean([fixes.get(g) == w for (g, w), (_, _, fixes) in zip(bad, M.judge(model, [g for g, _ in bad]))]) >= 0.95


def test_double_garbling():
    twice = "déjà".encode().decode("cp1252").encode().decode("cp1252")
    assert ("dÃ©jÃ\xa0", True) in set(M._decodings(twice, {"x"})) and ("déjà", True) in set(M._decodings("dÃ©jÃ\xa0", {"x"}))
    assert ("déjà", True) in set(M.candidates(twice))
    other = "déjà".encode().decode("mac_roman").encode().decode("cp1252")  # the second round knows every reading
    assert ("déjà", True) in set(M.candidates(other))


def test_candidates_are_those_of_every_chain():
    """Characters tell which encodings can have been read; what they rule out fails to encode."""
    for word in ("dÃ©jÃ", "пїЅСЂ", "été", "река", "縺ゅ＞", "图书馆", "カフェ", "Ð´Ð¾"):
        got = {d for d, _ in M._decodings(word, {word})}
        want = set()
        for wrong, right in M.CHAINS:
            try:
                want.add(word.encode(wrong, "orbweave-c1").decode(right))
            except (UnicodeError, ValueError):
                pass
        assert got == {d for d in want if d != word and not M.BROKEN.search(d)}


def test_restoration_touches_nothing_else(spark, clean):
    html = (
        "<p title='a &amp; b'>ch&Atilde;&cent;teau &lt;b&gt; &#60;script&#62; tr&Atilde;&uml;s &eacute;t&eacute;</p>"
        "<code>caf&Atilde;&copy; &#60;i&#62;</code><pre>if (a &lt; b &amp;&amp; c)</pre>"
    )
    rows = [*clean, (1, None, html), (2, "a < b chÃ¢teau & c", None), (3, None, "<p>&lt;p&gt; &amp; &nbsp; plain</p>")]
    got = {(r.id, r.field_name): r for r in M.garbled_fields(spark.createDataFrame(rows, SCHEMA), restore=True).collect()}
    assert set(got) == {(1, "html"), (2, "title")} and got[1, "html"].complete
    assert got[1, "html"].restored == html.replace("ch&Atilde;&cent;teau", "château").replace("tr&Atilde;&uml;s", "très")
    assert got[2, "title"].restored == "a < b château & c"


def test_what_is_put_into_markup_is_escaped():
    assert M.replaced("x &Atilde;&copy; <b>Ã©</b>", {"Ã©": "<&é"}, True) == "x &lt;&amp;é <b>&lt;&amp;é</b>"
    assert M.replaced("Ã© <b>", {"Ã©": "é"}, False) == "é <b>"


def test_rates_on_held_out_words(spark, clean):
    rates = {r.chain: r for r in M.chain_rates(spark.createDataFrame(corpus(1500, seed=5), SCHEMA)).collect()}
    assert rates["clean"].words >= 10 and rates["clean"].found == 0
    assert sum(r.found for c, r in rates.items() if c != "clean") >= 0.8 * sum(r.words for c, r in rates.items() if c != "clean")
    assert M.chain_rates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("written", "read", "lang"), [("utf-8", "koi8_r", "fr"), ("utf-8", "gb18030", "fr"), ("cp1252", "mac_roman", "de")])
def test_a_hot_site_read_wrongly_is_not_learned_as_clean(spark, written, read, lang):
    """A third of the rows is one catalog, all of it garbled alike; the other catalogs stay clean."""
    r = random.Random(3)
    rows = [(i, t, h, i % 60) for i, t, h in corpus(600)]
    bad = [w.encode(written).decode(read) for w in WORDS[lang] if not w.isascii() and "\ufffd" not in w.encode(written).decode(read, "replace")]
    rows += [(5000 + i, " ".join(r.sample(bad, 3)), f"<p>{' '.join(r.choice([*bad, 'plain']) for _ in range(30))}</p>", 99) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA + ", catalog_id bigint")
    got = {(x.id, x.field_name) for x in M.garbled_fields(df).collect()}
    assert got == {(5000 + i, f) for i in range(300) for f in ("title", "html")}


def test_every_clean_field_is_counted_and_every_word_tried(spark):
    """No part of the fields is kept from the counts, and no sample of words stands for the others."""
    r = random.Random(7)
    own = ["".join(r.choice("abcdelmnoprstu") for _ in range(7)) + "é" for _ in range(900)]
    rows = [(i, f"{w} été plain", f"<p>{w} forêt</p>") for i, w in enumerate(own)]
    trained = M.train(spark.createDataFrame(rows, SCHEMA), {"title": False, "html": True})
    tokens = [t for _, title, html in rows for field in (title, html) for t in M._tokens(field)]
    assert trained.model.total == sum(len(M._buckets(M._codes(f" {t} "))) for t in tokens)
    assert {x.word for x in trained.words.collect()} == {*own, "été", "forêt"}
    rates = {x.chain: x for x in M.chain_rates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert rates["clean"].words == trained.words.count() >= 902


def test_the_margin_has_the_fewest_wrong_decisions():
    grid = M._grid()
    r = np.random.default_rng(2)
    clean, garbled = r.normal(1.0, 0.8, 4000), r.normal(4.5, 1.0, 3000)
    cells = [np.bincount(np.searchsorted(grid, x, side="right"), minlength=len(grid) + 1) for x in (clean, garbled)]
    wrong = [np.mean(clean >= m) + np.mean(garbled < m) for m in grid]
    assert wrong[int(np.argmin(abs(grid - M.fit_margin(*cells))))] == pytest.approx(min(wrong))
