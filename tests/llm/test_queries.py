"""Queries on the smallest tables: against their SQL where there is some, else against each other and their tables."""

import pytest

from orbweave.llm.pagelines import visible_lines
from orbweave.llm.queries import QUERIES, SQL
from tests.oracle import connect, rows

DATA = "/root/testdata/sf0.001"
FOUND = {
    "p2_found": ["id", "line_no"], "p3_found": ["id", "line_no"], "p4_found": ["id", "field_name"], "p5_found": ["id"],
    "p6_found": ["id"], "p9_found": ["doc_id_1", "doc_id_2"],
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, DATA).toPandas() for name, query in QUERIES.items()}


@pytest.fixture(scope="module")
def tables():
    c = connect(DATA)
    return {name: c.sql(f"SELECT * FROM {name}").df() for name in ("crawler_resource", "indexed_resource", "documents", "container_specs", "mix_targets")}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found(results, name):
    got = results[name]
    assert list(got.columns) == FOUND[name] and not got.duplicated().any() and len(got)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(results, name):
    assert rows(results[name]) == rows(connect(DATA).sql(SQL[name]).df())


def test_lines_and_pages_agree(results, tables):
    html = dict(zip(tables["crawler_resource"]["id"], tables["crawler_resource"]["html"]))
    gone = results["p2_found"].groupby("id")["line_no"].apply(set).to_dict()
    for r in results["p2_cleaned"].itertuples():
        kept = [line for n, line in enumerate(html[r.id].split("\n"), 1) if n not in gone.get(r.id, ())]
        assert r.html == "\n".join(kept) and r.removed == len(gone.get(r.id, ()))
    blocks = results["p2_blocks"]
    assert blocks["support"].min() >= 4 and (blocks["nodes"] > blocks["edges"]).sum() > 0 and blocks["text"].str.len().min() > 0
    body = results["p3_found"].groupby("id")["line_no"].apply(set).to_dict()
    texts = dict(zip(results["p3_texts"]["id"], results["p3_texts"]["text"]))
    assert set(texts) == set(body)
    for i, text in texts.items():
        shown = dict(visible_lines(html[i]))
        lines = text.split("\n")
        # elements of one line are parted by a blank
        packed = lambda t: t.replace(" ", "")
        assert len(lines) == len(body[i]) and all(line and packed(line) in packed(shown[n]) for n, line in zip(sorted(body[i]), lines))
    contents = results["p3_contents"]
    assert set(contents["id"]) == set(tables["indexed_resource"]["id"])
    assert all(c == texts[i].replace("\n", " ") for i, c in zip(contents["id"], contents["content"]) if isinstance(c, str))


def test_fields_and_reasons_agree(results):
    restored, found = results["p4_restored"], results["p4_found"]
    assert set(zip(restored["id"], restored["field_name"])) == set(zip(found["id"], found["field_name"])) and restored["complete"].any()
    assert (results["p4_rates"]["found"] <= results["p4_rates"]["words"]).all()
    reasons = results["p6_reasons"]
    assert set(reasons["id"]) == set(results["p6_found"]["id"]) and set(reasons["reason"]) <= {"placeholder", "title", "replaced"}


def test_rates_keep_their_bound(results, tables):
    (r,) = results["p5_rates"].itertuples()
    keyed = tables["crawler_resource"].dropna(subset=["url", "catalog_id"])
    assert r.probes_of_new_keys == len(keyed[["catalog_id", "url"]].drop_duplicates()) and r.audited_rate <= 0.01 and r.theoretical_rate <= 2**-12


def test_containers_agree(results, tables):
    packed, capacity = results["p7_packed"], dict(zip(tables["container_specs"]["spec_id"], tables["container_specs"]["capacity_tokens"]))
    load = packed.groupby(["spec_id", "container"])["tokens"].sum()
    assert all(n <= capacity[spec] for (spec, _), n in load.items())
    assert all(set(part["doc_id"]) == set(tables["documents"]["doc_id"]) for _, part in packed.groupby("spec_id"))
    filled = results["p7_containers"]
    assert len(filled) == len(load) and filled["tokens"].sum() == packed["tokens"].sum()
    summary = results["p7_summary"]
    assert (summary["least_containers"] <= summary["containers"]).all() and (summary["containers"] <= summary["best_fit_containers"]).all()


def test_shares_agree(results, tables):
    drawn, shares = results["p8_drawn"], results["p8_shares"]
    assert set(shares["source"]) == set(tables["mix_targets"]["source"]) and not drawn["doc_id"].duplicated().any()
    got = (drawn["tokens"] * drawn["copies"]).groupby(drawn["source"]).sum()
    assert all(r.drawn_tokens == got.get(r.source, 0) and r.most_copies <= r.max_repeats for r in shares.itertuples())
    # a miss is smaller than half a record that one copy more or less of would mend
    largest = drawn.groupby("source")["tokens"].max()
    assert all(2 * abs(r.drawn_tokens - r.goal_tokens) <= largest[r.source] for r in shares.itertuples() if r.drawn_tokens and not r.shortfall_tokens)


def test_classes_hold_the_pairs(results):
    classes = results["p9_classes"].groupby("class_id")["doc_id"].apply(list)
    pairs = {(a, b) for docs in classes for a in docs for b in docs if a < b}
    assert pairs == set(zip(results["p9_found"]["doc_id_1"], results["p9_found"]["doc_id_2"]))
