"""Problems 5 and 9: keys seen before, shared spans."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.llm.golomb import GolombSet, add
from orbweave.llm.seen_keys import _keyed, candidate_records, probe_keys, seen_before, seen_rates
from orbweave.llm import shared_spans
from orbweave.llm.shared_spans import SPAN, pairs_within, shared_amounts, shared_classes, shared_pairs, shared_stretches

KEYS = "id bigint, catalog_id bigint, url string"


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), max_size=700), st.integers(0, 2**32))
def test_coded_sets_round_trip(values, seed):
    v = np.array(sorted(values), dtype=np.uint64)
    one = GolombSet(v, 1 << 40)
    assert (one.values() == v).all()
    probes = np.unique(np.concatenate([v[::3], np.random.default_rng(seed).integers(0, 2**40, 50).astype(np.uint64)]))
    assert one.contains(probes).tolist() == [int(p) in values for p in probes]


def test_coded_sets_are_small_and_merge():
    r = np.random.default_rng(1)
    levels = []
    for _ in range(8):
        add(levels, np.unique(r.integers(0, 2**26, 2000).astype(np.uint64)), 1 << 26)
    assert len(levels) == 1 and levels[0].count > 15_000
    assert levels[0].bits / levels[0].count < np.log2(2**26 / levels[0].count) + 3.5
    empty = GolombSet(np.empty(0, dtype=np.uint64), 8)
    assert not len(empty.values()) and not empty.contains(np.array([1], dtype=np.uint64))[0]


def brute_seen(rows):
    first = {}
    for i, c, u in rows:
        if None not in (i, c, u):
            first[c, u] = min(i, first.get((c, u), i))
    return sorted(i for i, c, u in rows if None not in (i, c, u) and i > first[c, u])


@pytest.mark.parametrize("seed", range(3))
def test_seen_against_brute_force(spark, seed):
    r = random.Random(seed)
    urls = [None, "", "a", "A", "a ", *(f"u{i}" for i in range(150))]
    rows = [(i, r.choice([1, 1, 2, None]), r.choice(urls) if r.random() < 0.7 else "hot") for i in r.sample(range(10_000), 700)]
    got = sorted(x.id for x in seen_before(spark.createDataFrame(rows, KEYS), shard_keys=64, epochs=7).collect())
    assert got == brute_seen(rows)


def test_seen_edges(spark):
    assert seen_before(spark.createDataFrame([], KEYS)).count() == 0
    rates = seen_rates(spark.createDataFrame([], KEYS)).first()
    assert rates.probes_of_new_keys == 0 and rates.audited_rate == 0
    twins = [(5, 1, "u"), (5, 1, "u"), (6, 1, "u"), (7, 1, "x" * 100_000), (8, 1, "x" * 100_000)]
    df = spark.createDataFrame(twins, KEYS).selectExpr("*", "1 as h", "2 as key0", "3 as shard", "4 as first")
    assert sorted(r.id for r in seen_before(df).collect()) == [6, 8]


def test_new_keys_never_reach_the_exact_check(spark):
    """Of 30,000 keys 500 come again: only those, and false positives at the theoretical rate, are compared exactly."""
    df = spark.range(30_500).selectExpr("id", "1 as catalog_id", "cast(id % 30000 as string) as url")
    base = _keyed(df, ("catalog_id", "url"), "id")
    flagged = probe_keys(base, shard_keys=1024)
    candidates = candidate_records(base, flagged)
    assert 1000 <= candidates.count() <= 1000 + 30_000 * 2**-12 * 4
    # were nothing flagged, nothing would be found: the sets decide
    assert candidate_records(base, flagged.withColumn("maybe", F.lit(False))).filter("id >= 30000").count() < 500
    assert seen_before(df, shard_keys=1024).count() == 500


def test_keys_that_share_an_order_value(spark):
    rows = [(3, 1, "b"), (5, 1, "a"), (5, 1, "b"), (6, 1, "a")]
    assert sorted(r.id for r in seen_before(spark.createDataFrame(rows, KEYS)).collect()) == [5, 6]


def test_audited_rate_keeps_the_bound(spark):
    df = spark.range(30_000).selectExpr("id", "id % 7 as catalog_id", "cast(id as string) as url")
    rates = seen_rates(df, fp_bits=4, shard_keys=1024).first()
    assert rates.probes_of_new_keys == 30_000 and 0 < rates.audited_rate <= 1 / 16
    assert abs(rates.audited_rate - rates.theoretical_rate) < 0.01


DOCS = "doc_id bigint, text string"


def brute_pairs(rows):
    grams = {}
    for i, t in rows:
        for p in range(len(t or "") - SPAN + 1):
            grams.setdefault(t[p : p + SPAN], set()).add(i)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def brute_amount(rows, i, text):
    others = {t[p : p + SPAN] for j, t in rows if j != i for p in range(len(t or "") - SPAN + 1)}
    covered = set()
    for p in range(len(text) - SPAN + 1):
        if text[p : p + SPAN] in others:
            covered.update(range(p, p + SPAN))
    return len(covered)


def texts(seed):
    r = random.Random(seed)
    fresh = lambda n: "".join(r.choice("abcdefgh \n日本é") for _ in range(n))
    spans = [fresh(n) for n in (199, 200, 201, 230, 450, 900)]
    rows = []
    for i in range(40):
        parts = [fresh(r.randint(0, 300))]
        for _ in range(r.randint(0, 2)):
            s = r.choice(spans)
            cut = r.randint(0, 40)
            parts += [s[cut:] if r.random() < 0.3 else s, fresh(r.randint(0, 200))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (104, "short"), (105, "short"), (106, "z" * 700), (107, "z" * 500), (108, "y" * 210), (108, "y" * 210), (109, "ab" * 150)]
    # equal ends around a middle of the same length that differs
    left, right = fresh(130), fresh(130)
    return rows + [(110, left + fresh(60) + right), (111, left + fresh(60) + right), (112, left[:100] + "#" + left[100:] + right)]


@pytest.mark.parametrize("seed", range(3))
def test_shared_spans_against_brute_force(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame(rows, DOCS)
    got = [tuple(r) for r in shared_pairs(df).collect()]
    assert set(got) == brute_pairs(rows) and len(got) == len(set(got))
    classes = {}
    for r in shared_classes(df).collect():
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert {(a, b) for docs in classes.values() for a in docs for b in docs if a < b} == brute_pairs(rows)
    if seed == 0:
        amounts = {r.doc_id: r for r in shared_amounts(df.filter("doc_id <> 108")).collect()}
        kept = [x for x in rows if x[0] != 108]
        for i, t in kept:
            assert amounts[i].shared_chars == (brute_amount(kept, i, t) if t else 0), i
            assert amounts[i].n_chars == len(t or "")


def test_stretches_are_where_they_are(spark):
    r = random.Random(9)
    fresh = lambda n: "".join(r.choice("abcdefgh \n日本é") for _ in range(n))
    a, b = fresh(250), fresh(400)
    rows = [(1, "x" * 10 + a + "|" + b), (2, a + "~"), (3, "12" + b), (4, a[:199] + "#"), (5, "q" * 300), (6, "q" * 300)]
    got = {(x.doc_id, x.start, x.stop) for x in shared_stretches(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 10, 260), (1, 261, 661), (2, 0, 250), (3, 2, 402), (5, 0, 300), (6, 0, 300)}


def test_long_spans_are_verified_from_the_text(spark, monkeypatch):
    """Even if all k-mers had one hash, texts that differ would not pair."""
    r = random.Random(3)
    rows = [(i, "".join(r.choice("abcdefgh") for _ in range(400))) for i in range(6)]
    df = spark.createDataFrame([*rows, (6, rows[0][1] + "tail")], DOCS)
    texts = shared_spans._texts(df, "doc_id", "text")
    wrong = texts.select("tid", F.lit(0).alias("start"), F.lit(400).alias("stop"))  # as if a path ran through all of them
    monkeypatch.setattr(shared_spans, "shared_paths", lambda _: wrong)
    assert [tuple(x) for x in shared_pairs(df).collect()] == [(0, 6)]


def test_pairs_of_a_large_group_are_split(spark, monkeypatch):
    monkeypatch.setattr(shared_spans, "BLOCK", 7)
    members = spark.range(60).selectExpr("1 as k", "id as m").unionByName(spark.range(3).selectExpr("2 as k", "id as m"))
    got = [tuple(x) for x in pairs_within(members, ["k"], "m").collect()]
    assert len(got) == len(set(got)) == 60 * 59 // 2 + 3 and all(a < b for _, a, b in got)


def test_spans_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert shared_pairs(empty).count() == 0 and shared_amounts(empty).count() == 0
    long = "".join(random.Random(5).choice("abcdefghij") for _ in range(900_000))
    df = spark.createDataFrame([(1, long), (2, "x" + long[400_000:400_250] + "y"), (None, long)], DOCS).selectExpr("*", "1 as tid", "2 as doc", "3 as h", "4 as pos")
    assert [tuple(r) for r in shared_pairs(df).collect()] == [(1, 2)]
