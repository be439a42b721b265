import random

import pytest

from orbweave.operators import snapshot_diff as sd

SCHEMA = "id bigint, catalog_id bigint, version int, url string, html string"


def brute(rows):
    last = {}
    for i, c, v, u, h in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if None not in (c, v, u):
            last[c, v, u] = h
    out = set()
    for c in {k[0] for k in last}:
        versions = sorted({k[1] for k in last if k[0] == c})
        for a, b in zip(versions, versions[1:]):
            old = {u: h for (x, v, u), h in last.items() if (x, v) == (c, a)}
            new = {u: h for (x, v, u), h in last.items() if (x, v) == (c, b)}
            out |= {(c, u, b, "added") for u in new.keys() - old.keys()} | {(c, u, b, "removed") for u in old.keys() - new.keys()}
            out |= {(c, u, b, "changed") for u in new.keys() & old.keys() if new[u] != old[u]}
    return out


def run(spark, rows, **options):
    df = sd.snapshot_changes(spark.createDataFrame(rows, SCHEMA), **options)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [None, "", "a", "b", "é", "A"]
    rows = [(i, r.choice([1, 1, 1, 2, 3, None]), r.choice([0, 1, 4, 9]), r.choice([None, *map(str, range(60))]), r.choice(texts)) for i in range(900)]
    assert run(spark, rows) == brute(rows)


def test_buckets_that_are_too_full_are_enlarged(spark):
    rows = [(i, 1, 0, f"a{i}", "x") for i in range(400)] + [(1000 + i, 1, 1, f"b{i}", "x") for i in range(400)]
    assert run(spark, rows, first_cells=6, bucket_rows=200) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == set()
    same = [(1, 1, 0, "u", "x"), (1, 1, 0, "u", "x"), (2, 1, 1, "u", "x")]
    assert run(spark, same) == set()
    late = [(5, 1, 0, "u", "old"), (9, 1, 0, "u", "late"), (6, 1, 1, "u", "late"), (7, 1, 1, "", None)]
    assert run(spark, late) == {(1, "", 1, "added")}
    long = [(1, 1, 0, "u", "x" * 2_000_000), (2, 1, 1, "u", "x" * 1_999_999 + "y")]
    assert run(spark, long) == {(1, "u", 1, "changed")}


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([(1, 1, 0, "u", "x"), (2, 1, 1, "v", "x")], SCHEMA)
    extra = df.selectExpr("*", "'k' as k1", "7 as bucket", "8 as pair", "9 as cnt", "'g' as group_id")
    assert {tuple(r) for r in sd.snapshot_changes(extra).collect()} == {(1, "u", 1, "removed"), (1, "v", 1, "added")}


def test_hash_equals_sparks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    values = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    want = [r[0] for r in df.select(F.xxhash64("v", "v", "v", "v")).collect()]
    x = np.array(values, dtype=np.int64)
    assert sd._check_of(x, x, x, x).tolist() == want
