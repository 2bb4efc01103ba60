import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.operators.hierarchy import contained, hierarchy, latest_rows, unsound

SCHEMA = "id bigint, name string, parent_id bigint, sort_order int, updated_at timestamp_ntz"
T0, T1 = datetime(2020, 1, 1), datetime(2020, 1, 2)


def brute(parents):
    found = {}
    for start in parents:
        path, x = [], start
        while x in parents and parents[x] is not None and x not in path:
            path.append(x)
            x = parents[x]
        if x in path:
            ring = path[path.index(x) :]
            found[start] = (min(ring), "cycle" if start in ring else "below_cycle")
        elif x not in parents:
            found[start] = (path[-1], "orphan" if path[-1] == start else "below_orphan")
    return found


def frame(spark, parents):
    return spark.createDataFrame([(i, f"n{i}", p, 0, T0) for i, p in parents.items()], SCHEMA)


def check(spark, parents):
    df = frame(spark, parents)
    got = {r.id: (r.anchor_id, r.reason) for r in unsound(df).collect()}
    want = brute(parents)
    assert got == want
    tree = {r.id: r for r in hierarchy(df).collect()}
    assert set(tree) == set(parents) - set(want)
    for i, r in tree.items():
        path, x = [i], parents[i]
        while x is not None:
            path.append(x)
            x = parents[x]
        assert r.path_ids == path[::-1] and r.depth == len(path) - 1 and r.root_id == path[-1]
        below = {j for j, o in tree.items() if i in o.path_ids and j != i}
        assert {j for j, o in tree.items() if r.lft < o.lft <= r.rgt} == below and r.n_descendants == len(below)
    assert sorted(r.lft for r in tree.values()) == list(range(len(tree)))
    return tree


def test_random_forests(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        ids = rnd.sample(range(1000), 60)
        parents = {i: rnd.choice([None, 7777, *ids[: max(1, k)], *ids]) if rnd.random() < 0.5 else (ids[k - 1] if k else None) for k, i in enumerate(ids)}
        check(spark, parents)


def test_chain_wide_and_cycles(spark):
    chain = {i: i - 1 if i else None for i in range(130)}
    wide = {1000 + i: 5 for i in range(200)}
    rings = {2000: 2000, 2001: 2002, 2002: 2003, 2003: 2001, 2004: 2003, 2005: 2004, 3000: 9999, 3001: 3000}
    tree = check(spark, chain | wide | rings)
    assert tree[0].n_descendants == 129 + 200


def test_versions_ties_nulls_and_extra_columns(spark):
    rows = [(1, "a", None, 0, T0), (1, "old", 9, 0, datetime(2019, 1, 1)), (2, None, 1, None, T0), (2, None, 1, None, T0), (3, "中/文", 1, 0, T1), (None, "x", 1, 0, T0), (4, "b", 1, 5, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("root", F.lit(1))
    tree = {r.id: r for r in hierarchy(df).collect()}
    assert {i: r.path for i, r in tree.items()} == {1: ["a"], 2: ["a", None], 3: ["a", "中/文"], 4: ["a", "b"]}
    assert latest_rows(df, "id", "updated_at", ["parent_id"]).count() == 4


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert hierarchy(df).count() == 0 and unsound(df).count() == 0


def test_contained_is_exact(spark):
    rnd = random.Random(4)
    outer = [(k, a, a + rnd.randint(0, 40)) for k in range(60) for a in [rnd.randint(0, 200)]]
    inner = [(k, rnd.randint(0, 250)) for k in range(80)]
    got = contained(spark.createDataFrame(outer, "o int, lft bigint, rgt bigint"), spark.createDataFrame(inner, "i int, at bigint"), 9)
    rows = [(r.o, r.i) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(o, i) for o, a, b in outer for i, at in inner if a < at <= b}


@pytest.mark.parametrize("parents", [{1: None}, {1: 1}, {1: 2}, {1: 2, 2: 1}])
def test_smallest(spark, parents):
    check(spark, parents)
