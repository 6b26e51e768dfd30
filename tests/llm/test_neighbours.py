"""Nearest neighbours against brute force: exact scores and order on small tables, recall on larger ones."""

import math
import random

import numpy as np
import pytest

from wearframe.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label string, rank string, score string, leaf string"


def brute(rows, k):
    """Exact answer; rows are (id, vector), one vector an id."""
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            found = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def answered(df, **options):
    got = {}
    for r in neighbours.search(df, df.filter("vec_id % 20 = 0"), **options).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(g) == list(range(1, len(g) + 1)) for g in got.values())
    return {q: [g[i] for i in sorted(g)] for q, g in got.items()}


def table(spark, rows):
    return spark.createDataFrame([(i, v, "mine", "mine", "mine", "mine") for i, v in rows], SCHEMA).repartition(5)


def test_awkward_vectors(spark):
    rng = random.Random(8)
    # small whole numbers: many exact ties; a third of all rows are one vector
    good = [(i, [float(rng.randint(-2, 2)) for _ in range(6)]) for i in range(200)] + [(1000 + i, [1.0, 2.0, 0.0, -1.0, 2.0, 1.0]) for i in range(120)]
    good = [(i, v) for i, v in good if any(v)]
    bad = [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2060, [math.nan] * 6), (2080, [math.inf] + [0.0] * 5), (2100, []), (2120, [1.0, 2.0]), (None, [1.0] * 6)]
    df = table(spark, good + bad + [good[20]] * 3)
    want = brute(good, 20)
    for options in ({}, {"leaf_rows": 8, "group_rows": (7, 7), "query_rows": 3, "recall": 1.0}):
        got = answered(df, **options)
        assert got.keys() == want.keys()
        if options:
            assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in g] for q, g in want.items()}
        for q, found in got.items():
            assert all(s == sum(a * b for a, b in zip(dict(good)[q], dict(good)[i], strict=True)) for i, s in found)
    few = answered(table(spark, good[:6] + [good[20]]))
    assert all(len(g) == 6 for g in few.values()) and few


def test_nothing(spark):
    assert answered(spark.createDataFrame([], SCHEMA)) == {}
    assert answered(table(spark, [(3, [1.0, 2.0])])) == {}
    assert answered(table(spark, [(20, [1.0, 2.0])])) == {}


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered):
    rng = np.random.default_rng(4)
    n, d = 3000, 24
    x = rng.normal(size=(n, d))
    if clustered:
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] * 3 + 0.4 * x
    x = x.astype(np.float32).astype(float) * np.where(rng.random(n) < 0.1, 2, 1)[:, None]
    got = answered(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), leaf_rows=40, group_rows=(300, 300), query_rows=40)
    hits = 0
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-s)[:20].tolist()))
        assert all(abs(v - float(x[i] @ x[q])) < 1e-9 for i, v in got[q])
    assert hits / (20 * len(got)) >= 0.9 and len(got) == n // 20


def test_tree_walk_opens_the_best_bin():
    rng = np.random.default_rng(1)
    tree = neighbours.fit(rng.normal(size=(400, 5)), 10)
    x = rng.normal(size=(300, 5))
    leaf = tree.place(x)
    assert set(leaf) <= set(range(tree.leaves))
    sizes = np.bincount(leaf, minlength=tree.leaves).tolist()
    walk = tree.visit(tree.centres @ x[0], sizes, tree.leaves, 0)
    assert sorted(walk) == list(range(tree.leaves))
    assert tree.visit(tree.centres @ x[0], sizes, 3, 0) == walk[:3]
    # equal vectors cannot be split
    assert neighbours.fit(np.ones((50, 3)), 4).leaves == 1


def test_groups():
    assert neighbours.groups_of([3, 4, 5, 25, 1, 0], 10) == ([0, 0, 1, 2, 5, 5], [1, 1, 1, 3, 1, 1])
