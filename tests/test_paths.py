"""Closures, components and what is reached, against plain walks; long paths and rings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import patterns


def closure(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = set()
    for a in after:
        todo, seen = list(after[a]), set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += after.get(b, ())
        out |= {(a, b) for b in seen}
    return out


@pytest.mark.parametrize("seed, nodes, edges", [(1, 12, 14), (2, 30, 36)])
def test_closure_and_components_of_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)] + [(100, 101), (101, 102), (5, 5)]
    df = spark.createDataFrame(pairs, "x long, y long")
    right = closure(pairs)
    assert sorted(map(tuple, patterns.one_or_more(df).collect())) == sorted(right)
    names = {n for p in pairs for n in p}
    parts = {n: min([n, *(m for m in names if (n, m) in right and (m, n) in right)]) for n in names}
    assert dict(map(tuple, patterns.strong_components(df).collect())) == parts
    starts = spark.createDataFrame([(0,), (3,), (100,), (100,)], "x long")
    assert sorted(map(tuple, patterns.reached(df, starts).collect())) == sorted(p for p in right if p[0] in (0, 3, 100))


def test_closure_of_nothing_and_of_a_loop(spark):
    none = spark.createDataFrame([], "x long, y long")
    assert patterns.one_or_more(none).count() == patterns.strong_components(none).count() == patterns.reached(none, none.select("x")).count() == 0
    assert list(map(tuple, patterns.one_or_more(spark.createDataFrame([(1, 1)], "x long, y long")).collect())) == [(1, 1)]


def test_a_path_and_a_ring_of_ten_thousand(spark):
    n = 10_000
    path = spark.range(n).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    start = spark.createDataFrame([(0,), (9_990,)], "x long")
    assert patterns.reached(path, start, 40).count() == n + 10
    assert patterns._without_ends(path).isEmpty()
    ring = path.unionByName(spark.createDataFrame([(n, 0), (n, -1)], "x long, y long"))
    assert patterns.reached(ring, start.limit(1), 40).count() == n + 2


def test_components_of_rings(spark):
    n = 500
    ring = spark.range(n).select(F.col("id").alias("x"), F.pmod(F.col("id") + 1, F.lit(n)).alias("y"))
    other = ring.select((F.col("x") + 1000).alias("x"), (F.col("y") + 1000).alias("y"))
    both = ring.unionByName(other).unionByName(spark.createDataFrame([(3, 1003), (7, -1)], "x long, y long"))
    parts = patterns.strong_components(both, 4, 40)
    assert {tuple(r) for r in parts.groupBy("component").count().collect()} == {(0, n), (1000, n), (-1, 1)}
