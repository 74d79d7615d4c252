"""How many terms each leads to, without the pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import patterns
from tests.test_paths import closure


def test_counts_are_those_of_the_closure(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (5, 5), (6, 5), (7, 8), (8, 9)]
    told = dict(map(tuple, patterns.reach_counts(spark.createDataFrame(pairs, "x long, y long")).collect()))
    right = closure(pairs)
    assert told == {x: sum(a == x for a, _ in right) for x, _ in right}
    path = spark.range(5).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y"))
    assert dict(map(tuple, patterns.reach_counts(path).collect())) == {x: 5 - x for x in range(5)}
