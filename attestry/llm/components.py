"""Connected components of an edge table, by alternating stars.

Each round links every vertex to the least vertex near it, first among its larger neighbours, then
among its smaller ones; the number of rounds grows with the logarithm of the longest chain. A round
is two aggregations and two equi-joins, so a vertex with very many links costs no single task: the
minimum is combined before the shuffle and a skewed join side is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import checkpoint


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every vertex that has a link to another one.

    ``component`` is the least vertex reachable. Links to oneself and links with a null end are
    ignored; repeated links count once; an empty table gives an empty table. Raises where ``rounds``
    do not suffice, rather than return components that are not whole.
    """
    x, y = F.col(a), F.col(b)
    links = (
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct()
    )
    links = checkpoint(links)
    seen = None
    for _ in range(rounds):
        mark = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(pmod(xxhash64(v, u), 1000003))")).first()
        if not mark[0] or mark == seen:
            least = links.groupBy("v").agg(F.lit(1).alias("n")).select(F.col("v").alias("node"), F.col("v").alias("component"))
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)
        seen = mark
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
