"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. The key's high bits cut each source into ranges of about
``rows_per_range`` rows, so that range-sorting needs no sampling and a source with a third of all
rows is many ranges. Token counts are summed by range, the sums run up over the ranges of a source,
then over the documents of a range in key order; the budget of the source cuts this running sum at
its exact word. A budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import NOT_WHITE, checkpoint

#: Fixed values of the contract: weights by the rank of the source, share of all sizes, cap by source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0


def words_in(text: Column) -> Column:
    """Number of words; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WHITE)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str) -> Column:
    """Fifteen hexadecimal digits of SHA-256 of the seed and the id, as a number below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, in code-point order with null last, without one task for all sources.

    Sources are dealt by ranges of their order; the running count over these few ranges is the rank at
    which each begins.
    """
    order = F.col("source").asc_nulls_last()
    dealt = checkpoint(sources.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    starts = dealt.groupBy("part").count().withColumn("start", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.withColumn("inside", inside).join(starts, "part").withColumn("rank", F.col("start") + F.col("inside") - 1).drop("part", "start", "inside")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, rounds: int = 1000) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    All sources share ``share`` times all sizes by weight; a source stops at ``cap`` times its own
    size, and what it leaves is shared again by weight until none is above. Each round is one
    aggregation to a single row and caps every source that the present share puts above.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    known = checkpoint(_ranked(sizes).select("source", "source_size", weight.alias("w"), (F.col("source_size") * cap).alias("most")))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    for _ in range(rounds):
        above = F.col("w") * F.lit(level) > F.col("most")
        free, used = known.agg(F.sum(F.when(~above, F.col("w"))), F.sum(F.when(above, F.col("most")))).first()
        risen = (share * total - (used or 0.0)) / free if free else level
        if risen <= level:
            break
        level = risen
    else:
        raise RuntimeError(f"targets did not settle in {rounds} rounds")
    return known.select("source", "source_size", F.least(F.lit(level) * F.col("w"), F.col("most")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", rows_per_range: int = 4_096) -> DataFrame:
    """One row for each input row: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes from the document, repeats by further epochs
    included; the document at a source's cut gives the words that are missing. A source takes its
    target, rounded to a whole word. Null sources form one source, which is last; a null text has no
    words and gives none; rows with equal ids are ordered by size, and equal rows are alike. An empty
    table gives an empty result. The same input gives the same mix.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), random_key(F.col(id_col), seed).alias("key"))
    thin = checkpoint(thin)
    bits = max(0, int(thin.count() / rows_per_range).bit_length())
    thin = thin.withColumn("range", F.shiftright("key", 60 - bits))
    sums = thin.groupBy("source", "range").agg(F.sum("size").alias("n"))
    plan = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    ranges = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n"))
    ranges = ranges.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("range").alias("r"), "before", "source_size", "target")
    told = thin.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("size").over(order) - F.col("size")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return told.withColumn("taken", (epochs * F.col("size") + last).cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix as documents: rows of which the mix takes words, repeated as often as it takes them.

    All columns stay, whatever these are called. The document at a cut appears whole where the cut
    takes at least half of it. Rows that share id, source and size are one row of the mix each.
    """
    plan = mix_sources(docs, id_col, text_col, source_col, seed)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    plan = plan.groupBy("doc_id", "source", "size").agg(F.max(times).alias("times"))
    plan = plan.where("times > 0").select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z"), "times")
    whole = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    return whole.join(plan, same).select("whole", F.explode(F.sequence(F.lit(1), "times")).alias("epoch")).select("whole.*")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'))
           - length(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', '', 'g')) AS size,
         ('0x' || substr(sha256('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
             source_size * 2.0::DOUBLE AS most FROM s),
o AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
             sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
             1.5::DOUBLE * sum(source_size) OVER () AS total FROM r),
l AS (SELECT max((total - used) / free) FILTER (WHERE (total - used) / free <= most / w) AS level FROM o),
p AS (SELECT source, source_size, least((SELECT level FROM l) * w, most) AS target FROM r),
e AS (SELECT d.doc_id, d.size, p.source_size, p.target, round(p.target)::BIGINT AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END - start)))::BIGINT AS taken
FROM e
"""
