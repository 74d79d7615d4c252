"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Every document becomes a digest of its normalised text, and digests are dealt over ``fan ** rounds``
partitions by a hash of the row. There each partition sorts its digests and merges equal neighbours:
that is its first run. Then the partitions exchange runs in rounds: in round k those whose numbers
differ in digit k only cut their runs into ``fan`` stretches of the digest space and give each other
one stretch each; what arrives is merged multiway, in sorted order, into the next run. After the last
round each partition holds one range of digests, and no other has any of it. At every level a run keeps,
for each digest, the smallest identifier, the number of rows, and the least and greatest of a second,
independent check of the text; where these differ two texts share a digest, and the job stops instead
of dropping one of them. A digest that a third of all rows share is one row of each first run, and so
at most ``fan`` rows of any later merge. Text is never shuffled by ``find``; the decisions are joined to
thin rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import checkpoint


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty.

    The pattern matches only runs that differ from one space, so that plain text passes unchanged.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    flat = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), F.sha2(flat, 256).alias("text_sha256"), F.xxhash64(flat, F.length(flat)).alias("check"))


def _merged(runs: DataFrame) -> DataFrame:
    """One sorted run for each partition number, of all rows with that number; equal digests are one row."""
    sorted_ = runs.repartition("part").sortWithinPartitions("part", "text_sha256")
    out = sorted_.groupBy("part", "text_sha256").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    clash = F.raise_error(F.lit("two texts share a SHA-256 digest"))
    return out.withColumn("n", F.when(F.col("low") == F.col("high"), F.col("n")).otherwise(clash.cast("long")))


def merge_runs(rows: DataFrame, fan: int = 8, rounds: int | None = None, rows_per_run: int = 1 << 20) -> DataFrame:
    """One row for each digest: smallest ``doc_id``, first of its rows, number of rows.

    ``rows`` has doc_id, row, text_sha256 (hexadecimal), check. A null doc_id sorts after every id.
    Without ``rounds``, there are two or as many as runs of about ``rows_per_run`` rows need.
    """
    if rounds is None:
        rounds = max(2, math.ceil(math.log(max(1, rows.count() / rows_per_run), fan)))
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    runs = rows.select(
        "text_sha256", first.alias("first"), F.lit(1).cast("long").alias("n"), F.col("check").alias("low"), F.col("check").alias("high"),
        F.pmod(F.xxhash64("row"), F.lit(fan**rounds)).alias("part"),
    )
    runs = _merged(runs)
    head = F.coalesce(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long"), F.xxhash64("text_sha256").bitwiseAND(F.lit((1 << 32) - 1)))
    stretch = F.floor(head * F.lit(fan**rounds) / F.lit(1 << 32))
    for k in range(rounds):
        unit = fan ** (rounds - 1 - k)  # the digit's place value, the highest digit first
        mine, goal = (F.pmod(F.floor(x / unit), F.lit(fan)) for x in (F.col("part"), stretch))
        runs = _merged(runs.withColumn("part", F.col("part") + (goal - mine) * unit))
    return runs.select("text_sha256", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("n").alias("group_size"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 8, rounds: int | None = None) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, and empty texts equal each other. Of rows that share text and id
    exactly one is kept. A null id loses against any id. An empty table gives an empty result; other
    columns are not read.
    """
    rows = checkpoint(_rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    merged = merge_runs(rows, fan, rounds)
    return rows.join(merged, "text_sha256").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever these are called.

    The row with the smallest id of each group of equal texts stays; of rows that share text and id,
    one stays. Nulls and empty tables as in ``find``.
    """
    rows = checkpoint(_rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    kept = checkpoint(merge_runs(rows).select("text_sha256", F.col("keep_id").alias("doc_id")))
    twice = rows.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1)
    whole = docs.select(F.struct("*").alias("whole"), F.col(id_col).alias("doc_id"), F.sha2(normalised(F.col(text_col)), 256).alias("text_sha256"))
    same = whole["doc_id"].eqNullSafe(kept["doc_id"]) & (whole["text_sha256"] == kept["text_sha256"])
    stay = whole.join(kept, same, "left_semi")
    if not twice.isEmpty():  # equal ids with equal texts: one of them
        stay = stay.groupBy("doc_id", "text_sha256").agg(F.first("whole").alias("whole"))
    return stay.select("whole.*")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
