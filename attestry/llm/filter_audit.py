"""Audit of how filters interact, by long-form windows.

What a filter chain does depends only on which filters a document fails, so documents are first
counted in cells: the part, a mask with one bit for each failed filter, and the labels. Cells are
unpivoted against every step of every order of the filters; a running bit-or over the steps before
tells which documents of the cell are gone by then, conditional sums over the cells give the metrics of
a step, and a window over all orders and steps of a filter gives its total.

Equal texts fail the same filters of content, so copies are told by groups of equal digests that were
counted before the shuffle; a text that a third of all rows share is a few thin rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the contract: the filters by letter, lowest bit first, and their bounds.
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, r"[#$%&*|]"


def content_mask(text: Column) -> Column:
    """The filters A to D that a text fails, as bits; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    few = F.size(words) < LEAST_WORDS
    repeats = F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * DISTINCT_PERCENT
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT
    fails = [few, repeats, capitals, text.rlike(MARKS)]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic, n: how many rows of a part fail just the filters of the mask.

    A row fails E if its text is that of a row with a smaller id; a null id is larger than any other and
    has no label. Rows that share id and text are no copies of each other. Several labels of one id count
    as good, or toxic, if one of them says so. Of both tables only the named columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), content_mask(F.col(text_col)).alias("mask"),
    )
    # A null id gets a key by its text that no label has, so that many of them are no hot key.
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.concat(F.lit(b"null"), F.col("digest"))).otherwise(F.lit(b"")))
    told = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    ).withColumn("salt", F.lit(b""))
    same = rows["id"].eqNullSafe(told["id"]) & (rows["salt"] == told["salt"])
    no = F.lit(False)
    joined = rows.join(told, same, "left").select(rows["id"], "part", "digest", "mask", rows["salt"], F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    one = joined.groupBy("id", "salt", "part", "digest", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))  # ids are single inside a group
    groups = one.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), first.alias("first"))
    lead = F.struct("first.none", "first.id")
    least = F.min(lead).over(Window.partitionBy("digest"))
    groups = groups.withColumn("copies", F.col("n") - F.when(lead.eqNullSafe(least), F.col("first.n")).otherwise(0))
    split = F.array(F.struct("mask", (F.col("n") - F.col("copies")).alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), F.col("copies").alias("n")))
    each = groups.select("part", "good", "toxic", F.explode(split).alias("cell")).where("cell.n > 0")
    return each.groupBy("part", F.col("cell.mask").alias("mask"), "good", "toxic").agg(F.sum("cell.n").alias("n"))


def interactions(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The metrics of every step of every order of the filters, for each part of ``cells``.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. No
    cells give no rows. The number of rows is that of the parts times the steps of all orders.
    """
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    long = counted.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))
    long = long.withColumn("bit", F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), F.col("letter")) - 1)).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("gone", F.coalesce(F.bit_or("fails").over(before), F.lit(0)) > 0)
    fails, gone, n = F.col("fails") > 0, F.col("gone"), F.col("n")

    def total(which: Column, name: str) -> Column:
        return F.sum(F.when(which, n).otherwise(0)).alias(name)

    steps = long.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "letter").agg(
        total(~fails & ~gone, "kept"), total(fails & ~gone, "removed"), total(fails & gone, "redundant"), total(F.col("mask") == F.col("bit"), "unique_fails"),
        total(fails & ~gone & F.col("good"), "good_lost"), total(fails & ~gone & F.col("toxic"), "toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return interactions(cells(docs, labels))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT part, concat(CASE WHEN len(w) < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END,
         CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
         CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails,
         EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AS toxic
  FROM d),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
o(s) AS (SELECT '' UNION ALL SELECT s || l FROM o, unnest(['A', 'B', 'C', 'D', 'E']) t(l) WHERE length(s) < 5 AND NOT contains(s, l)),
p AS (SELECT s AS filter_order, k AS step, s[k] AS l, s[1:k - 1] AS earlier FROM o, range(1, 6) t(k) WHERE length(s) = 5),
m AS (
  SELECT part, filter_order, step, l, contains(fails, l) AS hit, fails = l AS only_, n, g, x,
         length(translate(fails, earlier, '')) < length(fails) AS gone FROM c, p),
r AS (
  SELECT part, filter_order, step, l, sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_ THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN hit AND NOT gone THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN x ELSE 0 END) AS toxic_lost
  FROM m GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM r
"""
