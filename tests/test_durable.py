"""Cut tables are planned with the size that they have."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.plans import durable


def shown(df, capsys, mode="simple"):
    capsys.readouterr()
    df.explain(mode)
    return capsys.readouterr().out


def test_a_table_of_long_texts_is_not_sent_whole(spark, capsys):
    rows = spark.range(60_000).select(F.col("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 2).alias("t"))
    told = durable.cut(rows)
    assert "Broadcast" not in shown(told.join(told.withColumnRenamed("t", "u"), "k"), capsys)


def test_the_size_told_of_a_table_does_not_grow_with_the_rounds(spark, capsys):
    state = durable.cut(spark.range(10).select(F.col("id").alias("x"), F.lit(None).cast("string").alias("n")))
    for _ in range(5):
        state = durable.cut(state.join(state.select("x"), "x"))
    assert state.count() == 10
    assert "EiB" not in shown(state, capsys, "cost") and "E+" not in shown(state, capsys, "cost")


def test_tables_that_files_cannot_hold_are_cut(spark):
    told = durable.cut(spark.range(3).select("id", F.lit(None).alias("none")))
    assert [tuple(r) for r in told.orderBy("id").collect()] == [(0, None), (1, None), (2, None)]


def test_rows_of_one_file_are_spread(spark, tmp_path):
    spark.range(4000).coalesce(1).write.parquet(str(tmp_path / "t"))
    told = durable.spread(spark.read.parquet(str(tmp_path / "t")), "id")
    assert told.rdd.getNumPartitions() == 4 and told.count() == 4000
