"""Cutting the lineage of iterative plans in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _settle(spark: SparkSession) -> None:
    """Has Spark use ``spark.checkpoint.dir``; a temporary folder in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="attestry-"))


def cut(df: DataFrame) -> DataFrame:
    """Computes a table once and cuts its lineage.

    The rows are files of the shared folder, not compressed, so that Spark plans what follows with the size that they have. A bare
    checkpoint keeps the guess made of its plan: too low for texts made of short columns, so that whole tables are sent to the
    driver and on to all executors, and for joins a product, a number with twice the digits after every round.
    """
    spark = df.sparkSession
    if "void" in df.schema.simpleString() or len({c.lower() for c in df.columns}) < len(df.columns) or not df.columns:
        _settle(spark)
        return df.checkpoint()  # files have no place for these
    path = fresh_path(spark, "cut")
    df.write.option("compression", "none").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's address in the shared folder."""
    _settle(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"



def spread(df: DataFrame, key: str, rows: int = 1024) -> DataFrame:
    """The rows of a stored table dealt by ``key`` over as many tasks as the session has places for.

    A file of small rows is read by one task, however much work each row is. Tasks get some ``rows`` at least, since batches share costs.
    """
    spark = df.sparkSession
    most = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(most, -(-df.count() // rows))), key)
