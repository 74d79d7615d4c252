"""Content-addressed blobs as tables: lookups, probes, writes and integrity, all set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import hashing


def store(rows: DataFrame, data: Column, keep: list[str] | None = None) -> DataFrame:
    """hash, bytes: each different content once, under its address."""
    told = rows.select(hashing.sha256(data).alias("hash"), data.cast("binary").alias("bytes"), *(keep or []))
    return told.dropDuplicates(["hash"])


def lookup(wanted: DataFrame, blobs: DataFrame, hash_col: str = "hash") -> DataFrame:
    """The wanted rows with ``bytes``, null where the store has none."""
    return wanted.join(blobs.select(F.col("hash").alias(hash_col), "bytes"), hash_col, "left")


def present(wanted: DataFrame, blobs: DataFrame, hash_col: str = "hash") -> DataFrame:
    return wanted.join(blobs.select(F.col("hash").alias(hash_col)), hash_col, "left_semi")


def without(blobs: DataFrame, deleted: DataFrame) -> DataFrame:
    """The store once the addresses of ``deleted`` are gone."""
    return blobs.join(deleted.select("hash"), "hash", "left_anti")


def put(blobs: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with new blobs; of equal addresses the new one stays."""
    return without(blobs, fresh).select("hash", "bytes").unionByName(fresh.select("hash", "bytes").dropDuplicates(["hash"]))


def emptied(blobs: DataFrame) -> DataFrame:
    """The store without any blob, its columns kept."""
    return blobs.limit(0)


def intact(blobs: DataFrame) -> DataFrame:
    """Only blobs whose bytes have the address that they are stored under."""
    return blobs.where(hashing.verify(F.col("hash"), F.col("bytes")))


def corrupted(blobs: DataFrame) -> DataFrame:
    """Blobs whose bytes do not have their address, or whose address names no known algorithm."""
    return blobs.where(~F.coalesce(hashing.verify(F.col("hash"), F.col("bytes")), F.lit(False)))


def identical(readings: DataFrame, by: str = "hash") -> DataFrame:
    """Per address, whether all readings (from different stores) have the same bytes."""
    return readings.groupBy(by).agg((F.count_distinct(F.sha2("bytes", 256)) <= 1).alias("identical"), F.count("*").alias("readings"))
