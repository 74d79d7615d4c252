"""The life of signing keys: which key signed, and whether it could at a given time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import temporal, text

#: Fixed value: the lists of a key document in the order in which they are searched.
LISTS = ("active", "rotated", "revoked")


def flatten(documents: DataFrame) -> DataFrame:
    """authority, key_id, list, times and grace period: one row for each key of each document.

    A document has arrays active, rotated and revoked and a struct ``policies``. Of keys with the same
    name in one list the first counts.
    """
    rows = None
    fields = ("rotated_at", "verify_until", "invalid_after")
    for name, own in zip(LISTS, ((), ("rotated_at", "verify_until"), ("invalid_after",))):
        told = documents.select("authority", F.col("policies.grace").alias("grace"), F.posexplode(name).alias("place", "k"))
        told = told.select("authority", text.key_fragment(F.col("k.id")).alias("key_id"), F.lit(name).alias("list"), "place", "grace", F.col("k.public_key").alias("public_key"), *[(F.col(f"k.{f}") if f in own else F.lit(None)).cast("timestamp").alias(f) for f in fields])
        rows = told if rows is None else rows.unionByName(told)
    order = Window.partitionBy("authority", "key_id").orderBy(F.array_position(F.array(*map(F.lit, LISTS)), F.col("list")), "place")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "place")


def grace_end(rotated_at: Column, verify_until: Column, grace: Column) -> Column:
    """The earlier of the stated end and of the rotation plus the grace period."""
    return F.least(verify_until, temporal.add_days(rotated_at, grace))


def status(found: Column, created: Column, at: Column, end: Column, invalid_after: Column) -> Column:
    """``struct<valid, status, warning>``. The end of the grace period still counts, the point of
    invalidation does not."""
    name = F.when(found == "active", "active").when(found == "rotated", F.when(at <= end, "rotated-grace").otherwise("rotated-expired")).when(found == "revoked", "revoked").otherwise("unknown")
    early = F.coalesce(created < invalid_after, F.lit(False))
    valid = F.coalesce(name.isin("active", "rotated-grace") | ((name == "revoked") & early), F.lit(False))
    warning = F.when(name == "rotated-grace", "signed by a rotated key within its grace period").when((name == "revoked") & early, "key revoked later; signed before the point of invalidation")
    return F.struct(valid.alias("valid"), name.alias("status"), warning.alias("warning"))


def statuses(manifests: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """The manifests (authority, method, created as a timestamp) with their key's status at a time."""
    told = manifests.withColumn("key_id", text.key_fragment(F.col("method")))
    joined = told.join(keys, ["authority", "key_id"], "left")
    end = grace_end(F.col("rotated_at"), F.col("verify_until"), F.col("grace"))
    return joined.select(*told.columns, status(F.col("list"), F.col("created"), at, end, F.col("invalid_after")).alias("key"))


def sweep(manifests: DataFrame, keys: DataFrame, start: str, end: str, step: str) -> DataFrame:
    """Statuses at every step of a stretch of time, a fixed list of instants for each manifest."""
    times = F.expr(f"sequence(timestamp'{start}', timestamp'{end}', interval {step})")
    return statuses(manifests.withColumn("at", F.explode(times)), keys, F.col("at"))
