"""The data source of files named by their address: what filters open, what writes leave."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from attestry.sources import addressed, packages


def address(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


BLOBS = {address(b): b for b in (f"blob {k}".encode() * (k + 1) for k in range(60))} | {address(b""): b""}


@pytest.fixture
def folder(spark, tmp_path):
    addressed.register(spark)
    path = str(tmp_path / "store")
    spark.createDataFrame(list(BLOBS.items()), "hash string, bytes binary").repartition(4).write.format("addressed").mode("append").save(path)
    return path


def load(spark, path):
    return spark.read.format("addressed").load(path)


def held(df):
    return sorted((r["hash"], bytes(r["bytes"])) for r in df.collect())


def files(path):
    return [os.path.join(at, f) for at, _, names in os.walk(path) for f in names]


def test_what_is_written_is_read(spark, folder):
    assert held(load(spark, folder)) == sorted(BLOBS.items())
    more = [(address(b"new"), b"new"), (address(b"new"), b"new"), *list(BLOBS.items())[:5]]
    spark.createDataFrame(more, "hash string, bytes binary").repartition(3).write.format("addressed").mode("append").save(folder)
    assert len([f for f in os.listdir(folder) if f.startswith("batch-")]) == 2 and len(files(folder)) == len(BLOBS) + 1
    assert held(load(spark, folder)) == sorted([*BLOBS.items(), (address(b"new"), b"new")])
    packages.write_files(spark.createDataFrame([(address(b"flat"), b"flat"), *list(BLOBS.items())[:2]], "hash string, bytes binary"), folder)
    assert load(spark, folder).count() == len(BLOBS) + 2
    assert held(load(spark, folder).where(F.col("hash") == address(b"flat"))) == [(address(b"flat"), b"flat")]


def test_a_filter_opens_the_named_files_only(spark, folder):
    names = sorted(BLOBS)
    for f in files(folder):  # whatever is opened beside them ends the job
        if addressed.address_of(os.path.basename(f)) not in names[:3]:
            os.remove(f)
            os.mkdir(f)
    some = load(spark, folder).where(F.col("hash").isin(*names[:2], "sha256:none", "../x") & F.col("hash").isNotNull())
    assert held(some) == [(n, BLOBS[n]) for n in names[:2]]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "BatchScan addressed" in plan  # both conditions are left to the source
    assert held(load(spark, folder).where(F.col("hash") == names[2])) == [(names[2], BLOBS[names[2]])]
    assert load(spark, folder).where((F.col("hash") == names[2]) & (F.col("hash") == names[1])).count() == 0
    start = names[0][:10]
    assert held(load(spark, folder).where(F.startswith("hash", F.lit(start)))) == [(n, BLOBS[n]) for n in names[:3] if n.startswith(start)]
    with pytest.raises(Exception):
        spark.createDataFrame([("a/b", b"x")], "hash string, bytes binary").write.format("addressed").mode("append").save(folder)


def test_a_write_that_fails_leaves_nothing(spark, folder):
    before = sorted(files(folder))
    broken = spark.range(40).select(F.concat(F.lit("sha256:x"), "id").alias("hash"), F.when(F.col("id") < 39, F.lit(b"data")).alias("bytes"))
    with pytest.raises(Exception, match="needs an address and bytes"):
        broken.repartition(4).write.format("addressed").mode("append").save(folder)
    assert sorted(files(folder)) == before and not [f for f in os.listdir(folder) if f.startswith("_")]


def test_overwrite_and_nothing(spark, folder, tmp_path):
    spark.createDataFrame([(address(b"one"), b"one")], "hash string, bytes binary").write.format("addressed").mode("overwrite").save(folder)
    assert held(load(spark, folder)) == [(address(b"one"), b"one")]
    none = str(tmp_path / "none")
    spark.createDataFrame([], "hash string, bytes binary").write.format("addressed").mode("append").save(none)
    assert load(spark, none).count() == 0 and load(spark, none).where("hash = 'sha256:x'").count() == 0
