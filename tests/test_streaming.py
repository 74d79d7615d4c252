"""The version tracker and windowed counts, over files that arrive one after the other."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from attestry.streaming import arrivals, tracker

SCHEMA = "id string, manifest_hash string, version long, previous string, depth long, mode string"


def test_tracker_judges_arrivals(spark, tmp_path):
    parts = [
        [("a", "h1", 1, None, 1, "proof-of-possession"), ("b", "g5", 5, "g4", 5, None)],
        [("a", "h2", 2, "h1", 2, "public"), ("a", "h1", 1, None, 1, "public"), (None, "x", 1, None, 1, None)],
        [("a", "h4", 4, "h3", 4, "public"), ("b", "g6", 6, "g5", 6, None), ("a", "h2", 2, "h1", 2, "public")],
    ]
    folder = str(tmp_path / "in")
    report = {}
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = tracker.track(spark.readStream.schema(SCHEMA).parquet(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert not query.exception()
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        report.setdefault((r.id, r.manifest_hash), []).append((r.accepted, r.reason, r.from_mode, r.to_mode))
    assert sorted((x[0], x[1]) for x in report["a", "h1"]) == [(False, "replayed"), (True, None)]
    assert (True, None, "proof-of-possession", "public") in report["a", "h2"]
    assert any(x[1] == "replayed" for x in report["a", "h2"])
    assert report["a", "h4"] == [(False, "previous hash", None, "public")]
    assert report["b", "g5"][0][1] == "starts in the middle" and report["b", "g6"][0][0]


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type")
    events.coalesce(2).write.parquet(str(tmp_path / "events"))
    stream = tracker.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), late="365 days", window="1 day")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == events.count()


# --- out of order ----------------------------------------------------------------------------------

ARRIVAL = "id string, manifest_hash string, version long, previous string, depth long, mode string, at timestamp"


def minute(n):
    return datetime(2025, 1, 1) + timedelta(minutes=n)


def triggers(spark, tmp_path, name, parts, schema, build):
    """Runs a stream over parts that arrive one after the other; what each trigger gave, and the state's rows after it."""
    folder, out, told, state = str(tmp_path / name), str(tmp_path / f"{name}-out"), [], []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        query = build(spark.readStream.schema(schema).parquet(folder)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert not query.exception()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        told.append(sorted(map(tuple, spark.read.parquet(out).collect()), key=str))
    return [[r for r in now if r not in was] for was, now in zip([[], *told], told)], state


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, held)


def test_arrivals_wait_for_what_is_before_them(spark, tmp_path, rocks):
    parts = [
        [("a", "h3", 3, "h2", 3, "public", minute(2)), ("a", "h1", 1, None, 1, None, minute(1)), ("b", "g2", 2, "g1", 2, None, minute(2)), ("c", "f5", 5, "f4", 5, None, minute(1))],
        [("a", "h5", 5, "h4", 5, "public", minute(5)), ("a", "h3", 3, "h2", 3, "public", minute(6)), ("c", "f6", 6, "f5", 6, None, minute(6))],
        [("a", "h2", 2, "h1", 2, None, minute(8)), ("b", "g1", 1, "", None, "encrypted", minute(8))],
        [("z", "z1", 1, None, 1, None, minute(300)), ("a", "h1", 1, None, 1, None, minute(299))],
        [("z", "z2", 2, "z1", 9, None, minute(301)), ("a", "h6", 6, "h3", 4, None, minute(302))],
    ]
    told, _ = triggers(spark, tmp_path, "order", parts, ARRIVAL, lambda s: arrivals.in_order(s, wait_ms=3_600_000))
    told = [[(r[0], r[1], *r[3:5], r[7]) for r in part] for part in told]
    assert told[0] == [("a", "h1", True, None, False)]
    assert told[1] == [("a", "h3", False, "replayed", False)]
    assert told[2] == [("a", "h2", True, None, False), ("a", "h3", True, None, True), ("b", "g1", True, None, False), ("b", "g2", True, None, True)]
    late = set(told[3]) | set(told[4])
    assert {("a", "h5", False, "orphan", True), ("c", "f5", False, "orphan", True), ("c", "f6", True, None, True)} <= late
    assert {("a", "h1", False, "version", False), ("z", "z1", True, None, False), ("z", "z2", False, "depth", False), ("a", "h6", True, None, False)} <= late
    assert len(late) == 7


def test_manifests_and_content_meet(spark, tmp_path):
    body = {k: f"content {k}".encode() for k in range(8)}
    address = {k: "sha256:" + hashlib.sha256(b).hexdigest() for k, b in body.items()}
    man, con = (lambda k, t: ("m", f"m{k}", address[k], None, minute(t))), (lambda k, t, b=None: ("c", None, address[k], b or body[k], minute(t)))
    parts = [
        [man(0, 0), con(0, 1), man(1, 1), con(2, 2), con(3, 3, b"altered")],
        [con(1, 30), man(2, 20), man(3, 4), man(4, 5), ("m", "none", None, None, minute(6))],
        [con(5, 400), man(5, 401)],
        [con(4, 40), man(6, 30), con(7, 402), man(7, 403)],  # both come too late for each other, or for the watermark
        [con(0, 900), man(0, 901)],
        [man(1, 902), con(1, 903)],
    ]
    schema = "side string, manifest_hash string, hash string, bytes binary, at timestamp"

    def build(stream):
        m = stream.where("side = 'm'").select("manifest_hash", F.col("hash").alias("content_hash"), "at")
        return arrivals.with_content(m, stream.where("side = 'c'").select("hash", "bytes", "at"))

    told, state = triggers(spark, tmp_path, "content", parts, schema, build)
    all_ = [(r[0], r[2]) for part in told for r in part]
    assert {x for x in all_ if x[0] in ("m0", "m1", "m2", "m3", "m5", "m7")} >= {("m0", "verified"), ("m1", "verified"), ("m2", "verified"), ("m3", "altered"), ("m5", "verified"), ("m7", "verified")}
    assert ("m4", "missing") in all_ and ("none", "missing") in all_ and ("m4", "verified") not in all_
    assert max(state) <= 12 and state[-1] <= 6  # what is past does not stay
