"""Manifests as a stream: the last version of each address is kept as state, and every arrival is judged.

State is one short row for each address, whatever the length of its chain. An arrival that does not
follow the state is reported; the state moves on only with arrivals that do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "manifest_hash string, version long, depth long, mode string"
REPORT = "id string, manifest_hash string, version long, accepted boolean, reason string, from_mode string, to_mode string"


def _judge(key: tuple, arrivals: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = state.get if state.exists else None
    told, out = pd.concat(list(arrivals)), []  # one address in one trigger, which may come in several parts
    for r in told.sort_values(["version", "manifest_hash"]).itertuples(index=False):
        depth = 1 if pd.isna(r.depth) else int(r.depth)
        if seen is None:
            reason = None if pd.isna(r.previous) or not r.previous else "starts in the middle"
        elif r.version <= seen[1]:
            reason = "replayed" if r.manifest_hash == seen[0] else "version"
        else:
            reason = "previous hash" if r.previous != seen[0] else "depth" if depth != seen[2] + 1 else None
        was = None if seen is None or seen[3] == r.mode else seen[3]
        out.append((key[0], r.manifest_hash, int(r.version), reason is None, reason, was, r.mode))
        if reason is None or seen is None:
            seen = (r.manifest_hash, int(r.version), depth, r.mode)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in REPORT.split(", ")])
    if seen is not None:
        state.update(seen)


def track(manifests: DataFrame) -> DataFrame:
    """A report for each arrival of a stream of id, manifest_hash, version, previous, depth and mode.

    Arrivals of one trigger are taken in order of their versions. Rows without an id or a version are
    left out.
    """
    rows = manifests.where("id is not null and version is not null").select("id", "manifest_hash", F.col("version").cast("long"), "previous", F.col("depth").cast("long"), F.coalesce("mode", F.lit("public")).alias("mode"))
    return rows.groupBy("id").applyInPandasWithState(_judge, REPORT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes", slide: str | None = None, stamp: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by window and kind of a stream of events, with a watermark for late ones."""
    opened = F.window(stamp, window, slide) if slide else F.window(stamp, window)
    told = events.withWatermark(stamp, late).groupBy(opened.alias("w"), kind).agg(F.count("*").alias("n"))
    return told.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")
