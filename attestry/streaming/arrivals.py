"""Streams that come out of order: versions that wait for the one before, manifests and content that wait for each other.

``in_order`` keeps, for each address, the last accepted version and those that arrived before their
predecessor. An arrival that waits is judged when what it waits for comes, and is an orphan once the
watermark has passed its time by ``wait``. It needs the RocksDB state store. ``with_content`` is a join of two
streams: what has found its other half, or has waited for ``within``, leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attestry.functions import hashing

HEAD = "manifest_hash string, version long, depth long, mode string"
WAITING = "version long, previous string, depth long, mode string, until long"
REPORT = "id string, manifest_hash string, version long, accepted boolean, reason string, from_mode string, to_mode string, waited boolean"
NAMES = [c.split()[0] for c in REPORT.split(", ")]


class _InOrder(StatefulProcessor):
    """The versions of one address."""

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", HEAD)
        self.waiting = handle.getMapState("waiting", "manifest_hash string", WAITING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        head = self.head.get() if self.head.exists() else None
        held = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        before, told = set(held), pd.concat(list(rows))
        out = []
        for r in told.sort_values(["version", "manifest_hash"]).itertuples(index=False):
            one = (int(r.version), None if pd.isna(r.previous) or not r.previous else r.previous, 1 if pd.isna(r.depth) else int(r.depth), r.mode)
            if r.manifest_hash in held:
                out.append((key[0], r.manifest_hash, one[0], False, "replayed", None, one[3], False))
            elif (one[1] is not None) if head is None else (one[0] > head[1] and one[1] != head[0]):
                held[r.manifest_hash] = (*one, int(r.at.timestamp() * 1000) + self.wait)
                self.handle.registerTimer(held[r.manifest_hash][4])
            else:
                head = self._judged(key[0], r.manifest_hash, one, head, False, out)
                head = self._followed(key[0], head, held, out)
        self._keep(head, held, before)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head = self.head.get() if self.head.exists() else None
        held = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        before, out = set(held), []
        due = sorted((v[0], k) for k, v in held.items() if v[4] <= expiredTimerInfo.getExpiryTimeInMs())
        for _, name in due:
            if name not in held:  # judged meanwhile, as the follower of an orphan
                continue
            version, _, depth, mode, _ = held.pop(name)
            out.append((key[0], name, version, False, "orphan", None, mode, True))
            if head is None:  # a stream that starts in the middle goes on from there
                head = self._followed(key[0], (name, version, depth, mode), held, out)
        self._keep(head, held, before)
        yield pd.DataFrame(out, columns=NAMES)

    @staticmethod
    def _judged(address: str, name: str, one: tuple, head: tuple | None, waited: bool, out: list) -> tuple | None:
        version, previous, depth, mode = one[:4]
        if head is None:
            reason = None
        elif version <= head[1]:
            reason = "replayed" if name == head[0] else "version"
        else:
            reason = "depth" if depth != head[2] + 1 else None
        out.append((address, name, version, reason is None, reason, None if head is None or head[3] == mode else head[3], mode, waited))
        return (name, version, depth, mode) if reason is None else head

    def _followed(self, address: str, head: tuple | None, held: dict, out: list) -> tuple | None:
        """Judges what waited for the head, and what waited for that; what the head has overtaken is judged too."""
        while head is not None:
            ready = sorted((v[0], k) for k, v in held.items() if v[1] == head[0] or v[0] <= head[1])
            if not ready:
                break
            one = held.pop(ready[0][1])
            head = self._judged(address, ready[0][1], one, head, True, out)
        return head

    def _keep(self, head: tuple | None, held: dict, before: set) -> None:
        if head is not None:
            self.head.update(head)
        for name in before - held.keys():
            self.waiting.removeKey((name,))
        for name in held.keys() - before:
            self.waiting.updateValue((name,), held[name])


def in_order(manifests: DataFrame, late: str = "10 minutes", wait_ms: int = 3_600_000) -> DataFrame:
    """A report for each arrival of a stream of id, manifest_hash, version, previous, depth, mode and at (timestamp).

    An arrival that names another predecessor than the last accepted version waits for ``wait_ms`` after its own time;
    ``waited`` tells the reports of these. Reasons: ``replayed``, ``version`` (not above the last one), ``depth``, ``orphan``.
    An address without a first version goes on from its first orphan. Rows without id, version, hash or time are left out,
    and so are rows later than ``late``, as the watermark has it. State: a row for each address, and one for each that waits.
    """
    rows = manifests.where("id is not null and version is not null and manifest_hash is not null and at is not null")
    rows = rows.select("id", "manifest_hash", F.col("version").cast("long").alias("version"), "previous", F.col("depth").cast("long").alias("depth"), F.coalesce("mode", F.lit("public")).alias("mode"), "at")
    return rows.withWatermark("at", late).groupBy("id").transformWithStateInPandas(statefulProcessor=_InOrder(wait_ms), outputStructType=REPORT, outputMode="Append", timeMode="EventTime")


def with_content(manifests: DataFrame, contents: DataFrame, late: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """manifest_hash, content_hash, verdict of a stream of manifests (manifest_hash, content_hash, at) and one of content (hash, bytes, at).

    ``verified`` or ``altered`` where content of that address comes within the time before or after the manifest, one row
    for each such content; ``missing`` once the watermarks say that none can come any more, content that comes later still
    included. Both sides leave the state by then. Null hashes find nothing.
    """
    m = manifests.withWatermark("at", late).alias("m")
    c = contents.select(F.col("hash").alias("found"), "bytes", F.col("at").alias("came")).withWatermark("came", late).alias("c")
    near = (F.col("came") >= F.col("at") - F.expr(f"interval {within}")) & (F.col("came") <= F.col("at") + F.expr(f"interval {within}"))
    both = m.join(c, (F.col("content_hash") == F.col("found")) & near, "left")
    sound = hashing.sha256(F.col("bytes")) == F.col("content_hash")
    return both.select("manifest_hash", "content_hash", F.when(F.col("found").isNull(), "missing").when(sound, "verified").otherwise("altered").alias("verdict"))
