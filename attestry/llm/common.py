"""Shared pieces: durable intermediate tables, row identity, Arrow batches seen as numpy arrays."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the contracts: white space is the space and the controls from tab to carriage return.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder serves, in local mode only: on a cluster a local
    folder would be lost with its machine, so that raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="attestry-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes a thin table once and cuts its lineage.

    Spark's cleaner removes the files once nothing refers to them, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, which it is not by default.
    """
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


class _Stored(threading.local):
    """Paths of the tables that ``table`` has stored and ``release`` has not yet removed: of this thread's calls, not of others at the same time."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_stored = _Stored()


def table(df: DataFrame, name: str) -> DataFrame:
    """Computes a wider table once, as Parquet in the shared folder, and reads it again; see ``release``."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0, last: int = 0) -> int:
    """Removes the tables that this thread has stored, from the one of number ``since`` on and but for the ``last`` ones; gives how many.

    For callers whose results are written: what is not yet computed may read them still.
    """
    held = _stored.paths
    gone = held[since : len(held) - last]
    held[since : len(held) - last] = []
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def stored() -> int:
    """How many tables are stored: what ``release`` takes to leave these alone."""
    return len(_stored.paths)


def bucket_of(doc_id: Column, parts: int) -> Column:
    """The remainder of crc32 of the id as text, that decides what is held out; null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


#: A draw is a number below 2 ** DRAW_BITS, so that shares stay fine in the largest tables.
DRAW_BITS = 53


def draw(*columns: Column | str) -> Column:
    """A number below 2 ** DRAW_BITS that follows from the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *columns), 64 - DRAW_BITS)


def draws_for(wanted: int, n: int) -> int:
    """Below this number draws take about ``wanted`` of n rows, all if there are no more."""
    return min(1 << DRAW_BITS, -(-(wanted << DRAW_BITS) // max(1, n)))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two longs, k1 and k2, that name a row by its id and its text.

    Rows that share both are the same document told twice, and get the same answer; each still
    counts as an occurrence. Nulls are told apart from values.
    """
    return [F.xxhash64(doc_id.isNull(), doc_id).alias("k1"), F.xxhash64(text.isNull(), text).alias("k2")]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and each row's bounds; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts rows into consecutive runs of about ``most`` bytes; a longer row is a run of its own."""
    first = 0
    while first < len(bounds) - 1:
        last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(bounds) - 1)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers, in order; by sorting, which is several times faster here than a hash table."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Splits batches that arrive sorted by the keys into one table for each key.

    Null keys form one group. A group may span batches; only the group at hand is held.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t[k].combine_chunks()
            code = v.dictionary_encode(null_encoding="encode")
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        if held:
            last = held[-1].slice(held[-1].num_rows - 1, 1)
            new[0] = any(last[k][0].as_py() != t[k][0].as_py() for k in keys)
        cuts = np.flatnonzero(new)
        at = 0
        for c in cuts:
            if c > at:
                held.append(t.slice(at, c - at))
            if held:
                yield pa.concat_tables(held)
            held, at = [], int(c)
        held.append(t.slice(at))
    if held:
        yield pa.concat_tables(held)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Joins batches that arrive sorted by a key without nulls into tables of about ``rows`` rows that cut no group."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < rows:
            continue
        t = pa.concat_tables(held).combine_chunks()
        v = t[key].to_numpy()
        cut = int(np.searchsorted(v, v[-1])) if v[-1] >= v[0] else int(np.flatnonzero(v != v[-1])[-1]) + 1
        if cut:
            yield t.slice(0, cut)
        held = [t.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()
