"""Packing documents into windows of tokens by non-negative least squares.

Each document is tokenised once and cut every ``window`` ids; what is left of it is a tail. All that
packing needs to know of the corpus is the histogram of piece lengths, at most ``window`` numbers.
From it the driver enumerates shallow combinations of lengths that fill a window exactly, solves for
how often to repeat each by non-negative least squares, rounds these counts, and packs the residual
histogram greedily, a whole class of equal windows at a time. The outcome is a table of slots: which
ranks among the pieces of one length go to which windows. Ranks are computed by Spark, by ranges of a
hash of the piece, so that a length that very many pieces share is many ranges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import checkpoint
from attestry.llm.tokens import Encoder

WINDOW, END = 2048, 1  # fixed values of the contract
TOKENIZER = "byte_bpe_50k.json"


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int = WINDOW, end: int = END, added: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; null text is empty, one end id."""
    with open(tokenizer, encoding="utf-8") as f:  # read by the driver, so executors need no file
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, added)
        for batch in batches:
            row, start, length, crc, whole = [], [], [], [], []
            for k, text in enumerate(batch["text"]):
                ids = np.array([*encoder.ids(text.as_py() or ""), end], "<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    row.append(k), start.append(at), length.append(len(piece)), crc.append(zlib.crc32(piece.tobytes())), whole.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations_of(counts: np.ndarray, window: int, most: int = 6_000) -> list[tuple[int, ...]]:
    """Combinations of one to three lengths that fill the window, the best supplied ones first."""
    present = np.flatnonzero(counts)
    found = [(window,)] if counts[window] else []
    found += [(int(a), window - int(a)) for a in present if 2 * a >= window and a < window and counts[window - a]]
    triples = []
    for a in present[(present * 3 >= window) & (present < window)]:
        b = np.arange(max(1, (window - a + 1) // 2), min(a, window - a - 1) + 1)
        c = window - a - b
        supply = np.minimum(np.minimum(counts[a], counts[b]), counts[c])
        triples += [(int(s), int(a), int(x), int(y)) for s, x, y in zip(supply, b, c) if s]
    triples.sort(reverse=True)
    return found + [t[1:] for t in triples[:most]]


def nnls(columns: list[tuple[int, ...]], goal: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares by coordinate descent; a column counts the lengths it lists."""
    x, rest = np.zeros(len(columns)), goal.astype(float)
    for _ in range(sweeps):
        most = 0.0
        for k, lengths in enumerate(columns):
            square = sum(lengths.count(v) for v in lengths)  # of the column's counts
            step = max(-x[k], sum(rest[v] for v in lengths) / square)
            if step:
                x[k] += step
                for v in lengths:
                    rest[v] -= step
                most = max(most, abs(step))
        if most < 0.25:
            break
    return x


def slots(counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, ranks, first sequence, offset, per sequence) that place all pieces.

    ``counts[v]`` is the number of pieces of length v, 1 to ``window``.
    """
    left, used, rows, sequence = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), [], 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for v in sorted(set(lengths), reverse=True):
            per = lengths.count(v)
            rows.append((v, used[v], times * per, sequence, offset, per))
            used[v], left[v] = used[v] + times * per, left[v] - times * per
            offset += v * per
        sequence += times

    columns = combinations_of(left, window)
    wished = nnls(columns, left)
    for k in np.argsort(-wished, kind="stable"):
        lengths = columns[k]
        times = min(int(round(wished[k])), *(int(left[v]) // lengths.count(v) for v in lengths))
        if times > 0:
            place(list(lengths), times)
    while left.any():  # the residual: longest first, then the longest that fits, and all windows like it
        lengths, space, free = [], window, left.copy()
        v = int(np.flatnonzero(free)[-1])
        while v:
            take = min(int(free[v]), space // v)
            lengths += [v] * take
            free[v] -= take
            space -= v * take
            fits = np.flatnonzero(free[: space + 1])
            v = int(fits[-1]) if len(fits) else 0
        place(lengths, min(int(left[v]) // lengths.count(v) for v in set(lengths)))
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, rows_per_range: int = 4_096, added: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one end id. Texts of any length are cut into as many pieces as they
    need. Strings of added tokens are ordinary text, or with ``added`` those tokens, as ``tokenizers``
    has it by default. Rows with null or equal ids are packed as documents of their own. An empty table gives an
    empty result. Other columns are not read.
    """
    told = checkpoint(pieces(docs, id_col, text_col, tokenizer or str(public_tokenizers.path(TOKENIZER)), window, added=added).withColumn("key", F.xxhash64("doc_id", "start", "ids_crc32")))
    counts = np.zeros(window + 1, np.int64)
    for length, n in told.groupBy("length").count().collect():  # at most ``window`` rows
        counts[length] = n
    table = slots(counts, window)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    bits = max(0, int(counts.sum() / rows_per_range).bit_length())
    ranged = told.withColumn("range", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = ranged.groupBy("length", "range").count()
    sums = sums.withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("range")) - F.col("count")).drop("count")
    ranked = ranged.join(sums, ["length", "range"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "range").orderBy("key", "doc_id", "start")) - 1)
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the window, not by the corpus

    @F.arrow_udf("sequence_id long, offset long")
    def seat(length: pa.Array, rank: pa.Array) -> pa.Array:
        t, v, r = shared.value, length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        if not len(v):
            return pa.StructArray.from_arrays([pa.array([], pa.int64())] * 2, ["sequence_id", "offset"])
        top = int(counts.max()) + 1
        at = np.searchsorted(t[:, 0] * top + t[:, 1], v * top + r, side="right") - 1
        inside = r - t[at, 1]
        return pa.StructArray.from_arrays([pa.array(t[at, 3] + inside // t[at, 5]), pa.array(t[at, 4] + inside % t[at, 5] * v)], ["sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", seat("length", "rank").alias("seat")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "seat.*")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), added=True)
