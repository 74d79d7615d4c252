"""Count-min sketches over 64-bit hashes, built by partition, merged by segment, tested from a bitmap.

A sketch has ``depth`` rows of ``2 ** bits`` cells. Each task counts into the cells that it touches and
sends them as sparse pieces, one for each segment of 2 ** 16 cells; pieces of a segment are added up
in one place. What is kept is a bit for each cell, whether its count reaches ``least``. Since a cell's
count is never below that of any hash in it, a hash that occurs ``least`` times always passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import mix, sorted_groups

SEGMENT = 16
FLUSH = 1 << 21


class Sketch:
    """The merged sketch as bits: depth * 2**bits / 8 bytes, whatever the size of the input."""

    def __init__(self, bits: int, depth: int) -> None:
        self.bits, self.depth = bits, depth
        self.held = np.zeros((depth, 1 << (bits - 3)), np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash whether all its cells reached the count."""
        out = np.ones(len(hashes), bool)
        for row in range(self.depth):
            cell = cells(hashes, row, self.bits)
            out &= (self.held[row, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return out


def bits_for(n: int, least: int = 20, most: int = 29) -> int:
    """The width for n different hashes: about eight cells for each, within a size that can be broadcast.

    Beyond that size more hashes pass; none is lost.
    """
    return min(most, max(least, int(8 * n).bit_length()))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def build(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], least: int, bits: int = 26, depth: int = 2) -> Sketch:
    """The sketch of all hashes that ``hashes`` draws from the batches of ``df``; counts stop at ``least``."""
    return build_each(df, hashes, (least,), bits, depth)[0]


def build_each(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], leasts: tuple[int, ...], bits: int = 26, depth: int = 2) -> list[Sketch]:
    """Sketches of the same counts for several least counts; a count stops at the greatest."""
    kind = "u1" if max(leasts) < 256 else "<u2"
    assert max(leasts) < 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for row in range(depth):
                cell, n = np.unique(cells(np.concatenate(held), row, bits), return_counts=True)
                cuts = np.flatnonzero(np.diff(cell >> SEGMENT, prepend=-1))
                offset, n = (cell & ((1 << SEGMENT) - 1)).astype("<u2"), np.minimum(n, max(leasts)).astype(kind)
                ends = np.append(cuts[1:], len(cell))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((cell[cuts] >> SEGMENT) + (row << (bits - SEGMENT)), pa.int32()), pa.array([offset[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary())],
                    ["segment", "offsets", "counts"],
                )
            held.clear()

        for batch in batches:
            for h in hashes(batch):
                if len(h):
                    held.append(h)
                if sum(map(len, held)) > FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["segment"]):
            total = np.zeros(1 << SEGMENT, np.int64)
            for offsets, counts in zip(group["offsets"].to_pylist(), group["counts"].to_pylist()):
                total[np.frombuffer(offsets, "<u2")] += np.frombuffer(counts, kind)
            for k, least in enumerate(leasts):
                reached = np.packbits(total >= least, bitorder="little")
                if reached.any():
                    yield pa.RecordBatch.from_arrays([group["segment"].combine_chunks()[:1], pa.array([k], pa.int32()), pa.array([reached.tobytes()], pa.binary())], ["segment", "k", "bits"])

    pieces = df.mapInArrow(count, "segment int, offsets binary, counts binary")
    merged = pieces.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, k int, bits binary")
    out = [Sketch(bits, depth) for _ in leasts]
    for segment, k, held in merged.collect():  # at most depth * 2**(bits - 16) rows of 8 kB for each least count
        out[k].held.reshape(-1, 1 << (SEGMENT - 3))[segment] = np.frombuffer(held, np.uint8)
    return out


def of_longs(df: DataFrame, column: str, bits: int = 26) -> Sketch:
    """The set of a column's longs, as a sketch that every member passes."""
    return build(df.select(F.col(column).alias("h")), lambda b: iter([b["h"].to_numpy(zero_copy_only=False).view(np.uint64)]), 1, bits)
