"""Finding repeated windows of a fixed length by anchors that their content chooses.

Rows are sequences of symbols, bytes or words. Every window of ``window`` symbols has an anchor: the
least hash among its grams of ``gram`` symbols, the first one in a tie. Equal windows have equal anchors at
equal places, so windows only need comparing where their anchors are equal. The windows that share
an anchor are consecutive; with the symbols that they span they make up the anchor's context. About
one symbol in half a window starts an anchor, so there are far fewer contexts than windows, and each
is named by two hashes of 64 bits, of its gram and of its whole content.

Grams only choose anchors, so sums of mixed pairs of byte and place, rolled along, do for them: texts made to
collide there share anchors and cost time, no more. Names are taken as equal content. They are BLAKE2b of
the bytes themselves (words: of the words joined by single spaces) under a key that each run draws anew, so whoever
wrote the texts, two different contexts share a name with a probability of 2 ** -64, and only where their anchors are equal as well.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import sketch
from attestry.llm.common import mix, row_key, runs, text_buffer

BASE = 0x2545F4914F6CDD1D
PIECE = 1 << 20  # symbols worked on at a time
RUN = 1 << 20  # bytes read at a time
PLACE = 21  # bits of a place inside a piece


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    n = PIECE + 1
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Rolling:
    """Prefix sums from which the hash of any stretch follows, the same wherever it stands."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = _powers()
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (self.sums[last] - self.sums[first]) * self.down[first]


def keyed_names(key: bytes) -> Callable[[list[tuple[memoryview, int]]], np.ndarray]:
    """A function that names pairs of bytes and a number by 64 bits."""
    start = blake2b(digest_size=8, key=key)

    def one(data: memoryview, place: int) -> bytes:
        h = start.copy()
        h.update(place.to_bytes(8, "little"))
        h.update(data)
        return h.digest()

    return lambda parts: np.frombuffer(b"".join(one(*p) for p in parts), "<u8")


@dataclass
class Contexts:
    """Contexts of many rows; places count symbols from the start of all rows at hand."""

    row: np.ndarray
    first: np.ndarray  # first window's start
    last: np.ndarray  # last window's start
    place: np.ndarray  # anchor's start
    anchor: np.ndarray  # hash of the gram
    symbols: Symbols
    window: int

    def content(self, pick: np.ndarray) -> np.ndarray:
        """The names of some contexts, each with its anchor's place in it."""
        held, begin, end = self.symbols.held, self.symbols.begin, self.symbols.end
        first, last = begin(self.first[pick]).tolist(), end(self.last[pick] + self.window - 1).tolist()
        return self.symbols.names([(held[a:b], k) for a, b, k in zip(first, last, (self.place - self.first)[pick].tolist())])

    def windows(self, k: int) -> np.ndarray:
        """The name of each window of context k."""
        at = np.arange(self.first[k], self.last[k] + 1)
        first, last = self.symbols.begin(at).tolist(), self.symbols.end(at + self.window - 1).tolist()
        return self.symbols.names([(self.symbols.held[a:b], 0) for a, b in zip(first, last)])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive keys."""
    n = len(keys)
    padded = np.concatenate((keys, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


@dataclass
class Symbols:
    """Rows of texts as symbols."""

    raw: np.ndarray
    bounds: np.ndarray  # of rows, in symbols
    values: Callable[[int, int], np.ndarray]  # symbols a to b as hashes
    held: memoryview  # the bytes that names are taken from
    begin: Callable[[np.ndarray], np.ndarray]  # where symbols start in ``held``
    end: Callable[[np.ndarray], np.ndarray]  # and where they end
    names: Callable[[list[tuple[memoryview, int]]], np.ndarray]


def contexts(s: Symbols, window: int, gram: int) -> Iterator[Contexts]:
    """The contexts of rows of symbols.

    Long rows are worked on in pieces that overlap by a window less one symbol, so that every window
    is whole in exactly one of them.
    """
    n, bounds = int(s.bounds[-1]), s.bounds
    for a in range(0, max(1, n - window + 1), PIECE - window + 1):
        b = min(n, a + PIECE)
        if b - a < window:
            return
        rolling = Rolling(s.values(a, b))
        starts = np.arange(b - a - gram + 1)
        grams = mix(rolling.of(starts, starts + gram))
        keys = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | starts.astype(np.uint64)
        place = (_least(keys, window - gram + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        begin = np.arange(a, b - window + 1)
        row = np.searchsorted(bounds, begin, side="right") - 1
        whole = begin + window <= bounds[row + 1]
        begin, place, row = begin[whole], place[whole], row[whole]
        if not len(begin):
            continue
        new = np.ones(len(begin), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(begin)) - 1
        first, last, spot = begin[at], begin[end], place[at]
        yield Contexts(row[at], first, last, spot + a, grams[spot], s, window)


@lru_cache(maxsize=1)
def _bytes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def under_key(symbols: Callable) -> Callable:
    """``as_bytes`` or ``as_words`` with names of this run."""
    return partial(symbols, secrets.token_bytes(32))


def as_bytes(key: bytes, raw: np.ndarray, at: np.ndarray) -> Symbols:
    return Symbols(raw, at, lambda a, b: _bytes()[raw[a:b]], memoryview(np.ascontiguousarray(raw)), lambda k: k, lambda k: k + 1, keyed_names(key))


def _placed(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of bytes at their places inside a word."""
    return mix((place.astype(np.uint64) << np.uint64(8)) + raw + np.uint64(0x9E3779B97F4A7C15))


def as_words(key: bytes, raw: np.ndarray, at: np.ndarray) -> Symbols:
    """Words as symbols: sums of the hashes of bytes at their places for grams, the words themselves for names."""
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[at] = True
    before = np.ones(len(raw), bool)
    before[1:] = white[:-1]
    starts = np.flatnonzero(~white & (before | fresh[:-1]))
    after = np.ones(len(raw), bool)
    after[:-1] = white[1:]
    ends = np.flatnonzero(~white & (after | fresh[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # by pieces of bytes that end with a word
        j = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, side="right")))
        a, b = int(starts[k]), int(ends[j - 1])
        if b - a > PIECE:  # one word longer than a piece: pieces of it in turn
            parts = [_placed(raw[c : min(b, c + PIECE)], np.arange(c - a, min(b, c + PIECE) - a)).sum(dtype=np.uint64) for c in range(a, b, PIECE)]
            told = np.array([np.array(parts).sum(dtype=np.uint64)])
        else:
            begin = np.zeros(b - a, np.int64)
            begin[starts[k:j] - a] = starts[k:j] - a
            place = np.arange(b - a) - np.maximum.accumulate(begin)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_placed(raw[a:b], place), dtype=np.uint64)))
            told = sums[ends[k:j] - a] - sums[starts[k:j] - a]
        hashes[k:j] = mix(told + (ends[k:j] - starts[k:j]).astype(np.uint64))
        k = j
    keep = ~white
    keep[1:] |= ~white[:-1]  # a word and one place behind it
    spaced = np.where(white, np.uint8(32), raw)[keep]
    shift = np.cumsum(keep) - 1
    first, last = shift[starts], shift[ends - 1] + 1
    return Symbols(raw, np.searchsorted(starts, at), lambda a, b: hashes[a:b], memoryview(spaced), lambda k: first[k], lambda k: last[k], keyed_names(key))


def of_batch(column: pa.Array, symbols: Callable, window: int, gram: int) -> Iterator[tuple[int, Symbols, Contexts]]:
    """The contexts of a column of texts, with the row that the places of each yield start from."""
    raw, at = text_buffer(column)
    for first, last in runs(at, RUN):
        s = symbols(raw[at[first] : at[last]], at[first : last + 1] - at[first])
        for c in contexts(s, window, gram):
            yield first, s, c


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the two longs that name the row."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", "text")


def occurrences(docs: DataFrame, symbols: Callable, window: int, gram: int, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """k1, k2, anchor, content, start, windows: each context of each row of ``keyed`` documents.

    ``wanted`` picks among the anchors.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, s, c in of_batch(batch["text"], symbols, window, gram):
                pick = np.flatnonzero(wanted(c.anchor)) if wanted else np.arange(len(c.anchor))
                row = c.row[pick]
                take = pa.array(row + base)
                yield pa.RecordBatch.from_arrays(
                    [batch["k1"].take(take), batch["k2"].take(take), pa.array(c.anchor[pick].view(np.int64)), pa.array(c.content(pick).view(np.int64)), pa.array(c.first[pick] - s.bounds[row]), pa.array((c.last - c.first)[pick] + 1)],
                    ["k1", "k2", "anchor", "content", "start", "windows"],
                )

    return docs.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, anchor long, content long, start long, windows long")


#: Anchors that a broadcast sketch picks at most, some 128 MB of it; more of them are joined instead.
BROADCAST = 1 << 27


def picked(docs: DataFrame, thin: DataFrame, anchors: DataFrame, symbols: Callable, window: int, gram: int, tell: Callable[[Symbols, Contexts, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, bits: int | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """What ``tell`` makes of the contexts of the given ``anchors`` (columns anchor, mark), by runs of texts.

    ``thin`` has the ``occurrences`` of the documents. ``tell`` gets symbols, contexts, the places of those
    that are picked and their anchors' marks (booleans, of which a sketch gives a few too many). Up to ``broadcast`` anchors travel as sketches, of which a
    few others pass; more are joined to the occurrences and so to their texts, and none others pass.
    """
    spark, n = docs.sparkSession, anchors.count()
    if n <= broadcast:
        all_ = spark.sparkContext.broadcast(sketch.of_longs(anchors, "anchor", bits or sketch.bits_for(n)))
        crowd = anchors.where("mark")
        marked = spark.sparkContext.broadcast(sketch.of_longs(crowd, "anchor", bits or sketch.bits_for(crowd.count())))

        def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, s, c in of_batch(batch["text"], symbols, window, gram):
                    pick = np.flatnonzero(all_.value.passes(c.anchor))
                    if len(pick):
                        yield tell(s, c, pick, marked.value.passes(c.anchor[pick]))

        return docs.select("text").mapInArrow(by_sketch, schema)
    wanted = thin.join(anchors.hint("rebalance"), "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "mark")).alias("wanted"))

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names = {x["anchor"]: x["mark"] for x in batch["wanted"][k].as_py()}
                for _, s, c in of_batch(batch["text"].slice(k, 1), symbols, window, gram):
                    mine = c.anchor.view(np.int64).tolist()
                    pick = np.array([i for i, x in enumerate(mine) if x in names], np.int64)
                    if len(pick):
                        yield tell(s, c, pick, np.array([names[mine[i]] for i in pick], bool))

    return docs.join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(by_row, schema)


def repeated_windows(docs: DataFrame, thin: DataFrame, anchors: DataFrame, symbols: Callable, window: int, gram: int, keep: Callable[[DataFrame], DataFrame], broadcast: int = BROADCAST) -> DataFrame:
    """anchor, content, ranges: of the contexts of the given anchors, the windows that another one has.

    Every different window is grouped exactly, by its anchor's hash and its own; counts are combined
    before the shuffle, so a window that very many rows hold is no large group. ``keep`` stores the
    packed windows, which are read twice.
    """

    def pack(_: Symbols, c: Contexts, pick: np.ndarray, mark: np.ndarray) -> pa.RecordBatch:
        names = np.column_stack((c.anchor[pick], c.content(pick)))
        names, once = np.unique(names, axis=0, return_index=True)
        held = [c.windows(k).tobytes() for k in pick[once]]
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in names.T), pa.array(held, pa.binary())], ["anchor", "content", "held"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                held = part["held"].to_pylist()
                n = np.array([len(h) // 8 for h in held], np.int64)
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([part["anchor"].take(take), pa.array(np.frombuffer(b"".join(held), np.int64)), part["content"].take(take), pa.array(place, pa.int32())], ["anchor", "w", "content", "place"])

    packed = keep(picked(docs, thin, anchors.withColumn("mark", F.lit(False)), symbols, window, gram, pack, "anchor long, content long, held binary", broadcast=broadcast))
    each = packed.mapInArrow(spread, "anchor long, w long, content long, place int")
    twice = each.groupBy("anchor", "w").count().where("count > 1").select("anchor", "w")
    found = each.join(twice, ["anchor", "w"]).groupBy("anchor", "content").agg(F.collect_set("place").alias("places"))
    joined = """aggregate(array_sort(places), cast(array() as array<struct<low:bigint,high:bigint>>), (told, p) ->
      CASE WHEN size(told) > 0 AND element_at(told, -1).high = p - 1 THEN concat(slice(told, 1, size(told) - 1), array(struct(element_at(told, -1).low as low, cast(p as long) as high)))
      ELSE concat(told, array(struct(cast(p as long) as low, cast(p as long) as high))) END)"""
    return found.select("anchor", "content", F.expr(joined).alias("ranges"))


def spans_of(thin: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """k1, k2, spans: the stretches of each row that its contexts' repeated windows cover.

    ``found`` has anchor, content and ranges (low, high) of windows in the context. A context that very
    many rows share makes one key of the join hot; ``found`` is laid out anew before it, so that both
    sides are shuffles of the join's own and adaptive execution can split the hot one.
    """
    each = thin.join(found.hint("rebalance"), ["anchor", "content"]).select("k1", "k2", F.explode(F.expr(f"transform(ranges, r -> struct(start + r.low as a, start + least(r.high, windows - 1) + {window} as b))")).alias("span"))
    return each.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def covered(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The union of stretches, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
