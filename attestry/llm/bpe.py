"""Byte-level BPE by ranks: encoding in two tiers, and decoding.

A text is cut into pre-tokens by a pattern. First tier: a minimal perfect hash over the vocabulary names the
one entry that a pre-token can be, for all pre-tokens of a run of texts at once in numpy; the bytes are
then compared, so what the hash says is never taken on trust. Second tier: a pre-token that is no
entry is merged from its bytes, kept as a linked list beside a heap of the pairs that can be merged, lowest
rank first and leftmost among equals; each different one once, with what it gave remembered for a while.
A pre-token of n bytes takes n log n steps, so very long ones are no hazard.

Vocabulary and hash are made once by the driver, from a file that only the driver needs, and are broadcast: their size
is that of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import mix, runs, text_buffer

RANKS = "byte_bpe_50k.tiktoken"
RUN = 1 << 21  # bytes of text worked on at a time
REMEMBERED = 1 << 19  # pre-tokens beyond the vocabulary that a task remembers


def read_ranks(path: str) -> dict[bytes, int]:
    """The entries of a rank file: a base64 entry and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(entry): int(rank) for entry, rank in (line.split() for line in f if line.strip())}


def _end_to_end(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(k) for k in keys], dtype=np.int64)))
    return np.frombuffer(b"".join(keys), np.uint8), bounds


def _inside(lengths: np.ndarray) -> np.ndarray:
    """For stretches end to end, each place's distance from its stretch's start."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


@dataclass
class PerfectHash:
    """Maps n byte strings to the numbers below n, one to one, by a displacement for each bucket of hashes.

    Buckets are placed largest first: a bucket with several keys tries displacements until all its
    slots are free, a bucket with one key names its slot outright, as ``-1 - slot``, so no slot is left over.
    """

    seed: int
    moves: np.ndarray  # of each bucket
    raw: np.ndarray  # the keys' bytes, in the order of the slots
    bounds: np.ndarray
    longest: int

    @staticmethod
    def hashes(raw: np.ndarray, lengths: np.ndarray, seed: int, longest: int) -> np.ndarray:
        """A 64-bit hash of each of the stretches that lie end to end in ``raw``, none above ``longest``."""
        start = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) % (1 << 64))
        byte = mix(np.arange(1, 257, dtype=np.uint64) * start)
        place = mix(np.arange(1, longest + 2, dtype=np.uint64) + start) | np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte[raw] * place[_inside(lengths)], dtype=np.uint64)))
        ends = np.cumsum(lengths)
        return mix(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64))

    @staticmethod
    def slot(h: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
        return (mix(h + move.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) % np.uint64(n)).astype(np.int64)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        """The hash of different keys, of which there is at least one."""
        raw, bounds = _end_to_end(keys)
        lengths = np.diff(bounds)
        n, longest, seed = len(keys), int(lengths.max()), 0
        while len(np.unique(h := cls.hashes(raw, lengths, seed, longest))) < n:
            seed += 1
        buckets = n // 2 + 1
        bucket = (h >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        at = np.cumsum(sizes) - sizes
        moves, owner = np.zeros(buckets, np.int64), np.full(n, -1, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[at[b] : at[b] + sizes[b]]
            if len(mine) < 2:
                break
            move = 0
            while True:  # 64 displacements at a time
                tried = cls.slot(h[mine][None, :], np.arange(move, move + 64)[:, None], n)
                fits = (owner[tried] < 0).all(1) & (np.diff(np.sort(tried, axis=1), axis=1) > 0).all(1)
                if fits.any():
                    k = int(fits.argmax())
                    moves[b], owner[tried[k]] = move + k, mine
                    break
                move += 64
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(owner < 0)
        moves[single], owner[free] = -1 - free, order[at[single]]
        raw, bounds = _end_to_end([keys[k] for k in owner])
        return cls(seed, moves, raw, bounds, longest)

    def find(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The slot of each stretch of ``raw`` between consecutive bounds, -1 for those that are no key."""
        out = np.full(len(bounds) - 1, -1, np.int64)
        short = np.flatnonzero(np.diff(bounds) <= self.longest)
        if not len(short):
            return out
        lengths = np.diff(bounds)[short]
        inside = _inside(lengths)
        held = raw[np.repeat(bounds[short], lengths) + inside]
        h = self.hashes(held, lengths, self.seed, self.longest)
        move = self.moves[(h >> np.uint64(32)).astype(np.int64) % len(self.moves)]
        n = len(self.bounds) - 1
        slot = np.where(move < 0, -1 - move, self.slot(h, np.maximum(move, 0), n))
        same = self.bounds[slot + 1] - self.bounds[slot] == lengths
        # Bytes of stretches of the right length are compared with those of the key.
        each = np.repeat(same, lengths)
        differ = np.zeros(len(held), bool)
        differ[each] = held[each] != self.raw[(np.repeat(self.bounds[slot], lengths) + inside)[each]]
        wrong = np.concatenate((np.zeros(1, np.int64), np.cumsum(differ)))
        ends = np.cumsum(lengths)
        same &= wrong[ends] == wrong[ends - lengths]
        out[short[same]] = slot[same]
        return out


def merged(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of a pre-token: pairs of neighbours are merged, lowest rank first, leftmost among equals."""
    n, get, low = len(piece), ranks.get, (1 << 32) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n))
    best: list[int | None] = [None] * (n + 1)  # what the heap has for a part and its right neighbour, if it still holds
    heap = []
    for k in range(n - 1):
        r = get(piece[k : k + 2])
        if r is not None:
            best[k] = x = (r << 32) + k
            heap.append(x)
    heapify(heap)
    while heap:
        x = heappop(heap)
        k = x & low
        if best[k] != x:  # one of the two has been merged otherwise
            continue
        gone = after[k]
        end = after[k] = after[gone]
        before[end] = k
        best[gone] = best[k] = None
        if end < n and (stop := after[end]) - k <= longest:
            r = get(piece[k:stop])
            if r is not None:
                best[k] = x = (r << 32) + k
                heappush(heap, x)
        left = before[k]
        if left >= 0:
            r = get(piece[left:end]) if end - left <= longest else None
            best[left] = x = None if r is None else (r << 32) + left
            if r is not None:
                heappush(heap, x)
    ids, k = [], 0
    while k < n:
        ids.append(ranks[piece[k : after[k]]])
        k = after[k]
    return ids


class Encoder:
    """Encodes runs of texts; made on the driver, sent to tasks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash.build(list(ranks))
        raw, bounds = self.whole.raw.tobytes(), self.whole.bounds.tolist()
        self.id_of = np.array([ranks[raw[a:b]] for a, b in zip(bounds, bounds[1:])], np.int32)  # by slot

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("cut", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All pre-tokens of the texts, and how many each has."""
        if "cut" not in self.__dict__:
            self.cut, self.known = regex.compile(self.pattern).findall, {}
        found = [self.cut(t) for t in texts]
        counts = np.array([len(f) for f in found], np.int64)
        return pa.array([p for f in found for p in f], pa.large_string()), counts

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end and how many, for pre-tokens beyond the vocabulary."""
        told = pieces.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        held = []
        for p in told.dictionary.cast(pa.large_binary()).to_pylist():
            ids = self.known.get(p)
            if ids is None:
                ids = merged(p, self.ranks, self.whole.longest)
                if len(p) <= self.whole.longest:
                    self.known[p] = ids
            held.append(ids)
        code = told.indices.to_numpy()
        sizes = np.array([len(x) for x in held], np.int64)
        flat = np.array([i for x in held for i in x], np.int32)
        counts = sizes[code]
        return flat[np.repeat((np.cumsum(sizes) - sizes)[code], counts) + _inside(counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and the bounds of each text's."""
        pieces, counts = self._pieces(texts)
        raw, bounds = text_buffer(pieces)
        slot = self.whole.find(raw, bounds)
        sizes, miss = np.ones(len(slot), np.int64), np.flatnonzero(slot < 0)
        if len(miss):
            ids, sizes[miss] = self._merged(pieces.take(pa.array(miss)))
        out = np.empty(int(sizes.sum()), np.int32)
        at = np.cumsum(sizes) - sizes
        hit = slot >= 0
        out[at[hit]] = self.id_of[slot[hit]]
        if len(miss):
            out[np.repeat(at[miss], sizes[miss]) + _inside(sizes[miss])] = ids
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        return out, ends[np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids, an array of the text's token ids in order, one row for each input row.

    ``ranks`` is the path of a rank file, which must have an entry for every byte. Strings of special tokens are
    ordinary text. Null and empty texts have no ids; equal rows and null ids are rows like any other; an
    empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(read_ranks(ranks or public_tokenizers.path(RANKS)), pattern))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            _, at = text_buffer(batch["text"])
            for first, last in runs(at, RUN):
                texts = [t or "" for t in batch["text"].slice(first, last - first).to_pylist()]
                ids, bounds = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(told, f"doc_id {kind}, ids array<int>")


def decoder(spark: SparkSession, ranks: str | None = None) -> Callable[[Column], Column]:
    """A column function that turns arrays of ids into bytes.

    A null array gives null, an empty one no bytes. An id that is null or no entry ends the job with an error.
    """
    entries = read_ranks(ranks or public_tokenizers.path(RANKS))
    by_id: list[bytes | None] = [None] * (max(entries.values()) + 1)
    for entry, rank in entries.items():
        by_id[rank] = entry
    shared = spark.sparkContext.broadcast(by_id)  # bounded by the vocabulary
    held: dict[str, pa.Array] = {}

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        if "entries" not in held:
            held["entries"] = pa.array(shared.value, pa.large_binary())
        flat = ids.flatten()
        if flat.null_count or len(flat) and not 0 <= int(flat.to_numpy().min()) <= int(flat.to_numpy().max()) < len(held["entries"]):
            raise ValueError("an id is null or outside the vocabulary")
        told = held["entries"].take(flat)
        if told.null_count:
            raise ValueError("an id has no entry in the vocabulary")
        raw, bounds = text_buffer_of_bytes(told)
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = bounds[np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))]
        whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
        return pa.compute.if_else(ids.is_valid(), whole, pa.scalar(None, pa.binary()))

    return decode


def text_buffer_of_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary column without nulls end to end, and each row's bounds."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw[at[0] : at[-1]]), at - at[0]


def op12_bpe_codec(spark, sf_dir: str) -> DataFrame:
    told = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    decode = decoder(spark)
    return told.withColumn("decoded", decode("ids")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
