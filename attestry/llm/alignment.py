"""Aligning the tokens of two tokenizers, and how often their tokens meet in the whole corpus.

Both tokenizers cut the same bytes. A piece of a run of texts is laid end to end, the ends of all tokens of either
side are counted once over its bytes, and a group ends wherever both counts do. Prefix sums of the counts
give, for every byte, the token of either side and the group; read at the bounds of the texts they give each text's own
numbers. Two tokens are linked where their bytes overlap, and each stretch between consecutive ends of either side
is one link.

Corpus-wide counts need a second look at every text. So that texts are tokenised once, and no table of texts and links
is shuffled, each run of texts keeps a list of its own different pairs, and each text the places of its links in that
list, all stored as one table. Pairs are counted over the lists, and each run's pairs, not
its links, fetch the totals. The two sides meet by run: about ``RUN`` bytes of text, whatever the
corpus, or a single longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.bpe import text_buffer_of_bytes
from attestry.llm.common import checkpoint, runs, table, text_buffer
from attestry.llm.tokens import Encoder

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
RUN = 1 << 22  # bytes of text that share a list of pairs
PIECE = 1 << 18  # bytes of a run that are aligned at once: their ids are Python objects, and their bytes have several numbers each


class Sides:
    """The two tokenizers, their tokens' bytes and their ids as text, made once in each Python worker."""

    def __init__(self, spec: str, model: bytes) -> None:
        self.a = Encoder(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = pa.array(self.a.entries(), pa.large_binary())
        self.bytes_b = pa.array([self._bytes(self.b.id_to_piece(k)) for k in range(self.b.vocab_size())], pa.large_binary())
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.told = pa.array([f"{k}{mark}".encode() for k in range(n) for mark in (",", "|", ";", "")], pa.large_binary())

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("\u2581", " ").encode()


@lru_cache(maxsize=1)
def _sides(spec: str, model: bytes) -> Sides:
    return Sides(spec, model)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(x) for x in ids], dtype=np.int64)))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(bounds[-1])), bounds


class Aligned:
    """A run of texts, without nulls, aligned. Texts that either side does not give back byte for byte have no tokens."""

    def __init__(self, texts: list[str], sides: Sides) -> None:
        self.sides = sides
        raw, at = text_buffer(pa.array([" " + t if t else "" for t in texts], pa.large_string()))
        a, b = (_flat(ids) for ids in ([sides.a.ids(" " + t) if t else [] for t in texts], sides.b.encode(texts, num_threads=1)))
        whole = self._same(raw, at, *a, sides.bytes_a) & self._same(raw, at, *b, sides.bytes_b)
        if not whole.all():
            texts = [t if w else "" for t, w in zip(texts, whole)]
            keep = np.repeat(whole, np.diff(at))
            raw, at = raw[keep], np.concatenate((np.zeros(1, np.int64), np.cumsum(np.where(whole, np.diff(at), 0))))
            a, b = (self._kept(*x, whole) for x in (a, b))
        (self.a, self.of_a), (self.b, self.of_b) = a, b
        ends_a, ends_b = (np.cumsum(self._lengths(v)[ids]) - 1 for v, ids in ((sides.bytes_a, self.a), (sides.bytes_b, self.b)))
        n = len(raw)
        end_a, end_b = np.bincount(ends_a, minlength=n).astype(bool), np.bincount(ends_b, minlength=n).astype(bool)
        cut = end_a & end_b
        place = np.flatnonzero(end_a | end_b)  # the last byte of each link
        before_a, before_b = (np.cumsum(x[place], dtype=np.int64) - x[place] for x in (end_a, end_b))  # tokens before the link's
        self.link_a, self.link_b = self.a[before_a], self.b[before_b]
        self.cuts = np.flatnonzero(cut)
        self.of_group = np.searchsorted(self.cuts, at)  # groups before each text
        self.of_link = np.searchsorted(place, at)
        self.ends_a, self.ends_b = ends_a, ends_b

    @staticmethod
    def _lengths(entries: pa.Array) -> np.ndarray:
        return np.diff(np.frombuffer(entries.buffers()[1], np.int64, len(entries) + 1, entries.offset * 8))

    @staticmethod
    def _same(raw: np.ndarray, at: np.ndarray, ids: np.ndarray, bounds: np.ndarray, entries: pa.Array) -> np.ndarray:
        """For each text whether its tokens' bytes, joined, are its own."""
        told, ends = text_buffer_of_bytes(entries.take(pa.array(ids)))
        first, last = ends[bounds[:-1]], ends[bounds[1:]]
        if len(told) == len(raw) and (first == at[:-1]).all():
            wrong = np.concatenate((np.zeros(1, np.int64), np.cumsum(told != raw)))
            return wrong[at[1:]] == wrong[at[:-1]]
        return np.array([y - x == q - p and np.array_equal(told[x:y], raw[p:q]) for x, y, p, q in zip(first, last, at[:-1], at[1:])], bool)

    @staticmethod
    def _kept(ids: np.ndarray, bounds: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.diff(bounds)
        return ids[np.repeat(whole, counts)], np.concatenate((np.zeros(1, np.int64), np.cumsum(np.where(whole, counts, 0))))

    def groups(self) -> tuple[memoryview, np.ndarray]:
        """The groups of all texts as ``a1,a2|b1;a3|b2,b3``, end to end, and each text's bounds."""
        group_a, group_b = np.searchsorted(self.cuts, self.ends_a), np.searchsorted(self.cuts, self.ends_b)
        count_a, count_b = np.bincount(group_a, minlength=len(self.cuts)), np.bincount(group_b, minlength=len(self.cuts))
        seat_a = np.arange(len(self.a)) + (np.cumsum(count_b) - count_b)[group_a]
        seat_b = np.arange(len(self.b)) + np.cumsum(count_a)[group_b]
        ids, mark = np.empty(len(self.a) + len(self.b), np.int64), np.zeros(len(self.a) + len(self.b), np.int64)
        ids[seat_a], ids[seat_b] = self.a, self.b
        last = np.cumsum(count_a + count_b) - 1  # of each group
        mark[last - count_b] = 1
        mark[last] = 2
        ends = self.of_a + self.of_b
        mark[ends[1:][np.diff(ends) > 0] - 1] = 3
        told, bounds = text_buffer_of_bytes(self.sides.told.take(pa.array(ids * 4 + mark)))
        return memoryview(told), bounds[ends]


def _pieces(texts: pa.Array, at: np.ndarray, sides: Sides, digest: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A run of texts, aligned piece by piece: the numbers of a tokens, b tokens, groups and links of each text, all its links, and the groups."""
    counts, links, told = [], [], []
    for first, last in runs(at, PIECE):
        x = Aligned([t or "" for t in texts.slice(first, last - first).to_pylist()], sides)
        counts.append([np.diff(v) for v in (x.of_a, x.of_b, x.of_group, x.of_link)])
        links.append(x.link_a << 32 | x.link_b)
        held, ends = x.groups()
        each = (bytes(held[p:q]) for p, q in zip(ends.tolist(), ends[1:].tolist()))
        told += [hashlib.sha256(t).hexdigest() if t else "" for t in each] if digest else [t.decode() for t in each]
    return np.concatenate(counts, axis=1), np.concatenate(links), told


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str | None = None, piece_bpe: str | None = None, digest: bool = False, run: int = RUN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links and groups of each row, and what ``statistics`` needs besides.

    A is a byte-level vocabulary in the ``tokenizers`` format, applied to a space and the text; B a piece model that adds the space itself.
    ``groups`` is a text, as ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the SHA-256 of it in hexadecimal, and empty
    where there are no tokens. Null and empty texts, and texts that one of the two does not give back byte for byte, have no
    tokens. Rows with equal or null ids are rows like any other. An empty table gives an empty result. Other columns are not read.
    """
    with open(byte_bpe or public_tokenizers.path(BYTE_BPE), encoding="utf-8") as f, open(piece_bpe or public_tokenizers.path(PIECE_BPE), "rb") as g:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # bounded by the vocabularies
    base = 1 << 20

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, part, k = _sides(*shared.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            _, at = text_buffer(batch["text"])
            for first, last in runs(at, run):
                n = last - first
                counts, links, texts = _pieces(batch["text"].slice(first, n), at[first : last + 1], sides, digest)
                pairs, code = np.unique(links, return_inverse=True)
                cell = np.repeat(np.arange(n), counts[3]) * max(1, len(pairs)) + code
                total = np.bincount(code, minlength=len(pairs))
                del links, code
                cell, times = np.unique(cell, return_counts=True)
                row, cell = np.divmod(cell, max(1, len(pairs)))
                bounds = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                own = pa.array([0] + [len(pairs)] * n, pa.int32())  # the list lies with the run's first row
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(first, n), *(pa.array(v, pa.int64()) for v in counts), pa.array(texts, pa.string()),
                     pa.array(np.full(n, part * base + k)), pa.ListArray.from_arrays(bounds, pa.array(cell, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32())),
                     pa.ListArray.from_arrays(own, pa.array(pairs)), pa.ListArray.from_arrays(own, pa.array(total, pa.int64()))],
                    NAMES,
                )
                k += 1

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, run long, cells array<int>, times array<int>, pairs array<long>, totals array<long>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(told, schema)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "run", "cells", "times", "pairs", "totals"]


def pair_counts(stored: DataFrame) -> DataFrame:
    """a, b, count and best of each pair of ids that are linked anywhere; best: no A id is linked with b more often."""
    lists = stored.where(F.size("pairs") > 0).select(F.explode(F.arrays_zip("pairs", "totals")).alias("x"))
    counts = lists.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.totals").alias("count"))
    counts = counts.select(F.shiftrightunsigned("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "count")
    most = F.max("count").over(Window.partitionBy("b"))  # at most one row for each entry of A
    return counts.withColumn("best", F.col("count") == most)


def statistics(aligned: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each row of ``align``.

    n_best: links whose count in all rows is the highest of their B id, ties included; count_sum: the
    sum of the counts of all links. The aligned rows are stored, since they are read three times.
    """
    stored = table(aligned, "alignment")
    counts = checkpoint(pair_counts(stored).select(F.shiftleft("a", 32).bitwiseOR(F.col("b")).alias("pair"), "count", "best"))
    lists = stored.where(F.size("pairs") > 0).select(F.col("run").alias("list"), F.posexplode("pairs").alias("cell", "pair"))
    known = lists.join(counts.hint("rebalance"), "pair").select("list", "cell", "count", "best")
    rows = stored.drop("pairs", "totals")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        cell = right["cell"].to_numpy()
        count[cell], best[cell] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        cells, times = (left[c].combine_chunks() for c in ("cells", "times"))
        sizes = cells.value_lengths().to_numpy()
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
        cell, times = cells.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate((np.zeros(1, np.int64), np.cumsum(v[cell] * times)))[ends] for v in (best, count)]
        return pa.table([left[c] for c in NAMES[:5]] + [pa.array(np.diff(s)) for s in sums] + [left["groups"]], [*NAMES[:5], "n_best", "count_sum", "groups"])

    return rows.groupBy("run").cogroup(known.groupBy("list")).applyInArrow(finish, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    return statistics(align(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)).withColumnRenamed("groups", "groups_sha256")
