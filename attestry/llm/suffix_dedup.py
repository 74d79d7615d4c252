"""Suffix-array dedup of byte strings, by the common-prefix interval trees of their anchors.

Windows of ``length`` bytes are found through anchors (see ``anchors``), which partition a suffix array
of the whole corpus into small ones: the contexts of one anchor. All contexts of an anchor that occurs
twice or more meet in one group, copies included, and the group's interval tree lists the maximal
repeats with all occurrences (``suffix_repeats``). Copies are merged before the tree, after a comparison
of their bytes; a context with copies stands in the arrays twice, which is all that its number matters.

An anchor with more than ``most`` different contexts would be a large group. It is split by a longer
prefix: a repeat of ``length`` bytes around bytes that a group shares already has half of what is
missing on the left or on the right, so each context goes to the groups of those that share so much
more on either side, and only groups with another member go on. What is missing halves with each
round, to nothing: then the group is one interval, whatever its size.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.anchors import BROADCAST, Contexts, Symbols, as_bytes, covered, keyed, keyed_names, occurrences, picked, spans_of, under_key
from attestry.llm.common import checkpoint, sorted_groups, table
from attestry.llm.suffix_repeats import maximal_repeats

LENGTH = 400  # fixed value of the contract
GRAM = 64
MOST = 16_384


def window_ranges(lefts: list[bytes], rights: list[bytes], length: int) -> dict[int, list[dict]]:
    """For each context the disjoint ranges of its windows that lie in a maximal repeat, by number.

    The repeats come innermost first, so one adds to a member only what reaches further left than all
    before it: a context that many repeats hold is told once for each step of that stair.
    """
    best, told = [-1] * len(lefts), {}
    for left, right, members in maximal_repeats(lefts, rights, length):
        for m in members:
            if left > best[m]:
                best[m] = left
                low, high = max(0, len(lefts[m]) - left), len(lefts[m]) + min(right, len(rights[m])) - length
                told.setdefault(m, []).append((low, high))
    out: dict[int, list[dict]] = {}
    for m, ranges in told.items():
        for a, b in sorted(ranges):
            mine = out.setdefault(m, [])
            if mine and a <= mine[-1]["high"] + 1:
                mine[-1]["high"] = max(mine[-1]["high"], b)
            elif a <= b:
                mine.append({"low": a, "high": b})
    return {m: ranges for m, ranges in out.items() if ranges}


#: What the tree needs of each context: its group, the names, the place of the anchor, the bytes, how often.
HELD = "key long, anchor long, content long, before long, held binary, n long"
RANGES = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
FOUND = "anchor long, content long, ranges array<struct<low:bigint,high:bigint>>"


def _held(length: int):
    """What a task sends of the contexts that are picked: each different one of a run of texts once."""

    def tell(s: Symbols, c: Contexts, pick: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
        spans = {}
        content = c.content(pick)
        for k, crowd, name, a, b in zip(pick.tolist(), crowded.tolist(), content.tolist(), c.first[pick].tolist(), (c.last[pick] + length).tolist()):
            spans.setdefault((c.anchor[k], name, bytes(s.held[a:b])), [k, crowd, 0])[2] += 1
        at = np.array([v[0] for v in spans.values()])
        names = np.array([k[1] for k in spans], np.uint64)
        key = pa.array([None if v[1] else int(c.anchor[v[0]].view(np.int64)) for v in spans.values()], pa.int64())
        return pa.RecordBatch.from_arrays(
            [key, pa.array(c.anchor[at].view(np.int64)), pa.array(names.view(np.int64)), pa.array((c.place - c.first)[at]), pa.array([k[2] for k in spans], pa.binary()), pa.array([v[2] for v in spans.values()], pa.int64())],
            ["key", "anchor", "content", "before", "held", "n"],
        )

    return tell


def _merged(held: DataFrame) -> DataFrame:
    """One row for each different context of a group, groups whole and in order; bytes that share a name are compared."""
    dealt = held.repartition("key").sortWithinPartitions("key", "content")
    each = dealt.groupBy("key", "content").agg(F.min("anchor").alias("anchor"), F.min("before").alias("before"), F.min("held").alias("held"), F.max("held").alias("other"), F.sum("n").alias("n"))
    clash = F.raise_error(F.lit("two contexts share a name")).cast("long")
    return each.withColumn("n", F.when(F.col("held") == F.col("other"), F.col("n")).otherwise(clash)).drop("other").sortWithinPartitions("key")


def _compared(held: DataFrame, length: int) -> DataFrame:
    """anchor, content, ranges: the windows of each context that lie in a maximal repeat of its group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key"]):
            n = group["n"].to_numpy()
            if n.sum() < 2:
                continue
            twice = np.flatnonzero(n > 1)
            at = np.concatenate((np.arange(len(n)), twice))
            texts, before = group["held"].to_pylist(), group["before"].to_pylist()
            told = window_ranges([texts[k][: before[k]][::-1] for k in at], [texts[k][before[k] :] for k in at], length)
            told = {k: told[k] for k in range(len(n)) if k in told}  # both copies have the same ranges
            if told:
                take = pa.array(list(told))
                yield pa.RecordBatch.from_arrays([group["anchor"].take(take).combine_chunks(), group["content"].take(take).combine_chunks(), pa.array(list(told.values()), RANGES)], ["anchor", "content", "ranges"])

    return _merged(held).mapInArrow(compare, FOUND)


def _split(crowded: DataFrame, length: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Groups (HELD) of at most ``most`` different contexts each, and ranges of groups that share a whole window.

    ``crowded`` has one row for each different context of each crowded anchor.
    """
    key = secrets.token_bytes(32)

    def wider(need: int, half: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, keys, shared = [], [], []
                names = keyed_names(key)
                for k, (anchor, at, held, left) in enumerate(zip(*(batch[c].to_pylist() for c in ("anchor", "before", "held", "left")))):
                    right = length - need - left
                    for a, b in ((left + half, right), (left, right + half)) if half else ((left, right),):
                        if a <= at and b <= len(held) - at:
                            rows.append(k), shared.append(a)
                            keys.append((held[at - a : at + b] + anchor.to_bytes(8, "little", signed=True), a))
                taken = batch.select(["anchor", "content", "before", "held", "n"]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(names(keys).view(np.int64)), *taken.columns, pa.array(shared, pa.int64())], ["key", "anchor", "content", "before", "held", "n", "left"])

        return deal

    ready, need, work = None, length - gram, crowded.withColumn("left", F.lit(0).cast("long"))
    while True:
        half = -(-need // 2)
        wide = work.mapInArrow(wider(need, half), HELD + ", left long")
        dealt = table(wide.dropDuplicates(["key", "content"]), "suffix-split")  # two groups may send a context on alike
        need -= half
        sizes = dealt.groupBy("key").agg(F.count_distinct("content").alias("contexts"), F.sum("n").alias("all")).where("all > 1")
        sizes = checkpoint(sizes)
        small = dealt.join(sizes.where(F.col("contexts") <= most).select("key"), "key").select("key", "anchor", "content", "before", "held", "n")
        ready = small if ready is None else ready.unionByName(small)
        large = dealt.join(sizes.where(F.col("contexts") > most).select("key"), "key")
        if not need or sizes.where(F.col("contexts") > most).isEmpty():
            low = F.col("before") - F.col("left")
            whole = large.select("anchor", "content", F.array(F.struct(low.alias("low"), low.alias("high"))).alias("ranges"))
            return ready, whole
        work = large


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, bits: int | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """k1, k2, spans (a, b): the bytes that repeated windows cover, of ``keyed`` documents."""
    symbols = under_key(as_bytes)
    thin = table(occurrences(rows, symbols, length, gram), "suffix-contexts")
    several = thin.groupBy("anchor", "content").count().groupBy("anchor").agg(F.sum("count").alias("n"), F.count("*").alias("contexts")).where("n > 1")
    several = checkpoint(several.select("anchor", (F.col("contexts") > most).alias("mark")))
    held = picked(rows, thin, several, symbols, length, gram, _held(length), HELD, bits, broadcast)
    if several.where("mark").isEmpty():
        return spans_of(thin, _compared(held, length), length)
    held = table(held, "suffix-held")
    crowded = held.where("key is null").groupBy("anchor", "content").agg(F.min("before").alias("before"), F.min("held").alias("held"), F.max("held").alias("other"), F.sum("n").alias("n"))
    clash = F.raise_error(F.lit("two contexts share a name")).cast("long")
    crowded = crowded.select("anchor", "content", "before", "held", F.when(F.col("held") == F.col("other"), F.col("n")).otherwise(clash).alias("n"))
    groups, whole = _split(crowded, length, gram, most)
    found = _compared(held.where("key is not null").unionByName(groups), length)
    return spans_of(thin, found.unionByName(whole), length)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST, bits: int | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """One row for each input row: doc_id, n_bytes, n_removed, spans (a, b), kept (the bytes left).

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it starts anywhere else
    too, in the same row or another; such strings may overlap. Null texts are empty; short texts lose
    nothing. Repeated rows are occurrences of each other. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length, gram, most, bits, broadcast)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, runs, kept = [], [], [], []
            for text, s in zip(batch["text"], batch["spans"].to_pylist()):
                held, stay, at = text.as_buffer() if text.is_valid else b"", [], 0
                held = bytes(held)
                runs.append(covered(s))
                for a, b in runs[-1]:
                    stay.append(held[at:a])
                    at = b
                stay.append(held[at:])
                total.append(len(held)), kept.append(b"".join(stay)), gone.append(len(held) - len(kept[-1]))
            pairs = [[{"a": a, "b": b} for a, b in r] for r in runs]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(pairs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    told = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return told.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<a:bigint,b:bigint>>, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    told = remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return told.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
