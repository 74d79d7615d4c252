"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of hashed character n-grams, told by how often the text holds them (once, twice, four times and
so on), are scaled by the log-count ratio of the two classes; a linear hinge-loss model over them is fitted by dual coordinate descent, and its margins become probabilities
through a logistic curve fitted on a part of the sample that the model has not seen. The sample has
at most about ``sample`` labelled documents, drawn by a hash of the id; every text is scored, whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import bucket_of, distinct, draw, draws_for, mix, runs, text_buffer
from attestry.llm.ngrams import char_ngrams, code_points

ORDERS, BITS = (1, 2, 3), 18
TIMES = (1, 2, 4, 8, 16)
RUN = 1 << 19
THRESHOLD = 0.3  # fixed value of the contract


def indicators(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each distinct indicator of each row, rows in order.

    An indicator says that a text holds a character n-gram, case kept, so many ``TIMES`` or more: texts
    that only repeat themselves hold good n-grams, but too often.
    """
    points, bounds = code_points(raw, at)
    keys, low = [], (1 << BITS) - 1
    for n in ORDERS:
        row, bucket = char_ngrams(points, bounds, n, BITS)
        held, times = np.unique((row << BITS) | bucket, return_counts=True)
        for t in TIMES:
            held, times = held[times >= t], times[times >= t]
            named = mix((held & low).astype(np.uint64) + np.uint64(t << 32)) >> np.uint64(64 - BITS) if t > 1 else (held & low).astype(np.uint64)
            keys.append((held & ~low) | named.astype(np.int64))
    every = distinct(np.concatenate(keys))
    return every >> BITS, every & low


@dataclass
class Model:
    ratio: np.ndarray  # by bucket: log-count ratio
    weight: np.ndarray  # by bucket
    bias: float
    slope: float
    shift: float

    def margins(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at) - 1)
        for first, last in runs(at, RUN):
            row, bucket = indicators(raw[at[first] : at[last]], at[first : last + 1] - at[first])
            r = self.ratio[bucket]
            norm = np.sqrt(np.bincount(row, weights=r * r, minlength=last - first))
            out[first:last] = np.bincount(row, weights=r * self.weight[bucket], minlength=last - first) / np.maximum(norm, 1e-12) + self.bias
        return out

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(raw, at) + self.shift, -500, 500)))


def descend(rows: list[np.ndarray], x: Callable[[int], np.ndarray], y: np.ndarray, most: np.ndarray, use: np.ndarray, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge loss, by coordinate descent over the rows ``use``.

    ``x`` gives the values of a row's buckets, ``y`` holds labels of -1 and 1, ``most`` each dual variable's upper
    bound. The bias is one more feature of value one.
    """
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        for i in rng.permutation(use):
            at, xi = rows[i], x(i)
            slope = y[i] * (float(w[at] @ xi) + bias) - 1
            new = min(max(alpha[i] - slope / (float(xi @ xi) + 1), 0.0), most[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * xi
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w, bias, alpha


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 20, smoothing: float = 1.0, seed: int = 7) -> Model:
    """Fits on lists of buckets and labels 0 or 1. With one class only, every score is its share."""
    size = 1 << BITS
    share = (labels.sum() + 1) / (len(labels) + 2)
    flat = Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))
    if len(set(labels.tolist())) < 2:
        return flat
    rng = np.random.default_rng(seed)
    held = rng.random(len(rows)) < 0.2
    if len(set(labels[~held].tolist())) < 2 or len(set(labels[held].tolist())) < 2:
        held[:] = False
    use = np.flatnonzero(~held)
    sums = [np.full(size, smoothing), np.full(size, smoothing)]
    for i in use:
        sums[int(labels[i])][rows[i]] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    y = np.where(labels == 1, 1.0, -1.0)
    most = {k: cost * len(use) / 2 / max(1, (y[use] == k).sum()) for k in (1.0, -1.0)}  # each class weighs the same
    norm = [max(1e-12, float(np.linalg.norm(ratio[r]))) for r in rows]
    x = lambda i: ratio[rows[i]] / norm[i]  # noqa: E731  not held: there are as many values as indicators
    w, bias, _ = descend(rows, x, y, np.array([most[k] for k in y]), use, epochs, rng)
    # a logistic curve over margins, by Newton's method, with softened targets
    part = np.flatnonzero(held) if held.any() else use
    m = np.array([float(w[rows[i]] @ x(i)) + bias for i in part])
    good = labels[part].sum()
    goal = np.where(labels[part] == 1, (good + 1) / (good + 2), 1 / (len(part) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - goal) * m).sum() + 1e-3 * a, (p - goal).sum()])
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return Model(ratio, w, float(bias), float(a), float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, sample: int = 6_000, **options) -> Model:
    """Learns from labelled rows outside the held-out fold. Null labels and ids teach nothing.

    A document with several labels takes the more frequent one, 1 in a tie.
    """
    told = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).alias("y"))
    told = told.where(bucket_of(F.col("i"), folds) != held_out)
    n = max(1, told.count())
    drawn = told.where(draw("i") < draws_for(sample, n))
    drawn = drawn.groupBy("i").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "i")  # about ``sample`` ids

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch["text"])
            for first, last in runs(at, RUN):
                row, bucket = indicators(raw[at[first] : at[last]], at[first : last + 1] - at[first])
                cuts = np.searchsorted(row, np.arange(1, last - first))
                sets = [b.astype("<i4").tobytes() for b in np.split(bucket, cuts)]
                yield pa.RecordBatch.from_arrays([batch["i"].slice(first, last - first), batch["y"].slice(first, last - first), pa.array(sets, pa.binary())], ["i", "y", "buckets"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = texts.select("i", "y", "text").mapInArrow(featurise, f"i {kind}, y int, buckets binary").toArrow()
    ids, y = got["i"].to_pylist(), got["y"].to_pylist()
    sets = [np.frombuffer(b.as_buffer(), "<i4") for b in got["buckets"]]  # as they arrived, not copied
    order = sorted(range(len(ids)), key=lambda k: (ids[k], zlib.crc32(sets[k]), y[k]))  # whatever the order of arrival
    return fit([sets[k] for k in order], np.array([y[k] for k in order], np.int64), **options)


def quality(text: Column, model: Model, spark) -> Column:
    """The probability that the text is of label 1; null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(*text_buffer(column)))

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted (1 if score >= 0.3).

    Null and empty texts are scored like any text without n-grams. Repeated rows get equal answers;
    without labels every score is one half; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, folds, held_out, **options)
    told = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(F.col(id_col), folds) == held_out).alias("held_out"), quality(F.col(text_col), model, docs.sparkSession).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that the classifier does not reject, with all their columns. Nulls as in ``classify``."""
    model = train(docs, labels, id_col, text_col, **options)
    return docs.where(quality(F.col(text_col), model, docs.sparkSession) >= THRESHOLD)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
