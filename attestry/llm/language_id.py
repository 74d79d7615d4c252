"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts by language and bucket are gathered by Spark, combined in each task before the shuffle, from
at most ``docs_per_language`` documents of each language, drawn by a hash of the id. The log
probabilities, a matrix of ``languages x buckets``, are broadcast, and batches of whole texts are scored in
numpy: a text's n-grams pick rows of the matrix, which are summed by text. The matrix keeps its size however many
languages there are: above ``FULL`` of them, each doubling halves the buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import bucket_of, draw, draws_for, runs, text_buffer
from attestry.llm.ngrams import char_ngrams, code_points, letters, lowered

UNKNOWN = "und"
ORDERS, BITS = (1, 2, 3), 15
FULL, LEAST_BITS = 64, 8
RUN = 1 << 19  # bytes that numpy works on at a time


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # by language
    table: np.ndarray  # by bucket and language, log probabilities
    bits: int = BITS


def _features(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram, and for each row whether it has a letter."""
    points, at = code_points(raw, at)
    is_letter = letters()[points]
    folded = np.where(is_letter, lowered()[points], 32).astype(np.uint64)
    has = np.zeros(len(at) - 1, bool)
    has[np.repeat(np.arange(len(at) - 1), np.diff(at))[is_letter]] = True
    parts = [char_ngrams(folded, at, n, BITS) for n in ORDERS]
    return np.concatenate([p[0] for p in parts]), np.concatenate([(p[1] >> (BITS - bits)) + (k << bits) for k, p in enumerate(parts)]), has


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs_per_language: int = 10_000, smoothing: float = 0.5) -> Model:
    """Learns from rows whose language is not null. Null texts teach nothing.

    A table without such rows gives a model that answers ``und``. Values of the language column are taken
    for languages: more than 8,192 of them are no languages, and raise.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw(F.col(id_col)).alias("draw"))
    most = FULL << (BITS - LEAST_BITS)
    counts = sorted((r[0], r[1]) for r in known.groupBy("lang").count().limit(most + 1).collect())
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    bits = BITS - max(0, -(-len(counts) // FULL) - 1).bit_length()
    if not counts:
        return Model([], np.zeros(0), np.zeros((len(ORDERS) << BITS, 0)))
    limits = docs.sparkSession.createDataFrame([(lang, draws_for(docs_per_language, n)) for lang, n in counts], "lang string, below long")
    sample = known.join(F.broadcast(limits), "lang").where("draw < below").select("lang", "text")  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            raw, at = text_buffer(batch["text"])
            for first, last in runs(at, RUN):
                row, bucket, _ = _features(raw[at[first] : at[last]], at[first : last + 1] - at[first], bits)
                for lang in set(langs[first:last]):
                    into = seen.setdefault(lang, np.zeros(len(ORDERS) << bits, np.int64))
                    into += np.bincount(bucket[(langs[first:last] == lang)[row]], minlength=len(into))
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "bucket", "n"])

    told = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = [lang for lang, _ in counts]
    table = np.full((len(ORDERS) << bits, len(names)), smoothing)
    place = {lang: k for k, lang in enumerate(names)}
    columns = np.array([place[x] for x in told["lang"].combine_chunks().to_pylist()], np.int64) if told.num_rows else np.zeros(0, np.int64)
    table[told["bucket"].to_numpy(), columns] += told["n"].to_numpy()
    for k in range(len(ORDERS)):  # the n-grams of an order are one draw each
        part = table[k << bits : (k + 1) << bits]
        part[:] = np.log(part / part.sum(axis=0))
    prior = np.array([n for _, n in counts], float)
    return Model(names, np.log(prior / prior.sum()), table, bits)


def score(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each row of bytes and its posterior probability."""
    names, best = [], np.zeros(len(at) - 1)
    for first, last in runs(at, RUN):
        row, bucket, has = _features(raw[at[first] : at[last]], at[first : last + 1] - at[first], model.bits)
        if not model.languages:
            names += [UNKNOWN] * (last - first)
            continue
        sums = np.stack([np.bincount(row, weights=model.table[bucket, k], minlength=last - first) for k in range(len(model.languages))], axis=1) + model.prior
        sums = np.exp(sums - sums.max(axis=1, keepdims=True))
        sums /= sums.sum(axis=1, keepdims=True)
        top = sums.argmax(axis=1)
        best[first:last] = np.where(has, sums[np.arange(last - first), top], 0.0)
        names += [model.languages[k] if ok else UNKNOWN for k, ok in zip(top, has)]
    return names, best


def language(text: Column, model: Model, spark) -> Column:
    """A struct of lang_pred and score; ``und`` with score 0 if text is null or has no letter.

    Equal scores go to the language that is first in order.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def of(column: pa.Array) -> pa.Array:
        names, best = score(shared.value, *text_buffer(column))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(best)], ["lang_pred", "score"])

    return of(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2, **options) -> DataFrame:
    """One row for each input row: doc_id, held_out, lang_pred, score.

    Rows whose crc32 of the id as text leaves ``held_out`` teach nothing. Null texts and texts
    without letters are ``und``; a null id counts as empty text; repeated rows get equal answers; an
    empty table gives an empty result. Other columns are not read.
    """
    out = bucket_of(F.col(id_col), folds) == held_out
    model = train(docs.where(~out), text_col, lang_col, id_col, **options)
    told = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), language(F.col(text_col), model, docs.sparkSession).alias("told"))
    return told.select("doc_id", "held_out", "told.*")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
