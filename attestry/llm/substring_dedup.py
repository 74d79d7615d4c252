"""Substring dedup of word windows behind a count-min prefilter.

First pass: every task counts the anchors of all windows (see ``anchors``) in a sketch of its own, the
sketches are merged, and a window counts as repeated where its anchor's cells say so. An anchor
occurs at least as often as any of its windows and a cell is never below the true count, so no
repeated window is lost. Second pass: only windows estimated repeated are written down, a context at
a time. Contexts are grouped exactly; where one anchor has several, so are their windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm import sketch
from attestry.llm.anchors import BROADCAST, as_words, covered, keyed, occurrences, of_batch, repeated_windows, spans_of, under_key
from attestry.llm.common import checkpoint, table

WORDS = 35  # fixed value of the contract
GRAM = 12


def repeated_spans(rows: DataFrame, window: int = WORDS, gram: int = GRAM, bits: int | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """k1, k2, spans (a, b): the words that repeated windows cover, of ``keyed`` documents.

    ``bits`` sets the sketch's width, which else follows from the number of anchors to expect, up to 2 ** 29
    cells; a narrow one lets more windows into the exact pass, no fewer. ``broadcast`` is the most anchors
    that travel as a sketch in that pass.
    """
    spark, words = rows.sparkSession, under_key(as_words)
    if bits is None:
        told = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = sketch.bits_for(told // 3 // (window - gram + 2), least=24)  # a word and a space are six bytes or so

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, c in of_batch(batch["text"], words, window, gram):
            yield c.anchor

    maybe = spark.sparkContext.broadcast(sketch.build(rows.select("text"), hashes, 2, bits))
    thin = table(occurrences(rows, words, window, gram, lambda a: maybe.value.passes(a)), "substring-contexts")
    sizes = thin.groupBy("anchor", "content").count()
    several = checkpoint(sizes.groupBy("anchor").count().where("count > 1").select("anchor"))
    whole = sizes.where("count > 1").select("anchor", "content", F.expr("array(struct(0L as low, cast(1e15 as long) as high))").alias("ranges"))
    parts = repeated_windows(rows, thin, several, words, window, gram, lambda df: table(df, "substring-windows"), broadcast)
    return spans_of(thin, whole.unionByName(parts), window)


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WORDS, gram: int = GRAM, bits: int | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept (the words left, joined by spaces).

    A word goes if a window of ``window`` words that covers it starts anywhere else too, in the same
    row or another. Null and short texts lose nothing; a null text has no words. Repeated rows are
    occurrences of each other. An empty table gives an empty result. Other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, window, gram, bits, broadcast)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, s in zip(batch["text"], batch["spans"].to_pylist()):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                for a, b in reversed(covered(s)):
                    del words[a:b]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    told = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return told.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    told = remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return told.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) t(i)),
r AS (SELECT rid, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
c AS (SELECT DISTINCT rid, i + j AS k FROM r, range(0, 35) t(j)),
k AS (SELECT rid, string_agg(w[k], ' ' ORDER BY k) AS kept FROM d, unnest(range(1, len(w) + 1)) t(k)
      WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rid = d.rid AND c.k = t.k) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM c GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""
