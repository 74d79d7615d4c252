"""The corpus pipeline, stage by stage against brute force on its own input."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestry.llm import mixing, packing, quality

from .test_dedup import brute_components, near_corpus, words_of
from .test_tables import brute_targets, checked_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents and labels: good prose, junk, exact and near copies."""
    rows = [(i, t, "abc"[i % 3]) for i, t in near_corpus() if t and len(t) > 60 and i != 11]
    rows += [(2000 + k, rows[k][1].replace(" ", "  "), "b") for k in range(20)]
    rows += [(3000 + k, f"$$$ {k} !!! >>> " * 12, "c") for k in range(60)]
    rows += [(4000, None, None), (4001, "", "a")]
    d = str(tmp_path_factory.mktemp("corpus"))
    table(spark, rows).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i < 3000), 0) for i, _, _ in rows if i % 2 == 0 and i < 4000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, {i: (t, s) for i, t, s in rows}


def test_every_stage_against_brute_force(spark, corpus):
    d, every = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    # quality: the documents that the model scores at the threshold or more
    good = corpus_pipeline.good_quality(spark, docs, d)
    assert good.schema == docs.schema
    kept = {r.doc_id for r in good.collect()}
    told = quality.classify(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()
    assert kept == {r.doc_id for r in told if r.predicted == 1}
    assert sum(i < 3000 for i in kept) >= 0.97 * sum(i < 3000 for i in every) and not any(3000 <= i < 4000 for i in kept)
    # exact copies: the smallest id of each text
    first = {}
    for i in kept:
        flat = re.sub(r"[\x20\x09-\x0D]+", " ", every[i][0] or "")
        first[flat] = min(i, first.get(flat, i))
    exact = corpus_pipeline.exact_copies(spark, good, d)
    assert exact.schema == docs.schema and sorted(r.doc_id for r in exact.collect()) == sorted(first.values())
    # near copies: one of each component at five words and 0.8
    ids = sorted(first.values())

    def shingles(i):
        w = words_of((every[i][0] or "").lower())
        return frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([" ".join(w)])

    of = brute_components([shingles(i) for i in ids], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    want = {ids[c] for c in of}
    near = corpus_pipeline.near_copies(spark, exact, d)
    got = {r.doc_id for r in near.collect()}
    assert near.schema == docs.schema and want == got
    # mixing: sources reach their targets to within half a document
    mixed = corpus_pipeline.mixed(spark, near, d)
    assert mixed.schema == docs.schema
    sizes, taken, most = {}, {}, {}
    for i in got:
        n, s = len(words_of(every[i][0])), every[i][1]
        sizes[s], most[s] = sizes.get(s, 0) + n, max(n, most.get(s, 0))
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len(words_of(r.text))
    for s, goal in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - goal) <= most[s] / 2 + 1
    # packing: every row of the mix, whole
    packed = corpus_pipeline.packed(spark, mixed, d).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert sum(r.start == 0 for r in packed) == mixed.count()
    checked_pieces([(i, every[i][0]) for i in {r.doc_id for r in packed}], _once(packed), packing.WINDOW)


def _once(packed):
    """The pieces with repeats of a document renamed away: sequences stay whole, documents are told once."""
    seen, out = {}, []
    for r in packed:
        n = seen.get((r.doc_id, r.start), 0)
        seen[r.doc_id, r.start] = n + 1
        out.append((n, r))
    if all(n == 0 for n, _ in out):
        return [r for _, r in out]
    rows = [r for n, r in out if n == 0]  # sequences get gaps, so each piece is put in one of its own
    return [type(r)(**{**r.asDict(), "sequence_id": k, "offset": 0}) for k, r in enumerate(rows)]


def test_run_is_the_stages_in_order(spark, corpus):
    d, _ = corpus
    got = corpus_pipeline.run(spark, d)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    again = corpus_pipeline.run(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_stages_take_nothing(spark, corpus):
    d, _ = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), d).count() == 0


def test_registered(spark, sf_dir):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert mixing.op7_mix_sources(spark, sf_dir).select(F.count("*")).first()[0] == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
