"""Language identification and the quality classifier: held-out accuracy, and what they must not read."""

from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import language_id, quality
from attestry.llm.common import mix
from attestry.llm.ngrams import FOLD, char_ngrams, code_points

#: Columns with names that the operators use inside, to show that they do not clash.
SCHEMA = "doc_id long, text string, lang string, source string, i string, y string, told string, draw string"

ENGLISH = "the house stands on the hill and the wind blows through the old trees every night"
GERMAN = "das haus steht auf dem hügel und der wind weht jede nacht durch die alten bäume"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", *["x"] * 4) for r in rows], SCHEMA)


def two_languages():
    rows = [(i, " ".join((ENGLISH if i % 2 else GERMAN).split()[i % 5 :]), "en" if i % 2 else "de") for i in range(60)]
    return [*rows, (100, None, "en"), (101, "", None), (102, "12 34 !?", "de"), (103, ENGLISH.upper() * 3000, None), (104, "İ ß ﬁ", None), (None, GERMAN, None), rows[5]]


def test_more_languages_than_the_full_matrix_has(spark):
    """Made-up languages of three words each; the buckets are halved twice."""
    words = [[f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + (7 * k + j) % 26)}q{j}z" for j in range(3)] for k in range(200)]
    rows = [(i, " ".join(words[i % 200] * 4), f"l{i % 200:03}") for i in range(1200)]
    model = language_id.train(table(spark, rows))
    assert (len(model.languages), model.bits, model.table.shape) == (200, language_id.BITS - 2, (3 << (language_id.BITS - 2), 200))
    got = language_id.identify(table(spark, rows)).where("held_out").collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id % 200:03}" for r in got]) > 0.9


def test_language_and_its_edges(spark):
    got = language_id.identify(table(spark, two_languages())).collect()
    assert len(got) == len(two_languages())
    by = {r.doc_id: r for r in got}
    for i in (100, 101, 102):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[103].lang_pred == "en" and by[None].lang_pred == "de"
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)


def test_language_does_not_learn_from_held_out_rows(spark):
    rows = two_languages()
    swapped = [(i, t, {"en": "de", "de": "en"}.get(lang) if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (language_id.identify(table(spark, x)).orderBy("doc_id", "score").collect() for x in (rows, swapped))
    assert a == b


def test_language_of_nothing(spark):
    assert language_id.identify(table(spark, [])).count() == 0
    got = language_id.identify(table(spark, [(1, "text", None)])).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)


def test_language_scores_are_naive_bayes(spark):
    """The model's numbers against sums of logarithms by hand, over a small table."""
    rows = [r for r in two_languages() if r[0] is not None and r[0] < 60]
    learn = [(t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    model = language_id.train(table(spark, [(k, t, lang) for k, (t, lang) in enumerate(learn)]))
    counts = {}
    for t, lang in learn:
        points, at = code_points(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        folded = np.where([chr(c).isalpha() for c in points], points, 32).astype(np.uint64)
        for n in language_id.ORDERS:
            for b in char_ngrams(folded, at if len(points) == len(t) else np.array([0, len(points)]), n, language_id.BITS)[1]:
                counts[lang, n, int(b)] = counts.get((lang, n, int(b)), 0) + 1
    for k, lang in enumerate(model.languages):
        for n in language_id.ORDERS:
            whole = sum(v for (x, m, _), v in counts.items() if (x, m) == (lang, n)) + 0.5 * (1 << language_id.BITS)
            for (x, m, b), v in list(counts.items())[:300]:
                if (x, m) == (lang, n):
                    assert math.isclose(model.table[b + ((n - 1) << language_id.BITS), k], math.log((v + 0.5) / whole), rel_tol=1e-9)


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = language_id.op1_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right >= 0.9


# --- quality -------------------------------------------------------------------------------------


def labelled(spark):
    rows = [(i, " ".join((ENGLISH.split() * 2)[i % 7 : i % 7 + 14]) if i % 2 else f"$$ {i} click !!! BUY NOW {i * 7} $$$ " * 3, None) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (7, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_quality_separates_and_has_defined_edges(spark):
    rows, labels = labelled(spark)
    extra = [(1000, None, None), (1001, "", None), (1002, (ENGLISH + " ") * 20_000, None), (None, "word", None), (1, rows[1][1], None)]
    got = quality.classify(table(spark, rows + extra), labels).collect()
    assert len(got) == 305
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].predicted == i % 2 for i in range(300) if by[i].held_out]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by[1000].score == by[1001].score
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) for r in got)


def test_quality_does_not_learn_from_held_out_labels(spark):
    rows, labels = labelled(spark)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality.classify(table(spark, rows), x).collect()} for x in (labels, flipped))
    assert a == b


def test_quality_without_labels_or_rows(spark):
    rows, labels = labelled(spark)
    none = labels.where("false")
    assert {round(r.score, 6) for r in quality.classify(table(spark, rows[:5]), none).collect()} == {0.5}
    assert quality.classify(table(spark, []), labels).count() == 0
    assert quality.keep_good(table(spark, []), none).count() == 0


def test_quality_fit_is_the_dual_optimum():
    """Coordinate descent reaches the optimum: gradient conditions hold at every dual variable."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12) + (20 if k % 2 else 0)) for k in range(80)]
    x = [rng.normal(size=len(r)) for r in rows]
    y = np.where(np.arange(80) % 2, 1.0, -1.0)
    most = np.where(y > 0, 0.7, 0.4)
    w, bias, alpha = quality.descend(rows, lambda i: x[i], y, most, np.arange(80), 2000, rng)
    assert np.allclose(bias, (alpha * y).sum()) and (alpha >= 0).all() and (alpha <= most).all()
    whole = np.zeros_like(w)
    for i in range(80):
        whole[rows[i]] += alpha[i] * y[i] * x[i]
    assert np.allclose(w, whole)
    slope = np.array([y[i] * (w[rows[i]] @ x[i] + bias) - 1 for i in range(80)])
    inside = (alpha > 1e-9) & (alpha < most - 1e-9)
    assert (slope[alpha <= 1e-9] > -1e-3).all() and (slope[alpha >= most - 1e-9] < 1e-3).all() and (np.abs(slope[inside]) < 1e-3).all() and inside.any()


def by_hand(text):
    """The indicators of a text, from its n-grams one by one."""
    points, out = [np.uint64(ord(c)) for c in text], set()
    for n in quality.ORDERS:
        seen = {}
        for k in range(len(points) - n + 1):
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for c in points[k : k + n]:
                    h = h * FOLD + c
                bucket = int(mix(np.array([h + np.uint64(n)]))[0] >> np.uint64(64 - quality.BITS))
            seen[bucket] = seen.get(bucket, 0) + 1
        for bucket, times in seen.items():
            for t in quality.TIMES:
                if times >= t:
                    out.add(bucket if t == 1 else int(mix(np.array([bucket + (t << 32)], np.uint64))[0] >> np.uint64(64 - quality.BITS)))
    return np.array(sorted(out), np.int64)


def test_quality_query_by_brute_force(spark, tmp_path):
    """The whole query: indicators, ratios, the fit and the curve from plain loops over a small table."""
    rows, labels = labelled(spark)
    rows = rows[:120] + [(500, None, None), (501, "", None), (502, "a" * 5000, None)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    labels = labels.where("doc_id < 120")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    learn = sorted((i, t) for i, t, _ in rows if i < 120 and zlib.crc32(str(i).encode()) % 5 != 0)
    sets, y = [by_hand(t) for _, t in learn], np.array([i % 2 for i, _ in learn])
    order = sorted(range(len(learn)), key=lambda k: (learn[k][0], sets[k].astype("<i4").tobytes()))
    rng = np.random.default_rng(7)
    held = rng.random(len(order)) < 0.2
    use = [k for k, h in zip(range(len(order)), held) if not h]
    counts = {0: {}, 1: {}}
    for k in use:
        for b in sets[order[k]].tolist():
            counts[int(y[order[k]])][b] = counts[int(y[order[k]])].get(b, 0) + 1
    size = 1 << quality.BITS
    whole = {c: sum(counts[c].values()) + size for c in (0, 1)}
    ratio = lambda b: math.log((counts[1].get(b, 0) + 1) / whole[1]) - math.log((counts[0].get(b, 0) + 1) / whole[0])
    x = [np.array([ratio(b) for b in sets[order[k]].tolist()]) for k in range(len(order))]
    x = [v / max(1e-12, math.sqrt(float(v @ v))) for v in x]
    sign = [1.0 if y[order[k]] else -1.0 for k in range(len(order))]
    most = {s: len(use) / 2 / sum(sign[k] == s for k in use) for s in (1.0, -1.0)}
    w, bias, alpha = {}, 0.0, [0.0] * len(order)
    for _ in range(20):
        for k in rng.permutation(use):
            b = sets[order[k]].tolist()
            slope = sign[k] * (sum(w.get(z, 0.0) * v for z, v in zip(b, x[k])) + bias) - 1
            new = min(max(alpha[k] - slope / (float(x[k] @ x[k]) + 1), 0.0), most[sign[k]])
            for z, v in zip(b, x[k]):
                w[z] = w.get(z, 0.0) + (new - alpha[k]) * sign[k] * v
            bias, alpha[k] = bias + (new - alpha[k]) * sign[k], new

    def margin(t):
        b = by_hand(t or "").tolist()
        v = np.array([ratio(z) for z in b])
        return sum(w.get(z, 0.0) * r for z, r in zip(b, v)) / max(1e-12, math.sqrt(float(v @ v))) + bias

    got = {r.doc_id: r for r in quality.op8_quality_classifier(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    # the curve is one logistic function of the margin: two scores fix it, and it has to give all others
    told = sorted((margin(t), math.log(got[i].score / (1 - got[i].score))) for i, t, _ in rows)
    slope = (told[-1][1] - told[0][1]) / (told[-1][0] - told[0][0])
    assert slope > 0
    for m, z in told:
        assert math.isclose(z, told[0][1] + slope * (m - told[0][0]), rel_tol=1e-6, abs_tol=1e-6)


def test_quality_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    told = quality.op8_quality_classifier(spark, sf_dir).join(labels, "doc_id").where("held_out and quality is not null")
    right, n = told.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 5 and right >= 0.6
