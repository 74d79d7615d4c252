"""Alignment, byte-level BPE and the filter audit against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import permutations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestry.llm import alignment, bpe, filter_audit
from attestry.llm.tokens import _visible

SCHEMA = "doc_id long, text string, ids string, groups string, run string, part string, mask string, n string, digest string, pairs string"
SOUP = "ab \n\t'sé漢1٣$ \x85\x1c\U0001f600reTHE ▁ <s>"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA)


def texts():
    rng = random.Random(7)
    words = ["the", "cat", "unbelievable", "zqxv", "naïve", "漢字", "12345", "don't", "<|endoftext|>", "<s>", "$%", "THE"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    made += ["".join(rng.choice(SOUP) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    made += [None, "", " ", "  ", "\n\n\n", "a" * 3000, "▁ x", "<s>", "<0x41>", "same text twice", "same text twice", "=?" * 700, " " * 900, "word\x00zero"]
    return made


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# --- alignment -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(rows, sides):
    a, b = sides
    byte = _visible()
    told, links = [], []
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)) if text else ([], [])
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        groups, low = [], 0
        for c in sorted(cuts):
            groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, span) if low <= s and e <= c) for ids, span in zip((ids_a, ids_b), spans)))
            low = c
        links.append([(x, y) for x, (s, e) in zip(ids_a, spans[0]) for y, (u, v) in zip(ids_b, spans[1]) if s < v and u < e])
        told.append((doc_id, len(ids_a), len(ids_b), len(groups), len(links[-1]), ";".join(groups)))
    counts = Counter(p for doc in links for p in doc)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(*t[:5], sum(counts[p] == best[p[1]] for p in doc), sum(counts[p] for p in doc), t[5]) for t, doc in zip(told, links)]


def order(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("run", [1 << 22, 300])
def test_alignment_matches_brute_force(spark, sides, run):
    rows = list(enumerate(texts())) + [(None, "the cat"), (None, None), (3, "the cat"), (3, "the cat")]
    right = brute_alignment(rows, sides)
    got = alignment.statistics(alignment.align(table(spark, rows).repartition(3), run=run))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(right, key=order)
    got = alignment.statistics(alignment.align(table(spark, rows), run=run, digest=True))
    assert sorted(map(tuple, got.collect()), key=order) == sorted([(*r[:7], sha(r[7].encode()) if r[7] else "") for r in right], key=order)


def test_alignment_of_nothing(spark, sides):
    assert alignment.statistics(alignment.align(table(spark, []))).count() == 0
    got = alignment.statistics(alignment.align(table(spark, [(1, None), (2, ""), (None, "")])))
    assert sorted(map(tuple, got.collect()), key=order) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_a_very_long_text(spark, sides):
    text = " ".join(random.Random(3).choices(["alpha", "beta", "gamma", "漢字", "x1"], k=200_000))
    (row,) = alignment.statistics(alignment.align(table(spark, [(5, text)]))).collect()
    assert row.n_a == len(sides[0].encode(" " + text, add_special_tokens=False).ids)
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.groups.count(";") == row.n_groups - 1


def test_a_run_is_aligned_in_pieces(monkeypatch):
    with open(public_tokenizers.path(alignment.BYTE_BPE), encoding="utf-8") as f, open(public_tokenizers.path(alignment.PIECE_BPE), "rb") as g:
        sides = alignment.Sides(f.read(), g.read())
    told, seen, plain = texts() * 40, [], alignment.Aligned
    column = pa.array(told, pa.string())
    at = np.cumsum([0, *(len((t or "").encode()) for t in told)])

    def watched(part, sides):
        seen.append((len(part), sum(len(t.encode()) for t in part)))
        return plain(part, sides)

    monkeypatch.setattr(alignment, "Aligned", watched)
    monkeypatch.setattr(alignment, "PIECE", 5000)
    counts, links, groups = alignment._pieces(column, at, sides, False)
    assert len(seen) > 5 and all(size <= 5000 or n == 1 for n, size in seen)
    x = plain([t or "" for t in told], sides)
    held, ends = x.groups()
    assert (counts == [np.diff(v) for v in (x.of_a, x.of_b, x.of_group, x.of_link)]).all() and (links == (x.link_a << 32 | x.link_b)).all()
    assert "".join(groups).encode() == bytes(held) and np.array_equal(np.cumsum([0, *(len(t) for t in groups)]), ends)


def test_query_of_alignment(spark, sides, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = alignment.statistics(alignment.align(docs))
    assert sorted(map(tuple, got.collect())) == sorted(brute_alignment(rows, sides))
    whole = alignment.op11_token_alignment(spark, sf_dir)
    assert whole.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert whole.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


# --- byte-level BPE ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_perfect_hash_is_minimal_and_never_wrong(ranks):
    keys = list(ranks)
    made = bpe.PerfectHash.build(keys)
    raw, bounds = bpe._end_to_end(keys)
    assert sorted(made.find(raw, bounds).tolist()) == list(range(len(keys)))
    others = [k + b"\x00" for k in keys] + [bytes(reversed(k)) for k in keys if bytes(reversed(k)) not in ranks]
    assert (made.find(*bpe._end_to_end(others)) == -1).all()
    one = bpe.PerfectHash.build([b"x"])
    assert one.find(*bpe._end_to_end([b"x", b"y", b"xx", b""])).tolist() == [0, -1, -1, -1]


def test_encoding_matches_the_library(ranks):
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    made = [t or "" for t in texts()]
    ids, bounds = bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(made)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [right.encode_ordinary(t) for t in made]


def test_very_long_pretokens_are_merged(ranks):
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "ab" * 30_000 + "=" * 10_001
    ids, _ = bpe.Encoder(ranks, public_tokenizers.PATTERN).encode([text, "z" * 200_000])
    assert ids.tolist() == right.encode_ordinary(text) + right.encode_ordinary("z" * 200_000)


def test_encode_and_decode_as_tables(spark, ranks):
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(texts())) + [(None, "the cat"), (3, "the cat"), (3, "the cat")]
    told = bpe.encode(table(spark, rows))
    decode = bpe.decoder(spark)
    got = sorted(map(tuple, told.withColumn("back", decode("ids")).collect()), key=order)
    assert got == sorted([(i, right.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows], key=order)
    assert bpe.encode(table(spark, [])).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([0],)], "ids array<int>")
    assert [r[0] for r in odd.select(decode("ids")).collect()] == [None, b"", b"!"]
    for wrong in ([50256], [-1], [1 << 30], [None]):
        with pytest.raises(Exception, match="vocabulary"):
            spark.createDataFrame([(wrong,)], "ids array<int>").select(decode("ids")).collect()


def test_query_of_the_codec(spark, ranks, sf_dir):
    right = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = [(i, len(ids := right.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in docs]
    assert sorted(map(tuple, bpe.op12_bpe_codec(spark, sf_dir).collect())) == sorted(expected)


# --- filter audit --------------------------------------------------------------------------------


def brute_audit(rows, labels):
    def fails(i, text, others):
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        out = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        out += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        return out + "E" * any(t == text and j is not None and (i is None or j < i) for j, t in others)

    flat = [(i, t or "", p or "") for i, t, p in rows]
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    docs = [(p, fails(i, t, [(j, u) for j, u, _ in flat]), i in good, i in toxic) for i, t, p in flat]
    out = {}
    for part in {d[0] for d in docs}:
        mine, total = [d for d in docs if d[0] == part], Counter()
        for o in permutations("ABCDE"):
            for k, f in enumerate(o):
                here = [d for d in mine if not set(d[1]) & set(o[:k])]
                lost = [d for d in here if f in d[1]]
                total[f] += len(lost)
                out[part, "".join(o), k + 1] = [
                    len(here) - len(lost), len(lost), sum(f in d[1] for d in mine) - len(lost), sum(d[1] == f for d in mine), sum(d[2] for d in lost), sum(d[3] for d in lost), f,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]]
    return sorted((*k, *v) for k, v in out.items())


def test_audit_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["BIG", "LOUD", "a#b", "50%"]
    rows = [(k, " ".join(rng.choices(vocabulary if k % 3 else vocabulary[:90], k=rng.choice([5, 99, 100, 140]))), rng.choice(["en", "de", None, ""])) for k in range(60)]
    rows += [(100 + k, rows[k % 3][1], "fr") for k in range(20)] + [(-1, rows[0][1], "en"), (None, rows[1][1], "en"), (None, "only null", "en"), (None, "only null", "xx"), (7, rows[7][1], "de")]
    rows += [(300, None, "en"), (301, "", None), (302, " \t\n", "en"), (303, "x " * 60_000, "en"), (304, "ÄÖÜ" * 40, "en"), (305, "A&B", None)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 60, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1), (100, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", "y", "z", "q") for r in rows], "doc_id long, text string, lang string, good string, toxic string, mask string, cell string").repartition(5)
    told = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = filter_audit.interactions(filter_audit.cells(docs, told))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(filter_audit.cells(docs, labels)).count() == 0
    docs = spark.createDataFrame([(1, "a", None), (1, "a", None)], "doc_id long, text string, lang string")
    got = filter_audit.interactions(filter_audit.cells(docs, labels))
    assert got.count() == 600 and got.where("filter_order like 'A%' and step = 1").select("removed", "unique_fails").distinct().collect() == [(2, 2)]
    assert got.agg(F.max("shapley")).first()[0] == 240
